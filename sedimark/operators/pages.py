"""Paged collections: what makes one complete, and its items in order.

Pages: request, page (from 1), page_size, total (null where the provider doesn't tell), status, merge_base (null for lists that have none), items.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .planning import MAX_COMMITS

#: The most pages of a list that is read until a short page.
MAX_PAGES = 100


def page_faults(pages: DataFrame, ceiling: int = MAX_PAGES) -> DataFrame:
    """(request, fault) of collections that aren't whole or that changed while they were read. One aggregate by request over the pages' sizes, without their items."""
    n = F.size("items")
    found = pages.groupBy("request").agg(
        F.count("*").alias("n"), F.count_distinct("page").alias("d"), F.min("page").alias("low"), F.max("page").alias("high"), F.sum(n.cast("long")).alias("items"), F.max_by(n, "page").alias("tail"), F.max("page_size").alias("size"),
        F.count_distinct(F.struct(F.col("page_size"))).alias("sizes"), F.count_if(n < F.col("page_size")).alias("short"), F.count_if(F.coalesce(F.col("status") != 200, F.lit(True))).alias("failed"),
        F.count_distinct(F.struct("total")).alias("totals"), F.max("total").alias("total"), F.count_distinct(F.struct("merge_base")).alias("bases"), F.count_if(n > F.col("page_size")).alias("long"),
    )
    last_short = F.col("tail") < F.col("size")
    rules = {
        "page failed": F.col("failed") > 0, "page twice": F.col("n") > F.col("d"), "page missing": (F.col("low") != 1) | (F.col("high") != F.col("d")), "over the ceiling": F.col("high") > ceiling,
        "page sizes differ": F.col("sizes") > 1, "page too long": F.col("long") > 0, "short page before the last": F.col("short") > last_short.cast("int"), "total changed": F.col("totals") > 1, "merge base changed": F.col("bases") > 1,
        # without a total only a short page tells the end
        "end not seen": F.col("total").isNull() & ~last_short, "not as many as declared": (F.col("totals") == 1) & (F.col("items") != F.col("total")),
    }
    return found.select("request", F.explode(F.array_compact(F.array(*(F.when(c, F.lit(t)) for t, c in rules.items())))).alias("fault"))


def assembled(pages: DataFrame, ceiling: int = MAX_PAGES) -> DataFrame:
    """(request, ordinal, item) of the whole collections, numbered from 1 in order; those with faults are left out (page_faults lists them). Pages before the last are full, so a page knows its items' places."""
    whole = pages.join(page_faults(pages, ceiling).select("request").distinct(), "request", "left_anti")
    return whole.select("request", ((F.col("page") - 1) * F.col("page_size")).cast("long").alias("before"), F.posexplode("items").alias("at", "item")).select("request", (F.col("before") + F.col("at") + 1).alias("ordinal"), "item")


def range_faults(pages: DataFrame, ranges: DataFrame, ceiling: int = MAX_COMMITS) -> DataFrame:
    """(request, fault) of commit ranges: ranges have request, base, head, range_status; items are commit ids in order, the oldest first.

    A range is ahead of its base, or identical to it and empty; its merge base is its base, it has no commit twice, at most `ceiling` of them, and ends at its head.
    """
    faults = page_faults(pages, ceiling)
    items = pages.select("request", F.col("page").alias("p"), F.posexplode("items").alias("at", "item"))
    ends = items.groupBy("request").agg(F.count("*").alias("n"), F.count_distinct("item").alias("d"), F.max_by("item", F.struct("p", "at")).alias("last"))
    of = pages.groupBy("request").agg(F.max("merge_base").alias("merge_base"))
    met = ranges.join(of, "request", "left").join(ends, "request", "left").fillna(0, ["n", "d"])
    same = F.col("range_status") == "identical"
    rules = {
        "unknown status": ~F.col("range_status").isin("ahead", "identical"), "merge base isn't the base": ~F.col("merge_base").eqNullSafe(F.col("base")), "commits in an identical range": same & ((F.col("n") > 0) | (F.col("base") != F.col("head"))),
        "no commits": (F.col("range_status") == "ahead") & (F.col("n") == 0), "repeated commits": F.col("n") > F.col("d"), "over the commit ceiling": F.col("n") > ceiling, "doesn't end at the head": (F.col("range_status") == "ahead") & (F.col("n") > 0) & (F.col("last") != F.col("head")),
    }
    return faults.unionByName(met.select("request", F.explode(F.array_compact(F.array(*(F.when(c, F.lit(t)) for t, c in rules.items())))).alias("fault")))
