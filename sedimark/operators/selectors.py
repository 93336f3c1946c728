"""Coverage checks that look into structure: selectors of Python and TypeScript facts, fragments over concatenated assertions, and golden groups.

Evidence meets requirements by equi-joins: on the path, kind and name that a selector states, or on the prefixes of a locator. What lies inside a function is told by
pre- and post-order numbers of syntax nodes, an interval test on rows that already share artifact and function name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from . import ordering

#: Rows of extractors and of explode are many times those that the planner counts, as it goes by the bytes of what they are made of: sides that hold such rows aren't broadcast.
MADE = "merge"

SELECTOR = (
    "requirement_id string, place int, artifact string, kind string, scope string, name string, args_contains array<string>, keywords map<string,string>, value_call string, contains string, inside string"
)


def _absent_or(all_of: Column, ok: Column) -> Column:
    return all_of.isNull() | ok


def python_matches(nodes: DataFrame, selectors: DataFrame) -> DataFrame:
    """(requirement_id, place, label, locator): the syntax nodes that each selector finds; a null locator for one that finds none.

    nodes: from extract.python_nodes. selectors (SELECTOR): kind `function` by qualified name; `call` by scope and callee, with texts that arguments contain and keywords; `assignment` by scope, target and called
    value, with its keywords; `assert` by scope and a text that its expression contains. `inside`: only nodes within a function or class of this qualified name. Texts are compared without case
    and runs of whitespace; a keyword that isn't there reads as `None`.
    """
    key = F.when(F.col("kind") == "assignment", F.col("targets")).when(F.col("kind") == "assert", F.array(F.lit(""))).otherwise(F.array("name"))
    found = nodes.select(
        F.col("source_locator").alias("artifact"), "kind", F.explode(F.array_distinct(key)).alias("key"), F.col("scope").alias("n_scope"), "args", F.col("keywords").alias("n_keywords"), F.col("value_call").alias("n_value_call"),
        "value_keywords", "expression", "pre", "post", "locator",
    ).hint(MADE)
    asked = selectors.withColumn("key", F.when(F.col("kind") == "assert", F.lit("")).otherwise(F.col("name")))
    met = asked.join(found, ["artifact", "kind", "key"])
    inner = found.where("kind in ('function', 'class')").select("artifact", F.col("key").alias("inside"), F.col("pre").alias("from_"), F.col("post").alias("to_")).hint(MADE)
    observed = F.when(F.col("kind") == "assignment", F.col("value_keywords")).otherwise(F.col("n_keywords"))
    ok = (
        ((F.col("kind") == "function") | F.col("scope").eqNullSafe(F.col("n_scope")))
        & F.forall(F.coalesce("args_contains", F.array().cast("array<string>")), lambda f: F.exists("args", lambda a: F.contains(C.folded(a), C.folded(f))))
        & _absent_or(F.col("keywords"), F.forall(F.map_entries("keywords"), lambda e: F.coalesce(F.try_element_at(observed, e["key"]), F.lit("None")) == e["value"]))
        & _absent_or(F.col("value_call"), F.col("value_call").eqNullSafe(F.col("n_value_call"))) & _absent_or(F.col("contains"), F.contains(C.folded("expression"), C.folded("contains")))
    )
    fits = met.where(F.coalesce(ok, F.lit(False)))
    free = fits.where("inside is null").select("requirement_id", "place", "locator")
    within = fits.join(inner, ["artifact", "inside"]).where("from_ < pre and post < to_").select("requirement_id", "place", "locator")
    label = (
        F.when(F.col("kind") == "assignment", F.concat_ws(":", F.lit("assignment"), "scope", "name", "value_call")).when(F.col("kind") == "assert", F.concat_ws(":", F.lit("assert"), "scope", "contains"))
        .when(F.col("kind") == "function", F.concat_ws(":", F.lit("function"), "name")).otherwise(F.concat_ws(":", "kind", "scope", "name"))
    )
    return selectors.select("requirement_id", "place", label.alias("label")).join(free.unionByName(within).distinct().hint(MADE), ["requirement_id", "place"], "left")


def bundle_matches(facts: DataFrame, comments: DataFrame, selectors: DataFrame) -> DataFrame:
    """(requirement_id, place, label, locator) of TypeScript selectors: requirement_id, place, artifact, kind, field, contains, equals.

    Kind `comment` looks for a text in the comments of the artifact, every other kind for facts of that kind whose field contains or equals a text; exactly one of both is given.
    """
    value = F.expr("get_json_object(normalized_value, concat('$.', field))")
    met = selectors.where("kind <> 'comment'").join(facts.select(F.col("source_locator").alias("artifact"), F.get_json_object("normalized_value", "$.kind").alias("kind"), "normalized_value", "locator").hint(MADE), ["artifact", "kind"])
    ok = F.when(F.col("contains").isNotNull(), F.contains(C.folded(F.coalesce(value, F.lit(""))), C.folded("contains"))).otherwise(F.coalesce(value, F.lit("None")) == F.col("equals"))
    said = selectors.where("kind = 'comment'").join(comments.select(F.col("source_locator").alias("artifact"), "statement", "locator").hint(MADE), "artifact").where(F.contains(C.folded("statement"), C.folded("contains")))
    found = met.where(ok).select("requirement_id", "place", "locator").unionByName(said.select("requirement_id", "place", "locator"))
    label = F.when(F.col("kind") == "comment", F.concat_ws(":", "kind", "contains")).otherwise(F.concat_ws(":", F.lit("fact"), "kind", "field", F.coalesce("contains", "equals")))
    return selectors.select("requirement_id", "place", label.alias("label")).join(found.distinct().hint(MADE), ["requirement_id", "place"], "left")


def assessed(matches: DataFrame) -> DataFrame:
    """(requirement_id, status, matched_locators, missing): `recovered` where every selector found something, with the places in order of the selectors; else `gap` with the labels of the others."""
    hit = F.col("locator").isNotNull()
    ordered = lambda c, keep: F.transform(F.array_sort(F.array_distinct(F.collect_list(F.when(keep, F.struct("place", F.col(c).alias("x")))))), lambda s: s["x"])
    out = matches.groupBy("requirement_id").agg(ordered("locator", hit).alias("found"), ordered("label", ~hit).alias("missing"))
    whole = F.size("missing") == 0
    return out.select("requirement_id", F.when(whole, "recovered").otherwise("gap").alias("status"), F.when(whole, F.array_distinct("found")).otherwise(F.array().cast("array<string>")).alias("matched_locators"), "missing")


# locators and fragments


def locator_prefixes(locator: Column | str) -> Column:
    """What stands before each `:` and `#` of a locator: every artifact that the locator may belong to."""
    at = C.col(locator)
    marks = F.filter(F.sequence(F.lit(1), F.greatest(F.length(at), F.lit(1))), lambda k: F.substr(at, k, F.lit(1)).isin(":", "#"))
    return F.transform(marks, lambda k: F.substr(at, F.lit(1), k - 1))


def by_prefix(evidence: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Evidence (with a locator) with the artifact of `artifacts` whose locators begin with it and `:` or `#`. The prefixes make it an equi-join; a locator may belong to several."""
    return evidence.withColumn("artifact", F.explode(F.array_distinct(locator_prefixes("locator")))).join(artifacts.select("artifact").distinct().hint(MADE), "artifact")


def fragments_covered(requirements: DataFrame, assertions: DataFrame, order: list[str], block: int = 1_000) -> DataFrame:
    """requirements (artifact, fragment and others) with whether the artifact's assertions, one after the other in their order, hold the fragment; it may run over several of them.

    Statements are numbered by ranges and put together in blocks, each with as many statements of the next block as the longest fragment has words, and a statement has one at least: so
    no fragment is cut, and no group grows with the artifact.
    """
    said = by_prefix(assertions, requirements).withColumn("statement", C.folded("statement")).where("statement <> ''")
    need = requirements.select("artifact", "fragment").distinct().withColumn("f", C.folded("fragment"))
    reach = need.agg(F.max(F.size(F.split("f", " ")))).first()[0] or 1
    size = max(block, reach)
    placed = ordering.numbered(said.select("artifact", "statement", *order), "n", ["artifact"], [*order, "statement"]).withColumn("n", F.col("n") - 1)
    own = F.floor(F.col("n") / size).cast("long")
    both = placed.withColumn("block", F.explode(F.when((F.col("n") % size < reach) & (own > 0), F.array(own, own - 1)).otherwise(F.array(own))))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "statement"))), lambda s: s["statement"]), " ")
    blocks = both.groupBy("artifact", "block").agg(text.alias("text"))
    met = need.join(blocks, "artifact").where(F.contains("text", F.col("f"))).select("artifact", "fragment").distinct().withColumn("covered", F.lit(True))
    return requirements.join(met, ["artifact", "fragment"], "left").withColumn("covered", F.coalesce("covered", F.lit(False)))


# golden groups


def golden_supports(groups: DataFrame, records: DataFrame) -> DataFrame:
    """(group_id, locator, n_records, fault, support_id): the one record that each locator of an expected observation names.

    No record and several records are different faults; neither has a support.
    """
    named = records.groupBy("locator").agg(F.count("*").alias("n"), F.min("record_id").alias("record_id"))
    met = groups.select("group_id", "locator").distinct().join(named, "locator", "left")
    n = F.coalesce("n", F.lit(0))
    return met.select("group_id", "locator", n.alias("n_records"), F.when(n == 0, "no record").when(n > 1, "several records").alias("fault"), F.when(n == 1, F.col("record_id")).alias("support_id"))


def golden_cover(groups: DataFrame, records: DataFrame) -> DataFrame:
    """(group_id, n_locators, n_missing, n_ambiguous, covered): expected observations of which every locator names one record."""
    s = golden_supports(groups, records)
    return s.groupBy("group_id").agg(
        F.count("*").alias("n_locators"), F.count_if(F.col("n_records") == 0).alias("n_missing"), F.count_if(F.col("n_records") > 1).alias("n_ambiguous"), F.every(F.col("fault").isNull()).alias("covered"),
    )
