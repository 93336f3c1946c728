"""Identities of repositories: provider ids, names and aliases that belong together.

Names that a repository had stay its aliases, so sightings hang together in chains. They are components of a graph of ids and names; a component has at most one source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..sources.tables import written


def components(links: DataFrame) -> DataFrame:
    """(node, component): the least node that each node of links (a, b) reaches. A round takes the least label of neighbours and then the label of that label, so long chains shrink by
    doubling; it ends in a written table, and the driver sees one number."""
    edges = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a is not null and b is not null").distinct())
    labels = written(edges.groupBy("a").agg(F.least("a", F.min("b")).alias("label")).select(F.col("a").alias("node"), "label"))
    while True:
        near = edges.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        hop = written(labels.join(near, "node").select("node", "label", F.least("label", "near").alias("low")))
        up = hop.select(F.col("node").alias("low"), F.col("low").alias("up"))
        new = written(hop.join(up, "low").select("node", "label", F.least("low", "up").alias("new")))
        changed = new.where("new <> label").limit(1).count()
        labels = new.select("node", F.col("new").alias("label"))
        if not changed:
            return labels.select("node", F.col("label").alias("component"))


def merged(sightings: DataFrame, known: DataFrame) -> DataFrame:
    """(hit_id, state, source_id, component, aliases) of sightings: hit_id, provider_repository_id (null without metadata), name, aliases array, observed_at.

    known: provider_repository_id, source_id. `conflict`: the ids and names of the component belong to several sources, so it names none; `resolved`: to one; `created`: to none yet, and the source's
    identity comes from the component; `unresolved`: no provider id anywhere in it. Sightings that come again give the same rows. A source's aliases are its names but the last observed one.
    """
    rows = written(sightings.select("hit_id", F.concat(F.lit("p:"), "provider_repository_id").alias("p"), F.concat(F.lit("n:"), F.lower("name")).alias("n"), "name", F.coalesce("aliases", F.array().cast("array<string>")).alias("others"), "observed_at"))
    alias = rows.select("n", F.explode("others").alias("x")).select(F.col("n").alias("a"), F.concat(F.lit("n:"), F.lower("x")).alias("b"))
    own = rows.select("n", F.coalesce("p", "n").alias("b")).select(F.col("n").alias("a"), "b")
    of = components(own.unionByName(alias))
    sources = known.select(F.concat(F.lit("p:"), "provider_repository_id").alias("node"), "source_id").join(of, "node").groupBy("component").agg(F.count_distinct("source_id").alias("n_sources"), F.min("source_id").alias("source_id"))
    ids = of.where("node like 'p:%'").groupBy("component").agg(F.min("node").alias("provider"))
    names = (
        rows.select(F.col("n").alias("node"), F.col("name"), F.col("observed_at")).unionByName(rows.select(F.col("n").alias("node"), F.explode("others").alias("name"), F.lit(None).alias("observed_at"))).join(of, "node")
        .groupBy("component").agg(F.collect_set(F.lower("name")).alias("names"), F.max_by(F.lower("name"), F.struct("observed_at", "name")).alias("latest"))
    )
    state = F.when(F.col("n_sources") > 1, "conflict").when(F.col("n_sources") == 1, "resolved").when(F.col("provider").isNotNull(), "created").otherwise("unresolved")
    each = names.join(sources, "component", "left").join(ids, "component", "left").withColumn("state", state)
    source = F.when(F.col("state") == "resolved", F.col("source_id")).when(F.col("state") == "created", C.identity("source", F.expr("substring(provider, 3)")))
    each = each.select("component", "state", source.alias("source_id"), F.array_sort(F.array_remove("names", F.col("latest"))).alias("aliases"))
    return rows.select("hit_id", F.col("n").alias("node")).join(of, "node").join(each, "component").select("hit_id", "state", "source_id", "component", "aliases")


def shared_sources(sightings: DataFrame, known: DataFrame) -> DataFrame:
    """(component, n_hits): the guard's rows, components that belong to several sources."""
    return merged(sightings, known).where("state = 'conflict'").groupBy("component").agg(F.count("*").alias("n_hits"))
