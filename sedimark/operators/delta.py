"""Change operators: null-safe full outer joins of two captures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C


def _sides(previous: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """Both sides by key; every other column as previous_* and current_*, and whether a side has the key."""
    side = lambda df, s: df.select(*keys, *(F.col(c).alias(f"{s}_{c}") for c in df.columns if c not in keys), F.lit(True).alias(f"in_{s}"))
    return side(previous, "previous").join(side(current, "current"), keys, "full_outer").fillna(False, ["in_previous", "in_current"])


def artifact_change(prev: str = "previous", cur: str = "current") -> Column:
    c = lambda s, x: F.col(f"{s}_{x}")
    was, now = c(prev, "retrieval_status"), c(cur, "retrieval_status")
    return (
        F.when(~F.col(f"in_{prev}"), "capture_scope_added").when(~F.col(f"in_{cur}"), "capture_scope_removed")
        .when((was == "missing") & (now == "missing"), None)
        .when((was == "missing") & (now == "captured"), "became_captured").when((was == "captured") & (now == "missing"), "became_missing")
        .when(~c(prev, "content_hash").eqNullSafe(c(cur, "content_hash")), "content_changed")
        .when(~c(prev, "media_type").eqNullSafe(c(cur, "media_type")), "metadata_changed")
    )


def artifact_deltas(previous: DataFrame, current: DataFrame, run: str = "run") -> DataFrame:
    """Changed artifacts by path. Sides: source_locator, content_hash, media_type, retrieval_status."""
    return (
        _sides(previous, current, ["source_locator"]).withColumn("change_type", artifact_change()).where("change_type is not null")
        .withColumn("artifact_delta_id", C.identity("artifact-delta", F.lit(run), "source_locator")).drop("in_previous", "in_current")
    )


def keyed_facts(facts: DataFrame) -> DataFrame:
    """Facts by path, extractor and place within the path."""
    return facts.withColumn("relative_locator", F.expr("substring(locator, length(source_locator) + 1)")).select(
        "source_locator", "extractor_name", "extractor_version", "relative_locator", F.col("normalized_value").alias("value")
    )


FACT_KEY = ["source_locator", "extractor_name", "extractor_version", "relative_locator"]


def structural_deltas(previous: DataFrame, current: DataFrame, artifact_changes: DataFrame, gaps: DataFrame | None = None, run: str = "run") -> DataFrame:
    """Facts added, removed or modified in paths that both captures hold. Paths in gaps (source_locator) are left out on both sides."""
    if gaps is not None:
        out = gaps.select("source_locator").distinct()
        previous, current = (x.join(out, "source_locator", "left_anti") for x in (previous, current))
    both = artifact_changes.where(F.col("change_type").isin("content_changed", "metadata_changed")).select("source_locator", "artifact_delta_id")
    change = F.when(~F.col("in_previous"), "added").when(~F.col("in_current"), "removed").when(~F.col("previous_value").eqNullSafe(F.col("current_value")), "modified")
    return (
        _sides(keyed_facts(previous), keyed_facts(current), FACT_KEY).withColumn("change_type", change).where("change_type is not null").join(both, "source_locator")
        .withColumn("structural_key", F.concat("extractor_name", F.lit("@"), "extractor_version", F.lit(":"), F.when(F.col("relative_locator") == "", F.lit("#root")).otherwise(F.col("relative_locator"))))
        .withColumn("structural_delta_id", C.identity("structural-delta", F.lit(run), "artifact_delta_id", "structural_key", "change_type")).drop("in_previous", "in_current")
    )


def unexplained_structure(previous: DataFrame, current: DataFrame, artifact_changes: DataFrame) -> DataFrame:
    """Facts that differ although their path, on both sides, didn't change: extraction wasn't deterministic."""
    paths = keyed_facts(previous).select("source_locator").intersect(keyed_facts(current).select("source_locator"))
    differs = _sides(keyed_facts(previous), keyed_facts(current), FACT_KEY).where("not (in_previous and in_current and previous_value <=> current_value)")
    return differs.join(paths, "source_locator", "left_semi").join(artifact_changes, "source_locator", "left_anti").select(*FACT_KEY)


def assertion_signatures(assertions: DataFrame) -> DataFrame:
    """Each path's statements with their extractors, sorted, repeats kept, places left out, as a digest."""
    one = F.struct("extractor_name", "extractor_version", "statement")
    return assertions.groupBy("source_locator").agg(F.array_sort(F.collect_list(one)).alias("s")).select("source_locator", F.sha2(F.to_json("s"), 256).alias("signature"), F.size("s").cast("long").alias("n_statements"))


def assertion_changes(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Paths whose statements changed; a path without any counts as an empty list."""
    return _sides(assertion_signatures(previous), assertion_signatures(current), ["source_locator"]).where("not previous_signature <=> current_signature").select(
        "source_locator", F.coalesce("previous_n_statements", F.lit(0)).alias("previous_n"), F.coalesce("current_n_statements", F.lit(0)).alias("current_n")
    )


def tree_deltas(previous: DataFrame, current: DataFrame, revisions: tuple[str, str], run: str = "run") -> DataFrame:
    """Path changes of two recursive trees (path, entry_type, mode, object_sha, size); directories alone make none.

    Both revisions are part of a change's identity, so the intervals of one run don't collide."""
    differs = F.lit(False)
    for c in ("object_sha", "mode", "size"):
        differs = differs | ~F.col(f"previous_{c}").eqNullSafe(F.col(f"current_{c}"))
    change = (
        F.when(~F.col("in_previous"), "added").when(~F.col("in_current"), "removed")
        .when(~F.col("previous_entry_type").eqNullSafe(F.col("current_entry_type")), "type_changed").when(differs, "modified")
    )
    tree_only = F.coalesce(F.col("previous_entry_type"), F.lit("tree")).eqNullSafe(F.lit("tree")) & F.coalesce(F.col("current_entry_type"), F.lit("tree")).eqNullSafe(F.lit("tree"))
    return (
        _sides(previous, current, ["path"]).where(~tree_only).withColumn("change_type", change).where("change_type is not null").withColumn("surface", C.change_surface("path"))
        .withColumn("git_path_delta_id", C.identity("git-path-delta", F.lit(run), *map(F.lit, revisions), "path", "change_type")).drop("in_previous", "in_current")
    )


def diff_summary(deltas: DataFrame, *by: str) -> DataFrame:
    return deltas.groupBy(*by).agg(F.count("*").alias("delta_count"))


def materiality(pairs: DataFrame) -> DataFrame:
    """Whether a later revision matters: previous_/current_ commit_sha and tree_sha."""
    reason = F.when(F.col("previous_commit_sha") == F.col("current_commit_sha"), "same_revision").when(F.col("previous_tree_sha") == F.col("current_tree_sha"), "tree_unchanged").otherwise("tree_changed")
    return pairs.withColumn("reason", reason).withColumn("material", F.col("reason") == "tree_changed")
