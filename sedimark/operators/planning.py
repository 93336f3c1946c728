"""From path changes to bounded candidates: capture plans, commit chains, segments, factual reductions and gap signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import columns as C
from . import guards

#: Ceilings that fail or suppress; they never cut.
MAX_BLOB_BYTES, CHUNK_PATHS, MAX_COMMITS, MAX_COMMIT_FILES = 1_000_000, 50, 2_000, 3_000


def _plan_side(side: str, ceiling: int) -> Column:
    kind, size, surface = F.col(f"{side}_entry_type"), F.col(f"{side}_size"), F.col("surface")
    largest = F.greatest(F.col("previous_size"), F.col("current_size"))
    big = F.when(F.col("change_type") == "modified", largest > ceiling).otherwise(size > ceiling)
    pair = lambda d, r: F.struct(F.lit(d).alias("disposition"), F.lit(r).alias("reason"))
    return (
        F.when(kind.isNull(), pair("absent", "path_absent")).when(kind == "tree", pair("non_file", "directory_entry")).when(kind == "commit", pair("non_file", "submodule_pointer"))
        .when(surface == "GENERATED", pair("suppressed", "generated_surface")).when(surface == "VENDORED", pair("suppressed", "vendored_surface"))
        .when(big, pair("suppressed", "large_blob")).otherwise(pair("capture", "eligible_blob"))
    )


def capture_plans(deltas: DataFrame, ceiling: int = MAX_BLOB_BYTES, run: str = "run") -> DataFrame:
    """A plan for each path change: whether to capture its previous and current side, and why not."""
    planned = deltas.withColumn("previous", _plan_side("previous", ceiling)).withColumn("current", _plan_side("current", ceiling))
    taken = (F.col("previous.disposition") == "capture") | (F.col("current.disposition") == "capture")
    stopped = (F.col("previous.disposition") == "suppressed") | (F.col("current.disposition") == "suppressed")
    return planned.withColumn("policy_suppressed", ~taken & stopped).withColumn("affected_file_plan_id", C.identity("affected-file-plan", F.lit(run), "git_path_delta_id"))


def required_paths(plans: DataFrame) -> DataFrame:
    """(side, path): captured sides, and absent ones whose opposite is captured (they are recorded as missing)."""
    side = lambda a, b: plans.where((F.col(f"{a}.disposition") == "capture") | ((F.col(f"{a}.disposition") == "absent") & (F.col(f"{b}.disposition") == "capture"))).select(F.lit(a).alias("side"), "path")
    return side("previous", "current").unionByName(side("current", "previous"))


def suppressed_paths(plans: DataFrame) -> DataFrame:
    return plans.where("policy_suppressed").select("path", F.coalesce(F.when(F.col("current.disposition") == "suppressed", F.col("current.reason")), F.col("previous.reason")).alias("reason"))


def scope_mismatches(required: DataFrame, captured: DataFrame) -> DataFrame:
    """Required (side, path) that weren't captured or recorded as missing, and captured ones that weren't required."""
    a, b = required.select("side", "path").distinct(), captured.select("side", "path").distinct()
    return a.exceptAll(b).withColumn("fault", F.lit("not captured")).unionByName(b.exceptAll(a).withColumn("fault", F.lit("not required")))


# commits


def commit_snapshots(commits: DataFrame) -> DataFrame:
    """Commits (commit_sha, ordinal, parent_shas, files(filename, previous_filename)) with the paths they touch, sorted."""
    touched = F.array_sort(F.array_distinct(F.array_compact(F.concat(F.transform("files", lambda f: f["filename"]), F.transform("files", lambda f: f["previous_filename"])))))
    return commits.select("commit_sha", "ordinal", "parent_shas", touched.alias("touched_paths"))


def range_faults(commits: DataFrame, head: str, declared: int) -> DataFrame:
    """Faults of a loaded commit range: too many, not as many as declared, repeated, or not ending at the head."""
    found = commits.agg(F.count("*").alias("n"), F.count_distinct("commit_sha").alias("d"), F.max_by("commit_sha", "ordinal").alias("last"))
    rules = [("over the ceiling", F.col("n") > MAX_COMMITS), ("not as many as declared", F.col("n") != declared), ("repeated commits", F.col("n") != F.col("d")), ("doesn't end at the head", ~F.col("last").eqNullSafe(F.lit(head)))]
    return found.select(F.explode(F.array_compact(F.array(*(F.when(c, F.lit(t)) for t, c in rules)))).alias("fault"))


def first_parent_chain(commits: DataFrame, by: str, node: str, parent: str) -> DataFrame:
    """Place of every node on its chain (0 at the root), by pointer doubling: log2(longest chain) joins, no recursion limit.

    Roots have a null parent. Nodes on a cycle never reach a root; they come out with a null place.
    """
    from ..sources.tables import written

    at = commits.select(by, F.col(node).alias("node"), F.col(parent).alias("up"), F.when(F.col(parent).isNull(), 0).otherwise(1).cast("long").alias("place"))
    total = None
    while True:
        far = at.select(by, F.col("node").alias("up"), F.col("up").alias("up2"), F.col("place").alias("place2"), F.lit(True).alias("known"))
        at = written(
            at.join(far, [by, "up"], "left").select(
                by, "node", F.when(F.col("up").isNotNull(), F.when(F.col("known"), F.col("up2")).otherwise(F.lit(None))).alias("up"),
                (F.col("place") + F.when(F.col("up").isNotNull(), F.coalesce("place2", F.lit(0))).otherwise(0)).alias("place"),
            )
        )
        open_ = at.where("up is not null").count()
        if open_ == 0 or open_ == total:
            break
        total = open_
    return at.select(by, F.col("node").alias(node), F.when(F.col("up").isNull(), F.col("place")).alias("place"))


def latest_touch(deltas: DataFrame, touches: DataFrame, by: str = "path") -> DataFrame:
    """Each path's latest commit on the chain: touches have (path, commit_ordinal)."""
    return deltas.join(touches.groupBy(by).agg(F.max("commit_ordinal").alias("commit_ordinal")), by)


def segments(assigned: DataFrame, chunk: int = CHUNK_PATHS, run: str = "run") -> DataFrame:
    """Candidates: paths by commit and path group, in order of path, in chunks of a fixed size."""
    place = F.row_number().over(W.partitionBy("commit_ordinal", "path_group").orderBy("path")) - 1
    return (
        assigned.withColumn("path_group", C.path_group("path")).withColumn("chunk_ordinal", (F.floor(place / chunk) + 1).cast("int"))
        .groupBy("commit_ordinal", "path_group", "chunk_ordinal").agg(F.array_sort(F.collect_list("path")).alias("paths"))
        .withColumn("interval_candidate_segment_id", C.identity("interval-candidate", F.lit(run), "commit_ordinal", "path_group", "chunk_ordinal"))
    )


def segment_faults(deltas: DataFrame, found: DataFrame) -> DataFrame:
    """Paths that aren't in exactly one candidate."""
    return guards.not_exactly_once(deltas, found.select(F.explode("paths").alias("path")), "path")


# reduction

SIGNALS = ("structural_delta", "authored_assertion_change", "artifact_delta_without_extracted_signal", "git_only_change", "policy_suppressed")


def path_signals(paths: DataFrame, plans: DataFrame, artifact: DataFrame, structural: DataFrame, assertions: DataFrame, gaps: DataFrame | None = None) -> DataFrame:
    """Each path with flags of what is known of its change. In gap paths changes of assertions aren't read."""
    flag = lambda df, name: df.select("path").distinct().withColumn(name, F.lit(True))
    if gaps is not None:
        assertions, structural = (x.join(gaps.select("path").distinct(), "path", "left_anti") for x in (assertions, structural))
    out = paths
    for df, name in ((plans.where("policy_suppressed"), "suppressed"), (artifact, "artifact"), (structural, "structural"), (assertions, "assertion")):
        out = out.join(flag(df, name), "path", "left")
    out = out.fillna(False, ["suppressed", "artifact", "structural", "assertion"])
    kinds = [F.col("structural"), F.col("assertion"), F.col("artifact") & ~F.col("structural") & ~F.col("assertion"), ~(F.col("artifact") | F.col("structural") | F.col("assertion") | F.col("suppressed")), F.col("suppressed")]
    return out.withColumn("signals", F.array_compact(F.array(*(F.when(c, F.lit(s)) for s, c in zip(SIGNALS, kinds)))))


def reductions(signals: DataFrame, *by: str) -> DataFrame:
    """Candidates with their signal kinds; suppressed only if policy suppresses all their paths."""
    return signals.groupBy(*by).agg(
        F.count("*").alias("n_paths"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("signals")))).alias("signal_kinds"),
        F.when(F.every(F.col("suppressed")), "suppress").otherwise("retain").alias("disposition"),
    )


def gap_signals(candidate_paths: DataFrame, diagnostics: DataFrame, *by: str) -> DataFrame:
    """Candidates with paths that an extractor couldn't read on either side: diagnostics have (path, side, diagnostic_id)."""
    ids = lambda s: F.array_sort(F.array_compact(F.collect_list(F.when(F.col("side") == s, F.col("diagnostic_id"))))).alias(f"{s}_diagnostic_ids")
    return candidate_paths.join(diagnostics, "path").groupBy(*by).agg(F.array_sort(F.collect_set("path")).alias("paths"), ids("previous"), ids("current"))
