"""Input envelopes: a chain of digests over the stages of an interval, from captures to reductions.

A stage's outputs have a digest (`extract.envelope`, whatever their order). Its inputs are its own parameters and, by role, the runs that it read with the digests of their outputs; the digest
of that is its inputs_hash. So what a run was made of can be told from the records alone, and a chain can be checked bottom-up: outputs that no longer give
their digest break their own run, and outputs that were signed anew break the runs that read them.

runs: run_id, stage, policy_version, params (canonical JSON), inputs_hash, outputs_hash. reads: run_id, role, parent_id. A run reads a handful of parents;
how many runs there are doesn't matter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import extract
from ..sources.tables import written

#: The stages in the order in which a break counts, and the stages that each reads.
STAGES = {
    "capture": (), "extraction": ("capture",), "change": ("capture", "extraction"), "tree_diff": ("capture",), "plan": ("tree_diff",), "segment": ("tree_diff",),
    "reduce": ("capture", "extraction", "change", "tree_diff", "plan", "segment"),
}

#: What each stage's outputs are authenticated by.
OUTPUTS = {
    "capture": {"manifest": ("source_locator", "content_hash", "media_type", "retrieval_status")},
    "extraction": {
        "facts": ("locator", "raw_value", "normalized_value", "extractor_name", "extractor_version"), "assertions": ("locator", "statement", "extractor_name", "extractor_version"),
        "diagnostics": ("source_locator", "extractor_name", "extractor_version", "error_type", "error_message"),
    },
    "change": {
        "artifact_deltas": ("source_locator", "change_type", "previous_content_hash", "current_content_hash", "previous_media_type", "current_media_type"),
        "structural_deltas": ("source_locator", "structural_key", "change_type", "previous_value", "current_value"),
    },
    "tree_diff": {"path_deltas": ("path", "change_type", "surface", "previous_entry_type", "current_entry_type", "previous_mode", "current_mode", "previous_object_sha", "current_object_sha", "previous_size", "current_size")},
    "plan": {"plans": ("path", "previous", "current", "policy_suppressed")},
    "segment": {"candidates": ("interval_candidate_segment_id", "commit_ordinal", "path_group", "chunk_ordinal", "paths")},
    "reduce": {"reductions": ("interval_candidate_segment_id", "n_paths", "signal_kinds", "disposition")},
}

#: What a run without any outputs has as their digest.
EMPTY = "sha256:e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def stage_order(stage):
    """A stage's place in the order of stages; null for an unknown one."""
    out = None
    for k, name in enumerate(STAGES):
        out = F.when(C.col(stage) == name, k) if out is None else out.when(C.col(stage) == name, k)
    return out


def outputs_of(parts: dict[str, tuple[DataFrame, tuple[str, ...]]], by: str = "run_id") -> DataFrame:
    """(run_id, outputs_hash): the digest of each run's outputs. parts: by name, rows with the run's column and the fields that count."""
    found = None
    for name in sorted(parts):
        rows, fields = parts[name]
        one = extract.envelope(rows, [by], *fields).select(by, F.lit(name).alias("part"), F.col("outputs_hash").alias("part_hash"))
        found = one if found is None else found.unionByName(one)
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "part_hash"))), lambda x: F.concat_ws("=", x["part"], x["part_hash"])), "\n")
    return found.groupBy(by).agg(C.digest(whole).alias("outputs_hash"))


def inputs_of(runs: DataFrame, reads: DataFrame) -> DataFrame:
    """(run_id, expected_hash, n_unknown): the digest of what each run read, and how many of its parents have no record."""
    parents = reads.join(runs.select(F.col("run_id").alias("parent_id"), F.lit(True).alias("known"), F.col("outputs_hash").alias("parent_hash")), "parent_id", "left")
    met = parents.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("role", "parent_id", "parent_hash"))).alias("parents"), F.count_if(F.col("known").isNull()).alias("n_unknown"))
    full = runs.select("run_id", "stage", "policy_version", "params").join(met, "run_id", "left")
    return full.select("run_id", C.digest(C.canonical("params", "parents", "policy_version", "stage")).alias("expected_hash"), F.coalesce("n_unknown", F.lit(0)).alias("n_unknown"))


def signed(runs: DataFrame, reads: DataFrame) -> DataFrame:
    """runs (without inputs_hash) with the inputs_hash that their parents give."""
    return runs.join(inputs_of(runs, reads).select("run_id", F.col("expected_hash").alias("inputs_hash")), "run_id")


def own_faults(runs: DataFrame, reads: DataFrame, outputs: DataFrame) -> DataFrame:
    """(run_id, stage, fault) of runs that don't agree with the records that they name or with their stored outputs (run_id, outputs_hash); null where they do."""
    found = outputs.select("run_id", F.col("outputs_hash").alias("found_hash"))
    met = runs.join(inputs_of(runs, reads), "run_id").join(found, "run_id", "left").withColumn("found_hash", F.coalesce("found_hash", F.lit(EMPTY)))
    fault = (
        F.when(stage_order("stage").isNull(), "unknown stage").when(F.col("n_unknown") > 0, "unknown input").when(~F.col("inputs_hash").eqNullSafe(F.col("expected_hash")), "other inputs")
        .when(~F.col("outputs_hash").eqNullSafe(F.col("found_hash")), "other outputs")
    )
    return met.select("run_id", "stage", fault.alias("fault"))


def reached(reads: DataFrame, runs: DataFrame) -> DataFrame:
    """(run_id, ancestor) of all runs that a run rests on, itself included. Stages bound the depth: three doublings reach eight steps."""
    pairs = reads.select("run_id", F.col("parent_id").alias("ancestor")).unionByName(runs.select("run_id", F.col("run_id").alias("ancestor"))).distinct()
    steps = 1
    while steps < len(STAGES) - 1:
        up = pairs.select(F.col("run_id").alias("ancestor"), F.col("ancestor").alias("further"))
        pairs = pairs.join(up, "ancestor").select("run_id", F.col("further").alias("ancestor")).distinct()
        steps *= 2
    return pairs


def chain_faults(runs: DataFrame, reads: DataFrame, outputs: DataFrame) -> DataFrame:
    """(run_id, stage, fault, first_stage, first_run, first_fault) of runs that are broken or rest on a broken one, with the first broken stage below them.

    Only what is broken goes up, a step of reads at a time, with the first break below each run: whole runs have no row in it. As in `reached`, eight steps at most.
    """
    faults = written(own_faults(runs, reads, outputs))
    own = F.struct(stage_order("stage").alias("at"), "run_id", "stage", "fault")
    level = written(faults.where("fault is not null").select("run_id", own.alias("b")))
    found = level
    for _ in range(len(STAGES) + 1):
        below = level.select(F.col("run_id").alias("parent_id"), "b").hint("merge")
        level = written(reads.select("run_id", "parent_id").join(below, "parent_id").groupBy("run_id").agg(F.min("b").alias("b")))
        if level.isEmpty():
            break
        found = found.unionByName(level)
    first = found.groupBy("run_id").agg(F.min("b").alias("b"))
    return faults.join(first.hint("merge"), "run_id").select("run_id", "stage", "fault", F.col("b.stage").alias("first_stage"), F.col("b.run_id").alias("first_run"), F.col("b.fault").alias("first_fault"))
