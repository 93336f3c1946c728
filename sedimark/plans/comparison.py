"""Guards of a comparison before it runs, and extraction outputs as authenticated records.

A comparison of two captures is sound where no guard has a row: one source, nothing newer on the previous side, both extraction runs of one
generation (code, schema, policy), finished and with a digest, and stored outputs that still give that digest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import extract
from . import envelopes

#: What an extraction's outputs are, and the fields that authenticate each.
PARTS = {
    "facts": ("evidence_id", "artifact_id", "locator", "raw_value", "normalized_value", "extractor_name", "extractor_version"),
    "assertions": ("assertion_id", "artifact_id", "locator", "statement", "extractor_name", "extractor_version"),
    "diagnostics": ("artifact_id", "source_locator", "extractor_name", "extractor_version", "error_type", "error_message"),
}


def pair_faults(pairs: DataFrame) -> DataFrame:
    """(pair_id, fault) of pairs of captures: previous_ and current_ source_id, observed_at, captured_at. A time that isn't known is a fault."""
    unknown = lambda c: F.col(f"previous_{c}").isNull() | F.col(f"current_{c}").isNull()
    faults = F.array_compact(F.array(
        F.when(~F.col("previous_source_id").eqNullSafe(F.col("current_source_id")), "another source"),
        F.when(F.col("previous_observed_at") > F.col("current_observed_at"), "revision newer than the current one"),
        F.when(F.col("previous_captured_at") > F.col("current_captured_at"), "capture newer than the current one"),
        F.when(unknown("observed_at"), "revision without a time"), F.when(unknown("captured_at"), "capture without a time"),
    ))
    return pairs.select("pair_id", F.explode(faults).alias("fault"))


def run_faults(pairs: DataFrame, runs: DataFrame, fields: tuple[str, ...] = ("code_version", "contract_schema_version", "policy_version")) -> DataFrame:
    """(pair_id, fault) of the extraction runs of pairs (pair_id, previous_run_id, current_run_id): unknown, of another type, unfinished, without digest, or of unlike generations."""
    side = lambda s: runs.select(F.col("run_id").alias(f"{s}_run_id"), F.struct("run_type", "finished_at", "outputs_hash", *fields).alias(s))
    met = pairs.join(side("previous"), "previous_run_id", "left").join(side("current"), "current_run_id", "left")
    of = lambda s: [
        F.when(F.col(s).isNull(), f"{s}: unknown run"), F.when(F.col(f"{s}.run_type") != "extraction", f"{s}: another type"),
        F.when(F.col(s).isNotNull() & F.col(f"{s}.finished_at").isNull(), f"{s}: unfinished"), F.when(F.col(s).isNotNull() & F.col(f"{s}.outputs_hash").isNull(), f"{s}: no digest"),
    ]
    both = F.col("previous").isNotNull() & F.col("current").isNotNull()
    unlike = [F.when(both & ~F.col(f"previous.{f}").eqNullSafe(F.col(f"current.{f}")), f"unlike {f}") for f in fields]
    return met.select("pair_id", F.explode(F.array_compact(F.array(*of("previous"), *of("current"), *unlike))).alias("fault"))


def generation_faults(summaries: DataFrame, by: list[str], generation: list[str], intervals: DataFrame | None = None) -> DataFrame:
    """Intervals that don't have exactly one summary of a generation (the fields that name it); of the given intervals also those that have none at all."""
    n = summaries.groupBy(*by, *generation).agg(F.count("*").alias("n_summaries"))
    if intervals is not None:
        n = intervals.select(*by).distinct().join(n, by, "left").fillna(0, ["n_summaries"])
    return n.where("n_summaries <> 1")


def outputs_digest(outputs: dict[str, DataFrame], by: str = "run_id") -> DataFrame:
    """(run_id, outputs_hash, n_rows): facts, assertions and diagnostics of each run folded to one digest, whatever their order."""
    parts = None
    for name in sorted(outputs):
        one = extract.envelope(outputs[name], [by], *PARTS[name]).withColumn("part", F.lit(name))
        parts = one if parts is None else parts.unionByName(one)
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "outputs_hash"))), lambda x: F.concat_ws("=", x["part"], x["outputs_hash"])), "\n")
    return parts.groupBy(by).agg(C.digest(whole).alias("outputs_hash"), F.sum("n_rows").alias("n_rows"))


#: The digest of a run without any outputs.
EMPTY = envelopes.EMPTY


def tampered_runs(recorded: DataFrame, outputs: dict[str, DataFrame], by: str = "run_id") -> DataFrame:
    """Recorded runs (run_id, outputs_hash) whose stored outputs no longer give their digest; a run without outputs has that of the empty text."""
    found = outputs_digest(outputs, by).select(by, F.col("outputs_hash").alias("found_hash"))
    met = recorded.join(found, by, "left").withColumn("found_hash", F.coalesce("found_hash", F.lit(EMPTY)))
    return met.where(~F.col("outputs_hash").eqNullSafe(F.col("found_hash"))).select(by, "outputs_hash", "found_hash")


def strict_faults(pairs: DataFrame, diagnostics: DataFrame, runs: DataFrame, strict_policy: str) -> DataFrame:
    """(pair_id, fault) of pairs whose extraction runs have diagnostics (run_id) or were made under another policy than the strict one."""
    gaps = diagnostics.groupBy("run_id").agg(F.count("*").alias("n"))
    side = lambda s: pairs.select("pair_id", F.lit(s).alias("side"), F.col(f"{s}_run_id").alias("run_id"))
    met = side("previous").unionByName(side("current")).join(gaps, "run_id", "left").join(runs.select("run_id", "policy_version"), "run_id", "left")
    faults = F.array_compact(F.array(
        F.when(F.col("n") > 0, F.concat("side", F.lit(": diagnostics"))), F.when(~F.col("policy_version").eqNullSafe(F.lit(strict_policy)), F.concat("side", F.lit(": not strict"))),
    ))
    return met.select("pair_id", F.explode(faults).alias("fault"))


def foreign_evidence(evidence: DataFrame, artifacts: DataFrame) -> DataFrame:
    """(run_id, artifact_id, n): evidence (run_id, capture_id, artifact_id) of artifacts that its capture doesn't hold."""
    held = artifacts.where("retrieval_status = 'captured'").select("capture_id", "artifact_id").distinct()
    return evidence.join(held, ["capture_id", "artifact_id"], "left_anti").groupBy("run_id", "artifact_id").agg(F.count("*").alias("n"))
