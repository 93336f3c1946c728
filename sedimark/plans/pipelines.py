"""The engine's pipelines, composed of its operators: extraction runs, and the change signal from two captures to candidates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import delta, extract, governance, guards, planning
from ..sources.tables import written
from . import comparison, envelopes


@dataclass(frozen=True)
class Extraction:
    """Facts, assertions and diagnostics of one run over a capture's artifacts. Comparisons need no identities, so only what is recorded gets them."""

    facts: DataFrame
    assertions: DataFrame
    diagnostics: DataFrame
    run: str

    def recorded_facts(self) -> DataFrame:
        return extract.numbered_facts(self.facts, self.run)

    def recorded_assertions(self) -> DataFrame:
        return extract.numbered_assertions(self.assertions, self.run)


def extraction(artifacts: DataFrame, run: str, extractors: tuple[extract.Extractor, ...] = extract.DEFAULT) -> Extraction:
    """All extractors over the captured artifacts (artifact_id, capture_id, source_locator, text)."""
    rows = written(extract.parsed(artifacts, extractors))  # the parsers run once
    by = artifacts.select("artifact_id", "capture_id")
    markdown = artifacts.where(C.suffix("source_locator").isin(".md", ".markdown"))
    facts = extract.path_facts(artifacts).unionByName(extract.facts_of(rows)).join(by, "artifact_id")
    said = extract.markdown_paragraphs(markdown).unionByName(extract.markdown_list_items(markdown)).unionByName(extract.assertions_of(rows)).join(by, "artifact_id")
    return Extraction(facts, said, extract.diagnostics_of(rows), run)


def strict_extraction(artifacts: DataFrame, run: str, extractors: tuple[extract.Extractor, ...] = extract.DEFAULT) -> Extraction:
    """The same, failing before anything is recorded if any artifact can't be read."""
    done = extraction(artifacts, run, extractors)
    guards.require_empty(done.diagnostics, "artifacts that can't be read")
    return done


def gap_tolerant_pair(previous: DataFrame, current: DataFrame, run: str, extractors: tuple[extract.Extractor, ...] = extract.DEFAULT) -> tuple[Extraction, Extraction, DataFrame]:
    """Both extractions, and the paths that either couldn't read (source_locator, side, extractor_name)."""
    was, now = extraction(previous, f"{run}:previous", extractors), extraction(current, f"{run}:current", extractors)
    gap = lambda e, side: e.diagnostics.select("source_locator", F.lit(side).alias("side"), "extractor_name")
    return was, now, gap(was, "previous").unionByName(gap(now, "current")).distinct()


@dataclass(frozen=True)
class ChangeSignal:
    artifact_deltas: DataFrame
    structural_deltas: DataFrame
    path_deltas: DataFrame
    plans: DataFrame
    candidates: DataFrame
    reductions: DataFrame
    gaps: DataFrame
    previous: Extraction
    current: Extraction


def change_signal(
    previous: DataFrame, current: DataFrame, trees: tuple[DataFrame, DataFrame], touches: DataFrame, run: str, revisions: tuple[str, str],
    extractors: tuple[extract.Extractor, ...] = extract.DEFAULT,
) -> ChangeSignal:
    """From two captures, two trees and the commits between them to reduced candidates.

    Captures: artifact_id, capture_id, source_locator, text, content_hash, media_type, retrieval_status. touches: path, commit_ordinal; a
    changed path that no commit touches stays with ordinal 0, so that nothing is dropped. The revisions name the interval in all identities.
    """
    interval = ":".join((run, *revisions))
    paths = written(delta.tree_deltas(*trees, revisions, run=run))
    plans = planning.capture_plans(paths, run=run)
    live = lambda c: c.where("retrieval_status = 'captured'")
    was, now, gaps = gap_tolerant_pair(live(previous), live(current), interval, extractors)
    side = ["source_locator", "content_hash", "media_type", "retrieval_status"]
    artifact = written(delta.artifact_deltas(previous.select(*side), current.select(*side), interval))
    structural = written(delta.structural_deltas(was.facts, now.facts, artifact, gaps, interval))
    said = delta.assertion_changes(was.assertions, now.assertions)
    latest = paths.select("path").join(touches.groupBy("path").agg(F.max("commit_ordinal").alias("commit_ordinal")), "path", "left").fillna(0, ["commit_ordinal"])
    candidates = written(planning.segments(latest, run=interval))
    of = lambda df: df.select(F.col("source_locator").alias("path"))
    in_candidate = candidates.select("interval_candidate_segment_id", F.explode("paths").alias("path"))
    signals = planning.path_signals(in_candidate, plans, of(artifact), of(structural), of(said), of(gaps))
    diagnostics = gaps.select(F.col("source_locator").alias("path"), "side", F.concat_ws("@", "extractor_name", "source_locator").alias("diagnostic_id"))
    return ChangeSignal(
        artifact, structural, paths, plans, candidates, planning.reductions(signals, "interval_candidate_segment_id"),
        planning.gap_signals(in_candidate, diagnostics, "interval_candidate_segment_id"), was, now,
    )


def require_comparable(pairs: DataFrame, runs: DataFrame, outputs: dict[str, DataFrame], evidence: DataFrame, artifacts: DataFrame, strict_policy: str | None = None) -> None:
    """All guards of comparisons, before anything is compared; the first that has a row fails.

    pairs: pair_id, previous_/current_ source_id, observed_at, captured_at, run_id. runs: extraction runs. outputs: their stored facts, assertions and diagnostics by run_id.
    With a strict policy, runs with diagnostics or of another policy fail too; without, diagnostics are part of what is authenticated.
    """
    guards.require_empty(comparison.pair_faults(pairs), "captures that can't be compared")
    guards.require_empty(comparison.run_faults(pairs, runs), "extraction runs that can't be compared")
    if strict_policy is not None:
        guards.require_empty(comparison.strict_faults(pairs, outputs["diagnostics"], runs, strict_policy), "extraction runs that aren't strict")
    guards.require_empty(comparison.foreign_evidence(evidence, artifacts), "evidence outside its capture")
    guards.require_empty(comparison.tampered_runs(runs.select("run_id", "outputs_hash"), outputs), "stored outputs that don't give their run's digest")


def signal_records(captures: tuple[DataFrame, DataFrame], signal: ChangeSignal, run: str, policy_version: str, params: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(runs, reads, outputs) of a change signal's stages, each run's inputs signed by the digests of what it read: the records that envelopes.chain_faults checks later.

    params: canonical JSON of a stage's own parameters, by stage.
    """
    spark, params = captures[0].sparkSession, params or {}
    sides = ("previous", "current")
    of = {f"capture:{s}": ("capture", {"manifest": c}) for s, c in zip(sides, captures)}
    of |= {f"extraction:{s}": ("extraction", {"facts": e.facts, "assertions": e.assertions, "diagnostics": e.diagnostics}) for s, e in zip(sides, (signal.previous, signal.current))}
    of |= {
        "change": ("change", {"artifact_deltas": signal.artifact_deltas, "structural_deltas": signal.structural_deltas}), "tree_diff": ("tree_diff", {"path_deltas": signal.path_deltas}),
        "plan": ("plan", {"plans": signal.plans}), "segment": ("segment", {"candidates": signal.candidates}), "reduce": ("reduce", {"reductions": signal.reductions}),
    }
    outputs = None
    for name, (stage, parts) in of.items():
        one = envelopes.outputs_of({n: (df.withColumn("run_id", F.lit(f"{run}:{name}")), envelopes.OUTPUTS[stage][n]) for n, df in parts.items()})
        outputs = one if outputs is None else outputs.unionByName(one)
    outputs = written(outputs)
    names = spark.createDataFrame([(f"{run}:{name}", stage, policy_version, params.get(stage, "{}")) for name, (stage, _) in of.items()], "run_id string, stage string, policy_version string, params string")
    runs = names.join(outputs, "run_id", "left").fillna(envelopes.EMPTY, ["outputs_hash"])
    # an extraction reads its own side only
    pairs = [(a, b) for a, (stage, _) in of.items() for b, (read, _) in of.items() if read in envelopes.STAGES[stage] and (stage != "extraction" or a.split(":")[1] == b.split(":")[1])]
    reads = spark.createDataFrame([(f"{run}:{a}", b, f"{run}:{b}") for a, b in pairs], "run_id string, role string, parent_id string")
    return envelopes.signed(runs, reads), reads, outputs


def gated(requests: DataFrame, timeline: DataFrame) -> DataFrame:
    """Capture requests (source_id, at, needed_rank, needs_process, needs_reasoning) with whether the policy in effect allows them."""
    known = governance.as_of(requests, timeline, "source_id", "at", "effective_at", "level")
    p = governance.policy_of("level")
    allowed = (p["capture_rank"] >= F.col("needed_rank")) & (~F.col("needs_process") | p["process_current_allowed"]) & (~F.col("needs_reasoning") | p["reasoning_allowed"])
    return known.withColumn("allowed", allowed)
