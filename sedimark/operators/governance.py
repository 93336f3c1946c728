"""Discovery, registry, tracking, profiles, triage, action policy, review and readiness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import columns as C
from ..sources.tables import written
from . import guards, ordering

# discovery and registry


def discovery_hits(candidates: DataFrame, run: str, by: str = "discovered_locator", order: str = "position") -> DataFrame:
    """Hits of a run: the first of each locator, numbered in their order."""
    first = candidates.groupBy(by).agg(F.min(order).alias(order))
    return ordering.numbered(first, "ordinal", [], [order, by]).withColumn("discovery_hit_id", C.identity("discovery-hit", F.lit(run), by))


def watchlist_candidates(entries: DataFrame, sources: DataFrame) -> DataFrame:
    """Watchlist entries (position, repository, revision) with the source that each is mapped to, if any (sources: repository, source_id). A mapping to a blank source fails the query, as does one to two."""
    once = sources.groupBy("repository").agg(F.count_distinct("source_id").alias("n"), F.min(F.trim("source_id")).alias("source_id"))
    bad = F.col("repository").isNotNull() & ((F.col("n") > 1) | (F.coalesce("source_id", F.lit("")) == ""))
    sound = once.withColumn("source_id", F.when(bad, F.raise_error(F.concat(F.lit("invalid source of "), "repository")).cast("string")).otherwise(F.col("source_id"))).drop("n")
    return entries.join(sound, "repository", "left").select("position", F.col("repository").alias("discovered_locator"), "source_id")


def latest_locators(locators: DataFrame, by: str, *order: str) -> DataFrame:
    """Each source's locator row that was observed last."""
    rest = [c for c in locators.columns if c != by]
    return locators.groupBy(by).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(by, "r.*")


def resolve_hits(hits: DataFrame, metadata: DataFrame, known: DataFrame) -> DataFrame:
    """Hits to sources by the provider's id: `resolved` to a known source, `created` for a new one, `unresolved` without metadata.

    metadata: discovered_locator, provider_repository_id; known: provider_repository_id, source_id.
    """
    out = hits.join(metadata, "discovered_locator", "left").join(known, "provider_repository_id", "left")
    state = F.when(F.col("provider_repository_id").isNull(), "unresolved").when(F.col("source_id").isNull(), "created").otherwise("resolved")
    new = F.when(F.col("provider_repository_id").isNotNull(), C.identity("source", "provider_repository_id"))
    return out.withColumn("state", state).withColumn("source_id", F.coalesce("source_id", new))


def resolution_conflicts(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Repeated resolutions that differ from the recorded one in any field."""
    return guards.mixed_generation(new, old, key, fields)


# tracking


def as_of(facts: DataFrame, timeline: DataFrame, by: str, at: str, effective: str, *values: str, crowd: int = ordering.CROWD) -> DataFrame:
    """facts with the values of the latest timeline row of their key that is in effect at their time (null before the first).

    Both sides are sorted together by key and time, and the last timeline row is carried on: work is
    proportional to the rows, where a range join would meet every earlier row. Keys with more than a crowd of rows are sorted by ranges of key and time
    (`ordering.last_before`), so that no task sorts all rows of one.
    """
    cols = [c for c in facts.columns if c != by]
    a = facts.select(by, F.col(at).alias("__t"), F.lit(1).alias("__k"), F.struct(*cols).alias("__row"), F.lit(None).cast(timeline.select(F.struct(*values)).schema[0].dataType).alias("__v"))
    b = timeline.select(by, F.col(effective).alias("__t"), F.lit(0).alias("__k"), F.lit(None).cast(a.schema["__row"].dataType).alias("__row"), F.struct(*values).alias("__v"))
    cold, hot = ordering.split_hot(a.unionByName(b), by, crowd)
    last = F.last("__v", ignorenulls=True).over(W.partitionBy(by).orderBy("__t", "__k").rowsBetween(W.unboundedPreceding, 0))
    out = cold.withColumn("__v", last).where("__k = 1")
    if hot is not None:
        # facts of one moment may lie in several ranges: their digest is part of the order
        spread = hot.withColumn("__h", F.when(F.col("__k") == 1, F.xxhash64("__row")).otherwise(0))
        out = out.unionByName(ordering.last_before(spread, by, ["__t", "__k", "__h"], "__v", F.col("__k") == 1).drop("__h"))
    return out.select(by, "__row.*", *(F.col(f"__v.{v}").alias(v) for v in values))


def timeline_ties(timeline: DataFrame, by: str, effective: str) -> DataFrame:
    return guards.duplicates(timeline, by, effective)


def history(timeline: DataFrame, by: str, ident: str, *order: str, crowd: int = ordering.CROWD) -> DataFrame:
    """Assignments with the one they supersede; keys with more than a crowd of rows are ordered by ranges."""
    cold, hot = ordering.split_hot(timeline, by, crowd)
    w = W.partitionBy(by).orderBy(*order)
    out = cold.withColumn("supersedes", F.lag(ident).over(w)).withColumn("version", F.row_number().over(w).cast("long"))
    return out if hot is None else out.unionByName(ordering.with_previous(hot, by, [*order], ident, "supersedes", "version"))


#: Levels with capture depth and its rank, polling, and whether current process state, its history and reasoning are allowed.
POLICY = (
    ("0", "none", 0, "never", False, False, False), ("1", "metadata", 1, "metadata", False, False, False), ("2", "shallow", 2, "revision", False, False, False),
    ("3", "structural", 3, "revision", False, False, True), ("4", "deep", 4, "revision", True, True, True), ("5", "deep", 4, "continuous", True, True, True),
)


def policy_of(level: Column | str) -> Column:
    """The policy of a level as a struct; none assigned is level 0."""
    known = F.coalesce(C.col(level), F.lit("0"))
    names = ("level", "capture_depth", "capture_rank", "polling_mode", "process_current_allowed", "process_history_allowed", "reasoning_allowed")
    out = None
    for row in POLICY:
        value = F.struct(*(F.lit(v).alias(n) for n, v in zip(names, row)))
        out = F.when(known == row[0], value) if out is None else out.when(known == row[0], value)
    return out


def gate_violations(requests: DataFrame) -> DataFrame:
    """Requests (level, needed_rank, needs_process, needs_reasoning) that their policy doesn't allow."""
    p = policy_of("level")
    allowed = (p["capture_rank"] >= F.col("needed_rank")) & (~F.col("needs_process") | p["process_current_allowed"]) & (~F.col("needs_reasoning") | p["reasoning_allowed"])
    return requests.where(~allowed)


def assigned(requests: DataFrame, sources: DataFrame, crowd: int = ordering.CROWD) -> DataFrame:
    """requests (seq, source_id, level, assigned_by, reason, effective_at, recorded_at) with their state, as if each were made after those of lower seq.

    sources: source_id, first_seen_at. An assignment is effective at once, never before its source was seen nor before the one recorded last; one at a moment that is taken is
    `replayed` if it says the same and `occupied` otherwise. So what is recorded is what lies above the running maximum of the acceptable requests before it: a scan by source
    (by ranges where a source is hot) and an equi-join on source and moment, no fold.
    """
    r = requests.withColumn("effective_at", F.coalesce("effective_at", "recorded_at")).withColumn("assigned_by", F.trim("assigned_by")).withColumn("reason", F.trim("reason"))
    r = r.join(sources.select("source_id", "first_seen_at"), "source_id", "left")
    named = F.col("first_seen_at").isNotNull() & (F.coalesce("assigned_by", F.lit("")) != "") & (F.coalesce("reason", F.lit("")) != "")
    fits = named & (F.col("effective_at") == F.col("recorded_at")) & (F.col("effective_at") >= F.col("first_seen_at"))
    r = written(ordering.running_max(r.withColumn("fits_", F.coalesce(fits, F.lit(False))), "source_id", ["seq"], F.when(F.coalesce(fits, F.lit(False)), F.col("recorded_at")), "latest_", crowd))
    new = F.col("fits_") & (F.col("latest_").isNull() | (F.col("recorded_at") > F.col("latest_")))
    taken = r.where(new).select("source_id", "effective_at", F.struct("seq", "level", "assigned_by", "reason").alias("taken_"))
    met = r.join(taken, ["source_id", "effective_at"], "left")
    there = F.coalesce(F.col("taken_.seq") < F.col("seq"), F.lit(False))
    same = F.struct("level", "assigned_by", "reason").eqNullSafe(F.struct("taken_.level", "taken_.assigned_by", "taken_.reason"))
    state = (
        F.when(F.col("first_seen_at").isNull(), "unknown source").when(~named, "empty field").when(there & same, "replayed").when(there, "occupied").when(F.col("effective_at") != F.col("recorded_at"), "not immediate")
        .when(F.col("effective_at") < F.col("first_seen_at"), "before the source").when(F.col("recorded_at") < F.col("latest_"), "clock moved back").otherwise("recorded")
    )
    return met.withColumn("state", state).drop("taken_", "fits_", "latest_", "first_seen_at")


def backdated(assignments: DataFrame) -> DataFrame:
    """Assignments that aren't effective at once; scheduling and backdating aren't permitted."""
    return assignments.where("effective_at <> recorded_at")


# profiles and triage

#: Features that extractor families show.
FEATURES = {
    "python-ast": "language:python", "typescript-ast": "language:typescript", "typescript-lexical": "language:typescript", "pyproject": "manifest:python-project",
    "package-json": "manifest:node-package", "github-workflow-metadata": "surface:workflow", "github-process-metadata": "surface:process-current",
    "github-issue-events": "surface:process-history", "github-repository-metadata": "surface:repository-metadata", "git-root-tree": "surface:git-tree",
    "git-commit-metadata": "surface:git-commit",
}


def feature_keys(families: Column | str, media: Column | str) -> Column:
    mapping = F.create_map(*(F.lit(x) for kv in FEATURES.items() for x in kv))
    named = F.array_compact(F.transform(C.col(families), lambda f: F.try_element_at(mapping, f)))
    return F.array_sort(F.array_distinct(F.concat(F.transform(C.col(families), lambda f: F.concat(F.lit("extractor:"), f)), F.transform(C.col(media), lambda m: F.concat(F.lit("media:"), m)), named)))


def profiles(evidence: DataFrame, by: str) -> DataFrame:
    """Profile of each revision from its evidence rows (artifact_id, media_type, extractor_name, is_fact)."""
    sets = lambda c, name: F.array_sort(F.collect_set(c)).alias(name)
    return (
        evidence.groupBy(by).agg(
            sets("extractor_name", "extractor_families"), sets("media_type", "artifact_media_types"), F.count_distinct("artifact_id").alias("artifact_count"),
            F.count_if("is_fact").alias("evidence_fact_count"), F.count_if(~F.col("is_fact")).alias("source_assertion_count"),
        ).withColumn("feature_keys", feature_keys("extractor_families", "artifact_media_types"))
    )


def triage(profiled: DataFrame) -> DataFrame:
    """Band and reasons from rules in order; needs level, domain_match, n_structural_deltas, sensitivity_flags and the profile's fields."""
    ignored, deep = F.coalesce(F.col("level"), F.lit("0")) == "0", F.col("level").isin("4", "5")
    rich = (F.col("evidence_fact_count") > 0) & (F.size("extractor_families") >= 2)
    has = lambda *keys: F.arrays_overlap("feature_keys", F.array(*map(F.lit, keys)))
    process, workflow = has("surface:process-current", "surface:process-history"), has("surface:workflow")
    changed, sensitive = F.col("n_structural_deltas") > 0, F.size("sensitivity_flags") > 0
    any_signal = changed | sensitive | process | workflow | rich
    band = F.when(ignored, "ignore").when(F.col("domain_match") & deep & changed & sensitive, "deep_dive").when(F.col("domain_match") & any_signal, "review").otherwise("watch")
    reasons = {
        "tracking_ignored": ignored, "tracking_active": ~ignored, "domain_match": F.col("domain_match"), "domain_mismatch": ~F.col("domain_match"), "evidence_rich": rich,
        "process_rich": process, "workflow_rich": workflow, "recent_structural_change": changed, "governance_sensitive": F.array_contains("sensitivity_flags", "governance"),
        "experiment_sensitive": F.array_contains("sensitivity_flags", "experiment"), "deep_tracking": F.coalesce(deep, F.lit(False)),
    }
    return profiled.withColumn("band", band).withColumn("reasons", F.array_sort(F.array_compact(F.array(*(F.when(c, F.lit(r)) for r, c in reasons.items())))))


# action policy, review, readiness


def action_decisions(proposals: DataFrame, rules: DataFrame) -> DataFrame:
    """Decision for each proposal: blocked before requires_authorization before recommended; nothing is ever authorised.

    proposals: action_id, action_type, actor_role, repository_modification_required, can_write, can_contribute.
    rules: rule_id, effect, action_types, allowed_actor_roles; there are few, and they are broadcast by size if at all.
    """
    met = rules.select("rule_id", "effect", "allowed_actor_roles", F.explode("action_types").alias("action_type"))
    role_fails = (F.col("effect") == "require_role") & ~F.coalesce(F.array_contains("allowed_actor_roles", F.col("actor_role")), F.lit(False))
    joined = proposals.join(met, "action_type", "left").groupBy(*proposals.columns).agg(
        F.coalesce(F.bool_or((F.col("effect") == "prohibit") | role_fails), F.lit(False)).alias("rule_blocks"),
        F.coalesce(F.bool_or(F.col("effect") == "require_independent_authorization"), F.lit(False)).alias("needs_authorization"),
        F.array_sort(F.collect_set("rule_id")).alias("matched_rule_ids"),
    )
    unable = (F.col("repository_modification_required") & ~F.col("can_write")) | ((F.col("action_type") == "contribute_upstream") & ~F.col("can_contribute"))
    decision = F.when(unable | F.col("rule_blocks"), "blocked").when(F.col("needs_authorization"), "requires_authorization").otherwise("recommended")
    return joined.withColumn("decision", decision).withColumn("status", F.when(F.col("decision") == "blocked", "rejected").otherwise("recommended")).withColumn("rationale", F.concat_ws(" ", F.lit("policy:"), "decision", F.concat(F.lit("by "), F.nullif(F.array_join("matched_rule_ids", ", "), F.lit("")))))


def _faults(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    return rows.select(F.col(key).alias("key"), F.explode(F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(True)), F.lit(t)) for t, c in rules.items())))).alias("fault"))


def _blank(c: str) -> Column:
    return F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == ""


def proposal_faults(proposals: DataFrame) -> DataFrame:
    """(key, fault) of proposals of actions with an empty text field; key is the proposal's id."""
    return _faults(proposals, "proposal_id", {f"empty {c}": _blank(c) for c in ("proposal_id", "subject_id", "source_id", "target", "rationale", "actor_role")})


def rule_faults(rules: DataFrame) -> DataFrame:
    """(key, fault) of policy rules: rule_id, effect, action_types, rationale, n_supports, allowed_actor_roles."""
    roles, role_rule = F.coalesce("allowed_actor_roles", F.array().cast("array<string>")), F.col("effect") == "require_role"
    types = F.coalesce("action_types", F.array().cast("array<string>"))
    return _faults(rules, "rule_id", {
        "empty rule_id": _blank("rule_id"), "empty rationale": _blank("rationale"), "no action type": F.size(types) == 0, "repeated action type": F.size(F.array_distinct(types)) != F.size(types), "no support": F.col("n_supports") < 1,
        "no role": role_rule & ((F.size(roles) == 0) | F.exists(roles, lambda r: F.coalesce(F.trim(r), F.lit("")) == "")), "role without need": ~role_rule & (F.size(roles) > 0),
    })


def support_faults(supports: DataFrame) -> DataFrame:
    """(key, fault) of what rules rest on: support_id, support_type, expected_value, fragments. Facts need a value and no fragments, assertions the other way round; nothing else is direct."""
    fact, said = F.col("support_type") == "EvidenceFact", F.col("support_type") == "SourceAssertion"
    fragments = F.coalesce("fragments", F.array().cast("array<string>"))
    empty = (F.size(fragments) == 0) | F.exists(fragments, lambda f: F.coalesce(F.trim(f), F.lit("")) == "")
    return _faults(supports, "support_id", {
        "empty support_id": _blank("support_id"), "not direct": ~(fact | said), "fact without a value": fact & F.col("expected_value").isNull(), "fact with fragments": fact & (F.size(fragments) > 0),
        "assertion with a value": said & F.col("expected_value").isNotNull(), "assertion without fragments": said & empty,
    })


def unsupported_rules(supports: DataFrame, facts: DataFrame) -> DataFrame:
    """Rule supports (rule_id, evidence_id, expected_value, fragments) whose fact is missing, has another value, or lacks a fragment."""
    met = supports.join(facts.select("evidence_id", "normalized_value"), "evidence_id", "left")
    ok = F.col("normalized_value").isNotNull() & (F.col("expected_value").isNull() | (F.col("normalized_value") == F.col("expected_value"))) & F.coalesce(F.forall("fragments", lambda f: F.contains(F.col("normalized_value"), f)), F.lit(True))
    return met.where(~ok)


REVIEW_SUBJECTS = ("Observation", "Pattern", "ActionRecommendation", "TriageAssessment", "IntervalCandidateSegment")


def review_faults(reviews: DataFrame, subjects: DataFrame) -> DataFrame:
    """Reviews of an unknown kind of subject or decision, or of a subject that isn't there."""
    from ..schemas import ENUMS

    known = reviews.where(F.col("subject_type").isin(*REVIEW_SUBJECTS) & F.col("decision").isin(*ENUMS["ReviewDecisionType"]))
    return reviews.join(known.join(subjects, ["subject_type", "subject_id"], "left_semi").select("review_id"), "review_id", "left_anti")


def readiness(requirements: DataFrame, capabilities: DataFrame, by: str = "case_id") -> DataFrame:
    """deferred before blocked (missing or unknown) before ready. requirements: case and capability; capabilities: capability, state."""
    rank = F.when(F.col("state") == "deferred", 2).when(F.coalesce(F.col("state") != "available", F.lit(True)), 1).otherwise(0)
    met = requirements.join(capabilities, "capability", "left").withColumn("rank", rank)
    return met.groupBy(by).agg(F.max("rank").alias("rank"), F.count_if(F.col("rank") > 0).alias("n_missing")).withColumn("outcome", F.when(F.col("rank") == 2, "deferred").when(F.col("rank") == 1, "blocked").otherwise("ready")).drop("rank")


def outcome_counts(outcomes: DataFrame) -> DataFrame:
    """Cases by outcome, of all three outcomes in one row."""
    return outcomes.agg(*(F.count_if(F.col("outcome") == o).alias(o) for o in ("ready", "blocked", "deferred")))
