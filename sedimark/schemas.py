"""The contracts: a schema, a key and row checks for each record type.

Fields are written `name type`, with `?` for nullable ones. Besides Spark's types there are `sha1` and `digest` (patterns), `path`
(whitespace kept), `json` (canonical text) and the names of enumerations; all of these are strings.
"""

from __future__ import annotations

import re
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VERSION = "1"
#: The vocabularies of the enumerations.
ENUMS: dict[str, tuple[str, ...]] = {
    "ActionPolicyEffect": ("prohibit", "require_role", "require_independent_authorization",),
    "ActionPolicyDecision": ("blocked", "recommended", "requires_authorization",),
    "CandidateReductionDisposition": ("retain", "suppress",),
    "CandidateSignalKind": ("structural_delta", "authored_assertion_change", "artifact_delta_without_extracted_signal", "git_only_change", "policy_suppressed",),
    "CapturePlanDisposition": ("capture", "absent", "suppressed", "non_file",),
    "CapturePlanReason": ("eligible_blob", "path_absent", "directory_entry", "submodule_pointer", "generated_surface", "vendored_surface", "large_blob",),
    "ArtifactDeltaType": ("capture_scope_added", "capture_scope_removed", "became_captured", "became_missing", "content_changed", "metadata_changed",),
    "StructuralDeltaType": ("added", "removed", "modified",),
    "SourceKind": ("github_repository",),
    "SourceRole": ("implementation", "research_index", "research_program", "mixed", "unknown",),
    "DiscoveryChannelType": ("manual_watchlist", "github_stars", "saved_search",),
    "RepositoryResolutionMethod": ("github_provider_repository_id",),
    "RetrievalStatus": ("captured", "missing", "error", "not_modified",),
    "ObservationEpistemicType": ("Interpretation", "Inference", "Hypothesis", "Evaluation", "Opinion", "Unknown",),
    "ValidationState": ("candidate", "reviewed", "validated", "superseded", "rejected",),
    "SupportType": ("EvidenceFact", "SourceAssertion", "Observation",),
    "PatternOccurrenceRole": ("supporting", "negative_control", "contradicting",),
    "RunType": ("discovery", "registry", "capture", "extraction", "diff", "profiling", "reasoning", "synthesis", "evaluation", "other",),
    "RelationshipType": ("OWNED", "CONTRIBUTABLE", "EXTERNAL", "READ_ONLY", "UNKNOWN",),
    "ActionType": ("learn", "investigate", "adopt", "avoid", "mitigate", "pin", "monitor", "report_upstream", "contribute_upstream", "fork_vendor", "revalidate", "preserve", "rerun", "classify", "promote", "no_action",),
    "ActionStatus": ("candidate", "recommended", "authorized", "completed", "rejected", "superseded",),
    "ReviewDecisionType": ("ACCEPT", "REJECT", "LOW_SIGNAL", "DUPLICATE", "MERGE", "PROMOTE", "SNOOZE", "DEEP_DIVE", "CONTRADICT",),
    "InspectionLocationKind": ("artifact_metadata", "text_lines", "text_range", "structured_value", "derived_structure",),
    "ProcessKind": ("issue", "pull_request",),
    "CommitRangeStatus": ("ahead", "identical",),
    "GitPathDeltaType": ("added", "removed", "modified", "type_changed",),
    "ChangeSurface": ("SOURCE", "TEST", "DOCS", "CONFIG", "WORKFLOW", "MANIFEST", "LOCKFILE", "GENERATED", "VENDORED", "UNKNOWN",),
    "TriageBand": ("ignore", "watch", "review", "deep_dive",),
    "TriageSensitivity": ("governance", "experiment",),
    "TriageReason": ("tracking_ignored", "tracking_active", "domain_match", "domain_mismatch", "evidence_rich", "process_rich", "workflow_rich", "recent_structural_change", "governance_sensitive", "experiment_sensitive", "deep_tracking",),
    "MaterialityReason": ("same_revision", "tree_unchanged", "tree_changed",),
    "CaptureDepth": ("none", "metadata", "shallow", "structural", "deep",),
    "PollingMode": ("never", "metadata", "revision", "continuous",),
    "ArtifactClass": ("repository_metadata", "explicit_files", "commit_metadata", "git_tree", "deterministic_structure", "process_current", "process_history", "workflow_runs",),
    "TrackingLevel": ("0", "1", "2", "3", "4", "5",),
}
#: Records by name, with their key.
_CONTRACTS = """
CandidateExtractionGapSignal candidate_extraction_gap_signal_id: candidate_extraction_gap_signal_id string, interval_candidate_segment_id string, source_id string, previous_source_revision_id string, current_source_revision_id string, previous_capture_id string, current_capture_id string, paths array<path>, previous_diagnostic_ids array<string>, current_diagnostic_ids array<string>, segmentation_run_id string, previous_extraction_run_id string, current_extraction_run_id string, reduction_run_id string
CandidateFactualReduction candidate_factual_reduction_id: candidate_factual_reduction_id string, interval_candidate_segment_id string, source_id string, previous_source_revision_id string, current_source_revision_id string, paths array<path>, affected_file_plan_ids array<string>, capture_scoped_paths array<path>, policy_suppressed_paths array<path>, artifact_delta_ids array<string>, artifact_delta_paths array<path>, structural_delta_ids array<string>, structural_delta_paths array<path>, assertion_changed_paths array<path>, artifact_only_paths array<path>, git_only_paths array<path>, signal_kinds array<CandidateSignalKind>, disposition CandidateReductionDisposition, diff_run_id string, segmentation_run_id string, planner_run_id string, previous_capture_id string, current_capture_id string, previous_extraction_run_id string, current_extraction_run_id string, change_run_id string, reduction_run_id string
CapturePlanSide -: source_revision_id string, disposition CapturePlanDisposition, reason CapturePlanReason, entry_type string?, object_sha sha1?, size long?
AffectedFileCapturePlan affected_file_plan_id: affected_file_plan_id string, git_path_delta_id string, source_id string, previous_source_revision_id string, current_source_revision_id string, path string, surface ChangeSurface, previous CapturePlanSide, current CapturePlanSide, tracking_assignment_id string, tracking_level string, diff_run_id string, planner_run_id string
ArtifactDelta artifact_delta_id: artifact_delta_id string, source_id string, previous_source_revision_id string, current_source_revision_id string, previous_capture_id string, current_capture_id string, source_locator path, change_type ArtifactDeltaType, previous_artifact_id string?, current_artifact_id string?, previous_retrieval_status RetrievalStatus?, current_retrieval_status RetrievalStatus?, previous_content_hash digest?, current_content_hash digest?, previous_media_type string?, current_media_type string?, diff_run_id string
StructuralDelta structural_delta_id: structural_delta_id string, artifact_delta_id string, source_id string, previous_source_revision_id string, current_source_revision_id string, source_locator path, structural_key string, change_type StructuralDeltaType, extractor_name string, extractor_version string, previous_evidence_id string?, current_evidence_id string?, previous_locator path?, current_locator path?, previous_value json?, current_value json?, diff_run_id string
Source source_id: source_id string, source_kind SourceKind, source_role SourceRole, canonical_locator string, first_seen_at timestamp, last_seen_at timestamp
RepositoryIdentity source_id: source_id string, provider_repository_id string, owner string, name string, default_branch string, aliases array<string>, archived boolean
SourceRevision source_revision_id: source_revision_id string, source_id string, commit_sha sha1, tree_sha sha1, observed_at timestamp
DiscoveryChannel discovery_channel_id: discovery_channel_id string, channel_type DiscoveryChannelType, name string, canonical_locator string, created_at timestamp
DiscoveryRun discovery_run_id: discovery_run_id string, discovery_channel_id string, pipeline_run_id string, observed_at timestamp, hit_count long
DiscoveryHit discovery_hit_id: discovery_hit_id string, discovery_run_id string, source_id string?, ordinal long, discovered_locator string
RepositoryLocator repository_locator_id: repository_locator_id string, source_id string, provider_repository_id string, owner string, name string, canonical_locator string, default_branch string, archived boolean, fork boolean, parent_provider_repository_id string?, observed_at timestamp, pipeline_run_id string
DiscoveryResolution discovery_resolution_id: discovery_resolution_id string, discovery_hit_id string, source_id string, repository_locator_id string, resolution_method RepositoryResolutionMethod, resolver_version string, resolved_at timestamp, pipeline_run_id string
CaptureArtifactRef -: artifact_id string, source_locator path, content_hash digest?, media_type string?, retrieval_status RetrievalStatus
CaptureManifest capture_id: capture_id string, source_revision_id string, capture_policy_version string, captured_at timestamp, artifacts array<CaptureArtifactRef>
Artifact artifact_id: artifact_id string, capture_id string, source_locator path, content_hash digest, media_type string
PipelineRun run_id: run_id string, run_type RunType, code_version string, schema_version_used string, policy_version string, started_at timestamp, finished_at timestamp?, inputs_hash digest, outputs_hash digest?
EvidenceFact evidence_id: evidence_id string, artifact_id string, locator path, raw_value json, normalized_value json, extractor_name string, extractor_version string, run_id string
SourceAssertion assertion_id: assertion_id string, artifact_id string, locator path, statement string, extractor_name string, extractor_version string, run_id string
Observation observation_id: observation_id string, logical_claim_id string, epistemic_type ObservationEpistemicType, statement string, validation_state ValidationState, reasoning_run_id string, created_at timestamp, supersedes_observation_id string?
ObservationSupport support_edge_id: support_edge_id string, observation_id string, support_id string, support_type SupportType
Pattern pattern_id: pattern_id string, logical_claim_id string, epistemic_type ObservationEpistemicType, statement string, validation_state ValidationState, synthesis_run_id string, created_at timestamp
PatternOccurrence occurrence_id: occurrence_id string, pattern_id string, source_revision_id string, role PatternOccurrenceRole, summary string
PatternOccurrenceSupport support_edge_id: support_edge_id string, occurrence_id string, observation_id string
RepositoryRelationship relationship_id: relationship_id string, source_id string, relationship_type RelationshipType, can_write boolean, can_contribute boolean, observed_at timestamp
ActionRecommendation action_id: action_id string, subject_id string, action_type ActionType, target string, rationale string, repository_modification_required boolean, authorization_required boolean, status ActionStatus, created_at timestamp
ReviewDecision review_id: review_id string, subject_id string, decision ReviewDecisionType, decided_at timestamp, notes string
ExtractionDiagnostic extraction_diagnostic_id: extraction_diagnostic_id string, capture_id string, source_revision_id string, artifact_id string, source_locator path, extractor_name string, extractor_version string, error_type string, error_message string, run_id string
CommitRangeSummary commit_range_summary_id: commit_range_summary_id string, source_id string, previous_source_revision_id string, current_source_revision_id string, provider_status CommitRangeStatus, total_commits long, commit_shas array<sha1>, segmentation_run_id string
CommitPathSnapshot commit_path_snapshot_id: commit_path_snapshot_id string, source_id string, previous_source_revision_id string, current_source_revision_id string, commit_sha sha1, ordinal long, parent_shas array<sha1>, touched_paths array<path>, segmentation_run_id string
IntervalCandidateSegment interval_candidate_segment_id: interval_candidate_segment_id string, source_id string, previous_source_revision_id string, current_source_revision_id string, commit_path_snapshot_id string, commit_sha sha1, commit_ordinal long, path_group path, chunk_ordinal long, git_path_delta_ids array<string>, paths array<path>, segmentation_run_id string
GitPathDiffSummary git_path_diff_summary_id: git_path_diff_summary_id string, source_id string, previous_source_revision_id string, current_source_revision_id string, previous_capture_id string, current_capture_id string, delta_count long, diff_run_id string
GitPathDelta git_path_delta_id: git_path_delta_id string, source_id string, previous_source_revision_id string, current_source_revision_id string, previous_capture_id string, current_capture_id string, path string, change_type GitPathDeltaType, surface ChangeSurface, previous_entry_type string?, current_entry_type string?, previous_mode string?, current_mode string?, previous_object_sha sha1?, current_object_sha sha1?, previous_size long?, current_size long?, diff_run_id string
ArchitectureProfile architecture_profile_id: architecture_profile_id string, source_id string, source_revision_id string, profile_schema_version string, profiling_run_id string, evidence_run_ids array<string>, artifact_ids array<string>, evidence_fact_ids array<string>, source_assertion_ids array<string>, evidence_fact_count long, source_assertion_count long, artifact_count long, extractor_families array<string>, extractor_profiles array<string>, artifact_media_types array<string>, feature_keys array<string>
TriageAssessment triage_assessment_id: triage_assessment_id string, architecture_profile_id string, source_id string, source_revision_id string, triage_run_id string, policy_version string, tracking_level TrackingLevel, tracking_assignment_id string?, domain_match boolean, sensitivity_flags array<TriageSensitivity>, structural_delta_ids array<string>, band TriageBand, reasons array<TriageReason>
ReviewFeedback review_feedback_id: review_feedback_id string, review_id string, subject_type string, subject_id string, reviewer_id string, review_run_id string, recorded_at timestamp
RepositoryTrackingAssignment tracking_assignment_id: tracking_assignment_id string, source_id string, level TrackingLevel, effective_at timestamp, recorded_at timestamp, assigned_by string, reason string, policy_version string, supersedes_tracking_assignment_id string?
"""
_SCALARS = {"string": T.StringType(), "long": T.LongType(), "timestamp": T.TimestampType(), "boolean": T.BooleanType()}
_PATTERNS = {"sha1": "^[0-9a-f]{40}$", "digest": "^sha256:[0-9a-f]{64}$"}


def _lines() -> dict[str, tuple[str, list[tuple[str, str, bool]]]]:
    out = {}
    for line in _CONTRACTS.strip().splitlines():
        head, _, body = line.partition(": ")
        name, key = head.split()
        fields = [(f.split()[0], f.split()[1].rstrip("?"), f.endswith("?")) for f in body.split(", ")]
        out[name] = (key, fields)
    return out


FIELDS = _lines()
KEYS = {name: key for name, (key, _) in FIELDS.items() if key != "-"}


def data_type(kind: str) -> T.DataType:
    if m := re.fullmatch("array<(.+)>", kind):
        return T.ArrayType(data_type(m[1]))
    if kind in FIELDS and FIELDS[kind][0] == "-":
        return T.StructType([T.StructField(n, data_type(k), null) for n, k, null in FIELDS[kind][1]])
    return _SCALARS.get(kind, T.StringType())


@cache
def schema(name: str) -> T.StructType:
    """The schema of a record type; an unknown name is a KeyError."""
    rows = [T.StructField(n, data_type(k), null) for n, k, null in FIELDS[name][1]]
    return T.StructType([*rows, T.StructField("schema_version", T.StringType(), False)])


def checks(name: str) -> list[tuple[str, Column]]:
    """Named conditions that every row of a record type meets."""
    out: list[tuple[str, Column]] = [("schema_version", F.col("schema_version") == VERSION)]
    for field, kind, null in FIELDS[name][1]:
        c = F.col(field)
        rule = None
        if kind in _PATTERNS:
            rule = c.rlike(_PATTERNS[kind])
        elif kind in ENUMS:
            rule = c.isin(*ENUMS[kind])
        elif kind == "path":
            rule = F.length(c) >= 1
        elif kind == "string" and field.endswith("_id"):
            rule = (F.length(F.trim(c)) >= 1) & (F.trim(c) == c)
        elif kind == "long":
            rule = c >= 0
        if rule is None:
            out += [] if null else [(f"{field} not null", c.isNotNull())]
        else:
            out.append((field, (c.isNull() | rule) if null else F.coalesce(rule, F.lit(False))))
    return out + _CROSS.get(name, lambda: [])()


def _sorted_unique(field: str) -> tuple[str, Column]:
    return f"{field} sorted and unique", F.col(field) == F.array_sort(F.array_distinct(field))


#: Conditions over several fields.
_CROSS = {
    "Source": lambda: [("last_seen_at not before first_seen_at", F.col("last_seen_at") >= F.col("first_seen_at"))],
    "PipelineRun": lambda: [("finished_at not before started_at", F.coalesce(F.col("finished_at") >= F.col("started_at"), F.lit(True)))],
    "RepositoryRelationship": lambda: [("owners can write", (F.col("relationship_type") != "OWNED") | F.col("can_write")), ("readers can't write", (F.col("relationship_type") != "READ_ONLY") | ~F.col("can_write"))],
    "CaptureManifest": lambda: [("captured artifacts have a hash", F.forall("artifacts", lambda a: (a["retrieval_status"] == "captured") == a["content_hash"].isNotNull()))],
    "ArchitectureProfile": lambda: [_sorted_unique(f) for f in ("artifact_ids", "evidence_fact_ids", "source_assertion_ids", "extractor_families", "feature_keys")]
    + [("counts", (F.size("evidence_fact_ids") == F.col("evidence_fact_count")) & (F.size("artifact_ids") == F.col("artifact_count")))],
    "CandidateFactualReduction": lambda: [_sorted_unique(f) for f in ("paths", "capture_scoped_paths", "policy_suppressed_paths", "structural_delta_paths", "git_only_paths")]
    + [("suppressed only if all paths are", (F.col("disposition") == "retain") | (F.size("policy_suppressed_paths") == F.size("paths")))],
    "CommitPathSnapshot": lambda: [_sorted_unique("touched_paths")],
    "GitPathDelta": lambda: [("sides fit the change", F.when(F.col("change_type") == "added", F.col("previous_object_sha").isNull()).when(F.col("change_type") == "removed", F.col("current_object_sha").isNull()).otherwise(F.col("previous_object_sha").isNotNull() & F.col("current_object_sha").isNotNull()))],
    "ArtifactDelta": lambda: [("missing sides have no hash", F.coalesce(F.col("previous_retrieval_status") != "missing", F.lit(True)) | F.col("previous_content_hash").isNull())],
    "StructuralDelta": lambda: [("sides fit the change", F.when(F.col("change_type") == "added", F.col("previous_value").isNull()).when(F.col("change_type") == "removed", F.col("current_value").isNull()).otherwise(F.lit(True)))],
}


def violations(df: DataFrame, name: str) -> DataFrame:
    """(key, violation) for each check that a row fails."""
    failed = F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(label)) for label, ok in checks(name))))
    return df.select(F.col(KEYS[name]).alias("key"), F.explode(failed).alias("violation"))
