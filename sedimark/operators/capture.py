"""Capture: fetched files and provider payloads to artifacts and manifests, reconstruction, and facts of provider payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C


def requested_paths(paths: DataFrame) -> DataFrame:
    """Distinct safe paths; an unsafe one fails the query."""
    ok = F.when(C.safe_path("path"), F.col("path")).otherwise(F.raise_error(F.concat(F.lit("unsafe path "), F.coalesce("path", F.lit("null")))).cast("string"))
    return paths.select("capture_id", ok.alias("path")).distinct()


def capture_refs(requested: DataFrame, fetched: DataFrame) -> DataFrame:
    """A reference for each requested path: captured with digest and media type, or missing. fetched: capture_id, path, data."""
    met = requested.join(fetched, ["capture_id", "path"], "left")
    there = F.col("data").isNotNull()
    return met.select(
        "capture_id", C.identity("artifact", "capture_id", "path").alias("artifact_id"), F.col("path").alias("source_locator"), F.when(there, C.digest("data")).alias("content_hash"),
        F.when(there, C.media_type("path")).alias("media_type"), F.when(there, "captured").otherwise("missing").alias("retrieval_status"), "data",
    )


def manifests(refs: DataFrame) -> DataFrame:
    ref = F.struct("artifact_id", "source_locator", "content_hash", "media_type", "retrieval_status")
    return refs.groupBy("capture_id").agg(F.array_sort(F.collect_list(F.struct(F.col("source_locator").alias("k"), ref.alias("r")))).alias("x")).select("capture_id", F.col("x.r").alias("artifacts"))


def reconstruction_faults(manifest: DataFrame, artifacts: DataFrame, objects: DataFrame) -> DataFrame:
    """What keeps captures from being a closed set: captured references without artifact or object, artifacts without reference, repeated paths, other states."""
    refs = manifest.select("capture_id", F.explode("artifacts").alias("r")).select("capture_id", "r.*")
    taken = refs.where("retrieval_status = 'captured'")
    fault = lambda df, what: df.select("capture_id", "source_locator", F.lit(what).alias("fault"))
    key = ["capture_id", "artifact_id"]
    return (
        fault(taken.join(artifacts.select(*key), key, "left_anti"), "no artifact")
        .unionByName(fault(artifacts.join(taken.select(*key), key, "left_anti"), "not in the manifest"))
        .unionByName(fault(taken.join(objects.select("content_hash"), "content_hash", "left_anti"), "no object"))
        .unionByName(fault(refs.groupBy("capture_id", "source_locator").count().where("count > 1"), "repeated path"))
        .unionByName(fault(refs.where(~F.col("retrieval_status").isin("captured", "missing")), "state"))
    )


def drift(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Identities whose recorded fields changed."""
    from .guards import mixed_generation

    return mixed_generation(new, old, key, fields)


def authorised(captures: DataFrame, locators: DataFrame, runs: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Captures whose source's latest locator comes from a registry run with exactly one resolution."""
    from .governance import latest_locators

    latest = latest_locators(locators, "source_id", "observed_at", "repository_locator_id")
    one = resolutions.groupBy("repository_locator_id").agg(F.count("*").alias("n")).where("n = 1").drop("n")
    sound = latest.join(runs.where("run_type = 'registry'").select(F.col("run_id").alias("pipeline_run_id")), "pipeline_run_id", "left_semi").join(one, "repository_locator_id", "left_semi")
    return captures.join(sound.select("source_id", "repository_locator_id"), "source_id")


# canonical payloads


def tree_entries(trees: DataFrame) -> DataFrame:
    """Entries of tree payloads (tree_sha, body(sha, truncated, tree)); truncated trees, other shas, kinds or unsafe paths fail the query."""
    whole = F.when(F.col("body.truncated") | (F.col("body.sha") != F.col("tree_sha")), F.raise_error(F.concat(F.lit("tree isn't whole: "), "tree_sha")).cast(trees.schema["body"].dataType["tree"].dataType)).otherwise(F.col("body.tree"))
    rows = trees.select("tree_sha", F.explode(whole).alias("e")).select("tree_sha", "e.path", "e.mode", F.col("e.type").alias("entry_type"), F.col("e.sha").alias("object_sha"), "e.size")
    ok = C.safe_path("path") & F.col("entry_type").isin("blob", "tree", "commit") & F.col("object_sha").rlike("^[0-9a-f]{40}$")
    return rows.withColumn("path", F.when(ok, F.col("path")).otherwise(F.raise_error(F.concat(F.lit("bad entry "), "path")).cast("string")))


def sorted_names(items: str, field: str) -> Column:
    return F.array_sort(F.array_distinct(F.transform(items, lambda x: x[field])))


def ordered_events(events: DataFrame) -> DataFrame:
    """Histories (issue_id, events) with events by time and id; repeated ids fail the query."""
    keyed = F.array_sort(F.transform("events", lambda e: F.struct(C.utc(e["created_at"]).alias("at"), e["id"].alias("id"), e.alias("e"))))
    unique = F.size(F.array_distinct(F.transform("events", lambda e: e["id"]))) == F.size("events")
    return events.withColumn("events", F.when(unique, F.transform(keyed, lambda x: x["e"])).otherwise(F.raise_error(F.lit("repeated event")).cast(events.schema["events"].dataType)))


def jobs_with_logs(jobs: DataFrame, probes: DataFrame) -> DataFrame:
    """Jobs of a run with what is known of their logs, by provider id."""
    return jobs.join(probes.select(F.col("job_id").alias("id"), "availability", "http_status", "redirected"), "id", "left")


def incomplete_collections(runs: DataFrame) -> DataFrame:
    """Runs whose lists don't have as many items as the provider counts."""
    return runs.where((F.size("jobs") != F.col("jobs_total")) | (F.size("artifacts") != F.col("artifacts_total")))


def unpivoted(df: DataFrame, keys: list[str], fields: list[str], locator: str, name: str, keep_nulls: bool = True) -> DataFrame:
    """Facts of flat payload fields: a row for each field, at locator/field; nulls are kept as JSON null, or dropped."""
    field = lambda f: F.struct(F.lit(f).alias("field"), F.get_json_object(F.to_json(F.struct(F.col(f).alias("v")), {"ignoreNullFields": "false"}), "$.v").alias("text"), F.col(f).isNull().alias("none"))
    rows = df.select(*keys, F.explode(F.array(*map(field, fields))).alias("f"))
    rows = rows if keep_nulls else rows.where("not f.none")
    value = F.when(F.col("f.none"), "null").otherwise(F.col("f.text"))
    return rows.select(*keys, F.concat(F.lit(locator), F.lit("/"), C.pointer_escape("f.field")).alias("locator"), value.alias("raw_value"), value.alias("normalized_value"), F.lit(name).alias("extractor_name"), F.lit("1").alias("extractor_version"))


#: Fields that become facts, by payload.
COMMIT_FIELDS = ["sha", "tree_sha", "parent_shas", "parent_count", "author_date", "committer_date"]
EVENT_FIELDS = ["id", "node_id", "event", "actor", "commit_id", "commit_url", "created_at"]
METADATA_FIELDS = ["id", "owner", "name", "default_branch", "archived", "fork", "visibility"]
STEP_FIELDS = ["number", "name", "status", "conclusion", "started_at", "completed_at"]


def commit_facts(commits: DataFrame) -> DataFrame:
    return unpivoted(commits, ["artifact_id"], COMMIT_FIELDS, "$git/commit#", "git-commit-metadata")


def event_facts(histories: DataFrame) -> DataFrame:
    """Facts of each event, at its place; nulls are dropped."""
    rows = histories.select("artifact_id", F.posexplode("events").alias("at", "e")).select("artifact_id", "at", "e.*")
    out = unpivoted(rows, ["artifact_id", "at"], EVENT_FIELDS, "", "github-issue-events", keep_nulls=False)
    return out.withColumn("locator", F.concat(F.lit("$github/events#/events/"), F.col("at").cast("string"), "locator")).drop("at")


def metadata_facts(rows: DataFrame) -> DataFrame:
    return unpivoted(rows, ["artifact_id"], METADATA_FIELDS, "$github/repository#", "github-repository-metadata")


def step_facts(jobs: DataFrame) -> DataFrame:
    """Facts of workflow steps, addressed by job id and step number."""
    rows = jobs.select("artifact_id", F.col("id").alias("job"), F.explode("steps").alias("s")).select("artifact_id", "job", F.col("s.number").alias("step"), "s.*")
    out = unpivoted(rows, ["artifact_id", "job", "step"], STEP_FIELDS, "", "github-workflow-metadata")
    return out.withColumn("locator", F.concat(F.lit("$github/run#/jobs/"), F.col("job").cast("string"), F.lit("/steps/"), F.col("step").cast("string"), "locator")).drop("job", "step")


#: Fields of issues and pull requests that become facts; absent ones are skipped, null ones are kept.
PROCESS_FIELDS = [
    "id", "node_id", "number", "html_url", "state", "state_reason", "author", "author_association", "locked", "comments", "labels", "assignees", "created_at", "updated_at", "closed_at",
    "draft", "merged", "merge_commit_sha", "requested_reviewers", "commits", "changed_files", "additions", "deletions", "merged_at", "head", "base",
]
RUN_FIELDS = [
    "id", "name", "run_number", "run_attempt", "event", "status", "conclusion", "workflow_id", "head_branch", "head_sha", "path", "display_title", "created_at", "updated_at", "run_started_at", "actor", "html_url",
]


def process_facts(rows: DataFrame) -> DataFrame:
    """Facts of issues and pull requests, of the fields that their payload has; lists of names are sorted and unique."""
    names = [c for c in PROCESS_FIELDS if c in rows.columns]
    flat = rows
    for c in ("labels", "assignees", "requested_reviewers"):
        if c in names:
            flat = flat.withColumn(c, F.to_json(F.array_sort(F.array_distinct(c))))
    return unpivoted(flat, ["artifact_id"], names, "$github/process#", "github-process-metadata")


def process_assertions(rows: DataFrame) -> DataFrame:
    """Titles and bodies, stripped; empty ones are dropped."""
    one = lambda c: rows.select("artifact_id", F.lit(f"$github/process#/{c}").alias("locator"), F.trim(c).alias("statement"))
    return one("title").unionByName(one("body")).where("statement is not null and statement <> ''")


def run_facts(rows: DataFrame, revisions: DataFrame) -> DataFrame:
    """Facts of workflow runs; a run whose head isn't its revision's commit fails the query. revisions: artifact_id, commit_sha."""
    met = rows.join(revisions, "artifact_id")
    sound = met.withColumn("head_sha", F.when(F.col("head_sha") == F.col("commit_sha"), F.col("head_sha")).otherwise(F.raise_error(F.concat(F.lit("run of another commit: "), "head_sha")).cast("string")))
    return unpivoted(sound, ["artifact_id"], [c for c in RUN_FIELDS if c in rows.columns], "$github/run#", "github-workflow-metadata")


def inconsistent_metadata(rows: DataFrame) -> DataFrame:
    """Repository payloads whose privacy contradicts their visibility."""
    return rows.where(F.col("private") != (F.col("visibility") == "private"))


def tree_facts(entries: DataFrame) -> DataFrame:
    """Per tree its count and paths, per entry its type, mode, sha and size."""
    one = unpivoted(entries, ["tree_sha", "path"], ["entry_type", "mode", "object_sha", "size"], "", "git-root-tree")
    one = one.withColumn("locator", F.concat(F.lit("$git/tree#/entries/"), C.pointer_escape("path"), "locator")).drop("path")
    sums = entries.groupBy("tree_sha").agg(F.count("*").alias("entry_count"), F.to_json(F.array_sort(F.collect_list("path"))).alias("entry_paths"))
    return one.unionByName(unpivoted(sums, ["tree_sha"], ["entry_count", "entry_paths"], "$git/tree#", "git-root-tree"))
