"""Facts of whole provider payloads: a snapshot is a row, its facts are numbered in the order of the payload and have identities made of it.

Each snapshot's facts are built as one array expression and exploded with their places: no shuffle, no window. Values are text; lists are JSON, null is `null`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C

#: Fields that become facts, in order.
RUN = "id name path display_title run_number event status conclusion workflow_id check_suite_id head_branch head_sha run_attempt created_at updated_at run_started_at pull_request_numbers".split()
JOB = "id name status conclusion run_attempt head_sha created_at started_at completed_at labels runner_id runner_name runner_group_id runner_group_name step_count".split()
LOG = "availability http_status redirected".split()
STEP = "number name status conclusion started_at completed_at".split()
ARTIFACT = "id name size_in_bytes expired created_at updated_at expires_at".split()
COMMIT = "commit_sha tree_sha parents parent_count author_timestamp committer_timestamp".split()
VERIFICATION = "verified reason verified_at".split()
EVENT = "provider_id node_id event created_at actor_login commit_id commit_url".split()


def _text(value: Column) -> Column:
    return F.get_json_object(F.to_json(F.struct(value.alias("v")), {"ignoreNullFields": "false"}), "$.v")


def _fields(at: Column, of: Column, names: list[str], have: list[str]) -> Column:
    """(locator, value) of the fields that the payload's type has."""
    return F.array(*(F.struct(F.concat(at, F.lit(f"/{n}")).alias("locator"), _text(of[n]).alias("value")) for n in names if n in have))


def _names(schema, *path: str) -> list[str]:
    """Field names of a nested struct or of an array's elements; none if it isn't there."""
    for p in path:
        if p not in schema.fieldNames():
            return []
        schema = schema[p].dataType
        schema = getattr(schema, "elementType", schema)
    return schema.fieldNames() if hasattr(schema, "fieldNames") else []


def _facts(rows: DataFrame, facts: Column, run: str, kind: str, extractor: str, keep_nulls: bool = True) -> DataFrame:
    kept = facts if keep_nulls else F.filter(facts, lambda f: f["value"].isNotNull())
    out = rows.select("artifact_id", F.posexplode(kept).alias("k", "f")).select("artifact_id", (F.col("k") + 1).cast("long").alias("fact_index"), "f.locator", F.coalesce("f.value", F.lit("null")).alias("normalized_value"))
    ident = F.concat(F.lit("fact:"), F.sha2(F.concat_ws(C.NUL, F.lit(kind), F.lit(run), F.col("fact_index").cast("string"), F.col("locator")).cast("binary"), 256))
    return out.select("artifact_id", ident.alias("evidence_id"), "fact_index", "locator", F.col("normalized_value").alias("raw_value"), "normalized_value", F.lit(extractor).alias("extractor_name"), F.lit("1").alias("extractor_version"))


def workflow_facts(snapshots: DataFrame, run: str) -> DataFrame:
    """Facts of workflow runs: artifact_id, source_locator, run, job_count, artifact_count, jobs (with log and steps) and artifacts, addressed by the provider's ids."""
    root, s = F.concat("source_locator", F.lit("#")), snapshots.schema
    job_names, step_names, log_names = _names(s, "jobs"), _names(s, "jobs", "steps"), _names(s, "jobs", "log")

    def job(j):
        at = F.concat(root, F.lit("/jobs/"), j["id"].cast("string"))
        steps = F.transform(j["steps"], lambda x: _fields(F.concat(at, F.lit("/steps/"), x["number"].cast("string")), x, STEP, step_names))
        return F.concat(_fields(at, j, JOB, job_names), _fields(F.concat(at, F.lit("/log")), j["log"], LOG, log_names), F.flatten(steps))

    counts = F.array(*(F.struct(F.concat(root, F.lit(f"/{c}")).alias("locator"), F.col(c).cast("string").alias("value")) for c in ("job_count", "artifact_count")))
    made = F.transform("artifacts", lambda a: _fields(F.concat(root, F.lit("/artifacts/"), a["id"].cast("string")), a, ARTIFACT, _names(s, "artifacts")))
    facts = F.concat(_fields(F.concat(root, F.lit("/run")), F.col("run"), RUN, _names(s, "run")), counts, F.flatten(F.transform("jobs", job)), F.flatten(made))
    return _facts(snapshots, facts, run, "github-workflow", "github-workflow-metadata")


def workflow_count_faults(snapshots: DataFrame) -> DataFrame:
    """(artifact_id, fault) of snapshots whose lists don't have as many items as they say, or whose ids repeat."""
    twice = lambda c: F.size(F.array_distinct(F.transform(c, lambda x: x["id"]))) != F.size(c)
    rules = {"jobs differ from job_count": F.size("jobs") != F.col("job_count"), "artifacts differ from artifact_count": F.size("artifacts") != F.col("artifact_count"), "repeated job": twice("jobs"), "repeated artifact": twice("artifacts")}
    return snapshots.select("artifact_id", F.explode(F.array_compact(F.array(*(F.when(c, F.lit(t)) for t, c in rules.items())))).alias("fault"))


def commit_facts(commits: DataFrame, run: str) -> DataFrame:
    """Facts of commit payloads: artifact_id, source_locator, the fields of COMMIT but parent_count, and verification (null where the provider has none)."""
    rows = commits.withColumn("parent_count", F.size(F.coalesce("parents", F.array().cast("array<string>"))))
    at = F.concat("source_locator", F.lit("#"))
    own = F.array(*(F.struct(F.concat(at, F.lit(f"/{n}")).alias("locator"), _text(F.col(n)).alias("value")) for n in COMMIT))
    none = F.array().cast("array<struct<locator string, value string>>")
    checked = _fields(F.concat(at, F.lit("/verification")), F.col("verification"), VERIFICATION, _names(commits.schema, "verification"))
    return _facts(rows, F.concat(own, F.when(F.col("verification").isNotNull(), checked).otherwise(none)), run, "fact", "git-commit-metadata")


def commit_messages(commits: DataFrame) -> DataFrame:
    """The commit's message as an assertion; an empty one fails the query."""
    said = F.when(F.coalesce(F.trim(F.regexp_replace("message", r"\s+", " ")), F.lit("")) != "", F.col("message")).otherwise(F.raise_error(F.concat(F.lit("commit without a message: "), "commit_sha")).cast("string"))
    return commits.select("artifact_id", F.concat("source_locator", F.lit("#message")).alias("locator"), said.alias("statement"), F.lit("git-commit-message").alias("extractor_name"), F.lit("1").alias("extractor_version"))


def message_check(requirements: DataFrame, messages: DataFrame) -> DataFrame:
    """requirements (requirement_id, artifact_id, fragments, needed_capability) with their status: recovered if the commit's message holds all fragments; else the missing ones and the capability needed."""
    met = requirements.join(messages.select("artifact_id", "locator", C.folded("statement").alias("said")), "artifact_id", "left")
    missing = F.filter("fragments", lambda f: ~F.contains(F.coalesce("said", F.lit("")), C.folded(f)))
    whole = (F.size(missing) == 0) & F.col("said").isNotNull()
    return met.select(
        "requirement_id", F.when(whole, "recovered").otherwise("gap").alias("status"), F.when(whole, F.col("locator")).alias("locator"), missing.alias("missing"),
        F.when(~whole, F.coalesce("needed_capability", F.lit("commit-metadata-and-change-facts"))).alias("needed_capability"),
    )


def event_facts(histories: DataFrame, run: str) -> DataFrame:
    """Facts of issue-event histories: artifact_id, source_locator, repository_full_name, issue_number, events in order. Three aggregates, and of each event the fields that aren't null."""
    at = F.concat("source_locator", F.lit("#"))
    head = F.array(
        F.struct(F.concat(at, F.lit("/repository_full_name")).alias("locator"), F.col("repository_full_name").alias("value")), F.struct(F.concat(at, F.lit("/issue_number")).alias("locator"), F.col("issue_number").cast("string").alias("value")),
        F.struct(F.concat(at, F.lit("/event_count")).alias("locator"), F.size("events").cast("string").alias("value")),
    )
    each = F.transform("events", lambda e, k: _fields(F.concat(at, F.lit("/events/"), k.cast("string")), e, EVENT, _names(histories.schema, "events")))
    return _facts(histories, F.concat(head, F.flatten(each)), run, "event-fact", "github-issue-events", keep_nulls=False)


def tree_facts(trees: DataFrame, run: str) -> DataFrame:
    """Facts of tree payloads: artifact_id, source_locator, tree_sha, recursive, truncated, entries (path, type, mode, sha, size) in order of path."""
    at = F.concat("source_locator", F.lit("#"))
    one = lambda n, v: F.struct(F.concat(at, F.lit(f"/{n}")).alias("locator"), v.alias("value"))
    head = F.array(
        one("tree_sha", F.col("tree_sha")), one("recursive", F.col("recursive").cast("string")), one("truncated", F.col("truncated").cast("string")), one("entry_count", F.size("entries").cast("string")),
        one("entry_paths", F.to_json(F.transform("entries", lambda e: e["path"]))),
    )
    each = F.transform("entries", lambda e: _fields(F.concat(at, F.lit("/entries/"), C.pointer_escape(e["path"])), e, ["type", "mode", "sha", "size"], _names(trees.schema, "entries")))
    return _facts(trees, F.concat(head, F.flatten(each)), run, "tree-fact", "git-root-tree")


def family_counts(facts: DataFrame, *by: str) -> DataFrame:
    """Facts by extractor family."""
    return facts.groupBy(*by, "extractor_name").agg(F.count("*").alias("n_facts"))
