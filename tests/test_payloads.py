"""Whole payloads, reports and validators on odd rows."""

import hashlib

import pytest
from pyspark.sql import functions as F

from sedimark.functions import columns as C
from sedimark.operators import governance, payloads
from sedimark.plans import reports

RUN = (
    "artifact_id string, source_locator string, run struct<id long, name string>, job_count int, artifact_count int,"
    " jobs array<struct<id long, labels array<string>, log struct<availability string>, steps array<struct<number int, name string>>>>, artifacts array<struct<id long, expired boolean>>"
)


def test_workflow_facts(spark):
    row = ("a", "$run/1", (1, None), 1, 0, [(7, ["x", "y"], ("missing",), [(1, "s"), (2, None)])], [])
    f = payloads.workflow_facts(spark.createDataFrame([row], RUN), "r").orderBy("fact_index").collect()
    assert [(x.locator.removeprefix("$run/1#"), x.normalized_value) for x in f] == [
        ("/run/id", "1"), ("/run/name", "null"), ("/job_count", "1"), ("/artifact_count", "0"), ("/jobs/7/id", "7"), ("/jobs/7/labels", '["x","y"]'), ("/jobs/7/log/availability", "missing"),
        ("/jobs/7/steps/1/number", "1"), ("/jobs/7/steps/1/name", "s"), ("/jobs/7/steps/2/number", "2"), ("/jobs/7/steps/2/name", "null"),
    ]
    assert f[0].evidence_id == "fact:" + hashlib.sha256(b"github-workflow\0r\0001\0$run/1#/run/id").hexdigest()
    bad = ("b", "$run/2", (1, None), 3, 0, [(7, [], None, []), (7, [], None, [])], [])
    assert {x.fault for x in payloads.workflow_count_faults(spark.createDataFrame([row, bad], RUN)).collect()} == {"jobs differ from job_count", "repeated job"}


def test_commits_and_trees(spark):
    kinds = "artifact_id string, source_locator string, commit_sha string, tree_sha string, parents array<string>, author_timestamp string, committer_timestamp string, verification struct<verified boolean, reason string>, message string"
    df = spark.createDataFrame([("a", "$git/commit", "c", "t", None, "1", "2", None, " Fix\n it "), ("b", "$git/commit", "d", "t", ["c"], "1", "2", (False, "unsigned"), "x")], kinds)
    by = {}
    for x in payloads.commit_facts(df, "r").collect():
        by.setdefault(x.artifact_id, {})[x.locator.split("#/")[1]] = x.normalized_value
    assert by["a"]["parent_count"] == "0" and len(by["a"]) == 6 and by["b"]["verification/verified"] == "false" and len(by["b"]) == 8
    need = spark.createDataFrame([("r", "a", ["fix IT"], None), ("s", "a", ["no"], None), ("t", "z", ["x"], "cap")], "requirement_id string, artifact_id string, fragments array<string>, needed_capability string")
    got = {x.requirement_id: (x.status, x.missing, x.needed_capability) for x in payloads.message_check(need, payloads.commit_messages(df)).collect()}
    assert got == {"r": ("recovered", [], None), "s": ("gap", ["no"], "commit-metadata-and-change-facts"), "t": ("gap", ["x"], "cap")}
    with pytest.raises(Exception, match="without a message"):
        payloads.commit_messages(df.withColumn("message", F.lit(" \n"))).collect()
    tree = spark.createDataFrame([("t", "$git/tree", "s", False, True, [("a/~b", "blob", 3)])], "artifact_id string, source_locator string, tree_sha string, recursive boolean, truncated boolean, entries array<struct<path string, type string, size long>>")
    assert {(x.locator.split("#")[1], x.normalized_value) for x in payloads.tree_facts(tree, "r").collect()} == {
        ("/tree_sha", "s"), ("/recursive", "false"), ("/truncated", "true"), ("/entry_count", "1"), ("/entry_paths", '["a/~b"]'), ("/entries/a~1~0b/type", "blob"), ("/entries/a~1~0b/size", "3"),
    }


def test_reports(spark, tmp_path):
    kinds = "case_id string, requirement_id string, status string, needed_capability string, matched_locators array<string>, missing array<string>"
    r = spark.createDataFrame([("c", "r1", "recovered", None, ["a:L1", "b:L2"], []), ("c", "r2", "gap", "ast", [], ["f"])], kinds)
    r = reports.with_unsupported(r, spark.createDataFrame([("d", "r3", "other")], "case_id string, requirement_id string, needed_capability string"))
    reports.write_markdown(r, str(tmp_path / "md"))
    lines = "\n".join(open(f).read().rstrip() for f in sorted((tmp_path / "md").glob("part-*"))).splitlines()
    assert lines == [
        "- Cases: **2**", "- Requirements: **3**", "- Recovered: **1**", "- Gaps: **2**", "- Fraction: **0.333**", "| `c` | 1 | 2 | 0.500 |", "| `d` | 0 | 1 | 0.000 |", "- `ast`: 1", "- `other`: 1",
        "- `r1`: **recovered**", "  - matched: `a:L1`", "  - matched: `b:L2`", "- `r2`: **gap** needs `ast`", "  - missing: `f`", "- `r3`: **gap** needs `other`",
    ]
    reports.write_json(r, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 3


def test_watchlist_and_times(spark):
    w = spark.createDataFrame([(1, "o/n"), (2, "p/q")], "position int, repository string")
    one = spark.createDataFrame([("o/n", " s ")], "repository string, source_id string")
    assert [tuple(x) for x in governance.watchlist_candidates(w, one).orderBy("position").collect()] == [(1, "o/n", "s"), (2, "p/q", None)]
    for bad in ([("o/n", " ")], [("o/n", "s"), ("o/n", "t")]):
        with pytest.raises(Exception, match="invalid source"):
            governance.watchlist_candidates(w, spark.createDataFrame(bad, "repository string, source_id string")).collect()
    t = spark.createDataFrame([("2020-01-01T00:00:00Z", "2020-01-01T00:01:30Z"), (None, "2020-01-01T00:01:30Z"), ("x", "y")], "a string, b string")
    assert sorted((x.s for x in t.select(C.elapsed_seconds("a", "b").alias("s")).collect()), key=str) == [90, None, None]
    assert tuple(governance.outcome_counts(spark.createDataFrame([("ready",), ("ready",), ("deferred",)], "outcome string")).first()) == (2, 0, 1)
