"""What grows with tables: sides of joins that extractors make, tasks that parse, rows that a task holds."""

import os

import pytest
from pyspark.sql import functions as F

from sedimark.operators import extract, selectors
from sedimark.plans import envelopes, registry

DATA = "/root/testdata/sf0.001"
tables_here = pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables here")


def plan(df):
    return df._jdf.queryExecution().toString().split("== Physical Plan ==")[1]


@tables_here
def test_nodes_are_counted_without_a_join(spark):
    """The planner takes extracted rows for as few bytes as their artifacts and would broadcast them."""
    text = plan(registry.queries()["python_nodes"](spark, DATA))
    assert "Join" not in text and text.count("MapInArrow") == 1


def test_nodes_inside(spark):
    module = '"""doc"""\nclass A:\n    def f(self):\n        assert g(h(1))\n        return [g(x) for x in y]\n\nz = A()\n'
    rows = [(1, "a.py", module), (1, "b.py", module), (None, "c.py", "f()"), (2, "d.py", "")]
    nodes = extract.python_nodes(spark.createDataFrame(rows, "artifact_id long, source_locator string, text string"))
    found = nodes.collect()
    want = sorted((str(r.artifact_id), r.locator, sum(s.source_locator == r.source_locator and r.pre < s.pre and s.post < r.post for s in found)) for r in found)
    assert sorted((str(r.artifact_id), r.locator, r.n_inside) for r in extract.counted_inside(nodes).collect()) == want and max(w[2] for w in want) == 5


@tables_here
def test_extracted_rows_are_not_broadcast(spark):
    for name in ("python_selectors", "locator_prefixes"):
        assert "Broadcast" not in plan(registry.queries()[name](spark, DATA)), name
    facts = spark.createDataFrame([("a.ts", "a.ts:L1", "{}")], "source_locator string, locator string, normalized_value string")
    said = spark.createDataFrame([("a.ts", "b", "a.ts:L2")], "source_locator string, statement string, locator string")
    asked = spark.createDataFrame([("s", 2, "b.ts", "comment", None, "n", None)], "requirement_id string, place int, artifact string, kind string, field string, contains string, equals string")
    assert "Broadcast" not in plan(selectors.bundle_matches(facts, said, asked))


def test_fragments_with_letters_without_an_upper_case_of_their_own(spark, tmp_path):
    """The upper case of "ß" is "SS", whose lower case is another word."""
    spark.createDataFrame([(1, "ßa ßa", "s", "de", 5), (2, "Haus haus", "s", "de", 9)], "doc_id long, text string, source string, lang string, n_chars int").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.artifact: r.covered for r in registry.queries()["fragments_over_assertions"](spark, str(tmp_path)).collect()}
    assert got["s/de/doc-1.md"] and got["s/de/doc-2.md"]


@tables_here
def test_parsing_is_dealt_over_all_tasks(spark):
    for name in ("typescript_scopes", "pyproject_facts", "python_ast_facts", "package_json_facts"):
        assert registry.queries()[name](spark, DATA).rdd.getNumPartitions() == 4, name


@tables_here
def test_workflow_payloads_are_built_after_the_only_shuffle(spark):
    """Payloads are ten times their lines: no sort and no join may hold them."""
    text = plan(registry.queries()["workflow_count_faults"](spark, DATA)).split("== ")[0]
    assert "Join" not in text and "Window" not in text and text.count("Exchange ") == 1


def test_workflows_of_lines_without_an_order(spark, tmp_path):
    lines = [(2, 1, "A", "O", 1.0), (2, 2, "B", "F", 2.0), (9, 1, "A", "O", 3.0), (None, 1, "A", "O", 4.0)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_returnflag string, l_linestatus string, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(2, "F", "1-URGENT"), (3, "O", "5-LOW"), (None, "O", "5-LOW")], "o_orderkey long, o_orderstatus string, o_orderpriority string").write.parquet(str(tmp_path / "orders.parquet"))
    (row,) = registry._workflows(spark, str(tmp_path)).collect()
    assert (row.artifact_id, row.job_count, row.artifact_count, row.run.conclusion) == (2, 3, 2, None)
    assert [(j.id, j.name, j.log.http_status, [s.conclusion for s in j.steps]) for j in row.jobs] == [(1, "A", None, ["success"] * 2), (2, "B", 302, [None] * 2)] and [a.size_in_bytes for a in row.artifacts] == [1, 2]


def test_only_breaks_go_up_a_chain(spark, monkeypatch):
    """No closure over whole runs is made; breaks go up all steps, and the first by stage counts."""
    monkeypatch.setattr(envelopes, "reached", lambda *_: pytest.fail("all pairs of runs"))
    read = [("b", "a"), ("c", "b"), ("d", "c"), ("d", "x"), ("y", "x")]
    stages = {"a": "capture", "b": "extraction", "c": "change", "d": "reduce", "x": "capture", "y": "extraction"}
    runs = spark.createDataFrame([(r, s, "1", "{}", f"h{r}") for r, s in stages.items()], "run_id string, stage string, policy_version string, params string, outputs_hash string")
    reads = spark.createDataFrame([(r, "in", p) for r, p in [*read, *((r, None) for r in "ax")]], "run_id string, role string, parent_id string").where("parent_id is not null")
    reads = reads.unionByName(spark.createDataFrame([("a", "self", "a"), ("x", "self", "x")], "run_id string, role string, parent_id string"))
    signed = envelopes.signed(runs, reads)
    outputs = runs.select("run_id", F.when(F.col("run_id").isin("b", "c"), "other").otherwise(F.col("outputs_hash")).alias("outputs_hash"))
    got = {r.run_id: (r.fault, r.first_run) for r in envelopes.chain_faults(signed, reads, outputs).collect()}
    assert got == {"b": ("other outputs", "b"), "c": ("other outputs", "b"), "d": (None, "b")}
