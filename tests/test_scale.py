"""Orders of hot keys, the ledger's layout, and chains of envelopes."""

import random

import pytest
from pyspark.sql import functions as F

from sedimark.operators import extract, governance, guards, ordering
from sedimark.plans import comparison, envelopes, pipelines
from sedimark.sources import tables


def timelines(spark, seed):
    r = random.Random(seed)
    key = lambda: r.choice(("hot",) * 6 + ("a", "b", None))
    facts = [(key(), r.choice((None, *range(30))), k) for k in range(400)]
    marks = {(key(), r.randrange(30)): k for k in range(60)}
    f = spark.createDataFrame(facts, "k string, t int, id int")
    m = spark.createDataFrame([(k, t, f"v{v}" if v % 5 else None, v) for (k, t), v in marks.items()], "k string, at int, x string, m int")
    return f, m


def test_as_of_of_hot_keys(spark):
    """The same rows whether a key is sorted whole or by ranges; null values of the timeline are values too."""
    f, m = timelines(spark, 1)
    rows = lambda crowd: sorted(governance.as_of(f, m, "k", "t", "at", "x", "m", crowd=crowd).collect(), key=str)
    whole = rows(10**6)
    assert len(whole) == 400 and rows(5) == whole and rows(100) == whole


def test_history_of_hot_keys(spark):
    _, m = timelines(spark, 2)
    rows = lambda crowd: sorted(governance.history(m, "k", "m", "at", "m", crowd=crowd).collect(), key=str)
    assert rows(3) == rows(10**6) and any(r.supersedes is None for r in rows(3)) and max(r.version for r in rows(3)) > 10


def test_hot_keys_have_no_window_of_their_own(spark):
    """In the plan no window is by the key alone but the one over (key, range) cells."""
    f, m = timelines(spark, 3)
    plan = governance.as_of(f, m, "k", "t", "at", "x", crowd=5)._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    windows = [line for line in plan.splitlines() if "Window " in line and "windowspec" in line]
    assert windows and all("range_" in line for line in windows if "__t" not in line)
    assert "RangePartitioner" not in plan and "CartesianProduct" not in plan


@pytest.mark.parametrize("by", [[], ["k"], ["k", "u"]])
def test_numbers_are_dense(spark, by):
    r = random.Random(4)
    data = [(r.choice(("hot", "hot", "hot", "x", None)), r.randrange(3), r.randrange(50), k) for k in range(500)]
    df = spark.createDataFrame(data, "k string, u int, o int, id int").repartition(7)
    got = ordering.numbered(df, "n", by, ["o", "id"]).collect()
    want = {}
    place = {"k": 0, "u": 1}
    for row in sorted(data, key=lambda x: x[2:]):
        key = tuple(row[place[b]] for b in by)
        want.setdefault(key, []).append(row[3])
    found = {}
    for x in sorted(got, key=lambda x: x.n):
        found.setdefault(tuple(x[b] for b in by), []).append((x.n, x.id))
    assert {k: [*enumerate(v, 1)] for k, v in want.items()} == found
    assert ordering.numbered(df.where("id < 0"), "n", by, ["o"]).count() == 0


def facts(spark, n, run="r"):
    return spark.range(n).select(
        F.concat(F.lit(f"{run}:"), "id").alias("evidence_id"), F.lit("a").alias("artifact_id"), F.lit("p#x").alias("locator"), F.lit("1").alias("raw_value"), F.lit("1").alias("normalized_value"),
        F.lit("e").alias("extractor_name"), F.lit("1").alias("extractor_version"), F.lit(run).alias("run_id"), F.lit("1").alias("schema_version"),
    )


def test_ledger_layout(spark, tmp_path):
    """Keys become partition filters and, if they are few, values that files are asked for; the rows are those of a full scan."""
    ledger = tables.Ledger(spark, str(tmp_path / "ledger"), buckets=8)
    assert ledger.append({"EvidenceFact": facts(spark, 300)}) == 300 and ledger.append({"EvidenceFact": facts(spark, 310, "r")}) == 10
    assert ledger.append({"EvidenceFact": facts(spark, 50, "s")}) == 50
    plan = lambda df: df._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    ids = spark.createDataFrame([("r:7",), ("none",), (None,), ("r:7",)], "evidence_id string")
    got = ledger.get("EvidenceFact", ids)
    assert [r.evidence_id for r in got.collect()] == ["r:7"]
    text = plan(got)
    assert "PartitionFilters" in text and "bucket" in text.split("PartitionFilters")[1].split("PushedFilters")[0] and "In(record_id" in text
    many = ledger.get("EvidenceFact", spark.range(40).select(F.concat(F.lit("r:"), "id").alias("evidence_id")))
    assert many.count() == 40 and "bucket" in plan(many).split("PartitionFilters")[1].split("PushedFilters")[0]
    assert ledger.of_run("EvidenceFact", "s").count() == 50 and "EqualTo(run_id,s)" in plan(ledger.of_run("EvidenceFact", "s"))
    assert ledger.read("EvidenceFact").count() == 360 and tables.Ledger(spark, ledger.path, buckets=99).buckets == 8
    with pytest.raises(KeyError):
        ledger.get("Nothing", ids)


CAPTURE = "artifact_id string, capture_id string, source_locator string, text string, content_hash string, media_type string, retrieval_status string"
TREE = "path string, entry_type string, mode string, object_sha string, size long"


def small_signal(spark, revisions=("1", "2")):
    row = lambda side, k, text: (f"{side}{k}", side, f"d/{k}.md", text, None if text is None else f"h{hash(text)}", "text/markdown", "missing" if text is None else "captured")
    was = spark.createDataFrame([row("p", 1, "one\n\ntwo"), row("p", 2, "same"), row("p", 3, None)], CAPTURE)
    now = spark.createDataFrame([row("c", 1, "one\n\nthree"), row("c", 2, "same"), row("c", 3, "new")], CAPTURE)
    tree = lambda c: c.select(F.col("source_locator").alias("path"), F.lit("blob").alias("entry_type"), F.lit("100644").alias("mode"), F.col("content_hash").alias("object_sha"), F.lit(1).cast("long").alias("size"))
    touches = spark.createDataFrame([("d/1.md", 2)], "path string, commit_ordinal int")
    return (was, now), pipelines.change_signal(was, now, (tree(was), tree(now)), touches, "run", revisions)


def test_records_of_a_change_signal(spark):
    captures, signal = small_signal(spark)
    runs, reads, outputs = (tables.written(x) for x in pipelines.signal_records(captures, signal, "run", "1"))
    assert runs.count() == 9 and envelopes.chain_faults(runs, reads, outputs).count() == 0
    altered = outputs.withColumn("outputs_hash", F.when(F.col("run_id") == "run:tree_diff", F.lit("x")).otherwise(F.col("outputs_hash")))
    got = {r.run_id: (r.fault, r.first_stage, r.first_fault) for r in envelopes.chain_faults(runs, reads, altered).collect()}
    below = (None, "tree_diff", "other outputs")
    assert got == {"run:tree_diff": ("other outputs", "tree_diff", "other outputs"), "run:plan": below, "run:segment": below, "run:reduce": below}
    unsigned = runs.withColumn("outputs_hash", F.when(F.col("run_id") == "run:extraction:current", F.lit("y")).otherwise(F.col("outputs_hash")))
    got = {r.run_id: r.fault for r in envelopes.chain_faults(unsigned, reads, unsigned.select("run_id", "outputs_hash")).collect()}
    assert got == {"run:change": "other inputs", "run:reduce": "other inputs"}
    lost = envelopes.chain_faults(runs.where("run_id <> 'run:capture:previous'"), reads, outputs).collect()
    assert {r.fault for r in lost if r.run_id == "run:tree_diff"} == {"unknown input"} and len(lost) == 6


def test_revisions_are_part_of_identities(spark):
    ids = [r.git_path_delta_id for rev in (("1", "2"), ("2", "3")) for r in small_signal(spark, rev)[1].path_deltas.collect()]
    assert len(set(ids)) == len(ids)
    ids = [r.artifact_delta_id for rev in (("1", "2"), ("2", "3")) for r in small_signal(spark, rev)[1].artifact_deltas.collect()]
    assert len(set(ids)) == len(ids)


def test_guards_run_before_a_comparison(spark):
    pairs = spark.createDataFrame([(1, "s", "s", 1, 2, 1, 2, "a", "b")], "pair_id int, previous_source_id string, current_source_id string, previous_observed_at int, current_observed_at int, previous_captured_at int, current_captured_at int, previous_run_id string, current_run_id string")
    said = spark.createDataFrame([], "run_id string, assertion_id string, artifact_id string, locator string, statement string, extractor_name string, extractor_version string")
    found = facts(spark, 3, "a")
    diagnostics = spark.createDataFrame([("b", "x", "p", "e", "1", "ValueError", "m")], "run_id string, artifact_id string, source_locator string, extractor_name string, extractor_version string, error_type string, error_message string")
    outputs = {"facts": found, "assertions": said, "diagnostics": diagnostics}
    none = diagnostics.where("false")
    digest = {r.run_id: r.outputs_hash for r in comparison.outputs_digest(outputs).collect()}
    runs = lambda **more: spark.createDataFrame([(r, "extraction", "t", (digest | more)[r], "1", "1", "p") for r in ("a", "b")], "run_id string, run_type string, finished_at string, outputs_hash string, code_version string, contract_schema_version string, policy_version string")
    artifacts = spark.createDataFrame([("a", "c", "captured")], "artifact_id string, capture_id string, retrieval_status string")
    evidence = found.withColumn("capture_id", F.lit("c"))
    check = lambda pairs=pairs, runs=runs(), outputs=outputs, evidence=evidence, **kw: pipelines.require_comparable(pairs, runs, outputs, evidence, artifacts, **kw)
    check()
    for message, broken in {
        "can't be compared": {"pairs": pairs.withColumn("current_observed_at", F.lit(None).cast("int"))}, "aren't strict": {"strict_policy": "p"}, "outside its capture": {"evidence": evidence.withColumn("artifact_id", F.lit("q"))},
        "don't give": {"outputs": outputs | {"facts": facts(spark, 2, "a")}}, "runs that can't": {"pairs": pairs.withColumn("previous_run_id", F.lit("z"))},
    }.items():
        with pytest.raises(guards.GuardError, match=message):
            check(**broken)
    # a run that rightly has no outputs
    check(outputs=outputs | {"diagnostics": none}, runs=runs(b=comparison.EMPTY))


def test_summaries_of_all_intervals(spark):
    s = spark.createDataFrame([(1, "p"), (2, "p"), (2, "p"), (2, "q")], "i int, g string")
    got = comparison.generation_faults(s, ["i"], ["g"], spark.range(1, 4).select(F.col("id").cast("int").alias("i"))).collect()
    assert sorted(map(tuple, got), key=str) == [(2, "p", 2), (3, None, 0)]


def test_order_of_assertions(spark):
    rows = [("c", "a/b", f"a/b:L{n}-L{n}", f"s{n}") for n in (2, 10, 1)] + [("c", "a/b", "a/b#x", "t"), ("c", "a/a", "a/a:L1-L3", "u"), ("c", "a/a", "a/a:L1-L2", "v")]
    df = spark.createDataFrame(rows, "capture_id string, source_locator string, locator string, statement string").withColumn("extractor_name", F.lit("e"))
    got = [r.locator for r in extract.numbered_assertions(df, "r").orderBy("assertion_index").collect()]
    assert got == ["a/a:L1-L2", "a/a:L1-L3", "a/b:L1-L1", "a/b:L2-L2", "a/b:L10-L10", "a/b#x"]
