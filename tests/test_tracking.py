"""Assignments decided as a whole and as they arrive, and fragments among all statements."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sedimark.operators import governance, reasoning
from sedimark.streaming import tracking

REQUESTS = "seq long, source_id string, level string, assigned_by string, reason string, effective_at long, recorded_at long"


def requests(seed, n):
    r = random.Random(seed)
    rows = []
    for k in range(n):
        at = r.randrange(max(1, k - 3), k + 4) if r.random() < 0.8 else None
        recorded = r.randrange(max(1, k - 3), k + 4) if at is None or r.random() < 0.2 else at
        rows.append((k, r.choice(("hot", "hot", "s", "t", "none")), r.choice("012"), r.choice(("a", "a", " a ", "")), r.choice(("x", "x", "y", None)), at, recorded))
    return rows


def fold(rows, seen):
    """The rule, one request after the other."""
    history, out = defaultdict(list), {}
    for seq, source, level, by, reason, effective, recorded in sorted(rows):
        by, reason, effective = (by or "").strip(), (reason or "").strip(), recorded if effective is None else effective
        past = history[source]
        same = [h for h in past if h[0] == effective]
        if source not in seen:
            out[seq] = "unknown source"
        elif not by or not reason:
            out[seq] = "empty field"
        elif same:
            out[seq] = "replayed" if same[0][1:] == (level, by, reason) else "occupied"
        elif effective != recorded:
            out[seq] = "not immediate"
        elif effective < seen[source]:
            out[seq] = "before the source"
        elif past and recorded < past[-1][0]:
            out[seq] = "clock moved back"
        else:
            past.append((effective, level, by, reason))
            out[seq] = "recorded"
    return out


SEEN = {"hot": 3, "s": 0, "t": 20}


@pytest.mark.parametrize("crowd", [10, 10**6])
def test_assignments_as_a_whole(spark, crowd):
    rows = requests(1, 300)
    sources = spark.createDataFrame([*SEEN.items()], "source_id string, first_seen_at long")
    got = {x.seq: x.state for x in governance.assigned(spark.createDataFrame(rows, REQUESTS).repartition(3), sources, crowd).collect()}
    assert got == fold(rows, SEEN) and len({*got.values()}) == 8


def test_assignments_as_they_arrive(spark, tmp_path):
    """Three batches, the second of which comes again: states are those of the rule, replays are replays, and captures see what was in effect."""
    rows = requests(2, 90)
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        whole, numbered = [], []
        for batch in (rows[:40], rows[40:70], rows[40:70], rows[70:]):
            here = [(len(numbered) + k, *x[1:]) for k, x in enumerate(batch)]
            numbered += here
            arrive = [(s, src, "assign", lv, by, why, e, rec, SEEN.get(src), None) for s, src, lv, by, why, e, rec in here]
            top = max(x[6] for x in here)
            arrive.append((1000 + len(whole), "hot", "capture", None, None, None, None, top + 100, 3, 2))
            whole.append(top)
            # one file a batch
            spark.createDataFrame(arrive, tracking.ARRIVALS).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
            stream = spark.readStream.schema(tracking.ARRIVALS).json(str(tmp_path / "in"))
            query = tracking.decided(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).outputMode("append").trigger(availableNow=True).start()
            assert query.awaitTermination(120)
        got = spark.read.parquet(str(tmp_path / "out")).collect()
    finally:
        spark.conf.set(key, before)
    assigned = {x.seq: x.state for x in got if x.kind == "assign"}
    assert assigned == fold(numbered, SEEN)
    # the repeated batch records nothing new
    assert "recorded" not in {assigned[k] for k in range(70, 100)}
    levels = []
    for upto in (40, 70, 100, 120):
        states = fold(numbered[:upto], SEEN)
        levels.append([x[2] for x in numbered[:upto] if x[1] == "hot" and states[x[0]] == "recorded"][-1])
    captures = sorted((x for x in got if x.kind == "capture"), key=lambda x: x.seq)
    assert [x.level for x in captures] == levels and [x.state for x in captures] == ["allowed" if int(lv) >= 2 else "blocked" for lv in levels]


@pytest.mark.parametrize("chunk", [70, 1 << 20])
def test_fragments_among_all_statements(spark, chunk):
    r = random.Random(5)
    word = lambda: r.choice(("a", "b", "ab", "c", "ca", "x"))
    texts = [" ".join(word() for _ in range(r.randint(0, 14))) for _ in range(60)] + [None, "Common  words HERE"] * 3
    need = [" ".join(word() for _ in range(r.randint(1, 9))) for _ in range(120)] + ["", "ommon words her", "zz", None, "a b zz a b c a"]
    need += [" ".join(t.split()[1:9])[1:] for t in texts if t and len(t.split()) > 9]
    df = spark.createDataFrame([(k, f) for k, f in enumerate(need)], "requirement_id int, fragment string")
    got = {x.requirement_id: x.covered for x in reasoning.fragment_hits_anywhere(df, spark.createDataFrame([(t,) for t in texts], "statement string"), automaton_bytes=chunk).collect()}
    fold_ = lambda t: " ".join(t.lower().split())
    assert got == {k: f is not None and any(t is not None and fold_(f) in fold_(t) for t in texts) for k, f in enumerate(need)}
    plan = reasoning.fragment_hits_anywhere(df, spark.createDataFrame([(t,) for t in texts], "statement string"))._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert df.select(F.count("*")).first()[0] == len(need)
