"""Near-duplicate and substring dedup against brute force, with nulls, empties, long texts, ties, repeated rows and extra columns."""

import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sedimark.llm import common, itq_dedup, simhash_trie, substring_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component_id string, piece int, fp string"
EMPTY = [(None, None), (None, "a b"), (1, None), (2, ""), (3, " \n\t")]


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([(i, t, "en", "s", 1, "x", 1, "y") for i, t in rows], schema)


def components(ids, links):
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


def test_connected_components(spark):
    r = random.Random(1)
    links = [(r.randint(0, 400), r.randint(0, 400)) for _ in range(260)] + [(k, k + 1) for k in range(1000, 1100)] + [(5000, k) for k in range(5001, 5400)] + [(7, 7)]
    got = {x.node: x.component for x in common.connected_components(spark.createDataFrame(links, "x long, y long"), "x", "y").collect()}
    want = components({i for e in links for i in e if e[0] != e[1]}, [e for e in links if e[0] != e[1]])
    assert got == want
    assert common.connected_components(spark.createDataFrame([], "x long, y long"), "x", "y").count() == 0


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def near_texts():
    r = random.Random(2)
    words = [f"w{k}" for k in range(300)]
    out = list(EMPTY)
    for k in range(40):
        base = [r.choice(words) for _ in range(r.choice((1, 3, 5, 60, 300)))]
        for _ in range(r.randint(1, 4)):
            copy = list(base)
            if len(copy) > 50:
                copy[r.randrange(len(copy))] = "changed"
            out.append((r.randint(10, 500), " ".join(copy)))
    long = " ".join(r.choice(words) for _ in range(90_000))
    return [*out, (900, long), (901, long + " end"), (20, "A\x0bb c d e"), (21, "a b c D E"), out[10], out[10]]


def test_simhash_groups(spark):
    rows = near_texts()
    got = simhash_trie.near_groups(frame(spark, rows)).select("doc_id", "fingerprint", "component_id").collect()
    prints = [(i, plain_fingerprint(t)) for i, t in rows]
    assert sorted(((x.doc_id, x.fingerprint) for x in got), key=str) == sorted(((i, f"{p:016x}") for i, p in prints), key=str)
    want = least_of_groups([(i, p) for i, p in prints if i is not None])
    assert all(x.component_id == (want[x.fingerprint] if x.doc_id is not None else None) for x in got)


def least_of_groups(known):
    """Of each fingerprint, the least id of its group; rows with one id are documents of their own."""
    label = components({p for _, p in known}, [(p, q) for _, p in known for _, q in known if (p ^ q).bit_count() <= 4])
    least = {}
    for i, p in known:
        least[label[p]] = min(least.get(label[p], i), i)
    return {f"{p:016x}": least[label[p]] for _, p in known}


def test_simhash_crowded_blocks(spark):
    """Fingerprints that share a block value are cut into pairs of nodes further down."""
    r = np.random.default_rng(3)
    base = r.integers(0, 1 << 63, 6, dtype=np.uint64)
    codes = np.unique(np.concatenate([b ^ (np.uint64(1) << r.integers(0, 64, (120, 2), dtype=np.uint64)).sum(1, dtype=np.uint64) for b in base])).view(np.int64)
    links = simhash_trie.link_fingerprints(spark.createDataFrame([(int(c),) for c in codes], "fp long"), 4, split_rows=20)
    got = components(set(codes.tolist()), [(x.u, x.v) for x in links.collect()])
    near = [(a, b) for a in codes.tolist() for b in codes.tolist() if ((a ^ b) & (2**64 - 1)).bit_count() <= 4]
    assert got == components(set(codes.tolist()), near)


def test_simhash_keeps_one(spark):
    rows = near_texts()
    kept = simhash_trie.one_of_each_group(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns
    ids = [x.doc_id for x in kept.collect()]
    known = [(i, plain_fingerprint(t)) for i, t in rows if i is not None]
    label = components({p for _, p in known}, [(p, q) for _, p in known for _, q in known if (p ^ q).bit_count() <= 4])
    least = {}
    for i, p in known:
        least[label[p]] = min(least.get(label[p], i), i)
    assert sorted(i for i in ids if i is not None) == sorted(least.values())
    assert ids.count(None) == 2


def test_simhash_keeps_other_texts_of_an_id(spark):
    """A repeated id with another text stays, of equal rows one stays; columns of any type and name are carried."""
    r = random.Random(8)
    a, b = (" ".join(r.choice(["red", "green", "blue", "owl", "fox", "hen"]) + str(r.randint(0, 99)) for _ in range(80)) for _ in range(2))
    rows = [(1, a, {"k": 1}, "x"), (1, b, {"k": 2}, "y"), (1, a, {"k": 1}, "x"), (2, a, None, "z"), (3, b, {"k": 3}, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, of map<string, int>, `key` string")
    got = sorted((x.doc_id, x.text, str(x.of), x["key"]) for x in simhash_trie.one_of_each_group(docs).collect())
    assert got == sorted([(1, a, str({"k": 1}), "x"), (1, b, str({"k": 2}), "y")])


def test_simhash_many_blocks():
    """More blocks put more bits in front; every pair within the budget still shares one unit at least."""
    r = np.random.default_rng(5)
    for n_blocks in (5, 6, 7):
        tries = simhash_trie.tries(4, n_blocks)
        x = r.integers(0, 1 << 63, 200, dtype=np.uint64)
        y = x.copy()
        for k in range(4):
            y ^= np.uint64(1) << r.integers(0, 64, 200, dtype=np.uint64)
        met = np.zeros(200, bool)
        for order, bits in tries:
            p, q = simhash_trie.permuted(x, order), simhash_trie.permuted(y, order)
            assert (np.bitwise_count(p ^ q) == np.bitwise_count(x ^ y)).all()
            met |= (p >> np.uint64(64 - bits)) == (q >> np.uint64(64 - bits))
        assert met.all()
    assert [simhash_trie.blocks_for(n, 4, 50_000) for n in (0, 10**6, 10**9, 10**12)] == [5, 5, 6, 7]


def test_hot_keys(spark, monkeypatch):
    """Joins and components with keys of more than a crowd of rows."""
    monkeypatch.setattr(common, "crowd_of", lambda rows, least=0: 5)
    rows = common.written(spark.createDataFrame([(k % 3 if k < 60 else k, k) for k in range(90)] + [(None, -1)], "k long, v long"))
    table = common.written(spark.createDataFrame([(k, -k) for k in range(0, 80)], "k long, w long"))
    got = sorted(common.spread_join(rows, table, ["k"]).collect(), key=str)
    assert got == sorted(rows.join(table, "k", "left").collect(), key=str) and len(got) == 91
    links = [(5000, k) for k in range(5001, 5060)] + [(4000 + k, 4001 + k) for k in range(30)] + [(5059, 4030)]
    got = {x.node: x.component for x in common.connected_components(spark.createDataFrame(links, "x long, y long"), "x", "y").collect()}
    assert got == components({i for e in links for i in e}, links)


def test_simhash_empty(spark):
    assert simhash_trie.near_groups(frame(spark, [])).count() == 0
    assert simhash_trie.one_of_each_group(frame(spark, [])).count() == 0


def brute_repeats(rows, window):
    first = {}
    for i, t in rows:
        w = (t or "").encode().split()
        for k in range(len(w) - window + 1) if i is not None else ():
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, t in rows:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for k in range(len(w) - window + 1) if i is not None else ():
            if first[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        out.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("window", [1, 5, 13, 30])
def test_substring_dedup(spark, window):
    r = random.Random(window)
    words = [f"w{k}" for k in range(30)]
    passages = [[r.choice(words) for _ in range(80)] for _ in range(4)]
    rows = [*EMPTY, (None, " ".join(passages[0])), (3, "w1 " * 40)]
    for _ in range(90):
        w = [r.choice(words) for _ in range(r.randint(1, 70))]
        if r.random() < 0.6:
            p, a = r.choice(passages), r.randint(0, 30)
            w[2:2] = p[a : a + r.randint(5, 50)]
        rows.append((r.randint(0, 70), r.choice((" ", "\n", "  ")).join(w)))
    rows += [rows[-1], (200, " ".join(passages[0] * 400))]
    got = substring_dedup.without_repeats(frame(spark, rows), window).collect()
    want = brute_repeats(rows, window)
    assert sorted((tuple(x) for x in got), key=str) == want
    assert sum(x[2] for x in want) > 0


def test_substring_dedup_empty_and_text(spark):
    assert substring_dedup.without_repeats(frame(spark, [])).count() == 0
    text = " ".join(f"a{k}" for k in range(20))
    got = {x.doc_id: x.kept_text for x in substring_dedup.without_repeats(frame(spark, [(1, text), (2, "x " + text + " y")]), with_text=True).collect()}
    assert got == {1: text, 2: "x y"}


VECTORS = "vec_id long, embedding array<float>, label int, n int, kin string"


def brute_vectors(rows):
    def unit(v):
        ok = v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
        return np.array(v, float) / np.sqrt((np.array(v, float) ** 2).sum()) if ok else None

    units = [unit(np.float32(v).tolist() if v is not None and None not in v else v) for _, v, *_ in rows]
    links, n = [], [0] * len(rows)
    for a in range(len(rows)):
        for b in range(len(rows)):
            if a != b and units[a] is not None and units[b] is not None and len(units[a]) == len(units[b]) and rows[a][2] is not None and rows[a][2] == rows[b][2]:
                if units[a] @ units[b] >= 0.93:
                    links.append((rows[a][0], rows[b][0]))
                    n[a] += 1
    return n, components({r[0] for r in rows}, links)


def test_itq_groups(spark):
    r = np.random.default_rng(4)
    rows = []
    for _ in range(60):
        base, label = r.standard_normal(32), int(r.integers(0, 3))
        for _ in range(int(r.integers(1, 12))):
            rows.append((len(rows), (base + 0.1 * r.standard_normal(32)).tolist(), label))
    copy = rows[5][1]
    rows += [(1000 + k, copy, rows[5][2]) for k in range(30)]
    odd = [None, [], [0.0] * 32, [float("nan")] + [1.0] * 31, [float("inf")] + [1.0] * 31, [None] + [1.0] * 31, [1.0, 2.0], [2.0, 4.0]]
    rows += [(2000 + k, v, 0) for k, v in enumerate(odd)] + [(3000, copy, None)]
    df = spark.createDataFrame([(i, v, lab, 1, "x") for i, v, lab in rows], VECTORS)
    got = {x.vec_id: x for x in itq_dedup.near_groups(df).collect()}
    n, component = brute_vectors(rows)
    assert len(got) == len(rows)
    found = sum(x.n_links for x in got.values())
    assert found <= sum(n) and found >= 0.9 * sum(n)
    assert all(got[i].n_links == k and got[i].component_id == component[i] and got[i].kept == (component[i] == i) for (i, *_), k in zip(rows, n))


def test_itq_repeated_ids_and_large_numbers(spark):
    """Rows with one id are vectors of their own; squares of components may exceed a double."""
    r = np.random.default_rng(9)
    a, b = r.standard_normal(32), r.standard_normal(32)
    near = (a + 0.01 * r.standard_normal(32)).tolist()
    rows = [(1, a.tolist()), (1, b.tolist()), (2, (a * 1.01 + 0.001).tolist()), (3, near), (3, near), (4, (1e200 * r.standard_normal(32)).tolist()), (5, [2.0, 1.0]), (6, [2.0, 1.1])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, label int")
    got = sorted((x.vec_id, x.n_links, x.component_id, x.kept) for x in itq_dedup.near_groups(df).collect())
    assert got == sorted([(1, 3, 1, True), (1, 0, 1, True), (2, 3, 1, False), (3, 3, 1, False), (3, 3, 1, False), (4, 0, 4, True), (5, 1, 5, True), (6, 1, 5, False)])


def test_itq_crowded_places_and_blocks(spark):
    r = np.random.default_rng(5)
    base = r.standard_normal(64)
    rows = [(k, (base + 0.15 * r.standard_normal(64)).tolist(), 1) for k in range(300)]
    df = spark.createDataFrame([(i, v, lab, 1, "x") for i, v, lab in rows], VECTORS)
    coded = itq_dedup.usable(df)
    assert coded.count() == 300
    got = itq_dedup.near_groups(df, block=8).agg(F.sum("n_links"), F.max("component_id")).first()
    n, _ = brute_vectors(rows)
    assert got[0] >= 0.9 * sum(n)
    codes = spark.createDataFrame([("k", int(c)) for c in np.unique(r.integers(0, 1 << 20, 500))], "kin string, code long")
    few, many = (sorted((x.a, x.b) for x in itq_dedup.candidates(codes, 6, crowd).collect()) for crowd in (10, 100_000))
    plain = sorted(code.code for code in codes.collect())
    assert few == many == sorted((a, b) for a in plain for b in plain if a < b and (a ^ b).bit_count() <= 6)


def test_itq_empty(spark):
    assert itq_dedup.near_groups(spark.createDataFrame([], VECTORS)).count() == 0
