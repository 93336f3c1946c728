"""SimHash near-dedup by a binary trie self-join.

Fingerprints: every word shingle's XXH64 votes on 64 bits. Distinct fingerprints are linked at `budget` or fewer
differing bits. The bits are cut into more blocks than the budget; two linked fingerprints agree on all blocks but `budget` at
least, so each fingerprint goes into one trie for every choice of so many blocks, which stand in front there. With five blocks
that is five tries of 12 bits in front, with six 15 tries of 21 bits, and so on: the number of blocks follows the number
of fingerprints, so that the nodes below the front stay small. Such a node is one unit of work; one that holds more than `split_rows` fingerprints all
the same is cut into child nodes further down, which meet where they differ by the budget at most, so no task gets an unbounded group. In a unit the
trie is joined with itself: pairs of nodes descend together, differing bits add up, and a pair beyond the budget is dropped
with all below it. A task emits the links as a spanning forest, never all pairs of a group, and connected components join the forests.

Defined results: null text counts as empty; no word gives fingerprint zero, which links like any other; rows with a
null doc_id are fingerprinted but take no part in groups (component_id null); rows that repeat a doc_id are documents of their own, so
unlike texts under one id stay in groups of their own; an empty table gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U, connected_components, forest, shuffle_width, slices, small_batches, spread_join, tidy, unused, written

BITS = 64
_OF_BYTE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def fingerprint(text: bytes, shingle: int = 4, seed: int = 42, chunk: int = 65_536) -> int:
    """The SimHash of one text; a very long one in chunks of shingles."""
    words = text.lower().split()  # for bytes: A-Z only, and exactly the contract's separators
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, seed)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts, ends = [0, *(gaps[: len(words) - shingle] + 1).tolist()], [*gaps[shingle - 1 :].tolist(), len(joined)]
    ones, digest, n = np.zeros(BITS, np.int64), xxhash.xxh64_digest, len(starts)
    column = np.arange(0, 8 * 256, 256)
    for at in range(0, n, chunk):
        votes = np.frombuffer(b"".join([digest(joined[s:e], seed) for s, e in zip(starts[at : at + chunk], ends[at : at + chunk])]), np.uint8)
        seen = np.bincount((votes.reshape(-1, 8) + column).ravel(), minlength=8 * 256).reshape(8, 256)
        ones += (seen @ _OF_BYTE).ravel()
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def text_key():
    """A hash that tells apart the texts of rows with one doc_id."""
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text_key")


def fingerprints(docs: DataFrame, shingle: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, text_key, fp): fp is the fingerprint as a signed long."""

    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                found = [fingerprint((t or "").encode(), shingle, seed) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_key"), pa.array(np.array(found, U).view(np.int64))], names=["doc_id", "text_key", "fp"])

    return docs.select(F.col("doc_id").cast("long"), text_key(), F.col("text").cast("string")).mapInArrow(tidy(run), "doc_id long, text_key long, fp long")


Block = tuple[int, int]  # first bit and width


def tries(budget: int, n_blocks: int) -> list[tuple[list[Block], int]]:
    """The order of blocks in each trie, and the number of bits that two fingerprints in one unit have in common."""
    edges = [BITS * k // n_blocks for k in range(n_blocks + 1)]
    cut = [(a, b - a) for a, b in zip(edges, edges[1:])]
    out = []
    for front in combinations(range(n_blocks), n_blocks - budget):
        order = [*front, *(k for k in range(n_blocks) if k not in front)]
        out.append(([cut[k] for k in order], sum(cut[k][1] for k in front)))
    return out


def blocks_for(n: int, budget: int, split_rows: int) -> int:
    """The least number of blocks with which n fingerprints, evenly spread, leave at most split_rows in a unit."""
    n_blocks = budget + 1
    while n >> min(bits for _, bits in tries(budget, n_blocks)) > split_rows and n_blocks < budget + 4:
        n_blocks += 1
    return n_blocks


def permuted(x: np.ndarray, order: list[Block]) -> np.ndarray:
    """The bits of x with its blocks in that order."""
    out, at = np.zeros_like(x), 0
    for start, width in order:
        out |= ((x >> U(BITS - start - width)) & U((1 << width) - 1)) << U(BITS - at - width)
        at += width
    return out


def _permuted_column(order: list[Block]):
    parts, at = [], 0
    for start, width in order:
        parts.append(f"shiftleft(shiftrightunsigned(fp, {BITS - start - width}) & {(1 << width) - 1}L, {BITS - at - width})")
        at += width
    return F.expr(" | ".join(parts))


def join_tries(codes: np.ndarray, pairs: tuple[np.ndarray, ...], depth: int, budget: int, most: int = 400_000) -> tuple[np.ndarray, np.ndarray]:
    """Indices of codes linked below the given pairs of trie nodes.

    codes: sorted within every node. pairs: first and last index of the left node, of the right one, differing bits so
    far; both nodes of a pair stand at `depth`. The frontier is processed depth first in pieces of about `most` node
    pairs, so memory is bounded whatever the number of links; the links are reduced to a forest as they come.
    """
    out_u: list[np.ndarray] = []
    out_v: list[np.ndarray] = []
    kept = 0

    def found(i, j):
        nonlocal kept, out_u, out_v
        out_u.append(i)
        out_v.append(j)
        kept += len(i)
        if kept > 2_000_000:
            u, v = forest(np.concatenate(out_u), np.concatenate(out_v))
            out_u, out_v, kept = [u], [v], len(u) // 2

    stack = [(depth, *(np.asarray(p, np.int64) for p in pairs))]
    while stack:
        t, a0, a1, b0, b1, d = stack.pop()
        if len(d) > most:
            half = len(d) // 2
            stack += [(t, a0[:half], a1[:half], b0[:half], b1[:half], d[:half]), (t, a0[half:], a1[half:], b0[half:], b1[half:], d[half:])]
            continue
        # nodes of few leaves: compare the leaves
        sizes = (a1 - a0) * (b1 - b0)
        few = (sizes <= 16) | (t >= BITS)
        if few.any():
            wide, which = (b1 - b0)[few], np.repeat(np.flatnonzero(few), sizes[few])
            k = np.arange(len(which)) - np.repeat(np.cumsum(sizes[few]) - sizes[few], sizes[few])
            wide = np.repeat(wide, sizes[few])
            i, j = a0[which] + k // wide, b0[which] + k % wide
            near = (i < j) & (np.bitwise_count(codes[i] ^ codes[j]) <= budget)
            if near.any():
                found(i[near], j[near])
            a0, a1, b0, b1, d = (x[~few] for x in (a0, a1, b0, b1, d))
        if not len(d):
            continue
        # children by the next bit
        bit = U(BITS - 1 - t)
        ones = np.concatenate([[0], np.cumsum((codes >> bit) & U(1), dtype=np.int64)])
        am, bm = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])
        own = (a0 == b0) & (a1 == b1)
        nxt = []
        for x0, x1, y0, y1, more, ok in (
            (a0, am, b0, bm, 0, True), (am, a1, bm, b1, 0, True), (a0, am, bm, b1, 1, True), (am, a1, b0, bm, 1, ~own),
        ):
            keep = (x1 > x0) & (y1 > y0) & (d + more <= budget) & ok
            nxt.append((x0[keep], x1[keep], y0[keep], y1[keep], d[keep] + more))
        stack.append((t + 1, *(np.concatenate(x) for x in zip(*nxt))))
    if not out_u:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return forest(np.concatenate(out_u), np.concatenate(out_v))


def _join_units(budget: int, n_blocks: int):
    """Joins the units of a partition: rows (trie, left node, right node, depth, code), in any order."""
    order_of = [order for order, _ in tries(budget, n_blocks)]

    def run(batches):
        held = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if held is None or not held.num_rows:
            return
        trie, left, right, depth = (held.column(k).combine_chunks().to_numpy() for k in range(4))
        fp = held.column(4).combine_chunks().to_numpy().view(U)
        for r in np.unique(trie):
            for t in np.unique(depth[trie == r]):
                at = np.flatnonzero((trie == r) & (depth == t))
                code = permuted(fp[at], order_of[r])
                order = np.lexsort((code, right[at], left[at]))
                at, code = at[order], code[order]
                node = code >> U(BITS - t)
                new = np.flatnonzero(np.r_[True, (left[at][1:] != left[at][:-1]) | (right[at][1:] != right[at][:-1])])
                end = np.r_[new[1:], len(at)]
                # a unit's left node is the lesser and comes first; a node that is both is joined with itself
                mid = new + np.add.reduceat((node == left[at].astype(U)).astype(np.int64), new)
                same = left[at][new] == right[at][new]
                b0, a1 = np.where(same, new, mid), np.where(same, end, mid)
                ok = (a1 > new) & (end > b0)
                d = np.bitwise_count(left[at][new].astype(U) ^ right[at][new].astype(U)).astype(np.int64)
                # pieces of units that together hold a bounded number of codes keep the per-level work small
                ok = np.flatnonzero(ok)
                cut = np.searchsorted(np.cumsum((end - new)[ok]), np.arange(200_000, (end - new)[ok].sum() + 200_000, 200_000))
                for p in np.split(ok, np.unique(cut[cut < len(ok)])):
                    if len(p):
                        lo, hi = new[p[0]], end[p[-1]]
                        i, j = join_tries(code[lo:hi], (new[p] - lo, a1[p] - lo, b0[p] - lo, end[p] - lo, d[p]), int(t), budget)
                        if len(i):
                            raw = fp[at[lo:hi]].view(np.int64)
                            yield pa.RecordBatch.from_arrays([pa.array(raw[i]), pa.array(raw[j])], names=["u", "v"])

    return run


def _masks(budget: int, most: int = 24) -> list[tuple[int, int]]:
    """(more, mask): every mask of `more` bits with at most `budget` ones; some 65,000 rows."""
    out = []
    for more in range(most + 1):
        out += [(more, sum(1 << k for k in bits)) for ones in range(min(budget, more) + 1) for bits in combinations(range(more), ones)]
    return out


def link_fingerprints(fps: DataFrame, budget: int = 4, split_rows: int = 50_000) -> DataFrame:
    """(u, v): links between the distinct values of column fp, as forests whose union has the components of all links."""
    spark = fps.sparkSession
    n_blocks = blocks_for(fps.count(), budget, split_rows)
    rows = [F.struct(F.lit(r).alias("trie"), F.lit(bits).alias("bits"), _permuted_column(order).alias("code")) for r, (order, bits) in enumerate(tries(budget, n_blocks))]
    coded = fps.select("fp", F.explode(F.array(*rows)).alias("t")).select("fp", "t.*").withColumn("node", F.expr("shiftrightunsigned(code, 64 - bits)"))
    more = F.ceil(F.log2(F.col("count") / split_rows)).cast("int") + 1
    # nodes of more than split_rows are few: at most so many as their rows allow
    crowded = written(coded.groupBy("trie", "node").count().where(F.col("count") > split_rows).select("trie", "node", F.least(more, F.lit(24)).alias("more")))
    units = coded.withColumn("depth", F.col("bits")).withColumn("left", F.col("node")).withColumn("right", F.col("node"))
    if crowded.limit(1).count():
        masks = F.broadcast(spark.createDataFrame(_masks(budget, crowded.agg(F.max("more")).first()[0]), "more int, mask long"))
        units = (
            coded.join(crowded, ["trie", "node"], "left").withColumn("more", F.coalesce("more", F.lit(0)))
            .withColumn("depth", F.expr("bits + more")).withColumn("own", F.expr("shiftrightunsigned(code, 64 - depth)"))
            # a child node meets itself and every other child of its block within the budget; the lesser node stands left
            .join(masks, "more").withColumn("other", F.col("own").bitwiseXOR(F.col("mask"))).withColumn("left", F.least("own", "other")).withColumn("right", F.greatest("own", "other"))
        )
    return units.select("trie", "left", "right", "depth", "fp").repartition(shuffle_width(spark), "trie", "left", "right").mapInArrow(tidy(_join_units(budget, n_blocks)), "u long, v long")


def grouped(docs: DataFrame, shingle: int = 4, seed: int = 42, budget: int = 4) -> DataFrame:
    """(doc_id, text_key, fp, label, component_id) of every row: label stands for the group of fingerprints, component_id is its least doc_id."""
    prints = written(fingerprints(docs, shingle, seed))
    with_id = prints.where("doc_id is not null")
    first = written(with_id.groupBy("fp").agg(F.min("doc_id").alias("first")))
    component = connected_components(link_fingerprints(first.select("fp"), budget), "u", "v")
    named = written(first.join(component.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("label")))
    least = written(named.groupBy("label").agg(F.min("first").alias("component_id")))
    of = written(spread_join(named.select("fp", "label"), least, ["label"]))
    known = spread_join(with_id, of, ["fp"]).select("doc_id", "text_key", "fp", "label", "component_id")
    return known.unionByName(prints.where("doc_id is null").withColumn("label", F.lit(None).cast("long")).withColumn("component_id", F.lit(None).cast("long")))


def near_groups(docs: DataFrame, shingle: int = 4, seed: int = 42, budget: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every document."""
    return grouped(docs, shingle, seed, budget).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each_group(docs: DataFrame, **options) -> DataFrame:
    """The documents of which each group of near copies keeps one: that of the least doc_id (of several texts under it, the one of least hash;
    of equal rows and of rows that differ in other columns only, one).

    Rows with a null doc_id stay. Columns are those of docs, of any type and name.
    """
    names = docs.columns
    small_batches(docs.sparkSession)
    found = grouped(docs, **options).where("doc_id = component_id").groupBy("label", "doc_id", "text_key").agg(F.count("*").alias("n"))
    lead = written(found.groupBy("label", "doc_id").agg(F.min(F.struct("text_key", "n")).alias("m")).select("doc_id", "m.*"))
    of, key, n, row = unused(names, "of", "key", "n", "row")
    keyed = docs.where("doc_id is not null").withColumn(key, F.struct(F.col("doc_id").cast("long").alias("doc_id"), text_key()))
    met = keyed.join(lead.select(F.struct("doc_id", "text_key").alias(of), F.col("n").alias(n)), F.col(key) == F.col(of))
    again = met.where(F.col(n) > 1).groupBy(key).agg(F.min_by(F.struct(*(F.col(c).alias(f"c{k}") for k, c in enumerate(names))), F.to_json(F.struct(*names))).alias(row))
    return met.where(F.col(n) == 1).select(*names).unionByName(docs.where("doc_id is null")).unionByName(again.select(*(F.col(f"{row}.c{k}").alias(c) for k, c in enumerate(names))))
