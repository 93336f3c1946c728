"""Embedding near-dedup by iterative quantisation.

A rotation that balances the bits of binary codes is learned on at most `sample_rows` vectors (those of least id hash); all vectors
are coded with it. Codes are retrieved through multi-index Hamming tables: a code of 64 bits is cut into 4
blocks, and under each block's value and its 16 one-bit neighbours the code is filed, so two codes meet wherever a
block differs in two bits at most, which covers every pair within 11 bits. A pair is taken only where its first shared place is, so none comes twice. Pairs within
`radius` bits are reranked by cosine of the original vectors in double precision, block by block of vectors of a code.

Equal vectors are one class throughout: a class has a number of its own and stands for its copies in counts, so copies are never expanded
into pairs. Codes of more than a crowd of classes are cut into blocks; a table place with more than `crowd` codes (told from counts of block values,
not of filed codes) is cut into parts that meet pairwise. Recall against brute force is measured in the tests; on the tables at hand it is 1.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and those with a null label, link with nothing
(n_links 0, component_id their own vec_id); vectors of unequal length don't link; rows that repeat a vec_id are vectors of their own, each with its
own links and component; a null vec_id takes no part; an empty table gives no rows. Only vec_id, label and embedding are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CROWD, HOT_KEYS, U, connected_components, crowd_of, forest, least_ids, shuffle_width, spread_join, written

BITS, TABLES = 64, 4
BLOCK = BITS // TABLES


def _random_rotation(dim: int, bits: int) -> np.ndarray:
    q, _ = np.linalg.qr(np.random.default_rng(dim).standard_normal((dim, max(dim, bits))))
    return q[:, :bits] if q.shape[1] >= bits else np.random.default_rng(dim).standard_normal((dim, bits))


def learn_rotation(x: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Projection (dimensions by bits): principal directions, rotated to bring projections near their signs.

    Vectors are unit vectors and aren't centred: planes through the origin keep near vectors on one side even where a single dense group
    makes up the sample.
    """
    dim, bits = x.shape[1], min(BITS, x.shape[1])
    if len(x) < 2 * bits:
        return _random_rotation(dim, bits)
    _, axes = np.linalg.eigh(x.T @ x)
    axes = axes[:, ::-1][:, :bits]
    v = x @ axes
    r, _ = np.linalg.qr(np.random.default_rng(0).standard_normal((bits, bits)))
    for _ in range(rounds):
        left, _, right = np.linalg.svd(np.sign(v @ r).T @ v)
        r = (left @ right).T
    return axes @ r


def encode(x: np.ndarray, projection: np.ndarray) -> np.ndarray:
    """Codes; where the projection has fewer columns than bits, random planes give the rest, so that every block tells vectors apart."""
    missing = BITS - projection.shape[1]
    if missing:
        projection = np.concatenate([projection, np.random.default_rng(BITS).standard_normal((projection.shape[0], missing))], 1)
    # columns are dealt to blocks in turn, so that each block has its share of the learned ones
    projection = projection[:, np.arange(BITS).reshape(BLOCK, TABLES).T.ravel()]
    return np.packbits((x @ projection > 0).astype(np.uint8), axis=1).view(">u8").ravel().astype(U)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def scaled(x: np.ndarray) -> np.ndarray:
    """Vectors by a power of two each, which changes no cosine but keeps squares in range."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])


def _matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def sound():
    """Whether a row's vector may link."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    return F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(fine, F.lit(False))


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, kin, embedding, h): kin is label and length, equal for vectors that may link; h is a hash of the vector."""
    return vectors.where(sound()).select(
        F.col("vec_id").cast("long"), F.concat_ws(":", F.size("embedding"), "label").alias("kin"), F.col("embedding").cast("array<double>").alias("embedding")
    ).withColumn("h", F.xxhash64("embedding"))


def _coder(models: dict[int, np.ndarray]):
    """Adds each class's code and its number, which is of its partition and row; the table they are written to is what counts."""

    def run(batches):
        at_row = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
        for batch in batches:
            sizes = pc.list_value_length(batch.column("embedding")).to_numpy(zero_copy_only=False)
            codes = np.zeros(batch.num_rows, U)
            for dim in np.unique(sizes):
                at = np.flatnonzero(sizes == dim)
                projection = models[int(dim)] if int(dim) in models else _random_rotation(int(dim), min(BITS, int(dim)))
                codes[at] = encode(unit(_matrix(batch.column("embedding").take(pa.array(at)), int(dim))), projection)
            yield batch.append_column("code", pa.array(codes.view(np.int64))).append_column("cid", pa.array(np.arange(at_row, at_row + batch.num_rows)))
            at_row += batch.num_rows

    return run


def _flips() -> np.ndarray:
    return np.r_[U(0), U(1) << np.arange(BLOCK, dtype=U)]


def _places(batches):
    """The table places of each code: own block values and their neighbours."""
    flips = _flips()
    for batch in batches:
        code = batch.column("code").to_numpy().view(U)
        place = np.concatenate([((code >> U(BLOCK * t)) & U((1 << BLOCK) - 1))[:, None] ^ flips | U(t << BLOCK) for t in range(TABLES)], 1)
        again = pa.array(np.repeat(np.arange(len(code)), place.shape[1]))
        yield pa.RecordBatch.from_arrays(
            [batch.column("kin").take(again), pa.array(place.ravel().astype(np.int32)), batch.column("code").take(again)], names=["kin", "place", "code"]
        )


def _first_meeting(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The place, of all that two codes share, at which their pair is taken; -1 where they share none."""
    out = np.full(len(a), -1, np.int64)
    low = U((1 << BLOCK) - 1)
    for t in range(TABLES - 1, -1, -1):
        x, y = (a >> U(BLOCK * t)) & low, (b >> U(BLOCK * t)) & low
        diff = x ^ y
        n = np.bitwise_count(diff)
        one = diff & (~diff + U(1))  # its lowest bit
        at = np.where(n < 2, np.minimum(x, y), np.minimum(x ^ one, y ^ one))
        out = np.where(n <= 2, (at | U(t << BLOCK)).astype(np.int64), out)
    return out


def _meet(radius: int, most: int = 1 << 20):
    """Pairs of codes within the radius in the places of a partition: rows (kin, place, part, left, right, code, side)."""

    def run(batches):
        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        table = pa.Table.from_batches(rows).combine_chunks()
        kin = table.column("kin").combine_chunks().dictionary_encode()
        names, kin = kin.dictionary, kin.indices.to_numpy()
        place, left, right, part = (table.column(c).to_numpy() for c in ("place", "left", "right", "part"))
        code = table.column("code").to_numpy().view(U)
        order = np.lexsort((code, part != left, right, left, place, kin))
        kin, place, left, right, part, code = (x[order] for x in (kin, place, left, right, part, code))
        new = np.flatnonzero(np.r_[True, (kin[1:] != kin[:-1]) | (place[1:] != place[:-1]) | (left[1:] != left[:-1]) | (right[1:] != right[:-1])])
        end = np.r_[new[1:], len(code)]
        mid = np.where(left[new] == right[new], end, new + np.add.reduceat((part == left).astype(np.int64), new))
        own = left[new] == right[new]
        # each code with the codes of the other part, or with those after it in its own
        upto = np.repeat(np.where(own, end, mid), end - new)
        row = np.arange(len(code))
        first = np.where(np.repeat(own, end - new), row + 1, np.repeat(mid, end - new))
        n = np.where(row < upto, np.repeat(end, end - new) - first, 0)
        cuts = np.searchsorted(np.cumsum(n), np.arange(most, n.sum() + most, most))
        for lo, hi in zip(np.r_[0, cuts + 1], np.r_[cuts + 1, len(n)]):
            size = n[lo:hi]
            if not size.sum():
                continue
            i = np.repeat(np.arange(lo, lo + len(size)), size)
            j = np.repeat(first[lo:hi] - np.cumsum(size) + size, size) + np.arange(size.sum())
            ok = np.bitwise_count(code[i] ^ code[j]) <= radius
            i, j = i[ok], j[ok]
            ok = _first_meeting(code[i], code[j]) == place[i]
            i, j = i[ok], j[ok]
            if len(i):
                yield pa.RecordBatch.from_arrays(
                    [names.take(pa.array(kin[i])), *(pa.array(f(code[i].view(np.int64), code[j].view(np.int64))) for f in (np.minimum, np.maximum))], names=["kin", "a", "b"]
                )

    return run


def crowded_places(codes: DataFrame, crowd: int) -> DataFrame:
    """(kin, place, count) of the places with more than crowd codes: sums over a block value and its neighbours of the codes with that value."""
    values = F.array(*[F.expr(f"shiftrightunsigned(code, {BLOCK * t}) & {(1 << BLOCK) - 1}L").bitwiseOR(F.lit(t << BLOCK)) for t in range(TABLES)])
    held = codes.select("kin", F.explode(values).alias("value")).groupBy("kin", "value").agg(F.count("*").alias("n"))
    near = F.explode(F.array(*[F.col("value").bitwiseXOR(F.lit(int(f))) for f in _flips()])).alias("place")
    return held.select("kin", near, "n").groupBy("kin", F.col("place").cast("int").alias("place")).agg(F.sum("n").alias("count")).where(F.col("count") > crowd)


def candidates(codes: DataFrame, radius: int = 15, crowd: int = 4000) -> DataFrame:
    """(kin, a, b): distinct codes of a kin that share a table place and are within the radius."""
    spark = codes.sparkSession
    filed = codes.mapInArrow(_places, "kin string, place int, code long")
    # a code is filed at TABLES * (BLOCK + 1) places, so places of more than a crowd are few enough to be broadcast
    crowd = max(crowd, codes.count() * TABLES * (BLOCK + 1) // HOT_KEYS)
    crowded = written(crowded_places(codes, crowd).select("kin", "place", F.ceil(F.col("count") / crowd).cast("int").alias("parts")))
    parted = filed.withColumn("left", F.lit(0)).withColumn("right", F.lit(0)).withColumn("part", F.lit(0))
    if crowded.limit(1).count():
        parted = (
            filed.join(F.broadcast(crowded), ["kin", "place"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
            .withColumn("part", F.pmod(F.xxhash64("code"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
            .withColumn("left", F.least("part", "other")).withColumn("right", F.greatest("part", "other"))
        )
    dealt = parted.select("kin", "place", "left", "right", "part", "code").repartition(shuffle_width(spark), "kin", "place", "left", "right")
    return dealt.mapInArrow(_meet(radius), "kin string, a long, b long")


def _rerank(threshold: float):
    """Of block pairs: linked classes with what they add to counts, and links as a forest."""

    def run(batches):
        for batch in batches:
            ids, counts, other, vectors, ends = [], [], [], [], []
            for side in ("x", "y"):
                at = batch.schema.get_field_index
                i = batch.column(at(f"{side}_ids"))
                ids.append(i.flatten().to_numpy())
                counts.append(batch.column(at(f"{side}_n")).flatten().to_numpy())
                vectors.append(batch.column(at(f"{side}_v")).flatten().to_numpy().astype(np.float64))
                ends.append(np.r_[0, np.cumsum(pc.list_value_length(i).to_numpy())])
                other.append(np.r_[0, np.cumsum(pc.list_value_length(batch.column(at(f"{side}_v"))).to_numpy())])
            found: list[tuple[np.ndarray, ...]] = []
            for k in range(batch.num_rows):
                x, y = (slice(e[k], e[k + 1]) for e in ends)
                vx, vy = (v[o[k] : o[k + 1]].reshape(s.stop - s.start, -1) for v, o, s in zip(vectors, other, (x, y)))
                vx, vy = scaled(vx), scaled(vy)
                near = (vx @ vy.T) / np.sqrt((vx * vx).sum(1))[:, None] / np.sqrt((vy * vy).sum(1)) >= threshold
                i, j = np.nonzero(near)
                if len(i):
                    a, b = ids[0][x][i], ids[1][y][j]
                    keep = a < b if batch.column(batch.schema.get_field_index("own"))[k].as_py() else np.ones(len(a), bool)
                    found.append((a[keep], b[keep], counts[0][x][i][keep], counts[1][y][j][keep]))
            if not found:
                continue
            a, b, na, nb = (np.concatenate(c) for c in zip(*found))
            who, inverse = np.unique(np.r_[a, b], return_inverse=True)
            if not len(who):
                continue
            n = np.bincount(inverse, weights=np.r_[nb, na]).astype(np.int64)
            root = dict(zip(*(x.tolist() for x in forest(a, b))))
            yield pa.RecordBatch.from_arrays([pa.array(who), pa.array(n), pa.array([root.get(w, w) for w in who.tolist()], pa.int64())], names=["id", "n", "root"])

    return run


def models_of(vectors: DataFrame, sample_rows: int) -> dict[int, np.ndarray]:
    """A projection for each length of vectors in the sample: of the sample_rows ids of least hash, one vector each."""
    ids = F.broadcast(least_ids(vectors, sample_rows, "vec_id"))
    rows = usable(vectors.join(ids, "vec_id", "left_semi")).dropDuplicates(["vec_id"]).select("embedding").toArrow().column(0).combine_chunks()
    sizes = pc.list_value_length(rows).to_numpy(zero_copy_only=False)
    return {int(d): learn_rotation(unit(_matrix(rows.take(pa.array(np.flatnonzero(sizes == d))), int(d)))) for d in np.unique(sizes)}


def near_groups(vectors: DataFrame, threshold: float = 0.93, radius: int = 15, sample_rows: int = 20_000, block: int = 256) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every vector."""
    good = usable(vectors)
    copies = good.groupBy("kin", "h", "embedding").agg(F.min("vec_id").alias("id"), F.count("*").alias("n"))
    schema = "kin string, h long, embedding array<double>, id long, n long, code long, cid long"
    classes = written(copies.mapInArrow(_coder(models_of(vectors, sample_rows)), schema))
    codes = written(classes.groupBy("kin", "code").agg(F.count("*").alias("size")))
    # only codes of more than a crowd are cut into blocks; they are few enough to be broadcast, and others are at most a crowd
    crowd = crowd_of(classes.count(), block)
    large = F.broadcast(codes.where(F.col("size") > crowd).select("kin", "code", F.ceil(F.col("size") / block).cast("int").alias("parts")))
    part = F.pmod(F.xxhash64("cid"), F.coalesce("parts", F.lit(1))).cast("int")
    blocks = written(
        classes.join(large, ["kin", "code"], "left").groupBy("kin", "code", part.alias("part")).agg(F.collect_list(F.struct("cid", "n", "embedding")).alias("g"))
        .select("kin", "code", "part", F.col("g.cid").alias("ids"), F.col("g.n").alias("n"), F.flatten("g.embedding").alias("v"))
    )
    side = lambda s: [F.col(c).alias(f"{s}_{c}") for c in ("part", "ids", "n", "v")]
    apart = (
        candidates(codes.select("kin", "code"), radius)
        .join(blocks.select("kin", F.col("code").alias("a"), *side("x")), ["kin", "a"])
        .join(blocks.select("kin", F.col("code").alias("b"), *side("y")), ["kin", "b"]).withColumn("own", F.lit(False))
    )
    # blocks of one code: each with itself and with those after it
    inner = blocks.select("kin", "code", *side("x")).join(
        blocks.select("kin", "code", *side("y")), ["kin", "code"]
    ).where("x_part <= y_part").withColumn("own", F.col("x_part") == F.col("y_part"))
    columns = ["x_ids", "x_n", "x_v", "y_ids", "y_n", "y_v", "own"]
    links = written(apart.select(*columns).unionByName(inner.select(*columns)).mapInArrow(_rerank(threshold), "id long, n long, root long"))
    counts = links.groupBy(F.col("id").alias("cid")).agg(F.sum("n").alias("linked"))
    component = connected_components(links.where("id <> root"), "id", "root").select(F.col("node").alias("cid"), "component")
    linked = written(component.join(classes.select("cid", "id"), "cid"))
    least = written(linked.groupBy("component").agg(F.min("id").alias("component_id")))
    of_class = (
        classes.select("kin", "h", "embedding", "cid", "id", "n").join(counts, "cid", "left")
        .join(spread_join(linked.select("cid", "component"), least, ["component"], CROWD).select("cid", "component_id"), "cid", "left")
        .select(
            F.col("kin").alias("kin_"), F.col("h").alias("h_"), F.col("embedding").alias("embedding_"), (F.coalesce("linked", F.lit(0)) + F.col("n") - 1).alias("n_links"),
            F.coalesce("component_id", "id").alias("component_id"),
        )
    )
    # joined by integers; equal hashes are told apart by the vectors themselves
    found = good.join(of_class, F.expr("kin = kin_ and h = h_ and embedding = embedding_")).select("vec_id", "n_links", "component_id")
    rest = vectors.where(~sound()).select(F.col("vec_id").cast("long"), F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"))
    return found.unionByName(rest).withColumn("kept", F.col("vec_id") == F.col("component_id"))
