"""Shared pieces of the training-data operators: a byte-level word kernel, shared-folder tables
and distributed connected components."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U = np.uint64

#: Fixed values of the contract: words are separated by space and U+0009..U+000D.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
WORD_RE = "[^\\x20\\x09-\\x0D]+"

_MULT = U(0x9E3779B97F4A7C15)
#: Bases of two independent hashes; odd, so they have inverses modulo 2**64.
_BASES = (0x2545F4914F6CDD1D, 0x5851F42D4C957F2D)


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser; spreads the entropy of sums of products over all bits."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


_BYTE = mix(np.arange(1, 257, dtype=U) * _MULT)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a hash base and of its inverse, at least n of each."""
    if which not in _POWERS or len(_POWERS[which][0]) < n:
        made = []
        for base in (_BASES[which], pow(_BASES[which], -1, 1 << 64)):
            p = np.full(max(n, 1 << 16), U(base))
            p[0] = 1
            made.append(np.cumprod(p, dtype=U))
        _POWERS[which] = made[0], made[1]
    return _POWERS[which]


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, one after the other, and each text's first byte (with the end). Null: empty."""
    texts = texts.cast(pa.large_binary()) if not pa.types.is_large_binary(texts.type) else texts
    if texts.null_count:
        texts = texts.fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    if not len(texts) or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


class Words:
    """Words of a batch of texts as arrays: byte start and end, text index, 64-bit hash."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        self.data, self.offsets = text_buffer(texts)
        data, n = self.data, len(self.data)
        solid = ~IS_SPACE[data]
        first = np.zeros(n + 1, bool)
        first[self.offsets] = True
        before = np.empty(n, bool)
        before[:1] = True
        before[1:] = ~solid[:-1]
        self.start = np.flatnonzero(solid & (before | first[:n]))
        after = np.empty(n, bool)
        after[-1:] = True
        after[:-1] = ~solid[1:]
        self.end = np.flatnonzero(solid & (after | first[1:])) + 1
        #: first word of each text, with the end
        self.first = np.searchsorted(self.start, self.offsets)
        self.count = np.diff(self.first)
        self.lower = lower
        self._sums: dict[tuple[bool, int], np.ndarray] = {}
        self._hash: np.ndarray | None = None

    @property
    def text(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.count)), self.count)

    def spans(self, start: np.ndarray, end: np.ndarray, lower: bool = False, which: int = 0) -> np.ndarray:
        """Hashes of byte ranges; `which` picks one of two independent ones."""
        n = len(self.data)
        power, inverse = _powers(n + 1, which)
        if (lower, which) not in self._sums:
            sums = self._sums[lower, which] = np.empty(n + 1, U)
            sums[0] = 0
            np.cumsum((_BYTE_LOWER if lower else _BYTE)[self.data] * power[:n], out=sums[1:])
        sums = self._sums[lower, which]
        return mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(U))

    @property
    def hash(self) -> np.ndarray:
        if self._hash is None:
            self._hash = self.spans(self.start, self.end, self.lower)
        return self._hash

    def grams(self, k: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of k consecutive words at each word where they fit in the text, and those words' indices."""
        w, n = self.spans(self.start, self.end, self.lower, which) if which else self.hash, len(self.start) - k + 1
        if n <= 0:
            return np.zeros(0, U), np.zeros(0, np.int64)
        h = w[:n].copy()
        for i in range(1, k):
            h = h * _MULT + w[i : i + n]
        last = np.repeat(self.first[1:], self.count)[:n]
        at = np.flatnonzero(np.arange(n) + k <= last)
        return mix(h[at]), at


def slices(batch: pa.RecordBatch, column: str, limit: int = 1 << 19):
    """Pieces of a batch with about `limit` bytes of text at most, which bounds the arrays of a task (one longer text is a piece of its own)."""
    lengths = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths)
    at = 0
    while at < len(lengths):
        done = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, done + limit, side="right")))
        yield batch.slice(at, stop - at)
        at = stop


def tidy(run):
    """A function over Arrow batches that gives its memory back when a task ends: workers live on and serve other operators."""

    def wrapped(batches):
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except OSError:  # another C library
            pass

    return wrapped


def small_batches(spark: SparkSession, most: int = 4 << 20) -> None:
    """Bounds the bytes of Arrow batches between the JVM and Python, unless the session's bound is lower."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, None)
    if now is None or not now.lstrip("-").isdigit() or not 0 < int(now) <= most:
        spark.conf.set(key, str(most))


def unused(names: list[str], *stems: str) -> list[str]:
    """A column name for each stem that no column has, in any case."""
    taken, out = {n.lower() for n in names}, []
    for stem in stems:
        name = stem
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


_SCRATCH: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """A folder of this application in the cluster's shared checkpoint folder; in tests, where none is set, a temporary one."""
    app = spark.sparkContext.applicationId
    if app not in _SCRATCH:
        root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not root:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            root = tempfile.mkdtemp(prefix="sedimark-")
        _SCRATCH[app] = f"{root.rstrip('/')}/tables-{uuid.uuid4().hex}"
        atexit.register(_remove, spark, _SCRATCH[app])
    return _SCRATCH[app]


def _remove(spark: SparkSession, folder: str) -> None:
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the session may have ended before
        return


def written(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder: lineage ends there, and lost executors cost no recomputation."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Deletes the files of a table from written() that nothing reads any more."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/tables-" in path:
            _remove(spark, path)


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links as a spanning forest of stars: every linked value that isn't the least of its component, with the least."""
    values, inverse = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = inverse[: len(u)], inverse[len(u) :]
    label = np.arange(len(values))
    while len(a):
        least = np.minimum(label[a], label[b])
        # only roots are hooked: what hangs on them comes along, and no tie is lost
        roots = label[a], label[b]
        for r in roots:
            np.minimum.at(label, r, least)
        while (label[label] != label).any():
            label = label[label]
        keep = label[a] != label[b]
        a, b = a[keep], b[keep]
    off = label != np.arange(len(values))
    return values[off], values[label[off]]


def _local_forest(batches):
    """Each task's links as a forest, in bounded memory: what is kept is at most a link for each value."""
    u = v = np.zeros(0, np.int64)
    pending: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for b in batches:
        pending.append((b.column(0).to_numpy(), b.column(1).to_numpy()))
        size += b.num_rows
        if size > max(500_000, 2 * len(u)):
            u, v = forest(np.concatenate([u, *(p[0] for p in pending)]), np.concatenate([v, *(p[1] for p in pending)]))
            pending, size = [], 0
    if pending:
        u, v = forest(np.concatenate([u, *(p[0] for p in pending)]), np.concatenate([v, *(p[1] for p in pending)]))
    if len(u):
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])


#: Keys that are joined by broadcast are at most so many: those with more than a share of 1 / HOT_KEYS of the rows, and CROWD rows at least.
HOT_KEYS, CROWD = 10_000, 1_000


def crowd_of(rows: int, least: int = CROWD) -> int:
    return max(least, rows // HOT_KEYS)


def spread_join(rows: DataFrame, table: DataFrame, keys: list[str], least: int = CROWD) -> DataFrame:
    """Rows left-joined to the one row, if any, that table has for their keys, without a task that gets all rows of a hot key.

    Adaptive execution can't split a join where one side comes straight from an aggregate of the same keys. So keys of more than
    a crowd of rows (HOT_KEYS at most) are joined by broadcast, and only the others meet in an equi-join. rows and table should be tables already written, as
    both are read twice. Null keys find nothing.
    """
    crowd = crowd_of(rows.count(), least)
    hot = table.join(rows.groupBy(*keys).agg(F.count("*").alias("rows_")).where(F.col("rows_") > crowd).drop("rows_"), keys)
    hot = written(hot)
    if not hot.limit(1).count():
        return rows.join(table, keys, "left")
    mark = F.broadcast(hot.withColumn("hot_", F.lit(True)))
    tagged = rows.join(mark, keys, "left")
    cold = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(table, keys, "left")
    return tagged.where("hot_").drop("hot_").unionByName(cold)


def _with_least(edges: DataFrame, rows: int) -> DataFrame:
    """(u, v, m): edges with the least v of their u (or u itself, if less)."""
    crowd = crowd_of(rows)
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    hot = written(least.where(F.col("n") > crowd).select("u", "m"))
    if not hot.limit(1).count():
        return edges.join(least.select("u", "m"), "u")
    tagged = edges.join(F.broadcast(hot), "u", "left")
    cold = tagged.where("m is null").drop("m").join(least.where(F.col("n") <= crowd).select("u", "m"), "u")
    return tagged.where("m is not null").unionByName(cold)


def connected_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the least value reachable from every linked value, itself included.

    Alternating large-star and small-star rounds over links (u > v). Each round is two aggregates (combined before
    the shuffle) and two joins of edges with the least neighbour of their end; ends with a crowd of edges get it by broadcast (HOT_KEYS
    of them at most), so no task holds all edges of the root of a large component. A round ends in a written table. The driver
    sees only a few numbers a round. Values in no link don't appear.
    """
    schema = "u long, v long"
    edges = written(
        links.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v"))
        .where("u <> v").mapInArrow(tidy(_local_forest), schema)
    )
    state, rows = None, edges.count()
    while rows:
        both = written(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))))
        large = written(_with_least(both, 2 * rows).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        small = (
            _with_least(large, rows).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v").where("u <> v").distinct()
        )
        new = written(small.mapInArrow(tidy(_local_forest), schema))
        now = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        for done in (edges, both, large):
            forget(done)
        edges, rows = new, now[0]
        if tuple(now) == state:
            break
        state = tuple(now)
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(nodes.select(F.col("component").alias("node"), "component").distinct())


def least_ids(docs: DataFrame, most: int, key: str = "doc_id") -> DataFrame:
    """The `most` distinct ids of least hash as a column of that name: a sample that repeated ids don't enlarge, chosen without reading other columns."""
    ids = docs.where(F.col(key).isNotNull()).select(F.col(key).alias(key), F.xxhash64(F.col(key).cast("long")).alias("h"))
    n, share = docs.count(), 1.0
    if n > 8 * most:
        share = 8 * most / n
    while True:
        # a first threshold by the number of rows, so that few ids go on to the distinct
        low = ids if share >= 1 else ids.where(F.col("h") <= F.lit(int(-(2**63) + share * 2**64)))
        low = low.distinct().orderBy("h", key).limit(most)
        if share >= 1 or low.count() == most:
            return low.select(key)
        share *= 8


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
