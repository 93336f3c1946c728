"""Tables in the shared folder, the append-only ledger and the content store."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import guards
from ..schemas import KEYS, schema, violations

_FOLDERS: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """A folder in the cluster's spark.checkpoint.dir; in local tests, where none is set, a temporary one."""
    app = spark.sparkContext.applicationId
    if app not in _FOLDERS:
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            root = tempfile.mkdtemp(prefix="sedimark-core-")
        _FOLDERS[app] = f"{root.rstrip('/')}/core-{uuid.uuid4().hex}"
        atexit.register(_remove, spark, _FOLDERS[app])
    return _FOLDERS[app]


def _remove(spark: SparkSession, folder: str) -> None:
    """Deletes the tables of an application when it ends."""
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the session may have ended before
        return


def written(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder; lineage ends there."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# idempotent appends


def split_append(incoming: DataFrame, existing: DataFrame, key: list[str], payload: str) -> tuple[DataFrame, DataFrame]:
    """Incoming rows that are new, and those that contradict an existing row or each other under the same key."""
    once = incoming.dropDuplicates([*key, payload])
    clash = once.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").select(*key)
    old = existing.select(*key, F.col(payload).alias("__old"))
    met = once.join(old, key, "left")
    conflicts = met.where(F.col("__old").isNotNull() & (F.col("__old") != F.col(payload))).select(*key).unionByName(clash).distinct()
    return met.where("__old is null").drop("__old"), conflicts


def _entries(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder of any file system that Spark can read; none if it isn't there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []


class Ledger:
    """Records as canonical JSON in Parquet: read, checked appends, nothing overwritten.

    Layout: folders by contract type and by hash bucket of the record's id; files are sorted by run and id and have bloom filters of both. So a read by keys
    opens the buckets of those keys, and in them, for a few keys, the row groups that may have them; a read of one run opens row groups by their range of runs;
    an append compares with the buckets that it adds to. The number of buckets is part of the path, so every reader of a ledger uses the same.
    A batch is checked as a whole and written in one commit of Spark's, so it appears wholly or not at all.
    """

    SCHEMA = "contract_type string, record_id string, schema_version string, payload_json string, payload_sha256 string"
    #: Keys that are pushed down to the files by value; more are joined.
    FEW = 10

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path = spark, path
        found = [int(n.removeprefix("buckets=")) for n in _entries(spark, path) if n.startswith("buckets=")]
        self.buckets = found[0] if found else buckets

    @property
    def _folder(self) -> str:
        return f"{self.path}/buckets={self.buckets}"

    def bucket(self, key: str = "record_id"):
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def rows(self) -> DataFrame:
        """All rows, with the run of those that name one, and their bucket."""
        full = f"{self.SCHEMA}, run_id string, bucket int"
        if not _entries(self.spark, self._folder):
            return self.spark.createDataFrame([], full)
        return self.spark.read.schema(full).parquet(self._folder)

    def _typed(self, rows: DataFrame, name: str) -> DataFrame:
        return rows.select(F.from_json("payload_json", schema(name), {"mode": "FAILFAST"}).alias("r")).select("r.*")

    def _of(self, name: str) -> DataFrame:
        if name not in KEYS:
            raise KeyError(name)
        return self.rows().where(F.col("contract_type") == name)

    def read(self, name: str) -> DataFrame:
        """Typed records, in order of their id; an unknown type is a KeyError."""
        return self._typed(self._of(name), name).orderBy(KEYS[name])

    def of_run(self, name: str, run_id: str) -> DataFrame:
        """Typed records that a run made."""
        return self._typed(self._of(name).where(F.col("run_id") == run_id), name)

    def get(self, name: str, ids: DataFrame) -> DataFrame:
        """Records of the ids (a column named as the type's key): only their buckets are read, and few ids are looked up in the files."""
        rows, key = self._of(name), KEYS[name]
        asked = ids.select(F.col(key).alias("record_id")).where("record_id is not null").distinct().withColumn("bucket", self.bucket())
        few = asked.limit(self.FEW + 1).collect()
        if len(few) <= self.FEW:
            return self._typed(rows.where(F.col("bucket").isin([r.bucket for r in few]) & F.col("record_id").isin([r.record_id for r in few])), name)
        used = [r.bucket for r in asked.select("bucket").distinct().collect()]  # one number a bucket at most
        return self._typed(rows.where(F.col("bucket").isin(used)).join(asked, ["bucket", "record_id"], "left_semi"), name)

    @staticmethod
    def payloads(df: DataFrame, name: str) -> DataFrame:
        fields = sorted(schema(name).fieldNames())
        return df.select(
            F.lit(name).alias("contract_type"), F.col(KEYS[name]).alias("record_id"), "schema_version", C.canonical(*fields).alias("payload_json"),
        ).withColumn("payload_sha256", F.sha2("payload_json", 256))

    def split(self, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Rows (SCHEMA) that aren't in the ledger, and keys that contradict it or each other. Only buckets of incoming rows are read."""
        touched = incoming.select("contract_type", self.bucket().alias("bucket")).distinct().collect()  # at most types times buckets
        old = self.rows().where(F.col("contract_type").isin(sorted({r.contract_type for r in touched})) & F.col("bucket").isin(sorted({r.bucket for r in touched})))
        return split_append(incoming, old, ["contract_type", "record_id"], "payload_sha256")

    def add(self, new: DataFrame) -> None:
        """Writes rows (SCHEMA) that split() found new."""
        laid = new.withColumn("run_id", F.get_json_object("payload_json", "$.run_id")).withColumn("bucket", self.bucket())
        # large buckets are dealt to several tasks, small ones share one
        out = laid.hint("rebalance", "contract_type", "bucket").sortWithinPartitions("contract_type", "bucket", "run_id", "record_id").write.partitionBy("contract_type", "bucket")
        for c in ("record_id", "run_id"):
            out = out.option(f"parquet.bloom.filter.enabled#{c}", "true")
        out.mode("append").parquet(self._folder)

    def append(self, batch: dict[str, DataFrame]) -> int:
        """Appends records of several types, all or none; returns how many are new."""
        found = None
        for name, df in batch.items():
            guards.require_empty(violations(df, name), f"{name} breaks its contract")
            rows = self.payloads(df, name)
            found = rows if found is None else found.unionByName(rows)
        if found is None:
            return 0
        new, conflicts = self.split(written(found))
        guards.require_empty(conflicts, "other records under the same key")
        new = written(new)
        n = new.count()
        if n:
            self.add(new)
        return n


class ObjectStore:
    """Immutable bytes by their digest."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._empty = spark.createDataFrame([], "content_hash string, data binary")

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(self.path) if _entries(self.spark, self.path) else self._empty

    def put(self, data: DataFrame) -> None:
        """Appends the distinct contents of column data that aren't stored."""
        new = data.select(C.digest("data").alias("content_hash"), "data").dropDuplicates(["content_hash"])
        written(new.join(self.rows().select("content_hash"), "content_hash", "left_anti")).write.mode("append").parquet(self.path)

    def get(self, refs: DataFrame) -> DataFrame:
        """refs (content_hash) with their bytes; a stored object whose digest isn't its key fails the query."""
        sound = F.when(C.digest("data") == F.col("content_hash"), F.col("data")).otherwise(F.raise_error(F.concat(F.lit("corrupt object "), "content_hash")).cast("binary"))
        return refs.join(self.rows(), "content_hash").withColumn("data", sound)

    def exists(self, refs: DataFrame) -> DataFrame:
        return refs.join(self.rows().select("content_hash"), "content_hash", "left_semi")
