"""Readers of provider payloads and of declarative specifications.

The provider's answers are read from folders of JSON files, one request a file, through Spark's own readers: the path of
a file is the request. (A live client would land its answers in the same layout; no network code is part of the engine.)
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

ENDPOINTS = ("repository", "commit", "file", "tree", "compare", "issue", "pull", "events", "run", "jobs", "artifacts", "log")


def payloads(spark: SparkSession, folder: str, endpoint: str, schema: str | None = None) -> DataFrame:
    """(request, status, body): body is text, or a struct where a schema is given; an answer that doesn't fit fails the read."""
    if endpoint not in ENDPOINTS:
        raise KeyError(endpoint)
    raw = spark.read.text(f"{folder}/{endpoint}", wholetext=True).select(F.input_file_name().alias("request"), F.col("value").alias("text"))
    parsed = raw.withColumn("status", F.coalesce(F.get_json_object("text", "$.status_code").cast("int"), F.lit(200))).withColumn("body", F.get_json_object("text", "$.body"))
    return parsed.withColumn("body", F.from_json("body", schema, {"mode": "FAILFAST"})).drop("text") if schema else parsed.drop("text")


def file_bytes(files: DataFrame) -> DataFrame:
    """Contents of file answers: base64 with line breaks."""
    return files.withColumn("data", F.unbase64(F.regexp_replace("content", r"\s", "")))


def log_availability(status):
    """A redirect means that a log is there; the redirect itself isn't followed."""
    return F.when(status.isin(301, 302, 303, 307, 308), "available").when(status == 404, "missing").otherwise(F.raise_error(F.concat(F.lit("log probe: status "), status.cast("string"))))


def paginated_faults(pages: DataFrame, by: str, page_size: int, most: int = 100) -> DataFrame:
    """Collections that aren't complete: no short last page within the ceiling, or a page left out. pages: by, page, n_items."""
    return (
        pages.groupBy(by).agg(F.max("page").alias("last"), F.count_distinct("page").alias("n"), F.max_by("n_items", "page").alias("tail"))
        .where((F.col("last") != F.col("n")) | (F.col("tail") >= page_size) | (F.col("last") > most))
    )


class LandedPages(DataSource):
    """Python data source `landed_pages`: pages of collections from files that a client landed, `<path>/<request>/page-<number>.json`, a partition for each file.

    Option `requests` (a JSON list) names the requests that are read; others' folders aren't listed. It is an option and not a pushed filter, because Spark 4.1 keeps what was pushed to a
    relation's reader, so that another query on the same DataFrame would miss rows (tests/test_selectors.py reads one twice). A request whose numbers have a gap fails before anything is read, a page that isn't JSON or lacks a
    field when it is read; what only the contents tell (totals, short pages, merge bases) is for operators.pages.
    """

    @classmethod
    def name(cls) -> str:
        return "landed_pages"

    def schema(self) -> str:
        return "request string, page int, page_size int, total long, status int, merge_base string, items array<string>"

    def reader(self, schema):
        wanted = self.options.get("requests")
        return _Pages(self.options["path"], None if wanted is None else {*json.loads(wanted)})


class _Pages(DataSourceReader):
    def __init__(self, path: str, wanted: set[str] | None):
        self.path, self.wanted = path, wanted

    def _store(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path if "://" in self.path else f"file://{self.path}")

    def partitions(self):
        from pyarrow import fs

        store, root = self._store()
        requests = sorted(f.base_name for f in store.get_file_info(fs.FileSelector(root)) if f.type == fs.FileType.Directory)
        found = []
        for request in requests if self.wanted is None else sorted(self.wanted.intersection(requests)):
            names = [f.base_name for f in store.get_file_info(fs.FileSelector(f"{root}/{request}"))]
            pages = sorted(int(m[1]) for m in map(re.compile(r"page-(\d+)\.json").fullmatch, names) if m)
            if pages != [*range(1, len(pages) + 1)]:
                raise ValueError(f"request {request}: pages {pages} aren't complete")
            found += [InputPartition((request, page)) for page in pages]
        return found

    def read(self, partition):
        request, page = partition.value
        store, root = self._store()
        with store.open_input_stream(f"{root}/{request}/page-{page}.json") as f:
            made = json.loads(f.read())
        items = [x if isinstance(x, str) else json.dumps(x, sort_keys=True, separators=(",", ":"), ensure_ascii=False) for x in made["items"]]
        yield request, page, int(made["page_size"]), made.get("total"), int(made.get("status", 200)), made.get("merge_base"), items


def landed_pages(spark: SparkSession, path: str, requests: list[str] | None = None) -> DataFrame:
    """Pages of all requests, or of those named."""
    spark.dataSource.register(LandedPages)
    source = spark.read.format("landed_pages").option("path", path)
    return (source if requests is None else source.option("requests", json.dumps(requests))).load()


def _yaml(text: str):
    try:
        import yaml
    except ImportError as x:
        raise RuntimeError("PyYAML isn't installed; give the specification as JSON, which is YAML too") from x
    return yaml.safe_load(text)


def specification(spark: SparkSession, path: str):
    """A small YAML or JSON specification, read through Spark so that any store will do."""
    text = spark.read.text(path, wholetext=True).first().value
    try:
        return json.loads(text)
    except ValueError:
        return _yaml(text)


def watchlist(spark: SparkSession, path: str) -> DataFrame:
    """(position, repository, revision) of a watchlist; repeated or empty names fail."""
    made = specification(spark, path)
    rows = [(k, r["repository"].strip(), r.get("revision")) for k, r in enumerate(made["repositories"], 1)]
    if not rows or len({r for _, r, _ in rows}) != len(rows) or not all(r for _, r, _ in rows):
        raise ValueError("a watchlist names each repository once, and at least one")
    return spark.createDataFrame(rows, "position int, repository string, revision string")


def coverage_spec(spark: SparkSession, path: str) -> DataFrame:
    """(case_id, requirement_id, artifact, kind, fragment, needed_capability): a row for each fragment of each requirement."""
    rows = [
        (case["case_id"], need["evidence_id"], need["check"].get("artifact"), need["check"]["kind"], fragment, need.get("needed_capability_if_missing"))
        for case in specification(spark, path)["cases"] for need in case["requirements"] for fragment in need["check"].get("fragments") or [None]
    ]
    return spark.createDataFrame(rows, "case_id string, requirement_id string, artifact string, kind string, fragment string, needed_capability string")


def readiness_spec(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Requirements (case_id, capability) and capabilities (capability, state) of a readiness specification."""
    made = specification(spark, path)
    needs = [(c["case_id"], r) for c in made["cases"] for r in c["requires"]]
    return spark.createDataFrame(needs, "case_id string, capability string"), spark.createDataFrame([(k, v["state"]) for k, v in made["capabilities"].items()], "capability string, state string")
