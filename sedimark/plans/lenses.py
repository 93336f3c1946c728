"""The driver tables seen as the engine's inputs: each lens is a deterministic derivation of whole tables.

Two captures of the documents stand for two revisions: every document is in at least one of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEVELS = {"view": "1", "click": "2", "signup": "3", "purchase": "4", "error": "0"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts dealt over all tasks: texts made of them are many times as long as their rows, so that splits by the table's bytes would leave all parsing to a few tasks."""
    return table(spark, sf_dir, "part").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey")


def artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as Markdown artifacts."""
    d = table(spark, sf_dir, "documents")
    path = F.concat("source", F.lit("/"), "lang", F.lit("/doc-"), F.col("doc_id").cast("string"), F.lit(".md"))
    return d.select(F.col("doc_id").alias("artifact_id"), path.alias("source_locator"), "text", "source", "lang", "n_chars")


def capture(spark: SparkSession, sf_dir: str, side: str) -> DataFrame:
    """The previous or current capture: some documents are only in one, some missing, some with another text or media type."""
    now = side == "current"
    a = artifacts(spark, sf_dir).where(F.col("artifact_id") % 10 != (7 if now else 3))
    missing = F.col("artifact_id") % 13 == (2 if now else 1)
    text = F.when((F.col("artifact_id") % 5 == 0) & F.lit(now), F.concat("text", F.lit("\nchanged"))).otherwise(F.col("text"))
    media = F.when((F.col("artifact_id") % 11 == 0) & F.lit(now), "text/plain").otherwise("text/markdown")
    return a.withColumn("text", F.when(~missing, text)).withColumn("media_type", F.when(~missing, media)).withColumn(
        "content_hash", F.when(~missing, F.concat(F.lit("sha256:"), F.sha2(F.col("text").cast("binary"), 256)))
    ).withColumn("retrieval_status", F.when(missing, "missing").otherwise("captured"))


SIDE = ("source_locator", "content_hash", "media_type", "retrieval_status")


def markdown(a: DataFrame) -> DataFrame:
    """Texts broken at sentences, with some lines as blanks, fences, list items and headings."""
    rows = F.transform(
        F.split(F.regexp_replace("text", "[.] ", ".\n"), "\n"),
        lambda x, i: F.when((i + 1) % 7 == 0, F.lit("")).when((i + 1) % 17 == 2, F.lit("```")).when((i + 1) % 11 == 3, F.concat(F.lit("- "), x)).when((i + 1) % 13 == 5, F.concat(F.lit("# "), x)).otherwise(x),
    )
    return a.withColumn("text", F.array_join(rows, "\n"))


def url_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages' addresses as paths: without scheme, query and fragment."""
    p = table(spark, sf_dir, "pages")
    return p.select(F.col("page_id").alias("artifact_id"), F.regexp_replace(F.regexp_replace("url", r"^[a-z]+://", ""), r"[?#].*$", "").alias("source_locator"))


def tree(spark: SparkSession, sf_dir: str, side: str) -> DataFrame:
    """Parts as entries of two recursive trees."""
    now = side == "current"
    p = table(spark, sf_dir, "part").where(F.col("p_partkey") % 10 != (7 if now else 3))
    key = F.col("p_partkey")
    changed = (key % 5 == 0) & F.lit(now)
    folder = F.element_at(F.array(*map(F.lit, ("src", "docs", "vendor", "tests", ".github/workflows", "gen", "lib"))), (key % 7 + 1).cast("int"))
    ext = F.element_at(F.array(*map(F.lit, (".py", ".md", ".json", ".ts", ".bin"))), (key % 5 + 1).cast("int"))
    return p.select(
        F.concat(folder, F.lit("/"), F.regexp_replace("p_brand", "#", "-"), F.lit("/part-"), key.cast("string"), ext).alias("path"),
        F.when(key % 50 == 0, "tree").when((key % 31 == 0) & F.lit(now), "commit").otherwise("blob").alias("entry_type"),
        F.when((key % 19 == 0) & F.lit(now), "100755").otherwise("100644").alias("mode"),
        F.substring(F.sha2(F.concat("p_name", F.when(changed, F.lit("!")).otherwise(F.lit(""))).cast("binary"), 256), 1, 40).alias("object_sha"),
        (F.col("p_size").cast("long") * 25_000).alias("size"),
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def touches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as commits that touch part paths."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.concat(F.element_at(F.array(*map(F.lit, ("src", "docs", "tests"))), (F.col("l_partkey") % 3 + 1).cast("int")), F.lit("/part-"), F.col("l_partkey").cast("string")).alias("path"), F.col("l_orderkey").alias("commit_ordinal"))
