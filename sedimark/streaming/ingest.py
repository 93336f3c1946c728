"""Optional streaming ingestion: landed record batches into the ledger, exactly once; late timeline rows to a side table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import Ledger, written


def landed(spark: SparkSession, folder: str) -> DataFrame:
    """Ledger rows that appear as JSON files in a folder."""
    return spark.readStream.schema(Ledger.SCHEMA).json(folder)


def into_ledger(rows: DataFrame, ledger: Ledger, conflicts: str, checkpoint: str):
    """Starts a query that appends each micro-batch idempotently: repeated rows are no-ops, contradictions go to a side folder of the batch.

    A batch is compared with the ledger's buckets of its own keys, not with the whole ledger. A batch that runs again finds its rows there and replaces its contradictions.
    """

    def append(batch: DataFrame, number: int) -> None:
        batch = written(batch)
        new, clash = ledger.split(batch)
        clash = written(clash)
        batch.join(clash, ["contract_type", "record_id"], "left_semi").write.mode("overwrite").json(f"{conflicts}/batch={number}")
        fresh = written(new.join(clash, ["contract_type", "record_id"], "left_anti"))
        if fresh.limit(1).count():
            ledger.add(fresh)

    return rows.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counts_by_window(events: DataFrame, at: str, kind: str, length: str = "1 day", lateness: str = "2 days") -> DataFrame:
    """Event counts in tumbling windows; rows later than the watermark are dropped from the state."""
    return events.withWatermark(at, lateness).groupBy(F.window(at, length).alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), kind, "n")


def distinct_events(events: DataFrame, ident: str, at: str, lateness: str = "2 days") -> DataFrame:
    return events.withWatermark(at, lateness).dropDuplicatesWithinWatermark([ident])
