"""Family counts kept up to date from a stream: counts add up, so a network can be refreshed without its past rows.

Each micro-batch is collapsed and counted, and its counts are written under its batch number; a batch that is run again
replaces its own files, so every row counts once. Reading sums over batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.counts import Family, collapse, observed_counts

COUNTS = "f int, q long, v int, n long"


def count_stream(codes: DataFrame, families: list[Family], cards: dict[str, int], folder: str, checkpoint: str, **trigger):
    """Start a query that counts the streaming table of codes."""

    def one(batch: DataFrame, number: int) -> None:
        observed_counts(collapse(batch), families, cards).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return codes.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def totals(spark: SparkSession, folder: str) -> DataFrame:
    """f, q, v, n over all batches so far."""
    return spark.read.schema(COUNTS).parquet(folder).groupBy("f", "q", "v").agg(F.sum("n").alias("n"))


def windowed_counts(events: DataFrame, time: str, key: list[str], width: str, late: str) -> DataFrame:
    """Counts by tumbling event-time window and key; rows later than the watermark are dropped by Spark."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), *key).agg(F.count(F.lit(1)).alias("n"))
