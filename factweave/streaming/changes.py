"""Structured Streaming additions: event counts in windows, and facts kept fresh as files change."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def event_windows(events: DataFrame, every: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Tumbling counts and sums per event type; rows later than the watermark are dropped by Spark."""
    held = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events
    grouped = held.groupBy(F.window("ts", every).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return grouped.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def refresh_facts(changes: DataFrame, derive: Callable[[DataFrame], DataFrame], path: str, checkpoint: str):
    """Start a stream that rederives facts of changed files (path, text) and writes each batch once."""

    def write(batch: DataFrame, epoch: int) -> None:
        derive(batch).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()
