"""Streaming faces: windowed event counts, and incremental scans as a stream of file states."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repolith.operators.incremental import classify_changes


def windowed(events: DataFrame, *, width: str = "5 minutes", watermark: str | None = "10 minutes") -> DataFrame:
    """Events per type and time window; on a stream late rows beyond the watermark are dropped."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if watermark:
        timed = timed.withWatermark("ts", watermark)
    counted = timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("total"))
    return counted.select(F.col("w.start").alias("window_start"), "event_type", "events", "total")


def follow_scans(scans: DataFrame, known: Callable[[], DataFrame], publish: Callable[[DataFrame, int], None], *, checkpoint: str):
    """Runs every micro-batch of scanned file states against the state known so far.

    ``publish`` gets (file_id, state) and the batch number; written idempotently
    by batch number it makes the pipeline exactly-once.
    """

    def batch(frame: DataFrame, number: int) -> None:
        publish(classify_changes(known(), frame, ["file_id"]).where("state <> 'unchanged'"), number)

    return scans.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
