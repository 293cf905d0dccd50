"""Event-time aggregates and stateful forms for streams of detections and events (an extension: the batch operators do not need them)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Rows and sum of value per event type and time window; rows later than the watermark are dropped on streams."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of each user: rows with no more than the gap between them."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def frame_diagnostics(tracked: DataFrame, path: str):
    """Writes per-frame counts as they come: one append a micro-batch, which is all or nothing."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.groupBy("seq", "frame").agg(F.count("*").alias("n_tracked")).withColumn("epoch", F.lit(epoch)).write.mode("append").json(path)

    return tracked.writeStream.foreachBatch(write)
