"""Counts over event time. The functions take batch and streaming frames alike; watermarks matter only to streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _timed(events: DataFrame, late: str) -> DataFrame:
    """Rows with a ts; a stream's gets a watermark, for which times without a zone are read in the session's zone."""
    held = events.where("ts is not null")
    return held.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else held


def windows(events: DataFrame, width: str, late: str = "10 minutes") -> DataFrame:
    """Tumbling windows: event_type, starts, n, total. Rows without ts are left out."""
    held = _timed(events, late)
    counted = held.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return counted.select("event_type", F.col("window.start").alias("starts"), "n", "total")


def sessions(events: DataFrame, gap: str, late: str = "10 minutes") -> DataFrame:
    """Sessions by user: user_id, starts, n. A session ends when no event follows within the gap."""
    held = _timed(events.where("user_id is not null"), late)
    counted = held.groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return counted.select("user_id", F.col("session_window.start").alias("starts"), "n")


def once(writes: DataFrame, request: str, late: str = "10 minutes") -> DataFrame:
    """The first write of each request id; a stream forgets ids that are older than the watermark."""
    if writes.isStreaming:
        return _timed(writes, late).dropDuplicatesWithinWatermark([request])
    return writes.dropDuplicates([request])
