"""Windowed activity counts of an event stream, with late events up to a bound. An extension: batch features come from operators.behaviour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(events: DataFrame, window: str = "1 day", late: str = "2 hours", slide: str | None = None) -> DataFrame:
    """user_id, start, n, frequency and kinds a window, for a batch or a stream of events (ts, user_id, event_type, value)."""
    at = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    of = F.window("ts", window, slide) if slide else F.window("ts", window)
    grouped = at.groupBy("user_id", of.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("value", F.lit(1.0))).alias("frequency"), F.approx_count_distinct("event_type").alias("kinds"))
    return grouped.select("user_id", F.col("w.start").alias("start"), "n", "frequency", "kinds")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """user_id, start, end and n of runs of events with no gap as long as `gap`."""
    at = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    grouped = at.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return grouped.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
