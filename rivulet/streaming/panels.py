"""The daily panel and its sessions over a stream of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_counts(events: DataFrame, late: str = "2 days") -> DataFrame:
    """Events and values by user and day, final once the watermark has passed the day."""
    marked = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return marked.groupBy(F.window("ts", "1 day"), "user_id").agg(F.count(F.lit(1)).alias("n_events"), F.sum(F.col("value").cast("decimal(18,2)")).alias("total")).select("user_id", F.col("window.start").cast("date").alias("d"), "n_events", "total")


def sessions(events: DataFrame, gap: str = "70 days", late: str = "2 days") -> DataFrame:
    """Stretches of a user's events without a gap of this length."""
    marked = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return marked.groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n_events")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n_events")
