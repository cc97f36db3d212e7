"""A stream of scan metrics: daily trends with late data bounded."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def activity_stream(events: DataFrame, late: str = "2 days", window: str = "1 day") -> DataFrame:
    """Events (ts, event_type, user_id) counted per window and type; windows close once they are late."""
    rows = events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type")
    return rows.agg(F.count("*").alias("n"), F.approx_count_distinct("user_id").alias("users")).select(F.col("window.start").alias("start"), "event_type", "n", "users")
