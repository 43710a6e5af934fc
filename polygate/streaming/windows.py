"""Event-time operators over an ``events``-like stream or table: an extension beyond the dialects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, width: str, time: str = "ts", keys: tuple[str, ...] = ("event_type",), late: str | None = None) -> DataFrame:
    """Counts and sums of ``value`` by window and keys; with ``late`` a streaming watermark."""
    df = events.withWatermark(time, late) if late else events
    out = df.groupBy(F.window(time, width).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n", "total")


def sessions(events: DataFrame, gap: str, time: str = "ts", user: str = "user_id", late: str | None = None) -> DataFrame:
    """Sessions of each user: runs of events with less than ``gap`` between them."""
    df = events.withWatermark(time, late) if late else events
    out = df.groupBy(F.session_window(time, gap).alias("w"), user).agg(F.count("*").alias("n"))
    return out.select(user, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")
