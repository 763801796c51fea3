"""Windowed aggregates over event tables; they run on batch and streaming frames alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _watermarked(events: DataFrame, late: str | None) -> DataFrame:
    return events.withWatermark("ts", late) if late and events.isStreaming else events


def windows(events: DataFrame, size: str, slide: str | None = None, late: str | None = "1 hour") -> DataFrame:
    """(window_start, event_type, n, total): tumbling windows, or sliding ones with a slide."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    g = _watermarked(events, late).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, late: str | None = "1 hour") -> DataFrame:
    """(user_id, session_start, session_end, n, total)."""
    g = _watermarked(events, late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return g.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n", "total")
