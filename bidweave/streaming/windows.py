"""Event-time windows; each works on a batch and, with a watermark, on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _late(events: DataFrame, ts: str, delay: str | None) -> DataFrame:
    return events.withWatermark(ts, delay) if delay and events.isStreaming else events


def tumbling(events: DataFrame, ts: str, width: str, keys: list[str], value: str, delay: str | None = None) -> DataFrame:
    """Count and sum by window and keys."""
    rows = _late(events, ts, delay).groupBy(F.window(ts, width).alias("w"), *keys)
    return rows.agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("window_start"), *keys, "n", "total")


def sliding(events: DataFrame, ts: str, width: str, step: str, keys: list[str], value: str, delay: str | None = None) -> DataFrame:
    rows = _late(events, ts, delay).groupBy(F.window(ts, width, step).alias("w"), *keys)
    return rows.agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("window_start"), *keys, "n", "total")


def sessions(events: DataFrame, ts: str, gap: str, keys: list[str], value: str, delay: str | None = None) -> DataFrame:
    """Sessions that end when a key is silent for the gap."""
    rows = _late(events, ts, delay).groupBy(F.session_window(ts, gap).alias("w"), *keys)
    return rows.agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *keys, "n", "total")
