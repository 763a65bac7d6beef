"""Structured Streaming forms of the session, rate and latest-per-key operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def closed_sessions(events: DataFrame, key: str = "user_id", ts: str = "ts", gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions by gap; in append mode a session comes out once the watermark is past its end."""
    out = events.withWatermark(ts, late).groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("events"), F.max(ts).alias("end"))
    return out.select(key, F.col("w.start").alias("start"), "end", "events")


def rates(events: DataFrame, key: str, ts: str = "ts", window: str = "2 minutes", slide: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Events of a key in sliding windows."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, window, slide).alias("w"), key).agg(F.count("*").alias("events")).select(F.col("w.start").alias("start"), key, "events")


def first_seen(events: DataFrame, keys: list[str], ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """Each key once within the watermark: idempotent intake."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)
