"""Structured Streaming views of an event stream: windowed totals, late versions, sessions.

Late rows are taken up to the watermark's delay; state older than it is let go, so it stays bounded by the
delay and not by the stream's age. Every view takes any DataFrame, streaming or not, and gives the same rows for both.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_totals(events: DataFrame, *, length: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """window_start, event_type, n, total over tumbling windows."""
    kept = events.withWatermark("ts", delay)
    rows = kept.groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return rows.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def first_versions(events: DataFrame, key: str, *, delay: str = "2 hours") -> DataFrame:
    """Each key once within the delay, as its first version came: re-sent events are told apart from new ones."""
    kept = events.withWatermark("ts", delay)
    return kept.dropDuplicatesWithinWatermark([key]) if events.isStreaming else kept.dropDuplicates([key])


def sessions(events: DataFrame, *, gap: str = "30 minutes", delay: str = "2 hours") -> DataFrame:
    """user_id, session_start, session_end, n of runs of a user's events with no longer gap."""
    kept = events.withWatermark("ts", delay)
    rows = kept.groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count(F.lit(1)).alias("n"))
    return rows.select("user_id", F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "n")
