"""Event streams: the binning of tags and the union of peaks in their streaming form. Extensions; batch tables work too."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _timed(events: DataFrame, late: str) -> DataFrame:
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return events.withWatermark("ts", late) if events.isStreaming else events


def window_counts(events: DataFrame, width: str, late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """event_type, start, end, n, total in windows of time; events later than `late` are dropped from a stream."""
    at = F.window("ts", width, slide) if slide else F.window("ts", width)
    out = _timed(events, late).groupBy(at.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select("event_type", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")


def sessions(events: DataFrame, gap: str, late: str = "10 minutes") -> DataFrame:
    """user_id, start, end, n: events of a user no further apart than the gap, as peaks merge into runs."""
    out = _timed(events, late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
