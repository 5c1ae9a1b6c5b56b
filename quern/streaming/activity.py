"""Windowed activity of an event table or stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_activity(events: DataFrame, size: str = "1 day", slide: str | None = None, lateness: str = "2 hours") -> DataFrame:
    """(start, event_type, events, total) of events (ts, event_type, value), batch or stream.

    On a stream, a window closes once the largest ts seen is `lateness` past its end; later events are dropped then, and
    the state holds only open windows. Rows with a null ts belong to no window.
    """
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("ts", lateness) if rows.isStreaming else rows
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    out = rows.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "events", "total")
