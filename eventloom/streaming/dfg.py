"""Counts over streams of events, kept by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.model import EventLog
from eventloom.operators.casecentric import activity


def activity_windows(log: EventLog, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Events by time window and activity of a streaming log; events later than ``late`` are dropped."""
    events = log.events.withWatermark("ts", late)
    return events.groupBy(F.window("ts", window), activity().alias("activity")).agg(F.count("*").alias("cnt")).select(F.col("window.start").alias("start"), "activity", "cnt")
