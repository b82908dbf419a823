"""Streaming counters with watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, ts: str, key: str, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """(key, start, n, total) by tumbling window. Events later than the watermark are dropped by the stream, none in a batch."""
    counted = events.withWatermark(ts, late).groupBy(F.window(ts, window), F.col(key)).agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return counted.select(key, F.col("window.start").alias("start"), "n", "total")


def new_items(events: DataFrame, ts: str, key: str, late: str = "2 days") -> DataFrame:
    """Each key once within the watermark: resumable processing of items by the stream's own checkpoint."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])
