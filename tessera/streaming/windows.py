"""Event-time windows over streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def watermarked(events: DataFrame, time: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """A watermark takes a timestamp with a zone, so one without is cast first."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)


def counted(events: DataFrame, keys: list[str], window: Column, value: str | None = None) -> DataFrame:
    """keys, window_start, window_end, n and total for tumbling, sliding and session windows alike."""
    aggregates = [F.count("*").alias("n")] + ([F.sum(value).alias("total")] if value else [])
    rows = events.groupBy(*keys, window.alias("w")).agg(*aggregates)
    return rows.select(*keys, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n", *(["total"] if value else []))


def tumbling(time: str, length: str) -> Column:
    return F.window(time, length)


def sliding(time: str, length: str, step: str) -> Column:
    return F.window(time, length, step)


def session(time: str, gap: str) -> Column:
    return F.session_window(time, gap)
