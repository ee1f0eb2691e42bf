"""Windowed aggregates that run alike on a batch and on a stream of events (ts, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def _late(df: DataFrame, watermark: str | None) -> DataFrame:
    return df.withWatermark("ts", watermark) if watermark else df


def _counted(df: DataFrame, window: Column, by: tuple[str, ...]) -> DataFrame:
    d = df.groupBy(*by, window.alias("w")).agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("total"))
    return d.select(*by, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "events", "total")


def tumbling(df: DataFrame, width: str, *by: str, watermark: str | None = None) -> DataFrame:
    """Counts and sums in windows of one width; events later than the watermark are dropped."""
    return _counted(_late(df, watermark), F.window("ts", width), by)


def sliding(df: DataFrame, width: str, slide: str, *by: str, watermark: str | None = None) -> DataFrame:
    return _counted(_late(df, watermark), F.window("ts", width, slide), by)


def sessions(df: DataFrame, gap: str, *by: str, watermark: str | None = None) -> DataFrame:
    """Counts and sums of sessions that end after a gap without an event."""
    return _counted(_late(df, watermark), F.session_window("ts", gap), by)


def once(df: DataFrame, keys: list[str], watermark: str) -> DataFrame:
    """The first event of each key within the watermark."""
    d = df.withWatermark("ts", watermark)
    return d.dropDuplicatesWithinWatermark(keys) if df.isStreaming else d.dropDuplicates(keys)
