"""Aggregates over decoded streams. Spark supplies them; nothing here is special to XML."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def counts(df: DataFrame, time: str, key: str, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Rows of each key and window of a decoded stream or table; later ones than ``late`` are left out of a stream."""
    timed = df.withWatermark(time, late) if df.isStreaming else df
    return timed.groupBy(F.window(time, window).alias("w"), F.col(key)).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), key, "n")
