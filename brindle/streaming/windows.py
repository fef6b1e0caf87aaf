"""Aggregates over time windows, for batches and streams alike."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def windowed(df: DataFrame, time: str, size: str, keys: Sequence[str], aggregates: Sequence[Column], slide: str | None = None, late: str | None = None) -> DataFrame:
    """window_start, window_end, the keys and the aggregates. On a stream, ``late`` sets the watermark: rows later than
    that are dropped, and state older than it is let go."""
    rows = df.withWatermark(time, late) if late and df.isStreaming else df
    window = F.window(time, size, slide) if slide else F.window(time, size)
    out = rows.groupBy(window.alias("_w"), *keys).agg(*aggregates)
    return out.select(F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), *[c for c in out.columns if c != "_w"])


def sessions(df: DataFrame, time: str, gap: str, keys: Sequence[str], aggregates: Sequence[Column], late: str | None = None) -> DataFrame:
    """Runs of rows of a key that are less than ``gap`` apart."""
    rows = df.withWatermark(time, late) if late and df.isStreaming else df
    out = rows.groupBy(F.session_window(time, gap).alias("_w"), *keys).agg(*aggregates)
    return out.select(F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), *[c for c in out.columns if c != "_w"])
