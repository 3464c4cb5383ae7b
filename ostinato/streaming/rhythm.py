"""Cosinor statistics over streams of events: the sums of a fit are additive, so they are a windowed aggregate."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import fits, series


def windowed_cosinor(events: DataFrame, key: Column, ts: str, value: Column, period: float, window: str, late: str) -> DataFrame:
    """Of each key and window of time: the cosinor of the values at their own times. Works on streams, for which ``late`` bounds how
    long a window stays open, and on tables. Rows with a null value or time don't count."""
    w = series.hours(F.col(ts)) * (2 * math.pi / period)
    base = events.withWatermark(ts, late) if events.isStreaming else events
    base = base.where(value.isNotNull() & F.col(ts).isNotNull()).select(key.cast("string").alias("series_id"), F.col(ts).alias("ts"), F.cos(w).alias("c"), F.sin(w).alias("s"), value.cast("double").alias("y"))
    sums = {"sc": "c", "ss": "s", "sy": "y", "scc": "c*c", "sss": "s*s", "scs": "c*s", "scy": "c*y", "ssy": "s*y", "syy": "y*y"}
    g = base.groupBy("series_id", F.window("ts", window).alias("w")).agg(F.count("*").alias("n"), *[F.sum(F.expr(e)).alias(k) for k, e in sums.items()])
    out = fits.solve_cosinor(g)
    return out.select("series_id", F.col("w.start").alias("window_start"), "n", "mesor", "amplitude", "phase", "p_value")
