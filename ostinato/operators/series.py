"""The two shapes of series and what leads from one to the other.

Long: series_id, t (hours), value. Array: series_id, t and y as arrays in order of time. Long form suits aggregates over
irregular grids; array form suits expressions and kernels over whole series, and needs no shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hours(ts: Column, origin: Column | None = None) -> Column:
    """A timestamp in hours since the epoch, or since an origin; one without a zone is taken in the session's."""
    at = F.unix_micros(ts.cast("timestamp"))
    return at / 3.6e9 if origin is None else (at - F.unix_micros(origin.cast("timestamp"))) / 3.6e9


def to_array(long: DataFrame, series_id: str = "series_id", t: str = "t", value: str = "value") -> DataFrame:
    """Long to array form; points with a null or NaN time or value are left out, equal times stay in order of their values."""
    ok = long.where(F.col(t).isNotNull() & F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    pts = F.array_sort(F.collect_list(F.struct(F.col(t).cast("double").alias("t"), F.col(value).cast("double").alias("y"))))
    g = ok.groupBy(F.col(series_id).cast("string").alias("series_id")).agg(pts.alias("p"))
    return g.select("series_id", F.col("p.t").alias("t"), F.col("p.y").alias("y"))


def to_long(arrays: DataFrame) -> DataFrame:
    return arrays.select("series_id", F.explode(F.arrays_zip("t", "y")).alias("p")).select("series_id", F.col("p.t").alias("t"), F.col("p.y").alias("value"))


def from_vectors(df: DataFrame, series_id: str, vector: str, points: int | None = None, step: float = 1.0, keep: tuple[str, ...] = ()) -> DataFrame:
    """Array form of a vector column sampled on a regular grid, with the columns to keep; vectors shorter than points are left out."""
    v = F.col(vector).cast("array<double>")
    y = F.slice(v, 1, points) if points else v
    out = df.where(F.size(v) >= (points or 1))
    return out.select(F.col(series_id).cast("string").alias("series_id"), F.transform(F.sequence(F.lit(0), F.size(y) - 1), lambda i: i * float(step)).alias("t"), y.alias("y"), *keep)


def binned(events: DataFrame, series_id: Column, ts: Column, value: Column, width: float, how=F.avg) -> DataFrame:
    """Long form of an event table: one point for each occupied bin of ``width`` hours since the epoch."""
    t = F.floor(hours(ts) / width) * float(width)
    return events.groupBy(series_id.cast("string").alias("series_id"), t.alias("t")).agg(how(value).cast("double").alias("value"))


def average_replicates(long: DataFrame) -> DataFrame:
    """One value for each series and time: the mean over replicates, nulls left out."""
    return long.groupBy("series_id", "t").agg(F.avg("value").alias("value"))


def downsample(arrays: DataFrame, every: int) -> DataFrame:
    """Every k-th point of each series, from the first on."""
    pick = lambda c: F.filter(F.col(c), lambda x, i: i % every == 0)
    return arrays.select("series_id", pick("t").alias("t"), pick("y").alias("y"))


def noised(arrays: DataFrame, spread: float, seed: int = 0) -> DataFrame:
    """Each series with normal noise of ``spread`` times its own spread, from hashes of its id and the points' places: the same in every run."""
    share = lambda i, k: (F.pmod(F.xxhash64("series_id", i, F.lit(2 * seed + k)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    normal = lambda i: F.sqrt(-2 * F.log(share(i, 0))) * F.cos(2 * math.pi * share(i, 1))
    n, add = F.size("y"), lambda a, f: F.aggregate(a, F.lit(0.0), lambda s, x: s + f(x))
    sd = F.sqrt(F.greatest(add("y", lambda x: x * x) / n - (add("y", lambda x: x) / n) ** 2, F.lit(0.0)))
    # the spread is a variable of an outer function: as a column it would be put into the inner one and found anew at each point
    return arrays.withColumn("y", F.transform(F.array(sd), lambda d: F.transform("y", lambda x, i: x + spread * d * normal(i)))[0])


def guarded(arrays: DataFrame, least: int = 6) -> DataFrame:
    """Adds ``error``: why a series can't be analysed, or null."""
    n = F.size("y")
    error = (
        F.when(F.col("y").isNull() | F.col("t").isNull(), "no series")
        .when(F.size("t") != n, "times and values differ in number")
        .when(n < least, f"fewer than {least} points")
        .when(F.exists("y", lambda x: x.isNull() | F.isnan(x)), "values are missing")
    )
    return arrays.withColumn("error", error)
