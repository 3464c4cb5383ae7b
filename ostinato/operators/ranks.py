"""Running sums and quantiles in the order of a value, without a task that holds all values of a group.

Values are counted first. Mergeable sketches of each group's values, part of the same plan, give the points at which the counts are cut in ranges; every
range of every group is scanned on its own, and starts from the totals of the ranges below. Nothing runs or is kept before the result is asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges that the values of a group are cut in, and the accuracy of the sketch that cuts them.
BUCKETS, ACCURACY = 64, 1000


def meet(left: DataFrame, right: DataFrame, keys: list[str], *cols: str, how: str = "inner") -> DataFrame:
    """left with columns of right, whose keys are unique; null keys meet. Without keys right is one row."""
    if not keys:
        return left.join(F.broadcast(right.select(*cols)), F.lit(True))
    on = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    return left.alias("l").join(right.alias("r"), on, how).select("l.*", *[F.col(f"r.{c}") for c in cols])


def once(df: DataFrame, *by: str) -> DataFrame:
    """The rows dealt by some columns in one shuffle, from which all who read them get the same values.

    Readers of fewer columns would else have a narrower shuffle made, and what lies below it, sums of floats or kernels, computed anew and perhaps
    otherwise in the last digits. Passing whole batches on keeps all columns in it.
    """
    return df.repartition(*[F.col(c) for c in by]).mapInArrow(lambda batches: batches, df.schema)


def cut(counts: DataFrame, value: str, keys: list[str] | None = None, buckets: int = BUCKETS, few: bool = False) -> DataFrame:
    """The counts with a range number _b, rising with the value within a group. Null values are in the first range.
    ``few``: the groups are so few, whatever the input, that a row for each may be broadcast.

    The sketch reads all columns of the counts, so that it shares their shuffle with those who read the ranges.
    """
    v = F.col(value).cast("double")
    points = F.approx_percentile(F.when(F.abs(v) < float("inf"), v), F.lit([i / buckets for i in range(1, buckets)] or [0.0]), F.lit(ACCURACY))
    cuts = counts.groupBy(*(keys or [])).agg(F.array_distinct(points).alias("_cuts"), F.max(F.xxhash64(*counts.columns)).alias("_read"))
    below = F.size(F.filter("_cuts", lambda c: c < v)) if buckets > 1 else F.lit(0)
    number = F.when(F.col("_read").isNotNull() & F.col("_cuts").isNotNull(), below).otherwise(0)
    return meet(counts, F.broadcast(cuts) if few else cuts, keys or [], "_cuts", "_read").withColumn("_b", number).drop("_cuts", "_read")


def running(counts: DataFrame, value: str, sums: dict[str, Column], keys: list[str] | None = None, buckets: int = BUCKETS, keep: bool = False, few: bool = False) -> DataFrame:
    """Rows of one value of a group each, with the sums of some columns over the group's rows of smaller values, and over all its rows
    as ``{name}_all``; 0 at the least value. ``keep``: with the range, _b. ``few``: as for ``cut``; else the join may
    broadcast the side that grows with the input."""
    keys = keys or []
    cols = counts.columns
    counts = cut(counts, value, keys, buckets, few)
    within = Window.partitionBy(*keys, "_b").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    total = counts.groupBy(*keys, "_b").agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])  # a row for each range of a group
    below, whole = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*keys)
    zero = lambda c: F.coalesce(c, F.lit(0))
    total = total.select(*keys, "_b", *[zero(F.sum(f"_t_{n}").over(below)).alias(f"_u_{n}") for n in sums], *[F.sum(f"_t_{n}").over(whole).alias(f"{n}_all") for n in sums])
    scanned = counts.select("*", *[zero(F.sum(c).over(within)).alias(f"_w_{n}") for n, c in sums.items()])
    out = meet(scanned, F.broadcast(total) if few else total, [*keys, "_b"], *[f"_u_{n}" for n in sums], *[f"{n}_all" for n in sums])
    return out.select(*cols, *(["_b"] if keep else []), *[(F.col(f"_u_{n}") + F.col(f"_w_{n}")).alias(n) for n in sums], *[f"{n}_all" for n in sums])


def least_above(rows: DataFrame, value: str, measure: str, keys: list[str] | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Rows of one value of a group each, with the least of a measure over the group's rows of this value or a larger one, _least.
    Rows that have their range, _b, aren't cut again."""
    keys = keys or []
    rows = rows if "_b" in rows.columns else cut(rows, value, keys, buckets)
    within = Window.partitionBy(*keys, "_b").orderBy(F.desc(value))
    above = Window.partitionBy(*keys).orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    total = rows.groupBy(*keys, "_b").agg(F.min(measure).alias("_m")).select(*keys, "_b", F.min("_m").over(above).alias("_above"))
    return meet(rows.withColumn("_w", F.min(measure).over(within)), total, [*keys, "_b"], "_above").withColumn("_least", F.least("_w", "_above")).drop("_b", "_w", "_above")


def quantile(below: str, count: Column, total: Column, value: str, q: float | Column) -> Column:
    """Over a group of rows of ``running``: the value at a share of the way through, between two values in proportion. An aggregate."""
    at = (total - 1) * q
    lo, hi = F.floor(at), F.ceil(at)
    held = lambda p: F.max(F.when((F.col(below) <= p) & (p < F.col(below) + count), F.col(value)))
    share = F.max(at - lo)
    return held(lo) + F.when(share > 0, share * (held(hi) - held(lo))).otherwise(0.0)


def percentile(df: DataFrame, value: Column, q: float, keys: list[str] | None = None) -> DataFrame:
    """Keys (or one row) to the exact percentile of a value, null and NaN left out."""
    keys = keys or []
    v = value.cast("double")
    counts = df.select(*keys, v.alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v")).groupBy(*keys, "_v").agg(F.count("*").alias("_c"))
    r = running(counts, "_v", {"_n": F.col("_c")}, keys, few=not keys)
    return r.groupBy(*keys).agg(quantile("_n", F.col("_c"), F.col("_n_all"), "_v", q).alias("percentile"))


def percentiles(df: DataFrame, wanted: dict[str, tuple[Column, float]], keys: list[str] | None = None) -> DataFrame:
    """Keys (or one row) and a column for each (value, share) of ``wanted``: exact percentiles, null and NaN left out; all from one scan.

    Groups without a value of any of them have no row.
    """
    keys = keys or []
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), v.cast("double").alias("v")) for k, (v, _) in wanted.items()]))
    long = df.select(*keys, each.alias("_x")).select(*keys, F.col("_x.k").alias("_k"), F.col("_x.v").alias("_v"))
    counts = long.where(F.col("_v").isNotNull() & ~F.isnan("_v")).groupBy(*keys, "_k", "_v").agg(F.count("*").alias("_c"))
    r = running(counts, "_v", {"_n": F.col("_c")}, [*keys, "_k"], few=not keys)
    share = F.lit(0.0)
    for k, (_, q) in wanted.items():
        share = F.when(F.col("_k") == k, float(q)).otherwise(share)
    found = r.withColumn("_q", share).groupBy(*keys, "_k").agg(quantile("_n", F.col("_c"), F.col("_n_all"), "_v", F.col("_q")).alias("_p"))
    return found.groupBy(*keys).agg(*[F.max(F.when(F.col("_k") == k, F.col("_p"))).alias(k) for k in wanted])
