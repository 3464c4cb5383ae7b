"""The test tables in the shapes of the engine, with the SQL that builds the same."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import per_series, series

#: Components of a vector, all of which are an hourly series.
POINTS = 64
GRID = np.arange(POINTS, dtype=float)
ORIGIN = "2024-01-01"


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def vectors(spark: SparkSession, d: str, points: int = POINTS) -> DataFrame:
    """The components of each embedding as an hourly series."""
    return series.from_vectors(table(spark, d, "embeddings"), "vec_id", "embedding", points)


def spread(spark: SparkSession, d: str, points: int = POINTS) -> DataFrame:
    """The same, dealt over tasks for costly kernels."""
    return per_series.spread(vectors(spark, d, points))


def vectors_with_label(spark: SparkSession, d: str, points: int = POINTS) -> DataFrame:
    return series.from_vectors(table(spark, d, "embeddings"), "vec_id", "embedding", points, keep=("label",))


def events_long(spark: SparkSession, d: str, key: str) -> DataFrame:
    """Event values at their hours since ORIGIN."""
    e = table(spark, d, "events")
    t = series.hours(F.col("ts"), F.to_timestamp(F.lit(ORIGIN)))
    return e.select(F.col(key).cast("string").alias("series_id"), t.alias("t"), F.col("value"))


def r6(c, name: str):
    """Six decimals, no negative zero."""
    return (F.round(c, 6) + F.lit(0.0)).alias(name)


def q6(expr: str, name: str) -> str:
    return f"round({expr}, 6) + 0.0 AS {name}"


EVENTS = f"SELECT CAST({{key}} AS VARCHAR) AS series_id, (epoch_us(ts) - epoch_us(TIMESTAMP '{ORIGIN}')) / 3.6e9 AS t, value FROM events"
POINTS_SQL = f"SELECT CAST(vec_id AS VARCHAR) AS series_id, label, CAST(i AS DOUBLE) AS t, CAST(embedding[i + 1] AS DOUBLE) AS y FROM (SELECT vec_id, label, embedding, unnest(range({POINTS})) AS i FROM embeddings)"


def rss_sql(*periods: int) -> str:
    """The column of ``fit_sql`` with the residual sum of squares of a model."""
    return "rss_" + "_".join(map(str, periods)) if periods else "tss"


def fit_sql(*models: tuple[int, ...]) -> str:
    """Common table f of the vectors: series_id, label, n, tss, a column ``rss_sql`` for each model (a tuple of periods), and of the first
    model m, amp and phi of each period.

    Normal equations: inner products with cosines and sines, times the inverse of their Gram matrix, whose numbers depend on the
    grid alone; a residual sum is what the explained part leaves of the values' sum of squares.
    """
    wave = {p: [f"list_dot_product(y, list_transform(range({POINTS}), lambda t: {f}(2 * pi() * t / {p})))" for f in ("cos", "sin")] for p in sorted({p for m in models for p in m})}
    inner = ", ".join(f"{e} AS {f}{p}" for p, pair in wave.items() for f, e in zip("cs", pair, strict=True))
    parts = [f"yy - s0 * s0 / {POINTS} AS tss"]
    for i, model in enumerate(models):
        w = 2 * np.pi * GRID[:, None] / np.array(model, float)[None, :]
        x = np.column_stack([np.ones(POINTS), *(f(w[:, j]) for j in range(len(model)) for f in (np.cos, np.sin))])
        inverse = np.linalg.inv(x.T @ x)
        names = ["s0", *(f"{f}{p}" for p in model for f in "cs")]
        beta = ["(" + " + ".join(f"{float(v)!r} * {n}" for v, n in zip(row, names, strict=True)) + ")" for row in inverse]
        parts.append("yy - (" + " + ".join(f"{b} * {n}" for b, n in zip(beta, names, strict=True)) + f") AS {rss_sql(*model)}")
        if not i:
            parts.append(f"{beta[0]} AS m")
            for j, period in enumerate(model):
                c, d = beta[2 * j + 1], beta[2 * j + 2]
                parts += [f"sqrt({c} * {c} + {d} * {d}) AS amp{period}", f"atan2({d}, {c}) AS phi{period}"]
    vectors_ = f"SELECT CAST(vec_id AS VARCHAR) AS series_id, label, CAST(embedding AS DOUBLE[])[1:{POINTS}] AS y FROM embeddings WHERE len(embedding) >= {POINTS}"
    return f"WITH v AS ({vectors_}), s AS (SELECT series_id, label, list_sum(y) AS s0, list_dot_product(y, y) AS yy, {inner} FROM v), f AS (SELECT series_id, label, {POINTS} AS n, {', '.join(parts)} FROM s)"


def p2_sql(reduced: str, full: str, df2: int) -> str:
    return f"pow({full} / {reduced}, {df2 / 2})"


def cosinor_sql(source: str, period: float, select: str, tail: str = "") -> str:
    """The closed-form cosinor of a source of series_id, t, value."""
    return f"""WITH src AS ({source}), b AS (SELECT series_id, cos(t * (2 * pi() / {period})) AS c, sin(t * (2 * pi() / {period})) AS s, CAST(value AS DOUBLE) AS y FROM src WHERE value IS NOT NULL),
g AS (SELECT series_id, count(*) AS n, sum(c) AS sc, sum(s) AS ss, sum(y) AS sy, sum(c*c) AS scc, sum(s*s) AS sss, sum(c*s) AS scs, sum(c*y) AS scy, sum(s*y) AS ssy, sum(y*y) AS syy FROM b GROUP BY series_id),
h AS (SELECT *, scc - sc*sc/n AS cc, sss - ss*ss/n AS dd, scs - sc*ss/n AS cd, scy - sc*sy/n AS cy, ssy - ss*sy/n AS dy, syy - sy*sy/n AS tss FROM g),
k AS (SELECT *, CASE WHEN n > 3 AND cc*dd - cd*cd > 1e-9*cc*dd THEN (cy*dd - dy*cd)/(cc*dd - cd*cd) END AS a, CASE WHEN n > 3 AND cc*dd - cd*cd > 1e-9*cc*dd THEN (dy*cc - cy*cd)/(cc*dd - cd*cd) END AS b FROM h),
r AS (SELECT *, greatest(0, tss - a*cy - b*dy) AS rss, sy/n - a*sc/n - b*ss/n AS mesor, sqrt(a*a + b*b) AS amplitude, atan2(b, a) AS phase FROM k),
z AS (SELECT *, CASE WHEN a IS NULL THEN NULL WHEN rss <= 0 THEN 0 WHEN rss >= tss THEN 1 ELSE pow(rss/tss, (n - 3)/2.0) END AS p_value FROM r)
SELECT {select} FROM z {tail}"""
