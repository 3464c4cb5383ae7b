"""Least-squares fits of cosines to many series.

On a grid that all series share, the projection (X'X)^+ X' is computed once: coefficients and residuals of a batch of series are
products of matrices in one narrow pass over Arrow batches, whatever the number of models, and what follows from them is in
expressions. On grids of their own, one-period fits come from sums over the long form; fits of more periods, and free
periods, run as NumPy kernels.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stats as S


def design(t: np.ndarray, periods: list[float]) -> np.ndarray:
    """Columns 1, cos, sin, cos, sin, ... for the periods in order."""
    w = 2 * np.pi * np.asarray(t, float)[:, None] / np.asarray(periods, float)[None, :]
    return np.column_stack([np.ones(len(t)), *(f(w[:, i]) for i in range(len(periods)) for f in (np.cos, np.sin))])


def harmonics(base: float = 24.0, k: int = 3) -> list[float]:
    return [base / i for i in range(1, k + 1)]


def _projector(t: np.ndarray, models: dict[str, list[float]], at: int):
    """Coefficients and residual sums of squares of all models for a batch of series: products of one matrix of values."""
    xs = [design(t, m) for m in models.values()]
    proj = [np.linalg.pinv(x) for x in xs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = batch.column(at)
            flat = y.flatten()
            size = np.asarray(y.value_lengths().fill_null(-1)).astype(np.int64)
            first = np.concatenate([[0], np.cumsum(np.maximum(size, 0))])
            holes = np.concatenate([[0], np.cumsum(np.asarray(flat.is_null()))])
            good = np.flatnonzero((size == len(t)) & (holes[first[1:]] == holes[first[:-1]]))
            m = np.asarray(flat.fill_null(0.0))[first[good][:, None] + np.arange(len(t))[None, :]]
            place = np.full(batch.num_rows, -1)
            place[good] = np.arange(len(good))
            take = pa.array(place, mask=place < 0)
            cols = [pa.array(((m - m.mean(axis=1, keepdims=True)) ** 2).sum(axis=1)).take(take)]
            for x, p in zip(xs, proj, strict=True):
                beta = m @ p.T
                # the residual sum of squares is taken over the residuals: the difference of two sums of squares loses digits
                rss = ((m - beta @ x.T) ** 2).sum(axis=1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(good) + 1) * beta.shape[1], pa.int32()), pa.array(beta.ravel()))
                cols += [lists.take(take), pa.array(rss).take(take)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], [*batch.schema.names, "_tss", *(f"_{c}{i}" for i in range(len(xs)) for c in ("beta", "rss"))])

    return run


def information(rss: Column, n: Column | int, n_params: Column | int) -> dict[str, Column]:
    """Gaussian likelihood and criteria of a fit with n_params parameters, the variance among them."""
    n, k = S.col(n), S.col(n_params)
    sigma2 = F.greatest(rss / n, F.lit(1e-10))
    ll = -n / 2.0 * F.log(2 * math.pi * sigma2) - n / 2.0
    bic = -2 * ll + k * F.log(n.cast("double"))
    room = n - k - 1
    aicc = F.when(room > 0, -2 * ll + 2.0 * k + 2.0 * k * (k + 1) / room).otherwise(bic)
    return {"sigma2": sigma2, "log_lik": ll, "bic": bic, "aicc": aicc}


def with_fits(df: DataFrame, t: np.ndarray, models: dict[str, list[float]], free: int = 0, y: str = "y") -> DataFrame:
    """Adds a struct for each model (a list of periods; none for the mean alone): beta, mesor, components (period, a, b, amplitude,
    phase), rss, tss, sigma2, log_lik, bic, aicc, n, n_params.

    bic counts the variance as a parameter; aicc is bic where it isn't defined. Rank-deficient grids get the fit of least norm.
    Series that are null, of another length than t, or hold a null get nulls; NaN makes NaN. One narrow pass for all models.
    """
    taken = [c for c in df.columns if c in models]
    df = df.drop(*taken)
    df = df.withColumn(y, F.col(y).cast("array<double>"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    made = ", ".join(f"_beta{i} array<double>, _rss{i} double" for i in range(len(models)))
    out = df.mapInArrow(_projector(t, models, df.columns.index(y)), f"{kept}, _tss double, {made}")
    fitted = []
    for i, (name, periods) in enumerate(models.items()):
        b, rss, k = F.col(f"_beta{i}"), F.col(f"_rss{i}"), 2 * len(periods) + 2 + free
        comps = [F.struct(F.lit(float(p)).alias("period"), b[2 * j + 1].alias("a"), b[2 * j + 2].alias("b"), F.sqrt(b[2 * j + 1] ** 2 + b[2 * j + 2] ** 2).alias("amplitude"), F.atan2(b[2 * j + 2], b[2 * j + 1]).alias("phase")) for j, p in enumerate(periods)]
        info = information(rss, len(t), k)
        fitted.append(F.struct(b.alias("beta"), b[0].alias("mesor"), F.array(*comps).alias("components"), rss.alias("rss"), F.col("_tss").alias("tss"), *[c.alias(x) for x, c in info.items()], F.lit(len(t)).alias("n"), F.lit(k).alias("n_params")).alias(name))
    return out.select(*df.columns, *fitted)


def with_fit(df: DataFrame, t: np.ndarray, periods: list[float], name: str, free: int = 0, y: str = "y") -> DataFrame:
    """Adds the struct of one model."""
    return with_fits(df, t, {name: periods}, free, y)


def order_by_aicc(df: DataFrame, t: np.ndarray, base: float = 24.0, most: int = 4) -> DataFrame:
    """Adds k_best: the number of harmonics from 1 to ``most`` with the least AICc, the smaller on ties."""
    df = with_fits(df, t, {f"_k{k}": harmonics(base, k) for k in range(1, most + 1)})
    best = F.array_min(F.array(*[F.struct(F.col(f"_k{k}.aicc").alias("aicc"), F.lit(k).alias("k")) for k in range(1, most + 1)]))
    return df.withColumn("k_best", best["k"]).drop(*[f"_k{k}" for k in range(1, most + 1)])


def phases(df: DataFrame, t: np.ndarray, periods: list[float]) -> DataFrame:
    """Adds phase_P in [0, 2 pi) and amp_P of one joint fit for all series."""
    df = with_fit(df, t, periods, "_f")
    for i, p in enumerate(periods):
        df = df.withColumn(f"phase_{p:g}", S.wrap(F.col("_f.components")[i]["phase"])).withColumn(f"amp_{p:g}", F.col("_f.components")[i]["amplitude"])
    return df.drop("_f")


def single_phase(df: DataFrame, t: np.ndarray, period: float) -> DataFrame:
    """Adds the phase and amplitude of a fit of one period alone."""
    return phases(df, t, [period])


def cosinor_long(long: DataFrame, period: float, t: str = "t", value: str = "value", keys: tuple[str, ...] = ("series_id",)) -> DataFrame:
    """One-period cosinor of each series from its long form, on any grid: n, mesor, a, b, amplitude, phase, rss, tss, f, p_value.

    One pre-aggregated shuffle of ten sums a series; the centred 2 x 2 system is solved in closed form. p is null for
    fewer than four points or a grid on which the cosine and the sine can't be told apart.
    """
    y = F.col(value).cast("double")
    w = F.col(t).cast("double") * (2 * math.pi / period)
    base = long.where(y.isNotNull() & ~F.isnan(y) & F.col(t).isNotNull()).select(*keys, F.cos(w).alias("c"), F.sin(w).alias("s"), y.alias("y"))
    total = lambda e: F.sum(F.expr(e))
    g = base.groupBy(*keys).agg(F.count("*").alias("n"), *[total(e).alias(x) for x, e in (("sc", "c"), ("ss", "s"), ("sy", "y"), ("scc", "c*c"), ("sss", "s*s"), ("scs", "c*s"), ("scy", "c*y"), ("ssy", "s*y"), ("syy", "y*y"))])
    return solve_cosinor(g).select(*keys, "n", "mesor", "a", "b", "amplitude", "phase", "rss", "tss", "f", "p_value")


def solve_cosinor(g: DataFrame) -> DataFrame:
    """The cosinor of rows of sums n, sc, ss, sy, scc, sss, scs, scy, ssy, syy."""
    e = F.expr
    g = g.select("*", e("scc - sc*sc/n").alias("cc"), e("sss - ss*ss/n").alias("dd"), e("scs - sc*ss/n").alias("cd"), e("scy - sc*sy/n").alias("cy"), e("ssy - ss*sy/n").alias("dy"), e("syy - sy*sy/n").alias("tss"))
    g = g.withColumn("det", e("cc*dd - cd*cd")).withColumn("ok", e("n > 3 AND det > 1e-9 * cc * dd AND det > 0"))
    g = g.withColumn("a", e("CASE WHEN ok THEN (cy*dd - dy*cd)/det END")).withColumn("b", e("CASE WHEN ok THEN (dy*cc - cy*cd)/det END"))
    g = g.withColumn("rss", e("greatest(0D, tss - a*cy - b*dy)")).withColumn("mesor", e("sy/n - a*sc/n - b*ss/n"))
    g = g.withColumn("amplitude", e("sqrt(a*a + b*b)")).withColumn("phase", e("atan2(b, a)"))
    g = g.withColumn("f", e("CASE WHEN rss > 0 THEN ((tss - rss)/2) / (rss/(n - 3)) END"))
    return g.withColumn("p_value", S.f_sf_2(F.col("tss"), F.col("rss"), (F.col("n") - 3).cast("double")))
