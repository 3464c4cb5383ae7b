"""Tests for a rhythm of a given period, each alone and combined, and the classical detectors."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions import stats as S
from . import fits, per_series, ranks


def _partial(df: DataFrame, t: np.ndarray, periods: list[float], names: dict[int, str]) -> DataFrame:
    """Adds the fit of all periods as _full, and the p-values of the partial F tests of some of them, by their places."""
    for i in names:
        if not 0 <= i < len(periods):
            raise ValueError(f"no period {i} among {len(periods)}")
    rests = {f"_rest{i}": [p for j, p in enumerate(periods) if j != i] for i in names}
    df = fits.with_fits(df, t, {"_full": periods, **rests})
    df2 = F.lit(float(len(t) - 2 * len(periods) - 1))
    ps = {name: S.f_sf_2(F.col(f"_rest{i}.rss"), F.col("_full.rss"), df2) for i, name in names.items()}
    return df.withColumns(ps).drop(*rests)


def component_fs(df: DataFrame, t: np.ndarray, periods: list[float], names: dict[int, str]) -> DataFrame:
    """Adds the p-values of the partial F tests of some periods, by their places, with one pass over the series."""
    return _partial(df, t, periods, names).drop("_full")


def component_f(df: DataFrame, t: np.ndarray, periods: list[float], index: int, name: str) -> DataFrame:
    """Adds the p-value of the partial F test of one period among several, on a shared grid."""
    return component_fs(df, t, periods, {index: name})


def _tss(y: str) -> Column:
    m = S.mean_of(F.col(y))
    return F.aggregate(F.transform(y, lambda v: (v - m) * (v - m)), F.lit(0.0), lambda a, v: a + v)


def harmonic_f(df: DataFrame, t: np.ndarray, base: float = 24.0, name: str = "p_harmreg") -> DataFrame:
    """Adds the p-value of the half period beside the base period."""
    return component_f(df, t, [base, base / 2], 1, name)


def permutation_f(df: DataFrame, periods: list[float], index: int = 1, n: int = 999) -> DataFrame:
    """Adds p_permutation: the partial F test against permuted residuals of the reduced model."""
    return per_series.apply(df, lambda t, y, s: {"p_permutation": K.permutation_p(t, y, periods, index, n, s)}, "p_permutation double")


def jtk(df: DataFrame, lo: float = 10.5, hi: float = 13.5, n_phases: int = 8) -> DataFrame:
    """Adds p_jtk, tau, jtk_period, jtk_phase: the largest rank correlation with a cosine, periods one hour apart from lo."""
    periods = np.arange(lo, hi + 1.0, 1.0)

    def fn(t, y, _):
        r = K.jtk(t, y, periods, n_phases)
        return {"p_jtk": r["p"], "tau": r["tau"], "jtk_period": r["period"], "jtk_phase": r["phase"]}

    return per_series.apply(df, fn, "p_jtk double, tau double, jtk_period double, jtk_phase double", least=1)


def rain(df: DataFrame, period: float = 12.0, n_peaks: int = 9) -> DataFrame:
    """Adds p_rain, peak_fraction, rain_shape: umbrella alternatives about n_peaks peak positions."""
    fractions = np.linspace(0.1, 0.9, n_peaks)

    def fn(t, y, _):
        r = K.rain(t, y, period, fractions)
        return {"p_rain": r["p"], "peak_fraction": r["peak"], "rain_shape": r["shape"]}

    return per_series.apply(df, fn, "p_rain double, peak_fraction double, rain_shape string", least=1)


def least_p(ps: dict[str, Column]) -> tuple[Column, Column]:
    """The smallest p-value and the name of its method; the first of equal ones."""
    pick = F.array_min(F.array(*[F.struct(F.coalesce(F.nanvl(p, F.lit(1.0)), F.lit(1.0)).alias("p"), F.lit(i).alias("i"), F.lit(n).alias("n")) for i, (n, p) in enumerate(ps.items())]))
    return pick["p"], pick["n"]


def nonparametric(df: DataFrame, f_test: str | None = None) -> DataFrame:
    """Adds p_combined and detection_method: the least of the rank tests (and of a column of F test p-values)."""
    df = rain(jtk(df))
    ps = {"jtk": F.col("p_jtk"), "rain": F.col("p_rain")} | ({"ftest": F.col(f_test)} if f_test else {})
    p, name = least_p(ps)
    return df.withColumn("p_combined", p).withColumn("detection_method", name)


def bh_fdr(df: DataFrame, p: str, name: str, within: list[str] | None = None, buckets: int = ranks.BUCKETS) -> DataFrame:
    """Adds Benjamini and Hochberg's adjusted p-values; null and NaN stay null and don't count.

    Equal values are counted first, ranges of values are cut at points that sketches of each group give, and each range is scanned on its own with
    the totals of the ranges below and the least of those above: no task holds all rows. Equal p-values get equal results. The rows are
    shuffled once, and both they and the values to adjust are read from that shuffle.
    """
    keys = within or []
    ok = F.col(p).isNotNull() & ~F.isnan(p)
    df = df.withColumn("_p", F.when(ok, F.col(p)))
    shared = ranks.once(df, *keys, "_p")
    return ranks.meet(shared, _adjusted(shared, "_p", name, keys, buckets), [*keys, "_p"], name, how="left").drop("_p")


def _adjusted(df: DataFrame, p: str, name: str, keys: list[str], buckets: int = ranks.BUCKETS) -> DataFrame:
    """keys and _p, each distinct p-value, to its adjusted value."""
    # a condition on counts isn't moved below the shuffle that the rows themselves are read from
    counts = df.groupBy(*keys, F.col(p).alias("_p")).agg(F.count_if(F.col(p).isNotNull() & ~F.isnan(p)).alias("_c")).where("_c > 0")
    r = ranks.running(counts, "_p", {"_r": F.col("_c")}, keys, buckets, keep=True).withColumn("_q", F.col("_p") * F.col("_r_all") / (F.col("_r") + F.col("_c")))
    return ranks.least_above(r, "_p", "_q", keys, buckets).select(*keys, "_p", F.least(F.lit(1.0), "_least").alias(name))


def gate_b(df: DataFrame, base: float = 24.0) -> DataFrame:
    """Adds p_phase_freedom: whether the half period's phase is other than twice the base period's."""

    def fn(t, y, _):
        return {"p_phase_freedom": phase_freedom_p(t, y, base)}

    return per_series.apply(df, fn, "p_phase_freedom double")


def phase_freedom_p(t: np.ndarray, y: np.ndarray, base: float, phase: float | None = None) -> float:
    """P of one degree of freedom: free phase at the half period against a phase tied to that of the base period."""
    beta, free = K.fit(t, y, [base, base / 2])
    phase = math.atan2(beta[2], beta[1]) if phase is None else phase
    # the tied wave is a sum of the half period's cosine and sine; of both, and of y, what the base period leaves
    x, inverse = K.solver(t, [base])
    half = K.solver(t, [base / 2])[0][:, 1:] @ np.array([math.cos(2 * phase), math.sin(2 * phase)])
    rest, wave = y - x @ (inverse @ y), half - x @ (inverse @ half)
    size = float(wave @ wave)
    tied = float(rest @ rest) - (float(rest @ wave) ** 2 / size if size > 1e-20 * len(y) else 0.0)
    df = len(y) - 5
    return K.f1_p((tied - free) / (free / df), df) if df > 0 and free > 0 and tied >= free else 1.0


def stage1_numbers(t: np.ndarray, y: np.ndarray, base: float) -> dict:
    """The p-values that the first stage combines: partial F, rank correlation, umbrella, harmonic regression, and the base period's."""
    three = [base, base / 2, base / 3]
    return {
        "p_ftest": K.component_p(t, y, three, 1),
        "p_jtk": K.jtk(t, y, np.arange(11.5, 13.5, 1.0), 8)["p"],
        "p_rain": K.rain(t, y, base / 2, np.linspace(0.1, 0.9, 9))["p"],
        "p_harmreg": K.component_p(t, y, [base, base / 2], 1),
        "p_24": K.component_p(t, y, three, 0),
        "p_phase_freedom": phase_freedom_p(t, y, base),
    }


STAGE1 = "p_ftest double, p_jtk double, p_rain double, p_harmreg double, p_24 double, p_phase_freedom double"


def stage1(df: DataFrame, base: float = 24.0, alpha: Column | float | None = None, min_methods: int = 2, gate: bool = True) -> DataFrame:
    """Adds the first stage: six p-values, p_detect, best_detector, strength, waveform_hint, passed, stage1_class, p_gate_b.

    alpha is 0.05 from 48 points on, 0.10 from 30 on, else 0.20, unless given. A series passes if the combined p is below alpha
    and at least ``min_methods`` of its four p-values are below 0.1. The gate is informative: it never blocks.
    """
    df = per_series.apply(df, lambda t, y, _: stage1_numbers(t, y, base), STAGE1)
    return stage1_rules(df, F.size("y"), alpha, min_methods, gate)


def stage1_rules(df: DataFrame, n: Column, alpha: Column | float | None = None, min_methods: int = 2, gate: bool = True) -> DataFrame:
    """The first stage's decisions, from columns of its six p-values and the number of points."""
    alpha = F.when(n >= 48, 0.05).when(n >= 30, 0.10).otherwise(0.20) if alpha is None else S.col(alpha)
    four = {k: F.col(f"p_{k}") for k in ("ftest", "jtk", "rain", "harmreg")}
    df = df.withColumn("p_detect", S.cauchy_combine(F.array(*four.values())))
    _, best = least_p(four)
    few = sum((F.when(p < 0.1, 1).otherwise(0) for p in four.values()), F.lit(0)) < min_methods
    ranked = F.least("p_jtk", "p_rain")
    hint = F.when((ranked < 0.05) & (F.col("p_ftest") > 0.10), "non_sinusoidal").when(F.col("p_ftest") < 0.05, "sinusoidal").otherwise("unknown")
    strong = F.col("p_detect") < alpha
    hopeless = (F.col("p_24") > 0.5) & (F.col("p_detect") > 0.5)
    passed = strong & ~few & ~hopeless
    label = F.when(hopeless, "non_rhythmic").when((F.col("p_24") < 0.05) & ~passed, "circadian_only").when(passed, "has_12h").otherwise("non_rhythmic")
    df = df.withColumn("best_detector", best).withColumn("waveform_hint", hint).withColumn("detection_strength", -F.log10(F.greatest("p_detect", F.lit(1e-20))))
    df = df.withColumn("passed", passed).withColumn("stage1_class", label)
    return df.withColumn("p_gate_b", F.when(F.lit(gate) & strong & (F.col("p_24") < 0.05), F.col("p_phase_freedom")))


# --- classical detectors -------------------------------------------------------------------------------------------


def lomb_scargle(df: DataFrame, periods: list[float], n_bootstrap: int = 200) -> DataFrame:
    """Adds ls_period, ls_power, ls_p, ls_amplitude: the strongest of the periods, p from permuted series."""

    def fn(t, y, _):
        r = K.lomb(t, y, periods, n_bootstrap)
        return {"ls_period": r["period"], "ls_power": r["power"], "ls_p": r["p"], "ls_amplitude": r["amplitude"]}

    return per_series.apply(df, fn, "ls_period double, ls_power double, ls_p double, ls_amplitude double")


def lomb_power(df: DataFrame, t: np.ndarray, period: float, name: str) -> DataFrame:
    """Adds the normalised power at a period on a shared grid, as an expression: two inner products over the centred series."""
    w = 2 * math.pi / period
    tau = math.atan2(np.sin(2 * w * t).sum(), np.cos(2 * w * t).sum()) / (2 * w)
    c, s = np.cos(w * (t - tau)), np.sin(w * (t - tau))
    mean = S.mean_of(F.col("y"))
    dot = lambda v: S.dot(F.col("y"), v.tolist()) - mean * float(v.sum())
    return df.withColumn(name, (dot(c) ** 2 / float((c * c).sum()) + dot(s) ** 2 / float((s * s).sum())) / _tss("y"))


def cosinor(df: DataFrame, t: np.ndarray, period: float = 12.0, name: str = "cosinor") -> DataFrame:
    """Adds a struct: mesor, amplitude, phase, rss, tss, f, p of one period, on a shared grid. A perfect fit has p = 0."""
    df = fits.with_fit(df, t, [period], "_f").withColumn("_tss", F.col("_f.tss"))
    n = float(len(t))
    c = F.col("_f.components")[0]
    out = F.struct(F.col("_f.mesor").alias("mesor"), c["amplitude"].alias("amplitude"), c["phase"].alias("phase"), F.col("_f.rss").alias("rss"), F.col("_tss").alias("tss"), F.when(F.col("_f.rss") > 0, S.f_stat(F.col("_tss"), F.col("_f.rss"), 2, F.lit(n - 3))).alias("f"), S.f_sf_2(F.col("_tss"), F.col("_f.rss"), F.lit(n - 3)).alias("p"))
    return df.withColumn(name, out).drop("_f", "_tss")


def harmonic_regression(df: DataFrame, t: np.ndarray, periods: list[float]) -> DataFrame:
    """Adds hr_p (overall F test), hr_best (period of the largest amplitude), hr_components: period, amplitude, phase, p of each."""
    n, k = len(t), len(periods)
    df = _partial(df, t, periods, {i: f"_p{i}" for i in range(k)}).withColumnRenamed("_full", "_f").withColumn("_tss", F.col("_f.tss"))
    comps = F.array(*[F.struct(F.lit(float(p)).alias("period"), F.col("_f.components")[i]["amplitude"].alias("amplitude"), F.col("_f.components")[i]["phase"].alias("phase"), F.col(f"_p{i}").alias("p")) for i, p in enumerate(periods)])
    df2 = F.lit(float(n - 2 * k - 1))
    overall = S.f_sf_even(S.f_stat(F.col("_tss"), F.col("_f.rss"), 2 * k, df2), F.lit(float(2 * k)), df2)
    best = F.array_max(F.transform("hr_components", lambda c, i: F.struct(c["amplitude"].alias("a"), (-i).alias("i"), c["period"].alias("period"))))
    return df.withColumn("hr_p", overall).withColumn("hr_components", comps).withColumn("hr_best", best["period"]).drop("_f", "_tss", *[f"_p{i}" for i in range(k)])


def jtk_cycle(df: DataFrame, lo: float = 10.0, hi: float = 14.0, step: float = 0.5, n_phases: int = 24) -> DataFrame:
    """Adds jc_p, jc_tau, jc_period, jc_amplitude (of a cosine fit at that period)."""
    periods = np.arange(lo, hi + step / 2, step)

    def fn(t, y, _):
        r = K.jtk(t, y, periods, n_phases)
        beta, _ = K.fit(t, y, [r["period"]])
        return {"jc_p": r["p"], "jc_tau": r["tau"], "jc_period": r["period"], "jc_amplitude": math.hypot(beta[1], beta[2])}

    return per_series.apply(df, fn, "jc_p double, jc_tau double, jc_period double, jc_amplitude double")


def rain_detector(df: DataFrame, period: float = 12.0, n_peaks: int = 17) -> DataFrame:
    """Adds rn_p, rn_peak, rn_shape, rn_amplitude."""
    fractions = np.linspace(0.1, 0.9, n_peaks)

    def fn(t, y, _):
        r = K.rain(t, y, period, fractions)
        beta, _ = K.fit(t, y, [period])
        return {"rn_p": r["p"], "rn_peak": r["peak"], "rn_shape": r["shape"], "rn_amplitude": math.hypot(beta[1], beta[2])}

    return per_series.apply(df, fn, "rn_p double, rn_peak double, rn_shape string, rn_amplitude double")


def matrix_pencil(df: DataFrame, base: float = 24.0) -> DataFrame:
    """Adds mp_periods, mp_damping (strongest pole first), mp_has_12h (a period from 10 to 14), mp_p (partial F test)."""

    def fn(t, y, _):
        r = K.pencil(t, y)
        return {"mp_periods": r["periods"], "mp_damping": r["damping"], "mp_has_12h": any(10 < p < 14 for p in r["periods"]), "mp_p": K.component_p(t, y, [base, base / 2, base / 3], 1)}

    return per_series.apply(df, fn, "mp_periods array<double>, mp_damping array<double>, mp_has_12h boolean, mp_p double")


def all_methods(df: DataFrame, t: np.ndarray) -> DataFrame:
    """A row for each series and classical method: series_id, method, p, period, amplitude."""
    row = lambda d, m, p, period, a: d.select("series_id", F.lit(m).alias("method"), p.cast("double").alias("p"), period.cast("double").alias("period"), a.cast("double").alias("amplitude"))
    base = df.select("series_id", "t", "y")
    c = cosinor(base, t, 12.0)
    h = harmonic_regression(base, t, [24.0, 12.0, 8.0])
    twelve = F.filter("hr_components", lambda x: x["period"] == 12.0)[0]
    parts = [
        row(lomb_scargle(base, [24.0, 12.0, 8.0]), "lomb_scargle", F.col("ls_p"), F.col("ls_period"), F.col("ls_amplitude")),
        row(c, "cosinor", F.col("cosinor.p"), F.lit(12.0), F.col("cosinor.amplitude")),
        row(h, "harmonic_regression", twelve["p"], F.lit(12.0), twelve["amplitude"]),
        row(jtk_cycle(base), "jtk_cycle", F.col("jc_p"), F.col("jc_period"), F.col("jc_amplitude")),
        row(rain_detector(base), "rain", F.col("rn_p"), F.lit(12.0), F.col("rn_amplitude")),
        row(matrix_pencil(base), "matrix_pencil", F.col("mp_p"), F.get(F.col("mp_periods"), F.lit(0)), F.lit(None)),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def detect(df: DataFrame, t: np.ndarray, periods: list[float], alpha: float = 0.05) -> DataFrame:
    """series_id, mesor, and for each period A_, phi_, p_, fdr_ and sig_ (fdr below alpha), named by the rounded period.

    Periods that round to one name are refused: their columns would overwrite each other.
    """
    names = [f"{p:.0f}" for p in periods]
    if len(set(names)) < len(names):
        raise ValueError(f"periods {periods} have the names {names}")
    df = _partial(df, t, periods, {i: f"p_{n}" for i, n in enumerate(names)})
    c = F.col("_full.components")
    new = {"mesor": F.col("_full.mesor")} | {f"{k}_{n}": c[i][x] for i, n in enumerate(names) for k, x in (("A", "amplitude"), ("phi", "phase"))}
    base = df.withColumns(new).drop("_full", "t", "y")
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("k"), F.col(f"p_{n}").alias("p")) for n in names]))
    long = base.withColumn("_row", F.monotonically_increasing_id()).withColumn("_x", each).withColumns({"_k": F.col("_x.k"), "_p": F.col("_x.p")}).drop("_x")
    adjusted = _adjusted(long.select("_k", "_p"), "_p", "_q", ["_k"])
    met = ranks.meet(long, adjusted, ["_k", "_p"], "_q", how="left")
    fdr = [F.max(F.when(F.col("_k") == n, F.col("_q"))).alias(f"fdr_{n}") for n in names]
    out = met.groupBy("_row").agg(*[F.first(c).alias(c) for c in base.columns], *fdr).drop("_row")
    return out.withColumns({f"sig_{n}": F.col(f"fdr_{n}") < alpha for n in names})


def has_12h(p: Column, period: Column, alpha: float = 0.05) -> Column:
    """A method's answer: significant, with a period between 10 and 14 hours."""
    return (p < alpha) & (period > 10) & (period < 14)


def method_label(p: Column, period: Column) -> Column:
    """The label that a classical method's answer stands for."""
    return F.when(F.coalesce(p, F.lit(1.0)) >= 0.05, "non_rhythmic").when(F.abs(period - 12) < 2, "independent_ultradian").when(F.abs(period - 24) < 4, "circadian_only").otherwise("ambiguous")
