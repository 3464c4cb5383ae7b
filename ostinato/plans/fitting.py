"""Queries of fits, tests and evidence over the vectors as hourly series, and of fits over the events."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import stats as S
from ..operators import detect, evidence, fits, per_series, series
from ..streaming import rhythm
from . import inputs as I

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


COSINOR = ("mesor", "amplitude", "phase", "p_value")


def _cosinor(spark, d, key, period):
    c = fits.cosinor_long(I.events_long(spark, d, key), period)
    return c.select("series_id", "n", *[I.r6(F.col(x), x) for x in COSINOR])


_SEL = "series_id, n, " + ", ".join(I.q6(x, x) for x in COSINOR)


@query(I.cosinor_sql(I.EVENTS.format(key="user_id"), 24.0, _SEL))
def cosinor_24h(spark, d):
    return _cosinor(spark, d, "user_id", 24.0)


@query(I.cosinor_sql(I.EVENTS.format(key="user_id"), 12.0, _SEL))
def cosinor_12h(spark, d):
    return _cosinor(spark, d, "user_id", 12.0)


@query(I.cosinor_sql(I.EVENTS.format(key="event_type"), 24.0, _SEL))
def cosinor_event_type(spark, d):
    return _cosinor(spark, d, "event_type", 24.0)


_BINS = "SELECT CAST(event_type AS VARCHAR) AS series_id, floor(epoch_us(ts) / 3.6e9 / {w}) * {w} AS t, avg(value) AS value FROM events GROUP BY ALL"


@query("SELECT series_id, t, " + I.q6("value", "value") + f" FROM ({_BINS.format(w=1.0)})")
def event_bins_hourly(spark, d):
    b = series.binned(I.table(spark, d, "events"), F.col("event_type"), F.col("ts"), F.col("value"), 1.0)
    return b.select("series_id", "t", I.r6(F.col("value"), "value"))


@query("SELECT series_id, count(*) AS n, min(t) AS first_t, " + I.q6("sum(value)", "total") + f" FROM ({_BINS.format(w=2.0)}) GROUP BY series_id")
def long_to_array(spark, d):
    b = series.binned(I.table(spark, d, "events"), F.col("event_type"), F.col("ts"), F.col("value"), 2.0)
    a = series.to_array(b)
    return a.select("series_id", F.size("y").cast("long").alias("n"), F.col("t")[0].alias("first_t"), I.r6(F.aggregate("y", F.lit(0.0), lambda s, v: s + v), "total"))


@query("SELECT series_id, t, " + I.q6("y", "value") + f" FROM ({I.POINTS_SQL})")
def array_to_long(spark, d):
    return series.to_long(I.vectors(spark, d)).select("series_id", "t", I.r6(F.col("value"), "value"))


@query("SELECT series_id, t, " + I.q6("avg(y)", "value") + f" FROM (SELECT CAST(label AS VARCHAR) AS series_id, t, y FROM ({I.POINTS_SQL})) GROUP BY ALL")
def average_replicates(spark, d):
    v = series.to_long(I.vectors_with_label(spark, d).withColumn("series_id", F.col("label").cast("string")))
    return series.average_replicates(v).select("series_id", "t", I.r6(F.col("value"), "value"))


@query("SELECT series_id, count(*) AS n, " + I.q6("avg(y)", "mean") + f" FROM ({I.POINTS_SQL}) WHERE CAST(t AS INT) % 2 = 0 GROUP BY series_id")
def downsample(spark, d):
    a = series.downsample(I.vectors(spark, d), 2)
    return a.select("series_id", F.size("y").cast("long").alias("n"), I.r6(S.mean_of(F.col("y")), "mean"))


_N = I.POINTS
_CRIT = f"-2 * ({-_N / 2} * ln(2 * pi() * {{0}} / {_N}) - {_N / 2})"
_FULL = (24, 12, 8)
_RESTS = [tuple(x for x in _FULL if x != p) for p in _FULL]


def _harmonic_sql() -> str:
    crit = _CRIT.format(I.rss_sql(*_FULL))
    return I.fit_sql(_FULL) + f" SELECT series_id, {I.q6('m', 'mesor')}, {I.q6('amp24', 'A_24')}, {I.q6('amp12', 'A_12')}, {I.q6('amp8', 'A_8')}, {I.q6(I.rss_sql(*_FULL), 'rss')}, {I.q6(f'{crit} + 8 * ln({_N}.0)', 'bic')}, {I.q6(f'{crit} + 16 + 2.0 * 8 * 9 / ({_N} - 8 - 1)', 'aicc')} FROM f"


@query(_harmonic_sql())
def fit_harmonic(spark, d):
    v = fits.with_fit(I.vectors(spark, d), I.GRID, fits.harmonics(24.0, 3), "f")
    amp = [I.r6(F.col("f.components")[i]["amplitude"], f"A_{p}") for i, p in enumerate((24, 12, 8))]
    return v.select("series_id", I.r6(F.col("f.mesor"), "mesor"), *amp, *[I.r6(F.col(f"f.{x}"), x) for x in ("rss", "bic", "aicc")])


@query(I.fit_sql((24, 12, 6)) + f" SELECT series_id, {I.q6('phi24', 'phi_24')}, {I.q6('phi12', 'phi_12')}, {I.q6('phi6', 'phi_6')}, {I.q6(I.rss_sql(24, 12, 6), 'rss')} FROM f")
def fit_independent(spark, d):
    v = fits.with_fit(I.vectors(spark, d), I.GRID, [24.0, 12.0, 6.0], "f")
    return v.select("series_id", *[I.r6(F.col("f.components")[i]["phase"], f"phi_{p}") for i, p in enumerate((24, 12, 6))], I.r6(F.col("f.rss"), "rss"))


_ORDERS = [(24, 12, 8, 6)[:k] for k in range(1, 5)]


def _aicc(k: int) -> str:
    p = 2 * k + 2
    return f"{_CRIT.format(I.rss_sql(*_ORDERS[k - 1]))} + {2 * p} + {2.0 * p * (p + 1) / (_N - p - 1)!r}"


@query(I.fit_sql(*_ORDERS) + ", k AS (SELECT series_id, " + ", ".join(f"{_aicc(i)} AS k{i}" for i in range(1, 5)) + " FROM f) SELECT series_id, CASE WHEN k1 <= least(k2, k3, k4) THEN 1 WHEN k2 <= least(k3, k4) THEN 2 WHEN k3 <= k4 THEN 3 ELSE 4 END AS k_best FROM k")
def order_by_aicc(spark, d):
    return fits.order_by_aicc(I.vectors(spark, d), I.GRID).select("series_id", "k_best")


_WRAP = "({0} - 2 * pi() * floor({0} / (2 * pi())))"


@query(I.fit_sql((24, 12)) + f" SELECT series_id, {I.q6(_WRAP.format('phi24'), 'phase_24')}, {I.q6('amp24', 'amp_24')}, {I.q6(_WRAP.format('phi12'), 'phase_12')}, {I.q6('amp12', 'amp_12')} FROM f")
def batch_phases(spark, d):
    v = fits.phases(I.vectors(spark, d), I.GRID, [24.0, 12.0])
    return v.select("series_id", *[I.r6(F.col(c), c) for c in ("phase_24", "amp_24", "phase_12", "amp_12")])


@query(I.fit_sql((12,)) + f" SELECT series_id, {I.q6(_WRAP.format('phi12'), 'phase_12')} FROM f")
def single_phase(spark, d):
    return fits.single_phase(I.vectors(spark, d), I.GRID, 12.0).select("series_id", I.r6(F.col("phase_12"), "phase_12"))


def _component(p: int) -> str:
    return I.p2_sql(I.rss_sql(*[x for x in _FULL if x != p]), I.rss_sql(*_FULL), _N - 7)


@query(I.fit_sql(_FULL, *_RESTS) + " SELECT series_id, " + ", ".join(I.q6(_component(p), f"p_{p}") for p in (24, 12, 8)) + " FROM f")
def component_f_test(spark, d):
    v = I.vectors(spark, d)
    for i, p in enumerate((24, 12, 8)):
        v = detect.component_f(v, I.GRID, [24.0, 12.0, 8.0], i, f"p_{p}")
    return v.select("series_id", *[I.r6(F.col(f"p_{p}"), f"p_{p}") for p in (24, 12, 8)])


@query(I.fit_sql((24, 12), (24,)) + f" SELECT series_id, {I.q6(I.p2_sql(I.rss_sql(24), I.rss_sql(24, 12), _N - 5), 'p_harmreg')} FROM f")
def dual_harmonic_f_test(spark, d):
    return detect.harmonic_f(I.vectors(spark, d), I.GRID).select("series_id", I.r6(F.col("p_harmreg"), "p_harmreg"))


def _f_even(df1: int, df2: int, full: str) -> str:
    x = f"({full} / tss)"  # df2 / (df2 + df1 F) of an overall test
    h = df2 / 2
    terms = " + ".join(f"exp(lgamma({h + j}) - lgamma({h}) - lgamma({j + 1.0})) * pow(1 - {x}, {j})" for j in range(df1 // 2))
    return f"pow({x}, {h}) * ({terms})"


@query(I.fit_sql(_FULL) + f" SELECT series_id, {I.q6(_f_even(6, _N - 7, I.rss_sql(*_FULL)), 'hr_p')}, CASE WHEN amp24 >= greatest(amp12, amp8) THEN 24.0::DOUBLE WHEN amp12 >= amp8 THEN 12.0::DOUBLE ELSE 8.0::DOUBLE END AS hr_best FROM f")
def harmonic_regression(spark, d):
    return detect.harmonic_regression(I.vectors(spark, d), I.GRID, [24.0, 12.0, 8.0]).select("series_id", I.r6(F.col("hr_p"), "hr_p"), "hr_best")


@query(I.fit_sql((12,)) + f" SELECT series_id, {I.q6('m', 'mesor')}, {I.q6('amp12', 'amplitude')}, {I.q6('phi12', 'phase')}, {I.q6(f'((tss - {I.rss_sql(12)}) / 2) / ({I.rss_sql(12)} / {_N - 3})', 'f')}, {I.q6(I.p2_sql('tss', I.rss_sql(12), _N - 3), 'p')} FROM f")
def cosinor_grid(spark, d):
    c = detect.cosinor(I.vectors(spark, d), I.GRID, 12.0)
    return c.select("series_id", *[I.r6(F.col(f"cosinor.{x}"), x) for x in ("mesor", "amplitude", "phase", "f", "p")])


_CCT = "CASE WHEN (p1 >= 0.5) AND (p2 >= 0.5) AND (p3 >= 0.5) THEN 0.5 ELSE 0.5 - atan((" + " + ".join(f"CASE WHEN p{i} < 0.5 THEN tan((0.5 - greatest(p{i}, 1e-15)) * pi()) ELSE 0 END" for i in (1, 2, 3)) + ") / (" + " + ".join(f"CASE WHEN p{i} < 0.5 THEN 1 ELSE 0 END" for i in (1, 2, 3)) + ")) / pi() END"


@query(I.fit_sql(_FULL, *_RESTS) + ", p AS (SELECT series_id, " + ", ".join(f"{_component(x)} AS p{i}" for i, x in ((1, 24), (2, 12), (3, 8))) + f" FROM f) SELECT series_id, {I.q6(_CCT, 'p_combined')} FROM p")
def cauchy_combination(spark, d):
    v = I.vectors(spark, d)
    for i, p in enumerate((24, 12, 8)):
        v = detect.component_f(v, I.GRID, [24.0, 12.0, 8.0], i, f"p_{p}")
    return v.select("series_id", I.r6(S.cauchy_combine(F.array("p_24", "p_12", "p_8")), "p_combined"))


_BH = "least(1.0, min(p * n / r) OVER (ORDER BY p DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"


def _bh_sql(source: str, select: str) -> str:
    return f"WITH ps AS ({source}), rk AS (SELECT *, count(*) OVER (ORDER BY p RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS r, count(*) OVER () AS n FROM ps) SELECT {select.format(q=_BH)} FROM rk"


@query(_bh_sql(I.cosinor_sql(I.EVENTS.format(key="user_id"), 24.0, "series_id, p_value AS p", "WHERE p_value IS NOT NULL"), "series_id, " + I.q6("{q}", "fdr")))
def bh_fdr(spark, d):
    c = fits.cosinor_long(I.events_long(spark, d, "user_id"), 24.0).where("p_value is not null")
    return detect.bh_fdr(c, "p_value", "fdr").select("series_id", I.r6(F.col("fdr"), "fdr"))


@query(I.fit_sql(_FULL, *_RESTS) + f", c AS (SELECT *, {_component(12)} AS p FROM f), rk AS (SELECT *, count(*) OVER (ORDER BY p RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS r, count(*) OVER () AS nn FROM c) SELECT series_id, {I.q6('m', 'mesor')}, {I.q6('amp12', 'A_12')}, {I.q6('phi12', 'phi_12')}, {I.q6('p', 'p_12')}, {I.q6(_BH.replace('* n /', '* nn /'), 'fdr_12')}, {_BH.replace('* n /', '* nn /')} < 0.05 AS sig_12 FROM rk")
def detect_periods(spark, d):
    r = detect.detect(I.vectors(spark, d), I.GRID, [24.0, 12.0, 8.0])
    return r.select("series_id", *[I.r6(F.col(c), c) for c in ("mesor", "A_12", "phi_12", "p_12", "fdr_12")], "sig_12")


_LS = f"SELECT series_id, t, y - avg(y) OVER (PARTITION BY series_id) AS y FROM ({I.POINTS_SQL})"


def _lomb_sql(period: float = 12.0) -> str:
    """The delay that makes the sums of cosine times sine vanish comes from the grid; then two inner products, each over its norm."""
    w = 2 * math.pi / period
    tau = math.atan2(sum(math.sin(2 * w * t) for t in I.GRID), sum(math.cos(2 * w * t) for t in I.GRID)) / (2 * w)
    part = lambda f: f"pow(sum(y * {f}({w!r} * (t - {tau!r}))), 2) / sum(pow({f}({w!r} * (t - {tau!r})), 2))"
    return f"WITH c AS ({_LS}) SELECT series_id, {I.q6(f'({part("cos")} + {part("sin")}) / sum(y * y)', 'power')} FROM c GROUP BY series_id"


@query(_lomb_sql())
def lomb_power(spark, d):
    return detect.lomb_power(I.vectors(spark, d), I.GRID, 12.0, "power").select("series_id", I.r6(F.col("power"), "power"))


@query(I.fit_sql((12,)) + f", c AS (SELECT series_id, {I.p2_sql('tss', I.rss_sql(12), _N - 3)} AS p FROM f) SELECT series_id, CASE WHEN p >= 0.05 THEN 'non_rhythmic' ELSE 'independent_ultradian' END AS label, p < 0.05 AS has_12h FROM c")
def method_labels(spark, d):
    c = detect.cosinor(I.vectors(spark, d), I.GRID, 12.0)
    p = F.col("cosinor.p")
    return c.select("series_id", detect.method_label(p, F.lit(12.0)).alias("label"), detect.has_12h(p, F.lit(12.0)).alias("has_12h"))


_SID = """SELECT series_id, amp24*amp24 + 1e-10 AS e1, amp12*amp12 + 1e-10 AS e2, amp8*amp8 + 1e-10 AS e3, phi12 - 2*phi24 AS d2, phi8 - 3*phi24 AS d3 FROM f"""
_REF = [1 / k**2 + 1e-10 for k in (1, 2, 3)]
_KL = " + ".join(f"(e{k} / (e1 + e2 + e3)) * ln(e{k} / (e1 + e2 + e3) / {_REF[k - 1] / sum(_REF)!r})" for k in (1, 2, 3))


@query(I.fit_sql(_FULL) + f", e AS ({_SID}) SELECT series_id, {I.q6(_KL, 'kl')}, {I.q6('(e2 * (1 - cos(d2)) + e3 * (1 - cos(d3))) / (e2 + e3)', 'phase_div')} FROM e")
def spectral_divergence(spark, d):
    from ..functions import kernels as K
    import numpy as np

    proj = np.linalg.pinv(K.design(I.GRID, np.array([24.0, 12.0, 8.0])))

    def fn(t, y, _):
        kl, ph = K.divergence(proj @ y)
        return {"kl": float(kl), "phase_div": float(ph)}

    return per_series.apply(I.vectors(spark, d), fn, "kl double, phase_div double").select("series_id", I.r6(F.col("kl"), "kl"), I.r6(F.col("phase_div"), "phase_div"))


_BF = [(5, "very_strong_independent"), (3, "strong_independent"), (1, "moderate_independent"), (0, "weak_independent"), (-1, "inconclusive"), (-3, "moderate_harmonic"), (-5, "strong_harmonic")]


@query("SELECT l_orderkey, l_linenumber, CASE " + " ".join(f"WHEN x > {b} THEN '{w}'" for b, w in _BF) + " ELSE 'very_strong_harmonic' END AS interpretation FROM (SELECT l_orderkey, l_linenumber, (l_quantity - 25) / 4 AS x FROM lineitem)")
def bayes_factor_words(spark, d):
    li = I.table(spark, d, "lineitem")
    return li.select("l_orderkey", "l_linenumber", evidence.interpret((F.col("l_quantity") - 25) / 4).alias("interpretation"))


@query("WITH r AS (SELECT CAST(event_type AS VARCHAR) AS series_id, value AS a, value * value AS b FROM events WHERE value IS NOT NULL), g AS (SELECT series_id, count(*) AS n, sqrt(pow(avg(cos(b - 2*a)), 2) + pow(avg(sin(b - 2*a)), 2)) AS r FROM r GROUP BY series_id) SELECT series_id, n, " + I.q6("1 - r", "dispersion") + ", CAST(CASE WHEN 1 - r < 0.2 THEN -2 WHEN 1 - r < 0.4 THEN -1 WHEN 1 - r > 0.7 THEN 2 WHEN 1 - r > 0.5 THEN 1 ELSE 0 END AS DOUBLE) AS replicate_score FROM g")
def replicate_phase(spark, d):
    e = I.table(spark, d, "events").where("value is not null")
    r = evidence.replicate_phase(e.select(F.col("event_type").alias("series_id"), F.col("value").alias("phase_24"), (F.col("value") * F.col("value")).alias("phase_12")))
    return r.select("series_id", "n", I.r6(F.col("dispersion"), "dispersion"), "replicate_score")


@query(I.cosinor_sql("SELECT CAST(event_type AS VARCHAR) || '|' || strftime(time_bucket(INTERVAL '7 days', ts, TIMESTAMP '1970-01-01'), '%Y-%m-%d') AS series_id, epoch_us(ts) / 3.6e9 AS t, value FROM events", 24.0, "series_id, n, " + I.q6("mesor", "mesor")))
def windowed_cosinor(spark, d):
    r = rhythm.windowed_cosinor(I.table(spark, d, "events"), F.col("event_type"), "ts", F.col("value"), 24.0, "7 days", "1 day")
    return r.select(F.concat_ws("|", "series_id", F.date_format("window_start", "yyyy-MM-dd")).alias("series_id"), "n", I.r6(F.col("mesor"), "mesor"))


# --- kernels: rows only; tests/test_kernels.py holds them against brute force ----------------------------------------------------------------


@query()
def jtk_tau(spark, d):
    return detect.jtk(I.spread(spark, d)).select("series_id", "p_jtk", "tau", "jtk_period", "jtk_phase", "error")


@query()
def rain_umbrella(spark, d):
    return detect.rain(I.spread(spark, d)).select("series_id", "p_rain", "peak_fraction", "rain_shape", "error")


@query()
def nonparametric_combination(spark, d):
    return detect.nonparametric(I.spread(spark, d)).select("series_id", "p_combined", "detection_method")


@query()
def permutation_f_test(spark, d):
    return detect.permutation_f(I.spread(spark, d), [24.0, 12.0, 8.0]).select("series_id", "p_permutation")


@query()
def gate_b(spark, d):
    return detect.gate_b(I.vectors(spark, d)).select("series_id", "p_phase_freedom")


@query()
def stage1_detection(spark, d):
    return detect.stage1(I.spread(spark, d)).drop("t", "y")


@query()
def lomb_scargle(spark, d):
    return detect.lomb_scargle(I.spread(spark, d), [24.0, 12.0, 8.0]).drop("t", "y")


@query()
def jtk_cycle(spark, d):
    return detect.jtk_cycle(I.spread(spark, d)).drop("t", "y")


@query()
def rain_detector(spark, d):
    return detect.rain_detector(I.spread(spark, d)).drop("t", "y")


@query()
def matrix_pencil(spark, d):
    return detect.matrix_pencil(I.vectors(spark, d)).drop("t", "y")


@query()
def all_classical_methods(spark, d):
    return detect.all_methods(I.spread(spark, d), I.GRID)


@query()
def free_periods(spark, d):
    m = evidence.models(I.spread(spark, d))
    return m.select("series_id", "t_free", "rss_free", evidence.fitted_half_period().alias("t_12_fitted"), evidence.period_deviation().alias("deviation"), evidence.log_bayes_factor().alias("log_bf"), evidence.residual_improvement().alias("residual_improvement"), evidence.phase_coupling().alias("phase_coupling"), evidence.waveform_asymmetry().alias("waveform_asymmetry"), evidence.harmonic_coherence().alias("harmonic_coherence"), "r2_tied4")


@query()
def vmd_evidence(spark, d):
    return evidence.vmd(I.spread(spark, d)).select("series_id", "vmd", "vmd_score")


@query()
def hilbert_frequency(spark, d):
    return evidence.instantaneous_frequency(I.vectors(spark, d)).select("series_id", "inst_freq")


@query()
def vmd_hilbert_coupling(spark, d):
    return evidence.vmd_hilbert(I.spread(spark, d)).select("series_id", "vh", "vh_score")


@query()
def bispectral_coupling(spark, d):
    return evidence.bispectrum(I.vectors(spark, d)).select("series_id", "bicoherence", "p_bispectral", "bispectral_score", "bispectral_label")


@query()
def bootstrap_lrt(spark, d):
    return evidence.bootstrap_lrt(I.spread(spark, d)).select("series_id", "lrt", "p_lrt", "lrt_label")


@query()
def divergence_test(spark, d):
    return evidence.divergence_test(I.vectors(spark, d)).select("series_id", "sid", "p_sid")


@query()
def savage_dickey(spark, d):
    return evidence.savage_dickey(I.spread(spark, d)).select("series_id", "sd_log_bf", "sd_mean", "sd_sd", "sd_rhat", "sd_ess", "sd_score")


@query()
def amplitude_ratio_test(spark, d):
    return evidence.amplitude_ratio_test(I.vectors(spark, d)).select("series_id", "ar_ratio", "p_ar", "ar_label")


@query()
def waic_comparison(spark, d):
    return evidence.model_comparison(I.spread(spark, d)).select("series_id", "waic_tied", "waic_free", "p_waic_tied", "p_waic_free", "delta_waic", "waic_se", "base_mean", "base_sd", "period_mean", "period_sd", "amp_mean", "rhat", "ess", "waic_label", "posterior_label")


@query()
def goodwin_loops(spark, d):
    return evidence.goodwin(I.spread(spark, d)).select("series_id", "gw_coupling", "gw_r2", "gw_score")
