"""Lines of evidence for an independent half-period rhythm: numbers from kernels, scores as CASE expressions over them."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions import sampling
from ..functions import stats as S
from . import detect, per_series


def ladder(x: Column, *steps: tuple[str, float, float], otherwise: float = 0.0) -> Column:
    """The score of the first step whose comparison holds: (">" or "<", bound, score)."""
    out = F.lit(float(otherwise))
    for op, bound, score in reversed(steps):
        out = F.when(x > bound if op == ">" else x < bound, F.lit(float(score))).otherwise(out)
    return out


def _free(t: np.ndarray, y: np.ndarray, base: float) -> tuple[np.ndarray, np.ndarray]:
    """The three free periods of all rows of y, and their residual sums."""
    three = [base, base / 2, base / 3]
    return K.nearest_periods(t, y, three) if len(t) >= K.LATTICE_POINTS else K.free_periods(t, y, three)


def model_numbers(t: np.ndarray, y: np.ndarray, base: float, k: int = 3, found: tuple | None = None) -> dict:
    """What all classifiers need of a series' fits: criteria, amplitudes, periods, tied-phase fits and waveform measures.

    found: its free periods and their residual sum, where they were found together with others'.
    """
    n = len(y)
    three = [base, base / 2, base / 3]
    beta0, rss0 = K.fit(t, y, [base / i for i in range(1, k + 1)])
    beta, rss1 = K.fit(t, y, three)
    free, rss_free = found or [v[0] for v in _free(t, y[None], base)]
    bf, _ = K.fit_own(t, y, free.tolist())
    crit = lambda rss, p: _criteria(float(rss), n, p)
    (bic0, aicc0), (bic1, aicc1) = crit(rss0, 2 * k + 2), crit(rss_free, 2 * 3 + 2 + 3)
    tss = float(((y - y.mean()) ** 2).sum())
    b1, rss_base = K.fit(t, y, [base])
    phase = math.atan2(b1[2], b1[1])
    w = K.TWO_PI * t / base
    tied = np.column_stack([K.design(t, np.array([base])), *(np.cos(i * (w - phase)) for i in (2, 3, 4))])
    rss_tied = float(((y - tied @ np.linalg.lstsq(tied, y, rcond=None)[0]) ** 2).sum())
    b4, rss4 = K.fit(t, y, [base / i for i in range(1, 5)])
    amp4 = np.hypot(b4[1::2], b4[2::2])
    fold = np.mod(t, base) / base
    order = np.argsort(fold, kind="stable")
    f, z = fold[order], y[order]
    peak, trough = float(f[int(np.argmax(z))]), float(f[int(np.argmin(z))])
    rise = (peak - trough) % 1.0
    amp_free, phase_free = np.hypot(bf[1::2], bf[2::2]), np.arctan2(bf[2::2], bf[1::2])
    return {
        "n": n, "rss0": rss0, "rss1": rss1, "rss_free": float(rss_free), "tss": tss, "bic0": bic0, "bic_free": bic1, "aicc0": aicc0, "aicc_free": aicc1,
        "amp_24": math.hypot(beta[1], beta[2]), "amp_12": math.hypot(beta[3], beta[4]), "amp_8": math.hypot(beta[5], beta[6]), "phi_24": math.atan2(beta[2], beta[1]), "phi_12": math.atan2(beta[4], beta[3]), "phi_8": math.atan2(beta[6], beta[5]),
        "mesor": float(beta[0]), "t_free": free.tolist(), "amp_free": amp_free.tolist(), "phi_free": phase_free.tolist(), "r2_tied4": 1 - rss_tied / max(tss, 1e-10),
        "amp_base_alone": math.hypot(b1[1], b1[2]), "rss_base": rss_base, "p_tied_12": detect.phase_freedom_p(t, y, base, phase), "amp_k4": amp4.tolist(), "rss_k4": rss4, "peak_phase": peak, "rise": rise,
        "kl": float(K.divergence(beta0[: 2 * k + 1])[0]), "phase_div": float(K.divergence(beta0[: 2 * k + 1])[1]),
    }


MODEL = (
    "n int, rss0 double, rss1 double, rss_free double, tss double, bic0 double, bic_free double, aicc0 double, aicc_free double, amp_24 double, amp_12 double, amp_8 double, phi_24 double, phi_12 double, phi_8 double, "
    "mesor double, t_free array<double>, amp_free array<double>, phi_free array<double>, r2_tied4 double, amp_base_alone double, rss_base double, p_tied_12 double, amp_k4 array<double>, rss_k4 double, peak_phase double, rise double, kl double, phase_div double"
)


def _criteria(rss: float, n: int, p: int) -> tuple[float, float]:
    s2 = max(rss / n, 1e-10)
    ll = -n / 2 * math.log(K.TWO_PI * s2) - n / 2
    bic = -2 * ll + p * math.log(n)
    return bic, (-2 * ll + 2 * p + 2 * p * (p + 1) / (n - p - 1)) if n - p - 1 > 0 else bic


def models(df: DataFrame, base: float = 24.0, k: int = 3) -> DataFrame:
    """Adds the numbers of ``model_numbers``."""

    def many(t, y, _):
        return [model_numbers(t, z, base, k, found) for z, found in zip(y, zip(*_free(t, y, base), strict=True), strict=True)]

    return per_series.apply_many(df, many, MODEL)


def log_bayes_factor(small: int = 50) -> Column:
    """Half the difference of the criteria, harmonics less free periods: AICc below ``small`` points, else BIC."""
    bic = (F.col("bic0") - F.col("bic_free")) / 2
    return F.when(F.col("n") < small, (F.col("aicc0") - F.col("aicc_free")) / 2).otherwise(bic)


def interpret(log_bf: Column) -> Column:
    """The words for a log Bayes factor, cut at 5, 3, 1, 0 and the negatives."""
    return F.when(log_bf > 5, "very_strong_independent").when(log_bf > 3, "strong_independent").when(log_bf > 1, "moderate_independent").when(log_bf > 0, "weak_independent").when(log_bf > -1, "inconclusive").when(log_bf > -3, "moderate_harmonic").when(log_bf > -5, "strong_harmonic").otherwise("very_strong_harmonic")


def amplitude_ratio() -> Column:
    return F.col("amp_12") / F.greatest(F.col("amp_24"), F.lit(1e-10))


def fitted_half_period(base: float = 24.0) -> Column:
    """The free period nearest to half the base period."""
    return F.array_min(F.transform("t_free", lambda p: F.struct(F.abs(p - base / 2).alias("d"), p.alias("p"))))["p"]


def period_deviation(base: float = 24.0) -> Column:
    return F.abs(fitted_half_period(base) - base / 2) / (base / 2)


def residual_improvement() -> Column:
    gain = (F.col("rss0") - F.col("rss_free")) / F.col("rss0")
    return F.when(F.col("rss0") <= 0, 0.0).otherwise(ladder(gain, (">", 0.35, 2), (">", 0.25, 1)))


def phase_coupling(base: float = 24.0, n_points: int = 24) -> Column:
    """1 where the fitted half period's phase is far from twice the base period's (or its opposite), -1 where it is that, else 0.

    The standard error takes ``n_points`` for the number of points, as published; pass the real one to use it.
    """
    comps = F.arrays_zip(F.col("t_free").alias("p"), F.col("amp_free").alias("a"), F.col("phi_free").alias("f"))
    slow = F.filter(comps, lambda c: (F.abs(c["p"] - base) < 4) & (F.abs(c["p"] - base) < F.abs(c["p"] - base / 2)))
    fast = F.filter(comps, lambda c: (F.abs(c["p"] - base / 2) < 4) & ~((F.abs(c["p"] - base) < 4) & (F.abs(c["p"] - base) < F.abs(c["p"] - base / 2))))
    s, f = F.element_at(slow, -1), F.element_at(fast, -1)
    off = F.least(F.abs(S.angle_between(f["f"], 2 * s["f"])), F.abs(S.angle_between(f["f"], 2 * s["f"] + math.pi)))
    se = F.sqrt(F.col("rss_free") / max(n_points - 10, 1)) / F.greatest(f["a"] * math.sqrt(n_points / 2), F.lit(1e-10))
    z = off / F.greatest(se, F.lit(1e-10))
    near = F.abs(f["p"] - base / 2) / (base / 2) < 0.05
    score = F.when(se > math.pi / 4, 0.0).when((z > 3) & near, 1.0).when(z < 1, -1.0).otherwise(0.0)
    return F.when((F.size(slow) > 0) & (F.size(fast) > 0), score).otherwise(0.0)


def harmonic_r2() -> Column:
    return 1 - F.col("rss0") / F.greatest(F.col("tss"), F.lit(1e-10))


def waveform_asymmetry() -> Column:
    """-1 for a skewed waveform that harmonics explain: a peak off the symmetric phases, or a rise unlike the fall."""
    off = F.abs(F.col("peak_phase") - F.bround(F.col("peak_phase") * 2) / 2)
    rise, fall = F.col("rise"), 1 - F.col("rise")
    balance = F.when((rise > 0) & (fall > 0), F.least(rise, fall) / F.greatest(rise, fall)).otherwise(1.0)
    return F.when((F.col("n") >= 6) & ((off > 0.1) | (balance < 0.5)) & (harmonic_r2() > 0.5), -1.0).otherwise(0.0)


def harmonic_coherence() -> Column:
    """-2 or -1 where the amplitudes of three overtones follow a 1/k fall, for a strong base rhythm with a clear third harmonic."""
    a = F.col("amp_k4")
    s2 = F.col("rss_k4") / F.greatest(F.col("n") - 9, F.lit(1))
    noise = F.sqrt(2 * s2 / F.col("n"))
    ratio = a[1] / F.greatest(a[0], F.lit(1e-10))
    var = F.greatest(2 * s2 / F.col("n"), F.lit(1e-10))
    chi = sum(((a[i] - a[0] / (i + 1)) ** 2 / var for i in (1, 2, 3)), F.lit(0.0))
    gate = (a[0] > 3 * noise) & (ratio > 0.2) & (ratio < 0.8) & (a[2] > 1.5 * noise)
    return F.when(gate, ladder(chi, ("<", 4, -2), ("<", 8, -1))).otherwise(0.0)


def divergence_score() -> Column:
    """Of the spectral and phase divergence from harmonics: positive where they are far from them."""
    sid = F.col("kl") + F.col("phase_div")
    return ladder(sid, (">", 1.5, 2), (">", 0.8, 1), ("<", 0.3, -2), ("<", 0.5, -1)) + ladder(F.col("phase_div"), (">", 0.5, 1), ("<", 0.1, -1))


def divergence_test(df: DataFrame, base: float = 24.0, n: int = 499) -> DataFrame:
    """Adds sid and p_sid."""

    def fn(t, y, s):
        sid, p = K.divergence_test(t, y, base, 3, n, s)
        return {"sid": sid, "p_sid": p}

    return per_series.apply(df, fn, "sid double, p_sid double")


def _of_modes(name: str, measure, periods: list[float], base: float):
    """A field from the modes of a block of series, which are found together."""

    def fn(t, y, _):
        m = K.variational_modes(t, y, periods)
        return [{name: measure(t, z, base, {k: v[i] for k, v in m.items()})} for i, z in enumerate(y)]

    return fn


def vmd(df: DataFrame, base: float = 24.0) -> DataFrame:
    """Adds vmd (a struct of the two modes' periods, their energy ratio, deviation and lock) and vmd_score."""
    df = per_series.apply_many(df, _of_modes("vmd", K.vmd_summary, [base, base / 2, base / 3], base), "vmd struct<period_base:double,period_half:double,energy_ratio:double,deviation:double,lock:double>")
    return df.withColumn("vmd_score", vmd_score(F.col("vmd")))


def vmd_score(v: Column) -> Column:
    one = lambda c: F.when(c, 1.0).otherwise(0.0)
    e = v["energy_ratio"]
    return one(e > 0.3) + one(e > 0.6) + one(v["deviation"] > 0.02) + one(v["lock"] > 0.03) - one(e < 0.1) - one((v["lock"] < 0.02) & (e < 0.3))


def coupling(slow: Column, fast: Column) -> Column:
    """Two tracks of frequencies, of one length, to a struct: corr, ratio and ratio_sd (of fast over slow, where slow is above 0), short.

    From one sum over the points of the first and second moments. Of two steady tracks, which vary by less than a hundredth of their
    means, the correlation is 0; without three ratios the mean ratio is 0 and its spread 999.
    """
    zero = {k: F.lit(0.0) for k in ("n", "a", "b", "aa", "bb", "ab", "m", "r", "rr")}

    def add(s: Column, x: Column) -> Column:
        a, b = x["a"], x["b"]
        r = F.when(a > 1e-12, b / a)
        terms = {"n": F.lit(1.0), "a": a, "b": b, "aa": a * a, "bb": b * b, "ab": a * b, "m": F.when(r.isNotNull(), 1.0).otherwise(0.0), "r": F.coalesce(r, F.lit(0.0)), "rr": F.coalesce(r * r, F.lit(0.0))}
        return F.struct(*[(s[k] + v).alias(k) for k, v in terms.items()])

    def done(s: Column) -> Column:
        n, m = F.greatest(s["n"], F.lit(1.0)), F.greatest(s["m"], F.lit(1.0))
        var = lambda x: F.greatest(s[x + x] / n - (s[x] / n) ** 2, F.lit(0.0))
        steady = lambda x: F.sqrt(var(x)) < 0.01 * F.greatest(F.abs(s[x] / n), F.lit(1e-12))
        spread = F.sqrt(var("a") * var("b"))
        corr = F.when((steady("a") & steady("b")) | (spread <= 0), 0.0).otherwise((s["ab"] / n - s["a"] * s["b"] / (n * n)) / spread)
        enough, mean = s["m"] > 2, s["r"] / m
        sd = F.sqrt(F.greatest(s["rr"] / m - mean**2, F.lit(0.0)))
        return F.struct(corr.alias("corr"), F.when(enough, mean).otherwise(0.0).alias("ratio"), F.when(enough, sd).otherwise(999.0).alias("ratio_sd"), (s["n"] < 30).alias("short"))

    return F.aggregate(F.zip_with(slow, fast, lambda a, b: F.struct(a.alias("a"), b.alias("b"))), F.struct(*[v.alias(k) for k, v in zero.items()]), add, done)


#: Scores of a coupling, and the open bounds (from, to) within which they hold; the first that holds counts. off is the
#: distance of the mean ratio from 2, cv the ratios' spread over their mean; short and long are of tracks under and from 30 points.
COUPLING = (
    (-3, "any", {"corr": (0.8, None), "off": (None, 0.15)}),
    (-2, "any", {"corr": (0.6, None), "off": (None, 0.3)}),
    (-2, "short", {"off": (None, 0.2), "cv": (None, 0.35)}),
    (-1, "short", {"off": (None, 0.3), "cv": (None, 0.5)}),
    (2, "long", {"corr": (None, 0.2)}),
    (2, "long", {"sd": (0.5, None)}),
    (2, "any", {"off": (0.5, None)}),
    (2, "any", {"cv": (0.5, None), "off": (0.3, None)}),
    (1, "any", {"corr": (None, 0.4), "off": (0.2, None)}),
)


def coupling_score(c: Column) -> Column:
    """Of a struct of ``coupling``: -3 (the fast mode follows the slow one) to 2 (it doesn't)."""
    size = {"any": F.lit(True), "short": c["short"], "long": ~c["short"]}
    x = {"corr": c["corr"], "off": F.abs(c["ratio"] - 2), "cv": c["ratio_sd"] / F.greatest(F.abs(c["ratio"]), F.lit(1e-12)), "sd": c["ratio_sd"]}
    out = F.lit(0.0)
    for score, points, bounds in reversed(COUPLING):
        holds = size[points]
        for k, (lo, hi) in bounds.items():
            holds = holds & (x[k] > lo if lo is not None else x[k] < hi)
        out = F.when(holds, F.lit(float(score))).otherwise(out)
    return out


VMD_HILBERT = "struct<slow:array<double>,fast:array<double>,converged:boolean,amp_base:double,amp_half:double,deviation:double>"


def vmd_hilbert(df: DataFrame, base: float = 24.0) -> DataFrame:
    """Adds vh (frequencies' coupling of the two modes) and vh_score: a harmonic score is turned where the fast mode's period is off."""
    df = per_series.apply_many(df, _of_modes("vh", K.vmd_hilbert, [base, base / 2], base), f"vh {VMD_HILBERT}")
    df = df.withColumn("vh", coupled(F.col("vh")))
    return df.withColumn("vh_score", vmd_hilbert_score(F.col("vh")))


def coupled(vh: Column) -> Column:
    """The coupling of the two modes' tracks in place of the tracks."""
    c = coupling(vh["slow"], vh["fast"])
    return F.when(vh.isNotNull(), F.struct(*[c[k].alias(k) for k in ("corr", "ratio", "ratio_sd", "short")], *[vh[k].alias(k) for k in ("converged", "amp_base", "amp_half", "deviation")]))


def vmd_hilbert_score(vh: Column) -> Column:
    s = coupling_score(vh)
    return F.when((vh["deviation"] > 0.05) & (s < 0), F.greatest(s + 2, F.lit(1.0))).otherwise(s)


def instantaneous_frequency(df: DataFrame) -> DataFrame:
    """Adds inst_freq: cycles an hour at each point, from the analytic signal."""
    return per_series.apply(df, lambda t, y, _: {"inst_freq": K.instantaneous_frequency(t, y)}, "inst_freq array<double>")


def bispectrum(df: DataFrame, base: float = 24.0, n: int = 199) -> DataFrame:
    """Adds bicoherence, p_bispectral (against series of random phases), bispectral_score and bispectral_label."""

    def fn(t, y, s):
        r = K.bispectral_test(t, y, base, n, s)
        return {"bicoherence": r["bicoherence"], "p_bispectral": r["p"]}

    df = per_series.apply(df, fn, "bicoherence double, p_bispectral double")
    s = bispectral_score(F.col("p_bispectral"))
    label = F.when(s <= -2, "strong_qpc_harmonic").when(s == -1, "weak_qpc_harmonic").when(s >= 2, "no_qpc_independent").when(s == 1, "weak_no_qpc").otherwise("inconclusive")
    return df.withColumn("bispectral_score", s).withColumn("bispectral_label", label)


def bispectral_score(p: Column) -> Column:
    return ladder(p, ("<", 0.01, -3), ("<", 0.05, -2), (">", 0.5, 2), (">", 0.2, 1))


def bootstrap_lrt(df: DataFrame, base: float = 24.0, n: int = 999, k: int = 3, blocks: int = 1) -> DataFrame:
    """Adds lrt, p_lrt and lrt_label: free periods against harmonics, simulated under the harmonics.

    With several blocks a series' simulations are dealt over tasks in so many parts and their counts added: for fewer series than
    cores. The result is the same for any number of blocks. Rows of one series_id are told apart by their place in the table.
    """
    three = [base, base / 2, base / 3]
    cuts = [n * i // blocks for i in range(blocks + 1)]

    def fn(block: int):
        def run(t, y, s):
            lrt, more = K.exceeding_lrt(t, y, base, k, three, n, s, slice(cuts[block], cuts[block + 1]))
            return {"lrt": lrt, "_more": more}

        return run

    if blocks == 1:
        df = per_series.apply(df, fn(0), "lrt double, _more bigint")
    else:
        row = df.select(F.monotonically_increasing_id().alias("_row"), *[c for c in df.columns if c not in ("lrt", "_more", "p_lrt", "lrt_label", "error")])
        rest = [c for c in row.columns if c != "_row"]
        dealt = row.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        dealt = dealt.repartition(F.xxhash64("_row", "_block"))
        dealt = per_series.apply(dealt, lambda t, y, s, block: fn(block)(t, y, s), "lrt double, _more bigint", extra="_block")
        df = dealt.groupBy("_row").agg(*[F.first(c).alias(c) for c in rest], F.first("lrt").alias("lrt"), F.sum("_more").alias("_more"), F.first("error").alias("error")).drop("_row")
    df = df.withColumn("p_lrt", (F.col("_more") + 1) / (n + 1)).drop("_more")
    return df.withColumn("lrt_label", lrt_label(F.col("p_lrt")))


def lrt_label(p: Column) -> Column:
    return F.when(p < 0.01, "independent_ultradian").when(p < 0.05, "likely_independent_ultradian").when(p > 0.2, "harmonic").otherwise("ambiguous")


def savage_dickey(df: DataFrame, base: float = 24.0, method: str = "walk") -> DataFrame:
    """Adds sd_log_bf (positive: the half period is the harmonic's), sd_mean, sd_sd, sd_score, and with the walk sd_rhat and sd_ess.

    ``walk`` samples all eight parameters of two waves (mean, amplitudes, periods, phases, noise); ``period`` samples the half period alone,
    the base period fixed and the rest integrated: some ten times cheaper, and another model.
    """
    if method == "period":

        def fn(t, y, s):
            r = K.savage_dickey(t, y, base, 200, 100, s)
            return {"sd_log_bf": r["log_bf"], "sd_mean": r["mean"], "sd_sd": r["sd"]}

        df = per_series.apply(df, fn, "sd_log_bf double, sd_mean double, sd_sd double")
    else:

        def many(t, y, seeds):
            at, _ = K.nearest_periods(t, y, [base, base / 2])
            return [{f"sd_{k}": r[k] for k in ("log_bf", "mean", "sd", "rhat", "ess")} for r in sampling.savage_dickey(t, y, seeds, at, base)]

        df = per_series.apply_many(df, many, "sd_log_bf double, sd_mean double, sd_sd double, sd_rhat double, sd_ess double", least=K.LATTICE_POINTS, block=128)
    return df.withColumn("sd_score", ladder(F.col("sd_log_bf"), (">", 3, -2), (">", 1, -1), ("<", -3, 2), ("<", -1, 1)))


def amplitude_ratio_test(df: DataFrame, base: float = 24.0, n: int = 999) -> DataFrame:
    """Adds ar_ratio, p_ar and ar_label."""

    def fn(t, y, s):
        r, p = K.amplitude_ratio_test(t, y, base, 3, n, s)
        return {"ar_ratio": r, "p_ar": p}

    df = per_series.apply(df, fn, "ar_ratio double, p_ar double")
    label = F.when((F.col("ar_ratio") > 0.8) & (F.col("p_ar") < 0.05), "independent_strong_12h").when(F.col("p_ar") < 0.05, "amplitude_anomalous").otherwise("amplitude_consistent_harmonic")
    return df.withColumn("ar_label", label)


_COMPARED = "waic_tied double, waic_free double, p_waic_tied double, p_waic_free double, delta_waic double, waic_se double, base_mean double, base_sd double, period_mean array<double>, period_sd array<double>, amp_mean array<double>, rhat double, ess double, accepted double, p_24 double, p_12 double"


def model_comparison(df: DataFrame, base: float = 24.0, method: str = "hamiltonian") -> DataFrame:
    """Adds delta_waic, waic_se and waic_label, from posterior draws of tied and of free periods.

    ``hamiltonian`` samples both models whole, and adds their criteria, moments of the periods, the largest split R-hat, the smallest effective size,
    p-values of both periods and posterior_label; ``importance`` weighs draws of periods and integrates the rest, some hundred times cheaper.
    """
    if method == "importance":

        def fn(t, y, s):
            r = K.waic_of_periods(t, y, base, s)
            return {"delta_waic": r["delta_waic"], "waic_se": r["se"]}

        df = per_series.apply(df, fn, "delta_waic double, waic_se double", least=12)
    else:

        def many(t, y, seeds):
            three = [base, base / 2, base / 3]
            return [{**r, "p_24": K.component_p(t, z, three, 0), "p_12": K.component_p(t, z, three, 1)} for z, r in zip(y, sampling.compare(t, y, seeds, base), strict=True)]

        df = per_series.apply_many(df, many, _COMPARED, least=12, block=320)
        df = df.withColumn("posterior_label", posterior_label())
    z = F.col("delta_waic") / F.greatest(F.col("waic_se"), F.lit(1e-10))
    return df.withColumn("waic_label", F.when(z > 2, "independent_ultradian").when(z > 1, "likely_independent_ultradian").when(z < -1, "harmonic").otherwise("ambiguous"))


def posterior_label(alpha: float = 0.05) -> Column:
    """The label of delta_waic in its standard errors where both periods are significant; in doubt, of how far the half period's posterior is from half
    the base period's. Null where a number is."""
    z = F.when(F.col("waic_se") < 1e-6, 0.0).otherwise(F.col("delta_waic") / F.col("waic_se"))
    s24, s12 = F.col("p_24") < alpha, F.col("p_12") < alpha
    off = F.abs(F.col("period_mean")[1] - F.col("period_mean")[0] / 2) / F.greatest(F.col("period_sd")[1], F.lit(0.01))
    return (
        F.when(z.isNull() | s24.isNull() | s12.isNull(), F.lit(None).cast("string"))
        .when(~s24 & ~s12, "non_rhythmic")
        .when(~s12, "circadian_only")
        .when(~s24, "independent_ultradian")
        .when(z > 2, "independent_ultradian")
        .when(z > 1, "likely_independent_ultradian")
        .when(z < -1, "harmonic")
        .when(off > 2, "likely_independent_ultradian")
        .otherwise("ambiguous")
    )


def goodwin(df: DataFrame, base: float = 24.0) -> DataFrame:
    """Adds gw_coupling, gw_r2 and gw_score: a half-period loop that the base oscillator drives, or that runs on its own."""

    def many(t, y, seeds):
        return [{"gw_coupling": r["coupling"], "gw_r2": r["r2"]} for r in K.goodwins(t, y, base, seeds)]

    df = per_series.apply_many(df, many, "gw_coupling double, gw_r2 double", block=64)
    s = ladder(F.col("gw_coupling"), (">", 2, -2), (">", 1, -1), ("<", 0.2, 2), ("<", 0.5, 1))
    return df.withColumn("gw_score", F.when(F.col("gw_r2") < 0.3, 0.0).otherwise(s))


def replicate_phase(phases: DataFrame) -> DataFrame:
    """Replicates (series_id, phase_24, phase_12) to series_id, n, dispersion of phase_12 - 2 phase_24, and a score.

    One replicate, or none with both phases, tells nothing: dispersion 0.5, score 0.
    """
    psi = F.col("phase_12") - 2 * F.col("phase_24")
    g = phases.groupBy("series_id").agg(F.count(psi).alias("n"), F.avg(F.cos(psi)).alias("c"), F.avg(F.sin(psi)).alias("s"))
    v = F.when(F.col("n") < 2, 0.5).otherwise(1 - F.sqrt(F.col("c") ** 2 + F.col("s") ** 2))
    score = F.when(F.col("n") < 2, 0.0).otherwise(ladder(v, ("<", 0.2, -2), ("<", 0.4, -1), (">", 0.7, 2), (">", 0.5, 1)))
    return g.select("series_id", "n", v.alias("dispersion"), score.alias("replicate_score"))
