"""Classifiers: decision trees as CASE expressions over inspectable evidence columns.

Cheap tests come first and only the series that pass them pay for simulation: each expensive kernel runs on a filtered
branch, spread anew over the cluster because its cost isn't, and the branches are united.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K
from . import detect, evidence, per_series
from .evidence import ladder

LABELS = ("independent_ultradian", "likely_independent_ultradian", "harmonic", "circadian_only", "non_rhythmic", "ambiguous", "damped_ultradian", "multi_ultradian")


@dataclass(frozen=True)
class Config:
    """Thresholds of the two-stage classifier; unknown names are refused."""

    base: float = 24.0
    alpha: float | None = None
    independent: float = 0.6
    likely: float = 0.3
    harmonic: float = -0.6
    likely_harmonic: float = -0.3
    divisor: float = 4.0
    n_bootstrap: int = 199
    vmd_gate_strong: float = 0.10
    vmd_gate: float = 0.15
    small_n: int = 50
    k: int = 3
    bispectral_nonsin: float = 0.5
    asymmetry_gate: float = 0.5
    r2_discount: float = 0.5
    dominance_p: float = 0.001
    dominance_r2: float = 0.6
    dominance: float = -3.0
    min_methods: int = 2
    gate_b: bool = True

    @classmethod
    def of(cls, **kw) -> Config:
        unknown = set(kw) - {f.name for f in fields(cls)}
        if unknown:
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        return cls(**kw)

    @classmethod
    def for_tissue(cls, tissue: str = "default", n: int | None = None) -> Config:
        """The settings of a tissue's family, and of a number of points; tissues of no family have the defaults."""
        family = FAMILY.get(tissue.lower().strip(), "")
        changes = dict(PRESETS.get(family, {}))
        if n is not None:
            changes["alpha"] = next(a for least, a in ALPHA_BY_POINTS if n >= least)
            changes |= FEW_POINTS.get(family, {}) if n < FEW else {}
        return cls(**changes)


#: The families of tissues, and the settings in which they differ from the defaults.
FAMILY = {name: family for family, names in {
    "cultured": ("cell_line", "fibroblast", "in_vitro"),
    "contractile": ("heart", "muscle", "skeletal_muscle"),
    "reproductive": ("ovary", "oviduct", "reproductive", "uterus"),
    "weak": ("adipose", "kidney", "peripheral", "weak_rhythm"),
}.items() for name in names}
PRESETS = {
    "cultured": {"independent": 0.5, "likely": 0.2, "likely_harmonic": -0.2, "harmonic": -0.5, "vmd_gate": 0.10},
    "contractile": {"likely": 0.35, "likely_harmonic": -0.25, "harmonic": -0.55},
    "reproductive": {"independent": 0.5, "likely": 0.25, "vmd_gate": 0.12},
    "weak": {"independent": 0.5, "likely": 0.25, "vmd_gate": 0.12, "bispectral_nonsin": 0.3},
}
#: Significance level by the number of points from which on it holds; and what few points change in a family.
ALPHA_BY_POINTS = ((48, 0.05), (30, 0.10), (0, 0.20))
FEW, FEW_POINTS = 30, {"reproductive": {"alpha": 0.5}}


def _damped(x: Column) -> Column:
    """Positive evidence counts less where tied harmonics explain the series anyway."""
    r2 = F.col("r2_tied4")
    return F.when((x > 0) & (r2 > 0.9), 0.0).when((x > 0) & (r2 > 0.8), x * 0.5).otherwise(x)


EVIDENCE = ("phase_freedom", "period_deviation", "amplitude_ratio", "residual_improvement", "vmd_hilbert", "bispectral", "phase_coupling", "bootstrap_lrt", "waveform_asymmetry", "harmonic_coherence", "h24_dominance", "waveform_fit")


def _inputs(c: Config) -> dict[str, Column]:
    """What several lines read, from the fits alone: columns of their own before the modes are found, so that no line repeats another's terms."""
    ratio = evidence.amplitude_ratio()
    return {"amp_ratio": ratio, "rel_dev": evidence.period_deviation(c.base), "r2_m0": evidence.harmonic_r2(), "_gain": evidence.residual_improvement(), "_coupling": evidence.phase_coupling(c.base), "_coherence": evidence.harmonic_coherence(), "_asymmetry": F.when(ratio < c.asymmetry_gate, evidence.waveform_asymmetry()).otherwise(0.0)}


def _none_above_0(x: Column, where: Column) -> Column:
    """x, or 0 where the condition holds and it is above 0."""
    return F.least(x, F.when(where, 0.0).otherwise(float("inf")))


def _evidence(c: Config) -> dict[str, Column]:
    """The twelve lines, from the columns of the first stage, the fits, their inputs and the simulations."""
    ratio, dev, r2k4, r2 = F.col("amp_ratio"), F.col("rel_dev"), F.col("r2_tied4"), F.col("r2_m0")
    e: dict[str, Column] = {}
    e["phase_freedom"] = F.when(F.col("p_gate_b").isNull(), 0.0).otherwise(ladder(F.col("p_gate_b"), (">", 0.5, -2.5), (">", 0.3, -1.5), (">", 0.1, -0.5)))
    e["period_deviation"] = F.when(dev > 0.05, 1.0).when((dev > 0.02) & (r2k4 < 0.85), 0.5).otherwise(0.0)
    e["amplitude_ratio"] = F.when(ratio > 0.8, F.when(r2k4 > 0.6, 0.0).otherwise(3.0)).when(ratio > 0.5, F.when(r2k4 > 0.7, 0.0).otherwise(1.0)).otherwise(ladder(ratio, ("<", 0.25, -2), ("<", 0.4, -1)))
    e["residual_improvement"] = _damped(F.col("_gain"))
    s = F.least(F.col("vh_score"), F.lit(2.0))
    modes = F.col("vh.amp_half") / F.greatest(F.col("vh.amp_base"), F.lit(1e-10))
    gate = F.when(F.col("detection_strength") > 2, c.vmd_gate_strong).otherwise(c.vmd_gate)
    fade = F.greatest(F.lit(0.0), 1 - (r2k4 - 0.5) / 0.3)
    s = F.when((s > 0) & F.col("vh.converged"), F.when(modes < gate, 0.0).otherwise(s * fade)).otherwise(s)
    long = F.col("n") >= 48
    e["vmd_hilbert"] = F.when(long & F.col("vh").isNotNull(), s).otherwise(0.0)
    b = ladder(F.col("bic_value"), (">", 0.7, -2), (">", 0.5, -1), ("<", 0.3, 1))
    b = F.when((F.col("waveform_hint") == "non_sinusoidal") & (b < 0), b * c.bispectral_nonsin).otherwise(b)
    e["bispectral"] = F.when(long & F.col("bic_value").isNotNull(), F.when(F.col("n") < 96, b * 0.5).otherwise(b)).otherwise(0.0)
    e["phase_coupling"] = F.col("_coupling")
    e["bootstrap_lrt"] = F.when(F.col("p_lrt").isNull(), 0.0).otherwise(_damped(ladder(F.col("p_lrt"), ("<", 0.01, 2), ("<", 0.05, 1), (">", 0.5, -1))))
    e["waveform_asymmetry"] = F.col("_asymmetry")
    # a skewed waveform explains a deviating period
    explained = (e["waveform_asymmetry"] < 0) & (r2 > c.r2_discount)
    e["period_deviation"] = _none_above_0(e["period_deviation"], explained)
    e["harmonic_coherence"] = F.col("_coherence")
    coherent = e["harmonic_coherence"] <= -1
    for k in ("vmd_hilbert", "bootstrap_lrt", "period_deviation", "residual_improvement", "amplitude_ratio"):
        e[k] = _none_above_0(e[k], coherent)
    fall = F.when(ratio <= 0.2, c.dominance).when(ratio < 0.5, c.dominance * (0.5 - ratio) / 0.3).otherwise(0.0)
    e["h24_dominance"] = F.when((F.col("p_24") < c.dominance_p) & (r2 > c.dominance_r2), fall).otherwise(0.0)
    floor = F.sqrt(2 * F.col("rss_base") / F.col("n") / F.col("n"))
    w = F.when(F.col("amp_base_alone") < 2 * floor, 1.0).otherwise(ladder(F.col("p_tied_12"), ("<", 0.01, 2), ("<", 0.05, 1), (">", 0.5, -3), (">", 0.3, -1.5)))
    e["waveform_fit"] = _none_above_0(w, coherent)
    return e


def _stage2_modes(base: float):
    def fn(t, y, _):
        if len(y) < 48:
            return {}
        return {"vh": K.vmd_hilbert(t, y, base), "bic_value": float(K.bicoherence(t, y, base)[0])}

    return fn


def two_stage(df: DataFrame, config: Config | None = None, partitions: int | None = None) -> DataFrame:
    """Detect, then disentangle: series_id, the first stage's columns, evidence (a struct of twelve), evidence_score, confidence,
    classification, error.

    Series that the first stage ends keep no evidence. Of the others all are fitted, and only those whose period deviates or
    whose gate is in doubt are simulated.
    """
    c = config or Config()
    first = detect.stage1(df, c.base, c.alpha, c.min_methods, c.gate_b)
    keep = ["series_id", "p_ftest", "p_jtk", "p_rain", "p_harmreg", "p_24", "p_detect", "best_detector", "waveform_hint", "detection_strength", "passed", "stage1_class", "p_gate_b"]
    kind = "struct<" + ",".join(f"{k}:double" for k in EVIDENCE) + ">"
    none = {"evidence": F.lit(None).cast(kind), "evidence_score": F.lit(0.0), "confidence": F.lit(0.0)}
    ended = first.where((F.col("stage1_class") != "has_12h") | F.col("error").isNotNull())
    ended = ended.select(*keep, *[v.alias(k) for k, v in none.items()], F.when(F.col("error").isNotNull(), "error").otherwise(F.col("stage1_class")).alias("classification"), "error")
    rest = first.where((F.col("stage1_class") == "has_12h") & F.col("error").isNull())
    rest = per_series.spread(rest, partitions)
    m = evidence.models(rest, c.base, c.k)
    m = per_series.apply(m.withColumns(_inputs(c)), _stage2_modes(c.base), f"vh {evidence.VMD_HILBERT}, bic_value double").withColumn("vh", evidence.coupled(F.col("vh")))
    m = m.withColumn("vh_score", evidence.vmd_hilbert_score(F.col("vh"))).withColumn("simulate", (F.col("rel_dev") > 0.01) | F.coalesce(F.col("p_gate_b").between(0.05, 0.2), F.lit(False)))
    three = [c.base, c.base / 2, c.base / 3]
    # the flag travels with the series, so that one pass serves both kinds
    m = m.withColumn("_y", F.col("y")).withColumn("y", F.when(F.col("simulate"), F.col("y")))
    m = per_series.apply(m.withColumnRenamed("error", "_error"), lambda t, y, s: {"p_lrt": K.bootstrap_lrt(t, y, c.base, c.k, three, c.n_bootstrap, s)[1]}, "p_lrt double")
    lines = _evidence(c)
    m = m.select(*keep, F.struct(*[lines[k].cast("double").alias(k) for k in EVIDENCE]).alias("evidence"))
    m = m.withColumn("evidence_score", F.aggregate(F.array(*[F.col(f"evidence.{k}") for k in EVIDENCE]), F.lit(0.0), lambda s, x: s + x))
    m = m.withColumn("confidence", F.tanh(F.col("evidence_score") / c.divisor))
    conf = F.col("confidence")
    label = F.when(conf >= c.independent, "independent_ultradian").when(conf >= c.likely, "likely_independent_ultradian").when(conf <= c.likely_harmonic, "harmonic").otherwise("ambiguous")
    done = m.select(*keep, "evidence", "evidence_score", "confidence", label.alias("classification"), F.lit(None).cast("string").alias("error"))
    return ended.unionByName(done)


# --- one-stage classifiers -----------------------------------------------------------------------------------------


def _bf_points(log_bf: Column) -> Column:
    bf = F.exp(log_bf)
    return ladder(bf, (">", 3, 2), (">", 1, 1), ("<", 0.05, -2), ("<", 1, -1))


def _common_points(base: float) -> Column:
    """What the hard-gated and the soft-gated trees share."""
    dev = F.col("rel_dev")
    period = F.when(dev > 0.05, 3.0).when(dev > 0.02, 2.0).otherwise(-1.0)
    ratio = ladder(F.col("amp_ratio"), (">", 0.8, 3), (">", 0.65, 2), (">", 0.5, 1), ("<", 0.25, -2), ("<", 0.5, -1))
    boot = F.when(F.col("p_lrt").isNull(), 0.0).otherwise(ladder(F.col("p_lrt"), ("<", 0.01, 2), ("<", 0.05, 1), (">", 0.5, -2), (">", 0.3, -1)))
    return _bf_points(F.col("log_bf")) + period + ratio + evidence.residual_improvement() + boot + evidence.phase_coupling(base) + evidence.waveform_asymmetry()


def hard_gated(base: float = 24.0, alpha: float = 0.05) -> Column:
    """The first tree: significance of both periods decides first, a sum of points the rest."""
    p24, p12 = F.coalesce(F.col("p_24"), F.lit(1.0)), F.coalesce(F.col("p_12"), F.lit(1.0))
    s = _common_points(base)
    tree = F.when(s >= 4, "independent_ultradian").when(s >= 2, "likely_independent_ultradian").when(s <= -2, "harmonic").otherwise("ambiguous")
    return F.when((p24 >= alpha) & (p12 >= alpha), "non_rhythmic").when((p24 < alpha) & (p12 >= alpha), "circadian_only").when((p12 < alpha) & (p24 >= alpha), "independent_ultradian").otherwise(tree)


def weight_of_p(p: Column) -> Column:
    return F.least(-F.log10(F.greatest(p, F.lit(1e-20))) / 1.3, F.lit(1.0))


def soft_gated(base: float = 24.0) -> Column:
    """The second tree: points weigh as much as the half period's p-value says, after four hopeless or clear cases."""
    p24, p12, ratio = F.col("p_24"), F.col("p_12"), F.col("amp_ratio")
    w12, w24 = weight_of_p(p12), weight_of_p(p24)
    s = F.when((p24 < 1e-6) & (ratio < 0.4), -2.0).when((p24 < 1e-4) & (ratio < 0.7), -1.5).otherwise(0.0)
    s = s + (_common_points(base) + evidence.vmd_score(F.col("vmd")) + evidence.divergence_score()) * w12 + ladder(p12, ("<", 0.01, 1.5), ("<", 0.05, 0.5))
    s = F.when((p24 > 0.1) & (p12 > 0.1), F.least(s, F.lit(1.0))).otherwise(s)
    tree = F.when(s >= 4.5, "independent_ultradian").when(s >= 2.5, "likely_independent_ultradian").when(s <= -2, "harmonic").when((w24 > 0.5) & (w12 < 0.5) & (s < 0), "circadian_only").otherwise("ambiguous")
    return (
        F.when((p24 > 0.5) & (p12 > 0.5), "non_rhythmic")
        .when((p12 > 0.5) & (ratio < 0.15), "circadian_only")
        .when((p24 < 0.001) & (ratio < 0.3), "harmonic")
        .when((p24 > 0.5) & (p12 < 0.05), "independent_ultradian")
        .otherwise(tree)
    )


def analytic(df: DataFrame, base: float = 24.0, version: int = 2, n_bootstrap: int = 199, n_perm: int = 499, use_savage_dickey: bool = False, every: bool = False) -> DataFrame:
    """One-stage analysis: fits, log_bf, interpretation, p_24, p_12, t_12_fitted, t_12_deviation, amplitudes and phases, p_lrt,
    classification, error.

    Series with a Bayes factor in doubt (its log within 3) are simulated; with version 2 a half period's p-value between 0.02 and
    0.15 is replaced by a permutation's. With Savage and Dickey's ratio its sign is turned to the other's. With ``every`` all series are
    simulated, once, and lrt, p_lrt and lrt_label are given for all; the classification heeds them only where the factor is in doubt.
    """
    three = [base, base / 2, base / 3]

    def tests(t, y, s):
        out = {"p_24": K.component_p(t, y, three, 0), "p_12": K.component_p(t, y, three, 1), "p_12_raw": K.component_p(t, y, three, 1)}
        if version == 2 and 0.02 <= out["p_12"] <= 0.15:
            out["p_12"] = K.permutation_p(t, y, three, 1, n_perm, s)
        out["vmd"] = K.vmd_summary(t, y, base)
        return out

    m = evidence.models(per_series.spread(df), base)
    m = per_series.apply(m, tests, "p_24 double, p_12 double, p_12_raw double, vmd struct<period_base:double,period_half:double,energy_ratio:double,deviation:double,lock:double>")
    m = m.withColumn("log_bf", evidence.log_bayes_factor())
    if use_savage_dickey:
        m = evidence.savage_dickey(m, base).withColumn("log_bf", F.coalesce(-F.col("sd_log_bf"), "log_bf"))
    doubt = F.abs("log_bf") < 3
    m = m.withColumnRenamed("error", "_error")
    if every:
        m = evidence.bootstrap_lrt(m, base, n_bootstrap).withColumn("_p", F.col("p_lrt")).withColumn("p_lrt", F.when(doubt, F.col("p_lrt")))
    else:
        m = m.withColumn("_y", F.col("y")).withColumn("y", F.when(doubt, F.col("y")))
        m = per_series.apply(m, lambda t, y, s: {"p_lrt": K.bootstrap_lrt(t, y, base, 3, three, n_bootstrap, s)[1]}, "p_lrt double")
        m = m.withColumn("y", F.col("_y")).drop("_y")
    m = m.withColumn("error", F.col("_error")).drop("_error")
    m = m.withColumn("amp_ratio", evidence.amplitude_ratio()).withColumn("rel_dev", evidence.period_deviation(base))
    t12 = evidence.fitted_half_period(base)
    label = soft_gated(base) if version == 2 else hard_gated(base)
    m = m.withColumn("bayes_factor", F.exp("log_bf")).withColumn("interpretation", evidence.interpret(F.col("log_bf"))).withColumn("t_12_fitted", t12).withColumn("t_12_deviation", t12 - base / 2)
    m = m.withColumn("classification", F.when(F.col("error").isNotNull(), "error").otherwise(label))
    return m.withColumn("p_lrt", F.col("_p")).drop("_p") if every else m


def batch(df: DataFrame, base: float = 24.0, **kw) -> DataFrame:
    """The result table of the one-stage analysis, with adjusted p-values over all series."""
    a = analytic(df, base, **kw)
    a = detect.bh_fdr(a.withColumnRenamed("p_12", "f_test_12h_pvalue"), "f_test_12h_pvalue", "f_test_12h_fdr")
    return a.select("series_id", "log_bf", "bayes_factor", "interpretation", "classification", "t_12_fitted", "t_12_deviation", *[F.col(f"amp_{p}").alias(f"A_{p}") for p in (24, 12, 8)], *[f"phi_{p}" for p in (24, 12, 8)], "f_test_12h_pvalue", (F.col("f_test_12h_pvalue") < 0.05).alias("f_test_12h_significant"), "f_test_12h_fdr", "p_24", "p_lrt", "error")


def agree(analytic_label: Column, bootstrap_label: Column) -> tuple[Column, Column]:
    """Label and confidence of the analytic and the simulated answer: equal, compatible, or the more cautious."""
    family = lambda x: F.when(x.isin("independent_ultradian", "likely_independent_ultradian"), "independent").when(x.isin("harmonic", "circadian_only"), "harmonic").otherwise(x)
    same, kin = analytic_label == bootstrap_label, family(analytic_label) == family(bootstrap_label)
    label = (
        F.when(same | kin, analytic_label)
        .when(analytic_label.isin("non_rhythmic", "circadian_only"), analytic_label)
        .when(bootstrap_label == "ambiguous", analytic_label)
        .when(analytic_label == "ambiguous", bootstrap_label)
        .otherwise("ambiguous")
    )
    return label, F.when(same, "high").when(kin, "medium").otherwise("low")


def ensemble(df: DataFrame, base: float = 24.0, n_bootstrap: int = 499) -> DataFrame:
    """The analytic and the simulated answer of each series, and what both come to: classification, confidence."""
    a = analytic(df, base, n_bootstrap=n_bootstrap, every=True)
    label, conf = agree(F.col("classification"), F.col("lrt_label"))
    return a.withColumn("analytic_label", F.col("classification")).withColumn("confidence", conf).withColumn("classification", F.when(F.col("error").isNotNull(), "error").otherwise(label))


def fuse(label: Column, p: Column, p12: Column, sd: Column | None = None) -> tuple[Column, Column, Column]:
    """Label, confidence and reason of the soft-gated label with the bispectral test's p (null where it failed)."""
    ind, has12 = label.isin("independent_ultradian", "likely_independent_ultradian"), p12 < 0.1
    sd = F.lit(None).cast("double") if sd is None else sd
    mid, high = (p >= 0.01) & (p < 0.05), p > 0.5
    case = [
        (p.isNull(), label, "low", "bhct_failed_v2_default"),
        (p < 0.01, F.lit("harmonic"), "high", "bispectral_qpc_detected"),
        (mid & label.isin("harmonic", "circadian_only"), label, "high", "bhct_confirms_v2_harmonic"),
        (mid & (sd > 0), F.lit("harmonic"), "medium", "bhct_and_sd_agree_harmonic"),
        (mid & (sd < -1), label, "low", "bhct_harmonic_but_sd_independent"),
        (mid, F.lit("harmonic"), "medium", "bhct_moderate_qpc"),
        (high & ind, label, "high", "bhct_confirms_v2_independent"),
        (high & (label == "circadian_only") & has12, F.lit("independent_ultradian"), "medium", "bhct_no_qpc_promotes_to_independent"),
        (high & (label == "circadian_only"), label, "medium", "no_12h_signal"),
        (high, label, "medium", "bhct_no_qpc_v2_default"),
    ]
    out = [label, F.lit("low"), F.lit("bhct_inconclusive_v2_default")]
    for when, *values in reversed(case):
        out = [F.when(when, v if isinstance(v, Column) else F.lit(v)).otherwise(o) for v, o in zip(values, out, strict=True)]
    return tuple(out)


def channels_agree(label: Column, p: Column, sd: Column | None = None) -> Column:
    """Whether the label, the bispectral test and (if given) Savage and Dickey's ratio point one way."""
    har, ind = label == "harmonic", label.isin("independent_ultradian", "likely_independent_ultradian")
    both = (har & (p < 0.05) & ((sd > 0) if sd is not None else F.lit(True))) | (ind & (p > 0.2) & ((sd < -1) if sd is not None else F.lit(True)))
    quiet = label.isin("non_rhythmic", "circadian_only") & (p >= 0.05) if sd is None else F.lit(False)
    return F.coalesce(p.isNull() | both | quiet, F.lit(True))


def fusion(df: DataFrame, base: float = 24.0, use_savage_dickey: bool = False) -> DataFrame:
    """The third classifier: soft-gated labels with the bispectral test on top."""
    a = analytic(df, base).withColumnRenamed("error", "_error")
    b = evidence.bispectrum(a, base)
    sd = None
    if use_savage_dickey:
        b = evidence.savage_dickey(b, base)
        sd = F.col("sd_log_bf")
    v2 = F.col("classification")
    label, conf, reason = fuse(v2, F.col("p_bispectral"), F.col("p_12_raw"), sd)
    b = b.withColumn("v2_classification", v2).withColumn("confidence", conf).withColumn("reason", reason).withColumn("channels_agree", channels_agree(v2, F.col("p_bispectral"), sd)).withColumn("has_significant_12h", F.col("p_12_raw") < 0.1)
    return b.withColumn("classification", F.when(F.col("_error").isNotNull(), "error").otherwise(label)).withColumn("error", F.col("_error")).drop("_error")
