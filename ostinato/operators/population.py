"""Statistics over many series: circular, of contingency, of ranks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stats as S
from . import ranks, resampling
from .evidence import ladder


def rayleigh_p(n: Column, z: Column) -> Column:
    """The series for the p of a mean resultant, from ten angles on; its leading term below."""
    series = F.exp(-z) * (1 + (2 * z - z * z) / (4 * n) - (24 * z - 132 * z * z + 76 * z**3 - 9 * z**4) / (288 * n * n))
    return F.when(n > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(n >= 10, series).otherwise(F.exp(-z)))))


def rayleigh(df: DataFrame, angle: Column, keys: list[str] | None = None) -> DataFrame:
    """Keys (or one row) to n, r (mean resultant length), z, p_value, mean_direction in [0, 2 pi). Null angles don't count."""
    g = df.groupBy(*(keys or [])).agg(F.count(angle).alias("n"), F.avg(F.cos(angle)).alias("c"), F.avg(F.sin(angle)).alias("s"))
    r = F.sqrt(F.col("c") ** 2 + F.col("s") ** 2)
    g = g.withColumn("r", r).withColumn("z", F.col("n") * F.col("r") ** 2)
    return g.select(*(keys or []), "n", "r", "z", rayleigh_p(F.col("n"), F.col("z")).alias("p_value"), S.wrap(F.atan2("s", "c")).alias("mean_direction"))


def zar_p(n: Column, r: Column, published: bool = True) -> Column:
    """The exponential approximation of Rayleigh's p; ``published`` takes n r^2 for (n r)^2, as the modules' reports do."""
    return F.least(F.lit(1.0), F.exp(F.sqrt(1 + 4 * n + 4 * (n * n - (n * r * r if published else (n * r) ** 2))) - (1 + 2 * n)))


def phase_test(df: DataFrame, phase_24: str = "phase_24", phase_12: str = "phase_12", keys: list[str] | None = None) -> DataFrame:
    """Rayleigh's test of phase_12 - 2 phase_24 over series: harmonics share that angle. Fewer than five series are inconclusive."""
    r = rayleigh(df, S.wrap(F.col(phase_12) - 2 * F.col(phase_24)), keys)
    few = F.col("n") < 5
    p = F.col("p_value")
    label = F.when(few, "inconclusive").when(p < 0.05, "harmonic").when(p > 0.2, "independent").otherwise("inconclusive")
    score = F.when(few, 0.0).otherwise(ladder(p, ("<", 0.001, -3), ("<", 0.01, -2), ("<", 0.05, -1), (">", 0.5, 2), (">", 0.2, 1)))
    return r.withColumn("classification", label).withColumn("evidence_score", score)


def circular_correlation(df: DataFrame, a: Column, b: Column, keys: list[str] | None = None) -> DataFrame:
    """n and rho of the pairwise circular correlation, from six sums instead of all pairs.

    Products of sines of differences are half the difference of cosines of their difference and sum, whose double sums are
    squared resultants: of a - b, a + b, 2a and 2b.
    """
    parts = {"d": a - b, "p": a + b, "aa": 2 * a, "bb": 2 * b}
    both = a.isNotNull() & b.isNotNull()
    g = df.where(both).groupBy(*(keys or [])).agg(F.count("*").alias("n"), *[F.sum(f(v)).alias(f"{k}{i}") for k, v in parts.items() for i, f in enumerate((F.cos, F.sin))])
    sq = lambda k: F.col(f"{k}0") ** 2 + F.col(f"{k}1") ** 2
    num = (sq("d") - sq("p")) / 2
    n2 = F.col("n") * F.col("n")
    den = F.sqrt(F.greatest((n2 - sq("aa")) / 2 * ((n2 - sq("bb")) / 2), F.lit(0.0)))
    return g.select(*(keys or []), "n", F.when(den < 1e-10, 0.0).otherwise(num / den).alias("rho"))


def circular_permutation(df: DataFrame, a: str, b: str, n: int = 9999, seed: int = 42) -> DataFrame:
    """One row: n, rho, p_value and evidence of the circular correlation against n permutations of the partners.

    Rows of any number: permutations are keyed bijections of row numbers, and only sums of each leave a task. Rows with a null angle don't
    count; without rows p is 1.
    """
    sums, size = resampling.permuted_resultants(df, a, b, n, seed)
    seen = circular_correlation(df, F.col(a).cast("double"), F.col(b).cast("double")).select("n", F.col("rho").alias("rho"))
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    both = df.where(x.isNotNull() & y.isNotNull()).agg(F.count("*").alias("m"), *[F.sum(f(2 * c)).alias(k) for k, f, c in (("ca", F.cos, x), ("sa", F.sin, x), ("cb", F.cos, y), ("sb", F.sin, y))])
    m2 = (F.col("m") * F.col("m")).cast("double")
    den = F.sqrt(F.greatest((m2 - F.col("ca") ** 2 - F.col("sa") ** 2) / 2 * ((m2 - F.col("cb") ** 2 - F.col("sb") ** 2) / 2), F.lit(0.0)))
    both = both.select(den.alias("den"))
    num = (F.col("c1") ** 2 + F.col("s1") ** 2 - F.col("c2") ** 2 - F.col("s2") ** 2) / 2
    one = seen.join(both, F.lit(True))  # one row each
    rho = F.when(F.col("den") < 1e-10, 0.0).otherwise(num / F.col("den"))
    hits = sums.join(F.broadcast(one), F.lit(True)).agg(F.count_if(F.abs(rho) >= F.abs("rho") - 1e-12).alias("h"))
    p = F.when(F.col("n") == 0, 1.0).otherwise((F.col("h") + 1) / (n + 1))
    label = F.when(p < 0.01, "phases_correlated_harmonic").when(p < 0.05, "phases_weakly_correlated").otherwise("phases_independent")
    return hits.join(F.broadcast(one), F.lit(True)).select("n", F.coalesce("rho", F.lit(0.0)).alias("rho"), p.alias("p_value"), label.alias("evidence"))


def population_phases(df: DataFrame, values: str = "y") -> DataFrame:
    """The phase test over series whose half-period amplitude is above a tenth of the spread of all values; needs columns
    phase_24, phase_12, amp_12. Fewer than five such series: insufficient_genes."""
    v = df.select(F.explode(values).alias("v")).agg(F.stddev_pop("v").alias("sd"))
    out = phase_test(df.where(F.col("amp_12") > 0.1 * v.scalar()))
    return out.withColumn("classification", F.when(F.col("n") < 5, "insufficient_genes").otherwise(F.col("classification")))


def independence(df: DataFrame, is_24: Column, is_12: Column, keys: list[str] | None = None) -> DataFrame:
    """The 2 x 2 table of two flags: counts, observed over expected, chi-squared, p (exact where an expected count is below five or a
    margin is empty) and a label. Null flags count as false."""
    f24, f12 = F.coalesce(is_24, F.lit(False)), F.coalesce(is_12, F.lit(False))
    n = lambda c: F.count_if(c).cast("long")
    g = df.groupBy(*(keys or [])).agg(n(f12 & f24).alias("n_both"), n(f12 & ~f24).alias("n_12h_only"), n(~f12 & f24).alias("n_24h_only"), n(~f12 & ~f24).alias("n_neither"))
    a, b, c, d = (F.col(x) for x in ("n_both", "n_12h_only", "n_24h_only", "n_neither"))
    total, row, col_ = a + b + c + d, a + b, a + c
    expected = row * col_ / total
    least = F.least(expected, row * (b + d) / total, (c + d) * col_ / total, (c + d) * (b + d) / total)
    margins = row * col_ * (c + d) * (b + d)
    chi = F.when(margins > 0, total * (a * d - b * c) ** 2 / margins.cast("double")).otherwise(0.0)
    p = F.when((least < 5) | (margins == 0) | (total == 0), S.fisher_two_sided(a, b, c, d)).otherwise(S.chi2_sf_1(chi))
    oe = F.when(expected > 0, a / expected).otherwise(1.0)
    label = F.when((p < 0.05) & (oe > 1.5), "harmonic_dependent").when((p > 0.05) | ((oe > 0.5) & (oe < 1.5)), "independent").otherwise("inconclusive")
    return g.withColumn("observed_expected_ratio", oe).withColumn("chi2", chi).withColumn("p_value", p).withColumn("interpretation", label)


def mann_whitney(df: DataFrame, value: Column, second: Column, keys: list[str] | None = None) -> DataFrame:
    """Rank-sum test of the rows for which ``second`` is false against the others: n1, n2, medians, u, p_value (normal, corrected
    for ties and continuity), rank_biserial, log2fc of the medians.

    Equal values are counted before they are ranked, and ranks are running sums by ranges of values: see ``ranks``.
    """
    keys = keys or []
    rows = df.where(value.isNotNull() & second.isNotNull()).select(*keys, value.cast("double").alias("v"), second.cast("int").alias("g"))
    counts = rows.groupBy(*keys, "v").agg(F.sum(1 - F.col("g")).alias("c1"), F.sum("g").alias("c2"), F.count("*").alias("c"))
    r = ranks.running(counts, "v", {"below": F.col("c"), "b1": F.col("c1"), "b2": F.col("c2")}, keys)
    total = lambda e: F.sum(e).cast("double")
    med = lambda i: ranks.quantile(f"b{i}", F.col(f"c{i}"), F.col(f"b{i}_all"), "v", 0.5).alias(f"median_{i}")
    g = r.groupBy(*keys).agg(total(F.col("c1") * (F.col("below") + (F.col("c") + 1) / 2)).alias("r1"), total(F.col("c1")).alias("n1"), total(F.col("c")).alias("n"), total(F.col("c") ** 3 - F.col("c")).alias("ties"), med(1), med(2))
    n1, n2, n = F.col("n1"), F.col("n") - F.col("n1"), F.col("n")
    u = F.col("r1") - n1 * (n1 + 1) / 2
    sd = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.col("ties") / (n * (n - 1))))
    z = F.greatest(F.lit(0.0), F.abs(u - n1 * n2 / 2) - 0.5) / sd
    fc = F.log2(F.greatest("median_2", F.lit(1e-10)) / F.greatest("median_1", F.lit(1e-10)))
    return g.select(*keys, n1.cast("long").alias("n1"), n2.cast("long").alias("n2"), "median_1", "median_2", u.alias("u"), F.least(F.lit(1.0), S.normal_sf_two_sided(z)).alias("p_value"), (1 - 2 * u / (n1 * n2)).alias("rank_biserial"), fc.alias("log2fc"))


def damping_label(log2fc: Column, p: Column, second: str = "old", alpha: float = 0.05) -> Column:
    return F.when(p >= alpha, "no_significant_change").when(log2fc > 0.5, f"increased_damping_in_{second}").when(log2fc < -0.5, f"decreased_damping_in_{second}").otherwise("marginal_change")


def oscillator_fate(first: DataFrame, second: DataFrame, bound: float = 0.05) -> DataFrame:
    """Series of two conditions (series_id, gamma, active) to dying, gained or stable: active is with a damping below the bound."""
    on = lambda x: F.col(f"{x}.active") & (F.col(f"{x}.gamma") < bound)
    j = first.alias("a").join(second.alias("b"), "series_id")
    return j.select("series_id", F.col("a.gamma").alias("gamma_1"), F.col("b.gamma").alias("gamma_2"), F.when(on("a") & ~on("b"), "dying").when(~on("a") & on("b"), "gained").otherwise("stable").alias("fate"))


def damping_summary(df: DataFrame, keys: list[str]) -> DataFrame:
    """Of rows with gamma and period: medians, mean, spread, half-life and quality factor, share of underdamped oscillators. What makes the rows
    runs once: moments and medians read them from one shuffle."""
    df = ranks.once(df.select(*keys, "gamma", "period"), "gamma", "period")
    half = F.when(F.col("gamma") > 0, math.log(2) / F.col("gamma"))
    q = (2 * math.pi / F.col("period")) / (2 * F.col("gamma") + 1e-10)
    g = df.groupBy(*keys).agg(F.avg("gamma").alias("mean_gamma"), F.stddev_pop("gamma").alias("sd_gamma"), F.avg((q > 0.5).cast("double")).alias("share_underdamped"))
    med = ranks.percentiles(df, {k: (c, 0.5) for k, c in (("median_period", F.col("period")), ("median_gamma", F.col("gamma")), ("median_half_life", half), ("median_q", q))}, keys)
    names = ["median_period", "median_gamma", "median_half_life", "median_q"]
    g = ranks.meet(g, med, keys, *names, how="left")
    return g.select(*keys, "median_period", "median_gamma", "mean_gamma", "sd_gamma", F.coalesce("median_half_life", F.lit(float("inf"))).alias("median_half_life"), "median_q", "share_underdamped")


def spearman(df: DataFrame, a: str, b: str, keys: list[str] | None = None) -> DataFrame:
    """n and the rank correlation of two columns, ties at their mean rank."""
    keys = keys or []
    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    for c in (a, b):
        counts = rows.groupBy(*keys, c).agg(F.count("*").alias("_c"))
        r = ranks.running(counts, c, {"_below": F.col("_c")}, keys)
        rows = rows.join(r.select(*keys, c, (F.col("_below") + (F.col("_c") + 1) / 2).alias(f"_r_{c}")), [*keys, c])
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.corr(f"_r_{a}", f"_r_{b}").alias("spearman"))
