"""Tables that compare methods: detection and disentangling by group, agreement, knockouts, intervals of means."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stats as S
from . import metrics, resampling

INDEPENDENT = ("independent_ultradian", "likely_independent_ultradian")


def detection_table(df: DataFrame, truth: Column, positive: Column, score: Column | None = None, keys: list[str] | None = None) -> DataFrame:
    """Keys to the counts and rates of ``metrics.binary``, n_positive and n_negative, and with a score roc_auc; groups of one class have
    no row. Rows of an unknown truth don't count."""
    keys = keys or []
    known = df.where(truth.isNotNull())
    t = metrics.binary(known, truth, positive, keys)
    t = t.withColumns({"n_positive": F.col("tp") + F.col("fn"), "n_negative": F.col("fp") + F.col("tn")}).where("n_positive > 0 and n_negative > 0")
    if score is None:
        return t
    area = metrics.auc(known, score, truth, keys).withColumnRenamed("auc", "roc_auc")
    return t.join(area, keys) if keys else t.join(F.broadcast(area), F.lit(True))  # one row


def tier_one(df: DataFrame, exempt: Iterable[str] = (), ambiguous: Iterable[str] = (), keys: tuple[str, ...] = ("method",)) -> DataFrame:
    """Detection by method, for rows (method, scenario, truth, positive): exempt methods, which can't tell a harmonic from a rhythm of
    its own, aren't held to the ambiguous scenarios."""
    fair = ~(F.col("method").isin(*exempt) & F.col("scenario").isin(*ambiguous)) if exempt and ambiguous else F.lit(True)
    return detection_table(df.where(fair), F.col("truth"), F.col("positive"), keys=list(keys))


def tier_two(df: DataFrame, keys: tuple[str, ...] = ("method",)) -> DataFrame:
    """Among rows (method, independent, harmonic, classification, confidence) with a half-period rhythm of either kind: whether
    independent ones are told from harmonics."""
    some = df.where(F.col("independent") | F.col("harmonic"))
    return detection_table(some, F.col("independent"), F.col("classification").isin(*INDEPENDENT), F.col("confidence"), list(keys))


def accuracy_table(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys to the number of rows (truth, positive) and the share that is right."""
    return metrics.recovery(df, keys, F.col("truth") == F.col("positive")).select(*keys, "n", F.col("rate").alias("accuracy"))


def agreement_table(df: DataFrame, reference: str, unit: list[str]) -> DataFrame:
    """Each other method to the units that it and the reference have, and the share on which they agree."""
    ref = df.where(F.col("method") == reference).select(*unit, F.col("positive").alias("_r"))
    j = df.where(F.col("method") != reference).join(ref, unit)
    return j.groupBy("method").agg(F.count("*").alias("n_common"), F.avg((F.col("positive") == F.col("_r")).cast("double")).alias("agreement_rate"))


def knockout_validation(df: DataFrame) -> DataFrame:
    """One row, of rows (wt_classification, ko_has_12h): harmonics that lose their rhythm in the knockout, independent ones that keep it,
    ambiguous ones that lose it, and Fisher's test of more losses among the harmonics. Rates and p are null without such rows."""
    label, kept = F.col("wt_classification"), F.coalesce(F.col("ko_has_12h"), F.lit(False))
    of = {"harmonic": label == "harmonic", "independent": label.isin(*INDEPENDENT), "ambiguous": label == "ambiguous"}
    g = df.agg(*[F.count_if(c & (kept if k == "kept" else ~kept)).alias(f"{n}_{k}") for n, c in of.items() for k in ("lost", "kept")])
    a, b, c, d = (F.col(x) for x in ("harmonic_lost", "harmonic_kept", "independent_lost", "independent_kept"))
    p = F.when((a + b > 0) & (c + d > 0), S.hypergeometric_sf(a, a + b + c + d, a + c, a + b))
    ratio = F.when((a + b > 0) & (c + d > 0), F.coalesce(F.try_divide((a * d).cast("double"), b * c), F.lit(float("inf"))))
    return g.select("*", F.try_divide(a, a + b).alias("harmonic_loss_rate"), F.try_divide(d, c + d).alias("independent_retention_rate"), F.try_divide(F.col("ambiguous_lost"), F.col("ambiguous_lost") + F.col("ambiguous_kept")).alias("ambiguous_loss_rate"), ratio.alias("fisher_odds_ratio"), p.alias("fisher_p_value"))


def mean_intervals(df: DataFrame, value: Column, keys: list[str], n: int = 2000, seed: int = 0) -> DataFrame:
    """Keys to the mean of a value and its 95% percentile interval over n resamples; null and NaN are left out.

    Groups of any size: see ``resampling.mean_replicates``. What meets in one task is a group's n means.
    """
    v = value.cast("double")
    means = df.select(*keys, v.alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v")).groupBy(*keys).agg(F.avg("_v").alias("mean"))
    r = resampling.mean_replicates(df, value, keys, n, seed)
    ends = r.groupBy(*keys).agg(F.percentile("mean", F.array(F.lit(0.025), F.lit(0.975))).alias("_e"))
    on = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys] or [F.lit(True)]
    return means.alias("l").join(ends.alias("r"), on).select(*[F.col(f"l.{k}").alias(k) for k in keys], "l.mean", F.col("r._e")[0].alias("lo"), F.col("r._e")[1].alias("hi"))
