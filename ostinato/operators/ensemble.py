"""Consensus of two classifiers' tables by a weighted vote."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stats as S

#: Labels by their canonical class; other labels stand for themselves. Fixed values.
CANONICAL = {"independent_ultradian": "independent", "likely_independent_ultradian": "independent", "damped_ultradian": "independent", "multi_ultradian": "independent", "harmonic": "harmonic", "circadian_only": "circadian", "non_rhythmic": "non_rhythmic", "ambiguous": "ambiguous"}


def canonical(label: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for x in chain(*CANONICAL.items())])[label], label)


def weights(given: dict[str, float] | None = None) -> tuple[float, float]:
    """Weights of the analytic and the dynamic classifier, normalised; equal where both are 0."""
    a, b = (given or {}).get("analytic", 0.4), (given or {}).get("dynamic", 0.6)
    return (a / (a + b), b / (a + b)) if a + b else (0.5, 0.5)


def vote(la: Column, lb: Column, ca: Column, cb: Column, wa: float, wb: float) -> dict[str, Column]:
    """Label, confidence, agreement and review flag of two labels with their confidences: the first rule that holds."""
    a, b = canonical(la), canonical(lb)
    both = wa * ca + wb * cb
    sa, sb = wa * ca, wb * cb
    first, second = (la, ca), (lb, cb)
    stronger = lambda x, y: (F.when(sb >= sa, lb).otherwise(la), F.when(sb >= sa, sb).otherwise(sa))
    t, f = F.lit(True), F.lit(False)
    rules = [
        (la.isNull() & lb.isNull(), F.lit("ambiguous"), F.lit(0.0), f, t),
        (la.isNull(), *second, f, t),
        (lb.isNull(), *first, f, t),
        (la == lb, la, both, t, f),
        (a == b, lb if wb >= wa else la, both, t, f),
        ((la == "non_rhythmic") & (cb > 0.9), lb, cb * 0.8, f, t),
        (la == "non_rhythmic", *first, f, t),
        ((b == "non_rhythmic") & (ca > 0.6), *first, f, t),
        (b == "non_rhythmic", *second, f, t),
        (la == "ambiguous", *second, f, f),
        (lb == "ambiguous", *first, f, f),
        (((a == "harmonic") & (b == "independent")) | ((a == "independent") & (b == "harmonic")), *stronger(a, b), f, t),
        ((la == "harmonic") & (b == "circadian"), *first, f, t),
    ]
    out = [*stronger(a, b), f, t]
    for when, *values in reversed(rules):
        out = [F.when(when, v).otherwise(o) for v, o in zip(values, out, strict=True)]
    return dict(zip(("consensus_classification", "consensus_confidence", "agreement", "review_flag"), out, strict=True))


def integrate(analytic: DataFrame, dynamic: DataFrame, given: dict[str, float] | None = None) -> DataFrame:
    """Full join of two tables by series_id with the consensus; other columns come with the prefix of their table.

    analytic needs classification and log_bf, dynamic classification and confidence; a missing confidence is 0.5.
    """
    wa, wb = weights(given)
    a = analytic.select("series_id", *[F.col(c).alias(f"analytic_{c}") for c in analytic.columns if c != "series_id"])
    b = dynamic.select("series_id", *[F.col(c).alias(f"dynamic_{c}") for c in dynamic.columns if c != "series_id"])
    j = a.join(b, "series_id", "full")
    ca = S.logistic(F.abs(F.coalesce(F.nanvl(F.col("analytic_log_bf").cast("double"), F.lit(0.0)), F.lit(0.0))))
    cb = F.coalesce(F.nanvl(F.col("dynamic_confidence").cast("double"), F.lit(0.5)), F.lit(0.5))
    v = vote(F.col("analytic_classification"), F.col("dynamic_classification"), ca, cb, wa, wb)
    v["consensus_confidence"] = F.bround(v["consensus_confidence"], 4)
    return j.select("series_id", *[c.alias(k) for k, c in v.items()], *[c for c in j.columns if c != "series_id"])


def learn_weights(analytic: DataFrame, dynamic: DataFrame, truth: DataFrame, grid: int = 9) -> DataFrame:
    """weight (of the analytic table), accuracy, macro_f1 of each of the grid's weights 1/(grid+1).. against truth (series_id, label)."""
    from . import metrics

    a = analytic.select("series_id", F.col("classification").alias("la"), S.logistic(F.abs(F.coalesce("log_bf", F.lit(0.0)))).alias("ca"))
    b = dynamic.select("series_id", F.col("classification").alias("lb"), F.coalesce("confidence", F.lit(0.5)).alias("cb"))
    j = a.join(b, "series_id", "full").join(truth.select("series_id", F.col("label").alias("y_true")), "series_id")
    j = j.withColumn("ca", F.coalesce("ca", F.lit(0.5))).withColumn("cb", F.coalesce("cb", F.lit(0.5)))
    picks = F.array(*[F.struct(F.lit(i / (grid + 1)).alias("weight"), vote(F.col("la"), F.col("lb"), F.col("ca"), F.col("cb"), i / (grid + 1), 1 - i / (grid + 1))["consensus_classification"].alias("y_pred")) for i in range(1, grid + 1)])
    rows = j.select("y_true", F.explode(picks).alias("p")).select("y_true", "p.*")
    return metrics.scores(rows, ["weight"]).select("weight", "accuracy", "macro_f1")


def merged_parameter(*sources: str) -> Column:
    """The first value among columns that isn't missing."""
    return F.coalesce(*sources)
