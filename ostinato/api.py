"""Whole analyses: from a table of series to labels, and benchmarks on simulated series."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import classify, decompose, detect, ensemble, metrics, relational, series
from .sources import simulate


def as_arrays(df: DataFrame) -> DataFrame:
    return df if {"t", "y"} <= set(df.columns) else series.to_array(df)


def run(df: DataFrame, method: str = "analytic", base: float = 24.0) -> DataFrame:
    """Labels of series in long or array form: series_id, classification, confidence and the method's columns.

    analytic: fits and tests; dynamic: damped oscillators; both: the vote of the two; two_stage: detect, then disentangle.
    """
    arrays = as_arrays(df).select("series_id", "t", "y")
    if method == "two_stage":
        return classify.two_stage(arrays, classify.Config.of(base=base))
    a = classify.batch(arrays, base) if method in ("analytic", "both") else None
    d = decompose.decompose(arrays, (base, base / 2, base / 3)).drop("t", "y") if method in ("dynamic", "both") else None
    if method == "both":
        return ensemble.integrate(a, d).withColumnRenamed("consensus_classification", "classification").withColumnRenamed("consensus_confidence", "confidence")
    if method == "dynamic":
        return d
    if method != "analytic":
        raise ValueError(f"no method {method!r}")
    from .functions import stats

    return a.withColumn("confidence", stats.logistic(F.col("log_bf")))


def benchmark(spark: SparkSession, replicates: int = 5, points: int = 48, step: float = 1.0, seed: int = 42) -> DataFrame:
    """Detection scores of the two-stage classifier and the classical methods on simulated scenarios: method, tp .. f1.

    A series is positive if it has a half-period rhythm, independent or harmonic.
    """
    sims = simulate.scenarios(spark, replicates, points, step, seed)
    truth = sims.select("series_id", "scenario", (F.col("has_independent_12h") | F.col("has_harmonic_12h")).alias("truth"))
    t = np.arange(points) * step
    classical = detect.all_methods(sims.select("series_id", "t", "y"), t).withColumn("positive", F.coalesce(detect.has_12h(F.col("p"), F.col("period")), F.lit(False)))
    ours = classify.two_stage(sims.select("series_id", "t", "y")).select("series_id", F.lit("two_stage").alias("method"), F.col("passed").alias("positive"))
    rows = classical.select("series_id", "method", "positive").unionByName(ours).join(truth, "series_id")
    return metrics.binary(rows, F.col("truth"), F.col("positive"), ["method"])


def validation_report(results: DataFrame, lists: DataFrame, positive=("independent_ultradian", "likely_independent_ultradian", "harmonic")) -> DataFrame:
    """Of results (symbol, classification) the share recovered in each category of a list of symbols."""
    j = relational.truth_of(results, lists).where("truth is not null")
    return metrics.recovery(j, ["truth"], F.col("classification").isin(*positive))
