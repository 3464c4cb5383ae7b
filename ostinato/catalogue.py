"""All queries of the engine with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import detect, fits
from .plans import classifying, fitting, inputs, populations, reporting

Query = Callable[[SparkSession, str], DataFrame]
_PLANS = (fitting, populations, classifying, reporting)


def queries() -> dict[str, Query]:
    return {k: f for m in _PLANS for k, f in m.Q.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _PLANS for k, s in m.SQL.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosinor of each user's events at 24 hours, with adjusted p-values and a label."""
    c = fits.cosinor_long(inputs.events_long(spark, sf_dir, "user_id"), 24.0)
    c = detect.bh_fdr(c.where("p_value is not null"), "p_value", "fdr")
    return c.select("series_id", "n", "mesor", "amplitude", "phase", "p_value", "fdr", F.when(F.col("fdr") < 0.05, "rhythmic").otherwise("non_rhythmic").alias("label"))
