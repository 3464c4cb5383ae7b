"""Reports of labels against lists of known symbols, of one table, of two conditions, and of all methods over labelled datasets."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .operators import classify, detect, metrics, per_series

INDEPENDENT = ("independent_ultradian", "likely_independent_ultradian")
HALF_PERIOD = (*INDEPENDENT, "harmonic")
#: Categories of lists: rhythms at half the base period, at the base period, and none.
KNOWN, CORE, NONE = "known_12h", "core_circadian", "housekeeping"


def _share(part: Column, whole: Column) -> Column:
    return part / F.greatest(whole, F.lit(1))


def _listed(results: DataFrame, lists: DataFrame) -> DataFrame:
    """Results with a flag for each category; a symbol may be in several lists, in whatever case."""
    flags = lists.select(F.upper("symbol").alias("_s"), "category").where(F.col("_s").isNotNull())
    flags = flags.groupBy("_s").agg(*[F.max((F.col("category") == c).cast("int")).alias(f"_{c}") for c in (KNOWN, CORE, NONE)])
    return results.join(flags, F.upper("symbol") == F.col("_s"), "left").drop("_s")


def _count(where: Column, label: Column | None = None) -> Column:
    return F.count_if(where & label if label is not None else where)


def list_report(results: DataFrame, lists: DataFrame, other: DataFrame | None = None) -> DataFrame:
    """One row of results (symbol, classification) against lists (symbol, category): how many known symbols were found and detected, as what; core symbols found
    and right; symbols without a rhythm found and taken for one; the share of all with a half-period rhythm; with ``other`` (symbol), how many of
    those are in the list of another species. Shares of none are 0."""
    c = F.col("classification")
    on = lambda k: F.coalesce(F.col(f"_{k}"), F.lit(0)) == 1
    df = _listed(results, lists)
    if other is not None:
        df = df.join(other.select(F.upper("symbol").alias("_o")).distinct(), F.upper("symbol") == F.col("_o"), "left")
    half = c.isin(*HALF_PERIOD)
    aggs = {
        "n": F.count("*"), "known_found": _count(on(KNOWN)), "known_detected": _count(on(KNOWN), half), "known_independent": _count(on(KNOWN), c.isin(*INDEPENDENT)), "known_harmonic": _count(on(KNOWN), c == "harmonic"),
        "core_found": _count(on(CORE)), "core_right": _count(on(CORE), c == "circadian_only"), "none_found": _count(on(NONE)), "none_rhythmic": _count(on(NONE), ~(c == "non_rhythmic")), "half_period": _count(half),
    }
    if other is not None:
        aggs["overlap"] = _count(half, F.col("_o").isNotNull())
    g = df.agg(*[v.alias(k) for k, v in aggs.items()])
    rates = {"known_rate": ("known_detected", "known_found"), "core_rate": ("core_right", "core_found"), "false_rate": ("none_rhythmic", "none_found"), "half_period_rate": ("half_period", "n")}
    return g.select("*", *[_share(F.col(a), F.col(b)).alias(k) for k, (a, b) in rates.items()])


def condition_report(wild: DataFrame, knockout: DataFrame, lists: DataFrame) -> DataFrame:
    """A row for each condition (wt, ko) of results against lists: known symbols found, and the shares detected, independent and harmonic; core symbols found,
    and the share that is right: circadian in the wild type, without a rhythm in the knockout."""
    both = wild.select("symbol", "classification", F.lit("wt").alias("condition")).unionByName(knockout.select("symbol", "classification", F.lit("ko").alias("condition")))
    c = F.col("classification")
    on = lambda k: F.coalesce(F.col(f"_{k}"), F.lit(0)) == 1
    right = F.when(F.col("condition") == "wt", c == "circadian_only").otherwise(c == "non_rhythmic")
    g = _listed(both, lists).groupBy("condition").agg(
        _count(on(KNOWN)).alias("known_found"), _count(on(KNOWN), c.isin(*HALF_PERIOD)).alias("_d"), _count(on(KNOWN), c.isin(*INDEPENDENT)).alias("_i"), _count(on(KNOWN), c == "harmonic").alias("_h"), _count(on(CORE)).alias("core_found"), _count(on(CORE), right).alias("_c")
    )
    share = lambda a, b, name: _share(F.col(a), F.col(b)).alias(name)
    return g.select("condition", "known_found", "core_found", share("_d", "known_found", "detected_rate"), share("_i", "known_found", "independent_rate"), share("_h", "known_found", "harmonic_rate"), share("_c", "core_found", "core_rate"))


def benchmark(datasets: dict[str, DataFrame], lists: DataFrame) -> DataFrame:
    """Rows (dataset, symbol, method, p, predicted, truth, category) of all methods on the listed symbols of datasets (series_id, t, y on one grid of times each).

    truth: whether the category has a half-period rhythm. A symbol in several lists counts in the first of known, core, none. Series that can't be
    analysed are predicted to have none.
    """
    order = F.when(F.col("category") == KNOWN, 0).when(F.col("category") == CORE, 1).when(F.col("category") == NONE, 2)
    first = lists.where(order.isNotNull() & F.col("symbol").isNotNull()).groupBy(F.upper("symbol").alias("_s")).agg(F.min_by("category", order).alias("category"))
    out = None
    for name, df in datasets.items():
        mine = per_series.spread(df.join(first, F.upper("series_id") == F.col("_s")).select("series_id", "t", "y", "category"))
        grid = mine.select("t").where("t is not null").first()
        if grid is None:
            continue
        classical = detect.all_methods(mine, np.array(grid[0], float)).select("series_id", "method", "p", F.coalesce(detect.has_12h(F.col("p"), F.col("period")), F.lit(False)).alias("predicted"))
        c = classify.Config()  # whether there is a rhythm is for its first stage to say: the second only names its kind
        first_stage = detect.stage1(mine.select("series_id", "t", "y"), c.base, c.alpha, c.min_methods, c.gate_b)
        ours = first_stage.select("series_id", F.lit("two_stage").alias("method"), F.col("p_detect").alias("p"), F.coalesce("passed", F.lit(False)).alias("predicted"))
        rows = classical.unionByName(ours).join(mine.select("series_id", "category"), "series_id")
        rows = rows.select(F.lit(name).alias("dataset"), F.col("series_id").alias("symbol"), "method", "p", "predicted", (F.col("category") == KNOWN).alias("truth"), "category")
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("no dataset has a listed symbol")
    return out


def summary(rows: DataFrame) -> dict[str, DataFrame]:
    """Of ``benchmark``'s rows: scores by dataset and method, share of right answers by category and method, and overall by method."""
    right = F.col("truth") == F.col("predicted")
    return {
        "by_dataset": metrics.binary(rows, F.col("truth"), F.col("predicted"), ["dataset", "method"]),
        "by_category": metrics.recovery(rows, ["category", "method"], right),
        "overall": metrics.recovery(rows, ["method"], right),
    }


def details(results: DataFrame, lists: DataFrame) -> DataFrame:
    """Each listed symbol with its category and its label (of several the first in the alphabet), not_found where the results lack it."""
    r = results.groupBy(F.upper("symbol").alias("_s")).agg(F.min("classification").alias("classification"))
    return lists.select("symbol", "category").join(r, F.upper("symbol") == F.col("_s"), "left").select("symbol", "category", F.coalesce("classification", F.lit("not_found")).alias("classification"))
