"""The relational steps of the reports: renames, joins by lists, deduplication, pivots and tables of change."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ranks


def prefixed(df: DataFrame, source: str, keys: list[str]) -> DataFrame:
    """Key columns first, all others with the source's prefix."""
    return df.select(*keys, *[F.col(c).alias(c if c.startswith(f"{source}_") else f"{source}_{c}") for c in df.columns if c not in keys])


def expressed(df: DataFrame, least: float | None = None, percentile: float | None = None, y: str = "y") -> DataFrame:
    """Array-form series whose mean reaches a value, or an exact percentile of all means, and that vary at all."""
    mean = F.aggregate(y, F.lit(0.0), lambda a, v: a + v) / F.size(y)
    d = df.withColumn("_mean", mean).where(F.array_max(y) - F.array_min(y) > 1e-10)
    if least is not None:
        d = d.where(F.col("_mean") >= least)
    if percentile is not None:
        d = d.where(F.col("_mean") >= ranks.percentile(d, F.col("_mean"), percentile).scalar())
    return d.drop("_mean")


def screened(df: DataFrame, cheap: Column, dear, label: str = "non_rhythmic") -> DataFrame:
    """Rows for which the cheap test holds go through ``dear`` (a function of tables that adds classification); the rest get a label."""
    yes, no = df.where(cheap), df.where(~F.coalesce(cheap, F.lit(False))).withColumn("classification", F.lit(label))
    return dear(yes).unionByName(no, allowMissingColumns=True)


def mapped(key: Column, table: dict[str, str]) -> Column:
    """A lookup in a small dictionary; null where it has no entry."""
    return F.create_map(*[F.lit(x) for x in chain(*table.items())])[key] if table else F.lit(None).cast("string")


def truth_of(df: DataFrame, lists: DataFrame, symbol: str = "symbol") -> DataFrame:
    """Adds truth: the category of a symbol in lists (symbol, category), whatever its case; known_12h before circadian before housekeeping."""
    rank = F.when(F.col("category") == "known_12h", 0).when(F.col("category") == "circadian", 1).otherwise(2)
    one = lists.groupBy(F.upper("symbol").alias("_s")).agg(F.min(F.struct(rank.alias("r"), F.col("category").alias("c"))).alias("b")).select("_s", F.col("b.c").alias("truth"))
    return df.join(one, F.upper(symbol) == F.col("_s"), "left").drop("_s")


def dedup_max_mean(df: DataFrame, key: str, mean: Column, tie: str) -> DataFrame:
    """The row of each key with the largest mean, the first by ``tie`` of equal ones."""
    w = Window.partitionBy(key).orderBy(F.desc(mean), tie)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def top_k(df: DataFrame, k: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(k)


def case(rules: list[tuple[Column, str]], otherwise: str) -> Column:
    """The name of the first rule that holds."""
    out = F.lit(otherwise)
    for when, name in reversed(rules):
        out = F.when(when, name).otherwise(out)
    return out


def condition_change(first: Column, second: Column) -> Column:
    """What became of a label from one condition to the other, by classes of labels."""
    from .ensemble import canonical

    a, b = canonical(first), canonical(second)
    ind = "independent"
    return case([((a == ind) & (b == ind), "independent_in_both"), ((a == ind) & (b == "harmonic"), "independent_to_harmonic"), ((a == "harmonic") & (b == ind), "harmonic_to_independent"), (a == ind, "lost_independent"), (b == ind, "gained_independent"), ((a == "harmonic") & (b == "harmonic"), "harmonic_in_both"), ((a == "non_rhythmic") & (b == "non_rhythmic"), "non_rhythmic_in_both")], "other")


def concordance(ours: Column, theirs: Column) -> Column:
    """Of two answers: both, neither, or one only."""
    return case([(ours & theirs, "both"), (~ours & ~theirs, "neither"), (ours & ~theirs, "ours_only")], "theirs_only")


def value_counts(df: DataFrame, *cols: str) -> DataFrame:
    return df.groupBy(*cols).agg(F.count("*").alias("n"))


def pivot_first(df: DataFrame, row: str, column: str, value: str, values: list[str]) -> DataFrame:
    """A row for each key with a column for each of the values, and their mean over the columns that have one."""
    p = df.groupBy(row).pivot(column, values).agg(F.first(value, ignorenulls=True))
    total, n = sum((F.coalesce(F.col(v), F.lit(0.0)) for v in values), F.lit(0.0)), sum((F.col(v).isNotNull().cast("int") for v in values), F.lit(0))
    return p.withColumn("mean", F.when(n > 0, total / n))


def transitions(a: DataFrame, b: DataFrame, key: str = "series_id", labels: list[str] | None = None) -> DataFrame:
    """Counts of each label in one table by the label in the other; with labels, one column for each of them."""
    j = a.select(key, F.col("classification").alias("before")).join(b.select(key, F.col("classification").alias("after")), key)
    return j.groupBy("before").pivot("after", labels).agg(F.count("*")).na.fill(0) if labels else j.groupBy("before", "after").agg(F.count("*").alias("n"))


def conserved(df: DataFrame, key: str, group: str, least: int = 3) -> DataFrame:
    """Keys that occur in at least so many groups: n_groups and their sorted names."""
    g = df.groupBy(key).agg(F.sort_array(F.collect_set(group)).alias("groups"))
    return g.withColumn("n_groups", F.size("groups")).where(F.col("n_groups") >= least)


def coverage(df: DataFrame, key: str, group: str, detected: Column) -> DataFrame:
    """Keys with the number of groups they are in and are detected in: in_any, in_all (of all groups of the table)."""
    total = df.agg(F.countDistinct(group)).scalar()
    g = df.groupBy(key).agg(F.countDistinct(F.when(detected, F.col(group))).alias("n_detected"))
    return g.withColumn("in_any", F.col("n_detected") > 0).withColumn("in_all", F.col("n_detected") == total)


def pathway_counts(df: DataFrame, pathways: DataFrame, key: str = "symbol") -> DataFrame:
    """For each pathway: series, and those with a half-period rhythm in the first, in the second condition, and independent in the second."""
    j = df.join(pathways, key)
    return j.groupBy("pathway").agg(F.count("*").alias("n"), F.count_if("first_12h").alias("n_first"), F.count_if("second_12h").alias("n_second"), F.count_if("second_independent").alias("n_second_independent"))


def percent_reduction(before: Column, after: Column) -> Column:
    """Whole percents, towards zero."""
    return (100 * (1 - after / F.greatest(before, F.lit(1)))).cast("int")


def knockout_table(first: DataFrame, second: DataFrame) -> DataFrame:
    """Series of both conditions (series_id, p_24, p_12, classification): circadian_disrupted, persists_12h, change."""
    a = first.select("series_id", *[F.col(c).alias(f"{c}_wt") for c in ("p_24", "p_12", "classification")])
    b = second.select("series_id", *[F.col(c).alias(f"{c}_ko") for c in ("p_24", "p_12", "classification")])
    j = a.join(b, "series_id")
    return j.withColumn("circadian_disrupted", (F.col("p_24_wt") < 0.05) & (F.col("p_24_ko") >= 0.05)).withColumn("persists_12h", (F.col("p_12_wt") < 0.05) & (F.col("p_12_ko") < 0.05)).withColumn("change", condition_change(F.col("classification_wt"), F.col("classification_ko")))


def atlas(tables: dict[str, DataFrame], marks: DataFrame, least: int = 3) -> DataFrame:
    """All groups' results in one table, with is_12h, is_conserved (in at least so many groups) and is_marked (in a list of symbols)."""
    out = None
    for name, t in tables.items():
        t = t.select(F.lit(name).alias("tissue"), "symbol", "classification")
        out = t if out is None else out.unionByName(t)
    out = out.withColumn("is_12h", F.col("classification").isin("independent_ultradian", "likely_independent_ultradian", "harmonic"))
    c = conserved(out.where("is_12h"), "symbol", "tissue", least).select("symbol", F.lit(True).alias("is_conserved"))
    m = marks.select("symbol").distinct().withColumn("is_marked", F.lit(True))
    return out.join(c, "symbol", "left").join(m, "symbol", "left").na.fill(False, ["is_conserved", "is_marked"])
