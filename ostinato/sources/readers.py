"""Readers of series tables from files, and what the public formats need on the way."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ranks, relational, series

#: Hours in sample titles, tried in order. Fixed values.
HOUR_PATTERNS = (r"CT(\d+)", r"[Cc]ircadian\s+time\s+(\d+)", r"(\d+)\s*$")


def matrix_csv(spark: SparkSession, path: str, timepoints: list[float] | None = None, sep: str = ",") -> DataFrame:
    """A wide table, the name first and a column for each time, to long form. Headers are the times unless these are given.

    Raises ValueError where a header isn't a number or the given times don't fit the columns.
    """
    wide = spark.read.csv(path, header=True, sep=sep)
    name, *heads = wide.columns
    if timepoints is None:
        try:
            timepoints = [float(h) for h in heads]
        except ValueError as e:
            raise ValueError(f"a header isn't a time: {e}") from None
    if len(timepoints) != len(heads):
        raise ValueError(f"{len(heads)} columns and {len(timepoints)} times")
    return long_of(wide, name, dict(zip(heads, timepoints, strict=True)))


def long_of(wide: DataFrame, name: str, times: dict[str, float]) -> DataFrame:
    """Columns of a wide table to long form, by their times; only those columns are read."""
    points = F.array(*[F.struct(F.lit(float(t)).alias("t"), F.col(f"`{c}`").cast("double").alias("value")) for c, t in times.items()])
    return wide.select(F.col(f"`{name}`").cast("string").alias("series_id"), F.explode(points).alias("p")).select("series_id", "p.t", "p.value")


def delimited(spark: SparkSession, path: str, columns: list[str] | None = None, sep: str = "\t") -> DataFrame:
    """A delimited file, compressed or not, of which only some columns are kept."""
    df = spark.read.csv(path, header=True, sep=sep)
    return df.select(*[F.col(f"`{c}`") for c in columns]) if columns else df


def study_samples(meta: DataFrame, study: str) -> DataFrame:
    """Samples of a study that aren't outliers: sample, time."""
    return meta.where((F.col("study") == study) & ~F.coalesce(F.col("outlier").cast("boolean"), F.lit(False))).select("sample", F.col("time").cast("double").alias("time"))


def study(wide: DataFrame, samples: DataFrame, symbol: str = "symbol", least: float = 0.0) -> DataFrame:
    """Array form of a study from a table of symbols by samples: mean over samples of a time, rows without a symbol left out, series of
    a mean of at least ``least``, and of rows with one symbol that with the largest mean."""
    cols = [c for c in wide.columns if c != symbol]
    rows = wide.where(F.col(symbol).isNotNull() & (F.col(symbol) != "")).withColumn("_row", F.monotonically_increasing_id())
    points = F.explode(F.array(*[F.struct(F.lit(c).alias("sample"), F.col(f"`{c}`").cast("double").alias("value")) for c in cols])).alias("p")
    long = rows.select(symbol, "_row", points).select(symbol, "_row", "p.*").join(samples, "sample")
    mean = long.groupBy(symbol, "_row", F.col("time").alias("t")).agg(F.avg("value").alias("value"))
    pts = F.array_sort(F.collect_list(F.struct("t", "value")))
    g = mean.groupBy(symbol, "_row").agg(pts.alias("p"), F.avg("value").alias("_mean")).where(F.col("_mean") >= least)
    return relational.dedup_max_mean(g, symbol, F.col("_mean"), "_row").select(F.col(symbol).alias("series_id"), F.col("p.t").alias("t"), F.col("p.value").alias("y"))


def hour_of(title: Column, patterns: tuple[str, ...] = HOUR_PATTERNS) -> Column:
    """The hour in a sample's title by the first pattern that fits, or null."""
    return F.coalesce(*[F.when(F.regexp_extract(title, p, 1) != "", F.regexp_extract(title, p, 1).cast("double")) for p in patterns])


def first_symbol(symbols: Column) -> Column:
    """The first of the symbols of a probe, which are parted by ///."""
    return F.trim(F.element_at(F.split(symbols, "///"), 1))


def series_matrix(spark: SparkSession, path: str) -> tuple[dict[str, list[str]], DataFrame]:
    """A series-matrix text: the values of its !Sample_ lines, and the table as probe and samples.

    The header, a line for each attribute, is read on the driver; the table in parallel. ``sheets`` has both as data sources.
    """
    text = spark.read.text(path)
    unquote = lambda s: s.strip().strip('"')
    head: dict[str, list[str]] = {}
    for r in text.where(F.col("value").startswith("!Sample_")).collect():
        k, *v = r.value.split("\t")
        head.setdefault(k.removeprefix("!Sample_"), [unquote(x) for x in v])
    ids = text.where(F.col("value").startswith('"ID_REF"') | F.col("value").startswith("ID_REF")).first()
    if ids is None:
        raise ValueError("no table in the series matrix")
    names = [unquote(x) for x in ids.value.split("\t")]
    body = text.where(~F.col("value").startswith("!") & ~F.col("value").rlike('^"?ID_REF') & (F.trim("value") != ""))
    cells = F.split("value", "\t")
    return head, body.select(F.trim(F.regexp_replace(cells[0], '"', "")).alias("probe"), *[F.when(cells[i].isin("", "null", "NA"), None).otherwise(cells[i]).cast("double").alias(names[i]) for i in range(1, len(names))])


def array_study(table: DataFrame, titles: dict[str, str], annotation: DataFrame, pattern: str | None = None, floor_percentile: float | None = 0.1, least: float | None = None, every: int = 1) -> DataFrame:
    """Array form of a chip study: samples' hours from their titles (with a pattern: only those that fit, its last group the hour), probes'
    symbols from annotation (probe, symbol), the probe with the largest mean for each, means cut at a percentile or a value, and every
    n-th time. Samples of one hour are averaged."""
    import re

    hours: dict[float, list[str]] = {}
    for sample, title in titles.items():
        found = [m for p in ((pattern,) if pattern else HOUR_PATTERNS) if (m := re.search(p, title))]
        if not found and not pattern:
            raise ValueError(f"no hour in the title {title!r}")
        if found:
            hours.setdefault(float(found[0].groups()[-1]), []).append(sample)
    mean = lambda cols: sum((F.col(f"`{c}`") for c in cols), F.lit(0.0)) / len(cols)
    times = sorted(hours)[::every]
    ann = annotation.select("probe", first_symbol(F.col("symbol")).alias("symbol")).where("symbol is not null and symbol <> ''").dropDuplicates(["probe"])
    rows = table.join(ann, "probe").select("symbol", "probe", F.lit(times).alias("t") if times else F.array().cast("array<double>").alias("t"), F.array(*[mean(hours[t]) for t in times]).alias("y"))
    rows = rows.where(~F.exists("y", lambda v: v.isNull())).withColumn("_mean", F.aggregate("y", F.lit(0.0), lambda a, v: a + v) / F.size("y"))
    rows = relational.dedup_max_mean(rows, "symbol", F.col("_mean"), "probe").select(F.col("symbol").alias("series_id"), "t", "y")
    return relational.expressed(rows, least, floor_percentile)


#: Columns of hours and replicates, normalised and raw.
NORMALISED, RAW = r"CT(\d+)_([A-Z])\.normalized", r"CT(\d+)_([A-Z])\.raw"


def condition_pair(first: DataFrame, second: DataFrame, pattern: str = r"CT(\d+)_([A-Z])", name: str = "gene", floor_percentile: float = 0.1, second_pattern: str | None = None) -> DataFrame:
    """Series that both tables have: series_id, t and y of each condition (columns named by hour and replicate), averaged over replicates,
    without those of low mean over both. Each condition keeps its own times. Patterns say which columns count, of each table its own where they differ:
    NORMALISED and RAW are the two kinds of columns that such tables have side by side."""
    import re

    def one(df: DataFrame, tag: str, pattern: str) -> DataFrame:
        by_hour: dict[float, list[str]] = {}
        for c in df.columns:
            if m := re.search(pattern, c):
                by_hour.setdefault(float(m.group(1)), []).append(c)
        times = sorted(by_hour)
        y = F.array(*[sum((F.col(f"`{c}`").cast("double") for c in by_hour[t]), F.lit(0.0)) / len(by_hour[t]) for t in times])
        return df.select(F.col(name).alias("series_id"), F.lit(times).alias(f"t_{tag}"), y.alias(f"y_{tag}"))

    j = one(first, "wt", pattern).join(one(second, "ko", second_pattern or pattern), "series_id")
    m = lambda c: F.aggregate(c, F.lit(0.0), lambda a, v: a + v) / F.size(c)
    j = j.withColumn("_mean", (m("y_wt") + m("y_ko")) / 2)
    return j.where(F.col("_mean") >= ranks.percentile(j, F.col("_mean"), floor_percentile).scalar()).drop("_mean")


def tissue_table(wide: DataFrame, tissue: str, symbol: str = "Symbol", drop_prefix: str = "ENS", least: float = 0.0) -> DataFrame:
    """Array form of one tissue's columns (TISSUE.ZTnn): rows without a symbol or with an identifier for one left out, of equal symbols the
    row with the largest mean, means of at least ``least``."""
    times = {c: float(c.rpartition("ZT")[2]) for c in wide.columns if c.startswith(f"{tissue}.ZT")}
    order = sorted(times, key=times.__getitem__)
    rows = wide.where(F.col(symbol).isNotNull() & ~F.col(symbol).startswith(drop_prefix)).select(F.col(symbol).alias("symbol"), F.array(*[F.col(f"`{c}`").cast("double") for c in order]).alias("y"), F.lit([times[c] for c in order]).alias("t"))
    rows = rows.withColumn("_mean", F.aggregate("y", F.lit(0.0), lambda a, v: a + v) / F.size("y")).where(F.col("_mean") >= least)
    return relational.dedup_max_mean(rows, "symbol", F.col("_mean"), "y").select(F.col("symbol").alias("series_id"), "t", "y")


def subjects(long: DataFrame, subject: str = "all", floor_percentile: float | None = None) -> DataFrame:
    """Long form with a column subject to one subject's, or the mean over all subjects of each time; with a percentile without the
    series whose mean is below it."""
    out = series.average_replicates(long if subject == "all" else long.where(F.col("subject") == subject))
    if floor_percentile is None:
        return out
    means = out.groupBy("series_id").agg(F.avg("value").alias("m"))
    low = ranks.percentile(means, F.col("m"), floor_percentile).scalar()
    return out.join(means.where(F.col("m") >= low).select("series_id"), "series_id", "left_semi")


def workbook(spark: SparkSession, path: str, sheet: str = "1") -> DataFrame:
    """A sheet of a workbook, streamed by tasks; see ``sheets``."""
    from . import sheets

    sheets.register(spark)
    return spark.read.format("sheet").option("sheet", sheet).load(path)


# --- caches, sinks, registry -----------------------------------------------------------------------------------------


def cached(spark: SparkSession, path: str, make: Callable[[], DataFrame], partition_by: list[str] | None = None) -> DataFrame:
    """A table kept as Parquet: made and written where the folder isn't there yet, then read."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")):
        w = make().write.mode("overwrite")
        (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
    return spark.read.parquet(path)


def write_csv(df: DataFrame, path: str, single: bool = False) -> None:
    """Nested columns become JSON; single writes one part, for results that fit one task."""
    flat = df.select(*[F.to_json(f.name).alias(f.name) if f.dataType.typeName() in ("struct", "array", "map") else F.col(f"`{f.name}`") for f in df.schema])
    (flat.coalesce(1) if single else flat).write.mode("overwrite").csv(path, header=True)


def report(df: DataFrame, title: str) -> str:
    """Labels with their counts as text."""
    rows = df.groupBy("classification").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "classification").collect()
    total = sum(r.n for r in rows)
    return "\n".join([title, "=" * len(title), *(f"{r.classification:32s} {r.n:8d} {100 * r.n / total:5.1f} %" for r in rows)])


class Registry:
    """Datasets by name: a function of the session, with organism and hours between points."""

    def __init__(self) -> None:
        self.entries: dict[str, tuple[Callable[[SparkSession], DataFrame], dict]] = {}

    def register(self, name: str, load: Callable[[SparkSession], DataFrame], **about) -> None:
        if name in self.entries:
            raise ValueError(f"{name} is registered already")
        self.entries[name] = (load, about)

    def load(self, spark: SparkSession, name: str) -> DataFrame:
        """The dataset's rows with its name and what is known of it as columns."""
        load, about = self.entries[name]
        return load(spark).withColumns({"dataset": F.lit(name), **{k: F.lit(v) for k, v in about.items()}})

    def names(self) -> list[str]:
        return sorted(self.entries)
