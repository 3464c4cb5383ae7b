"""Scores of methods against labelled series, and tests of one method against another."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stats as S
from . import ranks

ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)


def confusion(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Counts of each pair y_true, y_pred."""
    return df.groupBy(*(keys or []), "y_true", "y_pred").agg(F.count("*").alias("n"))


def per_label(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Keys and label to support, precision, recall, f1, for each label that is true or predicted; 0 where undefined."""
    keys = keys or []
    c = confusion(df, keys)
    side = lambda col, t: c.select(*keys, F.col(col).alias("label"), *[(F.col("n") if x == t else F.lit(0)).alias(x) for x in ("true", "pred")], (F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0) if t == "true" else F.lit(0)).alias("hit"))
    g = side("y_true", "true").unionByName(side("y_pred", "pred")).groupBy(*keys, "label").agg(*[F.sum(x).alias(x) for x in ("true", "pred", "hit")])
    p, r = ratio(F.col("hit"), F.col("pred")), ratio(F.col("hit"), F.col("true"))
    return g.select(*keys, "label", F.col("true").alias("support"), p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r).alias("f1"))


def scores(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Keys (or one row) to n, accuracy, and the means over labels of precision, recall and F1."""
    keys = keys or []
    acc = confusion(df, keys).groupBy(*keys).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0)).alias("hit"))
    macro = per_label(df, keys).groupBy(*keys).agg(*[F.avg(x).alias(f"macro_{x}") for x in ("precision", "recall", "f1")])
    j = acc.join(macro, keys) if keys else acc.join(F.broadcast(macro), F.lit(True))
    return j.select(*keys, "n", ratio(F.col("hit"), F.col("n")).alias("accuracy"), "macro_precision", "macro_recall", "macro_f1")


def binary(df: DataFrame, truth: Column, pred: Column, keys: list[str] | None = None) -> DataFrame:
    """tp, fp, tn, fn, accuracy, sensitivity, specificity, precision, f1; rows with a null answer don't count."""
    c = lambda t, p: F.count_if((truth == t) & (pred == p))
    g = df.groupBy(*(keys or [])).agg(c(True, True).alias("tp"), c(False, True).alias("fp"), c(False, False).alias("tn"), c(True, False).alias("fn"))
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    sens, prec = ratio(tp, tp + fn), ratio(tp, tp + fp)
    return g.select(*(keys or []), "tp", "fp", "tn", "fn", ratio(tp + tn, tp + fp + tn + fn).alias("accuracy"), sens.alias("sensitivity"), ratio(tn, tn + fp).alias("specificity"), prec.alias("precision"), ratio(2 * prec * sens, prec + sens).alias("f1"))


def parameter_errors(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Mean, median and spread of errors of period (absolute), amplitude (relative, absolute for a true 0) and phase (circular), from
    columns period, amplitude, phase and the same with true_."""
    amp = F.abs(F.col("amplitude") - F.col("true_amplitude")) / F.when(F.col("true_amplitude") == 0, 1.0).otherwise(F.abs("true_amplitude"))
    err = {"period": F.abs(F.col("period") - F.col("true_period")), "amplitude": amp, "phase": F.abs(S.angle_between(F.col("phase"), F.col("true_phase")))}
    g = df.groupBy(*(keys or [])).agg(F.count("*").alias("n"), *[f(e).alias(f"{k}_{n}") for k, e in err.items() for n, f in (("mean", F.avg), ("sd", F.stddev_pop))])
    g = ranks.meet(g, ranks.percentiles(df, {f"{k}_median": (e, 0.5) for k, e in err.items()}, keys), keys or [], *[f"{k}_median" for k in err], how="left")
    return g.select(*(keys or []), "n", *[f"{k}_{n}" for k in err for n in ("mean", "median", "sd")])


def roc_points(df: DataFrame, score: Column, truth: Column, keys: list[str] | None = None) -> DataFrame:
    """Keys, threshold, tpr, fpr: a point for each distinct score from the top; equal scores are one point, null scores are least.

    A label and score are counted first, and points are running sums by ranges of scores: see ``ranks``.
    """
    keys = keys or []
    g = _roc_counts(df, score, truth, keys)
    return g.select(*keys, F.negative("v").alias("threshold"), F.try_divide(F.col("tp") + F.col("p"), F.col("tp_all")).alias("tpr"), F.try_divide(F.col("fp") + F.col("n"), F.col("fp_all")).alias("fpr"))


def _roc_counts(df: DataFrame, score: Column, truth: Column, keys: list[str]) -> DataFrame:
    """v (the score's negative), p and n (rows of each label), and of the higher scores tp and fp, with totals."""
    v = -F.coalesce(F.nanvl(score.cast("double"), F.lit(float("-inf"))), F.lit(float("-inf")))
    rows = df.where(truth.isNotNull()).select(*keys, v.alias("v"), truth.cast("int").alias("t"))
    counts = rows.groupBy(*keys, "v").agg(F.sum("t").alias("p"), F.sum(1 - F.col("t")).alias("n"))
    return ranks.running(counts, "v", {"tp": F.col("p"), "fp": F.col("n")}, keys)


def auc(df: DataFrame, score: Column, truth: Column, keys: list[str] | None = None) -> DataFrame:
    """Keys to the area under the ROC curve by trapezoids: null where a class is missing."""
    keys = keys or []
    area = F.col("n").cast("double") * (2 * F.col("tp") + F.col("p")) / 2
    whole = F.max("tp_all").cast("double") * F.max("fp_all")
    return _roc_counts(df, score, truth, keys).groupBy(*keys).agg(F.when(whole > 0, F.sum(area) / whole).alias("auc"))


def log_p_score(p: Column) -> Column:
    """The other score for ROC curves: -log10 p, p from 1e-300."""
    return -F.log10(F.greatest(p, F.lit(1e-300)))


def mcnemar(df: DataFrame, right_a: Column, right_b: Column, keys: list[str] | None = None) -> DataFrame:
    """b, c (one method right, the other wrong), p_value: exact below 25 discordant pairs, else chi-squared with continuity."""
    g = df.groupBy(*(keys or [])).agg(F.count_if(right_a & ~right_b).alias("b"), F.count_if(~right_a & right_b).alias("c"))
    n, k = F.col("b") + F.col("c"), F.least("b", "c")
    tail = S.sum_over(F.lit(0), k, lambda j: F.exp(S.log_factorial(n) - S.log_factorial(j) - S.log_factorial(n - j) - n * math.log(2)))
    chi = (F.abs(F.col("b") - F.col("c")) - 1) ** 2 / n
    return g.withColumn("p_value", F.when(n == 0, 1.0).when(n < 25, F.least(F.lit(1.0), 2 * tail)).otherwise(S.chi2_sf_1(chi)))


def delong(df: DataFrame, a: str, b: str, truth: Column, key: str = "series_id") -> DataFrame:
    """One row: auc_a, auc_b, z, p_value of the difference of two correlated areas, from mid-ranks (no pairs are formed).

    Placement values are differences of a score's mid-rank among all and within its class; their covariances give the variance.
    """
    rows = df.where(truth.isNotNull() & F.col(a).isNotNull() & F.col(b).isNotNull()).select(key, a, b, truth.cast("int").alias("_t"))
    for s in (a, b):
        g = rows.groupBy(s).agg(F.sum("_t").alias("_p"), F.sum(1 - F.col("_t")).alias("_n"))
        g = ranks.running(g, s, {"_bp": F.col("_p"), "_bn": F.col("_n")})
        place = g.select(s, (F.col("_bn") + F.col("_n") / 2).alias(f"_v_{s}"), (F.col("_bp") + F.col("_p") / 2).alias(f"_w_{s}"))
        rows = rows.join(place, s)
    m = rows.agg(F.sum("_t").cast("double").alias("m"), F.sum(1 - F.col("_t")).cast("double").alias("n"))
    rows = rows.join(F.broadcast(m), F.lit(True))
    pos, neg = F.col("_t") == 1, F.col("_t") == 0
    v = {s: F.when(pos, F.col(f"_v_{s}") / F.col("n")) for s in (a, b)}
    w = {s: F.when(neg, 1 - F.col(f"_w_{s}") / F.col("m")) for s in (a, b)}
    g = rows.agg(F.avg(v[a]).alias("auc_a"), F.avg(v[b]).alias("auc_b"), F.first("m").alias("m"), F.first("n").alias("n"), *[F.covar_samp(x[p], x[q]).alias(f"{k}{p is b and 1 or 0}{q is b and 1 or 0}") for k, x in (("v", v), ("w", w)) for p, q in ((a, a), (b, b), (a, b))])
    var = sum((s * (F.col(f"v{ij}") / F.col("m") + F.col(f"w{ij}") / F.col("n")) for ij, s in (("00", 1), ("11", 1), ("01", -2))), F.lit(0.0))
    z = F.when(var > 1e-15, (F.col("auc_a") - F.col("auc_b")) / F.sqrt(var)).otherwise(0.0)
    return g.select("auc_a", "auc_b", z.alias("z"), S.normal_sf_two_sided(z).alias("p_value"))


def bootstrap_metric(df: DataFrame, metric: Callable[[np.ndarray, np.ndarray, np.ndarray], float], truth: str = "y_true", pred: str = "y_pred", n: int = 10_000, seed: int = 42, blocks: int = 32) -> DataFrame:
    """One row: value, lo, hi of a metric(true, predicted, rows) with its 95% percentile interval over resampled rows.

    The metric sees each pair of labels once, with its number of rows: resampled rows are a multinomial draw of those numbers.
    """
    (t, p), c = _cells(df, [truth, pred])

    def draw(rng: np.random.RandomState) -> float:
        return float(metric(t, p, rng.multinomial(c.sum(), c / c.sum())))

    sims = _simulated(df, draw, n, seed, blocks)
    return sims.agg(F.percentile("v", [0.025, 0.975]).alias("q")).select(F.lit(float(metric(t, p, c))).alias("value"), F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"))


def _cells(df: DataFrame, cols: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct labels of the columns, and the number of rows of each combination: a row for each, whatever the table's size."""
    rows = df.groupBy(*cols).agg(F.count("*").alias("_rows")).orderBy(*cols).toArrow()
    arrays = [np.asarray(rows[c].combine_chunks() if rows.num_rows else []) for c in (*cols, "_rows")]
    return arrays[:-1], arrays[-1].astype(np.int64)


def _simulated(df: DataFrame, draw: Callable[[np.random.RandomState], float], n: int, seed: int, blocks: int) -> DataFrame:
    """v of n draws, in blocks with seeds of their own."""
    per = -(-n // blocks)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for k in batch.column(0).to_pylist():
                rng = np.random.RandomState(seed + k)
                out += [draw(rng) for _ in range(min(per, n - k * per))]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.float64())], ["v"])

    return df.sparkSession.range(-(-n // per), numPartitions=blocks).mapInArrow(run, "v double")


def permutation_metric(df: DataFrame, metric: Callable[[np.ndarray, np.ndarray, np.ndarray], float], a: str, b: str, truth: str = "y_true", n: int = 10_000, seed: int = 42, blocks: int = 32) -> DataFrame:
    """One row: difference, p_value of a metric(true, predicted, rows) of two methods whose answers are exchanged at random, row by row.

    Of the rows with the same three labels a binomial number is exchanged.
    """
    (t, x, y), c = _cells(df, [truth, a, b])
    seen = float(metric(t, x, c)) - float(metric(t, y, c))
    both, xy, yx = np.concatenate([t, t]), np.concatenate([x, y]), np.concatenate([y, x])

    def draw(rng: np.random.RandomState) -> float:
        swap = rng.binomial(c, 0.5)
        rows = np.concatenate([c - swap, swap])
        return float(abs(metric(both, xy, rows) - metric(both, yx, rows)) >= abs(seen) - 1e-12)

    sims = _simulated(df, draw, n, seed, blocks)
    return sims.agg(F.sum("v").alias("h")).select(F.lit(seen).alias("difference"), ((F.col("h") + 1) / (n + 1)).alias("p_value"))


def compare_methods(df: DataFrame, reference: str) -> DataFrame:
    """Rows (series_id, method, y_true, y_pred) to each other method's McNemar test against the reference, p adjusted by Bonferroni.

    reference_better: the reference is right more often where they differ, significantly after the adjustment.
    """
    ref = df.where(F.col("method") == reference).select("series_id", (F.col("y_true") == F.col("y_pred")).alias("ref_right"))
    j = df.where(F.col("method") != reference).select("series_id", "method", (F.col("y_true") == F.col("y_pred")).alias("right")).join(ref, "series_id")
    m = mcnemar(j, F.col("ref_right"), F.col("right"), ["method"])
    k = m.agg(F.count("*")).scalar()
    adj = F.least(F.lit(1.0), F.col("p_value") * k)
    return m.select("method", "b", "c", "p_value", adj.alias("p_adjusted"), ((adj < 0.05) & (F.col("b") > F.col("c"))).alias("reference_better"))


def stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("ns")


def markdown(df: DataFrame, digits: int = 3, most: int = 1000) -> str:
    """A report table as Markdown, of at most ``most`` rows."""
    head = "| " + " | ".join(df.columns) + " |\n|" + "---|" * len(df.columns)
    show = lambda v: f"{v:.{digits}f}" if isinstance(v, float) else str(v)
    return "\n".join([head, *("| " + " | ".join(show(v) for v in r) + " |" for r in df.limit(most).collect())])


def latex(df: DataFrame, digits: int = 3, most: int = 1000) -> str:
    """A report table as LaTeX, of at most ``most`` rows: numbers to the right, null as a dash, special characters escaped."""
    special = {c: "\\" + c for c in "&%$#_{}"} | {"\\": r"\textbackslash{}", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}"}
    text = lambda v: "".join(special.get(c, c) for c in str(v))
    show = lambda v: "---" if v is None or v != v else f"{v:.{digits}f}" if isinstance(v, float) else text(v)
    align = "".join("l" if f.dataType.typeName() in ("string", "boolean") else "r" for f in df.schema)
    rows = [" & ".join(show(v) for v in r) + r" \\" for r in df.limit(most).collect()]
    return "\n".join([rf"\begin{{tabular}}{{{align}}}", r"\toprule", " & ".join(text(c) for c in df.columns) + r" \\", r"\midrule", *rows, r"\bottomrule", r"\end{tabular}"])


def latency(df: DataFrame, ms: Column, keys: list[str]) -> DataFrame:
    """Mean, median, spread, 95th percentile and number of the positive latencies."""
    ok = F.when(ms > 0, ms)
    g = df.groupBy(*keys).agg(F.avg(ok).alias("mean_ms"), F.stddev_pop(ok).alias("sd_ms"), F.count(ok).alias("n"))
    g = ranks.meet(g, ranks.percentiles(df, {"median_ms": (ok, 0.5), "p95_ms": (ok, 0.95)}, keys), keys, "median_ms", "p95_ms", how="left")
    return g.select(*keys, "mean_ms", "median_ms", "sd_ms", "p95_ms", "n")


def recovery(df: DataFrame, keys: list[str], detected: Column) -> DataFrame:
    """Share of detected series for each key: n, n_detected, rate."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(detected).alias("n_detected"), F.avg(detected.cast("double")).alias("rate"))


def folds(df: DataFrame, k: int, key: str = "series_id", seed: int = 42) -> DataFrame:
    """Adds fold, from a hash of the id: the same whatever the table's order."""
    return df.withColumn("fold", F.pmod(F.xxhash64(F.lit(seed), key), F.lit(k)).cast("int"))


def cross_validate(df: DataFrame, k: int = 5, keys: list[str] | None = None) -> DataFrame:
    """Scores of each fold, for rows with series_id, y_true, y_pred."""
    return scores(folds(df, k), [*(keys or []), "fold"])


def sensitivity(base: float, spread: float = 0.2, steps: int = 5) -> list[float]:
    """Values of a setting around its default for a sweep."""
    return [base * (1 - spread + 2 * spread * i / (steps - 1)) for i in range(steps)]
