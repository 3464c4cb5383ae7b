"""Modules of series with like rhythms: clustering, coherence, enrichment, shrinkage and reclassification."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats as S
from . import population, ranks

FEATURES = ("A_12", "A_24", "amp_ratio", "cos_12", "sin_12", "cos_24", "sin_24", "log_bf")
INDEPENDENT = ("independent_ultradian", "likely_independent_ultradian")


def features(df: DataFrame, rows: bool = False) -> DataFrame:
    """series_id and eight features of a result table; missing ones take the column's median, or 0 where all are missing.
    With rows, the row itself comes along as ``_row``. The medians are found at once."""
    ratio = F.col("A_12") / F.greatest("A_24", F.lit(1e-10))
    cols = {"A_12": F.col("A_12"), "A_24": F.col("A_24"), "amp_ratio": ratio, "cos_12": F.cos("phi_12"), "sin_12": F.sin("phi_12"), "cos_24": F.cos("phi_24"), "sin_24": F.sin("phi_24"), "log_bf": F.col("log_bf")}
    raw = df.select("series_id", *[F.struct(*df.columns).alias("_row")] * rows, *[F.nanvl(c.cast("double"), F.lit(None)).alias(k) for k, c in cols.items()])
    return impute_median(raw, list(cols), now=True)


def impute_median(df: DataFrame, cols: list[str], now: bool = False) -> DataFrame:
    """Nulls and NaN replaced by the exact median of their column; 0 where a column has no value. ``now``: the medians are found once, by a job of
    their own, for a table that is read many times."""
    clean = df.select(*[c for c in df.columns if c not in cols], *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in cols])
    med = ranks.percentiles(clean, {f"_m_{c}": (F.col(c), 0.5) for c in cols})  # one row
    clean = clean.withColumns({k: F.lit(v).cast("double") for k, v in med.first().asDict().items()}) if now else clean.join(F.broadcast(med), F.lit(True))
    return clean.select(*[c for c in df.columns if c not in cols], *[F.coalesce(c, f"_m_{c}", F.lit(0.0)).alias(c) for c in cols])


def standardise(df: DataFrame, cols: list[str]) -> DataFrame:
    """Columns less their mean, over their population standard deviation (or over 1 where that is 0); both are found at once, by one job."""
    m = df.agg(*[F.avg(c).alias(f"_m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"_s_{c}") for c in cols]).first()
    z = lambda c: (F.col(c) - F.lit(m[f"_m_{c}"]).cast("double")) / F.lit(m[f"_s_{c}"] or 1.0)
    return df.select(*[c for c in df.columns if c not in cols], *[z(c).alias(c) for c in cols])


def squared_distances(x: np.ndarray) -> np.ndarray:
    own = (x * x).sum(axis=1)
    d = np.maximum(own[:, None] + own - 2 * (x @ x.T), 0)
    d[d < 1e-14 * (own[:, None] + own)] = 0
    return d


def ward_distances(x: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Squared distances of Ward's method between clusters of given centres and sizes; for single rows the squared distances."""
    return squared_distances(x) * (2 * size[:, None] * size / (size[:, None] + size))


def ward(x: np.ndarray, size: np.ndarray | None = None) -> list[tuple[int, int, float]]:
    """Merges of Ward's method by the nearest-neighbour chain: (cluster, cluster, distance), clusters by their first row.

    Rows with a size are centres of clusters of so many rows.
    """
    n = len(x)
    size = np.ones(n) if size is None else size.astype(float)
    d = ward_distances(x, size)
    np.fill_diagonal(d, np.inf)
    alive, chain, merges = np.ones(n, bool), [], []
    while len(merges) < n - 1:
        if not chain:
            chain.append(int(np.flatnonzero(alive)[0]))
        while True:
            i = chain[-1]
            j = int(np.argmin(d[i]))
            if len(chain) > 1 and d[i, chain[-2]] <= d[i, j]:
                j = chain[-2]
                break
            chain.append(j)
        chain = chain[:-2]
        a, b = min(i, j), max(i, j)
        merges.append((a, b, float(np.sqrt(d[a, b]))))
        others = alive.copy()
        others[[a, b]] = False
        new = ((size[a] + size) * d[a] + (size[b] + size) * d[b] - size * d[a, b]) / (size[a] + size[b] + size)
        d[a, others] = d[others, a] = new[others]
        d[b], d[:, b] = np.inf, np.inf
        alive[b] = False
        size[a] += size[b]
    return sorted(merges, key=lambda m: m[2])


def cut(merges: list[tuple[int, int, float]], n: int, k: int) -> np.ndarray:
    """Labels 0.. of k clusters, numbered by their first row."""
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b, _ in merges[: n - k]:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return np.unique([find(i) for i in range(n)], return_inverse=True)[1]


def silhouette(d: np.ndarray, labels: np.ndarray, size: np.ndarray | None = None, within: np.ndarray | None = None) -> float:
    """The mean silhouette of labels from distances; rows with a size count as so many, ``within`` apart from each other on average."""
    k = int(labels.max()) + 1
    weight = np.ones(len(d)) if size is None else size
    one = np.eye(k)[labels]
    of = one.T @ weight
    total = d @ (one * weight[:, None])
    own = total[np.arange(len(d)), labels] + (0 if within is None else (weight - 1) * within)
    own = own / np.maximum(of[labels] - 1, 1)
    other = np.where(one > 0, np.inf, total / of).min(axis=1)
    value = np.where(of[labels] > 1, (other - own) / np.maximum(np.maximum(own, other), 1e-300), 0)
    return float((value * weight).sum() / weight.sum())


# --- leaves: clusters of rows as sums ------------------------------------------------------------------------------

#: Rows whose distances to all are held at once when leaves look for their nearest.
STRIP = 128


def nearest_others(x: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each cluster the nearest other one by Ward's distance, the first of equals, and that distance; a strip of the distances is held at a time.

    A distance is the same both ways to the last bit, so the two nearest of all are each other's nearest.
    """
    near, far = np.empty(len(x), np.int64), np.empty(len(x))
    cols = np.ascontiguousarray(x.T)
    for lo in range(0, len(x), STRIP):
        hi = min(lo + STRIP, len(x))
        d, diff = np.zeros((hi - lo, len(x))), np.empty((hi - lo, len(x)))
        for c in cols:
            np.subtract(c[lo:hi, None], c, out=diff)
            np.multiply(diff, diff, out=diff)
            d += diff
        np.add(size[lo:hi, None], size, out=diff)
        np.divide(size[lo:hi, None] * size, diff, out=diff)
        d *= diff
        d *= 2
        d[np.arange(hi - lo), np.arange(lo, hi)] = np.inf
        near[lo:hi] = d.argmin(axis=1)
        far[lo:hi] = d[np.arange(hi - lo), near[lo:hi]]
    return near, far


def condense(n: np.ndarray, total: np.ndarray, squares: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Leaves (rows, their sum, their sum of squares) merged by Ward's distance until there are at most so many.

    Equal centres merge first. Then, in rounds, pairs of leaves that are each other's nearest do: those are merges that Ward's method makes.
    """
    if len(n) > 1:
        _, first, same = np.unique(np.round(total / n[:, None], 12), axis=0, return_index=True, return_inverse=True)
        if len(first) < len(n):
            same = same.ravel()
            n, total, squares = (np.stack([np.bincount(same, c) for c in np.atleast_2d(v.T)], axis=-1).reshape(len(first), *v.shape[1:]) for v in (n.astype(float), total, squares))
    while len(n) > most:
        near, far = nearest_others(total / n[:, None], n)
        i = np.flatnonzero((near[near] == np.arange(len(n))) & (near > np.arange(len(n))))
        i = i[np.argsort(far[i], kind="stable")][: len(n) - most]
        j = near[i]
        n, total, squares = n.copy(), total.copy(), squares.copy()
        n[i], total[i], squares[i] = n[i] + n[j], total[i] + total[j], squares[i] + squares[j]
        keep = np.ones(len(n), bool)
        keep[j] = False
        n, total, squares = n[keep], total[keep], squares[keep]
    return n, total, squares


def leaves(df: DataFrame, cols: list[str], most: int = 2000, fan_in: int = 8) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """At most so many leaves of all rows: every task condenses its rows, then ``fan_in`` tasks' leaves meet in one, until one is left."""
    import pyarrow as pa

    def run(batches):
        held, rows = None, []

        def gather():
            parts = rows if held is None else [held, *rows]
            return condense(*(np.concatenate(c) for c in zip(*parts, strict=True)), most)

        waiting = 0
        for batch in batches:
            n, squares = (batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in (0, 1))
            total = np.stack([batch.column(2 + i).to_numpy(zero_copy_only=False) for i in range(len(cols))], axis=1).astype(float)
            for lo in range(0, len(n), most):
                rows.append((n[lo : lo + most], total[lo : lo + most], squares[lo : lo + most]))
                waiting += len(rows[-1][0])
                if waiting >= most:
                    held, rows, waiting = gather(), [], 0
        if rows:
            held = gather()
        if held is not None and len(held[0]):
            n, total, squares = held
            yield pa.RecordBatch.from_arrays([pa.array(n), pa.array(squares), *[pa.array(total[:, i]) for i in range(len(cols))]], names)

    names = ["n", "squares", *[f"x{i}" for i in range(len(cols))]]
    out = df.select(F.lit(1.0).alias("n"), sum((F.col(c) * F.col(c) for c in cols), F.lit(0.0)).alias("squares"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(cols)])
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.sparkSession.sparkContext.defaultParallelism)
    kind = ", ".join(f"{c} double" for c in names)
    out = out.mapInArrow(run, kind)
    while parts > 1:
        parts = -(-parts // fan_in)
        out = out.repartition(parts).mapInArrow(run, kind)
    rows = out.toArrow()
    x = np.stack([rows[c].to_numpy() for c in names], axis=1).reshape(rows.num_rows, len(names))
    x = x[np.lexsort(x.T[::-1])]
    return x[:, 0], x[:, 2:], x[:, 1]


def nearest(cols: list[str], centres: np.ndarray) -> Column:
    """The number of the centre nearest to a row, the first of equals."""

    @F.pandas_udf("int")
    def number(*x: pd.Series) -> pd.Series:
        v = np.stack([c.to_numpy(float) for c in x], axis=1)
        out = np.empty(len(v), np.int32)
        own = (centres * centres).sum(axis=1)
        for lo in range(0, len(v), 1024):
            out[lo : lo + 1024] = (own - 2 * v[lo : lo + 1024] @ centres.T).argmin(axis=1)
        return pd.Series(out)

    return number(*[F.col(c) for c in cols])


def means_of_nearest(rows: DataFrame, cols: list[str], centres: np.ndarray) -> dict[int, np.ndarray]:
    """For each centre that is the nearest of some rows the mean of those: a task adds up its rows, and only its sums, one for each centre, leave it."""
    import pyarrow as pa

    k, names = len(centres), ["c", "n", *[f"x{i}" for i in range(len(cols))]]
    own = (centres * centres).sum(axis=1)

    def run(batches):
        size, total = np.zeros(k), np.zeros((len(cols), k))
        for batch in batches:
            v = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(len(cols))], axis=1)
            label = (own - 2 * v @ centres.T).argmin(axis=1)
            size += np.bincount(label, minlength=k)
            for i in range(len(cols)):
                total[i] += np.bincount(label, v[:, i], k)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k)), pa.array(size), *[pa.array(t) for t in total]], names)

    sums = rows.select(*cols).mapInArrow(run, "c bigint, n double, " + ", ".join(f"{x} double" for x in names[2:])).toArrow()
    c, n, *x = (sums[name].to_numpy() for name in names)
    n, x = np.bincount(c, n, k), np.stack([np.bincount(c, v, k) for v in x], axis=1)
    return {i: x[i] / n[i] for i in np.flatnonzero(n).tolist()}


# --- modules -------------------------------------------------------------------------------------------------------


def ward_labels(n: np.ndarray, total: np.ndarray, squares: np.ndarray, k: int | None) -> np.ndarray:
    """Labels of leaves by Ward's method, of k clusters or of the best silhouette of 2 to 20."""
    x = total / n[:, None]
    if n.sum() < 3 or len(n) < 2:
        return np.zeros(len(n), int)
    merges = ward(x, n)
    if k is None:
        radius2 = np.maximum(squares / n - (x * x).sum(axis=1), 0)
        within = np.sqrt(2 * radius2 * n / np.maximum(n - 1, 1))
        d = np.sqrt(squared_distances(x))
        k = max(range(2, min(20, len(n) - 1, int(n.sum()) - 1) + 1), key=lambda i: (round(silhouette(d, cut(merges, len(n), i), n, within), 12), -i), default=1)
    return cut(merges, len(n), min(k, len(n)))


def merged(size: np.ndarray, total: np.ndarray, first: list, least: int) -> np.ndarray:
    """For each cluster the one it ends in: those below a size join the nearest centre of the others, smallest first; numbers go by first members."""
    of = np.arange(len(size))
    size, total, first = size.astype(float).copy(), total.copy(), list(first)
    while True:
        ids = np.unique(of)
        if len(ids) < 2 or size[ids].min() >= least:
            break
        small = min(ids, key=lambda i: (size[i], first[i]))
        rest = ids[ids != small]
        c = total[rest] / size[rest, None] - total[small] / size[small]
        to = rest[int(np.argmin((c * c).sum(axis=1)))]
        size[to], total[to], first[to] = size[to] + size[small], total[to] + total[small], min(first[to], first[small])
        of[of == small] = to
    order = sorted(np.unique(of), key=lambda i: first[i])
    return np.array([order.index(i) for i in of], int)


def spectral_coordinates(z: DataFrame, cols: list[str], k: int) -> tuple[DataFrame, list[str]]:
    """z with the rows of the leading k vectors of its normalised affinity, each of length one, and their columns.

    The affinity (r + 1) / 2, r the correlation of two rows' features, is a product of rows (1, u) with u the row less its mean at unit length
    (zeros for a constant row). So degrees are a sum, and the vectors come from a matrix of one row and column a feature, itself a sum over rows:
    the affinities themselves are never made.
    """
    mean = sum((F.col(c) for c in cols), F.lit(0.0)) / len(cols)
    norm = F.sqrt(sum(((F.col(c) - mean) ** 2 for c in cols), F.lit(0.0)))
    b = [F.lit(math.sqrt(0.5))] + [F.when(norm > 1e-12, (F.col(c) - mean) / norm).otherwise(0.0) * math.sqrt(0.5) for c in cols]
    names = [f"_b{i}" for i in range(len(b))]
    rows = z.select("*", *[v.alias(n) for n, v in zip(names, b, strict=True)])
    total = np.array(rows.agg(*[F.coalesce(F.sum(n), F.lit(0.0)) for n in names]).first(), float)
    degree = F.greatest(sum((F.col(n) * float(v) for n, v in zip(names, total, strict=True)), F.lit(0.0)), F.lit(1e-12))
    pairs = [(i, j) for i in range(len(b)) for j in range(i, len(b))]
    sums = rows.agg(*[F.coalesce(F.sum(F.col(names[i]) * F.col(names[j]) / degree), F.lit(0.0)) for i, j in pairs]).first()
    gram = np.zeros((len(b), len(b)))
    for (i, j), v in zip(pairs, sums, strict=True):
        gram[i, j] = gram[j, i] = v
    value, vector = np.linalg.eigh(gram)
    on = [i for i in range(len(b) - 1, -1, -1) if value[i] > 1e-10][:k]
    axes = [vector[:, i] / math.sqrt(value[i]) for i in on]
    raw = [sum((F.col(n) * float(w) for n, w in zip(names, a, strict=True)), F.lit(0.0)) / F.sqrt(degree) for a in axes]
    found = [f"_v{i}" for i in range(len(axes))]
    out = rows.select(*z.columns, *[r.alias(f) for r, f in zip(raw, found, strict=True)])
    length = F.greatest(F.sqrt(sum((F.col(f) ** 2 for f in found), F.lit(0.0))), F.lit(1e-12))
    return out.select(*z.columns, *[(F.col(f) / length).alias(f) for f in found]), found


def k_means(df: DataFrame, cols: list[str], k: int, rounds: int = 100, most_leaves: int = 2000) -> np.ndarray:
    """Centres of at most k clusters: found among the leaves of all rows, then moved to the means of their rows until they stay.

    The first centre is the leaf of most rows, each further one the leaf farthest from all before. Up to ``most_leaves`` different rows the leaves
    are the rows, and one round over the table tells that nothing moves.
    """
    # as many parts as cores, held for the rounds
    held = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).coalesce(df.sparkSession.sparkContext.defaultParallelism).persist(StorageLevel.MEMORY_AND_DISK)
    n, total, _ = leaves(held, cols, most_leaves)
    if not len(n):
        held.unpersist()
        return np.zeros((0, len(cols)))
    x = total / n[:, None]
    centres = x[[int(np.argmax(n))]]
    apart = lambda c: ((x[:, None] - c[None]) ** 2).sum(axis=2)
    while len(centres) < k:
        d = np.round(apart(centres).min(axis=1), 12)
        if d.max() <= 0:
            break
        centres = np.vstack([centres, x[int(np.argmax(d))]])

    def moved(means: dict[int, np.ndarray]) -> np.ndarray:
        return np.stack([means.get(i, c) for i, c in enumerate(centres)])

    for _ in range(rounds):
        label = apart(centres).argmin(axis=1)
        new = moved({i: np.average(x[label == i], axis=0, weights=n[label == i]) for i in np.unique(label)})
        still, centres = np.allclose(new, centres), new
        if still:
            break
    for _ in range(rounds):
        new = moved(means_of_nearest(held, cols, centres))
        still, centres = np.allclose(new, centres), new
        if still:
            break
    held.unpersist()
    return centres


def modules(feature_table: DataFrame, k: int | None = None, method: str = "ward", least: int = 5, most_leaves: int = 2000) -> DataFrame:
    """series_id, module_id of a feature table of any number of rows; modules of fewer than ``least`` join the nearest, and are numbered by their first series.

    ward: rows are condensed to at most ``most_leaves`` leaves over the cluster, Ward's method links the leaves, and a row is where its nearest leaf is;
    up to that number of different rows it is Ward's method of the rows. k comes from the best silhouette of 2 to 20 cuts of the linkage.
    spectral: exact for any number of rows (default k: 8). bisecting: bisecting k-means (default k: 20), without the merge of small modules.
    A column ``_row`` is no feature and stays.
    """
    cols = [c for c in feature_table.columns if c not in ("series_id", "_row")]
    kept = [c for c in feature_table.columns if c not in cols]
    z = standardise(feature_table, cols)
    if method == "bisecting":
        from pyspark.ml.clustering import BisectingKMeans
        from pyspark.ml.feature import VectorAssembler

        # a cluster is split at its centre times 1 -/+ 1e-4: standardised rows, whose centre is 0, would stay whole
        v = VectorAssembler(inputCols=cols, outputCol="_v").transform(z.select(*kept, *[(F.col(c) + 1).alias(c) for c in cols]))
        return BisectingKMeans(k=k or 20, seed=42, featuresCol="_v", predictionCol="module_id").fit(v).transform(v).select(*kept, "module_id")
    if method == "spectral":
        z = z.persist(StorageLevel.MEMORY_AND_DISK)  # for the passes until labels are known
        n = z.count()
        v, axes = spectral_coordinates(z, cols, min(k or 8, max(n - 1, 1)))
        centres = k_means(v, axes, min(k or 8, max(n - 1, 1))) if n > 2 else np.zeros((1, len(axes)))
        labelled = v.withColumn("_label", nearest(axes, centres) if axes and len(centres) else F.lit(0))
    else:
        n, total, squares = leaves(z, cols, most_leaves)
        label = ward_labels(n, total, squares, k)
        labelled = z.withColumn("_leaf", nearest(cols, total / n[:, None]) if len(n) else F.lit(0))
        labelled = labelled.withColumn("_label", F.element_at(F.lit(label.tolist() or [0]), F.col("_leaf") + 1))
    of = labelled.groupBy("_label").agg(F.count("*").alias("_n"), F.min("series_id").alias("_first"), *[F.sum(c).alias(f"_s{i}") for i, c in enumerate(cols)]).collect()
    z.unpersist()
    if not of:
        return labelled.select(*kept, F.lit(0).alias("module_id"))
    to = merged(np.array([r["_n"] for r in of]), np.array([r[3:] for r in of], float).reshape(len(of), len(cols)), [(r["_first"] is not None, r["_first"]) for r in of], least)
    number = {r["_label"]: int(m) for r, m in zip(of, to, strict=True)}
    named = F.element_at(F.lit([number.get(i, 0) for i in range(max(number) + 1)]), F.col("_label") + 1)
    return labelled.select(*kept, named.alias("module_id"))


def phase_coherence(df: DataFrame, published: bool = True) -> DataFrame:
    """module_id to n, r, mean_direction, p_value of phi_12 (the modules' p formula; see ``population.zar_p``)."""
    g = df.where(F.col("phi_12").isNotNull()).groupBy("module_id").agg(F.count("*").alias("n"), F.avg(F.cos("phi_12")).alias("c"), F.avg(F.sin("phi_12")).alias("s"))
    r = F.sqrt(F.col("c") ** 2 + F.col("s") ** 2)
    return g.select("module_id", "n", r.alias("r"), F.atan2("s", "c").alias("mean_direction"), population.zar_p(F.col("n").cast("double"), r, published).alias("p_value"))


def enrichment(df: DataFrame) -> DataFrame:
    """module_id to its most enriched classification: n, k, label, p_value (one-sided exact test over all labels of the table)."""
    cell = df.groupBy("module_id", "classification").agg(F.count("*").alias("k"))
    size = cell.groupBy("module_id").agg(F.sum("k").alias("n"))
    label = cell.groupBy("classification").agg(F.sum("k").alias("marked"))
    total = size.agg(F.sum("n")).scalar()
    t = cell.join(size, "module_id").join(label, "classification").withColumn("total", total)
    t = t.withColumn("p_value", S.hypergeometric_sf(F.col("k"), F.col("total"), F.col("marked"), F.col("n")))
    best = t.groupBy("module_id").agg(F.min(F.struct("p_value", "classification", "n", "k")).alias("b"))
    return best.select("module_id", "b.n", "b.k", F.col("b.classification").alias("label"), F.col("b.p_value").alias("p_value"))


def refine(df: DataFrame, enriched: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Adds refined: ambiguous series take likely_ and their module's enriched label, once."""
    e = enriched.where(F.col("p_value") < alpha).select("module_id", F.regexp_replace("label", "^likely_", "").alias("_dominant"))
    likely = F.when((F.col("classification") == "ambiguous") & (F.col("_dominant") != "ambiguous"), F.concat(F.lit("likely_"), "_dominant"))
    return df.join(e, "module_id", "left").withColumn("refined", F.coalesce(likely, "classification")).drop("_dominant")


def concentration(r: Column) -> Column:
    """The approximate von Mises concentration of a mean resultant length, 500 at most."""
    high = F.coalesce(F.try_divide(F.lit(1.0), 2 * (1 - r) - (1 - r) ** 2), F.lit(500.0))  # one angle, r = 1
    return F.when(r < 1e-10, 0.0).otherwise(F.least(F.lit(500.0), F.when(r >= 0.85, high).otherwise(F.try_divide(r * (2 - r * r), 1 - r * r))))


def hyperparameters(df: DataFrame, least: int = 5) -> DataFrame:
    """Modules of enough series: means and spreads of amplitudes, circular means and concentrations of phases, shares of labels."""
    g = df.groupBy("module_id").agg(
        F.count("*").alias("n_series"),
        *[f(F.col(f"A_{p}")).alias(f"{k}_A_{p}") for p in (12, 24) for k, f in (("mu", F.avg), ("sigma", F.stddev_samp))],
        *[F.avg(f(F.col(f"phi_{p}"))).alias(f"_{k}_{p}") for p in (12, 24) for k, f in (("c", F.cos), ("s", F.sin))],
        F.avg(F.col("classification").isin(*INDEPENDENT).cast("double")).alias("prop_independent"),
        F.avg(F.coalesce(F.col("f_test_12h_significant"), F.lit(False)).cast("double")).alias("prop_rhythmic"),
    )
    g = g.where(F.col("n_series") >= least)
    for p in (12, 24):
        g = g.withColumn(f"sigma_A_{p}", F.greatest(F.coalesce(f"sigma_A_{p}", F.lit(1.0)), F.lit(1e-8)))
        g = g.withColumn(f"mu_phi_{p}", F.atan2(f"_s_{p}", f"_c_{p}")).withColumn(f"kappa_phi_{p}", concentration(F.sqrt(F.col(f"_s_{p}") ** 2 + F.col(f"_c_{p}") ** 2)))
    return g.drop("_c_12", "_s_12", "_c_24", "_s_24")


def shrink(df: DataFrame, hyper: DataFrame, strength: float = 1.0) -> DataFrame:
    """Adds shrunken amplitudes and phases with their weights: a series' own value against its module's mean.

    A series' spread is its period's deviation where that is positive, else the median of those, else 1. Series without a module of
    hyperparameters, or without finite amplitudes, stay as they are.
    """
    own = F.when(F.col("T_12_deviation") > 0, F.col("T_12_deviation"))
    mid = ranks.percentile(df, own, 0.5).scalar()
    h = hyper.select("module_id", *[c for c in hyper.columns if c.startswith(("mu_", "sigma_", "kappa_"))])
    j = df.join(h, "module_id", "left").withColumn("_sg", F.coalesce(own, mid, F.lit(1.0)))
    on = F.col("mu_A_12").isNotNull() & F.col("A_12").isNotNull() & F.col("A_24").isNotNull()
    for p in (12, 24):
        s = F.col(f"sigma_A_{p}") / max(strength, 1e-8)
        d = s * s + F.col("_sg") ** 2
        w = F.when(on, F.when(d < 1e-16, 1.0).otherwise(s * s / d)).otherwise(1.0)
        j = j.withColumn(f"_w{p}", w).withColumn(f"A_{p}_shrunk", F.when(on, w * F.col(f"A_{p}") + (1 - w) * F.col(f"mu_A_{p}")).otherwise(F.col(f"A_{p}")))
    turn = on & F.col("phi_12").isNotNull() & F.col("phi_24").isNotNull()
    kg = F.greatest(1 / (F.col("_sg") + 1e-8), F.lit(0.1))
    for p in (12, 24):
        km = F.col(f"kappa_phi_{p}") * strength
        mean = F.atan2(kg * F.sin(f"phi_{p}") + km * F.sin(f"mu_phi_{p}"), kg * F.cos(f"phi_{p}") + km * F.cos(f"mu_phi_{p}"))
        j = j.withColumn(f"phi_{p}_shrunk", F.when(turn, mean).otherwise(F.col(f"phi_{p}")))
    j = j.withColumn("shrinkage_weight_A12", F.col("_w12")).withColumn("shrinkage_weight_phi12", F.when(turn, kg / (kg + F.col("kappa_phi_12") * strength)).otherwise(1.0))
    return j.select(*df.columns, "A_12_shrunk", "A_24_shrunk", "phi_12_shrunk", "phi_24_shrunk", "shrinkage_weight_A12", "shrinkage_weight_phi12")


def reclassify(df: DataFrame, least: int = 5, prior: float = 0.3, few: bool = False) -> DataFrame:
    """Adds hierarchical_classification: an ambiguous series takes its module's majority among the unambiguous ones. ``few``: a row for each module may be broadcast."""
    c = F.col("classification")
    g = df.groupBy("module_id").agg(F.count("*").alias("_n"), F.count_if(c != "ambiguous").alias("_known"), F.count_if(c.isin(*INDEPENDENT)).alias("_ind"), F.count_if(c.isin("harmonic", "likely_harmonic")).alias("_har"))
    bound = 0.6 * (1 - prior) + 0.4 * prior
    ok = (F.col("_n") >= least) & (F.col("_known") > 0) & (c == "ambiguous")
    label = F.when(ok & (F.col("_ind") / F.col("_known") > bound), "likely_independent").when(ok & (F.col("_har") / F.col("_known") > bound), "likely_harmonic").otherwise(c)
    return df.join(F.broadcast(g) if few else g, "module_id", "left").withColumn("hierarchical_classification", label).drop("_n", "_known", "_ind", "_har")


def hierarchical(results: DataFrame, k: int | None = None, least: int = 5, strength: float = 1.0, prior: float = 0.3, method: str = "ward") -> DataFrame:
    """The whole refinement of a result table, with modules by ``method`` (bisecting for any number of series); fewer than three series come back with module_id null and their labels.

    Results keep their rows while modules are named, so nothing that grows with the series is joined; of modules there are 20 or k at most.
    """
    if results.limit(3).count() < 3:
        return results.withColumn("module_id", F.lit(None).cast("int")).withColumn("hierarchical_classification", F.col("classification"))
    row = F.col("_row")
    df = modules(features(results, rows=True), k, method, least).select("series_id", *[row.getField(c).alias(c) for c in results.columns if c != "series_id"], "module_id")
    return reclassify(shrink(df, F.broadcast(hyperparameters(df, least)), strength), least, prior, few=True)


def module_lists(df: DataFrame) -> DataFrame:
    """module_id to its size and series; for reports: the lists grow with the modules."""
    return df.groupBy("module_id").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("series_id")).alias("series"))


def top_of_module(df: DataFrame, by: str, k: int = 10) -> DataFrame:
    """The k series of each module with the largest value, ties by id."""
    w = Window.partitionBy("module_id").orderBy(F.desc(by), "series_id")
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
