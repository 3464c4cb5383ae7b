"""Modules of any number of rows against methods that make all distances."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ostinato.operators import network


def table(spark, x, parts=5):
    cols = ", ".join(f"f{i} double" for i in range(x.shape[1]))
    return spark.createDataFrame([(f"{i:05d}", *map(float, v)) for i, v in enumerate(x)], f"series_id string, {cols}").repartition(parts)


def plain_ward(x, k):
    """Merge the two clusters whose union adds least to the sums of squares, again and again."""
    parts = [[i] for i in range(len(x))]
    while len(parts) > k:
        best = None
        for a in range(len(parts)):
            for b in range(a):
                m, n = len(parts[a]), len(parts[b])
                d = x[parts[a]].mean(axis=0) - x[parts[b]].mean(axis=0)
                cost = m * n / (m + n) * (d * d).sum()
                if best is None or cost < best[0]:
                    best = (cost, a, b)
        _, a, b = best
        parts[b] += parts[a]
        del parts[a]
    return {frozenset(p) for p in parts}


def found(df):
    by = {}
    for r in df.collect():
        by.setdefault(r.module_id, set()).add(int(r.series_id))
    return {frozenset(v) for v in by.values()}, by


def scores(x):
    return (x - x.mean(axis=0)) / np.where(x.std(axis=0) > 0, x.std(axis=0), 1)


@pytest.mark.parametrize("seed", [0, 1])
def test_ward_of_rows_that_are_leaves(spark, seed):
    x = np.random.RandomState(seed).normal(size=(60, 3)) * [1, 2, 3]
    got, by = found(network.modules(table(spark, x), 7, least=1))
    assert got == plain_ward(scores(x), 7)
    assert [min(by[m]) for m in sorted(by)] == sorted(min(v) for v in by.values())


def test_leaves_keep_all_sums(spark):
    x = np.vstack([np.random.RandomState(0).normal(size=(3000, 4)), np.ones((500, 4))])
    df = table(spark, x, 9)
    cols = df.columns[1:]
    for most in (40, 5000):
        n, total, squares = network.leaves(df, cols, most)
        assert n.sum() == 3500 and total.sum(axis=0) == pytest.approx(x.sum(axis=0)) and squares.sum() == pytest.approx((x * x).sum())
        assert len(n) == (40 if most == 40 else 3001)
        assert (squares - (total * total).sum(axis=1) / n > -1e-9).all()
    assert len(network.leaves(df.limit(0), cols, 10)[0]) == 0


def test_condensing_is_wards_merging():
    """Leaves left by pairs of nearest neighbours are the clusters of Ward's method where it has no close calls."""
    rng = np.random.RandomState(3)
    x = np.vstack([rng.normal(c, 0.05, (8, 2)) for c in ((0, 0), (4, 0), (0, 4), (4, 4), (9, 9))])
    n, total, _ = network.condense(np.ones(40), x, (x * x).sum(axis=1), 5)
    assert sorted(n) == [8] * 5 and sorted(np.round(total / n[:, None]).tolist()) == [[0, 0], [0, 4], [4, 0], [4, 4], [9, 9]]


def test_many_rows_in_few_leaves(spark):
    rng = np.random.RandomState(5)
    centre = rng.normal(0, 10, (6, 4))
    kind = rng.randint(0, 6, 12_000)
    kind[:4000] = 2  # a third of all rows in one module
    x = centre[kind] + rng.normal(0, 0.3, (12_000, 4))
    for k in (6, None):
        got, _ = found(network.modules(table(spark, x, 16), k, most_leaves=60))
        assert got == {frozenset(np.flatnonzero(kind == i)) for i in range(6)}


def test_spectral_coordinates_are_those_of_the_dense_affinity(spark):
    rng = np.random.RandomState(7)
    x = rng.normal(size=(2000, 6)) + 2 * np.eye(6)[rng.randint(0, 3, 2000)]
    x[5] = 1.0  # a row without correlation
    df = table(spark, x, 6)
    v, axes = network.spectral_coordinates(df, df.columns[1:], 4)
    got = np.array([[float(r[a]) for a in axes] for r in v.orderBy("series_id").collect()])
    with np.errstate(invalid="ignore", divide="ignore"):
        a = (np.nan_to_num(np.corrcoef(x)) + 1) / 2
    a[5, 5] = 0.5  # its correlation with itself is none either
    s = 1 / np.sqrt(a.sum(axis=1))
    value, dense = np.linalg.eigh(a * s[:, None] * s)
    dense = dense[:, -4:]
    dense /= np.linalg.norm(dense, axis=1, keepdims=True)
    # the same rows up to one rotation: all products of rows agree
    assert np.abs(got @ got.T - dense @ dense.T).max() < 1e-6


def test_spectral_modules_of_planted_kinds(spark):
    rng = np.random.RandomState(8)
    shape = np.array([[3.0, 0, 0, -3, 0, 0], [0, 3, 0, 0, -3, 0], [0, 0, 3, 0, 0, -3]])
    kind = np.sort(rng.randint(0, 3, 6000))
    x = shape[kind] * rng.uniform(0.5, 2, (6000, 1)) + rng.normal(0, 0.1, (6000, 6))
    got, _ = found(network.modules(table(spark, x, 8), 3, "spectral"))
    assert got == {frozenset(np.flatnonzero(kind == i)) for i in range(3)}


def test_small_modules_join_the_nearest(spark):
    x = np.concatenate([np.linspace(0, 1, 20), np.linspace(10, 11, 20), [12.5, 12.6]])[:, None] * [1.0, 0.5]
    got, _ = found(network.modules(table(spark, x), 3, least=5))
    assert got == {frozenset(range(20)), frozenset(range(20, 42))}


def test_modules_of_odd_tables(spark):
    one = table(spark, np.ones((1, 2)), 1)
    for method in ("ward", "spectral"):
        assert network.modules(one.limit(0), None, method).count() == 0
        assert [r.module_id for r in network.modules(one, None, method).collect()] == [0]
        same = network.modules(table(spark, np.ones((50, 3))), None, method).collect()
        assert len(same) == 50 and {r.module_id for r in same} == {0}


def test_nearest_leaves_are_held_a_strip_at_a_time():
    """The same nearest and distances as the whole matrix has, in a fraction of its memory; the same leaves as rounds of plain merges."""
    import tracemalloc

    rng = np.random.RandomState(5)
    x, size = rng.normal(size=(1500, 6)), rng.randint(1, 9, 1500).astype(float)
    x[7] = x[900]
    d = network.ward_distances(x, size)
    np.fill_diagonal(d, np.inf)
    near, far = network.nearest_others(x, size)
    assert (near == d.argmin(axis=1)).all() and far == pytest.approx(d.min(axis=1), abs=1e-12) and near[7] == 900 and far[7] == 0
    tracemalloc.start()
    n, total, squares = network.condense(size, x * size[:, None], (x * x).sum(axis=1) * size, 400)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(n) == 400 and n.sum() == size.sum() and total.sum(axis=0) == pytest.approx((x * size[:, None]).sum(axis=0))
    assert peak < 1500 * 1500 * 8 / 2  # half of one whole matrix of distances


def test_means_of_nearest_leave_tasks_as_sums(spark):
    """Against plain numpy, with a centre that is nobody's nearest; a round is one stage: no rows are dealt anew."""
    x = np.random.RandomState(6).normal(size=(300, 3))
    df, centres = table(spark, x), np.vstack([np.random.RandomState(7).normal(size=(5, 3)), np.full(3, 99.0)])
    cols = df.columns[1:]
    label = ((x[:, None] - centres) ** 2).sum(axis=2).argmin(axis=1)
    got = network.means_of_nearest(df, cols, centres)
    assert sorted(got) == sorted(set(label)) and 5 not in got
    assert all(m == pytest.approx(x[label == i].mean(axis=0)) for i, m in got.items())
    assert network.means_of_nearest(df.limit(0), cols, centres) == {}


def test_refinement_joins_nothing_that_grows(spark, tmp_path):
    """Results and modules are not joined: only rows of a module, of a range or of the whole table are broadcast, and each keeps its place."""
    from ostinato.plans import inputs

    rows = spark.range(600).select(F.col("id").cast("string").alias("series_id"), (F.col("id") % 7 + 1.0).alias("A_12"), (F.col("id") % 5 + 1.0).alias("A_24"), (F.col("id") % 6 * 1.0).alias("phi_12"), F.when(F.col("id") % 9 > 0, F.col("id") % 4 * 1.0).alias("phi_24"), (F.col("id") % 9 - 4.0).alias("log_bf"), (F.col("id") * 1.0).alias("T_12_deviation"), (F.col("id") % 2 == 0).alias("f_test_12h_significant"), F.when(F.col("id") % 3 == 0, "ambiguous").otherwise("harmonic").alias("classification"))
    rows.write.parquet(str(tmp_path / "r"))
    rows = spark.read.parquet(str(tmp_path / "r"))
    got = network.hierarchical(rows, 4, method="bisecting")
    assert {*rows.columns, "module_id"} < {*got.columns} and got.count() == 600
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join " in line]
    assert joins and all("strategy=broadcast" in line for line in joins), joins
    named = {r.series_id: r.module_id for r in network.modules(network.features(rows), 4, "bisecting").collect()}
    assert {r.series_id: (r.module_id, r.T_12_deviation) for r in got.collect()} == {k: (m, float(k)) for k, m in named.items()}
    assert network.hierarchical(rows, 3).where("module_id is not null").count() == 600
    labelled = inputs.vectors_with_label(spark, "/root/testdata/sf0.001")
    assert labelled.columns == ["series_id", "t", "y", "label"] and "Join" not in labelled._jdf.queryExecution().optimizedPlan().toString()
