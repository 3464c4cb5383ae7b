"""Permutations and resamples by rule against shuffles and draws of whole arrays."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ostinato.operators import population, reports, resampling


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 500, 4097])
def test_permutations_are_bijections(n):
    keys = np.arange(20)
    p = resampling.permuted(np.arange(n), n, keys)
    assert all(sorted(r) == list(range(n)) for r in p)
    half = resampling.permuted(np.arange(n // 2, n), n, keys)
    assert (half == p[:, n // 2 :]).all()


def test_permutations_are_even():
    """All six orders of three, and all places of one of 50, come about equally often."""
    p = resampling.permuted(np.arange(3), 3, np.arange(6000))
    counts = np.unique(p, axis=0, return_counts=True)[1]
    assert len(counts) == 6 and abs(counts - 1000).max() < 150
    q = resampling.permuted(np.arange(50), 50, np.arange(20_000))
    assert abs(np.bincount(q[:, 7], minlength=50) - 400).max() < 120
    # places of neighbours are as good as independent
    assert abs(np.corrcoef(q[:, 7], q[:, 8])[0, 1] + 1 / 49) < 0.03


def angles(spark, x, y, parts=3):
    return spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)] + [(None, 1.0), (2.0, None)], "a double, b double").repartition(parts)


def rho(x, y):
    num = den_x = den_y = 0.0
    i, j = np.triu_indices(len(x), 1)
    a, b = np.sin(x[i] - x[j]), np.sin(y[i] - y[j])
    num, den_x, den_y = (a * b).sum(), (a * a).sum(), (b * b).sum()
    return num / math.sqrt(den_x * den_y)


def test_resultants_are_those_of_the_permutation(spark, monkeypatch):
    """Over several chunks, row by row: sums of a against the partner that the rule gives."""
    rng = np.random.RandomState(0)
    x, y = rng.uniform(0, 6, 300), rng.uniform(0, 6, 300)
    monkeypatch.setattr(resampling, "CHUNK", 64)
    df = angles(spark, x, y)
    chunks, size = resampling.numbered_chunks(df.where("a is not null and b is not null"), ["a", "b"])
    rows = sorted(chunks.collect())
    a, b = (np.concatenate([r[i] for r in rows]) for i in (1, 2))
    assert size == 300 and [len(r.a) for r in rows] == [64] * 4 + [44] and sorted(zip(a, b)) == sorted(zip(x, y))
    sums, _ = resampling.permuted_resultants(df, "a", "b", 70, 5)
    got = {r.permutation: r for r in sums.collect()}
    assert set(got) == set(range(70))
    for k in (0, 33, 69):
        to = resampling.permuted(np.arange(300), 300, np.array([k + (5 << 20)]))[0]
        partner = np.empty(300)
        partner[to] = b
        assert (got[k].c1, got[k].s1, got[k].c2, got[k].s2) == pytest.approx((np.cos(a - partner).sum(), np.sin(a - partner).sum(), np.cos(a + partner).sum(), np.sin(a + partner).sum()))


@pytest.mark.parametrize("tie", [0.0, 0.12, 0.5])
def test_permutation_p_is_that_of_shuffles(spark, tie):
    rng = np.random.RandomState(int(100 * tie))
    x = rng.uniform(0, 2 * np.pi, 120)
    y = np.where(rng.uniform(size=120) < tie, 0.3 + x, rng.uniform(0, 2 * np.pi, 120))
    r = population.circular_permutation(angles(spark, x, y), "a", "b", n=1999).first()
    seen = rho(x, y)
    null = np.array([rho(x, rng.permutation(y)) for _ in range(2000)])
    p = ((np.abs(null) >= abs(seen)).sum() + 1) / 2001
    assert r.n == 120 and r.rho == pytest.approx(seen) and abs(r.p_value - p) < 4 * math.sqrt(max(p * (1 - p), 1e-4) / 1000)


def test_permutations_of_few_rows(spark):
    assert population.circular_permutation(angles(spark, [], []), "a", "b", n=9).first().p_value == 1.0
    assert population.circular_permutation(angles(spark, [1.0], [2.0]), "a", "b", n=9).first().p_value == 1.0


def test_intervals_of_one_large_group(spark):
    """A group of two thirds of the rows over many chunks, with one value that a third of it has."""
    rng = np.random.RandomState(3)
    v = np.concatenate([rng.gamma(2, 3, 6000), np.full(3000, 1.5)])
    small = rng.normal(-5, 1, 40)
    rows = [("hot", float(x)) for x in v] + [("cold", float(x)) for x in small] + [("cold", None), ("cold", float("nan")), (None, 4.0), (None, 4.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(6)
    r = {x.g: x for x in reports.mean_intervals(df, F.col("v"), ["g"], n=2000).collect()}
    for k, values in (("hot", v), ("cold", small)):
        means = np.array([values[rng.randint(0, len(values), len(values))].mean() for _ in range(2000)])
        lo, hi = np.percentile(means, [2.5, 97.5])
        assert r[k].mean == pytest.approx(values.mean()) and abs(r[k].lo - lo) < 0.01 * abs(lo) and abs(r[k].hi - hi) < 0.01 * abs(hi)
        assert abs((r[k].hi - r[k].lo) / (hi - lo) - 1) < 0.12
    assert (r[None].mean, r[None].lo, r[None].hi) == (4.0, 4.0, 4.0)
    assert resampling.mean_replicates(df, F.col("v"), ["g"], 20, 1).groupBy("g").count().collect() and reports.mean_intervals(df.limit(0), F.col("v"), ["g"]).count() == 0
    whole = reports.mean_intervals(df.where("g = 'cold'"), F.col("v"), [], n=200).first()
    assert whole.lo < small.mean() < whole.hi


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 500, 4097])
def test_the_way_back_of_a_permutation(n):
    keys = np.arange(20)
    to = resampling.permuted(np.arange(n), n, keys)
    back = resampling.permuted(np.arange(n), n, keys, back=True)
    assert all((b[t] == np.arange(n)).all() for t, b in zip(to, back, strict=True))


@pytest.mark.parametrize("shared", [4, 16, 64])
def test_values_travel_once_for_many_permutations(spark, monkeypatch, shared):
    """Sums are those of each permutation, where chunks get few of another's values, most, or all of them."""
    rng = np.random.RandomState(1)
    x, y = rng.uniform(0, 6, 90), rng.uniform(0, 6, 90)
    monkeypatch.setattr(resampling, "CHUNK", 8)
    monkeypatch.setattr(resampling, "SHARED", shared)
    monkeypatch.setattr(resampling, "TOGETHER", 3)
    df = angles(spark, x, y)
    chunks, size = resampling.numbered_chunks(df.where("a is not null and b is not null"), ["a", "b"])
    rows = sorted(chunks.collect())
    a, b = (np.concatenate([r[i] for r in rows]) for i in (1, 2))
    sums, _ = resampling.permuted_resultants(df, "a", "b", 21, 5)
    got = {r.permutation: r for r in sums.collect()}
    assert set(got) == set(range(21)) and size == 90
    for k in range(21):
        partner = np.empty(90)
        partner[resampling.permuted(np.arange(90), 90, np.array([k + (5 << 20)]))[0]] = b
        assert (got[k].c1, got[k].s1, got[k].c2, got[k].s2) == pytest.approx((np.cos(a - partner).sum(), np.sin(a - partner).sum(), np.cos(a + partner).sum(), np.sin(a + partner).sum()))


def test_chunks_of_a_group_lie_together(spark, capsys):
    """Chunks of one group and block of replicates come one after the other, in at most DEALT parts, so how many of a resample fall in each chunk is drawn once
    for many (before: once for each chunk, so with the square of their number)."""
    df = spark.range(3000).select((F.col("id") % 2).alias("g"), F.col("id").cast("double").alias("v"))
    r = resampling.mean_replicates(df, F.col("v"), ["g"], 20, 1)
    r.explain()
    plan = capsys.readouterr().out
    assert "Sort [_group" in plan and "pmod(_chunk" in plan and r.groupBy("g").count().collect() and {x.rows for x in r.collect()} == {1500}
