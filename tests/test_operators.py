"""Operators on signals of known content, and on nulls, ties and empty tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ostinato.operators import classify, decompose, detect, evidence, fits, metrics, network, per_series, population, series
from ostinato.sources import readers, simulate


def arrays(spark, ys, t=None):
    t = list(map(float, range(48))) if t is None else t
    return spark.createDataFrame([(str(i), t, None if y is None else [float(v) for v in y]) for i, y in enumerate(ys)], "series_id string, t array<double>, y array<double>")


T = np.arange(48.0)
COS24, COS12 = 2 * np.cos(2 * np.pi * T / 24 - 0.7), 1.5 * np.cos(2 * np.pi * T / 12 - 1.1)


def test_exact_fit(spark):
    r = fits.with_fit(arrays(spark, [5 + COS24 + COS12]), T, [24.0, 12.0], "f").select("f.*").first()
    assert r.mesor == pytest.approx(5) and r.rss == pytest.approx(0, abs=1e-18)
    assert [c.amplitude for c in r.components] == pytest.approx([2, 1.5]) and [c.phase for c in r.components] == pytest.approx([0.7, 1.1])


def test_long_and_grid_cosinor_agree(spark):
    rng = np.random.RandomState(0)
    a = arrays(spark, rng.normal(size=(5, 48)))
    g = {r.series_id: r.cosinor.p for r in detect.cosinor(a, T, 12.0).collect()}
    for r in fits.cosinor_long(series.to_long(a), 12.0).collect():
        assert r.p_value == pytest.approx(g[r.series_id], rel=1e-9)


def test_detection_guards(spark):
    rows = detect.jtk(arrays(spark, [[1.0] * 48, None, COS12, [float("nan")] * 48])).collect()
    by = {r.series_id: r for r in rows}
    assert by["0"].p_jtk == 1.0 and by["1"].error == "no series" and by["3"].error == "values are missing" and by["2"].p_jtk < 1e-6


def test_bh_matches_sorted_rule(spark):
    p = np.round(np.random.RandomState(1).uniform(size=300), 2)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(p)] + [(300, None)], "i int, p double")
    got = {r.i: r.q for r in detect.bh_fdr(df, "p", "q", buckets=8).collect()}
    order = np.argsort(p)
    q = np.minimum.accumulate((p[order] * 300 / np.arange(1, 301))[::-1])[::-1]
    assert got[300] is None
    assert np.allclose([got[i] for i in order], np.minimum(q, 1))


def test_two_stage_labels(spark):
    rng = np.random.RandomState(3)
    t = list(map(float, range(0, 96, 2)))
    w = np.array(t)
    ys = [5 + 3 * np.cos(2 * np.pi * w / 24) + rng.normal(0, 0.3, 48), 5 + rng.normal(0, 1, 48), 5 + 2 * np.cos(2 * np.pi * w / 24 - 0.5) + 1.9 * np.cos(2 * np.pi * w / 11.3 - 2.1) + rng.normal(0, 0.3, 48), 3 * (np.mod(w / 24, 1) - 0.5) + rng.normal(0, 0.2, 48)]
    got = {r.series_id: r.classification for r in classify.two_stage(arrays(spark, ys, t), classify.Config.of(n_bootstrap=49)).collect()}
    assert got["0"] in ("circadian_only", "harmonic", "non_rhythmic") and got["1"] in ("non_rhythmic", "circadian_only")
    assert got["2"] in ("independent_ultradian", "likely_independent_ultradian") and got["3"] not in ("independent_ultradian", "likely_independent_ultradian")
    with pytest.raises(ValueError):
        classify.Config.of(unknown=1)


def test_decomposition(spark):
    r = {x.series_id: x for x in decompose.decompose(arrays(spark, [COS24 * 2, COS24 + COS12 * 2, np.random.RandomState(0).normal(size=48)])).collect()}
    assert r["0"].classification == "circadian_only" and r["1"].classification == "independent_ultradian" and r["2"].classification == "non_rhythmic"


def test_bispectral_prefers_tied_phases(spark):
    w = 2 * np.pi * T / 24
    tied = sum((-1) ** (k + 1) * np.sin(k * w) / k for k in range(1, 6))
    r = evidence.bispectrum(arrays(spark, [tied + np.random.RandomState(0).normal(0, 0.05, 48)]), n=99).first()
    assert r.bicoherence > 0.5


def test_circular(spark):
    df = spark.createDataFrame([(0.1 * i, (0.2 * i + 0.05) % (2 * math.pi)) for i in range(20)], "phase_24 double, phase_12 double")
    assert population.phase_test(df).first().classification == "harmonic"
    x = population.circular_correlation(df, F.col("phase_24"), F.col("phase_24")).first()
    assert x.rho == pytest.approx(1)
    assert population.phase_test(df.limit(0)).first().classification == "inconclusive"


def test_ward_and_silhouette():
    x = np.vstack([np.random.RandomState(0).normal(c, 0.1, (10, 2)) for c in (0, 3, 6)])
    m = network.ward(x)
    labels = network.cut(m, 30, 3)
    assert [len(set(labels[i : i + 10])) for i in (0, 10, 20)] == [1, 1, 1] and labels.max() == 2
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    assert network.silhouette(d, labels) > 0.9


def test_scores_by_hand(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("b", "b"), ("c", "a"), ("c", "c")], "y_true string, y_pred string")
    r = metrics.scores(df).first()
    assert r.accuracy == pytest.approx(4 / 6)
    p = {x.label: x for x in metrics.per_label(df).collect()}
    assert p["a"].precision == 0.5 and p["b"].recall == 1 and p["c"].precision == 1
    assert metrics.auc(spark.createDataFrame([(0.9, True), (0.8, False), (0.7, True)], "s double, t boolean"), F.col("s"), F.col("t")).first().auc == pytest.approx(0.5)


def test_scenarios_are_reproducible(spark):
    a = simulate.scenarios(spark, 2).orderBy("series_id").collect()
    b = simulate.scenarios(spark, 2).repartition(7).orderBy("series_id").collect()
    assert a == b and len(a) == 30 and len(a[0].y) == 24


def test_matrix_reader(spark, tmp_path):
    (tmp_path / "m.csv").write_text("gene,0,2,4\nx,1,2,3\ny,4,,6\n")
    rows = readers.matrix_csv(spark, str(tmp_path / "m.csv")).collect()
    assert len(rows) == 6 and {r.t for r in rows} == {0.0, 2.0, 4.0}
    with pytest.raises(ValueError):
        readers.matrix_csv(spark, str(tmp_path / "m.csv"), [0.0])
    a = {r.series_id: r for r in series.to_array(readers.matrix_csv(spark, str(tmp_path / "m.csv"))).collect()}
    assert a["y"].y == [4.0, 6.0]


def test_series_matrix(spark, tmp_path):
    (tmp_path / "s.txt").write_text('!Sample_title\t"Liver CT18"\t"Liver CT20"\n"ID_REF"\t"G1"\t"G2"\n"p1"\t1\t3\n"p2"\t5\t9\n!series_matrix_table_end\n')
    head, t = readers.series_matrix(spark, str(tmp_path / "s.txt"))
    ann = spark.createDataFrame([("p1", "A /// B"), ("p2", "A")], "probe string, symbol string")
    r = readers.array_study(t, dict(zip(["G1", "G2"], head["title"], strict=True)), ann, floor_percentile=None).collect()
    assert [(x.series_id, x.t, x.y) for x in r] == [("A", [18.0, 20.0], [5.0, 9.0])]


def test_streaming_equals_batch(spark, sf, tmp_path):
    from ostinato.streaming import rhythm

    e = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    e.write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "e"))
    q = rhythm.windowed_cosinor(stream, F.col("event_type"), "ts", F.col("value"), 24.0, "7 days", "1 day").writeStream.format("memory").queryName("w").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    want = rhythm.windowed_cosinor(e, F.col("event_type"), "ts", F.col("value"), 24.0, "7 days", "1 day")
    assert spark.table("w").count() == want.count() > 0


def test_refinement_of_many_series(spark):
    """More series than Ward's method takes."""
    from ostinato.operators import network

    rows = spark.range(5200).select(F.col("id").cast("string").alias("series_id"), (F.col("id") % 7 + 1.0).alias("A_12"), (F.col("id") % 5 + 1.0).alias("A_24"), (F.col("id") % 6 * 1.0).alias("phi_12"), (F.col("id") % 4 * 1.0).alias("phi_24"), (F.col("id") % 9 - 4.0).alias("log_bf"), (F.col("id") % 8 - 3.0).alias("T_12_deviation"), (F.col("id") % 2 == 0).alias("f_test_12h_significant"), F.when(F.col("id") % 3 == 0, "ambiguous").otherwise("harmonic").alias("classification"))
    got = network.hierarchical(rows, 8, method="bisecting")
    assert got.select("module_id").distinct().count() == 8
    assert got.count() == 5200 and got.where("module_id is null or hierarchical_classification is null").count() == 0


def test_intervals_of_any_number_of_rows(spark):
    """More than a million rows: the interval is that of a share of so many rows."""
    rows = spark.range(1_200_000).select(F.lit("1").alias("y_true"), F.when(F.col("id") % 4 == 0, "0").otherwise("1").alias("y_pred"), F.when(F.col("id") % 4 == 1, "0").otherwise("1").alias("y_b"))
    share = lambda a, b, n: float(np.average(a == b, weights=n))
    r = metrics.bootstrap_metric(rows, share, n=2000).first()
    sd = (0.75 * 0.25 / 1.2e6) ** 0.5
    assert r.value == 0.75 and abs(r.lo - 0.75 + 1.96 * sd) < 0.2 * sd and abs(r.hi - 0.75 - 1.96 * sd) < 0.2 * sd
    p = metrics.permutation_metric(rows, share, "y_pred", "y_b", n=500).first()
    assert p.difference == 0 and p.p_value == 1


def test_cut_points_are_made_distinct_once_for_a_group(spark):
    """Not at each value of the group; ranges are those of the points, of which a value that is most of a group gives several times the same."""
    from ostinato.operators import ranks

    counts = spark.createDataFrame([("a", float(i % 40)) for i in range(200)] + [("a", 7.0)] * 500 + [("b", None), ("b", 2.0)], "g string, v double")
    out = ranks.cut(counts, "v", ["g"], 8)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert all("Aggregate" in line for line in plan.splitlines() if "array_distinct" in line) and "array_distinct" in plan
    rows = out.collect()
    by = {(r.g, r.v): r["_b"] for r in rows}
    assert len(rows) == 702 and [by["a", float(i)] for i in range(40)] == sorted(by["a", float(i)] for i in range(40)) and by["a", 0.0] == 0 < by["a", 39.0] < 8 and by["b", None] == 0


def test_blocks_of_series_are_of_equal_sizes(spark):
    """Nine series in blocks of four at most are three blocks of three: a small block costs about as much as a full one."""
    df = spark.createDataFrame([(str(i), [float(x) for x in range(8)], [float(i)] * 8) for i in range(9)], "series_id string, t array<double>, y array<double>").coalesce(1)
    got = per_series.apply_many(df, lambda t, y, seeds: [{"v": z[0], "size": len(y)} for z in y], "v double, size int", block=4).collect()
    assert [r.v for r in got] == [float(r.series_id) for r in got] and [r["size"] for r in got] == [3] * 9
