"""Reports against lists, comparisons of methods, and lines of evidence on live series, each by a plain count or definition."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ostinato import cli, validation
from ostinato.operators import classify, detect, evidence, metrics

T = np.arange(48.0)
wave = lambda p, f=0.0: np.cos(2 * np.pi * T / p - f)


def arrays(spark, ys, t=T):
    return spark.createDataFrame([(str(i), [float(v) for v in t], [float(v) for v in y]) for i, y in enumerate(ys)], "series_id string, t array<double>, y array<double>")


LISTS = [("Xbp1", "known_12h"), ("ATF4", "known_12h"), ("gone", "known_12h"), ("Per2", "core_circadian"), ("per2", "known_12h"), ("Actb", "housekeeping"), (None, "housekeeping"), ("odd", "other")]
RESULTS = [("XBP1", "harmonic"), ("Atf4", "independent_ultradian"), ("Per2", "circadian_only"), ("ACTB", "non_rhythmic"), ("zzz", "likely_independent_ultradian"), (None, "harmonic")]


def frames(spark, results=RESULTS):
    return spark.createDataFrame(results, "symbol string, classification string"), spark.createDataFrame(LISTS, "symbol string, category string")


def test_list_report(spark):
    r, lists = frames(spark)
    x = validation.list_report(r, lists, spark.createDataFrame([("atf4",), ("ZZZ",), ("Per2",)], "symbol string")).first()
    assert (x.n, x.known_found, x.known_detected, x.known_independent, x.known_harmonic) == (6, 3, 2, 1, 1)
    assert (x.core_found, x.core_right, x.none_found, x.none_rhythmic, x.half_period, x.overlap) == (1, 1, 1, 0, 4, 2)
    assert (x.known_rate, x.core_rate, x.false_rate, x.half_period_rate) == (2 / 3, 1, 0, 4 / 6)
    none = validation.list_report(r.limit(0), lists).first()
    assert (none.n, none.known_rate, none.half_period_rate) == (0, 0, 0)
    d = {(x.symbol, x.category): x.classification for x in validation.details(r, lists).collect()}
    assert d["gone", "known_12h"] == "not_found" and d["ATF4", "known_12h"] == "independent_ultradian" and len(d) == len(LISTS)


def test_condition_report(spark):
    r, lists = frames(spark)
    ko, _ = frames(spark, [("xbp1", "likely_independent_ultradian"), ("atf4", "non_rhythmic"), ("per2", "non_rhythmic")])
    x = {r.condition: r for r in validation.condition_report(r, ko, lists).collect()}
    assert (x["wt"].known_found, x["wt"].detected_rate, x["wt"].harmonic_rate, x["wt"].core_rate) == (3, 2 / 3, 1 / 3, 1)
    assert (x["ko"].known_found, x["ko"].independent_rate, x["ko"].harmonic_rate, x["ko"].core_rate) == (3, 1 / 3, 0, 1)


def test_benchmark_of_labelled_datasets(spark, tmp_path):
    rng = np.random.RandomState(0)
    kinds = {"known": 2 * wave(12), "day": 2 * wave(24), "none": 0 * T}
    rows = [(f"{k}{i}", [float(x) for x in T], [float(v) for v in y + 0.5 * rng.normal(size=48)]) for k, y in kinds.items() for i in range(4)] + [("unlisted", [float(x) for x in T], [1.0] * 48)]
    df = spark.createDataFrame(rows, "series_id string, t array<double>, y array<double>")
    category = {"known": "known_12h", "day": "core_circadian", "none": "housekeeping"}
    listed = [(f"{k.upper()}{i}", c) for k, c in category.items() for i in range(4)] + [("known0", "housekeeping")]
    lists = spark.createDataFrame(listed, "symbol string, category string")
    rows_ = validation.benchmark({"a": df, "b": df.where("series_id like 'known%'"), "empty": df.limit(0)}, lists).cache()
    assert rows_.count() == (12 + 4) * 7 and {r.method for r in rows_.select("method").distinct().collect()} == {"lomb_scargle", "cosinor", "harmonic_regression", "jtk_cycle", "rain", "matrix_pencil", "two_stage"}
    s = validation.summary(rows_)
    by = {(r.dataset, r.method): r for r in s["by_dataset"].collect()}
    assert by["a", "cosinor"].sensitivity == 1 and by["a", "two_stage"].tp == 4 and by["b", "jtk_cycle"].tp == 4 and ("empty", "cosinor") not in by
    assert {r.category for r in s["by_category"].collect()} == set(category.values()) and all(0 <= r.rate <= 1 for r in s["overall"].collect())
    with pytest.raises(ValueError):
        validation.benchmark({"a": df}, lists.limit(0))


def test_benchmark_asks_the_first_stage_alone(spark, monkeypatch):
    """Its answers are those of the whole classifier, whose simulations aren't run, and the series are dealt over tasks."""
    rng = np.random.RandomState(1)
    y = {f"s{i}": (i % 3) * wave(12) + (i % 2) * wave(24) + rng.normal(size=48) for i in range(12)}
    df = spark.createDataFrame([(k, [float(x) for x in T], [float(x) for x in v]) for k, v in y.items()] + [("bad", [float(x) for x in T], [float("nan")] * 48)], "series_id string, t array<double>, y array<double>").coalesce(1)
    lists = df.select(F.col("series_id").alias("symbol"), F.lit("known_12h").alias("category"))
    want = {r.series_id: (r.p_detect, bool(r.passed)) for r in classify.two_stage(df).collect()}
    monkeypatch.setattr(classify, "two_stage", None)
    out = validation.benchmark({"a": df}, lists).where("method = 'two_stage'")
    assert {r.symbol: (r.p, r.predicted) for r in out.collect()} == want and any(v[1] for v in want.values()) and not all(v[1] for v in want.values())
    assert "REPARTITION_BY_NUM" in out._jdf.queryExecution().executedPlan().toString()


def test_command_of_labelled_benchmark(spark, tmp_path):
    rng = np.random.RandomState(1)
    lines = ["gene," + ",".join(f"{t:g}" for t in T)] + [f"{k}{i}," + ",".join(f"{v:.4f}" for v in y + 0.4 * rng.normal(size=48)) for k, y in (("k", 2 * wave(12)), ("n", 0 * T)) for i in range(3)]
    (tmp_path / "m.csv").write_text("\n".join(lines))
    (tmp_path / "lists.csv").write_text("symbol,category\n" + "\n".join([f"K{i},known_12h" for i in range(3)] + [f"N{i},housekeeping" for i in range(3)]))
    args = ["benchmark-real", str(tmp_path / "out"), "--lists", str(tmp_path / "lists.csv"), "--dataset", f"one={tmp_path / 'm.csv'}"]
    assert cli.main(args) == 0
    scores = spark.read.csv(str(tmp_path / "out" / "by_dataset"), header=True)
    assert scores.count() == 7 and scores.where("method = 'cosinor'").first().tp == "3" and spark.read.csv(str(tmp_path / "out" / "rows"), header=True).count() == 42


def test_all_methods_are_the_methods(spark):
    """A row for each series and method, with that method's own numbers."""
    rng = np.random.RandomState(2)
    df = arrays(spark, [2 * wave(12) + 0.4 * rng.normal(size=48), rng.normal(size=48), 2 * wave(24) + 0.4 * rng.normal(size=48)])
    got = {(r.series_id, r.method): r for r in detect.all_methods(df, T).collect()}
    assert len(got) == 18
    own = {
        "jtk_cycle": {r.series_id: (r.jc_p, r.jc_period) for r in detect.jtk_cycle(df).collect()}, "rain": {r.series_id: (r.rn_p, 12.0) for r in detect.rain_detector(df).collect()},
        "lomb_scargle": {r.series_id: (r.ls_p, r.ls_period) for r in detect.lomb_scargle(df, [24.0, 12.0, 8.0]).collect()}, "cosinor": {r.series_id: (r.cosinor.p, 12.0) for r in detect.cosinor(df, T, 12.0).collect()},
        "matrix_pencil": {r.series_id: (r.mp_p, r.mp_periods[0] if r.mp_periods else None) for r in detect.matrix_pencil(df).collect()},
    }
    for m, rows in own.items():
        for k, (p, period) in rows.items():
            assert got[k, m].p == pytest.approx(p) and got[k, m].period == (pytest.approx(period) if period is not None else None), (m, k)
    assert all(got["0", m].p < 0.01 for m in ("cosinor", "jtk_cycle", "rain", "harmonic_regression"))


def test_least_of_the_rank_tests(spark):
    rng = np.random.RandomState(3)
    df = arrays(spark, [wave(12) + 0.5 * rng.normal(size=48), rng.normal(size=48), np.ones(48)]).withColumn("p_f", F.lit(1e-9))
    for r in detect.nonparametric(df).collect():
        ps = {"jtk": r.p_jtk, "rain": r.p_rain}
        assert r.p_combined == min(ps.values()) and ps[r.detection_method] == r.p_combined
    assert {r.detection_method for r in detect.nonparametric(df, "p_f").collect()} == {"ftest"}


def test_methods_against_a_reference(spark):
    rng = np.random.RandomState(4)
    truth = rng.randint(0, 2, 60)
    pred = {"ref": np.where(rng.uniform(size=60) < 0.95, truth, 1 - truth), "poor": np.where(rng.uniform(size=60) < 0.5, truth, 1 - truth), "good": np.where(rng.uniform(size=60) < 0.93, truth, 1 - truth)}
    df = spark.createDataFrame([(str(i), m, int(truth[i]), int(p[i])) for m, p in pred.items() for i in range(60)], "series_id string, method string, y_true int, y_pred int")
    got = {r.method: r for r in metrics.compare_methods(df, "ref").collect()}
    assert set(got) == {"poor", "good"}
    for m, r in got.items():
        a, b = pred["ref"] == truth, pred[m] == truth
        only_ref, only_m = int((a & ~b).sum()), int((~a & b).sum())
        n, k = only_ref + only_m, min(only_ref, only_m)
        exact = min(1.0, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n)
        assert {r.b, r.c} == {only_ref, only_m} and r.b == only_ref and r.p_adjusted == pytest.approx(min(1.0, 2 * r.p_value))
        if n < 25:
            assert r.p_value == pytest.approx(exact)
    assert got["poor"].reference_better and not got["good"].reference_better


def test_latex_table(spark):
    df = spark.createDataFrame([("a_b & c", 0.12345, 3, None), ("x%", None, 4, True)], "method string, p double, n int, ok boolean")
    assert metrics.latex(df, 2).split("\n") == [r"\begin{tabular}{lrrl}", r"\toprule", r"method & p & n & ok \\", r"\midrule", r"a\_b \& c & 0.12 & 3 & --- \\", r"x\% & --- & 4 & True \\", r"\bottomrule", r"\end{tabular}"]


def test_phase_coupling_of_live_fits(spark):
    """By hand from each series' free fit: distance of the fast phase from twice the slow one's, in its standard errors."""
    rng = np.random.RandomState(5)
    ys = [2 * wave(24, 0.4) + a * wave(p, f) + 0.15 * rng.normal(size=48) for a in (0.3, 1.0) for p in (12.0, 12.3, 13.0) for f in (0.8, 2.0, 4.0)]
    df = evidence.models(arrays(spark, ys)).withColumn("e5", evidence.phase_coupling())
    seen = set()
    for r in df.collect():
        slow = [i for i, p in enumerate(r.t_free) if abs(p - 24) < 4]
        fast = [i for i, p in enumerate(r.t_free) if abs(p - 12) < 4 and i not in slow]
        want = 0.0
        if slow and fast:
            s, f = slow[-1], fast[-1]
            turn = lambda x: abs((x + math.pi) % (2 * math.pi) - math.pi)
            off = min(turn(r.phi_free[f] - 2 * r.phi_free[s]), turn(r.phi_free[f] - 2 * r.phi_free[s] - math.pi))
            se = math.sqrt(r.rss_free / 14) / (r.amp_free[f] * math.sqrt(12))
            if se <= math.pi / 4:
                want = 1.0 if off / se > 3 and abs(r.t_free[f] - 12) / 12 < 0.05 else -1.0 if off / se < 1 else 0.0
        assert r.e5 == want
        seen.add(want)
    assert {1.0, -1.0} <= seen


def test_asymmetry_and_coherence_of_live_fits(spark):
    """A sawtooth's waveform is skewed and its overtones fall as 1/k; a plain cosine is neither."""
    saw = ((T % 24) / 24 - 0.5) * 4
    rng = np.random.RandomState(6)
    ys = [saw + 0.05 * rng.normal(size=48), 2 * wave(24) + 0.05 * rng.normal(size=48), rng.normal(size=48)]
    df = evidence.models(arrays(spark, ys)).withColumn("e6", evidence.waveform_asymmetry()).withColumn("e7", evidence.harmonic_coherence())
    r = {x.series_id: x for x in df.collect()}
    for k, x in r.items():
        off, rise = abs(x.peak_phase - round(x.peak_phase * 2) / 2), x.rise
        balance = min(rise, 1 - rise) / max(rise, 1 - rise) if 0 < rise < 1 else 1.0
        assert x.e6 == (-1.0 if (off > 0.1 or balance < 0.5) and 1 - x.rss0 / max(x.tss, 1e-10) > 0.5 else 0.0), k
        a, s2 = x.amp_k4, x.rss_k4 / 39
        noise, ratio = math.sqrt(2 * s2 / 48), x.amp_k4[1] / max(x.amp_k4[0], 1e-10)
        chi = sum((a[i] - a[0] / (i + 1)) ** 2 / max(2 * s2 / 48, 1e-10) for i in (1, 2, 3))
        gate = a[0] > 3 * noise and 0.2 < ratio < 0.8 and a[2] > 1.5 * noise
        assert x.e7 == ((-2.0 if chi < 4 else -1.0 if chi < 8 else 0.0) if gate else 0.0), k
    assert r["0"].e6 == -1.0 and r["1"].e7 == 0.0


def test_batch_is_the_analytic_table_with_adjusted_p(spark):
    rng = np.random.RandomState(7)
    df = arrays(spark, [a * wave(12) + 2 * wave(24) + 0.5 * rng.normal(size=48) for a in (0, 0.3, 0.6, 1.0, 2.0)] + [[1.0, 2.0]], T).withColumn("t", F.slice("t", 1, F.size("y")))
    kw = {"n_bootstrap": 19, "n_perm": 49}
    b = {r.series_id: r for r in classify.batch(df, **kw).collect()}
    a = {r.series_id: r for r in classify.analytic(df, **kw).collect()}
    p = {k: r.p_12 for k, r in a.items() if r.p_12 is not None}
    order = sorted(p, key=p.get, reverse=True)
    low, want = 1.0, {}
    for i, k in enumerate(order):
        low = min(low, p[k] * len(p) / (len(p) - i))
        want[k] = low
    for k, r in b.items():
        assert r.classification == a[k].classification and r.log_bf == a[k].log_bf and r.f_test_12h_pvalue == a[k].p_12
        assert r.f_test_12h_fdr == (pytest.approx(want[k]) if k in want else None)
    assert b["5"].classification == "error" and b["5"].error and len(p) == 5
