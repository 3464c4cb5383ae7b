"""Readers, reports and the command line on small files."""

import gzip

import numpy as np
import pytest
from pyspark.sql import functions as F

from ostinato import cli
from ostinato.operators import reports
from ostinato.sources import readers


def rows(df):
    return {r.series_id: (list(r.t), [round(v, 6) for v in r.y]) for r in df.collect()}


def test_delimited_and_study(spark, tmp_path):
    with gzip.open(tmp_path / "x.tsv.gz", "wt") as f:
        f.write("symbol\ts1\ts2\ts3\tnote\nA\t1\t3\t5\tx\nA\t10\t30\t50\ty\nB\t0\t0\t0\tz\n\t7\t7\t7\tq\n")
    wide = readers.delimited(spark, str(tmp_path / "x.tsv.gz"), ["symbol", "s1", "s2", "s3"])
    meta = spark.createDataFrame([("s1", "p", 0.0, False), ("s2", "p", 0.0, None), ("s3", "p", 4.0, False), ("s4", "p", 8.0, True), ("s5", "q", 1.0, False)], "sample string, study string, time double, outlier boolean")
    samples = readers.study_samples(meta, "p")
    assert {r["sample"] for r in samples.collect()} == {"s1", "s2", "s3"}
    assert rows(readers.study(wide, samples, least=0.5)) == {"A": ([0.0, 4.0], [20.0, 50.0])}


def test_hours_of_titles(spark):
    titles = ["Liver CT18 rep 2", "circadian  time 07", "Circadian time 12 (b)", "array 36 ", "ZT06", "none"]
    df = spark.createDataFrame([(t,) for t in titles], "t string")
    assert [r.h for r in df.select(readers.hour_of(F.col("t")).alias("h")).collect()] == [18.0, 7.0, 12.0, 36.0, 6.0, None]


def test_series_matrix_and_array_study(spark, tmp_path):
    (tmp_path / "m.txt").write_text('!Sample_title\t"CT0"\t"CT4"\t"CT8"\n!Sample_x\t"a"\t"b"\t"c"\n"ID_REF"\t"g1"\t"g2"\t"g3"\n"p1"\t1\t2\t3\n"p2"\t5\t6\t8\n"p3"\t1\tnull\t3\n"p4"\t2\t2\t2\n!series_matrix_table_end\n')
    head, table = readers.series_matrix(spark, str(tmp_path / "m.txt"))
    assert head["title"] == ["CT0", "CT4", "CT8"]
    ann = spark.createDataFrame([("p1", "Aa /// Bb"), ("p2", "Aa"), ("p3", "Cc"), ("p4", "Dd"), ("p9", None)], "probe string, symbol string")
    titles = dict(zip(["g1", "g2", "g3"], head["title"]))
    assert rows(readers.array_study(table, titles, ann, floor_percentile=None)) == {"Aa": ([0.0, 4.0, 8.0], [5.0, 6.0, 8.0])}
    assert rows(readers.array_study(table, titles, ann, floor_percentile=None, every=2))["Aa"][0] == [0.0, 8.0]
    with pytest.raises(ValueError):
        readers.array_study(table, {**titles, "g3": "no hour."}, ann)
    assert rows(readers.array_study(table, {**titles, "g3": "no hour."}, ann, pattern=r"(C)T(\d+)", floor_percentile=None))["Aa"][0] == [0.0, 4.0]


def test_condition_pair_and_tissue_table(spark):
    a = spark.createDataFrame([("x", 1.0, 3.0, 5.0), ("y", 0.0, 0.0, 0.1), ("w", 2.0, 2.0, 2.0)], "gene string, CT0_A double, CT0_B double, CT4_A double")
    b = spark.createDataFrame([("x", 2.0, 4.0), ("y", 0.0, 0.0), ("v", 1.0, 1.0)], "gene string, CT2_A double, CT6_A double")
    got = readers.condition_pair(a, b, floor_percentile=0.5).collect()
    assert [(r.series_id, list(r.t_wt), list(r.y_wt), list(r.t_ko), list(r.y_ko)) for r in got] == [("x", [0.0, 4.0], [2.0, 5.0], [2.0, 6.0], [2.0, 4.0])]
    t = spark.createDataFrame([("A", 1.0, 2.0, 9.0), ("A", 3.0, 4.0, 9.0), ("ENSPANG1", 9.0, 9.0, 9.0), (None, 9.0, 9.0, 9.0), ("B", 0.1, 0.1, 9.0)], "Symbol string, `LIV.ZT02` double, `LIV.ZT00` double, `KID.ZT00` double")
    assert rows(readers.tissue_table(t, "LIV", least=0.5)) == {"A": ([0.0, 2.0], [4.0, 3.0])}


def test_subjects(spark):
    long = spark.createDataFrame([("g", s, float(t), v) for s, v in (("a", 1.0), ("b", 3.0)) for t in (0, 2)] + [("low", "a", 0.0, 0.1), ("mid", "a", 0.0, 1.5)], "series_id string, subject string, t double, value double")
    assert {(r.series_id, r.t): r.value for r in readers.subjects(long).collect()}[("g", 2.0)] == 2.0
    assert {r.value for r in readers.subjects(long, "b").collect()} == {3.0}
    assert {r.series_id for r in readers.subjects(long, floor_percentile=0.1).collect()} == {"g", "mid"}


def test_command_line(spark, tmp_path, capsys):
    t = np.arange(0, 48.0, 2)
    y = [5 + 2 * np.cos(2 * np.pi * t / 24), 5 + np.random.RandomState(0).normal(0, 1, 24)]
    with open(tmp_path / "in.csv", "w") as f:
        f.write("gene," + ",".join(str(x) for x in t) + "\n" + "".join(f"g{i}," + ",".join(map(str, v)) + "\n" for i, v in enumerate(y)))
    assert cli.main(["version"]) == 0 and cli.main(["detect", str(tmp_path / "in.csv"), str(tmp_path / "out"), "--method", "dynamic"]) == 0
    out = spark.read.csv(str(tmp_path / "out"), header=True)
    assert {r.series_id for r in out.collect()} == {"g0", "g1"}
    assert cli.main(["detect", str(tmp_path / "in.csv"), str(tmp_path / "out2"), "-t", "1,2"]) == 1


def test_reports(spark):
    df = spark.createDataFrame([("m", "s", True, True, 0.9), ("m", "s", False, False, 0.1), ("m", "s", None, True, 0.5), ("k", "s", True, True, 0.2), ("m", "amb", True, False, 0.0)], "method string, scenario string, truth boolean, positive boolean, score double")
    r = reports.detection_table(df, F.col("truth"), F.col("positive"), F.col("score"), ["method"]).collect()
    assert len(r) == 1 and (r[0].method, r[0].tp, r[0].tn, r[0].fn, r[0].roc_auc) == ("m", 1, 1, 1, 0.5)
    assert reports.tier_one(df, ("m",), ("amb",)).first().f1 == 1.0 and reports.tier_one(df).first().sensitivity == 0.5
    k = reports.knockout_validation(spark.createDataFrame([("harmonic", False)] * 8 + [("harmonic", True)] * 2 + [("independent_ultradian", False)] + [("independent_ultradian", True)] * 5, "wt_classification string, ko_has_12h boolean")).first()
    assert (k.harmonic_loss_rate, k.independent_retention_rate, k.ambiguous_loss_rate, k.fisher_odds_ratio) == (0.8, 5 / 6, None, 20.0) and k.fisher_p_value == pytest.approx(0.0243, abs=1e-3)
    empty = reports.knockout_validation(spark.createDataFrame([], "wt_classification string, ko_has_12h boolean")).first()
    assert empty.fisher_p_value is None and empty.harmonic_loss_rate is None
    v = np.random.RandomState(1).normal(3, 1, 200)
    m = {r.g: r for r in reports.mean_intervals(spark.createDataFrame([("a", float(x)) for x in v] + [("a", float("nan")), ("b", 1.0), ("c", None)], "g string, v double"), F.col("v"), ["g"]).collect()}
    assert set(m) == {"a", "b"} and m["a"].lo < v.mean() < m["a"].hi and m["a"].mean == pytest.approx(v.mean()) and (m["b"].lo, m["b"].hi) == (1.0, 1.0)
