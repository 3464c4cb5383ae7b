"""Every query with SQL, side by side with DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from ostinato import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SLOW: set[str] = set()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return round(float(v), 6) if type(v).__name__ == "Decimal" else v


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        if os.path.exists(f"{sf}/{t}.parquet"):
            con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(set(catalogue.oracle_sql()) - SLOW))
def test_same_as_sql(spark, sf, duck, name):
    df = catalogue.queries()[name](spark, sf)
    cols = sorted(df.columns)
    rel = duck.sql(catalogue.oracle_sql()[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    key = lambda r: tuple("" if v is None else str(v) for v in r)
    ours = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=key)
    theirs = sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=key)
    assert len(ours) == len(theirs)
    for a, b in zip(ours, theirs, strict=True):
        assert all(x == y or isinstance(x, float) and isinstance(y, float) and abs(x - y) < 2e-6 for x, y in zip(a, b, strict=True)), (a, b)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_resamples_are_the_operators_own():
    import inspect

    q = catalogue.queries()
    for name in ("bootstrap_lrt", "ensemble_classifier", "bootstrap_accuracy", "permutation_accuracy"):
        assert not any(x in inspect.getsource(q[name]) for x in ("n=", "n_bootstrap=")), name


def test_queries_take_whole_vectors(spark, sf):
    from ostinato.plans import inputs

    v = inputs.vectors(spark, sf).join(inputs.table(spark, sf, "embeddings").selectExpr("cast(vec_id as string) as series_id", "embedding"), "series_id")
    assert v.where("size(y) = 64 and y = cast(embedding as array<double>)").count() == inputs.table(spark, sf, "embeddings").count()
