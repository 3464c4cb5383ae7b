"""Registered queries against their SQL, on the smallest tables."""

import duckdb
import pytest

from ostinato.llm import oracle, queries


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "benchmark", "labels"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_same_rows(spark, sf, duck, name):
    df = queries.queries()[name](spark, sf)
    rel = duck.sql(oracle.oracle_sql()[name])
    cols = sorted(df.columns)
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted((tuple(r[c] for c in cols) for r in df.collect()), key=key) == sorted((tuple(r[i] for i in at) for r in rel.fetchall()), key=key)
