"""Every registered query against its DuckDB oracle on the smallest scale factor."""

import math
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    import duckdb

    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    return c


def _norm(v):
    from decimal import Decimal

    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return v


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_oracle(spark, con, name):
    sdf = entry.queries()[name](spark, SMALL)
    rel = con.sql(entry.oracle_sql()[name])
    assert sorted(sdf.columns) == sorted(rel.columns)
    cols = sorted(sdf.columns)
    si = [sdf.columns.index(c) for c in cols]
    di = [rel.columns.index(c) for c in cols]
    s = sorted((tuple(_norm(r[i]) for i in si) for r in sdf.collect()), key=repr)
    d = sorted((tuple(_norm(r[i]) for i in di) for r in rel.fetchall()), key=repr)
    assert s == d


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_query_without_oracle_runs(spark, name):
    df = entry.queries()[name](spark, SMALL)
    assert df.count() >= 0


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0
