import random

import pytest
from pyspark.sql import functions as F

from tamis.functions.exprs import stable_hash
from tamis.operators import rebalance


def wanted(df, target, size, key_cols, seed=42):
    """Rows of each class by hash, then key columns, in plain Python."""
    rows = df.withColumn("h", stable_hash([F.col(c) for c in key_cols], seed)).collect()
    kept = []
    for c in {r[target] for r in rows if r[target] is not None}:
        own = sorted((r for r in rows if r[target] == c), key=lambda r: (r["h"], *(str(r[k]) for k in key_cols)))
        kept += [tuple(r)[:-1] for r in own[:size]]
    return sorted(map(str, kept))


@pytest.fixture
def table(spark):
    rng = random.Random(9)
    rows = [(i, rng.choice("aaaaaaaabbc"), i % 7) for i in range(4_000)] + [(5_000, None, 1), (5_001, "rare", 2)]
    return spark.createDataFrame(rows, "k int, whole string, start int")


@pytest.mark.parametrize("bracket", [3, 200, 20_000])
def test_undersampling_keeps_the_first_hashes(table, monkeypatch, bracket):
    monkeypatch.setattr(rebalance, "BRACKET_ROWS", bracket)
    got = rebalance.rebalance(table, "whole", "undersample")
    assert sorted(str(tuple(r)) for r in got.collect()) == wanted(table, "whole", 100, table.columns)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hash" not in plan and "Exchange range" not in plan and "Sort" not in plan


@pytest.mark.parametrize("bracket", [3, 20_000])
def test_undersampling_with_repeated_rows(spark, monkeypatch, bracket):
    monkeypatch.setattr(rebalance, "BRACKET_ROWS", bracket)
    rows = [(1, "big")] * 700 + [(i, "big") for i in range(2, 60)] + [(3, "small")] * 150 + [(4, "tiny")] * 20
    df = spark.createDataFrame(rows, "k int, c string").repartition(5)
    for ratio in (1.0, 6.0, 10.0):
        got = rebalance.rebalance(df, "c", "undersample", ratio=ratio)
        assert sorted(str(tuple(r)) for r in got.collect()) == wanted(df, "c", max(int(20 * ratio), 100), df.columns)
