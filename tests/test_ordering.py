"""Ordered scans against pandas, with partition invariance and a hot group."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tamis.functions.ordering import (
    FillKernel,
    InterpolateKernel,
    PositionKernel,
    RollingMeanKernel,
    SavgolKernel,
    average_rank,
    exact_quantiles,
    ordered_scan,
    savgol_coeffs,
)


@pytest.fixture(scope="module")
def gaps(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet").withColumn("value", F.when(F.col("event_id") % 5 != 0, F.col("value")))


@pytest.fixture(scope="module")
def gaps_pd(gaps):
    return gaps.toPandas().sort_values("ts").reset_index(drop=True)


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_ffill_bfill_interp_partition_invariant(gaps, gaps_pd, parts):
    for kernel, expect in (
        (FillKernel(["value"], "ffill"), gaps_pd["value"].ffill()),
        (FillKernel(["value"], "bfill"), gaps_pd["value"].bfill()),
        (InterpolateKernel(["value"]), gaps_pd["value"].interpolate()),
    ):
        got = ordered_scan(gaps, kernel, ["ts"], num_partitions=parts).toPandas().sort_values("ts")
        assert np.allclose(got["value"].to_numpy(float), expect.to_numpy(float), equal_nan=True)


def test_rolling_grouped_matches_pandas(gaps, gaps_pd):
    got = ordered_scan(gaps, RollingMeanKernel("value", 4, 1), ["ts"], ["user_id"], 7).toPandas().sort_values(["user_id", "ts"])
    p = gaps_pd.sort_values(["user_id", "ts"])
    exp = p.groupby("user_id")["value"].transform(lambda s: s.rolling(4, min_periods=1).mean())
    assert np.allclose(got["value"].to_numpy(float), exp.to_numpy(float), equal_nan=True)


def test_hot_group_spread_over_partitions(spark):
    # one key holds a third of the rows; positions inside it must still be exact
    n = 3000
    pdf = pd.DataFrame({"g": np.where(np.arange(n) % 3 == 0, 0, np.arange(n) % 50 + 1), "t": np.arange(n)})
    df = spark.createDataFrame(pdf)
    out = ordered_scan(df, PositionKernel("pos"), ["t"], ["g"], 12).toPandas().sort_values(["g", "t"])
    assert (out["pos"].to_numpy() == out.groupby("g").cumcount().to_numpy()).all()
    # the hot group really was split
    from tamis.functions.ordering import SLICE, Scan

    scan = Scan(df, ["t"], ["g"], 12)
    slices = {r["g"]: r["n"] for r in scan.rows.groupBy("g").agg(F.countDistinct(SLICE).alias("n")).collect()}
    assert slices.pop(0) > 2 and set(slices.values()) == {1}


def test_savgol_reproduces_cubic(spark):
    t = np.arange(40, dtype=float)
    y = 0.01 * t**3 - 0.3 * t**2 + 2 * t + 5
    df = spark.createDataFrame(pd.DataFrame({"t": t, "y": y}))
    got = ordered_scan(df, SavgolKernel("y", 7, 3, 0.0), ["t"], num_partitions=5).toPandas().sort_values("t")
    assert np.allclose(got["y"].to_numpy(), y)


def test_savgol_coefficients_sum_to_one():
    assert abs(savgol_coeffs(11, 3).sum() - 1) < 1e-12


def test_average_rank_and_quantiles(gaps, gaps_pd):
    r = average_rank(gaps, "user_id", "r").toPandas().sort_values("event_id")
    p = gaps_pd.sort_values("event_id")
    assert np.allclose(r["r"].to_numpy(), p["user_id"].rank().to_numpy())
    q = exact_quantiles(gaps, "value", [0.0, 0.1, 0.5, 0.9, 1.0])
    assert np.allclose(q, p["value"].quantile([0.0, 0.1, 0.5, 0.9, 1.0]).to_numpy())


def test_empty_and_single_row(spark):
    empty = spark.createDataFrame([], "t long, v double")
    assert ordered_scan(empty, FillKernel(["v"]), ["t"]).count() == 0
    one = spark.createDataFrame([(1, None)], "t long, v double")
    assert ordered_scan(one, InterpolateKernel(["v"]), ["t"]).first()["v"] is None
    assert exact_quantiles(empty, "v", [0.5]) == [None]


def test_bracketed_quantiles_large_path(spark, sf, monkeypatch):
    """Force the histogram-bracketing path (used above SMALL_EXACT_ROWS) and compare."""
    from tamis.functions import stats

    monkeypatch.setattr(stats, "SMALL_EXACT_ROWS", 0)
    monkeypatch.setattr(stats, "COLLECT_MAX", 500)
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    cols = ["l_orderkey", "l_quantity", "l_extendedprice", "l_discount"]
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = stats.bracketed_quantiles(li, cols, probs)
    pdf = li.select(*cols).toPandas()
    for c in cols:
        assert np.allclose(got[c], pdf[c].quantile(probs).to_numpy()), c
    empty = spark.createDataFrame([(None,)], "x double")
    assert stats.bracketed_quantiles(empty, ["x"], [0.5]) == {"x": [None]}
