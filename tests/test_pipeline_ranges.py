"""Ranges of step parameters, old dates, and distinct counts of narrow hashes."""

import datetime as dt
import math

import pytest

from tamis.operators.profile import analyze_dataset_advanced, distinct_counts
from tamis.plans.pipeline import make_step, run_pipeline, validate_pipeline
from tamis.operators.base import StepError


def spec(kind, **params):
    return {"kind": kind, "params": params}


@pytest.mark.parametrize(
    "step",
    [
        spec("select_features_correlation", threshold=7), spec("select_features_correlation", threshold=0.05), spec("select_features_correlation", threshold=True),
        spec("bin_features", columns=["x"], bins=1), spec("bin_features", columns=["x"], bins="five"), spec("create_polynomial_features", columns=["x"], degree=0),
        spec("automated_feature_engineering", max_features=9), spec("impute", columns=["x"], strategy="knn", n_neighbors=0),
    ],
)
def test_out_of_range(spark, step):
    ok, errors = validate_pipeline(spark.createDataFrame([(1.0,)], "x double"), [spec("scale", columns=["x"], method="minmax"), step])
    assert not ok and len(errors) == 1 and errors[0].startswith("Step 1")


def test_in_range_and_lowered(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 1.0), (4.0, 3.0)], "x double, y double")
    good = [spec("select_features_correlation", threshold=t) for t in (0.1, 0.5, 0.9)] + [spec("bin_features", columns=["x"], bins=2)]
    assert validate_pipeline(df, good) == (True, [])
    with pytest.warns(UserWarning, match="taken as 50"):
        assert validate_pipeline(df, [spec("bin_features", columns=["x"], bins=5000)]) == (True, [])
    with pytest.raises(StepError):
        run_pipeline(df, [spec("no such kind")])


def test_resample_before_the_year_1000(spark):
    rows = [(dt.datetime(1, 1, 1, h), float(h)) for h in (1, 2, 5)] + [(dt.datetime(1, 1, 2, 1), 9.0)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, v double")
    out = make_step(spec("resample_time_series", time_column="ts", freq="6h", agg_func="sum")).fit_transform(df)
    assert sorted((r.ts, r.v) for r in out.collect()) == [
        (dt.datetime(1, 1, 1), 8.0), (dt.datetime(1, 1, 1, 6), 0.0), (dt.datetime(1, 1, 1, 12), 0.0), (dt.datetime(1, 1, 1, 18), 0.0), (dt.datetime(1, 1, 2), 9.0),
    ]


def test_distinct_counts(spark):
    rows = [(1, "a", 0.0, None), (1, "b", -0.0, None), (2, None, math.inf, None), (None, "a" * 10_000, 1.5, None), (2, "a" * 9_999 + "b", 1.5, None)]
    df = spark.createDataFrame(rows, "i int, s string, f double, n string")
    assert distinct_counts(df, df.columns) == {"i": 2, "s": 4, "f": 3, "n": 0}
    assert distinct_counts(df.limit(0), ["i"]) == {"i": 0} and distinct_counts(df, []) == {}
    found = {r["column"]: r.unique_count for r in analyze_dataset_advanced(df.drop("n")).collect()}
    assert found == {"i": 2, "s": 4, "f": 3}
