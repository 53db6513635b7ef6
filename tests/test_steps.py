"""Steps on hand-made edge cases (NULLs, ties, constants, non-ASCII, bin edges...)."""

import math

import pytest
from pyspark.sql import functions as F

from tamis.operators.base import StepError
from tamis.plans.pipeline import make_step, run_pipeline


def step(df, kind, **params):
    return make_step({"kind": kind, "params": params}).fit_transform(df)


def test_impute_strategies(spark):
    df = spark.createDataFrame([(1, 1.0, "a"), (2, None, None), (3, 3.0, "b"), (4, 3.0, "b"), (5, None, "a")], "k long, x double, s string")
    assert [r.x for r in step(df, "impute", columns=["x"], strategy="mean").orderBy("k").collect()] == [1.0, 7 / 3, 3.0, 3.0, 7 / 3]
    assert step(df, "impute", columns=["x"], strategy="median").where("k = 2").first().x == 3.0
    # mode ties: smallest wins
    assert step(df, "impute", columns=["s"], strategy="mode").where("k = 2").first().s == "a"
    assert step(df, "impute", columns=["x"], strategy="constant", constant_value="7").where("k = 5").first().x == 7.0
    with pytest.raises(StepError):
        make_step({"kind": "impute", "params": {"columns": ["x"], "strategy": "ffill"}})


def test_impute_all_null_column(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "k long, x double")
    assert step(df, "impute", columns=["x"], strategy="mean").where("x IS NOT NULL").count() == 0
    assert step(df, "impute", columns=["x"], strategy="mode").where("x IS NOT NULL").count() == 0


def test_knn_and_random_forest_fill_everything(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "user_id", F.when(F.col("event_id") % 4 != 0, F.col("value")).alias("value"))
    for strategy in ("knn", "random_forest"):
        params = {"n_neighbors": 3} if strategy == "knn" else {"n_estimators": 5}
        out = step(e, "impute", columns=["value"], strategy=strategy, **params)
        assert out.where("value IS NULL").count() == 0
        kept = out.join(e.where("value IS NOT NULL").withColumnRenamed("value", "v0"), ["event_id", "user_id"])
        assert kept.where("value <> v0").count() == 0


def test_drop_missing(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, 2.0, None), (3, 3.0, "c")], "k long, x double, s string")
    assert step(df, "drop_missing", axis="rows").count() == 1
    assert step(df, "drop_missing", axis="rows", columns=["x"]).count() == 2
    assert step(df, "drop_missing", axis="columns", threshold=0.3).columns == ["k"]


def test_normalize_text_non_ascii(spark):
    df = spark.createDataFrame([("  É,   a!  ",), (None,)], "s string")
    out = step(df, "normalize_text", columns=["s"], remove_special=True).collect()
    assert out[0].s == "é a" and out[1].s is None


def test_extract_domain_edges(spark):
    df = spark.createDataFrame([("http://a b.com/x",), ("Example.COM/path",), ("localhost",), (None,), ("  ",), ("https://u:p@Host.org:8080/q?x#f",)], "u string")
    got = [r.u for r in step(df, "extract_domain", column="u").collect()]
    assert got == ["a b.com", "example.com", "http://localhost", "", "", "u:p@host.org:8080"]


def test_outliers_keep_null_and_skip_constant(spark):
    df = spark.createDataFrame([(float(i),) for i in range(20)] + [(1000.0,), (None,)], "x double")
    out = step(df, "outliers", columns=["x"], method="iqr")
    assert out.where("x IS NULL").count() == 1 and out.agg(F.max("x")).first()[0] < 1000
    const = spark.createDataFrame([(1.0,), (1.0,), (None,)], "x double")
    assert step(const, "outliers", columns=["x"], method="zscore").where("x IS NULL").count() == 1


def test_scale_constant_column_is_zero(spark):
    df = spark.createDataFrame([(5.0,), (5.0,)], "x double")
    for m in ("standard", "minmax", "robust"):
        assert [r.x for r in step(df, "scale", columns=["x"], method=m).collect()] == [0.0, 0.0]


def test_encoders(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, None), (4, "b")], "k long, c string")
    oh = step(df, "encode", columns=["c"], method="onehot").orderBy("k").collect()
    assert [(r.c_a, r.c_b) for r in oh] == [(0, 1), (1, 0), (0, 0), (0, 1)]
    lab = step(df, "encode", columns=["c"], method="label").orderBy("k").collect()
    assert [r.c for r in lab] == [1, 0, None, 1]
    fr = step(df, "encode", columns=["c"], method="frequency_encode").orderBy("k").collect()
    assert [r.c for r in fr] == [2, 1, None, 2]
    hs = step(df, "encode", columns=["c"], method="hashing_encode", n_components=4).orderBy("k").collect()
    assert all(sum(abs(getattr(r, f"c_hash_{i}")) for i in range(4)) == (0 if r.k == 3 else 1) for r in hs)


def test_type_convert(spark):
    df = spark.createDataFrame([("1",), ("0",), ("true",), ("2.7",), (None,)], "s string")
    assert [r.s for r in step(df, "type_convert", column="s", type="bool").collect()] == [True, False, False, True, False]
    assert [r.s for r in step(df, "type_convert", column="s", type="int").collect()] == [1, 0, 0, 2, 0]


def test_skew_boxcox_close_to_normal(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    vals = rng.lognormal(size=2000)
    df = spark.createDataFrame([(float(v),) for v in vals], "x double")
    f = make_step({"kind": "skewness_transform", "params": {"columns": ["x"], "method": "boxcox"}}).fit(df)
    assert abs(f.state["x"]["lambda"]) < 0.15  # log-normal data: lambda near 0


def test_mask_pii_card_before_phone(spark):
    df = spark.createDataFrame([("card 4111 1111 1111 1111 call 555-123-4567 mail a.b@x.org ip 10.0.0.1",)], "t string")
    t = step(df, "mask_pii", columns=["t"]).first().t
    assert "[CARD_MASKED]" in t and "[PHONE_MASKED]" in t and "[EMAIL_MASKED]" in t and "[IP_MASKED]" in t


def test_datetime_and_bins(spark):
    df = spark.createDataFrame([("2024-02-29",), ("2024-03-04",), ("bad",)], "d string")
    out = step(df, "extract_datetime_features", columns=["d"], features=["dayofweek", "month"]).collect()
    assert [(r.d_dayofweek, r.d_month) for r in out] == [(3, 2), (0, 3), (None, None)]
    b = spark.createDataFrame([(float(x),) for x in [1, 2, 3, 4, 5, 6, 7, 8, 9, 10]], "x double")
    codes = [r.x_binned for r in step(b, "bin_features", columns=["x"], bins=2).orderBy("x").collect()]
    assert codes == [0, 0, 0, 0, 0, 1, 1, 1, 1, 1]  # 5.5 edge: (a, b] intervals


def test_polynomial_names(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 3.0), (3.0, 5.0)], "a double, b double")
    out = step(df, "create_polynomial_features", columns=["a", "b"], degree=3)
    assert out.columns == ["a", "b", "a^2", "a b", "b^2", "a^3", "a^2 b", "a b^2", "b^3"]


def test_rebalance_counts(spark, sf):
    lab = spark.read.parquet(f"{sf}/labels.parquet")
    over = step(lab, "rebalance", target="toxic", method="oversample")
    counts = {r.toxic: r["count"] for r in over.groupBy("toxic").count().collect()}
    assert counts[0] == counts[1]
    under = step(lab, "rebalance", target="toxic", method="undersample")
    counts = {r.toxic: r["count"] for r in under.groupBy("toxic").count().collect()}
    assert counts[0] == 100 and counts[1] < 100
    with pytest.raises(StepError):
        step(lab.where("toxic = 1"), "rebalance", target="toxic", method="oversample")


def test_duplicates_keep_false_and_order(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "k long, t long, v string")
    assert step(df, "duplicates", subset=["k"], keep=False).count() == 1
    last = step(df, "duplicates", subset=["k"], keep="last", order_by=["t"]).where("k = 1").first()
    assert last.v == "b"


def test_pipeline_json_and_validation(spark):
    df = spark.createDataFrame([(1, 2.0), (2, None)], "k long, x double")
    out = run_pipeline(df, [{"kind": "impute", "params": {"columns": ["x"], "strategy": "mean"}}, {"kind": "scale", "params": {"columns": ["x"], "method": "minmax"}}])
    assert [r.x for r in out.collect()] == [0.0, 0.0]
    from tamis.plans.pipeline import validate_pipeline

    ok, errs = validate_pipeline(df, [{"kind": "nope"}, {"kind": "scale", "params": {"columns": ["zz"], "method": "standard"}}])
    assert not ok and len(errs) == 2


def test_validation_folds_over_new_columns(spark):
    from tamis.plans.pipeline import validate_pipeline

    df = spark.createDataFrame([(1, "2024-01-01", 2.0)], "k long, d string, x double")
    steps = [
        {"kind": "extract_datetime_features", "params": {"columns": ["d"], "features": ["year"]}},
        {"kind": "scale", "params": {"columns": ["d_year"], "method": "minmax"}},
        {"kind": "drop_missing", "params": {"axis": "columns", "columns": ["x"]}},
        {"kind": "scale", "params": {"columns": ["x"], "method": "minmax"}},
    ]
    ok, errs = validate_pipeline(df, steps)
    assert not ok and len(errs) == 1 and errs[0].startswith("Step 3")


def test_resample_months_first_last_and_rare_group(spark):
    import datetime as dt

    rows = [(dt.datetime(2024, 1, 5), 1.0), (dt.datetime(2024, 1, 20), 3.0), (dt.datetime(2024, 3, 2), 5.0)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, v double")
    m = step(df, "resample_time_series", time_column="ts", freq="MS", agg_func="sum").orderBy("ts").collect()
    assert [(r.ts.month, r.v) for r in m] == [(1, 4.0), (2, 0.0), (3, 5.0)]
    last = step(df, "resample_time_series", time_column="ts", freq="1D", agg_func="last").where("v IS NOT NULL").orderBy("ts").collect()
    assert [r.v for r in last] == [1.0, 3.0, 5.0]
    cats = spark.createDataFrame([("a",), ("a",), ("b",), ("c",)], "c string")
    out = step(cats, "encode", columns=["c"], method="onehot", max_categories=2, group_rare=True)
    assert sorted(out.columns) == ["c_Rare", "c_a", "c_b"]


def test_column_names_with_spaces(spark):
    df = spark.createDataFrame([(1, 2.0, "a b"), (2, None, "c"), (3, 4.0, None)], "`row id` long, `unit price` double, `the text` string")
    out = run_pipeline(df, [
        {"kind": "impute", "params": {"columns": ["unit price"], "strategy": "ffill", "order_by": ["row id"]}},
        {"kind": "scale", "params": {"columns": ["unit price"], "method": "minmax"}},
        {"kind": "normalize_text", "params": {"columns": ["the text"]}},
        {"kind": "encode", "params": {"columns": ["the text"], "method": "frequency_encode"}},
    ]).orderBy("row id").collect()
    assert [r["unit price"] for r in out] == [0.0, 0.0, 1.0]
    assert [r["the text"] for r in out] == [1, 1, None]
