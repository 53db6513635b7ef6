"""Feature families, profiles, correlations and recommendations."""

import math

import numpy as np
from pyspark.sql import functions as F


def test_kmeans_label_is_nearest_centre_and_pca_uncorrelated(spark, sf):
    from tamis.operators.features import clustering_family, pca_family
    from tamis.operators.profile import analyze_dataset_advanced

    d = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    prof = analyze_dataset_advanced(d, as_dict=True, with_correlations=False)
    new = clustering_family(d, prof, 2, list(d.columns))
    out = d.select(*[e.alias(n) for n, e in new.items()]).toPandas()
    assert out["cluster_kmeans"].notna().all() and (out["cluster_distance"] >= 0).all()
    pcs = pca_family(d, prof, 3, list(d.columns))
    p = d.select(*[e.alias(n) for n, e in pcs.items()]).toPandas()
    c = np.corrcoef(p.to_numpy().T)
    assert np.allclose(c - np.diag(np.diag(c)), 0, atol=1e-6)
    v = p.var().to_numpy()
    assert (np.diff(v) <= 1e-9).all()


def test_automated_features_adds_columns(spark, sf):
    from tamis.plans.pipeline import make_step

    c = spark.read.parquet(f"{sf}/customer.parquet")
    f = make_step({"kind": "automated_feature_engineering", "params": {"max_features": 20}}).fit(c)
    assert f.state["features"] and len(f.state["features"]) <= 20
    assert set(f.state["features"]) <= set(f.transform(c).columns)


def test_p_value_and_significance(spark):
    from tamis.operators.correlation import p_value

    assert abs(p_value(0.5, 20) - 0.0247) < 1e-3
    assert p_value(None, 10) == 1.0 and p_value(0.9, 2) == 1.0


def test_recommendations_find_defects(spark, sf):
    from tamis.plans.recommend import analyze_dataset, steps_for

    o = spark.read.parquet(f"{sf}/orders.parquet")
    o = o.withColumn("o_totalprice", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")))
    recs = analyze_dataset(o, as_list=True)
    types = {(r["type"], r["column"]) for r in recs}
    assert ("missing_data", "o_totalprice") in types
    assert [r["priority"] for r in recs] == sorted([r["priority"] for r in recs], reverse=True)
    steps = steps_for(recs, o)
    assert {"kind": "impute", "params": {"columns": ["o_totalprice"], "strategy": "mean"}} in steps


def test_basic_stats_and_compare(spark, sf):
    from tamis.operators.profile import compare_stats, compute_basic_stats

    o = spark.read.parquet(f"{sf}/orders.parquet")
    a = compute_basic_stats(o)
    b = compute_basic_stats(o.drop("o_custkey").limit(10))
    d = compare_stats(a, b)
    assert a["rows"] == 15000 or a["rows"] > 0
    assert d["removed_columns"] == ["o_custkey"] and d["rows_delta"] < 0


def test_query_surface(spark, sf):
    import pytest

    from tamis.operators.base import StepError
    from tamis.plans.query import add_expression_column, run_sql, validate_sql_query

    o = spark.read.parquet(f"{sf}/orders.parquet")
    assert run_sql(o, "SELECT count(*) AS n FROM df").first().n == o.count()
    for bad in ("DROP TABLE df", "SELECT 1; SELECT 2", "DELETE FROM df"):
        with pytest.raises(StepError):
            validate_sql_query(bad)
    with pytest.raises(StepError):
        add_expression_column(o, "system(o_totalprice)", "x")
    z = add_expression_column(o, "o_totalprice / (o_custkey - o_custkey)", "z", check=False)
    assert z.where("z IS NOT NULL").count() == 0


def test_preview_pipeline_and_rule_helpers(spark, sf):
    from tamis.plans.pipeline import preview_pipeline
    from tamis.plans.recommend import filter_priority, smart_feature_rules

    o = spark.read.parquet(f"{sf}/orders.parquet")
    res = preview_pipeline(o, [{"kind": "drop_missing", "params": {"axis": "columns", "columns": ["o_custkey"]}}], n=100, key_columns=["o_orderkey"])
    assert res["sample"].count() == 100 and res["delta"]["removed_columns"] == ["o_custkey"]
    recs = [{"priority": 0.9}, {"priority": 0.8}, {"priority": 0.6}, {"priority": 0.5}]
    assert len(filter_priority(recs, "high")) == 2 and len(filter_priority(recs, "medium")) == 2 and len(filter_priority(recs, "low")) == 2
    rules = smart_feature_rules(spark.read.parquet(f"{sf}/events.parquet"))
    assert 0 < len(rules) <= 8


def test_clean_text_lemmas_and_feature_preview(spark, sf):
    from tamis.operators.features import batch_feature_preview
    from tamis.plans.pipeline import make_step

    df = spark.createDataFrame([("The Cats were running!",), (None,)], "t string")
    out = make_step({"kind": "clean_text", "params": {"column": "t", "remove_stopwords": True, "lemmas": {"cats": "cat", "running": "run"}}}).fit_transform(df)
    assert [r.t for r in out.collect()] == ["cat run", ""]
    o = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_totalprice", "o_orderdate")
    cols = batch_feature_preview(o).columns
    assert "o_orderkey o_totalprice" in cols and "o_orderdate_year" in cols and "o_totalprice_binned" in cols


def test_kendall_matches_brute_force(spark):
    import numpy as np
    import pandas as pd

    from tamis.functions.ranks import inversions
    from tamis.operators.correlation import kendall_tau_b

    rng = np.random.default_rng(3)
    x = rng.integers(0, 20, 600).astype(float)
    y = np.where(rng.random(600) < 0.3, 5.0, rng.normal(size=600))  # a heavy tied value
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": y}))
    dx = np.sign(x[:, None] - x[None, :])
    dy = np.sign(y[:, None] - y[None, :])
    iu = np.triu_indices(len(x), 1)
    n0 = len(iu[0])
    expect = (dx * dy)[iu].sum() / np.sqrt((n0 - (dx[iu] == 0).sum()) * (n0 - (dy[iu] == 0).sum()))
    tau, n, p = kendall_tau_b(df, "x", "y")
    assert abs(tau - expect) < 1e-12 and n == 600 and 0 <= p <= 1
    assert inversions([3, 1, 2, 2, 0]) == 7


def test_regression_f_scores_and_mi(spark, sf):
    import numpy as np

    from tamis.operators.importance import f_scores, mutual_information

    li = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_extendedprice", "l_quantity", "l_discount")
    f = {r.feature: r.f_score for r in f_scores(li, "l_extendedprice", ["l_quantity", "l_discount"]).collect()}
    p = li.toPandas()
    r = np.corrcoef(p.l_quantity, p.l_extendedprice)[0, 1]
    assert abs(f["l_quantity"] - r * r / (1 - r * r) * (len(p) - 2)) < 1e-6 * max(1, f["l_quantity"])
    dep = li.withColumn("l_double", F.col("l_extendedprice") * 2)  # fully dependent feature
    mi = {r.feature: r.mutual_info for r in mutual_information(dep, "l_extendedprice", ["l_double", "l_discount"]).collect()}
    assert mi["l_double"] > 1.0 > 0.05 > mi["l_discount"] >= 0
