"""Rank correlations, pair sums and scans of sliced groups against brute force."""

import math
import random
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tamis.functions import gram, ordering, ranks
from tamis.functions.ordering import CumulativeKernel, FillKernel, InterpolateKernel, PositionKernel, RollingMeanKernel, SavgolKernel, ordered_scan
from tamis.operators.correlation import kendall_matrix, pearson_matrix, spearman_matrix


def frame(d, n, seed, gaps=True):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) + rng.normal(size=(n, 1)) * 0.7
    x[:, ::3] = np.round(x[:, ::3])  # ties
    x[:, 1] = np.where(rng.random(n) < 0.4, 5.0, x[:, 1])  # a heavy value
    if gaps:
        for k in range(2, d):
            x[rng.random(n) < 0.05 * (k % 4), k] = np.nan  # four kinds of columns, some without gaps
        x[:, d - 1] = np.where(np.isnan(x[:, 2]), np.nan, x[:, d - 1])
    return pd.DataFrame(x, columns=[f"c {k}" for k in range(d)])


def matrix(found, d):
    out = np.full((d, d), np.nan)
    for r in found.collect():
        out[int(r.Variable1[2:]), int(r.Variable2[2:])] = r.correlation
    return out


def jobs_of(spark, fn):
    tracker, group = spark.sparkContext.statusTracker(), f"g{random.random()}"
    spark.sparkContext.setJobGroup(group, group)
    try:
        fn()
        return len(tracker.getJobIdsForGroup(group))
    finally:
        spark.sparkContext._jsc.clearJobGroup()


def test_twenty_columns_with_gaps(spark):
    pdf = frame(20, 400, 1)
    df = spark.createDataFrame(pdf)
    assert np.allclose(matrix(spearman_matrix(df), 20), pdf.corr("spearman"), atol=1e-9)
    assert np.allclose(matrix(pearson_matrix(df), 20), pdf.corr(), atol=1e-9)


def test_jobs_do_not_grow_with_columns(spark):
    few, many = (spark.createDataFrame(frame(d, 60, 2)) for d in (4, 16))
    assert jobs_of(spark, lambda: spearman_matrix(many)) <= jobs_of(spark, lambda: spearman_matrix(few)) + 2


def test_five_hundred_columns(spark):
    pdf = frame(500, 200, 3)
    df = spark.createDataFrame(pdf).repartition(3)
    found = gram.correlations(df, [F.col(f"`{c}`") for c in pdf.columns])
    want = pdf.corr().to_numpy()
    assert len(found) == 500 * 499 // 2
    assert max(abs(r - want[i, j]) for (i, j), (r, _) in found.items()) < 1e-9


def test_columns_without_spread_or_end(spark):
    rows = [(1.0, 3.0, None, math.inf, float(i), 1e12 + i) for i in range(9)] + [(1.0, 3.0, 2.0, 1.0, 7.0, 1e12)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double, f double")
    found = gram.correlations(df, [F.col(c) for c in "abcdef"])
    assert found[0, 1] == (None, 10) and found[2, 4] == (None, 1) and found[3, 4][0] is None
    assert found[4, 5][0] == pytest.approx(np.corrcoef([r[4] for r in rows], [r[5] - 1e12 for r in rows])[0, 1])
    assert gram.correlations(df.limit(0), [F.col("a"), F.col("b")])[0, 1] == (None, 0)


class Counted(np.ndarray):
    """Counts the matrix products made with it."""

    products = 0

    def __matmul__(self, other):
        Counted.products += 1
        return np.asarray(self) @ np.asarray(other)

    def __rmatmul__(self, other):
        Counted.products += 1
        return np.asarray(other) @ np.asarray(self)


def test_whole_blocks_take_one_product(monkeypatch):
    monkeypatch.setattr(Counted, "products", 0)
    x = np.random.default_rng(5).normal(size=(500, 7))
    whole = gram.block_sums(x.view(Counted))
    assert Counted.products == 1
    gaps = gram.block_sums(np.vstack((x, np.full((1, 7), np.nan))))  # a row of gaps adds nothing
    assert np.allclose(whole, gaps, rtol=1e-12, atol=1e-12)


def tau(x, y):
    keep = ~(np.isnan(x) | np.isnan(y))
    x, y = x[keep], y[keep]
    s = np.sign(x[:, None] - x) * np.sign(y[:, None] - y)
    a, b = (np.count_nonzero(v[:, None] != v) for v in (x, y))
    return s.sum() / math.sqrt(a * b)


@pytest.mark.parametrize(("block", "fan"), [(1000, 64), (16, 3), (7, 64), (5, 2)])
def test_kendall_by_merging(spark, block, fan):
    pdf = frame(4, 300, 4)
    df = spark.createDataFrame(pdf)
    found = ranks.kendall(df, [F.col(f"`{c}`") for c in pdf.columns], block=block, fan=fan)
    for i, j in combinations(range(4), 2):
        assert found[i, j][0] == pytest.approx(tau(pdf.iloc[:, i].to_numpy(), pdf.iloc[:, j].to_numpy()))


def test_kendall_matrix_and_constant_column(spark):
    df = spark.createDataFrame([(float(i), 1.0, float(-i), None) for i in range(9)], "a double, b double, c double, d double")
    found = {(r.Variable1, r.Variable2): (r.correlation, r.p_value) for r in kendall_matrix(df, ["a", "b", "c"]).collect()}
    assert found["a", "b"] == (0.0, 1.0) and found["a", "c"][0] == -1.0 and found["c", "a"][1] < 0.01


KERNELS = {
    "ffill": lambda: FillKernel(["v", "s"], "ffill"),
    "bfill": lambda: FillKernel(["v", "s"], "bfill"),
    "line": lambda: InterpolateKernel(["v"]),
    "mean": lambda: RollingMeanKernel("v", 9, 2),
    "savgol": lambda: SavgolKernel("v", 7, 2, 1.5),
    "place": lambda: PositionKernel("pos"),
    "total": lambda: CumulativeKernel(["w", "w2"], ["before", "before2"]),
}


@pytest.fixture(scope="module")
def hot(spark):
    """Group 0 holds a third of the rows, null a tenth; the others have 1 to 30; one order value is a quarter of group 0."""
    rng = random.Random(6)
    rows = []
    for i in range(900):
        g = 0 if i % 3 == 0 else None if i % 10 == 1 else rng.randrange(1, 40)
        t = 77 if g == 0 and rng.random() < 0.25 else rng.randrange(10_000)
        rows.append((i, g, t, None if rng.random() < 0.6 else rng.random(), None if rng.random() < 0.8 else f"s{i}", i % 7, -i))
    return spark.createDataFrame(rows, "id long, g long, t long, v double, s string, w long, w2 long").repartition(5)


def same(a, b):
    return all(x == y or (isinstance(x, float) and isinstance(y, float) and x == pytest.approx(y, abs=1e-9)) for x, y in zip(a, b, strict=True))


@pytest.mark.parametrize("kernel", KERNELS)
@pytest.mark.parametrize("groups", [[], ["g"]])
def test_slices_change_nothing(spark, hot, kernel, groups):
    def found(parts):
        return sorted(tuple(r) for r in ordered_scan(hot, KERNELS[kernel](), ["t"], groups, parts).drop("g", "s" if "fill" not in kernel else "").fillna(-1.0).fillna("-").collect())

    plain = found(1)
    for parts in (7, 64):
        assert all(same(a, b) for a, b in zip(plain, found(parts), strict=True))


def test_scans_stay_in_the_jvm(spark, hot):
    for kernel in KERNELS.values():
        plan = ordered_scan(hot, kernel(), ["t"], ["g"], 12)._jdf.queryExecution().executedPlan().toString()
        assert "Arrow" not in plan and "Python" not in plan and "Checkpoint" not in plan


def test_slices_after_joins_are_counted_rows(spark, monkeypatch):
    """The number of slices follows the rows there are, not what a plan of joins may promise."""
    monkeypatch.setattr(ordering, "ROWS", 50)
    ids = spark.range(200)
    wide = ids.join(ids.withColumnRenamed("id", "b"), F.col("id") == F.col("b")).join(ids.withColumnRenamed("id", "c"), F.col("id") == F.col("c"))
    assert len(ordering.slice_bounds(wide, ["id"])) == 3
    assert ordering.slice_bounds(wide.limit(40), ["id"]) == []


def test_types_of_order_columns(spark):
    df = spark.range(60).selectExpr(
        "id", "if(id % 7 = 0, null, date_add(date'0900-01-01', cast(id * 37 % 60 as int))) AS d", "cast(id as decimal(20,2)) AS m", "concat('é', id % 5) AS s",
        "timestamp'1969-12-31 23:59:00' + make_interval(0, 0, 0, 0, 0, 0, id) AS ts",
        "timestamp_ntz'0001-01-01 23:59:00' + make_interval(0, 0, 0, 0, 0, 0, id * 11.25) AS nt", "if(id % 3 = 0, double('nan'), id / 7.0) AS f", "id % 2 = 0 AS b",
    )
    for order in (["d", "id"], ["m"], ["s", "ts"], ["f", "id"], ["b", "m"], ["ts"], ["nt"]):
        one, many = (
            sorted((r.id, r.pos) for r in ordered_scan(df, PositionKernel("pos"), order, [], parts).collect()) for parts in (1, 9)
        )
        assert one == many
    one, many = (sorted((r.id, r.pos) for r in ordered_scan(df, PositionKernel("pos"), ["m"], ["d"], parts).collect()) for parts in (1, 40))
    assert one == many
