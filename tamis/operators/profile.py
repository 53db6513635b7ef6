"""Profiling and analysis.

Each profile is one or two aggregations over all rows that return a bounded result
(one row per column, or one row per bin/bucket).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    BooleanType,
    DateType,
    DoubleType,
    FloatType,
    NumericType,
    StringType,
    TimestampNTZType,
    TimestampType,
)

from tamis.functions.exprs import is_missing, nan_as_null
from tamis.functions.stats import quantiles
from tamis.operators.base import col, one_row
from tamis.operators.duplicates import duplicate_count


def _numeric(df):
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]


def missing_summary(df: DataFrame) -> DataFrame:
    """A3 (and A1's missing table): column, missing count and ratio, most missing first."""
    n = F.count(F.lit(1))
    aggs = [n.alias("__n")] + [F.sum(is_missing(df, c).cast("long")).alias(f"m{i}") for i, c in enumerate(df.columns)]
    row = df.agg(*aggs)
    stacked = row.select(
        F.col("__n"),
        F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.lit(i).alias("ord"), F.col(f"m{i}").alias("missing")) for i, c in enumerate(df.columns)])).alias("r"),
    ).select("r.column", "r.ord", "r.missing", (F.col("r.missing") / F.col("__n")).alias("missing_ratio"))
    return stacked


def describe(df: DataFrame, method: str | None = None) -> DataFrame:
    """A1 describe: count, mean, std, min, 25%, 50%, 75%, max per numeric column."""
    nums = _numeric(df)
    spark = df.sparkSession
    if not nums:
        return spark.createDataFrame([], "column string, count long, mean double, std double, min double, q25 double, q50 double, q75 double, max double")
    aggs = []
    for i, c in enumerate(nums):
        x = col(c).cast("double")
        x = F.when(~F.isnan(x), x)  # NaN counts as missing, as in pandas
        aggs += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"a{i}"), F.stddev_samp(x).alias(f"s{i}"), F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}")]
    row = one_row(df, *aggs)
    known = {c: (row[f"n{i}"], row[f"lo{i}"], row[f"hi{i}"]) for i, c in enumerate(nums)}
    qs = quantiles(df, nums, [0.25, 0.5, 0.75], method, known=known)
    rows = [
        (c, row[f"n{i}"], row[f"a{i}"], row[f"s{i}"], row[f"lo{i}"], qs[c][0], qs[c][1], qs[c][2], row[f"hi{i}"])
        for i, c in enumerate(nums)
    ]
    return spark.createDataFrame(rows, "column string, count long, mean double, std double, min double, q25 double, q50 double, q75 double, max double")


def compute_basic_stats(df: DataFrame, method: str | None = None) -> dict:
    """A1: shape, types, missing, describe, memory estimate and duplicate rows."""
    n = df.count()
    miss = missing_summary(df).orderBy(F.desc("missing"), "ord").collect()
    lengths = one_row(df, *[F.avg(F.octet_length(col(f.name))).alias(f"l{i}") for i, f in enumerate(df.schema.fields) if isinstance(f.dataType, StringType)] or [F.lit(0).alias("none")]).asDict()
    # Bytes per value of fixed-width types.
    widths = {"tinyint": 1, "smallint": 2, "int": 4, "bigint": 8, "float": 4, "double": 8, "boolean": 1, "date": 4,
              "timestamp": 8, "timestamp_ntz": 8}
    mem = 0.0
    for i, f in enumerate(df.schema.fields):
        if isinstance(f.dataType, StringType):
            mem += (lengths.get(f"l{i}") or 0) * n
        else:
            mem += widths.get(f.dataType.simpleString(), 16) * n
    return {
        "rows": n,
        "columns": len(df.columns),
        "dtypes": {f.name: f.dataType.simpleString() for f in df.schema.fields},
        "missing": {r["column"]: r["missing"] for r in miss},
        "total_missing": sum(r["missing"] for r in miss),
        "describe": [r.asDict() for r in describe(df, method).collect()],
        "memory_bytes_estimate": mem,
        "duplicate_rows": duplicate_count(df),
    }


def compare_stats(before: dict, after: dict) -> dict:
    """A2: row, column and missing deltas (inf percentage when growing from 0)."""

    def pct(a, b):
        if a == 0:
            return 0.0 if b == 0 else math.inf
        return (b - a) / a * 100

    return {
        "rows_delta": after["rows"] - before["rows"],
        "rows_pct": pct(before["rows"], after["rows"]),
        "columns_delta": after["columns"] - before["columns"],
        "missing_delta": after["total_missing"] - before["total_missing"],
        "missing_pct": pct(before["total_missing"], after["total_missing"]),
        "added_columns": [c for c in after["dtypes"] if c not in before["dtypes"]],
        "removed_columns": [c for c in before["dtypes"] if c not in after["dtypes"]],
    }


def quality_metrics(df: DataFrame) -> DataFrame:
    """A4: completeness = 1 − missing/cells, uniqueness = 1 − duplicate rows/rows."""
    n_cols = len(df.columns)
    miss = sum(is_missing(df, c).cast("long") for c in df.columns)
    stats = df.agg(F.count(F.lit(1)).alias("rows"), F.sum(miss).alias("missing")).first()
    distinct = df.distinct().count()
    rows, missing = stats["rows"], stats["missing"] or 0
    dup = rows - distinct
    out = [(rows, missing, dup, (1 - missing / (rows * n_cols)) if rows else None, (1 - dup / rows) if rows else None)]
    return df.sparkSession.createDataFrame(out, "rows long, missing long, duplicate_rows long, completeness double, uniqueness double")


def distinct_counts(df: DataFrame, columns: list[str]) -> dict[str, int]:
    """Exact numbers of distinct values (of their 128-bit hashes), missing values not counted, in one aggregation.

    Hashes of all columns are stacked and grouped, so that no value of any length is shuffled.
    """
    entries = []
    for i, c in enumerate(columns):
        x = col(c)
        if isinstance(df.schema[c].dataType, (DoubleType, FloatType)):
            x = F.when(x == 0, F.lit(0.0)).otherwise(x)  # minus zero is zero
        entries.append(F.struct(F.when(col(c).isNotNull(), F.lit(i)).alias("i"), F.xxhash64(x).alias("a"), F.xxhash64(F.lit(i), x).alias("b")))
    if not entries:
        return {}
    # no function over the array's entries: that would leave generated code
    cells = df.select(F.inline(F.array(*entries))).where("i IS NOT NULL").distinct()
    found = {r["i"]: r["count"] for r in cells.groupBy("i").count().collect()}
    return {c: found.get(i, 0) for i, c in enumerate(columns)}


@nan_as_null
def analyze_dataset_advanced(df: DataFrame, exact_distinct: bool = True, as_dict: bool = False, with_correlations: bool = True):
    """A10: per-column type group and statistics over all rows (two aggregations and the distinct counts)."""
    fields = df.schema.fields
    aggs = [F.count(F.lit(1)).alias("__n")]
    distinct = distinct_counts(df, df.columns) if exact_distinct else {}
    for i, f in enumerate(fields):
        c = col(f.name)
        if not exact_distinct:
            aggs.append(F.approx_count_distinct(c, 0.01).alias(f"u{i}"))
        aggs.append(F.sum(is_missing(df, f.name).cast("long")).alias(f"m{i}"))
        if isinstance(f.dataType, NumericType) and not isinstance(f.dataType, BooleanType):
            x = c.cast("double")
            aggs += [F.var_samp(x).alias(f"v{i}"), F.skewness(x).alias(f"s{i}"), F.kurtosis(x).alias(f"k{i}"), F.avg(x).alias(f"a{i}")]
        elif isinstance(f.dataType, StringType):
            aggs += [
                F.avg(F.char_length(c)).alias(f"l{i}"),
                F.bool_or(c.rlike(r"\d")).alias(f"d{i}"),
                F.bool_or(c.rlike(r"[^a-zA-Z0-9\s]")).alias(f"p{i}"),
            ]
    row = one_row(df, *aggs)
    n = row["__n"]
    prof = {"rows": n, "numeric_cols": [], "categorical_cols": [], "datetime_cols": [], "text_cols": [], "binary_cols": [], "high_cardinality_cols": [], "stats": {}}
    out_rows = []
    for i, f in enumerate(fields):
        u, m = distinct[f.name] if exact_distinct else row[f"u{i}"], row[f"m{i}"]
        st = {"unique_count": u, "missing_rate": m / max(n, 1), "variance": None, "skewness": None, "kurtosis": None, "mean": None, "avg_length": None}
        t = f.dataType
        if isinstance(t, NumericType) and not isinstance(t, BooleanType):
            kind = "numeric"
            prof["numeric_cols"].append(f.name)
            if n - m > 1:
                st.update(variance=row[f"v{i}"], skewness=row[f"s{i}"], kurtosis=row[f"k{i}"], mean=row[f"a{i}"])
                if u == 2:
                    prof["binary_cols"].append(f.name)
        elif isinstance(t, (TimestampType, TimestampNTZType, DateType)):
            kind = "datetime"
            prof["datetime_cols"].append(f.name)
        elif isinstance(t, StringType):
            avg_len = row[f"l{i}"]
            st["avg_length"] = avg_len
            if u > 50:
                prof["high_cardinality_cols"].append(f.name)
            if u / max(n, 1) > 0.8 or (avg_len or 0) > 20:
                kind = "text"
                prof["text_cols"].append(f.name)
            else:
                kind = "categorical"
                prof["categorical_cols"].append(f.name)
                if u == 2:
                    prof["binary_cols"].append(f.name)
        else:
            kind = "other"
            prof["categorical_cols"].append(f.name)
        st["type"] = kind
        prof["stats"][f.name] = st
        out_rows.append((f.name, kind, int(u), float(st["missing_rate"]), st["variance"], st["skewness"], st["kurtosis"], st["avg_length"]))
    if with_correlations and len(prof["numeric_cols"]) > 1:
        from tamis.operators.features import pearson_pairs

        corr = pearson_pairs(df, prof["numeric_cols"])
        prof["correlations"] = corr
        prof["high_correlations"] = [
            {"feature1": a, "feature2": b, "correlation": abs(r)} for (a, b), (r, _) in corr.items() if r is not None and abs(r) > 0.7
        ]
    if as_dict:
        return prof
    return df.sparkSession.createDataFrame(
        out_rows,
        "column string, kind string, unique_count long, missing_rate double, variance double, skewness double, kurtosis double, avg_length double",
    )


@nan_as_null
def histogram(df: DataFrame, column: str, bins: int = 50, method: str | None = None) -> DataFrame:
    """Counts over equal-width bins between the 1st and 99th percentiles."""
    x = col(column).cast("double")
    q = quantiles(df, [column], [0.01, 0.99], method)[column]
    spark = df.sparkSession
    schema = "bin int, lo double, hi double, count long"
    if q[0] is None:
        return spark.createDataFrame([], schema)
    lo, hi = q
    distinct = df.where(x.isNotNull()).select(x).distinct().limit(2).count()
    if distinct <= 1 or hi <= lo:
        return spark.createDataFrame([], schema)
    b = max(1, min(50, int(bins)))
    width = (hi - lo) / b
    trimmed = df.where((x >= lo) & (x <= hi))
    code = F.least(F.floor((x - F.lit(lo)) / F.lit(width)).cast("int"), F.lit(b - 1))
    counted = trimmed.groupBy(code.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    return counted.select("bin", (F.lit(lo) + F.col("bin") * F.lit(width)).alias("lo"), (F.lit(lo) + (F.col("bin") + 1) * F.lit(width)).alias("hi"), "count")


@nan_as_null
def line_series(df: DataFrame, time_col: str, value_col: str, max_points: int = 1000) -> DataFrame:
    """(time, value) reduced to at most ``max_points`` time buckets by mean."""
    from tamis.operators.dates import parse_timestamp

    t = parse_timestamp(df, time_col)
    b = df.select(F.unix_micros(t.cast("timestamp")).alias("__us"), col(value_col).cast("double").alias("__v")).where("__us IS NOT NULL")
    lo_hi = b.agg(F.min("__us"), F.max("__us")).first()
    if lo_hi[0] is None:
        return df.sparkSession.createDataFrame([], f"`{time_col}` timestamp_ntz, `{value_col}` double")
    width = max(1, (lo_hi[1] - lo_hi[0]) // max_points + 1)
    g = b.groupBy(F.floor((F.col("__us") - lo_hi[0]) / width).alias("__b")).agg(F.avg("__v").alias(value_col), F.min("__us").alias("__t"))
    return g.select(F.timestamp_micros("__t").cast("timestamp_ntz").alias(time_col), value_col)


@nan_as_null
def box_summary(df: DataFrame, column: str, method: str | None = None) -> DataFrame:
    """Quartiles, whiskers (extreme values within 1.5 IQR) and outlier count."""
    x = col(column).cast("double")
    q1, q2, q3 = quantiles(df, [column], [0.25, 0.5, 0.75], method)[column]
    spark = df.sparkSession
    if q1 is None:
        return spark.createDataFrame([], "q1 double, median double, q3 double, lower_whisker double, upper_whisker double, outliers long")
    lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    inside = (x >= lo) & (x <= hi)
    return df.agg(
        F.lit(q1).alias("q1"),
        F.lit(q2).alias("median"),
        F.lit(q3).alias("q3"),
        F.min(F.when(inside, x)).alias("lower_whisker"),
        F.max(F.when(inside, x)).alias("upper_whisker"),
        F.count(F.when(x.isNotNull() & ~inside, F.lit(1))).alias("outliers"),
    )


def missing_matrix(df: DataFrame, order_by, bucket_rows: int = 1) -> DataFrame:
    """Long form (row bucket, column, missing count) of the NULL pattern."""
    key = F.floor(col(order_by) / F.lit(bucket_rows)).cast("long") if bucket_rows > 1 else col(order_by)
    # one sum per column first: the unpivot sees buckets, not rows
    counts = df.groupBy(key.alias("row")).agg(*[F.sum(is_missing(df, c).cast("int")).alias(f"m{i}") for i, c in enumerate(df.columns)])
    cells = [F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("missing")) for i, c in enumerate(df.columns)]
    return counts.select("row", F.inline(F.array(*cells)))


@nan_as_null
def rolling_mean_full(df: DataFrame, value_col: str, order_by, window: int, partition_by=(), output="rolling_mean") -> DataFrame:
    """Trailing mean that needs a full window of non-missing values."""
    from tamis.functions.ordering import RollingMeanKernel, ordered_scan

    w = max(3, min(30, int(window)))
    order_by = [order_by] if isinstance(order_by, str) else list(order_by)
    return ordered_scan(df, RollingMeanKernel(value_col, w, w, output), order_by, list(partition_by))


@nan_as_null
def class_distribution(df: DataFrame, target: str) -> DataFrame:
    """Count per class, missing included."""
    return df.groupBy(col(target).alias(target)).agg(F.count(F.lit(1)).alias("count"))


@nan_as_null
def scatter_pairs(df: DataFrame, x: str, y: str) -> DataFrame:
    """Complete (x, y) rows."""
    return df.select(col(x), col(y)).dropna()
