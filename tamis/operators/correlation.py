"""Correlation profiles: A7 Pearson / Spearman / Kendall matrices with p-values and
significant pairs, A8 heatmap data, A11 high-correlation pairs.

Pearson sums come from one pass for all pairs (``functions.gram``); Spearman and Kendall stack
the columns and rank them together (``functions.ranks``). All named (else all numeric) columns
take part, over pairwise-complete rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from tamis.functions.exprs import nan_as_null
from tamis.functions.ranks import kendall, spearman
from tamis.functions.stats import normal_two_sided, student_t_sf
from tamis.operators.base import col, one_row
from tamis.operators.features import pearson_pairs

SCHEMA = "Variable1 string, Variable2 string, correlation double, n long, p_value double"


def _eligible(df, columns):
    """The named, else all numeric columns, with three values at least."""
    cols = list(columns or [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)])
    row = one_row(df, *[F.count(col(c)).alias(f"n{i}") for i, c in enumerate(cols)])
    return [c for i, c in enumerate(cols) if row[f"n{i}"] >= 3]


def p_value(r, n):
    if r is None or n is None or n < 3:
        return 1.0
    if abs(r) >= 1.0:
        return 0.0
    t = r * math.sqrt((n - 2) / (1 - r * r))
    return student_t_sf(t, n - 2)


def _long(df, cols, pairs):
    rows = []
    for a in cols:
        for b in cols:
            if a == b:
                rows.append((a, b, 1.0, None, 1.0))
                continue
            r, n = pairs.get((a, b)) or pairs.get((b, a)) or (None, 0)
            rows.append((a, b, r if r is not None else 0.0, n, p_value(r, n)))
    return df.sparkSession.createDataFrame(rows, SCHEMA)


@nan_as_null
def pearson_matrix(df: DataFrame, columns=None) -> DataFrame:
    """A7a + A7d: long-form Pearson matrix with two-sided p-values (NaN shown as 0)."""
    cols = _eligible(df, columns)
    return _long(df, cols, pearson_pairs(df, cols))


@nan_as_null
def spearman_pairs(df: DataFrame, cols) -> dict:
    """Spearman rho per pair = Pearson r of average ranks over pairwise-complete rows."""
    return {(cols[i], cols[j]): found for (i, j), found in spearman(df, [col(c) for c in cols]).items()}


@nan_as_null
def spearman_matrix(df: DataFrame, columns=None) -> DataFrame:
    """A7b + A7d."""
    cols = _eligible(df, columns)
    return _long(df, cols, spearman_pairs(df, cols))


def significant_pairs(matrix: DataFrame, alpha=0.05, min_abs=0.3, strong=0.7) -> DataFrame:
    """A7e: off-diagonal pairs (each once) with p < alpha and |r| ≥ min_abs."""
    m = matrix.where((F.col("Variable1") < F.col("Variable2")) & (F.col("p_value") < alpha) & (F.abs("correlation") >= min_abs))
    return m.select(
        "Variable1",
        "Variable2",
        "correlation",
        "p_value",
        F.when(F.abs("correlation") >= strong, F.lit("strong")).otherwise(F.lit("moderate")).alias("strength"),
    )


def heatmap_top_pairs(matrix: DataFrame, threshold=0.0, top=10) -> DataFrame:
    """The strongest off-diagonal entries, both orientations, by |r|."""
    m = matrix.where((F.col("Variable1") != F.col("Variable2")) & (F.abs("correlation") > threshold))
    return m.orderBy(F.desc(F.abs("correlation")), "Variable1", "Variable2").limit(top).select("Variable1", "Variable2", "correlation")


@nan_as_null
def high_correlation_pairs(df: DataFrame, columns=None, threshold=0.7) -> DataFrame:
    """Pairs (i < j in column order) with |r| > threshold."""
    cols = list(columns or [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)])
    pairs = pearson_pairs(df, cols)
    rows = [(a, b, abs(r)) for (a, b), (r, _) in pairs.items() if r is not None and abs(r) > threshold]
    return df.sparkSession.createDataFrame(rows, "feature1 string, feature2 string, correlation double")


def kendall_tau_b(df: DataFrame, a: str, b: str) -> tuple:
    """(tau-b, n, p) of two columns over pairwise-complete rows, exactly, with the
    two-sided p-value by the normal approximation (as for large samples)."""
    tau, n = kendall(df, [col(a), col(b)])[0, 1]
    return tau, n, kendall_p(tau, n)


def kendall_p(tau: float | None, n: int) -> float:
    if tau is None or n < 3:
        return 1.0
    return normal_two_sided(3 * tau * math.sqrt(n * (n - 1)) / math.sqrt(2 * (2 * n + 5)))


@nan_as_null
def kendall_matrix(df: DataFrame, columns=None) -> DataFrame:
    """A7c + A7d in the long matrix form; all pairs in one set of jobs."""
    cols = _eligible(df, columns)
    found = kendall(df, [col(c) for c in cols])
    rows = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            if i == j:
                rows.append((a, b, 1.0, None, 1.0))
            else:
                tau, n = found[min(i, j), max(i, j)]
                rows.append((a, b, tau if tau is not None else 0.0, n, kendall_p(tau, n)))
    return df.sparkSession.createDataFrame(rows, SCHEMA)
