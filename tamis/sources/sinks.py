"""K1–K6: writers. Every writer is a distributed ``DataFrameWriter``; the reference's
single-string exports and its Dask first-part-only Parquet are not reproduced."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tamis.operators.base import col
from tamis.operators.pii import redact


def write_csv(df: DataFrame, path: str, compression: str | None = None, mode: str = "overwrite") -> None:
    """K1 / K4 (``compression="gzip"``)."""
    w = df.write.mode(mode).option("header", True)
    if compression:
        w = w.option("compression", compression)
    w.csv(path)


def write_parquet(df: DataFrame, path: str, compression: str = "snappy", mode: str = "overwrite", partition_by=None) -> None:
    """K2 / K3."""
    w = df.write.mode(mode).option("compression", compression)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def export_columns(df: DataFrame, path: str, columns, fmt: str = "csv", redact_columns=None) -> None:
    """K5 (+A6): chosen columns, flagged columns redacted, written in parallel."""
    out = df.select(*[col(c) for c in columns])
    if redact_columns:
        out = redact(out, [c for c in redact_columns if c in columns])
    (write_csv if fmt == "csv" else write_parquet)(out, path)


def write_matrix(matrix: DataFrame, path: str) -> None:
    """K6: a (bounded) correlation matrix in long form as one CSV file."""
    matrix.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
