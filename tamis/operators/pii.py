"""T14 ``mask_pii``, A5 PII detection and A6 redaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tamis.functions.fixed import PII_DETECT_PATTERNS, PII_MASK_ORDER, PII_PATTERNS
from tamis.operators.base import FittedStep, Step, col, register_step, replace_columns


def mask_expr(x: Column, patterns: dict | None = None) -> Column:
    s = x.cast("string")
    if patterns:
        items = list(patterns.values())
    else:
        items = [PII_PATTERNS[k] for k in PII_MASK_ORDER]
    out = s
    for pattern, repl in items:
        out = F.regexp_replace(out, pattern, repl)
    if patterns:
        return out
    # Every default pattern needs "@" (email), "://" (url), digit.digit (ip) or four digits
    # in a row (card, ssn, phone), and no replacement token contains any of them, so text
    # without them is returned as is without running the six scans.
    gate = s.contains("@") | s.contains("://") | s.rlike(r"[0-9]\.[0-9]|[0-9]{4}")
    return F.when(gate, out).otherwise(s)


@register_step("mask_pii")
class MaskPII(Step):
    required = ("columns",)

    def fit(self, df):
        p = self.params
        exprs = {c: mask_expr(col(c), p.get("patterns")) for c in p["columns"]}
        return FittedStep(self.kind, p, {}, lambda d: replace_columns(d, exprs))


def detect_pii(df: DataFrame, first_only: bool = False) -> DataFrame:
    """(column, pii_type) for each text column with a value matching a PII pattern.

    One aggregation over all rows evaluates every column × pattern flag; the result has
    at most columns × 4 rows.
    """
    spark = df.sparkSession
    text_cols = [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]
    pairs = [(c, t) for c in text_cols for t in PII_DETECT_PATTERNS]
    if not pairs:
        return spark.createDataFrame([], "column string, pii_type string")
    aggs = [F.bool_or(F.coalesce(col(c).rlike(PII_DETECT_PATTERNS[t]), F.lit(False))).alias(f"f{i}") for i, (c, t) in enumerate(pairs)]
    flags = df.agg(*aggs)
    stacked = flags.select(
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("column"), F.lit(t).alias("pii_type"), F.lit(i).alias("ord"), F.col(f"f{i}").alias("hit")) for i, (c, t) in enumerate(pairs)])
        ).alias("r")
    ).select("r.*").where("hit")
    if first_only:
        stacked = stacked.groupBy("column").agg(F.min_by("pii_type", "ord").alias("pii_type"), F.min("ord").alias("ord"))
    return stacked.select("column", "pii_type", "ord").orderBy("ord").drop("ord")


def redact(df: DataFrame, columns) -> DataFrame:
    return replace_columns(df, {c: F.when(col(c).isNotNull(), F.lit("[REDACTED]")) for c in columns})
