"""Deterministic preview samples.

``sample_for_preview`` returns every row when there are at most ``n``; otherwise the
``n`` rows with the smallest seeded hash of their key — a top-k (each task keeps its own
k, then one merge of k rows per task), never a full sort or a driver-side loop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from tamis.functions.exprs import stable_hash
from tamis.operators.base import col

PREVIEW_ROWS = 1000


def sample_for_preview(df: DataFrame, n: int = PREVIEW_ROWS, seed: int = 42, key_columns=None) -> DataFrame:
    keys = [col(c) for c in (key_columns or df.columns)]
    h = stable_hash(keys, seed)
    return df.withColumn("__h", h).orderBy("__h", *keys).limit(n).drop("__h")
