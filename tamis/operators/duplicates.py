"""T8 ``duplicates``.

First and last copies come from ``row_number() = 1`` by subset, which Spark prunes to one row
per group and task before the shuffle (WindowGroupLimit), so a group of copies holding a
third of the table never lands in one task. Groups without copies come from a count by subset
that is joined back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from tamis.operators.base import FittedStep, Step, col, register_step


def remove_duplicates(df: DataFrame, subset=None, keep="first", order_by=None) -> DataFrame:
    cols = df.columns
    subset = list(subset) if subset else list(cols)
    order_by = [order_by] if isinstance(order_by, str) else list(order_by or [])
    if keep is False or keep == "none":
        once = df.groupBy(*[col(c).alias(f"__k{i}") for i, c in enumerate(subset)]).agg(F.count(F.lit(1)).alias("__n")).where("__n = 1")
        same = [col(c).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate(subset)]
        return df.join(once, same, "left_semi")
    if set(subset) == set(cols):
        return df.dropDuplicates()
    # The order decides which copy survives; without one the smallest row does.
    sortable = [f.name for f in df.schema.fields if not isinstance(f.dataType, MapType)]
    keys = [col(c) for c in dict.fromkeys([*order_by, *sortable])]
    order = [k.asc_nulls_first() if keep == "first" else k.desc_nulls_last() for k in keys]
    place = F.row_number().over(Window.partitionBy(*[col(c) for c in subset]).orderBy(*order))
    return df.withColumn("__place", place).where("__place = 1").drop("__place")


def duplicate_count(df: DataFrame, subset=None) -> int:
    """Rows that repeat an earlier row (on ``subset``)."""
    cols = list(subset) if subset else df.columns
    row = df.agg(F.count(F.lit(1)).alias("n")).first()
    distinct = df.select(*[col(c) for c in cols]).distinct().count()
    return row["n"] - distinct


@register_step("duplicates")
class Duplicates(Step):
    rowwise = False

    def input_columns(self):
        return list(self.params.get("subset") or [])

    def fit(self, df):
        p = self.params
        keep = p.get("keep", "first")
        if keep not in ("first", "last", False, "none"):
            keep = "first"
        return FittedStep(
            self.kind, p, {}, lambda d: remove_duplicates(d, p.get("subset"), keep, p.get("order_by"))
        )
