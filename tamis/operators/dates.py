"""T4 ``standardize_dates`` and date parsing shared by the datetime features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, TimestampNTZType, TimestampType

from tamis.functions.exprs import strftime_to_java
from tamis.operators.base import FittedStep, Step, col, register_step, replace_columns

# Text date layouts tried in order when parsing (month before day, as pandas).
PARSE_FORMATS = [
    "yyyy-MM-dd HH:mm:ss[.SSSSSSSSS][.SSSSSS][.SSS][.SS][.S][XXX][X]",
    "yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS][.SSSSSS][.SSS][.SS][.S][XXX][X]",
    "yyyy-MM-dd HH:mm",
    "yyyy-MM-dd'T'HH:mm",
    "yyyy-MM-dd",
    "yyyy/MM/dd[ HH:mm[:ss]]",
    "MM/dd/yyyy[ HH:mm[:ss]]",
    "dd/MM/yyyy[ HH:mm[:ss]]",
    "MM-dd-yyyy[ HH:mm[:ss]]",
    "dd.MM.yyyy[ HH:mm[:ss]]",
]


def parse_timestamp(df: DataFrame, c: str, formats=None) -> Column:
    """Timestamp from a timestamp/date column, or from text; unparseable text is NULL."""
    t = df.schema[c].dataType
    if isinstance(t, (TimestampType, TimestampNTZType)):
        return col(c)
    if isinstance(t, DateType):
        return col(c).cast("timestamp_ntz")
    s = F.trim(col(c).cast("string"))
    tries = [F.try_to_timestamp(s, F.lit(f)) for f in (formats or PARSE_FORMATS)]
    return F.coalesce(*tries).cast("timestamp_ntz")


@register_step("standardize_dates")
class StandardizeDates(Step):
    required = ("columns",)

    def fit(self, df: DataFrame) -> FittedStep:
        p = self.params
        try:
            pattern = strftime_to_java(p.get("format", "%Y-%m-%d"))
        except ValueError:
            pattern = "yyyy-MM-dd"
        exprs = {c: F.date_format(parse_timestamp(df, c, p.get("input_formats")), pattern) for c in p["columns"]}
        return FittedStep(self.kind, p, {"pattern": pattern}, lambda d: replace_columns(d, exprs))
