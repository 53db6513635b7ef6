"""T12 ``type_convert``: parsing never fails the job (try_cast), as pandas' coerce."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from tamis.operators.base import FittedStep, Step, StepError, col, register_step, replace_columns

TYPES = ("bool", "category", "int", "float", "string")


def convert_expr(df, c, t):
    x = col(c)
    if t == "bool":
        if isinstance(df.schema[c].dataType, BooleanType):
            return F.coalesce(x, F.lit(False))
        return F.coalesce(x.try_cast("double"), F.lit(0.0)) != 0
    if t == "int":
        v = F.coalesce(x.try_cast("double"), F.lit(0.0))
        return F.when(v.isNaN(), F.lit(0)).otherwise(v.try_cast("long"))
    if t == "float":
        return x.try_cast("double")
    if t == "category":
        return x.cast("string").alias(c, metadata={"tamis.kind": "nominal"})
    return x.cast("string")


@register_step("type_convert")
class TypeConvert(Step):
    required = ("column", "type")

    def check_params(self):
        if self.params["type"] not in TYPES:
            raise StepError(f"type_convert: unsupported type {self.params['type']!r}; allowed {TYPES}")

    def fit(self, df):
        p = self.params
        c = p["column"]
        e = convert_expr(df, c, p["type"])
        return FittedStep(self.kind, p, {}, lambda d: replace_columns(d, {c: e}))
