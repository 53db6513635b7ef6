"""Step base classes and the registry of step kinds.

A step is fitted with at most a few bounded Spark aggregations; the fitted step keeps
only small state on the driver (scalars, short value lists) or a Spark DataFrame for
unbounded lookup maps, and ``transform`` is a single projection of column expressions.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass, field
from typing import Any, Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType

from tamis.functions.exprs import nan_to_null

REGISTRY: dict[str, type["Step"]] = {}


class StepError(ValueError):
    """Bad step parameters or columns; raised at validation time."""


def register_step(kind: str):
    def deco(cls):
        cls.kind = kind
        REGISTRY[kind] = cls
        return cls

    return deco


@dataclass
class FittedStep:
    kind: str
    params: dict
    state: dict = field(default_factory=dict)
    fn: Callable[[DataFrame], DataFrame] | None = None
    lineage: dict = field(default_factory=dict)

    def transform(self, df: DataFrame) -> DataFrame:
        df = nan_to_null(df)  # missing is NULL in every step
        return self.fn(df) if self.fn else df


class Step:
    kind = "?"
    required: tuple[str, ...] = ()
    # Whether a fitted step is a row-wise projection (valid on a streaming DataFrame).
    rowwise = True

    def __init_subclass__(cls, **kwargs):
        super().__init_subclass__(**kwargs)
        if "fit" in cls.__dict__:
            fit = cls.fit
            cls.fit = functools.wraps(fit)(lambda self, df: fit(self, nan_to_null(df)))

    def __init__(self, **params: Any):
        missing = [p for p in self.required if p not in params]
        if missing:
            raise StepError(f"{self.kind}: missing required parameter(s) {missing}")
        self.params = params
        self.check_params()

    def check_params(self) -> None:
        pass

    def input_columns(self) -> list[str]:
        cols = self.params.get("columns")
        if cols is None:
            one = self.params.get("column") or self.params.get("target") or self.params.get("time_column")
            return [one] if one else []
        return list(cols)

    def check_columns(self, df: DataFrame) -> None:
        absent = [c for c in self.input_columns() if c not in df.columns]
        if absent:
            raise StepError(f"{self.kind}: columns not in DataFrame: {absent}")

    def fit(self, df: DataFrame) -> FittedStep:
        raise NotImplementedError

    def fit_transform(self, df: DataFrame) -> DataFrame:
        self.check_columns(df)
        return self.fit(df).transform(df)


# ---- helpers shared by steps -------------------------------------------------------------


def clamp(v, lo, hi):
    return max(lo, min(hi, v))


def is_numeric(df: DataFrame, c: str) -> bool:
    t = df.schema[c].dataType
    return isinstance(t, NumericType) and not isinstance(t, BooleanType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]


def other_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if not isinstance(f.dataType, NumericType)]


def replace_columns(df: DataFrame, exprs: dict[str, Column]) -> DataFrame:
    """One projection that replaces or appends columns, keeping column order."""
    if not exprs:
        return df
    out = [exprs[c].alias(c) if c in exprs else F.col(f"`{c}`") for c in df.columns]
    out += [e.alias(c) for c, e in exprs.items() if c not in df.columns]
    return df.select(*out)


def col(c: str) -> Column:
    return F.col(f"`{c}`")


def unique_name(existing, base: str) -> str:
    """Deterministic fresh column name: base, base_1, base_2, ..."""
    existing = set(existing)
    if base not in existing:
        return base
    i = 1
    while f"{base}_{i}" in existing:
        i += 1
    return f"{base}_{i}"


def one_row(df: DataFrame, *aggs: Column):
    """Run one aggregation (the fit of a step) and return its single row."""
    return df.agg(*aggs).first()


def as_double(c: Column) -> Column:
    return c.cast("double")
