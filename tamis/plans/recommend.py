"""Rule-based recommendations from one bounded profile.

Profile passes (all over every row):
1. one aggregation: row count, per-column missing counts, numeric min/max/mean/population
   std/skewness, a 0/1 test and a sketch of the distinct integers;
2. one aggregation: outlier counts by |z| > 3 (needs pass 1's mean and std) and the exact
   number of values of integer columns that the sketch says are few;
3. one job over the categorical columns unpivoted to (column, value): value counts with
   map-side combine, then per-column max/min share and rare-value counts;
4. the duplicate-row count.
The rules run on the driver over that profile.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegralType, NumericType

from tamis.functions.exprs import nan_to_null
from tamis.functions.fixed import ID_NAMES
from tamis.operators.base import col, one_row
from tamis.operators.duplicates import duplicate_count

SCHEMA = "rank int, type string, column string, severity string, priority double, value double"


FEW_VALUES = 20  # R10


def profile_for_rules(df: DataFrame) -> dict:
    df = nan_to_null(df)
    fields = df.schema.fields
    nums = [f for f in fields if isinstance(f.dataType, NumericType) and not isinstance(f.dataType, BooleanType)]
    ints = [f for f in nums if isinstance(f.dataType, IntegralType)]
    cats = [f for f in fields if not isinstance(f.dataType, NumericType)]
    aggs = [F.count(F.lit(1)).alias("__n")]
    aggs += [F.count_if(col(f.name).isNull()).alias(f"m{i}") for i, f in enumerate(fields)]
    # the sketch only tells which columns may have few values; those are counted exactly below
    aggs += [F.approx_count_distinct(col(f.name)).alias(f"u{i}") for i, f in enumerate(ints)]
    for i, f in enumerate(nums):
        x = col(f.name).cast("double")
        aggs += [
            F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}"), F.avg(x).alias(f"a{i}"), F.stddev_pop(x).alias(f"s{i}"),
            F.skewness(x).alias(f"k{i}"), F.count(x).alias(f"c{i}"),
            F.bool_and(F.coalesce(x.isin(0.0, 1.0), F.lit(True))).alias(f"b{i}"),
        ]
    row = one_row(df, *aggs)
    n = row["__n"]
    prof = {"rows": n, "cols": {}}
    for i, f in enumerate(fields):
        prof["cols"][f.name] = {"missing": row[f"m{i}"], "unique": None, "numeric": False}
    second = []
    for i, f in enumerate(nums):
        p = prof["cols"][f.name]
        p.update(numeric=True, min=row[f"lo{i}"], max=row[f"hi{i}"], mean=row[f"a{i}"], std=row[f"s{i}"], skew=row[f"k{i}"],
                 count=row[f"c{i}"], binary=row[f"b{i}"] and row[f"c{i}"] > 0)
        if p["std"]:
            far = F.abs((col(f.name).cast("double") - F.lit(p["mean"])) / F.lit(p["std"])) > 3
            second.append(F.count_if(far).alias(f"outliers.{f.name}"))
    for i, f in enumerate(ints):
        if row[f"u{i}"] <= 5 * FEW_VALUES:
            second.append(F.size(F.collect_set(col(f.name))).alias(f"unique.{f.name}"))
    if second:
        for key, value in one_row(df, *second).asDict().items():
            what, name = key.split(".", 1)
            prof["cols"][name][what] = value
    if cats:
        stacked = df.select(F.explode(F.array(*[F.struct(F.lit(f.name).alias("c"), col(f.name).cast("string").alias("v")) for f in cats])).alias("r")).select("r.c", "r.v")
        vc = stacked.where("v IS NOT NULL").groupBy("c", "v").agg(F.count(F.lit(1)).alias("k"))
        tot = vc.groupBy("c").agg(F.sum("k").alias("t"), F.max("k").alias("mx"), F.min("k").alias("mn"), F.count("*").alias("u"))
        shares = vc.join(tot, "c").groupBy("c", "t", "mx", "mn", "u").agg(F.count(F.when(F.col("k") / F.col("t") < 0.01, 1)).alias("rare"))
        for r in shares.collect():
            prof["cols"][r["c"]].update(total=r["t"], max_share=r["mx"] / r["t"], min_share=r["mn"] / r["t"], rare=r["rare"], unique=r["u"])
    prof["duplicates"] = duplicate_count(df)
    return prof


# ---- the rules -----------------------------------------------------------------------------
#
# A finding is a value or None. ``Seen`` is what a rule looks at: a column's profile and the
# number of rows. An action names the step that answers a finding.


@dataclass(frozen=True)
class Seen:
    name: str
    profile: dict
    rows: int

    def numeric(self, key: str):
        """A statistic of a numeric column, else None."""
        return self.profile.get(key) if self.profile["numeric"] else None

    def category(self, key: str):
        """A statistic of a column with counted values, else None."""
        return self.profile.get(key) if "total" in self.profile else None


def beyond(value, limit):
    """The value where it exceeds the limit."""
    return value if value is not None and value > limit else None


def below(value, limit):
    return value if value is not None and value < limit else None


def many_values(c: Seen):
    unique = c.category("unique")
    return unique if unique is not None and (unique > 0.1 * c.rows or unique > 50) else None


def all_distinct_id(c: Seen):
    return c.profile["unique"] if c.name.lower() in ID_NAMES and c.category("unique") == c.rows else None


def value_range(c: Seen):
    return None if c.numeric("max") is None else beyond(c.profile["max"] - c.profile["min"], 1e6)


def few_integers(c: Seen):
    unique = c.numeric("unique")
    return unique if unique is not None and unique <= FEW_VALUES else None


def skewed(c: Seen):
    skew = c.numeric("skew")
    return skew if skew is not None and abs(skew) > 2 else None


def many_outliers(c: Seen):
    return beyond(c.numeric("outliers"), 0.05 * c.rows) if (c.numeric("count") or 0) >= 2 else None


def on_columns(kind: str, **params):
    return lambda c, numeric: {"kind": kind, "params": {"columns": [c], **params}}


def on_column(kind: str, key: str, **params):
    return lambda c, numeric: {"kind": kind, "params": {key: c, **params}}


def fill(c: str, numeric: bool) -> dict:
    return {"kind": "impute", "params": {"columns": [c], "strategy": "mean" if numeric else "mode"}}


CLIP = on_columns("outliers", method="iqr", factor=1.5)
BALANCE = on_column("rebalance", "target", method="oversample", ratio=1.0)
DROP = on_columns("drop_missing", axis="columns")
UNIQUE = lambda c, numeric: {"kind": "duplicates", "params": {"subset": None, "keep": "first"}}

# Type, severity and priority of each rule. Rules of one group are tried
# column by column; R12 follows its documented intent (see README).
COLUMN_RULES = [
    [("missing_data", "high", 0.9, lambda c: beyond(c.profile["missing"] / c.rows, 0.1), fill)],  # R1
    [("outliers", "medium", 0.7, many_outliers, CLIP)],  # R2
    [
        ("bias_risk", "medium", 0.8, lambda c: beyond(c.category("max_share"), 0.8), BALANCE),  # R3
        ("class_imbalance", "high", 0.8, lambda c: below(c.category("min_share"), 0.05), BALANCE),  # R4
        ("constant_category", "medium", 0.6, lambda c: beyond(c.category("max_share"), 0.99), DROP),  # R5
        ("rare_categories", "low", 0.5, lambda c: beyond(c.category("rare"), 0), on_columns("encode", method="onehot", max_categories=10)),  # R6
        ("high_cardinality", "medium", 0.7, many_values, on_columns("encode", method="frequency_encode")),  # R7
    ],
]
TABLE_RULES = [("duplicates", "medium", 0.6, lambda copies, rows: beyond(copies, 0.01 * rows), UNIQUE)]  # R8
LATER_RULES = [
    [("id_leakage", "high", 0.9, all_distinct_id, DROP)],  # R9
    [("numeric_to_categorical", "low", 0.5, few_integers, on_column("type_convert", "column", type="category"))],  # R10
    [("high_skew", "medium", 0.7, skewed, CLIP)],  # R11
    [("boolean_disguised", "low", 0.5, lambda c: c.numeric("binary") or None, on_column("type_convert", "column", type="bool"))],  # R12
    [("wide_numeric_range", "medium", 0.6, value_range, on_columns("scale", method="standard"))],  # R13
]
ACTIONS = {rule[0]: rule[-1] for group in [*COLUMN_RULES, TABLE_RULES, *LATER_RULES] for rule in group}


def analyze_dataset(df: DataFrame, as_list: bool = False):
    """Findings by priority; within a priority in the order of the rules."""
    prof = profile_for_rules(df)
    rows = prof["rows"]
    found = []

    def by_column(groups):
        for group in groups:
            for seen in (Seen(c, prof["cols"][c], rows) for c in df.columns):
                for kind, severity, priority, test, _ in group:
                    if (value := test(seen)) is not None:
                        found.append((kind, seen.name, severity, priority, None if value is True else float(value)))

    if rows:
        by_column(COLUMN_RULES)
        for kind, severity, priority, test, _ in TABLE_RULES:
            if (value := test(prof["duplicates"], rows)) is not None:
                found.append((kind, None, severity, priority, float(value)))
        by_column(LATER_RULES)
    ranked = [(i, *r) for i, r in enumerate(sorted(found, key=lambda r: -r[3]))]
    if as_list:
        return [dict(zip(["rank", "type", "column", "severity", "priority", "value"], r)) for r in ranked]
    return df.sparkSession.createDataFrame(ranked, SCHEMA)


def steps_for(recs: list[dict], df: DataFrame) -> list[dict]:
    """The step that answers each finding."""
    nums = {f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)}
    return [ACTIONS[r["type"]](r["column"], r["column"] in nums) for r in recs if r["type"] in ACTIONS]


PRIORITY_BANDS = {"all": (0.0, 1.0), "high": (0.8, 1.0), "medium": (0.6, 0.8), "low": (0.0, 0.6)}


def filter_priority(recs: list[dict], band: str) -> list[dict]:
    """Inclusive on both ends, as the reference."""
    lo, hi = PRIORITY_BANDS[band]
    return [r for r in recs if lo <= r["priority"] <= hi]


# Limits of the feature suggestions.
SKEW_LOG, SKEW_SQRT, WIDEST, LONG_TEXT, SUGGESTED = 1.0, 0.5, 5, 10, 8
PRIORITIES = ("high", "medium", "low")


def _skewed(prof: dict, above: float, most: float) -> list[list[str]]:
    skews = {c: prof["stats"][c].get("skewness") for c in prof["numeric_cols"]}
    return [[c] for c, s in skews.items() if s is not None and above < s <= most]


def _widest(prof: dict) -> list[list[str]]:
    spread = {c: prof["stats"][c].get("variance") for c in prof["numeric_cols"]}
    widest = sorted((c for c, v in spread.items() if v), key=lambda c: -spread[c])[:WIDEST]
    return [widest] if len(widest) > 1 else []


@dataclass(frozen=True)
class FeatureRule:
    """A suggested feature: ``finding`` gives the column groups of a profile that it fits, ``name`` is filled with the first column."""

    name: str
    kind: str
    priority: str
    finding: Callable[[dict], list[list[str]]]


FEATURE_RULES = (
    FeatureRule("log_{}", "log", "high", lambda p: _skewed(p, SKEW_LOG, math.inf)),
    FeatureRule("{}_parts", "extract_datetime_features", "high", lambda p: [[c] for c in p["datetime_cols"]]),
    FeatureRule("drop_correlated", "select_features_correlation", "high", lambda p: [[]] if p.get("high_correlations") else []),
    FeatureRule("sqrt_{}", "sqrt", "medium", lambda p: _skewed(p, SKEW_SQRT, SKEW_LOG)),
    FeatureRule("freq_{}", "frequency_encode", "medium", lambda p: [[c] for c in p["high_cardinality_cols"]]),
    FeatureRule("polynomial", "create_polynomial_features", "medium", _widest),
    FeatureRule("text_{}", "text_features", "medium", lambda p: [[c] for c in p["text_cols"] if (p["stats"][c].get("avg_length") or 0) > LONG_TEXT]),
)


def smart_feature_rules(df: DataFrame) -> list[dict]:
    """Feature suggestions from the A10 profile, the first by priority."""
    from tamis.operators.profile import analyze_dataset_advanced

    prof = analyze_dataset_advanced(df, as_dict=True)
    found = [
        {"feature": rule.name.format(*columns[:1]), "kind": rule.kind, "columns": columns, "priority": rule.priority}
        for rule in sorted(FEATURE_RULES, key=lambda r: PRIORITIES.index(r.priority))
        for columns in rule.finding(prof)
    ]
    return found[:SUGGESTED]
