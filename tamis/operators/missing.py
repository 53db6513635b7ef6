"""T1 ``impute`` and T2 ``drop_missing``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, IntegralType

from tamis.functions.exprs import is_missing
from tamis.functions.neighbours import Search
from tamis.functions.ordering import FillKernel, ordered_scan
from tamis.operators.base import (
    FittedStep,
    Step,
    StepError,
    clamp,
    col,
    is_numeric,
    numeric_columns,
    one_row,
    register_step,
    replace_columns,
)
from tamis.session import reliable_checkpoint

STRATEGIES = ("mean", "median", "mode", "constant", "ffill", "bfill", "knn", "random_forest")


def parse_constant(v):
    """The UI rule: "3" is an int, "3.5" a float, anything else stays text."""
    if not isinstance(v, str):
        return v
    try:
        return int(v)
    except ValueError:
        try:
            return float(v)
        except ValueError:
            return v


@register_step("impute")
class Impute(Step):
    required = ("columns", "strategy")

    def check_params(self):
        s = self.params["strategy"]
        self.rowwise = s not in ("ffill", "bfill", "knn")
        if s not in STRATEGIES:
            raise StepError(f"impute: invalid strategy {s!r}")
        if s in ("ffill", "bfill") and not self.params.get("order_by"):
            raise StepError("impute: ffill/bfill need an explicit 'order_by' (Spark rows have no order)")
        if s == "knn":
            k = self.params.get("n_neighbors", 5)
            if not isinstance(k, int) or k <= 0:
                raise StepError("impute: 'n_neighbors' must be a positive integer")

    def fit(self, df: DataFrame) -> FittedStep:
        p = self.params
        cols, s = list(p["columns"]), p["strategy"]
        if s in ("mean", "median", "mode", "constant"):
            fills = self._fill_values(df, cols, s)
            exprs = {c: filled(df, c, v, s) for c, v in fills.items()}
            return FittedStep(self.kind, p, {"fill": fills}, lambda d: replace_columns(d, exprs))
        if s in ("ffill", "bfill"):
            order_by = _as_list(p["order_by"])
            part = _as_list(p.get("partition_by", []))
            kernel = FillKernel(cols, s)
            return FittedStep(
                self.kind, p, {}, lambda d: ordered_scan(d, kernel, order_by, part, p.get("num_partitions")).select(*d.columns)
            )
        if s == "knn":
            return _fit_knn(df, cols, clamp(int(p.get("n_neighbors", 5)), 1, 50), p)
        return _fit_random_forest(df, cols, clamp(int(p.get("n_estimators", 100)), 1, 200), p)

    def _fill_values(self, df, cols, s):
        if s == "constant":
            v = parse_constant(self.params.get("constant_value"))
            return {c: v for c in cols}
        if s == "median":
            from tamis.functions.stats import quantiles

            q = quantiles(df, cols, [0.5], self.params.get("quantile_method"))
            return {c: q[c][0] for c in cols}
        means = [c for c in cols if s == "mean" or is_numeric(df, c)]
        row = one_row(df, *[F.avg(col(c)).alias(f"v{i}") for i, c in enumerate(means)]) if means else []
        mean = dict(zip(means, row, strict=True))
        if s == "mean":
            return mean
        return {c: most_frequent(df, c, mean.get(c)) for c in cols}


def most_frequent(df, c, otherwise):
    """The mode, the smallest on ties; counted by value, so no task holds a whole column's values."""
    counts = df.where(col(c).isNotNull()).groupBy(col(c).alias("v")).count()
    top = counts.orderBy(F.desc("count"), "v").limit(1).collect()
    return top[0]["v"] if top else otherwise


def filled(df, c, value, strategy):
    """The column with its gaps filled. Whole-number columns become double where the value isn't whole by nature."""
    kind = df.schema[c].dataType
    if value is None:
        return col(c)
    if not is_numeric(df, c):
        return F.coalesce(col(c), F.lit(value).try_cast(kind))
    if isinstance(value, str):
        raise StepError(f"impute: {value!r} doesn't fit the numeric column {c!r}")
    whole = not isinstance(value, float) or value.is_integer()
    if strategy in ("mean", "median") or not whole and isinstance(kind, (IntegralType, DecimalType)):
        return F.coalesce(col(c).cast("double"), F.lit(float(value)))
    return F.coalesce(col(c), F.lit(value).try_cast(kind))


def _as_list(v):
    if v is None:
        return []
    return [v] if isinstance(v, str) else list(v)


KNN_BLOCK = 32_768  # rows to fill, and donors, that are compared in one task at a time


def _fit_knn(df: DataFrame, cols, k, p) -> FittedStep:
    """Mean of the k nearest donors by NaN-aware Euclidean distance over all numeric columns.

    Donors are the fitted rows with the column present, at any number; of equal ones only the
    first k can be among the nearest, so the others leave before the search (see
    ``functions/neighbours.py``). Ties go to the smaller donor number.
    Only the requested columns are filled. Integer columns become double.
    """
    feats = numeric_columns(df)
    targets = [c for c in cols if c in feats]
    if not targets or len(feats) < 2:
        return FittedStep("impute", p, {"skipped": True}, None)
    point = F.array(*[col(c).cast("double") for c in feats])
    donors = df.select(F.monotonically_increasing_id().alias("donor"), point.alias("x"))
    equal = Window.partitionBy("x").orderBy("donor")
    donors = reliable_checkpoint(donors.withColumn("n", F.row_number().over(equal)).where(F.col("n") <= k).drop("n"))

    def transform(d: DataFrame) -> DataFrame:
        held = reliable_checkpoint(d.withColumn("__row", F.monotonically_increasing_id()))
        out = held
        for n, t in enumerate(targets):
            search = Search(donors, feats.index(t), k, KNN_BLOCK)
            values = search.mean(held.where(col(t).isNull()).select("__row", point.alias("x")), reliable_checkpoint)
            out = out.join(values.withColumnsRenamed({"__row": f"__r{n}", "value": f"__v{n}"}), F.col("__row") == F.col(f"__r{n}"), "left")
        new = {t: F.coalesce(col(t).cast("double"), F.col(f"__v{n}")).alias(t) for n, t in enumerate(targets)}
        return out.select(*[new.get(c, col(c)) for c in d.columns])

    return FittedStep("impute", p, {"features": feats}, transform)


def _fit_random_forest(df: DataFrame, cols, trees, p) -> FittedStep:
    """Regress each column on the other numeric columns (median-filled) with Spark ML."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    from tamis.functions.stats import quantiles

    nums = numeric_columns(df)
    targets = [t for t in cols if t in nums and len(nums) > 1]
    medians = {c: q[0] or 0.0 for c, q in quantiles(df, nums, [0.5]).items()} if targets else {}
    models = {}
    for t in targets:
        others = [c for c in nums if c != t]
        inputs = [F.coalesce(col(c).cast("double"), F.lit(medians[c])).alias(f"__f_{c}") for c in others]
        train = df.where(col(t).isNotNull()).select(col(t).cast("double").alias("__label"), *inputs)
        va = VectorAssembler(inputCols=[f"__f_{c}" for c in others], outputCol="__x")
        rf = RandomForestRegressor(featuresCol="__x", labelCol="__label", numTrees=trees, seed=42)
        models[t] = (inputs, va, rf.fit(va.transform(train)))

    def transform(d: DataFrame) -> DataFrame:
        out = d
        for t, (inputs, va, model) in models.items():
            scored = model.transform(va.transform(out.select("*", *inputs)))
            value = F.coalesce(col(t).cast("double"), F.col("prediction")).alias(t)
            out = scored.select(*[value if c == t else col(c) for c in d.columns])
        return out

    return FittedStep("impute", p, {"models": list(models)}, transform)


@register_step("drop_missing")
class DropMissing(Step):
    required = ("axis",)

    def check_params(self):
        if self.params["axis"] not in ("rows", "columns"):
            raise StepError("drop_missing: axis must be 'rows' or 'columns'")

    def input_columns(self):
        return list(self.params.get("columns") or [])

    def fit(self, df: DataFrame) -> FittedStep:
        p = self.params
        cols = p.get("columns")
        thr = clamp(float(p.get("threshold", 0.5)), 0.0, 1.0)
        if p["axis"] == "rows":
            if cols:
                return FittedStep(self.kind, p, {}, lambda d: d.dropna("any", subset=list(cols)))
            if p.get("by_ratio"):
                # drop rows whose share of missing cells exceeds the threshold
                def by_ratio(d):
                    flags = [is_missing(d, c).cast("int") for c in d.columns]
                    share = sum(flags[1:], flags[0]) / F.lit(len(flags))
                    return d.where(share <= thr)

                return FittedStep(self.kind, p, {}, by_ratio)
            return FittedStep(self.kind, p, {}, lambda d: d.dropna("any"))
        if cols:
            return FittedStep(self.kind, p, {"dropped": list(cols)}, lambda d: d.drop(*cols))
        ratios = missing_ratios(df)
        dropped = [c for c, r in ratios.items() if r > thr]
        return FittedStep(self.kind, p, {"dropped": dropped, "ratios": ratios}, lambda d: d.drop(*dropped))


def missing_ratios(df: DataFrame) -> dict[str, float]:
    """Share of NULL (and NaN, for floating columns) per column, in one aggregation."""
    if not df.columns:
        return {}
    row = one_row(df, F.count(F.lit(1)).alias("__n"), *[F.sum(is_missing(df, c).cast("long")).alias(f"c{i}") for i, c in enumerate(df.columns)])
    n = row["__n"] or 0
    return {c: (row[f"c{i}"] / n if n else 0.0) for i, c in enumerate(df.columns)}
