"""T15 ``smooth_time_series`` and T16 ``resample_time_series``."""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from tamis.functions.exprs import bounded_broadcast
from tamis.functions.ordering import (
    FillKernel,
    InterpolateKernel,
    RollingMeanKernel,
    SavgolKernel,
    ordered_scan,
)
from tamis.operators.base import FittedStep, Step, StepError, clamp, col, one_row, register_step
from tamis.operators.dates import parse_timestamp
from tamis.functions.fixed import RESAMPLE_FUNCS


def _as_list(v):
    if v is None:
        return []
    return [v] if isinstance(v, str) else list(v)


def smooth(df: DataFrame, column, order_by, partition_by=(), method="moving_average", window=5, interpolate="none", num_partitions=None):
    """Interpolate (optional) then smooth ``column`` along ``order_by`` (per ``partition_by``)."""
    window = clamp(int(window), 3, 100)
    order_by, partition_by = _as_list(order_by), _as_list(partition_by)
    cols = df.columns
    out = df
    if interpolate in ("ffill", "bfill"):
        out = ordered_scan(out, FillKernel([column], interpolate), order_by, partition_by, num_partitions).select(*cols)
    elif interpolate == "linear":
        out = ordered_scan(out, InterpolateKernel([column]), order_by, partition_by, num_partitions).select(*cols)
    if method == "savitzky_golay":
        w = window if window % 2 else window - 1
        if partition_by:  # gaps take the group's mean
            means = out.groupBy(*[col(c).alias(f"__g{i}") for i, c in enumerate(partition_by)]).agg(F.avg(col(column).cast("double")).alias("__mean"))
            same = [col(c).eqNullSafe(F.col(f"__g{i}")) for i, c in enumerate(partition_by)]
            joined = out.join(bounded_broadcast(means), same, "left")
            out = joined.select(*[F.coalesce(col(c).cast("double"), F.col("__mean")).alias(c) if c == column else col(c) for c in cols])
            kernel = SavgolKernel(column, w, min(3, w - 1), None)
        else:
            mean = one_row(out, F.avg(col(column).cast("double")).alias("m"))["m"]
            kernel = SavgolKernel(column, w, min(3, w - 1), mean)
    else:
        kernel = RollingMeanKernel(column, window, 1)
    return ordered_scan(out, kernel, order_by, partition_by, num_partitions).select(*cols)


@register_step("smooth_time_series")
class SmoothTimeSeries(Step):
    required = ("column", "method")
    rowwise = False

    def check_params(self):
        if not self.params.get("order_by"):
            raise StepError("smooth_time_series: needs an explicit 'order_by'")

    def fit(self, df):
        p = self.params
        method = p["method"] if p["method"] in ("moving_average", "savitzky_golay") else "moving_average"
        interp = p.get("interpolate", "none")
        interp = interp if interp in ("none", "linear", "ffill", "bfill") else "none"
        return FittedStep(
            self.kind,
            p,
            {},
            lambda d: smooth(d, p["column"], p["order_by"], p.get("partition_by", ()), method, p.get("window", 5), interp, p.get("num_partitions")),
        )


# ---- resampling ----------------------------------------------------------------------------

_UNITS = {
    "d": 86400, "day": 86400, "days": 86400,
    "h": 3600, "hour": 3600, "hours": 3600,
    "t": 60, "min": 60, "minute": 60, "minutes": 60,
    "s": 1, "sec": 1, "second": 1, "seconds": 1,
    "w": 7 * 86400,
}


def parse_freq(freq: str):
    """('seconds', n) for fixed durations, ('months', n) for month starts; else 1 day."""
    f = str(freq).strip()
    m = re.fullmatch(r"(\d*)\s*([A-Za-z]+)", f)
    if m:
        n = int(m.group(1) or 1)
        u = m.group(2)
        if u in ("MS", "M", "ME"):
            return ("months", n)
        if u.lower() in _UNITS and n > 0:
            return ("seconds", n * _UNITS[u.lower()])
    return ("seconds", 86400)


def resample(df: DataFrame, time_column: str, freq: str, agg_func="mean", fill_empty=True) -> DataFrame:
    """Bucket rows by time and aggregate every numeric column with one function.

    Buckets are aligned to midnight of the first day (pandas' default origin). Empty
    buckets between the first and last one are emitted (NULL, or 0 for sum/count); the
    bucket list comes from ``spark.range`` so it is generated in parallel.
    """
    func = agg_func if agg_func in RESAMPLE_FUNCS + ["first", "last"] else "mean"
    kind, n = parse_freq(freq)
    ts = parse_timestamp(df, time_column).cast("timestamp_ntz")
    base = df.select(ts.alias("__t"), *[col(f.name) for f in df.schema.fields if isinstance(f.dataType, NumericType) and f.name != time_column])
    base = base.where(F.col("__t").isNotNull())
    values = [c for c in base.columns if c != "__t"]
    bounds = base.agg(F.min("__t").alias("lo"), F.max("__t").alias("hi")).first()
    spark = df.sparkSession
    if bounds["lo"] is None:
        return spark.createDataFrame([], base.select(F.col("__t").alias(time_column), *[col(c) for c in values]).schema)
    origin = datetime(bounds["lo"].year, bounds["lo"].month, bounds["lo"].day)
    origin_lit = F.lit(origin.isoformat(" ")).cast("timestamp_ntz")  # no time-zone shift; four digits of year
    if kind == "months":
        months = (F.year("__t") - origin.year) * 12 + (F.month("__t") - origin.month)
        idx = F.floor(months / n).cast("long")
    else:
        secs = F.timestamp_diff("SECOND", origin_lit, F.col("__t"))
        idx = F.floor(secs / n).cast("long")
    keyed = base.withColumn("__b", idx)
    aggs = []
    for c in values:
        x = col(c)
        e = {
            "mean": F.avg(x), "sum": F.sum(x), "min": F.min(x), "max": F.max(x), "count": F.count(x),
            "std": F.stddev_samp(x), "first": F.min_by(x, "__t"), "last": F.max_by(x, "__t"),
        }[func]
        aggs.append(e.alias(c))
    grouped = keyed.groupBy("__b").agg(*aggs)
    if fill_empty:
        last = keyed.agg(F.max("__b")).first()[0]
        buckets = spark.range(0, last + 1).withColumnRenamed("id", "__b")
        grouped = buckets.join(grouped, "__b", "left")
        if func in ("sum", "count"):
            grouped = grouped.fillna(0, subset=values)
    if kind == "months":
        start = F.make_timestamp_ntz(F.lit(origin.year), F.lit(origin.month), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
        t_expr = F.add_months(start, (F.col("__b") * n).cast("int")).cast("timestamp_ntz")
    else:
        t_expr = F.timestamp_add("SECOND", F.col("__b") * n, origin_lit)
    return grouped.select(t_expr.alias(time_column), *[col(c) for c in values])


@register_step("resample_time_series")
class ResampleTimeSeries(Step):
    required = ("time_column", "freq", "agg_func")
    rowwise = False

    def fit(self, df):
        p = self.params
        return FittedStep(self.kind, p, {}, lambda d: resample(d, p["time_column"], p["freq"], p["agg_func"]))
