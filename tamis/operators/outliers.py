"""T7 ``outliers``: IQR clipping or z-score replacement, one aggregation for all columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from tamis.functions.exprs import clip
from tamis.functions.stats import quantiles
from tamis.operators.base import FittedStep, Step, StepError, clamp, col, one_row, register_step, replace_columns


@register_step("outliers")
class Outliers(Step):
    required = ("columns", "method")

    def check_params(self):
        if self.params["method"] not in ("iqr", "zscore"):
            raise StepError(f"outliers: invalid method {self.params['method']!r}")

    def fit(self, df):
        p = self.params
        cols, k = list(p["columns"]), clamp(float(p.get("factor", 1.5)), 0.1, 10.0)
        exprs, state = {}, {}
        if p["method"] == "iqr":
            qs = quantiles(df, cols, [0.25, 0.75], p.get("quantile_method"))
            for c in cols:
                q = qs[c]
                if q[0] is None:
                    continue
                lo, hi = q[0] - k * (q[1] - q[0]), q[1] + k * (q[1] - q[0])
                exprs[c] = clip(col(c).cast("double"), lo, hi)
                state[c] = (lo, hi)
        else:
            aggs = []
            for i, c in enumerate(cols):
                aggs += [F.avg(col(c)).alias(f"m{i}"), F.stddev_samp(col(c)).alias(f"s{i}")]
            row = one_row(df, *aggs)
            for i, c in enumerate(cols):
                m, s = row[f"m{i}"], row[f"s{i}"]
                if s is None or not s > 0:
                    continue
                x = col(c).cast("double")
                # a missing value fails the test and becomes the mean, as in the reference
                exprs[c] = F.when(F.abs(x - F.lit(m)) <= F.lit(k * s), x).otherwise(F.lit(m))
                state[c] = (m, s)
        return FittedStep(self.kind, p, state, lambda d: replace_columns(d, exprs))
