"""T5 ``unit_convert``, T10 ``scale`` and T13 ``skewness_transform``."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamis.operators.base import FittedStep, Step, StepError, clamp, col, one_row, register_step, replace_columns


@register_step("unit_convert")
class UnitConvert(Step):
    required = ("column", "factor")

    def check_params(self):
        f = self.params["factor"]
        if not isinstance(f, (int, float)) or math.isnan(f) or math.isinf(f):
            raise StepError("unit_convert: invalid conversion factor")

    def fit(self, df):
        p = self.params
        c, f = p["column"], clamp(float(p["factor"]), -1e6, 1e6)
        return FittedStep(self.kind, p, {"factor": f}, lambda d: replace_columns(d, {c: col(c) * F.lit(f)}))


@register_step("scale")
class Scale(Step):
    """standard: (x-mean)/population std; minmax: (x-min)/range; robust: (x-median)/IQR.

    A zero spread is treated as 1, so constant columns become 0.
    """

    required = ("columns", "method")

    def check_params(self):
        if self.params["method"] not in ("standard", "minmax", "robust"):
            raise StepError(f"scale: invalid method {self.params['method']!r}")

    def fit(self, df: DataFrame) -> FittedStep:
        p = self.params
        cols, m = list(p["columns"]), p["method"]
        aggs = []
        for i, c in enumerate(cols):
            x = col(c).cast("double")
            if m == "standard":
                aggs += [F.avg(x).alias(f"a{i}"), F.stddev_pop(x).alias(f"b{i}")]
            elif m == "minmax":
                aggs += [F.min(x).alias(f"a{i}"), (F.max(x) - F.min(x)).alias(f"b{i}")]
        row = one_row(df, *aggs).asDict() if aggs else {}
        if m == "robust":
            from tamis.functions.stats import quantiles

            qs = quantiles(df, cols, [0.25, 0.5, 0.75], p.get("quantile_method"))
        params = {}
        for i, c in enumerate(cols):
            if m == "robust":
                q = qs[c]
                a, b = (q[1], q[2] - q[0]) if q[0] is not None else (None, None)
            else:
                a, b = row[f"a{i}"], row[f"b{i}"]
            if b is None or b == 0 or (isinstance(b, float) and math.isnan(b)):
                b = 1.0
            params[c] = (a, b)
        keep = bool(p.get("keep_original", False))
        exprs = {}
        for c, (a, b) in params.items():
            e = (col(c).cast("double") - F.lit(a)) / F.lit(b)
            exprs[f"{c}_scaled" if keep else c] = e
        return FittedStep(self.kind, p, {"center_scale": params}, lambda d: replace_columns(d, exprs))


BOXCOX_LIMIT = 64.0
BOXCOX_STEPS = 20


def boxcox_lambda(df: DataFrame, c: str, shift: float) -> float | None:
    """Maximum-likelihood Box-Cox lambda, to some 1e-9; None where the likelihood has no maximum.

    Each level is one aggregation that gives, for every lambda of a grid, the population
    variance of the transformed values; the log-likelihood is
    (lambda - 1) * sum(ln x) - n / 2 * ln(var). The bracket [-2, 2] grows until the best lambda
    is inside, then shrinks around it.
    """
    x = col(c).cast("double") + F.lit(shift)
    lx = F.ln(x)
    rows = df.where(col(c).isNotNull())
    scale = one_row(rows, F.avg(lx)).asDict().popitem()[1] or 0.0

    def best(lo, hi):
        grid = np.linspace(lo, hi, BOXCOX_STEPS + 1)
        # x / geometric mean keeps the powers in range; the maximum stays where it is
        z = lx - F.lit(scale)
        powers = [z if abs(lam) < 1e-12 else (F.exp(F.lit(float(lam)) * z) - 1) / F.lit(float(lam)) for lam in grid]
        row = one_row(rows, F.count(x).alias("n"), *[F.var_pop(y).alias(f"v{j}") for j, y in enumerate(powers)])
        scores = [-np.inf if not (v := row[f"v{j}"]) or not math.isfinite(v) else -math.log(v) for j in range(len(grid))]
        return None if max(scores) == -np.inf else grid[int(np.argmax(scores))]

    lo, hi = -2.0, 2.0
    while (lam := best(lo, hi)) is not None and (lam in (lo, hi)) and hi < BOXCOX_LIMIT:
        lo, hi = 2 * lo, 2 * hi
    width = hi - lo
    while lam is not None and width > 1e-8:
        width *= 2 / BOXCOX_STEPS
        lam = best(lam - width / 2 * 1.5, lam + width / 2 * 1.5)
        width *= 1.5
    return None if lam is None else float(lam)


@register_step("skewness_transform")
class SkewnessTransform(Step):
    required = ("columns", "method")

    def fit(self, df: DataFrame) -> FittedStep:
        p = self.params
        m = p["method"] if p["method"] in ("log", "sqrt", "boxcox") else "log"
        exprs, state = {}, {}
        mins = one_row(df, *[F.min(col(c)).alias(c) for c in p["columns"]]).asDict() if m == "boxcox" else {}
        for c in p["columns"]:
            x = col(c).cast("double")
            if m == "log":
                exprs[c] = F.when(x.isNotNull(), F.log1p(F.greatest(x, F.lit(0.0))))
            elif m == "sqrt":
                exprs[c] = F.when(x.isNotNull(), F.sqrt(F.greatest(x, F.lit(0.0))))
            else:
                mn = mins[c]
                if mn is None:
                    continue
                shift = abs(float(mn)) + 1 if mn <= 0 else 0.0
                lam = boxcox_lambda(df, c, shift)
                if lam is None:  # constant columns have no lambda
                    exprs[c] = F.log1p(F.greatest(x, F.lit(0.0)))
                    state[c] = {"fallback": "log"}
                    continue
                xs = x + F.lit(shift)
                exprs[c] = F.ln(xs) if abs(lam) < 1e-12 else (F.pow(xs, F.lit(lam)) - 1) / F.lit(lam)
                state[c] = {"lambda": lam, "shift": shift}
        return FittedStep(self.kind, p, state, lambda d: replace_columns(d, exprs))
