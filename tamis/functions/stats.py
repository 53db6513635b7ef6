"""Quantiles and small driver-side statistics on bounded results."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamis.functions.ordering import exact_quantiles_multi

# How quantiles are computed by steps and profiles:
#   "exact"     — histogram bracketing (default): equal-width bin counts narrow a value
#                 bracket around each wanted rank until it holds at most ``COLLECT_MAX``
#                 rows, whose (value, count) pairs are fetched. Only aggregations;
#   "scan"      — distributed rank selection by an ordered scan over counted values;
#   "aggregate" — Spark's exact ``percentile`` aggregate (fast on small data, but its
#                 final merge keeps every distinct value of the column in one task);
#   "approx"    — ``percentile_approx`` with accuracy 10,000 (one pass, bounded memory).
DEFAULT_METHOD = "exact"


def quantiles(df: DataFrame, cols, probs, method: str | None = None, known: dict | None = None) -> dict:
    """``known``: {column: (non-null count, min, max)} already computed by the caller."""
    method = method or DEFAULT_METHOD
    cols, probs = list(cols), list(probs)
    if not cols:
        return {}
    if method == "exact":
        return bracketed_quantiles(df, cols, probs, known=known)
    if method == "scan":
        return exact_quantiles_multi(df, cols, probs)
    if method == "approx":
        aggs = [F.percentile_approx(F.col(f"`{c}`").cast("double"), probs, 10000).alias(f"q{i}") for i, c in enumerate(cols)]
    else:
        aggs = [F.percentile(F.col(f"`{c}`").cast("double"), probs).alias(f"q{i}") for i, c in enumerate(cols)]
    row = df.agg(*aggs).first()
    return {c: (list(row[f"q{i}"]) if row[f"q{i}"] is not None else [None] * len(probs)) for i, c in enumerate(cols)}


COLLECT_MAX = 20_000
ACCURACY = 1_000


BINS = 1024
# Up to this many non-null values, the single-pass exact ``percentile`` aggregate is used.
SMALL_EXACT_ROWS = 2_000_000


def bracketed_quantiles(df: DataFrame, cols, probs, max_rounds: int = 8, known: dict | None = None) -> dict:
    """Exact linear-interpolated quantiles (pandas "linear") by histogram bracketing.

    For every wanted rank r (0-based among non-null values) we keep a value bracket
    [lo, hi] holding it, with ``below`` = #(x < lo) and ``inside`` = #(lo <= x <= hi).
    A round counts the rows of each bracket in ``BINS`` equal-width bins (one
    aggregation with map-side combine; at most brackets × BINS result rows) and keeps the
    bin that holds r, tightened to that bin's exact min and max. Binning is monotone in
    x, so the bin is exactly the rows within its min/max and the counts stay exact. When
    a bracket has at most ``COLLECT_MAX`` rows, or one value, its (value, count) pairs
    are fetched and the rank is read off. No shuffle of the data, no sketch.
    """
    cols, probs = list(cols), list(probs)
    if not cols:
        return {}
    xs = {c: F.when(~F.isnan(F.col(f"`{c}`").cast("double")), F.col(f"`{c}`").cast("double")) for c in cols}
    if known and all(c in known for c in cols):
        first = {}
        for i, c in enumerate(cols):
            first[f"n{i}"], first[f"lo{i}"], first[f"hi{i}"] = known[c]
    else:
        first = df.agg(
            *[F.count(xs[c]).alias(f"n{i}") for i, c in enumerate(cols)],
            *[F.min(xs[c]).alias(f"lo{i}") for i, c in enumerate(cols)],
            *[F.max(xs[c]).alias(f"hi{i}") for i, c in enumerate(cols)],
        ).first()
    n = {c: first[f"n{i}"] for i, c in enumerate(cols)}
    if max(n.values()) <= SMALL_EXACT_ROWS:
        # proven bound: Spark's exact percentile keeps at most this many values per group
        row = df.agg(*[F.percentile(xs[c], probs).alias(f"q{i}") for i, c in enumerate(cols)]).first()
        return {c: (list(row[f"q{i}"]) if row[f"q{i}"] is not None else [None] * len(probs)) for i, c in enumerate(cols)}
    # target -> [lo, hi, below, inside, value]
    t: dict = {}
    for i, c in enumerate(cols):
        if not n[c]:
            continue
        for p in probs:
            for r in (int(math.floor(p * (n[c] - 1))), int(math.ceil(p * (n[c] - 1)))):
                lo, hi = first[f"lo{i}"], first[f"hi{i}"]
                t[(c, r)] = [lo, hi, 0, n[c], lo if lo == hi else None]
    for _ in range(max_rounds):
        active = [k for k, v in t.items() if v[4] is None and v[3] > COLLECT_MAX]
        if not active:
            break
        groups: dict = {}
        for k in active:
            groups.setdefault((k[0], t[k][0], t[k][1]), []).append(k)
        keys = list(groups)
        parts = []
        for g, (c, lo, hi) in enumerate(keys):
            x = xs[c]
            b = F.least(F.floor((x - F.lit(lo)) / F.lit(hi - lo) * BINS).cast("int"), F.lit(BINS - 1))
            parts.append(F.when((x >= lo) & (x <= hi), F.struct(F.lit(g).alias("g"), b.alias("b"), x.alias("x"))))
        cells = df.select(F.explode(F.filter(F.array(*parts), lambda e: e.isNotNull())).alias("e")).select("e.*")
        hist = cells.groupBy("g", "b").agg(F.count(F.lit(1)).alias("c"), F.min("x").alias("mn"), F.max("x").alias("mx")).collect()
        by_group: dict = {}
        for row in hist:
            by_group.setdefault(row["g"], []).append((row["b"], row["c"], row["mn"], row["mx"]))
        for g, gk in enumerate(keys):
            bins = sorted(by_group.get(g, []))
            for k in groups[gk]:
                acc = t[k][2]
                for _, cnt, mn, mx in bins:
                    if acc <= k[1] < acc + cnt:
                        t[k][0:4] = [mn, mx, acc, cnt]
                        if mn == mx:
                            t[k][4] = mn
                        break
                    acc += cnt
    pending = [k for k, v in t.items() if v[4] is None]
    if pending:
        if any(t[k][3] > COLLECT_MAX for k in pending):
            from tamis.functions.ordering import exact_quantiles_multi

            return exact_quantiles_multi(df, cols, probs)
        groups = {}
        for k in pending:
            groups.setdefault((k[0], t[k][0], t[k][1]), []).append(k)
        keys = list(groups)
        parts = []
        for g, (c, lo, hi) in enumerate(keys):
            x = xs[c]
            parts.append(F.when((x >= lo) & (x <= hi), F.struct(F.lit(g).alias("g"), x.alias("v"))))
        cells = df.select(F.explode(F.filter(F.array(*parts), lambda e: e.isNotNull())).alias("e")).select("e.g", "e.v")
        rows = cells.groupBy("g", "v").agg(F.count(F.lit(1)).alias("c")).collect()
        buckets: dict = {}
        for row in rows:
            buckets.setdefault(row["g"], []).append((row["v"], row["c"]))
        for g, gk in enumerate(keys):
            vals = sorted(buckets.get(g, []))
            for k in groups[gk]:
                acc = t[k][2]
                for v, cnt in vals:
                    if acc <= k[1] < acc + cnt:
                        t[k][4] = v
                        break
                    acc += cnt
    out = {}
    for c in cols:
        if not n[c]:
            out[c] = [None for _ in probs]
            continue
        vals = []
        for p in probs:
            h = p * (n[c] - 1)
            lo, hi = int(math.floor(h)), int(math.ceil(h))
            a, b = t[(c, lo)][4], t[(c, hi)][4]
            vals.append(a + (h - lo) * (b - a))
        out[c] = vals
    return out


def student_t_sf(t: float, dof: int) -> float:
    """Two-sided p-value of a t statistic (regularised incomplete beta, continued fraction)."""
    if dof <= 0 or math.isnan(t):
        return float("nan")
    x = dof / (dof + t * t)
    return _betainc(dof / 2.0, 0.5, x)


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def _betainc(a: float, b: float, x: float) -> float:
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    lbeta = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
    front = math.exp(math.log(x) * a + math.log(1 - x) * b + lbeta)
    if x < (a + 1) / (a + b + 2):
        return front * _betacf(a, b, x) / a
    return 1 - front * _betacf(b, a, 1 - x) / b


def _betacf(a, b, x, iters=300, eps=1e-15):
    qab, qap, qam = a + b, a + 1, a - 1
    c, d = 1.0, 1 - qab * x / qap
    d = 1 / (d if abs(d) > 1e-300 else 1e-300)
    h = d
    for m in range(1, iters + 1):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1 + aa * d
        d = 1 / (d if abs(d) > 1e-300 else 1e-300)
        c = 1 + aa / c if abs(1 + aa / c) > 1e-300 else 1e-300
        h *= d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1 + aa * d
        d = 1 / (d if abs(d) > 1e-300 else 1e-300)
        c = 1 + aa / c if abs(1 + aa / c) > 1e-300 else 1e-300
        delta = d * c
        h *= delta
        if abs(delta - 1) < eps:
            break
    return h
