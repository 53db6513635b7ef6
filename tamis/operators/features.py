"""Feature builders: F1 polynomial, F2 datetime parts, F3 binning, F4 correlation selection,
F6 feature families (numeric, categorical, datetime, text, clustering, PCA) and F5 the
automated builder that plans them from one profile.

Every builder fits with at most a few aggregations over all rows and adds its columns in
one projection (no ``withColumn`` loops).
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import combinations, combinations_with_replacement, islice

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, NumericType, TimestampNTZType, TimestampType

from tamis.functions.exprs import bounded_broadcast
from tamis.functions.fixed import DATETIME_PARTS
from tamis.functions.gram import correlations, pair_sums
from tamis.functions.ordering import average_rank
from tamis.functions.stats import quantiles
from tamis.operators.base import (
    FittedStep,
    Step,
    StepError,
    clamp,
    col,
    is_numeric,
    one_row,
    register_step,
    unique_name,
)
from tamis.operators.dates import parse_timestamp


def _select_with(d: DataFrame, new: dict[str, Column]) -> DataFrame:
    return d.select(*[col(c) for c in d.columns], *[e.alias(n) for n, e in new.items()])


# ---- F1 polynomial -------------------------------------------------------------------------


def polynomial_terms(columns, degree):
    """sklearn's order and names: by degree, then combinations with replacement."""
    terms = []
    for deg in range(2, degree + 1):
        for combo in combinations_with_replacement(range(len(columns)), deg):
            powers = {}
            for i in combo:
                powers[i] = powers.get(i, 0) + 1
            name = " ".join(columns[i] if p == 1 else f"{columns[i]}^{p}" for i, p in sorted(powers.items()))
            terms.append((name, combo))
    return terms


@register_step("create_polynomial_features")
class PolynomialFeatures(Step):
    required = ("columns", "degree")

    def check_params(self):
        if not isinstance(self.params["degree"], int) or self.params["degree"] < 1:
            raise StepError("create_polynomial_features: 'degree' must be a positive integer")

    def fit(self, df):
        p = self.params
        degree = clamp(int(p["degree"]), 1, 5)
        cand = [c for c in p["columns"] if c in df.columns and is_numeric(df, c)]
        if not cand:
            return FittedStep(self.kind, p, {"columns": []})
        row = one_row(df, *[F.var_samp(col(c).cast("double")).alias(f"v{i}") for i, c in enumerate(cand)])
        valid = [c for i, c in enumerate(cand) if row[f"v{i}"] is not None and not math.isnan(row[f"v{i}"]) and row[f"v{i}"] != 0]
        if len(valid) > 10 and degree > 2:
            raise StepError("create_polynomial_features: too many columns for degree > 2")
        if not valid:
            return FittedStep(self.kind, p, {"columns": []})
        med = quantiles(df, valid, [0.5], p.get("quantile_method"))
        filled = [F.coalesce(col(c).cast("double"), F.lit(med[c][0])) for c in valid]
        terms = polynomial_terms(valid, degree)

        def transform(d):
            new = {}
            names = list(d.columns)
            for name, combo in terms:
                e = filled[combo[0]]
                for i in combo[1:]:
                    e = e * filled[i]
                n = unique_name(names, name)
                names.append(n)
                new[n] = e
            return _select_with(d, new)

        return FittedStep(self.kind, p, {"columns": valid, "medians": {c: med[c][0] for c in valid}}, transform,
                          lineage={n: valid for n, _ in terms})


# ---- F2 datetime parts -----------------------------------------------------------------------


def datetime_part(ts: Column, part: str) -> Column:
    return {
        "year": F.year(ts),
        "month": F.month(ts),
        "day": F.dayofmonth(ts),
        "hour": F.hour(ts),
        "minute": F.minute(ts),
        "second": F.second(ts),
        "dayofweek": F.weekday(ts),  # Monday = 0, as pandas
        "quarter": F.quarter(ts),
    }[part]


@register_step("extract_datetime_features")
class DatetimeFeatures(Step):
    required = ("columns", "features")

    def check_params(self):
        if not all(f in DATETIME_PARTS for f in self.params["features"]):
            raise StepError("extract_datetime_features: invalid datetime features")

    def fit(self, df):
        p = self.params
        feats = [f for f in p["features"] if f in DATETIME_PARTS]
        cols = [c for c in p["columns"] if c in df.columns]
        parsed = {c: parse_timestamp(df, c) for c in cols}

        def transform(d):
            names, new = list(d.columns), {}
            for c in cols:
                for f in feats:
                    n = unique_name(names, f"{c}_{f}")
                    names.append(n)
                    new[n] = datetime_part(parsed[c], f)
            return _select_with(d, new)

        return FittedStep(self.kind, p, {}, transform)


# ---- F3 binning ---------------------------------------------------------------------------


def bin_code(x: Column, edges: list[float]) -> Column:
    """pandas ``qcut``/``cut`` codes: intervals (a, b], the lowest edge included."""
    inner = F.array(*[F.lit(float(e)) for e in edges[1:-1]])
    code = F.size(F.filter(inner, lambda e: e < x))
    return F.when(x.isNotNull() & (x >= F.lit(float(edges[0]))) & (x <= F.lit(float(edges[-1]))), code)


def quantile_edges(df, cols, bins, method=None):
    probs = [i / bins for i in range(bins + 1)]
    qs = quantiles(df, cols, probs, method)
    out = {}
    for c in cols:
        if qs[c][0] is None:
            continue
        edges = sorted(set(qs[c]))
        out[c] = edges
    return out


@register_step("bin_features")
class BinFeatures(Step):
    required = ("columns", "bins")

    def check_params(self):
        if not isinstance(self.params["bins"], int) or self.params["bins"] < 2:
            raise StepError("bin_features: 'bins' must be an integer >= 2")

    def fit(self, df):
        p = self.params
        bins = clamp(int(p["bins"]), 2, 50)
        cand = [c for c in p["columns"] if c in df.columns and is_numeric(df, c)]
        row = one_row(df, *[F.min(col(c).cast("double")).alias(f"mn{i}") for i, c in enumerate(cand)],
                      *[F.max(col(c).cast("double")).alias(f"mx{i}") for i, c in enumerate(cand)]) if cand else None
        # at least two distinct values <=> min < max (no distinct count needed)
        valid = [c for i, c in enumerate(cand) if row[f"mn{i}"] is not None and row[f"mn{i}"] < row[f"mx{i}"]]
        edges = quantile_edges(df, valid, bins, p.get("quantile_method"))
        for i, c in enumerate(cand):
            if c in valid and len(edges.get(c, [])) < 2:
                mn, mx = row[f"mn{i}"], row[f"mx{i}"]
                e = list(np.linspace(mn, mx, bins + 1))
                e[0] = mn - (mx - mn) * 0.001
                edges[c] = e

        def transform(d):
            names, new = list(d.columns), {}
            for c in valid:
                n = unique_name(names, f"{c}_binned")
                names.append(n)
                new[n] = bin_code(col(c).cast("double"), edges[c])
            return _select_with(d, new)

        return FittedStep(self.kind, p, {"edges": edges}, transform)


# ---- F4 correlation selection ------------------------------------------------------------


def variances(df, cols):
    if not cols:
        return {}
    row = one_row(df, *[F.var_samp(col(c).cast("double")).alias(f"v{i}") for i, c in enumerate(cols)])
    return {c: row[f"v{i}"] for i, c in enumerate(cols)}


def pearson_pairs(df, cols) -> dict:
    """Pairwise-complete Pearson r and n for every pair of ``cols``: column means, then one pass for all pairs."""
    cols = list(cols)
    return {(cols[i], cols[j]): found for (i, j), found in correlations(df, [col(c) for c in cols]).items()}


def correlated_to_drop(cols, corr: dict, threshold: float) -> list[str]:
    drop = []
    for j, b in enumerate(cols):
        for a in cols[:j]:
            r = corr.get((a, b), (None, 0))[0]
            if r is not None and abs(r) > threshold:
                drop.append(b)
                break
    return drop


@register_step("select_features_correlation")
class SelectFeaturesCorrelation(Step):
    required = ("threshold",)

    def check_params(self):
        t = self.params["threshold"]
        if not isinstance(t, (int, float)):
            raise StepError("select_features_correlation: 'threshold' must be a number")

    def fit(self, df):
        p = self.params
        thr = clamp(float(p["threshold"]), 0.1, 0.99)
        nums = [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]
        var = variances(df, nums)
        valid = [c for c in nums if var[c] is not None and not math.isnan(var[c]) and var[c] > 1e-10]
        if len(valid) < 2:
            return FittedStep(self.kind, p, {"dropped": []})
        drop = correlated_to_drop(valid, pearson_pairs(df, valid), thr)
        if len(drop) == len(df.columns):
            raise StepError("select_features_correlation: cannot drop all columns")
        return FittedStep(self.kind, p, {"dropped": drop}, lambda d: d.drop(*drop))


# ---- F6 families -----------------------------------------------------------------------------
#
# A family is a generator of offers: tuples of features that are only added together, in
# order of preference. ``choose`` takes the offers that fit into a family's budget. How many
# columns a family looks at are parameters; their defaults are fixed values.

FAMILY_COLUMNS = {"numeric": 5, "zscore": 3, "categorical": 5, "datetime": 3, "text": 2}
MAX_INTERACTIONS = 20
TOP_VALUES = 3
INTERACTION_RANGE = (0.3, 0.8)
MIN_VARIANCE = 1e-6


@dataclass(frozen=True)
class Feature:
    """A column to add. ``value`` maps the frame that holds the lookups' columns to an expression."""

    name: str
    value: Column
    lookup: Lookup | None = None


@dataclass(frozen=True)
class Lookup:
    """Values by key of one column, joined to the rows: ``table`` has __k and the prefixed value columns."""

    column: str
    table: DataFrame
    prefix: str


def choose(offers, budget: int, taken) -> list[Feature]:
    """The offers that fit into the budget, in order, under names that aren't taken."""
    out: list[Feature] = []
    used = list(taken)
    for offer in offers:
        if len(out) + len(offer) <= budget:
            for f in offer:
                name = unique_name(used, f.name)
                used.append(name)
                out.append(Feature(name, f.value, f.lookup))
        if len(out) == budget:
            break
    return out


def add_features(df: DataFrame, features: list[Feature]) -> DataFrame:
    """One projection over the rows joined with the features' lookups (broadcast if their size allows it)."""
    joined = df
    for look in {f.lookup.prefix: f.lookup for f in features if f.lookup}.values():
        key = f"{look.prefix}k"
        joined = joined.join(bounded_broadcast(look.table.withColumnRenamed("__k", key)), col(look.column) == col(key), "left")
    return joined.select(*[col(c) for c in df.columns], *[f.value.alias(f.name) for f in features])


def safe_denominator(x: Column) -> Column:
    """|x| ≤ 1e-6 lifted to ±1e-6 (0 stays 0, as sign(0) = 0)."""
    return F.when(F.abs(x) > 1e-6, x).otherwise(F.lit(1e-6) * F.signum(x))


def spread_columns(profile: dict) -> list[str]:
    """Numeric columns that vary."""
    return [c for c in profile["numeric_cols"] if (profile["stats"][c].get("variance") or 0) > MIN_VARIANCE]


def shape_offers(column: str, skewness: float):
    """F6a–c: a transform against right skew, then the reciprocal."""
    x = col(column).cast("double")
    floor = F.greatest(x, F.lit(0.0))
    if skewness > 1:
        yield (Feature(f"log_{column}", F.log1p(floor)),)
    elif skewness > 0.5:
        yield (Feature(f"sqrt_{column}", F.sqrt(floor)),)
    yield (Feature(f"reciprocal_{column}", F.try_divide(F.lit(1.0), safe_denominator(x))),)


def interaction_offers(columns: list[str], correlations: dict):
    """F6e: product and ratio of moderately correlated pairs."""
    low, high = INTERACTION_RANGE
    for a, b in combinations(columns, 2):
        r = correlations.get((a, b), (None, 0))[0]
        if r is not None and low <= abs(r) <= high:
            x, y = col(a).cast("double"), col(b).cast("double")
            yield (Feature(f"{a}_x_{b}", x * y),)
            yield (Feature(f"{a}_div_{b}", F.try_divide(x, safe_denominator(y))),)


def numeric_offers(df: DataFrame, profile: dict):
    """F6a–e: shape, z-scores, products and ratios of columns that vary."""
    varied, stats = spread_columns(profile), profile["stats"]
    for c in varied[: FAMILY_COLUMNS["numeric"]]:
        yield from shape_offers(c, stats[c].get("skewness") or 0)
    if len(varied) > 1:
        for c in varied[: FAMILY_COLUMNS["zscore"]]:
            spread = math.sqrt(stats[c]["variance"]) + 1e-8
            yield (Feature(f"zscore_{c}", (col(c).cast("double") - F.lit(stats[c]["mean"])) / F.lit(spread)),)
    yield from islice(interaction_offers(varied, profile.get("correlations", {})), MAX_INTERACTIONS)


def value_frequencies(df: DataFrame, column: str, prefix: str) -> Lookup:
    """Count and average rank of the count (1 = most frequent) of each value, at any number of values."""
    counts = df.groupBy(col(column).alias("__k")).agg(F.count(F.lit(1)).alias("n")).where("__k IS NOT NULL")
    values = counts.count()
    ranked = average_rank(counts, "n", "up").select("__k", col("n").alias(f"{prefix}n"), (F.lit(values + 1.0) - F.col("up")).alias(f"{prefix}r"))
    return Lookup(column, ranked, prefix)


def categorical_offers(df: DataFrame, profile: dict):
    """F6f: frequency, rank of the frequency, indicators of the most frequent of a few values."""
    usable = (c for c in profile["categorical_cols"] if c not in profile["high_cardinality_cols"])
    for n, c in enumerate(islice(usable, FAMILY_COLUMNS["categorical"])):
        look = value_frequencies(df, c, f"__f{n}_")
        yield (Feature(f"freq_{c}", col(f"__f{n}_n"), look),)
        yield (Feature(f"rank_{c}", col(f"__f{n}_r"), look),)
        if TOP_VALUES <= profile["stats"][c]["unique_count"] <= 10:
            top = look.table.orderBy(F.desc(f"__f{n}_n"), F.col("__k").cast("string")).limit(TOP_VALUES).collect()
            for v in (r["__k"] for r in top):
                yield (Feature(f"is_{c}_{str(v)[:10]}", F.coalesce((col(c) == F.lit(v)).cast("int"), F.lit(0))),)


def datetime_offers(df: DataFrame, profile: dict):
    """F6g: parts, weekend and month-end flags, the month on a circle (both or none), epoch seconds."""
    for c in profile["datetime_cols"][: FAMILY_COLUMNS["datetime"]]:
        ts = parse_timestamp(df, c)
        angle = F.lit(2 * math.pi) * F.month(ts) / 12
        values = {f: datetime_part(ts, f) for f in ("year", "month", "day", "dayofweek", "hour", "quarter")}
        values["is_weekend"] = (F.weekday(ts) >= 5).cast("int")
        values["is_month_end"] = (F.to_date(ts) == F.last_day(ts)).cast("int")
        yield from ((Feature(f"{c}_{part}", value),) for part, value in values.items())
        yield Feature(f"{c}_month_sin", F.sin(angle)), Feature(f"{c}_month_cos", F.cos(angle))
        yield (Feature(f"{c}_timestamp", F.unix_seconds(ts.cast("timestamp"))),)


def text_offers(df: DataFrame, profile: dict):
    """F6h: length, word count, digit count, special count, mean word length."""
    for c in profile["text_cols"][: FAMILY_COLUMNS["text"]]:
        s = F.coalesce(col(c).cast("string"), F.lit(""))
        words = F.filter(F.split(F.trim(s), r"\s+"), lambda w: F.char_length(w) > 0)
        letters = F.aggregate(words, F.lit(0).cast("long"), lambda a, w: a + F.char_length(w))
        values = {
            "len": F.char_length(s),
            "word_count": F.size(words),
            "digit_count": F.regexp_count(s, F.lit(r"\d")),
            "special_char_count": F.regexp_count(s, F.lit(r"[^a-zA-Z0-9\s]")),
            "avg_word_length": F.when(F.size(words) > 0, letters / F.size(words)).otherwise(F.lit(0.0)),
        }
        yield from ((Feature(f"{what}_{c}", value),) for what, value in values.items())


def standardized_inputs(df, cols, method=None):
    med = quantiles(df, cols, [0.5], method)
    filled = df.select(*[F.coalesce(col(c).cast("double"), F.lit(med[c][0] if med[c][0] is not None else 0.0)).alias(c) for c in cols])
    row = one_row(filled, *[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)], *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(cols)])
    mean = [row[f"m{i}"] for i in range(len(cols))]
    std = [row[f"s{i}"] or 1.0 for i in range(len(cols))]
    exprs = [
        (F.coalesce(col(c).cast("double"), F.lit(med[c][0] if med[c][0] is not None else 0.0)) - F.lit(mean[i])) / F.lit(std[i] if std[i] else 1.0)
        for i, c in enumerate(cols)
    ]
    return exprs


def clustering_family(df, profile, budget, names, n_rows=None) -> dict[str, Column]:
    """F6i: k-means label and distance to the nearest centre (standardised, median-filled)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    stats = profile["stats"]
    cols = spread_columns(profile)
    if len(cols) < 2 or budget < 1:
        return {}
    n_rows = n_rows or profile["rows"]
    k = min(5, max(2, n_rows // 1000))
    exprs = standardized_inputs(df, cols)
    z = df.select(*[e.alias(f"__z{i}") for i, e in enumerate(exprs)])
    va = VectorAssembler(inputCols=[f"__z{i}" for i in range(len(cols))], outputCol="__v")
    model = KMeans(k=k, seed=42, featuresCol="__v", maxIter=50).fit(va.transform(z))
    centres = [list(map(float, c)) for c in model.clusterCenters()]
    d2 = [sum((exprs[j] - F.lit(cen[j])) * (exprs[j] - F.lit(cen[j])) for j in range(len(cols))) for cen in centres]
    # one distance array; label = position of its minimum (first on ties), distance = sqrt(min)
    dists = F.array(*d2)
    new = {}
    n1 = unique_name(names, "cluster_kmeans")
    names.append(n1)
    new[n1] = (F.array_position(dists, F.array_min(dists)) - 1).cast("int")
    if budget > 1:
        n2 = unique_name(names, "cluster_distance")
        names.append(n2)
        new[n2] = F.sqrt(F.array_min(dists))
    return new


def pca_family(df, profile, budget, names) -> dict[str, Column]:
    """F6j: up to 5 principal components of the standardised numeric columns.

    The covariance matrix is one pass of products of row blocks; the
    eigen-decomposition of that d×d matrix runs on the driver. Signs follow the rule
    "largest loading positive".
    """
    stats = profile["stats"]
    cols = spread_columns(profile)
    if len(cols) < 3:
        return {}
    k = min(budget, len(cols), 5)
    exprs = standardized_inputs(df, cols)
    z = df.select(*[e.alias(f"__z{i}") for i, e in enumerate(exprs)])
    d = len(cols)
    cov = np.zeros((d, d))
    for (i, j), (n, *_, products) in pair_sums(z, [col(c) for c in z.columns], list(combinations_with_replacement(range(d), 2))).items():
        cov[i, j] = cov[j, i] = products / max(n - 1, 1)
    vals, vecs = np.linalg.eigh(cov)
    order = np.argsort(vals)[::-1][:k]
    new = {}
    for rank, idx in enumerate(order):
        v = vecs[:, idx]
        if v[np.argmax(np.abs(v))] < 0:
            v = -v
        n_ = unique_name(names, f"pca_component_{rank + 1}")
        names.append(n_)
        new[n_] = sum(exprs[j] * F.lit(float(v[j])) for j in range(d))
    return new


# ---- F5 automated --------------------------------------------------------------------------


# The share of the budget that each family may use.
FAMILY_SHARES = {numeric_offers: 0.4, categorical_offers: 0.25, datetime_offers: 0.2, text_offers: 0.1}


@register_step("automated_feature_engineering")
class AutomatedFeatures(Step):
    """Plan feature families from one profile, add them in one projection, then prune
    near-constant and highly correlated new features (F6k, F6l) and, with ``target_col``, keep the
    best half of the budget by mutual information and forest importance (F6m)."""

    required = ("max_features",)
    rowwise = False

    def check_columns(self, df):
        super().check_columns(df)
        target = self.params.get("target_col")
        if target is not None and target not in df.columns:
            raise StepError(f"automated_feature_engineering: target column {target!r} not in DataFrame")

    def fit(self, df):
        from tamis.operators.profile import analyze_dataset_advanced

        p = self.params
        budget = clamp(int(p["max_features"]), 5, 500)
        target = p.get("target_col")
        inputs = df.drop(target) if target is not None else df
        prof = analyze_dataset_advanced(inputs, as_dict=True)
        names = list(df.columns)
        new: list[Feature] = []

        def extend(found):
            new.extend(found)
            names.extend(f.name for f in found)

        for offers, share in FAMILY_SHARES.items():
            extend(choose(offers(inputs, prof), int(budget * share), names))
        for family, wanted, most in ((clustering_family, "clustering", 2), (pca_family, "pca", 5)):
            room = min(budget - len(new), most)
            if room > 0 and p.get(wanted, True):
                extend([Feature(n, e) for n, e in family(inputs, prof, room, list(names)).items()])
        if not new:
            return FittedStep(self.kind, p, {"features": []})
        wide = add_features(df, new)
        var = variances(wide, [f.name for f in new])
        keep = [f for f in new if var[f.name] is not None and not math.isnan(var[f.name]) and var[f.name] >= MIN_VARIANCE]
        order = [f.name for f in keep]
        drop = correlated_to_drop(order, pearson_pairs(wide, order), 0.95) if len(order) > 1 else []
        keep = [f for f in keep if f.name not in drop]
        if target is not None and len(keep) > budget // 2:
            best = top_by_importance(wide, target, [f.name for f in keep], budget // 2)
            keep = [f for f in keep if f.name in best]
        return FittedStep(self.kind, p, {"features": [f.name for f in keep]}, lambda d: add_features(d, keep))


def top_by_importance(df: DataFrame, target: str, features: list[str], most: int) -> list[str]:
    """F6m: the features with the largest sum of mutual information and forest importance."""
    from tamis.operators.importance import forest_importance, mutual_information

    score = {c: 0.0 for c in features}
    for table, value in ((mutual_information(df, target, features), "mutual_info"), (forest_importance(df, target, features), "importance")):
        for r in table.collect():
            score[r["feature"]] += r[value] or 0.0
    return sorted(features, key=lambda c: -score[c])[:most]


def skew_candidates(df, cols) -> list:
    """F7 helper: sample-corrected skewness (pandas ``skew``) per column."""
    row = one_row(df, *[F.skewness(col(c)).alias(f"s{i}") for i, c in enumerate(cols)], *[F.count(col(c)).alias(f"n{i}") for i, c in enumerate(cols)])
    out = {}
    for i, c in enumerate(cols):
        g, n = row[f"s{i}"], row[f"n{i}"]
        out[c] = g * math.sqrt(n * (n - 1)) / (n - 2) if g is not None and n and n > 2 else None
    return out


def batch_feature_preview(df, method=None):
    """the batch preview of the feature tab — degree-2 polynomial of up to 3 numeric
    columns, year/month/day of up to 2 datetime columns, 10 quantile bins of up to 2
    numeric columns and log1p of skewed ones (sample-corrected skew > 1) among 3."""
    from tamis.plans.pipeline import make_step

    nums = [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]
    dts = [f.name for f in df.schema.fields if isinstance(f.dataType, (TimestampType, TimestampNTZType, DateType))]
    steps = []
    if len(nums) >= 2:
        steps.append({"kind": "create_polynomial_features", "params": {"columns": nums[:3], "degree": 2, "quantile_method": method}})
    if dts:
        steps.append({"kind": "extract_datetime_features", "params": {"columns": dts[:2], "features": ["year", "month", "day"]}})
    if nums:
        steps.append({"kind": "bin_features", "params": {"columns": nums[:2], "bins": 10, "quantile_method": method}})
    out = df
    for spec in steps:
        out = make_step(spec).fit_transform(out)
    skews = skew_candidates(df, nums[:3]) if nums else {}
    logs = {unique_name(out.columns, f"log_{c}"): F.log1p(F.greatest(col(c).cast("double"), F.lit(0.0))) for c, g in skews.items() if g is not None and g > 1}
    return _select_with(out, logs) if logs else out
