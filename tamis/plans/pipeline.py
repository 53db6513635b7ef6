"""Validate, fit and run a JSON list of steps.

Validation folds over the evolving schema where parameters determine it (a step may use
a column an earlier step made); ``Pipeline.fit`` re-checks every step on its real input. Fitting folds ``fit``/``transform``: each fit runs its few bounded aggregations,
each transform only extends the lazy plan, so the whole pipeline is one plan that runs
at the sink.
"""

from __future__ import annotations

import json
import time
import warnings

from pyspark.sql import DataFrame

from tamis.operators.base import REGISTRY, FittedStep, StepError

# Step kinds as the reference names them (18 pipeline steps and 5 feature steps).
KINDS = [
    "impute", "drop_missing", "normalize_text", "standardize_dates", "unit_convert", "outliers",
    "duplicates", "encode", "scale", "rebalance", "type_convert", "skewness_transform", "mask_pii",
    "smooth_time_series", "resample_time_series", "clean_text", "extract_tfidf", "extract_domain",
    "create_polynomial_features", "extract_datetime_features", "bin_features",
    "select_features_correlation", "automated_feature_engineering",
]


def _load_registry():
    import tamis.operators  # noqa: F401  (registers the built-in kinds)


def make_step(spec: dict):
    _load_registry()
    if not isinstance(spec, dict):
        raise StepError("step must be a dict")
    kind = spec.get("kind")
    if kind not in REGISTRY:
        raise StepError(f"unknown step kind: {kind}")
    params = spec.get("params", {})
    if not isinstance(params, dict):
        raise StepError(f"{kind}: 'params' must be a dict")
    return REGISTRY[kind](**params)


def _columns_after(step, cols: list[str]) -> list[str]:
    """Columns after ``step`` where they follow from its parameters alone (no job runs);
    data-dependent additions (one-hot dummies, polynomial terms, TF-IDF columns) are
    re-checked by ``Pipeline.fit`` against the schema each step actually receives."""
    p, k = step.params, step.kind
    out = list(cols)
    if k == "drop_missing" and p.get("axis") == "columns" and p.get("columns"):
        out = [c for c in out if c not in p["columns"]]
    elif k == "scale" and p.get("keep_original"):
        out += [f"{c}_scaled" for c in p.get("columns", []) if f"{c}_scaled" not in out]
    elif k == "extract_datetime_features":
        out += [f"{c}_{f}" for c in p.get("columns", []) for f in p.get("features", []) if f"{c}_{f}" not in out]
    elif k == "bin_features":
        out += [f"{c}_binned" for c in p.get("columns", []) if f"{c}_binned" not in out]
    elif k == "encode" and p.get("method") == "hashing_encode":
        n = max(1, min(50, int(p.get("n_components", 8))))
        for c in p.get("columns", []):
            out = [x for x in out if x != c] + [f"{c}_hash_{i}" for i in range(n)]
    elif k == "encode" and p.get("method") == "onehot":
        out = [x for x in out if x not in p.get("columns", [])]
    elif k == "extract_tfidf" and p.get("form", "wide") == "wide":
        out = [x for x in out if x != p.get("column")]
    elif k == "resample_time_series":
        out = out  # numeric columns and the time column remain
    return out


# The least and most a parameter may be, by step.
PARAMETER_RANGES = {
    ("impute", "n_neighbors"): (1, None),
    ("create_polynomial_features", "degree"): (1, None),
    ("bin_features", "bins"): (2, None),
    ("select_features_correlation", "threshold"): (0.1, 0.9),
    ("automated_feature_engineering", "max_features"): (10, None),
}
# What larger values are taken as.
PARAMETER_LIMITS = {
    ("impute", "n_neighbors"): 50,
    ("create_polynomial_features", "degree"): 5,
    ("bin_features", "bins"): 50,
    ("automated_feature_engineering", "max_features"): 500,
}


def range_errors(step) -> list[str]:
    """Parameters that are no number or lie outside their range; warns of those that the step will lower."""
    errors = []
    for (kind, name), (least, most) in PARAMETER_RANGES.items():
        if kind != step.kind or name not in step.params:
            continue
        value = step.params[name]
        kinds = (int, float) if isinstance(least, float) else int
        if isinstance(value, bool) or not isinstance(value, kinds) or value < least or (most is not None and value > most):
            number = "a number" if isinstance(least, float) else "an integer"
            errors.append(f"'{name}' must be {number} " + (f"of at least {least}" if most is None else f"between {least} and {most}"))
        elif value > PARAMETER_LIMITS.get((kind, name), value):
            warnings.warn(f"{kind}: '{name}' {value} is taken as {PARAMETER_LIMITS[kind, name]}", stacklevel=3)
    return errors


def problems(df: DataFrame, steps: list[dict]) -> tuple[list[str], list[str]]:
    """(steps that can't be built, other errors)."""
    if not isinstance(steps, list):
        return ["pipeline must be a list"], []
    unbuilt, errors = [], []
    cols = list(df.columns)
    for i, spec in enumerate(steps):
        try:
            step = make_step(spec)
        except StepError as e:
            unbuilt.append(f"Step {i}: {e}")
            continue
        errors += [f"Step {i} ({step.kind}): {e}" for e in range_errors(step)]
        absent = [c for c in step.input_columns() if c not in cols]
        if absent:
            errors.append(f"Step {i} ({step.kind}): columns not in DataFrame: {', '.join(absent)}")
        cols = _columns_after(step, cols)
    return unbuilt, errors


def validate_pipeline(df: DataFrame, steps: list[dict]) -> tuple[bool, list[str]]:
    """Check kinds, parameters, their ranges and columns. Columns are checked against the schema each
    step will see as far as it follows from earlier steps' parameters; no job runs."""
    unbuilt, errors = problems(df, steps)
    every = sorted([*unbuilt, *errors], key=lambda e: int(e.split()[1].strip(":")) if e.startswith("Step ") else -1)
    return not every, every


class Pipeline:
    def __init__(self, steps: list[dict]):
        self.specs = list(steps)
        self.steps = [make_step(s) for s in self.specs]
        self.fitted: list[FittedStep] = []
        self.timings: list[tuple[str, float]] = []

    @classmethod
    def from_json(cls, text: str) -> "Pipeline":
        return cls(json.loads(text))

    def to_json(self) -> str:
        return json.dumps(self.specs)

    def fit(self, df: DataFrame) -> "Pipeline":
        self._fold(df)
        return self

    def _fold(self, df: DataFrame) -> DataFrame:
        """Fit each step on what the step before made of ``df``; returns what the last one made."""
        self.fitted, self.timings = [], []
        cur = df
        for step in self.steps:
            t0 = time.time()
            step.check_columns(cur)
            f = step.fit(cur)
            self.fitted.append(f)
            cur = f.transform(cur)
            self.timings.append((step.kind, time.time() - t0))
        return cur

    def transform(self, df: DataFrame) -> DataFrame:
        cur = df
        for f in self.fitted:
            cur = f.transform(cur)
        return cur

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self._fold(df)

    @property
    def streaming_safe(self) -> bool:
        return all(s.rowwise for s in self.steps)


def run_pipeline(df: DataFrame, steps: list[dict]) -> DataFrame:
    """Fit and apply every step in order (fail fast on the first bad step)."""
    unbuilt, _ = problems(df, steps)
    if unbuilt:
        raise StepError("; ".join(unbuilt))
    return Pipeline(steps).fit_transform(df)


def preview_pipeline(df: DataFrame, steps: list[dict], n: int = 1000, seed: int = 42, key_columns=None) -> dict:
    """Run the steps on a seeded sample and compare statistics before/after."""
    from tamis.operators.profile import compare_stats, compute_basic_stats
    from tamis.sources.sample import sample_for_preview

    sample = sample_for_preview(df, n, seed, key_columns)
    after = run_pipeline(sample, steps)
    before_stats, after_stats = compute_basic_stats(sample), compute_basic_stats(after)
    return {"sample": sample, "result": after, "before": before_stats, "after": after_stats, "delta": compare_stats(before_stats, after_stats)}
