"""Pipeline steps (fit / transform) and feature builders.

Importing this package registers every built-in step kind.
"""

from tamis.operators.base import REGISTRY, FittedStep, Step, StepError, register_step  # noqa: F401
from tamis.operators import (  # noqa: F401
    missing,
    text,
    dates,
    numeric,
    outliers,
    duplicates,
    encode,
    rebalance,
    types,
    pii,
    timeseries,
    tfidf,
    features,
)
