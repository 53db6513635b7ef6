"""tamis: data preparation and feature engineering as Spark jobs.

Steps are described as JSON (``{"kind": ..., "params": {...}}``), fitted with a bounded
Spark aggregation and applied as column expressions, so one fitted pipeline runs over
whole tables, samples and (for row-wise steps) streams.
"""

from tamis.session import get_session, checkpoint_dir
from tamis.plans.pipeline import Pipeline, run_pipeline, validate_pipeline
from tamis.operators.base import REGISTRY, register_step

__all__ = [
    "get_session",
    "checkpoint_dir",
    "Pipeline",
    "run_pipeline",
    "validate_pipeline",
    "REGISTRY",
    "register_step",
]
