"""Structured Streaming forms of the steps.

* Row-wise fitted steps (impute with constants, scale, encode with literal maps, text,
  PII masking, type conversion…) are projections, so a pipeline fitted on a batch table
  transforms a streaming DataFrame unchanged.
* T16 resampling becomes an event-time window aggregation with a watermark.
* T8 de-duplication becomes ``dropDuplicatesWithinWatermark``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from tamis.operators.base import StepError, col
from tamis.operators.timeseries import parse_freq


def apply_fitted(pipeline, stream: DataFrame) -> DataFrame:
    if not pipeline.streaming_safe:
        raise StepError("pipeline has steps that need the whole table (not row-wise)")
    return pipeline.transform(stream)


def resample_stream(stream: DataFrame, time_column: str, freq: str, agg_func: str = "mean", watermark: str = "1 hour") -> DataFrame:
    kind, n = parse_freq(freq)
    if kind != "seconds":
        raise StepError("streaming resample supports fixed durations")
    ts = col(time_column).cast("timestamp")
    s = stream.withColumn("__et", ts).withWatermark("__et", watermark)
    values = [f.name for f in stream.schema.fields if isinstance(f.dataType, NumericType) and f.name != time_column]
    fn = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "count": F.count, "std": F.stddev_samp}.get(agg_func, F.avg)
    g = s.groupBy(F.window("__et", f"{n} seconds")).agg(*[fn(col(c)).alias(c) for c in values])
    return g.select(F.col("window.start").cast("timestamp_ntz").alias(time_column), *values)


def dedupe_stream(stream: DataFrame, time_column: str, subset, watermark: str = "1 hour") -> DataFrame:
    s = stream.withColumn("__et", col(time_column).cast("timestamp")).withWatermark("__et", watermark)
    return s.dropDuplicatesWithinWatermark(list(subset)).drop("__et")
