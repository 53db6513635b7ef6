"""K7: session save / restore as a directory: ``raw/`` (Parquet), ``pipeline.json`` and
``manifest.json``. No size limit; a structure check on load."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

VERSION = "1.0"


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def _read_text(spark: SparkSession, path: str) -> str:
    return "\n".join(r.value for r in spark.read.text(path).collect())


def export_bundle(raw: DataFrame, steps: list[dict], path: str, changelog: list[str] | None = None, sample_rows: int | None = None) -> None:
    spark = raw.sparkSession
    data = raw
    if sample_rows:
        from tamis.sources.sample import sample_for_preview

        data = sample_for_preview(raw, sample_rows)
    data.write.mode("overwrite").parquet(f"{path}/raw")
    _write_text(spark, f"{path}/pipeline.json", json.dumps(steps))
    _write_text(spark, f"{path}/manifest.json", json.dumps({"version": VERSION, "changelog": changelog or [], "sample_rows": sample_rows}))


def import_bundle(spark: SparkSession, path: str) -> tuple[DataFrame, list[dict], dict]:
    manifest = json.loads(_read_text(spark, f"{path}/manifest.json"))
    if manifest.get("version") != VERSION:
        raise ValueError(f"unsupported bundle version {manifest.get('version')!r}")
    steps = json.loads(_read_text(spark, f"{path}/pipeline.json"))
    if not isinstance(steps, list) or not all(isinstance(s, dict) and "kind" in s for s in steps):
        raise ValueError("bundle pipeline is not a list of steps")
    return spark.read.parquet(f"{path}/raw"), steps, manifest
