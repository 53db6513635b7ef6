"""Helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tamis.session import reliable_checkpoint, workers_find_package


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    workers_find_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder: it is read several times, or cuts lineage."""
    return reliable_checkpoint(df)


def payload(docs: DataFrame, *names: str) -> DataFrame:
    """Only the named columns; any other column of the input, whatever its name, is left behind."""
    return docs.select(*(docs[n] for n in names))
