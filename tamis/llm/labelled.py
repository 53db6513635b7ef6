"""Bounded samples of labelled documents, for the classifiers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.llm.common import payload, settle

MAX_ROWS = 20_000


def fold(doc_id: str, folds: int) -> Column:
    """crc32 of the id as text modulo ``folds``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds


def chosen_labels(labels: DataFrame, target: str, folds: int, held_out: int, max_rows: int) -> DataFrame:
    """(doc_id, y): the ``max_rows`` labelled ids outside the held-out fold with the smallest hashes. Only labels 0 and 1 count."""
    usable = payload(labels, "doc_id", target).select("doc_id", F.col(target).cast("int").alias("y"))
    usable = usable.where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & (fold("doc_id", folds) != held_out))
    return usable.distinct().orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id", "y").limit(max_rows)


def reduced_sample(docs: DataFrame, labels: DataFrame, target: str, folds: int, held_out: int, max_rows: int, reduce: Callable) -> DataFrame:
    """(hash, y, b): the rows of ``training_sample`` with each text reduced to numbers by ``reduce`` where it is scanned.

    ``reduce`` maps batches of (hash, y, text) to (hash, y, b array<int>). No text is shuffled or sorted; if ids that
    repeat make more than ``max_rows`` rows, the first by hash of id, label and numbers are taken.
    """
    found = payload(docs, "doc_id", "text").join(F.broadcast(chosen_labels(labels, target, folds, held_out, max_rows)), "doc_id")
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    slim = found.select(F.xxhash64(F.col("doc_id").cast("string")).alias("hash"), "y", text)
    rows = settle(slim.mapInArrow(reduce, "hash long, y int, b array<int>").withColumn("row", F.monotonically_increasing_id()))
    if rows.count() > max_rows:
        first = rows.select("row", "hash", "y", F.xxhash64("b").alias("of")).orderBy("hash", "y", "of", "row").limit(max_rows)
        rows = rows.join(F.broadcast(first.select("row")), "row")
    return rows.drop("row")


def training_sample(docs: DataFrame, labels: DataFrame, target: str, folds: int, held_out: int, max_rows: int = MAX_ROWS) -> DataFrame:
    """(doc_id, text, y): at most ``max_rows`` labelled documents outside the held-out fold.

    The rows with the smallest hash of their id are taken, so the sample doesn't depend on
    how the tables are stored. Labels that are null or neither 0 nor 1 are left out. At most
    ``max_rows`` ids of 12 bytes are broadcast.
    """
    usable = payload(labels, "doc_id", target).select("doc_id", F.col(target).cast("int").alias("y"))
    usable = usable.where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & (fold("doc_id", folds) != held_out))
    order = [F.xxhash64(F.col("doc_id").cast("string")), "doc_id", "y"]
    chosen = usable.distinct().orderBy(*order).limit(max_rows)
    found = payload(docs, "doc_id", "text").join(F.broadcast(chosen), "doc_id")
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    # ids that repeat could make the join larger than the bound
    return settle(found.select("doc_id", text, "y").orderBy(*order, F.xxhash64("text")).limit(max_rows))
