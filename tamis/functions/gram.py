"""Sums over pairs of columns, in one pass: products of a block of rows with itself.

The columns go to Python as one array a row, whose Arrow batches are matrices as they stand. Each
task adds up four products: rows in which both columns have a value, sums and sums of squares of
one over the rows of the other, and sums of products; where a batch lacks no value, the last
product and the column sums give the others. It emits one row a pair, and pairs are added up by
a grouped aggregation. The plan holds one expression a column, not one a pair.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SUMS = ("n", "a", "b", "aa", "bb", "ab")


def block_sums(x: np.ndarray) -> np.ndarray:
    """(6, d, d): for columns i and j the rows with both, sums of i, of j, of i², of j², of ij over them.

    Missing values are NaN. A column's infinite values make all sums of its pairs NaN.
    """
    if math.isfinite(x.sum()):  # neither missing nor infinite values
        a, ab = np.tile(x.sum(0)[:, None], x.shape[1]), x.T @ x
        aa = np.tile(ab.diagonal()[:, None], x.shape[1])
        return np.stack((np.full(ab.shape, float(len(x))), a, a.T, aa, aa.T, ab))
    there = ~np.isnan(x)
    endless = np.isinf(x)
    held = np.where(there & ~endless, x, 0.0)
    mask = there.astype(float)
    n, a, aa, ab = mask.T @ mask, held.T @ mask, (held * held).T @ mask, held.T @ held
    if endless.any():
        lost = endless.T.astype(float) @ mask
        lost = (lost + lost.T) > 0
        for s in (a, aa, ab):
            s[lost] = np.nan
    return np.stack((n, a, a.T, aa, aa.T, ab))


def pair_sums(df: DataFrame, columns: list[Column], pairs: list[tuple[int, int]]) -> dict[tuple[int, int], tuple]:
    """{(i, j): sums} in the order of ``SUMS``, over the rows where both columns have a value; null and NaN are missing."""
    if not pairs:
        return {}
    i, j = (np.array(x, np.int32) for x in zip(*pairs, strict=True))
    d = len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(SUMS), d, d))
        for batch in batches:
            total += block_sums(batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, d))
        found = [pa.array(i), pa.array(j), *(pa.array(s) for s in total[:, i, j])]
        yield pa.RecordBatch.from_arrays(found, ["i", "j", *SUMS])

    rows = df.select(F.array(*[c.cast("double") for c in columns]).alias("x"))
    parts = rows.mapInArrow(run, "i int, j int, " + ", ".join(f"{s} double" for s in SUMS))
    added = parts.groupBy("i", "j").agg(*[F.sum(s).alias(s) for s in SUMS]).collect()  # one row a pair asked for
    nothing = (0.0,) * len(SUMS)
    found = {(r["i"], r["j"]): tuple(r[s] for s in SUMS) for r in added}
    return {p: found.get(p, nothing) for p in pairs}


def centred(df: DataFrame, columns: list[Column]) -> list[Column]:
    """The columns less their means, so that sums of products don't cancel."""
    finite = [F.when(F.abs(c.cast("double")) < math.inf, c.cast("double")) for c in columns]
    means = df.agg(*[F.avg(c).alias(f"m{k}") for k, c in enumerate(finite)]).first()
    return [c.cast("double") - F.lit(means[f"m{k}"] or 0.0) for k, c in enumerate(columns)]


def correlation(sums: tuple) -> tuple[float | None, int]:
    """(r, n) from a pair's sums; no r for fewer than two rows or a column that doesn't vary."""
    n, a, b, aa, bb, ab = sums
    n = int(n)
    if n < 2:
        return None, n
    saa, sbb, sab = aa - a * a / n, bb - b * b / n, ab - a * b / n
    # what is left of the squares is rounding where a column doesn't vary over the pair's rows
    if not (saa > 1e-13 * aa and sbb > 1e-13 * bb) or math.isnan(sab):
        return None, n
    return max(-1.0, min(1.0, sab / math.sqrt(saa * sbb))), n


def correlations(df: DataFrame, columns: list[Column], pairs: list[tuple[int, int]] | None = None) -> dict[tuple[int, int], tuple]:
    """{(i, j): (Pearson r, n)} over pairwise-complete rows, for i < j or the pairs asked for."""
    pairs = list(combinations(range(len(columns)), 2)) if pairs is None else pairs
    return {p: correlation(s) for p, s in pair_sums(df, centred(df, columns) if pairs else columns, pairs).items()}
