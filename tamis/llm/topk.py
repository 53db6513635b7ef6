"""Exact top-k inner-product search with MaxScore over shards of candidate rows.

Each dimension is a term. A shard holds its postings column by column (the values of one
term over the shard's rows) with the term's smallest and largest value, which bound what
the term can add to a query's score. For a block of queries the terms are put in order of
their bounds. Essential terms are traversed first, for all rows; after each step a row
stays competitive for a query only if its score so far plus the bound of the remaining,
non-essential terms reaches the query's k-th best score known. Competitive rows are probed
in the remaining terms. Shards give k rows for each query, which are merged by rank.

Candidate blocks and query blocks form a grid; a cell of it is one task's unit, so memory is
bounded by two blocks and the work is spread evenly however ids are distributed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tamis.llm.common import payload, settle

SHARD_ROWS = 16_384
QUERY_ROWS = 8_192
AT_ONCE = 256  # queries whose scores over a shard are held together
LEADING = 16  # terms in the first traversal; the next ones double


def integer_vectors(rows: DataFrame, scale: int = 64) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component as a long; unusable vectors are left out.

    Null vectors and vectors with a null, NaN or infinite component take no part; neither do
    rows without vec_id.
    """
    slim = payload(rows, "vec_id", "embedding").select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("x"))
    sound = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    whole = F.transform("x", lambda x: F.floor(x * scale).cast("long"))
    return slim.where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & sound).select("vec_id", whole.alias("v"))


def columns(vectors: pd.Series, width: int) -> np.ndarray:
    """Postings by term: one row per term, zero where a vector is shorter."""
    out = np.zeros((width, len(vectors)), np.int64)
    for n, v in enumerate(vectors):
        out[: len(v), n] = v
    return out


def threshold(scores: np.ndarray, k: int) -> np.ndarray:
    """Each query's k-th best of some rows' scores; minus infinity with fewer rows."""
    if scores.shape[1] < k:
        return np.full(len(scores), -np.inf)
    return np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]


def exact_scores(query: np.ndarray, terms: np.ndarray, peak: int) -> np.ndarray:
    """The integer inner products of a query and rows; ``peak`` bounds their size. Raises where a score is beyond a long."""
    if peak < 2**63:
        return query @ terms
    scores = query.astype(object) @ terms.astype(object)
    if any(not -(2**63) <= x < 2**63 for x in scores.tolist()):
        raise OverflowError("a score is beyond a 64-bit integer")
    return scores.astype(np.int64)


def max_score(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, terms: np.ndarray, k: int, peak: int) -> Iterator[tuple]:
    """(query_id, ids, scores) of each query's best k rows of a shard, ties to smaller ids.

    ``queries`` has a row per query, ``terms`` a row per term, both of integers; ``peak`` bounds the
    sum of the absolute products of a query and a row. Bounds are doubles; where these round (sums from 2 ** 53
    on), rows stay competitive within the rounding. Final scores are integers.
    """
    slack = 0.0 if peak < 2**53 else float(peak) * (len(terms) + 2) * 2.0**-51
    whole_queries, whole_terms = queries, terms
    queries, terms = queries.astype(float), terms.astype(float)
    high = np.maximum(queries * terms.max(1), queries * terms.min(1))
    order = np.argsort(-high.sum(0), kind="stable")
    queries, terms, high = queries[:, order], terms[order], high[:, order]
    rest = np.concatenate((np.cumsum(high[:, ::-1], 1)[:, ::-1], np.zeros((len(queries), 1))), axis=1) + slack
    # some rows scored in full give the first threshold
    probe = queries @ terms[:, : 8 * k]
    best = threshold(np.where(ids[: 8 * k] == query_ids[:, None], -np.inf, probe), k) - slack
    done = min(LEADING, len(terms))
    score = queries[:, :done] @ terms[:done]
    live = score + rest[:, done, None] >= best[:, None]
    while done < len(terms) and np.count_nonzero(live) > live.size // 8:
        step = min(done, len(terms) - done)
        score += queries[:, done : done + step] @ terms[done : done + step]
        done += step
        live &= score + rest[:, done, None] >= best[:, None]
    for n, query_id in enumerate(query_ids):
        rows = np.flatnonzero(live[n])
        rows = rows[ids[rows] != query_id]
        if slack:
            total = exact_scores(whole_queries[n], whole_terms[:, rows], peak)
        else:
            total = (score[n, rows] + queries[n, done:] @ terms[done:, rows]).astype(np.int64)
        if len(rows) > k:
            keep = total >= np.partition(total, len(total) - k)[len(total) - k]
            rows, total = rows[keep], total[keep]
        first = np.lexsort((ids[rows], -total))[:k]
        yield query_id, ids[rows[first]], total[first]


def top_k(rows: DataFrame, every: int = 20, k: int = 20, scale: int = 64) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best rows of each query by integer inner product.

    Queries are the rows whose vec_id is divisible by ``every``; candidates are all rows with
    another vec_id, so copies of a query's own row are no candidates. Ties go to the smaller
    vec_id; rows that repeat are ranked one after the other. A query row that repeats is one
    query if the vectors agree; otherwise each vector is searched and their rows are ranked
    together. Scores are exact; one beyond a 64-bit integer, or such a component, raises an OverflowError. Shorter vectors
    count as ending in zeros. Fewer candidates than k give fewer rows, an
    empty table none. Other input columns are ignored.
    """
    vectors = settle(integer_vectors(rows, scale))
    largest = F.max(F.array_max(F.transform("v", lambda x: F.abs(x.cast("decimal(20,0)")))))
    n, width, asked, most = vectors.agg(
        F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0)), F.count(F.when(F.col("vec_id") % every == 0, 1)), largest
    ).first()
    most = int(most or 0)
    if most >= 2**63 - 1:
        raise OverflowError("a scaled component is beyond a 64-bit integer")
    peak = most * most * width
    shards, blocks = max(1, -(-n // SHARD_ROWS)), max(1, -(-asked // QUERY_ROWS))
    dealt = F.xxhash64("vec_id", "v")
    candidates = vectors.withColumn("shard", F.pmod(dealt, F.lit(shards))).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    )
    queries = (
        vectors.where(F.col("vec_id") % every == 0).distinct().withColumn("block", F.pmod(dealt, F.lit(blocks)).cast("int"))
        .withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
    )

    def search(ask: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
        if ask.empty or shard.empty or not width:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
        ids, terms = shard["vec_id"].to_numpy(), columns(shard["v"], width)
        parts = [ask.iloc[at : at + AT_ONCE] for at in range(0, len(ask), AT_ONCE)]
        found = [x for part in parts for x in max_score(part["vec_id"].to_numpy(), columns(part["v"], width).T, ids, terms, k, peak)]
        return pd.DataFrame(
            {
                "query_id": np.repeat([q for q, _, _ in found], [len(i) for _, i, _ in found]).astype("int64"),
                "vec_id": np.concatenate([i for _, i, _ in found]).astype("int64"),
                "score": np.concatenate([s for _, _, s in found]),
            }
        )

    cells = queries.groupBy("shard", "block").cogroup(candidates.groupBy("shard", "block"))
    found = cells.applyInPandas(search, "query_id long, vec_id long, score long")
    merged = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(merged)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
