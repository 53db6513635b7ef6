"""Ranked lexical search over norm buckets (LEMP): the k best documents of each query.

A document is an impact vector over the queries' terms, a query the vector of its terms'
weights. Both are scaled by the root of the weight, so that their inner product is the
score and Cauchy-Schwarz bounds it by the product of the lengths.

1. One pass over the texts keeps each document's length and its counts of the queries' terms.
2. Impact vectors are dealt by length, longest first, into range partitions: the buckets.
3. The first bucket gives each query's first threshold, its k-th best score there.
4. Every bucket is searched by itself, block after block. A query leaves a block whose longest
   vector times its own length stays below its threshold. Inside a block, a row's values at
   the query's heaviest terms, and Cauchy-Schwarz for the rest, bound its score. Rows that
   can still reach the threshold are rescored exactly, in 64-bit integers.
5. Buckets give at most k rows for each query, which are merged by rank.

Queries are taken in blocks of bounded number, whose terms go to every task; documents are
never paired with each other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tamis.llm.common import payload, settle
from tamis.llm.words import slices
from tamis.session import shuffle_partitions

QUERIES = 4_096  # in a block at most
TERMS = 1_000_000  # of all queries in a block, which every task holds; a query with more is a block of its own
CELLS = 2_000_000  # of the dense table of a block of rows
LEADING = 3  # heaviest terms of a query that are looked at before the rest is bounded
SLACK = 1 + 1e-9  # bounds are in doubles, scores in integers
#: ASCII that ends words (all but digits and letters) becomes a space; A-Z are lower-cased, other bytes stay.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or chr(c).isalnum() else 32 for c in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(FOLD).split()


def query_terms(queries: DataFrame) -> DataFrame:
    """(item_id, terms): the distinct terms of each query, as binary; rows that share an item_id are one query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = [list(dict.fromkeys(terms_of(t.as_py()))) for t in batch.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(terms, pa.list_(pa.binary()))], ["item_id", "terms"])

    slim = payload(queries, "item_id", "text").select("item_id", F.col("text").cast("string").alias("text"))
    found = slim.mapInArrow(run, f"item_id {dict(slim.dtypes)['item_id']}, terms array<binary>")
    return found.groupBy("item_id").agg(F.array_distinct(F.flatten(F.collect_list("terms"))).alias("terms"))


def counts(docs: DataFrame, known: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, at, tf): each row's number of terms, and its terms among ``known`` with their counts, as packed integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            lengths, words = np.zeros(batch.num_rows, np.int64), []
            for row, text in enumerate(batch.column("text").cast(pa.binary())):
                found = terms_of(text.as_py())
                lengths[row] = len(found)
                words += found
            at = np.fromiter(map(known.get, words, repeat(-1)), np.int64, len(words))
            held = at >= 0
            key, tf = np.unique(np.repeat(np.arange(batch.num_rows), lengths)[held] * max(1, len(known)) + at[held], return_counts=True)
            row = key // max(1, len(known))
            ends = np.searchsorted(row, np.arange(batch.num_rows + 1)).tolist()
            at, tf = (key % max(1, len(known))).astype("<i4"), tf.astype("<i4")
            packed = [pa.array([x[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary()) for x in (at, tf)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lengths), *packed], ["doc_id", "n", "at", "tf"])

    slim = payload(docs, "doc_id", "text").select("doc_id", F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(run, f"doc_id {dict(slim.dtypes)['doc_id']}, n long, at binary, tf binary")


def unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All integers of a column of packed integers, and where each row begins."""
    parts = [x.as_py() for x in column]
    starts = np.concatenate(([0], np.cumsum([len(x) // 4 for x in parts], dtype=np.int64)))
    return np.frombuffer(b"".join(parts), "<i4").astype(np.int64), starts


def document_frequencies(vectors: DataFrame, terms: int) -> np.ndarray:
    """Rows that hold each term; every task adds up its own rows first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(terms, np.int64)
        for batch in batches:
            total += np.bincount(unpacked(batch.column(0))[0], minlength=terms)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "df"])

    found = vectors.select("at").mapInArrow(run, "at long, df long").groupBy("at").agg(F.sum("df").alias("df"))
    out = np.zeros(terms, np.int64)
    for row in found.collect():  # at most one row a term
        out[row["at"]] = row["df"]
    return out


def weights(df: np.ndarray, rows: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * rows + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)


def impacts(tf: np.ndarray, n: np.ndarray, rows: int, words: int) -> np.ndarray:
    """Each count's impact in a text of ``n`` terms, in 64-bit integers."""
    if 50 * int(n.max(initial=0)) * rows < 2**63:
        m = 100 - 50 + (50 * n * rows) // max(1, words)
    else:
        m = np.array([100 - 50 + (50 * x * rows) // max(1, words) for x in n.tolist()], np.int64)
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


class Index:
    """The queries of a block as weight vectors, heaviest scaled terms first."""

    def __init__(self, queries: list[np.ndarray], weight: np.ndarray, k: int) -> None:
        self.k, self.weight = k, weight
        self.root = np.sqrt(weight)
        self.terms = [q[np.argsort(-weight[q], kind="stable")] for q in queries]
        self.length = np.array([math.sqrt(weight[q].sum()) for q in queries])
        self.rest = np.array([math.sqrt(weight[q[LEADING:]].sum()) for q in self.terms])

    def search(
        self, tf: np.ndarray, at: np.ndarray, starts: np.ndarray, n: np.ndarray, rank: np.ndarray, total: tuple[int, int], least: np.ndarray
    ) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query, row, score) of each query's best k rows; ``least`` holds the thresholds and rises.

        A row scores more than 0 and at least the query's threshold; ties go by ``rank``.
        """
        row = np.repeat(np.arange(len(n)), np.diff(starts))
        impact = impacts(tf, n[row], *total)
        scaled = impact * self.root[at]
        square = np.bincount(row, scaled * scaled, minlength=len(n))
        step = max(1, CELLS // max(1, len(self.weight)))
        best: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in self.terms]
        order = np.argsort(-square, kind="stable")
        for first in range(0, len(n), step):
            rows = order[first : first + step]
            longest = math.sqrt(square[rows[0]])
            live = np.flatnonzero((self.length * longest * SLACK >= least) & (self.length * longest > 0))
            if not len(live):
                break  # no later block has longer vectors
            table = np.zeros((len(self.weight), len(rows)), np.int64)
            for place, r in enumerate(rows.tolist()):
                table[at[starts[r] : starts[r + 1]], place] = impact[starts[r] : starts[r + 1]]
            for q in live.tolist():
                terms = self.terms[q]
                head = table[terms[:LEADING]] * self.root[terms[:LEADING], None]
                # what the leading terms leave of a row's length bounds the other terms
                left = np.sqrt(np.maximum(square[rows] - (head * head).sum(0), 0))
                bound = (head * self.root[terms[:LEADING], None]).sum(0) + left * self.rest[q]
                near = np.flatnonzero(bound * SLACK + 1e-6 >= max(least[q], 1))
                if not len(near):
                    continue
                score = self.weight[terms] @ table[np.ix_(terms, near)]
                keep = score >= max(least[q], 1)
                if keep.any():
                    best[q].append((rows[near[keep]], score[keep]))
                    self.shorten(best[q], rank, least, q)
        for q, found in enumerate(best):
            for r, score in found:
                yield np.full(len(r), q), r, score

    def shorten(self, found: list[tuple[np.ndarray, np.ndarray]], rank: np.ndarray, least: np.ndarray, q: int) -> None:
        """Once there are k rows, keep the best k and raise the threshold to the last one's score."""
        if sum(len(r) for r, _ in found) < self.k:
            return
        r, score = (np.concatenate(x) for x in zip(*found, strict=True))
        best = np.lexsort((rank[r], -score))[: self.k]
        least[q] = max(least[q], score[best[-1]])
        found[:] = [(r[best], score[best])]


def bucket_search(vectors: DataFrame, index: Index, total: tuple[int, int], least: np.ndarray) -> DataFrame:
    """(q, doc_id, n, score): each query's best k rows in every batch of every partition, of those that may be among the best k."""
    id_type = dict(vectors.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rising = least.copy()  # batches of a partition share the thresholds reached so far
        for batch in batches:
            at, starts = unpacked(batch.column("at"))
            tf, _ = unpacked(batch.column("tf"))
            n = batch.column("n").to_numpy()
            rank = np.empty(len(n), np.int64)
            rank[pa.compute.sort_indices(batch, [("doc_id", "ascending"), ("n", "ascending")], null_placement="at_end")] = np.arange(len(n))
            found = list(index.search(tf, at, starts, n, rank, total, rising))
            if found:
                q, r, score = (np.concatenate(x) for x in zip(*found, strict=True))
                ids = batch.column("doc_id").take(pa.array(r))
                yield pa.RecordBatch.from_arrays([pa.array(q), ids, pa.array(n[r]), pa.array(score)], ["q", "doc_id", "n", "score"])

    return vectors.mapInArrow(run, f"q long, doc_id {id_type}, n long, score long")


def best_of(found: DataFrame, k: int) -> DataFrame:
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n")]
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(*order))).where(F.col("rank") <= k)


def search_block(docs: DataFrame, queries: list[tuple], k: int) -> DataFrame:
    """The result rows of one block of queries, (item_id, terms) each."""
    spark = docs.sparkSession
    known = {t: n for n, t in enumerate(dict.fromkeys(t for _, terms in queries for t in terms))}
    asked = [np.array([known[t] for t in terms], np.int64) for _, terms in queries]
    vectors = settle(counts(docs, known))
    rows, words = vectors.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    weight = weights(document_frequencies(vectors, len(known)), rows)
    index, total = Index(asked, weight, k), (rows, words)

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, starts = unpacked(batch.column("at"))
            row = np.repeat(np.arange(batch.num_rows), np.diff(starts))
            impact = impacts(unpacked(batch.column("tf"))[0], batch.column("n").to_numpy()[row], *total) * index.root[at]
            square = np.bincount(row, impact * impact, minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.sqrt(square))], [*batch.schema.names, "len"])

    # copies have equal lengths: the hash lets them lie in several buckets
    id_type = dict(vectors.dtypes)["doc_id"]
    measured = vectors.where("length(at) > 0").mapInArrow(lengths, f"doc_id {id_type}, n long, at binary, tf binary, len double")
    spread = [F.desc("len"), F.xxhash64("doc_id", "n")]
    buckets = settle(measured.repartitionByRange(shuffle_partitions(spark), *spread).sortWithinPartitions(*spread).drop("len"))
    buckets = buckets.withColumn("bucket", F.spark_partition_id())
    longest = buckets.agg(F.min("bucket")).first()[0]
    least = np.zeros(len(asked), np.int64)
    seeds = best_of(bucket_search(buckets.where(F.col("bucket") == F.lit(longest)), index, total, least), k).where(F.col("rank") == k).select("q", "score")
    for row in seeds.collect():  # at most one row a query
        least[row["q"]] = row["score"]
    found = best_of(bucket_search(buckets, index, total, least), k)
    ids = spark.createDataFrame([(n, item) for n, (item, _) in enumerate(queries)], f"q long, item_id {index_type(queries)}")
    return found.join(F.broadcast(ids), "q").select("item_id", "rank", "doc_id", "score")


def index_type(queries: list[tuple]) -> str:
    return "string" if any(isinstance(item, str) for item, _ in queries) else "long"


def ranked_search(docs: DataFrame, queries: DataFrame, k: int = 50) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the k best rows of ``docs`` for each query, scores above 0 only.

    Terms are runs of ASCII digits and letters and of all other non-ASCII characters, A-Z
    lower-cased. A query's terms count once each. With N the rows with a term, L all their
    terms, n a row's, df the rows that hold a term and tf its count in a row, a score is the
    sum over the query's terms of floor(1000 ln((2N + 2) / (2df + 1))) times
    (10^9 tf) div (1000 tf + 20 m), where m = 50 + (50 n N) div L. Equal scores go by doc_id
    (null last), then by n.

    Null and empty texts have no term, match nothing and don't count. Rows that repeat are ranked
    one after the other. Queries that share an item_id are one query; item_id (integers or text)
    may be null. A query that matches nothing has no row; without queries or documents the result is empty.
    """
    asked = settle(query_terms(queries))
    item = asked.schema["item_id"]
    items, terms = asked.agg(F.count("*"), F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()
    blocks = max(1, -(-items // QUERIES), -(-terms // TERMS))
    parts = []
    for block in range(blocks):
        held = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect()
        if held:
            parts.append(search_block(docs, [(r["item_id"], [bytes(t) for t in r["terms"]]) for r in held], k))
    if not parts:
        id_type = docs.schema["doc_id"].dataType.simpleString()
        return docs.sparkSession.createDataFrame([], f"item_id {item.dataType.simpleString()}, rank int, doc_id {id_type}, score long")
    return reduce(DataFrame.unionAll, parts).withColumn("item_id", F.col("item_id").cast(item.dataType))
