"""Toxicity classifier: a factorization machine over hashed terms.

Terms are a text's words and their beginnings, each also as "repeated" and as "dense" (in
one word of a hundred or more), hashed to ``BUCKETS``. Buckets enter the machine by one of two
tests over the whole training sample: by themselves (chi-square), or through pairs, where what
a first machine leaves unexplained goes with the bucket and any other bucket together. The
machine learns a weight and a vector for each of them, so that pairs of terms count beyond the
sum of their weights.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamis.llm.common import payload
from tamis.llm.labelled import MAX_ROWS, fold, reduced_sample

BUCKETS, TERMS, FACTORS = 1 << 22, 2_048, 8
TELLING = 20.0  # chi-square that a term needs; chance gives it to one in some 100,000
LEAST_ROWS = 5  # rows of the sample that a bucket needs
SKETCH, SHUFFLES, AT_ONCE = 16, 2, 128
EPOCHS, BATCH, RATE, RIDGE = 60, 256, 0.1, 1e-4
BEGINNINGS = (4, 5, 6, 7)
KEPT = 300_000  # words whose terms a worker keeps
WORD = re.compile(r"\w+")


def bucket(term: str) -> int:
    return zlib.crc32(term.encode("utf-8", "replace")) % BUCKETS


def base_terms(word: str) -> list[str]:
    """The word and its beginnings."""
    return [word, *(word[:n] + "*" for n in BEGINNINGS if len(word) > n)]


def terms(text: str) -> set[int]:
    """Buckets of a text's terms."""
    words = WORD.findall(text.lower())
    counts: Counter[str] = Counter()
    for word, n in Counter(words).items():
        for term in base_terms(word):
            counts[term] += n
    found = set()
    for term, n in counts.items():
        found.add(bucket(term))
        if n > 1:
            found.add(bucket("2 " + term))
        if 100 * n >= len(words):
            found.add(bucket("% " + term))
    return found


@dataclass
class Machine:
    """Factorization machine over the chosen buckets."""

    buckets: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def __post_init__(self):
        self.place = {int(b): n for n, b in enumerate(self.buckets)}
        self.of_word: dict[str, tuple] = {}

    def known(self, word: str) -> tuple:
        """(term, its place plain, repeated, dense) of the word's terms that have any place."""
        found = self.of_word.get(word)
        if found is None:
            if len(self.of_word) >= KEPT:
                self.of_word.clear()
            places = ((t, *(self.place.get(bucket(kind + t), -1) for kind in ("", "2 ", "% "))) for t in base_terms(word))
            found = self.of_word[word] = tuple(p for p in places if max(p[1:]) >= 0)
        return found

    def active(self, text: str) -> list[int]:
        """Places of a text's terms."""
        words = WORD.findall(text.lower())
        counts: dict[tuple, int] = {}
        for word, n in Counter(words).items():
            for places in self.known(word):
                counts[places] = counts.get(places, 0) + n
        found = set()
        for (_, plain, repeated, dense), n in counts.items():
            found.add(plain)
            found.add(repeated if n > 1 else -1)
            found.add(dense if 100 * n >= len(words) else -1)
        found.discard(-1)
        return sorted(found)

    def score(self, places: list[int]) -> float:
        v = self.factors[places]
        margin = self.bias + self.weights[places].sum() + ((v.sum(0) ** 2 - (v**2).sum(0)).sum()) / 2
        return float(1 / (1 + np.exp(-np.clip(margin, -50, 50))))


def fit(x: np.ndarray, y: np.ndarray, seed: int = 7) -> tuple[float, np.ndarray, np.ndarray]:
    """Bias, weights and factors for the log loss by AdaGrad over shuffled batches; ``x`` is 0/1 by row and term."""
    rng = np.random.default_rng(seed)
    many = x.shape[1]
    w, v = np.zeros(many), rng.normal(0, 0.01, (many, FACTORS))
    bias = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    if not 0 < y.sum() < len(y):
        return bias, w, np.zeros_like(v)
    gw, gv, gb = np.full(many, 1e-3), np.full((many, FACTORS), 1e-3), 1e-3
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for at in range(0, len(y), BATCH):
            rows = order[at : at + BATCH]
            b = x[rows].astype(np.float64)
            sums = b @ v
            margin = bias + b @ w + (sums**2 - b @ v**2).sum(1) / 2
            err = (1 / (1 + np.exp(-np.clip(margin, -50, 50))) - y[rows]) / len(rows)
            dw = b.T @ err + RIDGE * w
            dv = b.T @ (err[:, None] * sums) - (b.T @ err)[:, None] * v + RIDGE * v
            db = err.sum()
            gw, gv, gb = gw + dw**2, gv + dv**2, gb + db**2
            w -= RATE * dw / np.sqrt(gw)
            v -= RATE * dv / np.sqrt(gv)
            bias -= RATE * db / np.sqrt(gb)
    return bias, w, v


class Rows:
    """Sparse 0/1 rows: the sorted places of each row's buckets."""

    def __init__(self, places: list[np.ndarray]) -> None:
        sizes = np.array([len(p) for p in places], np.int64)
        self.index = np.concatenate(places) if len(places) else np.zeros(0, np.int32)
        self.many, self.filled = len(places), np.flatnonzero(sizes)
        self.starts = (np.cumsum(sizes) - sizes)[self.filled]
        order = np.argsort(self.index, kind="stable")
        self.row = np.repeat(np.arange(self.many), sizes)[order]
        self.columns, self.first = np.unique(self.index[order], return_index=True)

    def times(self, v: np.ndarray) -> np.ndarray:
        """Per row the sum of ``v`` over its places."""
        out = np.zeros((self.many, v.shape[1]), v.dtype)
        if len(self.index):
            out[self.filled] = np.add.reduceat(v[self.index], self.starts, axis=0)
        return out

    def sums(self, e: np.ndarray) -> np.ndarray:
        """Per column that occurs the sum of ``e`` over its rows."""
        return np.add.reduceat(e[self.row], self.first, axis=0) if len(self.index) else e[:0]


def pair_statistic(places: list[np.ndarray], counts: np.ndarray, left: np.ndarray, seed: int = 1) -> np.ndarray:
    """How far what is ``left`` in the rows goes with a bucket and any other bucket together.

    Rows are centred, scaled and projected on ``SKETCH`` random directions; a bucket's sum of
    left-over times projection is compared with its variance. It grows with every pair
    that the bucket is in, and is ``SKETCH`` on average where labels are chance.
    """
    rng = np.random.default_rng(seed)
    mean = counts / max(len(places), 1)
    scale = 1 / np.sqrt(mean * (1 - mean) + 0.01)
    direction = (rng.choice([-1.0, 1.0], (len(counts), SKETCH)) * scale[:, None]).astype(np.float32)
    centre = (mean @ direction).astype(np.float32)
    found, spread = np.zeros((len(counts), SKETCH)), np.zeros(len(counts))
    every, total = np.zeros(SKETCH), 0.0
    for start in range(0, len(places), AT_ONCE):
        rows = Rows(places[start : start + AT_ONCE])
        e = left[start : start + AT_ONCE, None] * (rows.times(direction) - centre)
        square = (e**2).sum(1)
        found[rows.columns] += rows.sums(e)
        spread[rows.columns] += rows.sums(square)
        every, total = every + e.sum(0), total + square.sum()
    found -= mean[:, None] * every
    spread = spread * (1 - 2 * mean) + mean**2 * total
    return (found**2).sum(1) * SKETCH / np.maximum(spread, 1e-9)


def telling_pairs(places: list[np.ndarray], counts: np.ndarray, left: np.ndarray, most: int) -> np.ndarray:
    """Places whose pair statistic exceeds all those that shuffled left-overs give; the ``most`` greatest."""
    if not len(counts):
        return np.zeros(0, np.int64)
    rng = np.random.default_rng(5)
    chance = max(pair_statistic(places, counts, rng.permutation(left)).max() for _ in range(SHUFFLES))
    found = pair_statistic(places, counts, left)
    return np.argsort(-found, kind="stable")[: min(most, int((found > chance).sum()))]


def dense(places: list[np.ndarray], columns: np.ndarray, many: int) -> np.ndarray:
    """0/1 by row and chosen column."""
    at = np.full(many, -1)
    at[columns] = np.arange(len(columns))
    x = np.zeros((len(places), len(columns)), np.uint8)
    for row, own in zip(x, places, strict=True):
        kept = at[own]
        row[kept[kept >= 0]] = 1
    return x


def margins(x: np.ndarray, bias: float, w: np.ndarray, v: np.ndarray) -> np.ndarray:
    out = []
    for start in range(0, len(x), BATCH):
        b = x[start : start + BATCH].astype(float)
        out.append(bias + b @ w + ((b @ v) ** 2 - b @ v**2).sum(1) / 2)
    return np.concatenate(out) if out else np.zeros(0)


def learn(places: list[np.ndarray], y: np.ndarray, counts: np.ndarray, toxic: np.ndarray, most: int = TERMS) -> tuple:
    """(columns, bias, weights, factors) from sparse rows; ``counts`` and ``toxic`` are each bucket's rows and toxic rows."""
    n, p = max(len(y), 1), y.sum()
    if not 0 < p < n:
        bias, w, v = fit(np.zeros((len(y), 0), np.uint8), y)
        return np.zeros(0, np.int64), bias, w, v
    expected = counts * (p / n)
    alone = (toxic - expected) ** 2 / (expected * (1 - p / n) * (1 - counts / n + 1 / n) + 1.0)
    first = np.argsort(-alone, kind="stable")[: min(most, int((alone >= TELLING).sum()))]
    x = dense(places, first, len(counts))
    machine = fit(x, y)
    left = y - 1 / (1 + np.exp(-np.clip(margins(x, *machine), -50, 50)))
    pairs = np.setdiff1d(telling_pairs(places, counts, left, most), first)
    if not len(pairs):
        return first, *machine
    columns = np.concatenate([first, pairs])
    return columns, *fit(dense(places, columns, len(counts)), y)


def train(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1, max_rows: int = MAX_ROWS, max_terms: int = TERMS) -> Machine:
    """A machine for ``labels.toxic`` from at most ``max_rows`` labelled documents outside the held-out fold.

    Texts are reduced to their buckets where they are scanned, and buckets are counted by class in
    Spark; the driver gets the sample's rows as places of the buckets that at least ``LEAST_ROWS``
    rows hold. The machine has at most ``max_terms`` buckets of either test.
    """

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, text in enumerate(batch.column(2).to_pylist()):
                found = pa.array([sorted(terms(text))], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(n, 1), batch.column(1).slice(n, 1), found], ["hash", "y", "b"])

    sample = reduced_sample(docs, labels, "toxic", folds, held_out, max_rows, reduce)
    seen = sample.select(F.explode("b").alias("b"), "y").groupBy("b").agg(F.count("*").alias("n"), F.sum("y").alias("p"))
    seen = seen.where(F.col("n") >= LEAST_ROWS).toPandas().sort_values("b")
    buckets = seen["b"].to_numpy(np.int32)
    shared = docs.sparkSession.sparkContext.broadcast(buckets)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for b in batch.column(2).to_pylist():
                own = np.array(b, np.int32)
                at = np.searchsorted(shared.value, own)
                rows.append(at[shared.value[np.minimum(at, len(shared.value) - 1)] == own].astype("<i4").tobytes() if len(shared.value) else b"")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.binary())], ["hash", "y", "places"])

    rows = sample.mapInArrow(place, "hash long, y int, places binary").toPandas().sort_values(["hash", "y", "places"])
    places = [np.frombuffer(p, "<i4") for p in rows["places"]]
    counts, toxic = seen["n"].to_numpy(float), seen["p"].to_numpy(float)
    columns, bias, w, v = learn(places, rows["y"].to_numpy(float), counts, toxic, max_terms)
    return Machine(buckets[columns].astype(np.int64), bias, w, v)


MACHINES: dict[int, Machine] = {}  # of this Python worker


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """(doc_id, score) of every row, from its text alone."""
    shared = docs.sparkSession.sparkContext.broadcast((machine.buckets, machine.bias, machine.weights, machine.factors))
    key = hash((machine.bias, machine.weights.tobytes(), machine.factors.tobytes()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = MACHINES.get(key) or MACHINES.setdefault(key, Machine(*shared.value))
        for batch in batches:
            scores = [own.score(own.active(t.as_py() or "")) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    slim = payload(docs, "doc_id", "text").select("doc_id", F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(run, f"doc_id {dict(slim.dtypes)['doc_id']}, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, max_rows: int = MAX_ROWS, max_terms: int = TERMS) -> DataFrame:
    """One row per input row: doc_id, held_out, score and predicted (1 from ``threshold`` on).

    Null texts count as empty; a text without known terms gets the bias alone. Rows with a
    null doc_id are scored; their fold is that of an empty text. Repeated doc_ids get a row
    each. Without labelled rows every score is 0.5. Other input columns are ignored.
    """
    scored = score(docs, train(docs, labels, max_rows=max_rows, max_terms=max_terms))
    return scored.select(
        "doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
