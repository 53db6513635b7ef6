"""Quality classifier: histogram gradient-boosted trees over statistics of a document's text.

Trees are grown level by level on binned statistics of a bounded labelled sample; histograms
of gradients and Hessians give the splits. The trees are flattened into arrays (complete
binary trees), which numpy traverses for a batch of documents at once, level by level.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamis.llm.common import payload
from tamis.llm.labelled import MAX_ROWS, fold, training_sample

BINS, DEPTH, TREES, RATE, LEAF_ROWS, RIDGE = 64, 4, 120, 0.1, 20, 1.0

CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "digit": b"0123456789",
    "space": b" \t\n\r\x0b\x0c",
    "stop": b".",
    "comma": b",;:",
    "shout": b"!?",
    "bar": b"|/\\_",
    "symbol": b"#$%&*+<=>@^`{}~",
    "bracket": b"()[]\"'-",
}
CLASS_OF = np.full(256, len(CLASSES), np.uint8)  # the last class: bytes outside ASCII and controls
for _n, _chars in enumerate(CLASSES.values()):
    CLASS_OF[list(_chars)] = _n
STATISTICS = [
    *(f"{c}_share" for c in [*CLASSES, "other"]), "log_bytes", "log_words", "word_length", "distinct_words", "top_word", "same_as_before",
    "log_lines", "distinct_lines", "words_per_line", "compressed", "odd_words", "upper_words",
]


def statistics(text: str) -> list[float]:
    """Length, shares of character classes, repetition and line shape; zeros for an empty text."""
    data = text.encode("utf-8", "replace")
    if not data.strip():
        return [0.0] * len(STATISTICS)
    shares = np.bincount(CLASS_OF[np.frombuffer(data, np.uint8)], minlength=len(CLASSES) + 1) / len(data)
    words = data.split()
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lines = data.split(b"\n")
    n = len(words)
    return [
        *shares.tolist(),
        np.log1p(len(data)),
        np.log1p(n),
        sum(map(len, words)) / n,
        len(counts) / n,
        max(counts.values()) / n,
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
        np.log1p(len(lines)),
        len(set(lines)) / len(lines),
        n / len(lines),
        len(zlib.compress(data, 1)) / len(data),
        sum(not w[-1:].isalnum() and w[-1] < 128 and w[-1:] not in b".,;:" for w in words) / n,
        sum(w[:2].isupper() for w in words) / n,
    ]


@dataclass
class Trees:
    """Complete binary trees as arrays: (tree, node) of feature and threshold, (tree, leaf) of value."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def margins(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += value[node - (2**DEPTH - 1)]
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margins(x)))


def best_splits(binned: np.ndarray, node: np.ndarray, nodes: int, grad: np.ndarray, hess: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each node of a level the feature and the last bin that goes left; BINS where no split gains."""
    gain = np.zeros(nodes)
    feature, cut = np.zeros(nodes, np.int64), np.full(nodes, BINS, np.int64)
    for f in range(binned.shape[1]):
        at = node * BINS + binned[:, f]
        g, h, n = (np.bincount(at, w, nodes * BINS).reshape(nodes, BINS).cumsum(1) for w in (grad, hess, np.ones(len(at))))
        rest = [a[:, -1:] - a for a in (g, h, n)]
        value = g**2 / (h + RIDGE) + rest[0] ** 2 / (rest[1] + RIDGE) - (g[:, -1:] ** 2) / (h[:, -1:] + RIDGE)
        value[(n < LEAF_ROWS) | (rest[2] < LEAF_ROWS)] = 0
        here = value.argmax(1)
        better = value[np.arange(nodes), here] > gain + 1e-9
        gain[better] = value[np.arange(nodes), here][better]
        feature[better], cut[better] = f, here[better]
    return feature, cut


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    """Boosted trees for the log loss; without rows of both classes the score is their share, smoothed."""
    base = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    inner = 2**DEPTH - 1
    feature, threshold, value = [], [], []
    if 0 < y.sum() < len(y):
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS)[1:-1])) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], 1)
        margin = np.full(len(y), base)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-margin))
            grad, hess = y - p, p * (1 - p)
            node = np.zeros(len(y), np.int64)
            features, thresholds = np.zeros(inner, np.int64), np.full(inner, np.inf)
            for level in range(DEPTH):
                first = 2**level - 1
                best, cut = best_splits(binned, node - first, 2**level, grad, hess)
                for k in range(2**level):
                    if cut[k] < len(edges[best[k]]):
                        features[first + k], thresholds[first + k] = best[k], edges[best[k]][cut[k]]
                right = binned[np.arange(len(y)), best[node - first]] > cut[node - first]
                node = 2 * node + 1 + right
            leaf = node - inner
            g, h = (np.bincount(leaf, w, inner + 1) for w in (grad, hess))
            values = RATE * g / (h + RIDGE)
            margin += values[leaf]
            feature.append(features)
            threshold.append(thresholds)
            value.append(values)
    n = len(feature)
    return Trees(
        base,
        np.array(feature, np.int64).reshape(n, inner),
        np.array(threshold, float).reshape(n, inner),
        np.array(value, float).reshape(n, inner + 1),
    )


def train(docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2, max_rows: int = MAX_ROWS) -> Trees:
    """Trees for ``labels.quality`` from at most ``max_rows`` labelled documents outside the held-out fold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics(t.as_py()) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), batch.column(1)], ["x", "y"])

    sample = training_sample(docs, labels, "quality", folds, held_out, max_rows)
    rows = sample.select("text", "y").mapInArrow(run, "x array<double>, y int").toPandas()
    x = np.array(rows["x"].tolist(), float).reshape(len(rows), len(STATISTICS))
    return fit(x, rows["y"].to_numpy(float))


def score(docs: DataFrame, trees: Trees) -> DataFrame:
    """(doc_id, score) of every row, from its text alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([statistics(t.as_py() or "") for t in batch.column(1)]).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(trees.scores(x))], ["doc_id", "score"])

    slim = payload(docs, "doc_id", "text").select("doc_id", F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(run, f"doc_id {dict(slim.dtypes)['doc_id']}, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, max_rows: int = MAX_ROWS) -> DataFrame:
    """One row per input row: doc_id, held_out, score and predicted (1 from ``threshold`` on).

    Null texts count as empty; empty texts get the score that the trees give to zeros. Rows
    with a null doc_id are scored; their fold is that of an empty text. Repeated doc_ids get
    a row each. Without labelled rows every score is 0.5. Other input columns are ignored.
    """
    scored = score(docs, train(docs, labels, max_rows=max_rows))
    return scored.select(
        "doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, max_rows: int = MAX_ROWS) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score reaches ``threshold``; scored in one pass."""
    trees = train(docs, labels, max_rows=max_rows)

    @F.pandas_udf("double")
    def quality(text):
        return scores_of(text, trees)

    return docs.where(quality(F.coalesce(docs["text"].cast("string"), F.lit(""))) >= threshold)


def scores_of(text, trees: Trees):
    import pandas as pd

    x = np.array([statistics(t) for t in text]).reshape(-1, len(STATISTICS))
    return pd.Series(trees.scores(x), index=text.index)
