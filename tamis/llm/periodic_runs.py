"""Periodic runs of words in a document, by descending-LCP Kruskal over its suffixes.

A run is a stretch of words with smallest period q that no neighbouring word extends; those of
at least 4 periods and ``min_words`` words are wanted. Suffixes are sorted by prefix doubling and
neighbours in that order are joined by decreasing length of their longest common prefix (LCP).
Each class is an ordered set of positions: when two classes are united, a position of the
smaller one becomes the neighbour of at most two of the larger one. Two positions i < j that
become neighbours at LCP l with j - i <= l seed a run: the words from i up to j + l have period
j - i. A run of 4 periods has l >= 3 (j - i) at its first word, and is reported there, once; since no
position of the class lies between, the period is the smallest.

Only texts in which a stretch of three quarters of ``min_words`` words begins twice are sorted
at all, as it does in every wanted run. All texts of a slice are sorted together in numpy.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from itertools import compress
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.llm.common import payload
from tamis.llm.words import numbered, slices, split

PERIODS = 4
BLOCK = 512  # positions of an ordered set that lie in one list
BASE = 0x9E3779B97F4A7C15


def shortest_lcp(min_words: int) -> int:
    """LCP of a wanted run's first two periods, at least."""
    return -(-max(PERIODS, min_words) * (PERIODS - 1) // PERIODS)


def repeated_stretches(number: np.ndarray, text: np.ndarray, left: np.ndarray, length: int) -> np.ndarray:
    """Texts in which a stretch of ``length`` words may begin twice (judged by its hash)."""
    mixed = (number.astype(np.uint64) + np.uint64(1)) * np.uint64(BASE)
    mixed ^= mixed >> np.uint64(29)
    key = text.astype(np.uint64)
    for k in range(length):
        key = (key * np.uint64(0xD6E8FEB86659FD93)) ^ (key >> np.uint64(32))
        key += mixed[np.minimum(np.arange(len(mixed)) + k, len(mixed) - 1)]
    at = np.flatnonzero(left >= length)
    order = at[np.argsort(key[at], kind="stable")]
    same = (key[order[1:]] == key[order[:-1]]) & (text[order[1:]] == text[order[:-1]])
    return np.unique(text[order[1:][same]])


def suffixes(number: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, lcp): the suffixes of all texts sorted by text, then words, and each one's LCP with the one before it.

    A suffix ends with its text; suffixes of different texts have LCP 0.
    """
    n = len(number)
    order = np.lexsort((number, text))
    new = np.ones(n, bool)
    new[1:] = (text[order[1:]] != text[order[:-1]]) | (number[order[1:]] != number[order[:-1]])
    ranks = [np.empty(n, np.int64)]
    ranks[0][order] = np.cumsum(new)
    width = 1
    while not new.all():
        rank, follow = ranks[-1], np.zeros(n, np.int64)
        follow[: n - width] = np.where(text[width:] == text[: n - width], rank[width:], 0) if width < n else 0
        # suffixes whose rank is their own are in place: only the others are sorted on
        alone = np.bincount(rank, minlength=n + 1) == 1
        open_ = np.flatnonzero(~alone[rank[order]])
        moved = order[open_]
        moved = moved[np.lexsort((follow[moved], rank[moved]))]
        order[open_] = moved
        new = np.ones(n, bool)
        new[1:] = (rank[order[1:]] != rank[order[:-1]]) | (follow[order[1:]] != follow[order[:-1]])
        ranks.append(np.empty(n, np.int64))
        ranks[-1][order] = np.cumsum(new)
        width *= 2
    a, b, lcp = order[:-1].copy(), order[1:].copy(), np.zeros(max(0, n - 1), np.int64)
    for k in reversed(range(len(ranks))):
        inside = (a < n) & (b < n)
        same = np.flatnonzero(inside)[ranks[k][a[inside]] == ranks[k][b[inside]]]
        # equal ranks mean equal words, up to the text's end where a suffix is shorter; no two suffixes of a text are equal
        lcp[same] += 1 << k
        a[same] += 1 << k
        b[same] += 1 << k
    return order, np.concatenate((np.zeros(1, np.int64), lcp))[:n]


class Positions:
    """An ordered set of integers in lists of bounded length."""

    __slots__ = ("blocks", "least", "size")

    def __init__(self, first: int) -> None:
        self.blocks, self.least, self.size = [[first]], [first], 1

    def __iter__(self) -> Iterator[int]:
        for block in self.blocks:
            yield from block

    def add(self, x: int) -> tuple[int, int]:
        """Add ``x``; its neighbours below and above, -1 for none."""
        b = max(0, bisect_left(self.least, x) - 1)
        block = self.blocks[b]
        i = bisect_left(block, x)
        below = block[i - 1] if i else -1
        above = block[i] if i < len(block) else self.blocks[b + 1][0] if b + 1 < len(self.blocks) else -1
        block.insert(i, x)
        self.least[b] = block[0]
        self.size += 1
        if len(block) > BLOCK:
            half = len(block) // 2
            self.blocks.insert(b + 1, block[half:])
            self.least.insert(b + 1, block[half])
            del block[half:]
        return below, above


def seeds(order: np.ndarray, lcp: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """(i, j, l): positions that become neighbours in a class, where l, the LCP at that time, is ``least`` or more."""
    edges = np.flatnonzero(lcp >= least)
    edges = edges[np.argsort(-lcp[edges], kind="stable")]
    parent: dict[int, int] = {}
    sets: dict[int, Positions] = {}

    def root(x: int) -> int:
        if x not in parent:
            parent[x], sets[x] = x, Positions(x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b, length in zip(order[edges - 1].tolist(), order[edges].tolist(), lcp[edges].tolist(), strict=True):
        a, b = root(a), root(b)
        if sets[a].size < sets[b].size:
            a, b = b, a
        parent[b] = a
        large, small = sets[a], sets.pop(b)
        own = list(small)
        for before, x, after in zip([-1, *own], own, [*own[1:], -1], strict=False):
            below, above = large.add(x)
            # two of the smaller class were neighbours before, or have one of the larger class between them
            if below >= 0 and below != before:
                yield below, x, length
            if above >= 0 and not 0 <= after < above:
                yield x, above, length


def runs_of(number: np.ndarray, text: np.ndarray, start: np.ndarray, min_words: int) -> np.ndarray:
    """Rows (text, start, length, period) of all wanted runs, in that order; ``start`` is each text's first place."""
    order, lcp = suffixes(number, text)
    found = []
    for i, j, length in seeds(order, lcp, shortest_lcp(min_words)):
        period = j - i
        if (PERIODS - 1) * period > length or length + period < min_words:
            continue
        # a word before that continues the period belongs to a run that begins earlier
        if i == 0 or text[i - 1] != text[i] or number[i - 1] != number[j - 1]:
            found.append((text[i], i - start[text[i]], length + period, period))
    out = np.array(found, np.int64).reshape(-1, 4)
    return out[np.lexsort((out[:, 3], out[:, 1], out[:, 0]))]


def periodic_runs(docs: DataFrame, min_words: int = 6) -> DataFrame:
    """One row per input row: doc_id, runs (start, length, period; by start, then period), collapsed (the text left).

    A run is a maximal stretch of words with smallest period q and a length of at least
    ``min_words`` (4 or more) and 4q. In ``collapsed`` the words of each run after its first q are
    dropped and the others joined by one space. Words are runs of anything but ASCII white space,
    numbered from 0.

    Null and empty texts have no runs and an empty ``collapsed``. Rows that repeat and null
    doc_ids give a row each. Other input columns are ignored. An empty table gives none.
    """
    if min_words < PERIODS:
        raise ValueError(f"min_words must be {PERIODS} or more")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words, starts = split(batch.column("text"))
            lengths = np.diff(starts)
            _, number = numbered(words)
            text = np.repeat(np.arange(batch.num_rows), lengths)
            left = starts[1:][text] - np.arange(len(words))
            held = repeated_stretches(number, text, left, shortest_lcp(min_words)) if words else np.empty(0, np.int64)
            inside = np.flatnonzero(np.isin(text, held))
            found = np.empty((0, 4), np.int64)
            if len(inside):
                first = np.zeros(batch.num_rows, np.int64)
                first[held] = np.searchsorted(text[inside], held)
                found = runs_of(number[inside], text[inside], first, min_words)
            at = starts[found[:, 0]] + found[:, 1]
            n = len(words) + 1
            edge = np.bincount(at + found[:, 3], minlength=n) - np.bincount(at + found[:, 2], minlength=n)
            stay = (np.cumsum(edge)[:-1] == 0).tolist()
            kept = [b" ".join(compress(words[a:b], stay[a:b])) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
            spans = pa.StructArray.from_arrays([pa.array(found[:, c]) for c in (1, 2, 3)], ["start", "length", "period"])
            offsets = pa.array(np.searchsorted(found[:, 0], np.arange(batch.num_rows + 1)).astype(np.int32))
            columns = [batch.column("doc_id"), pa.ListArray.from_arrays(offsets, spans), pa.array(kept, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "runs", "collapsed"])

    slim = payload(docs, "doc_id", "text").select("doc_id", F.col("text").cast("string").alias("text"))
    id_type = dict(slim.dtypes)["doc_id"]
    return slim.mapInArrow(run, f"doc_id {id_type}, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id, text: some texts made periodic from a word on, by the checksum h of the id's decimal form.

    With g = h div 10, a text of n > 0 words whose h is divisible by 10 has each word i from
    a = g mod n on replaced by word a + (i - a) mod p, where p = 1 + (n - a) div (3 + g mod 8). A
    null id changes nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            hashes = [crc32(str(x).encode()) if x is not None else 1 for x in ids.to_pylist()]
            out = {}
            for row, h in enumerate(hashes):
                words = (texts[row].as_py() or "").encode().split() if h % 10 == 0 else []
                if words:
                    n, g = len(words), h // 10
                    a = g % n
                    p = 1 + (n - a) // (3 + g % 8)
                    tail = words[a : a + p]
                    out[row] = b" ".join((words[:a] + tail * (-(-(n - a) // p)))[:n])
            changed = pa.array([out.get(row) for row in range(batch.num_rows)], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([ids, pa.compute.coalesce(changed, texts)], ["doc_id", "text"])

    slim = payload(docs, "doc_id", "text").select("doc_id", F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(run, f"doc_id {dict(slim.dtypes)['doc_id']}, text string")


def digest(found: DataFrame) -> DataFrame:
    def sha(text: Column) -> Column:
        return F.sha2(text.cast("binary"), 256)

    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    order = F.transform("runs", lambda r: F.struct((-r["length"]).alias("shorter"), r["start"].alias("start"), r["period"].alias("period")))
    best = F.array_min(order)
    thousand = F.lit(1000) * -best["shorter"]
    exponent = ((thousand - thousand % best["period"]) / best["period"]).cast("long")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), (-best["shorter"]).alias("length"),
        best["period"].alias("period"), exponent.alias("exponent_milli"),
        sha(F.array_join(lines, "")).alias("runs_sha256"), sha(F.col("collapsed")).alias("collapsed_sha256"),
    )
