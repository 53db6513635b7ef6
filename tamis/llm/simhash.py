"""SimHash near-duplicate groups through anchor points of a covering code.

Fingerprints are cut into two halves of 32 bits: of at most ``max_bits`` differing bits one
half holds at most ``max_bits // 2``. In a half the anchors are the words of a perfect
Hamming code on its first 31 bits, with the last bit free: every half lies within covering
radius 1 of an anchor. Two halves at distance t have a midpoint at most ceil(t / 2) from
both, and that midpoint has an anchor within 1, so replicating each fingerprint to every
anchor within 1 + ceil(t / 2) makes each linked pair meet at some anchor (this is the
covering radius plus threshold, shared between the two sides: 17 anchors at most for
t = 2 where the one-sided form needs 157). Pairs are compared in full at their anchors.

Exact copies share a fingerprint and are one node. An anchor's fingerprints are compared
in numpy blocks of one task and only a spanning forest of their links is emitted; an
anchor with more than ``cell_rows`` fingerprints is cut into chunks whose pairs of chunks
are separate cells, so no task ever holds more than two chunks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamis.llm.common import payload, settle
from tamis.llm.components import connected_components

CODE = 31  # bits of a half that the Hamming code covers
SMALL = 32  # groups up to this size are compared by shifting whole batches


def fingerprint(words: list[bytes], shingle: int) -> bytes:
    """Eight bytes, most significant first; none set for no words."""
    import xxhash

    if not words:
        return bytes(8)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_digest
    span = zip(starts[:last].tolist(), ends[min(shingle, len(words)) - 1 :].tolist(), strict=True)
    hashes = b"".join([digest(joined[a:b], 42) for a, b in span])
    counts = np.unpackbits(np.frombuffer(hashes, np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return np.packbits(2 * counts > last).tobytes()


def fingerprints(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, h, fp): a hash of each row's text and its 64-bit fingerprint, as longs.

    Words are runs of anything but ASCII white space, A-Z lower-cased; shingles count with
    their repeats. Null and empty texts have fingerprint zero.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = bytearray()
            for text in batch.column(2).cast(pa.binary()):
                out += fingerprint((text.as_py() or b"").lower().split(), shingle)
            fps = np.frombuffer(bytes(out), ">u8").astype(np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps)], ["doc_id", "h", "fp"])

    text = F.col("text").cast("string")
    slim = payload(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("h"), text.alias("text"))
    return slim.mapInArrow(run, "doc_id long, h long, fp long")


def flip_table(reach: int) -> list[np.ndarray]:
    """For each syndrome of the Hamming code, the masks of at most ``reach`` flips that lead to a code word."""
    masks: list[list[int]] = [[] for _ in range(CODE + 1)]
    for n in range(reach + 1):
        for flips in combinations(range(1, CODE + 1), n):
            syndrome = 0
            for p in flips:
                syndrome ^= p
            masks[syndrome].append(sum(1 << (p - 1) for p in flips))
    return [np.array(m, np.uint64) for m in masks]


def anchors(halves: np.ndarray, spread: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor) for every anchor within covering radius 1 plus ``spread`` of each 32-bit half."""
    low = halves & np.uint64(2**CODE - 1)
    syndrome = np.zeros(len(halves), np.int64)
    for p in range(1, CODE + 1):
        syndrome ^= np.where(low >> np.uint64(p - 1) & np.uint64(1), p, 0)
    rows, found = [], []
    # the free bit may use up one unit of the spread
    for free, reach in [(0, 1 + spread)] + ([(1, spread)] if spread else []):
        masks = flip_table(reach)
        for s in np.unique(syndrome):
            at = np.flatnonzero(syndrome == s)
            rows.append(np.repeat(at, len(masks[s])))
            found.append((halves[at, None] ^ masks[s][None, :] ^ np.uint64(free << CODE)).ravel())
    if not rows:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    return np.concatenate(rows), np.concatenate(found)


def replicas(nodes: DataFrame, max_bits: int) -> DataFrame:
    """(key, fp): each fingerprint at each of its anchors; the key holds the half and the anchor."""
    spread = (max_bits // 2 + 1) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for half in (0, 1):
                rows, at = anchors(fps >> np.uint64(32 * half) & np.uint64(2**32 - 1), spread)
                key = (at | np.uint64(half << 32)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fps[rows].view(np.int64))], ["key", "fp"])

    return nodes.select("fp").mapInArrow(run, "key long, fp long")


def merge_labels(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Join the classes of i and j; labels are always roots, the smallest index of their class."""
    while True:
        a, b = labels[i], labels[j]
        open_ = a != b
        if not open_.any():
            return labels
        np.minimum.at(labels, np.maximum(a, b)[open_], np.minimum(a, b)[open_])
        while (up := labels[labels]).tobytes() != labels.tobytes():
            labels = up
        i, j = i[open_], j[open_]


def forest(keys: np.ndarray, fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what is linked inside each run of equal keys; at most one per row."""
    n = len(keys)
    labels = np.arange(n)
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if n else np.empty(0, np.int64)
    sizes = np.diff(np.append(starts, n))
    left, right = [], []
    for k in range(1, min(SMALL, int(sizes.max(initial=0)))):
        near = (keys[k:] == keys[:-k]) & (np.bitwise_count(fps[k:] ^ fps[:-k]) <= max_bits)
        at = np.flatnonzero(near)
        left.append(at)
        right.append(at + k)
    if left:
        labels = merge_labels(labels, np.concatenate(left), np.concatenate(right))
    for start, size in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist(), strict=True):
        group = fps[start : start + size]
        step = max(1, 2**21 // size)
        for a in range(0, size, step):
            i, j = np.nonzero(np.bitwise_count(group[a : a + step, None] ^ group[None, a:]) <= max_bits)
            labels = merge_labels(labels, start + a + i, start + a + j)
    moved = np.flatnonzero(labels != np.arange(n))
    return fps[moved], fps[labels[moved]]


def links(nodes: DataFrame, max_bits: int, cell_rows: int = 32_768) -> DataFrame:
    """(u, v): links between distinct fingerprints whose components are those of all links."""
    spread = replicas(nodes, max_bits)
    large = settle(
        spread.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > cell_rows)
        .select("key", F.ceil(F.col("n") / cell_rows).cast("int").alias("chunks"))
    )
    if large.isEmpty():
        cells = spread.withColumn("cell", F.lit(0).cast("long"))
    else:
        chunk = F.pmod(F.xxhash64("fp"), "chunks").cast("long")
        other = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("chunks", F.lit(1)) - 1))
        cells = (
            spread.join(large, "key", "left")
            .select("key", "fp", "chunks", F.coalesce(chunk, F.lit(0)).alias("a"), other.alias("b"))
            .select("key", "fp", (F.least("a", "b") * 2**31 + F.greatest("a", "b")).alias("cell"))
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, cell, fps = (np.empty(0, t) for t in (np.int64, np.int64, np.uint64))
        for batch in batches:
            k, c, f = (batch.column(x).to_numpy(zero_copy_only=False) for x in range(3))
            keys, cell, fps = np.append(keys, k), np.append(cell, c), np.append(fps, f.view(np.uint64))
            ends = np.flatnonzero((keys[1:] != keys[:-1]) | (cell[1:] != cell[:-1]))
            done = int(ends[-1]) + 1 if len(ends) else 0
            if done:
                yield out(keys[:done], cell[:done], fps[:done])
                keys, cell, fps = keys[done:], cell[done:], fps[done:]
        if len(keys):
            yield out(keys, cell, fps)

    def out(keys: np.ndarray, cell: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        group = np.cumsum(np.concatenate(([0], (keys[1:] != keys[:-1]) | (cell[1:] != cell[:-1]))))
        u, v = forest(group, fps, max_bits)
        return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

    dealt = cells.select("key", "cell", "fp").repartition("key", "cell").sortWithinPartitions("key", "cell")
    return dealt.mapInArrow(run, "u long, v long").distinct()


def grouped(docs: DataFrame, shingle: int, max_bits: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, h, fp) of every row, and (fp, first): the first row (unnamed, doc_id, h) of each fingerprint's group."""
    if not 0 <= max_bits <= 5:
        raise ValueError("max_bits must be 0 to 5")
    prints = settle(fingerprints(docs, shingle))
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "h")
    nodes = settle(prints.groupBy("fp").agg(F.min(place).alias("own")))
    roots = connected_components(links(nodes, max_bits))
    rooted = settle(nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "own", F.coalesce("root", "fp").alias("root")))
    firsts = rooted.groupBy("root").agg(F.min("own").alias("first"))
    return prints, rooted.join(firsts, "root").select("fp", "first")


def near_duplicate_groups(docs: DataFrame, shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id.

    Fingerprints of at most ``max_bits`` (0 to 5) differing bits are linked; component_id is
    the smallest doc_id that can be reached. Null or empty texts have fingerprint zero and
    are linked like any other. Rows with a null doc_id take part; a component of such rows alone
    has a null id. Repeated doc_ids give a row each. Other input columns are ignored. An empty
    table gives an empty result.
    """
    prints, groups = grouped(docs, shingle, max_bits)
    out = prints.join(groups, "fp", "left")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("first.doc_id").alias("component_id"))


def one_of_each_group(docs: DataFrame, shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """The input rows, with all their columns, that come first in their group.

    First is the smallest doc_id, null ids last, then the smallest hash of the text. Of rows
    that agree in id and text one stays.
    """
    prints, groups = grouped(docs, shingle, max_bits)
    first = groups.select("first").distinct().select("first.doc_id", "first.h")
    same = prints["doc_id"].eqNullSafe(first["doc_id"]) & (prints["h"] == first["h"])
    counted = prints.join(first, same, "left_semi").groupBy("doc_id", "h").agg(F.count("*").alias("copies"))
    kept = settle(counted.select(F.col("doc_id").alias("__id"), F.col("h").alias("__h"), F.col("copies").alias("__n")))
    own = docs["doc_id"].cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(docs["text"].cast("string")) == F.col("__h"))
    found = docs.join(kept, own)
    rows = found.where("__n = 1").select(*(docs[c] for c in docs.columns))
    if kept.where("__n > 1").isEmpty():
        return rows
    copies = found.where("__n > 1").dropDuplicates(["__id", "__h"]).select(*(docs[c] for c in docs.columns))
    return rows.unionAll(copies)
