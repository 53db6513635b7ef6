"""Substring dedup: repeated windows of words, found through difference-cover anchors.

The cover is a perfect difference set: of any two places there is a shift below its period
that takes both to cover positions. Two equal windows of 35 words therefore share an anchor,
a stretch of 15 words that begins at a cover position (modulo 21) of both documents and lies
at the same place in both windows. So only 5 of 21 positions are hashed in the first pass,
and an anchor that is found once in the corpus can't lie in a repeated window at its place.

Matched anchors are then extended: each window that holds one is hashed in full (128 bits),
and the windows whose hash is found more than once are the repeated ones. Windows without a
matched anchor are never hashed to the network.

Documents lie in chunks of bounded size, in the checkpoint folder. A chunk sends each hash
once, with its first place there and whether it is there again, and gets back the places of
those found anywhere else; so a passage that a third of all documents share is one row a
chunk, and no task collects its copies. Whole texts are looked for in the same way first: of equal
texts one alone sends its anchors, and all lose their words.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations, compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tamis.llm.common import payload, settle
from tamis.llm.words import numbered, slices, split

WINDOW = 35
CHUNK_BYTES = 8_000_000  # of text; a longer text is a chunk of its own
PLACE_BITS = 30  # of a tag: a spot; a chunk has fewer than 2 ** 29 words
CHUNK_BITS = 13  # of a chunk's number: chunks of a partition, 64 GB of text
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)  # odd, for the two halves of a hash


@cache
def difference_cover(window: int) -> tuple[int, np.ndarray]:
    """(period, positions): a perfect difference set with a period of at most 0.6 windows."""
    q = max(q for q in (0, 1, 2, 3, 4, 5) if q * q + q + 1 <= max(1, 0.6 * window))
    period = q * q + q + 1
    for rest in combinations(range(1, period), q):
        cover = np.array((0, *rest))
        if len(np.unique((cover[:, None] - cover) % period)) == period:
            return period, cover
    raise ValueError(f"no perfect difference set of period {period}")


def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows as compressed chunks."""
    held: list[pa.RecordBatch] = []

    def sealed() -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=7))) as writer:
            writer.write_table(table)
        return pa.RecordBatch.from_pydict({"blob": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

    size = number = 0
    for rows in slices(batches, "text", CHUNK_BYTES):
        held.append(rows)
        size += rows.column("text").nbytes
        if size >= CHUNK_BYTES:
            yield sealed()
            held, size, number = [], 0, number + 1
            if number >= 1 << CHUNK_BITS:
                raise ValueError("a partition holds too many chunks: repartition the documents")
    if held:
        yield sealed()


def unpack(blob: bytes) -> pa.Table:
    with pa.ipc.open_stream(pa.py_buffer(blob)) as reader:
        return reader.read_all().combine_chunks()


def powers(base: int, n: int) -> np.ndarray:
    """1, base, base squared, ... modulo 2 ** 64."""
    return np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, base, np.uint64))))[:n]


class Chunk:
    """The words of a chunk's texts and the hashes of their windows."""

    def __init__(self, blob: bytes) -> None:
        import xxhash

        table = unpack(blob)
        self.ids = table.column("doc_id").combine_chunks()
        self.words, self.starts = split(table.column("text").combine_chunks())
        distinct, self.number = numbered(self.words)
        self.hashes = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, distinct)), np.uint64).reshape(-1, 2)
        self.lengths = np.diff(self.starts)
        texts = b"".join(xxhash.xxh3_128_digest(t.as_py() or b"") for t in table.column("text").combine_chunks().cast(pa.binary()))
        self.texts = tuple(np.frombuffer(texts, np.int64).reshape(-1, 2).T)
        self.place = np.arange(len(self.words)) - np.repeat(self.starts[:-1], self.lengths)
        self.left = np.repeat(self.lengths, self.lengths) - self.place  # words up to the text's end, this one included

    def rolled(self, half: int, length: int) -> np.ndarray:
        """Polynomial hash of the ``length`` words from each word on; only those inside a text mean anything."""
        n, base = len(self.words), BASES[half]
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.hashes[self.number, half] * powers(base, n), out=sums[1:])
        ends = np.minimum(np.arange(n) + length, n)
        return (sums[ends] - sums[:n]) * powers(pow(base, -1, 2**64), n)

    def long_texts(self, window: int) -> tuple[np.ndarray, ...]:
        """Rows whose text holds a window, and the two halves of the text's hash."""
        at = np.flatnonzero(self.lengths >= window)
        return at, *(half[at] for half in self.texts)

    def copied(self, window: int, rows: np.ndarray) -> np.ndarray:
        """Which texts are copies; ``rows`` has one row of each text that is there again, here or in another chunk."""
        at, *halves = self.long_texts(window)
        out = np.zeros(len(self.lengths), bool)
        out[at] = among(tuple(halves), tuple(half[rows] for half in self.texts))
        return out

    def anchors(self, window: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of the anchors and their hashes."""
        period, cover = difference_cover(window)
        length = window - period + 1
        held = np.zeros(period, bool)
        held[cover] = True
        # texts that hold no window have no anchors either
        at = np.flatnonzero(held[self.place % period] & (self.left >= length) & (self.place + self.left >= window))
        return at, self.rolled(0, length)[at].view(np.int64)

    def extended(self, window: int, matched: np.ndarray) -> np.ndarray:
        """Places of the windows that hold a matched anchor; ``matched`` has one place of each matched hash."""
        period, _ = difference_cover(window)
        at, hashes = self.anchors(window)
        at = at[np.isin(hashes, hashes[np.searchsorted(at, matched)])]
        n = len(self.words)
        begins = np.maximum(at - period + 1, at - self.place[at])
        edge = np.bincount(begins, minlength=n + 1) - np.bincount(at + 1, minlength=n + 1)
        return np.flatnonzero((np.cumsum(edge)[:n] > 0) & (self.left >= window))

    def windows(self, window: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return tuple(self.rolled(half, window)[at].view(np.int64) for half in (0, 1))

    def covered(self, window: int, repeated: np.ndarray) -> np.ndarray:
        """Which words lie in a repeated window; ``repeated`` has one place of each repeated hash."""
        n = len(self.words)
        at = np.flatnonzero(self.left >= window)
        every = self.windows(window, at)
        known = np.searchsorted(at, repeated)
        at = at[among(every, tuple(half[known] for half in every))]
        edge = np.bincount(at, minlength=n + 1) - np.bincount(at + window, minlength=n + 1)
        return np.cumsum(edge)[:n] > 0


def among(pairs: tuple[np.ndarray, np.ndarray], known: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Which of the pairs are among the known ones."""
    order = np.lexsort((known[1], known[0]))
    a, b = known[0][order], known[1][order]
    found = np.zeros(len(pairs[0]), bool)
    at = np.searchsorted(a, pairs[0])
    while len(a):
        here = np.minimum(at, len(a) - 1)
        same = (at < len(a)) & (a[here] == pairs[0])
        found |= same & (b[here] == pairs[1])
        if not (same & ~found).any():
            break
        at = at + 1  # another known pair with the same first half
    return found


def spots(places: np.ndarray, *hashes: np.ndarray) -> list[np.ndarray]:
    """One spot for each distinct hash, in order of place: twice its first place, plus one if it is there again; then the hashes."""
    order = np.lexsort(hashes[::-1]) if len(hashes) > 1 else np.argsort(hashes[0], kind="stable")
    held = [h[order] for h in hashes]
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.any([h[1:] != h[:-1] for h in held], axis=0)
    first = np.flatnonzero(new)
    again = np.diff(np.append(first, len(order))) > 1
    by_place = np.argsort(order[first], kind="stable")
    first, again = first[by_place], again[by_place]
    return [places[order[first]] * 2 + again, *(h[first] for h in held)]


def tagged(chunk: int, spot: np.ndarray) -> pa.Array:
    return pa.array((chunk << PLACE_BITS) | spot)


def found_again(rows: DataFrame, *keys: str) -> DataFrame:
    """(chunk, spot, first) of the hashes found more than once, in one chunk or in several; rows are one a hash and chunk.

    ``first`` marks one row of each hash.
    """
    same, spot = Window.partitionBy(*keys), F.col("tag").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    held = rows.withColumn("everywhere", F.sum(spot % 2 + 1).over(same)).withColumn("least", F.min("tag").over(same))
    found = held.where("everywhere > 1")
    return found.select(F.shiftright("tag", PLACE_BITS).alias("chunk"), spot.alias("spot"), (F.col("tag") == F.col("least")).alias("first"))


def without_repeated_substrings(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per input row: doc_id, n_words, removed (spans of words: start, length), kept (the text left).

    Words are runs of anything but ASCII white space, unchanged. Each word is removed that lies
    in a window of ``window`` consecutive words of one document whose sequence also begins
    anywhere else, in the same document or another; windows are judged on the input. All
    copies go, the first as well. ``kept`` joins the words left by one space.

    Null and empty texts have no words and an empty ``kept``. Rows that repeat, with or without
    their doc_id, are copies of each other. Null doc_ids are kept. Texts with fewer words
    than the window keep all. Other input columns are ignored. An empty table gives none.
    """
    slim = payload(docs, "doc_id", "text").select("doc_id", F.col("text").cast("string").alias("text"))
    number = F.monotonically_increasing_id()  # 33 bits of it count a partition's rows
    compact = F.shiftleft(F.shiftright(number, 33), CHUNK_BITS).bitwiseOR(number.bitwiseAND(F.lit((1 << CHUNK_BITS) - 1)))
    chunks = settle(slim.mapInArrow(pack, "blob binary")).withColumn("chunk", compact)

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob, chunk in zip(batch.column("blob"), batch.column("chunk").to_pylist(), strict=True):
                spot, a, b = spots(*Chunk(blob.as_py()).long_texts(window))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), tagged(chunk, spot)], ["a", "b", "tag"])

    def opened(chunk: pa.Table) -> tuple[int, Chunk]:
        return chunk.column("chunk")[0].as_py(), Chunk(chunk.column("blob")[0].as_py())

    def anchors(chunk: pa.Table, copies: pa.Table) -> pa.Table:
        number, words = opened(chunk)
        rows, first = copies.column("spot").to_numpy() // 2, copies.column("first").to_numpy()
        sends = ~words.copied(window, rows)
        sends[rows[first]] = True
        at, hashes = words.anchors(window)
        sent = np.repeat(sends, words.lengths)[at]
        spot, hashes = spots(at[sent], hashes[sent])
        return pa.table([pa.array(hashes), tagged(number, spot)], names=["hash", "tag"])

    def candidates(chunk: pa.Table, matched: pa.Table) -> pa.Table:
        if not matched.num_rows:
            return pa.table([pa.array([], pa.int64())] * 3, names=["a", "b", "tag"])
        number, words = opened(chunk)
        at = words.extended(window, matched.column("spot").to_numpy() // 2)
        spot, a, b = spots(at, *words.windows(window, at))
        return pa.table([pa.array(a), pa.array(b), tagged(number, spot)], names=["a", "b", "tag"])

    id_type = dict(slim.dtypes)["doc_id"]

    def remove(chunk: pa.Table, repeated: pa.Table) -> pa.Table:
        _, words = opened(chunk)
        rows, whole = repeated.column("spot").to_numpy() // 2, repeated.column("whole").to_numpy()
        gone = words.covered(window, rows[~whole]) | np.repeat(words.copied(window, rows[whole]), words.lengths)
        before = np.concatenate(([False], gone[:-1])) & (words.place > 0)
        after = np.concatenate((gone[1:], [False])) & (words.left > 1)
        first, last = np.flatnonzero(gone & ~before), np.flatnonzero(gone & ~after)
        spans = pa.StructArray.from_arrays([pa.array(words.place[first]), pa.array(last - first + 1)], ["start", "length"])
        offsets = np.searchsorted(first, words.starts).astype(np.int32)
        stay, kept = (~gone).tolist(), []
        for a, b in zip(words.starts[:-1].tolist(), words.starts[1:].tolist(), strict=True):
            kept.append(b" ".join(compress(words.words[a:b], stay[a:b])))
        columns = [words.ids, pa.array(words.lengths), pa.ListArray.from_arrays(pa.array(offsets), spans), pa.array(kept, pa.binary()).cast(pa.string())]
        return pa.table(columns, names=["doc_id", "n_words", "removed", "kept"])

    def by_chunk(rows: DataFrame, fn, schema: str) -> DataFrame:
        return chunks.groupBy("chunk").cogroup(rows.groupBy("chunk")).applyInArrow(fn, schema)

    copies = found_again(chunks.mapInArrow(texts, "a long, b long, tag long"), "a", "b")
    matched = found_again(by_chunk(copies, anchors, "hash long, tag long"), "hash")
    repeated = found_again(by_chunk(matched, candidates, "a long, b long, tag long"), "a", "b")
    marked = repeated.withColumn("whole", F.lit(False)).unionAll(copies.withColumn("whole", F.lit(True)))
    return by_chunk(marked.drop("first"), remove, f"doc_id {id_type}, n_words long, removed array<struct<start:long,length:long>>, kept string")


def digest(cleaned: DataFrame) -> DataFrame:
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda total, span: total + span["length"])
    return cleaned.select("doc_id", "n_words", gone.alias("n_removed"), F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
