"""Line dedup: repeated runs of lines, found by a suffix array over sequences of line ids.

Lines that occur once end every repeated run, so the sequences are the stretches of repeated lines,
and stretches with fewer than ``min_words`` words are left out. Prefix doubling ranks the
suffixes of the stretches by their first 1, 2, 4, ... lines: in each round the distinct
pairs (rank, rank of the suffix as many lines further) are range-partitioned and sorted,
and their places are the next ranks.

Suffixes that share m lines are one interval of longest common prefix of at least m; two
overlapping ranks of 2^k lines name it. A repeated run of ``min_words`` words or more is the
union of the shortest such runs that start at, or end at, each of its lines, so the
intervals of these lengths reveal every maximal run. In each interval the first occurrence
stays and the later ones are deleted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamis.llm.common import payload, settle

MIN_WORDS = 50
BROADCAST_ROWS = 1_000_000  # of 16 bytes


def text_of(docs: DataFrame) -> Column:
    return F.coalesce(docs["text"].cast("string"), F.lit(""))


def small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def line_table(docs: DataFrame) -> DataFrame:
    """(doc_id, h, at, i, line): lines that aren't blank, ``at`` counting them, ``i`` all lines; h is the text's hash."""
    held = F.filter(
        F.transform(F.split("text", "\n", -1), lambda line, i: F.struct(i.alias("i"), F.trim(line).alias("line"))), lambda x: x["line"] != ""
    )
    slim = payload(docs, "doc_id", "text").select("doc_id", text_of(docs).alias("text"))
    return slim.select("doc_id", F.xxhash64("text").alias("h"), F.posexplode(held).alias("at", "x")).select(
        "doc_id", "h", "at", "x.i", "x.line", F.xxhash64("x.line").alias("a"), F.xxhash64(F.lit(1), "x.line").alias("b")
    )


def ranked(pairs: DataFrame, name: str) -> DataFrame:
    """The distinct rows of two columns with their rank: a number that grows with their order.

    The places are numbered inside sorted range partitions, so no task sees all rows; the
    table is written before it is used, so the numbers hold.
    """
    a, b = pairs.columns
    ordered = pairs.distinct().repartitionByRange(a, b).sortWithinPartitions(a, b)
    return settle(ordered.withColumn(name, F.monotonically_increasing_id()))


def stretches(docs: DataFrame, min_words: int) -> DataFrame:
    """(doc_id, h, part, at, i, words, r0): lines of stretches of repeated lines that hold enough words; r0 ranks the line."""
    lines = line_table(docs)
    repeated = settle(lines.groupBy("a", "b").count().where("count > 1").select("a", "b"))
    held = lines.join(small(repeated, repeated.count()), ["a", "b"])
    words = F.regexp_count("line", F.lit(r"\S+")).alias("words")
    # rows that repeat with id and text are one document
    held = held.select("doc_id", "h", "at", "i", words, "a", "b").dropDuplicates(["doc_id", "h", "at"])
    in_doc = Window.partitionBy("doc_id", "h")
    parts = held.withColumn("part", F.col("at") - F.row_number().over(in_doc.orderBy("at")))
    total = F.sum("words").over(Window.partitionBy("doc_id", "h", "part"))
    long = settle(parts.withColumn("total", total).where(F.col("total") >= min_words).drop("total"))
    return long.join(ranked(long.select("a", "b"), "r0"), ["a", "b"]).drop("a", "b")


def doubled(lines: DataFrame, longest: int) -> DataFrame:
    """Adds ranks r1, r2, ... of the first 2, 4, ... lines, until two of them cover ``longest`` lines."""
    inside = Window.partitionBy("doc_id", "h", "part").orderBy("at")
    k = 0
    while 2 ** (k + 1) <= longest:
        # a stretch's end sorts before any line
        lines = lines.withColumn("next", F.coalesce(F.lead(f"r{k}", 2**k).over(inside), F.lit(-1)))
        lines = settle(lines)
        ranks = ranked(lines.select(f"r{k}", "next"), f"r{k + 1}")
        lines = lines.join(ranks, [f"r{k}", "next"]).drop("next")
        k += 1
    return lines


def shortest_runs(words: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the shortest runs with enough words from each line on, and up to each line."""
    ends = np.cumsum(words)
    starts = ends - words
    forward = np.searchsorted(ends, starts + min_words, side="left") + 1
    s = np.flatnonzero(forward <= len(words))
    backward = np.searchsorted(starts, ends - min_words, side="right") - 1
    e = np.flatnonzero(backward >= 0)
    both = np.concatenate((np.stack((s, forward[s] - s)), np.stack((backward[e], e + 1 - backward[e]))), axis=1)
    return tuple(np.unique(both, axis=1))


def longest_run(lines: DataFrame, min_words: int) -> int:
    """Lines of the longest of the shortest runs; lines without words (of tabs, say) make it longer than ``min_words``."""
    words = F.transform(F.array_sort(F.collect_list(F.struct("at", "words"))), lambda x: x["words"]).alias("words")
    parts = lines.groupBy("doc_id", "h", "part").agg(F.min("words").alias("least"), words).where("least = 0").select("words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0)
            words, offsets = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), column.offsets.to_numpy()
            offsets = offsets - offsets[0]
            longest = [shortest_runs(words[a:b], min_words)[1].max(initial=0) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(longest, pa.int64())], ["m"])

    # a run of min_words words has at most as many lines with words
    return max(min_words, parts.mapInArrow(run, "m long").agg(F.max("m")).first()[0] or 0)


def run_intervals(lines: DataFrame, levels: int, min_words: int) -> DataFrame:
    """(doc_id, h, start, lines, m, x, y): the shortest runs of each stretch and the interval (m, x, y) of each."""
    ranks = [f"r{k}" for k in range(levels)]
    parts = lines.groupBy("doc_id", "h", "part").agg(F.array_sort(F.collect_list(F.struct("at", "i", "words", *ranks))).alias("lines"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(2).flatten()
            offsets = batch.column(2).offsets.to_numpy()
            at, i, words, *levels_of = (flat.field(c).to_numpy(zero_copy_only=False) for c in range(3 + len(ranks)))
            out: list[list[np.ndarray]] = [[], [], [], [], [], []]
            table = np.stack(levels_of)
            for row, (a, b) in enumerate(zip(offsets[:-1] - offsets[0], offsets[1:] - offsets[0], strict=True)):
                s, m = shortest_runs(words[a:b].astype(np.int64), min_words)
                k = np.frexp(m)[1] - 1
                found = (np.full(len(s), row), at[a:b][s], i[a:b][s], m, table[k, a + s], table[k, a + s + m - (1 << k)])
                for column, values in zip(out, found, strict=True):
                    column.append(values)
            row, start, first, m, x, y = (np.concatenate(c) if c else np.empty(0, np.int64) for c in out)
            docs = [batch.column(c).take(pa.array(row.astype(np.int64))) for c in range(2)]
            rest = [pa.array(c.astype(np.int64)) for c in (start, m, x, y)]
            yield pa.RecordBatch.from_arrays([*docs, *rest], ["doc_id", "h", "start", "m", "x", "y"])

    slim = parts.select("doc_id", "h", "lines")
    return slim.mapInArrow(run, f"doc_id {dict(slim.dtypes)['doc_id']}, h long, start long, m long, x long, y long")


def later_copies(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, h, i): lines, by their place in the text, that lie in a repeated run with an earlier copy."""
    lines = settle(stretches(docs, min_words))
    wordless = lines.where("words = 0").limit(1).count()
    ranks = doubled(lines, longest_run(lines, min_words) if wordless else min_words)
    levels = sum(c[0] == "r" and c[1:].isdigit() for c in ranks.columns)
    runs = settle(run_intervals(ranks, levels, min_words))
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "h", "start")
    shared = runs.groupBy("m", "x", "y").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = runs.join(shared, ["m", "x", "y"]).where(~place.eqNullSafe(F.col("first")))
    span = F.explode(F.sequence(F.col("start").cast("int"), (F.col("start") + F.col("m") - 1).cast("int")))
    gone = later.select(F.col("doc_id").alias("d"), F.col("h").alias("g"), span.alias("n")).distinct()
    same = lines["doc_id"].eqNullSafe(gone["d"]) & (lines["h"] == gone["g"]) & (lines["at"] == gone["n"])
    return lines.join(gone, same, "left_semi").select("doc_id", "h", "i")


def without_repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The input rows with later copies of repeated line runs deleted from ``text``.

    Adds n_lines and removed (places of the deleted lines, in order); input columns of these
    names are replaced. A run is a
    sequence of lines that aren't blank, equal but for spaces at their ends, of ``min_words`` words
    or more; it is a later copy if the same run begins earlier, by doc_id (null ids last),
    then text hash, then line. Copies may lie in one document and may overlap. Null texts
    count as empty and become empty; rows that agree in id and text are one document and
    keep or lose the same lines. A text that loses nothing is unchanged; one that loses all
    its lines becomes empty. An empty table gives an empty table.
    """
    gone = later_copies(docs, min_words).groupBy("doc_id", "h").agg(F.array_sort(F.collect_list("i")).alias("gone"))
    gone = settle(gone.select(F.col("doc_id").alias("gone_id"), F.col("h").alias("gone_h"), "gone"))
    held = small(gone, gone.agg(F.sum(F.size("gone") + 3)).first()[0] or 0)
    text = text_of(docs)
    joined = docs.join(held, docs["doc_id"].eqNullSafe(held["gone_id"]) & (F.xxhash64(text) == held["gone_h"]), "left")
    # a column of its own, so that it is split once
    joined = joined.withColumn("__lines", F.split(text, "\n", -1))
    every = F.col("__lines")
    kept = F.array_except(F.sequence(F.lit(0), F.size(every) - 1), held["gone"])
    rest = F.array_join(F.transform(kept, lambda i: F.get(every, i)), "\n")
    new = {
        "text": F.when(held["gone"].isNull(), text).otherwise(rest),
        "n_lines": F.size(every).cast("long"),
        "removed": F.coalesce(held["gone"], F.array().cast("array<int>")),
    }
    columns = [new.pop(c).alias(c) if c in new else docs[c] for c in docs.columns]
    return joined.select(*columns, *(value.alias(name) for name, value in new.items()))


def digest(cleaned: DataFrame) -> DataFrame:
    return cleaned.select(
        "doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256")
    )
