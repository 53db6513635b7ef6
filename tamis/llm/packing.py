"""Mixture-controlled packing of token sequences by deficit round-robin over source queues.

Every source has a queue of its documents' tokens and a target share of the tokens of each
window (one sequence of ``length`` tokens). With each window a queue earns its share; from
``quantum`` earned tokens on it is served in its turn, cutting documents as needed. What a
queue is not given stays its deficit for later windows; what fills a window in a missing
source's place is borrowed and counts against the lender's later turns.

Documents are dealt to partitions by hash, so each holds about the whole mixture, and are
tokenised and packed there in one pass. What doesn't fill a last window goes, with the
deficits, to a second pass that joins the rest of ``JOINED`` partitions. The final rest of
each is cut at powers of two, so no sequence holds padding.
"""

from __future__ import annotations

import re
import zlib
from array import array
from base64 import b64decode
from collections import deque
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamis.llm.common import payload, settle

END_ID = 1
AHEAD = 8  # windows of tokens that are waited for before packing
HELD = 4_000_000  # tokens that a task holds at most while a source that is due has too few
JOINED = 64  # partitions whose rest is packed together
QUEUES = 1_024  # sources with a queue of their own; smaller ones share the last
FIELDS = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

# The pre-tokeniser's expression and the special token of the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPECIAL = {"<|endoftext|>": 50256}
SPACE = "[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"  # the expression's \\s
RUN = 500_000  # white-space characters in a row from which the slower library encodes; tiktoken fails at about twice as many
LONG = re.compile(f"(?<!{SPACE}){SPACE}{{{RUN},}}")
NEXT = re.compile(SPACE)


class Encoder:
    """Token ids as little-endian 32-bit bytes; ``full`` gives the vocabulary as ``tokenizers`` reads it, when it is needed."""

    def __init__(self, ranks: bytes, full: Callable[[], bytes]):
        import tiktoken

        self.full, self.slow = full, None
        pairs = (line.split() for line in ranks.splitlines())
        mergeable = {b64decode(token): int(rank) for token, rank in pairs}
        self.model = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=mergeable, special_tokens=SPECIAL)

    def encode(self, text: str) -> bytes:
        """A special token's text inside is that token, as the vocabulary's own library has it."""
        try:
            return array("I", self.model.encode(text, allowed_special="all")).tobytes()
        except ValueError:  # its expression's stack is full
            runs = [m.span() for m in LONG.finditer(text)]
            if not runs:
                raise
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_buffer(self.full())
        out, at = [], 0
        # no piece reaches over the begin of white space, so texts may be cut there
        for begin, end in runs:
            out.append(self.encode(text[at:begin]))
            following = NEXT.search(text, end)
            at = following.start() if following else len(text)
            out.append(array("I", self.slow.encode(text[begin:at], add_special_tokens=False).ids).tobytes())
        return b"".join([*out, self.encode(text[at:])])


class Packer:
    """Source queues, what each has earned, and the pieces packed so far."""

    def __init__(self, shares: list[float], length: int, quantum: int, base: int):
        self.shares, self.length, self.quantum = shares, length, quantum
        self.queues: list[deque] = [deque() for _ in shares]
        self.waiting = [0] * len(shares)
        self.total = 0
        self.deficit = [0.0] * len(shares)
        self.turn = 0
        self.sequence = base
        self.pieces: list[tuple] = []

    def add(self, queue: int, doc_id, ids: bytes, start: int = 0, doc_tokens: int | None = None) -> None:
        n = len(ids) // 4
        self.queues[queue].append((doc_id, ids, start, n if doc_tokens is None else doc_tokens))
        self.waiting[queue] += n
        self.total += n

    def serve(self, queue: int, n: int, offset: int) -> int:
        """Move n tokens from the queue's head into the open sequence; returns the next offset."""
        self.waiting[queue] -= n
        self.total -= n
        self.deficit[queue] -= n
        line = self.queues[queue]
        while n:
            doc_id, ids, start, doc_tokens = line.popleft()
            take = min(n, len(ids) // 4)
            if take * 4 < len(ids):
                line.appendleft((doc_id, ids[take * 4 :], start + take, doc_tokens))
            self.pieces.append((doc_id, start, take, zlib.crc32(ids[: take * 4]), doc_tokens, self.sequence, offset))
            offset += take
            n -= take
        return offset

    def window(self, length: int | None = None) -> None:
        """Fill one sequence; as many tokens must be waiting."""
        length = length or self.length
        many = len(self.shares)
        for q, share in enumerate(self.shares):
            self.deficit[q] += share * length
        at = 0
        for step in range(many):
            q = (self.turn + step) % many
            # a source that had nothing to give catches up at twice its share a window
            give = min(int(self.deficit[q]), int(2 * self.shares[q] * length) + self.quantum, self.waiting[q], length - at)
            if give >= min(self.quantum, length):
                at = self.serve(q, give, at)
        while at < length:
            q = max((q for q in range(many) if self.waiting[q]), key=self.deficit.__getitem__)
            at = self.serve(q, min(self.waiting[q], length - at, max(self.quantum, int(self.deficit[q]))), at)
        self.turn = (self.turn + 1) % many
        self.sequence += 1

    def ready(self) -> bool:
        """Whether the next window can be filled as the mixture asks, or no more can be held."""
        if self.total < AHEAD * self.length:
            return False
        earned = (min(d + s * self.length, self.length) for d, s in zip(self.deficit, self.shares, strict=True))
        return self.total >= HELD or all(e < self.quantum or w >= e for e, w in zip(earned, self.waiting, strict=True))

    def fill(self) -> None:
        while self.total >= self.length:
            self.window()

    def finish(self) -> None:
        """Pack the rest into sequences of powers of two."""
        self.fill()
        while self.total:
            self.window(1 << (self.total.bit_length() - 1))

    def taken(self) -> list[tuple]:
        pieces, self.pieces = self.pieces, []
        return pieces


ENCODERS: dict[int, Encoder] = {}  # of this Python worker, by vocabulary


def queue_shares(docs: DataFrame, mixture: dict[str, float] | None) -> tuple[list[str | None], list[float]]:
    """Sources with a queue of their own and the shares of all queues; the last queue is for the rest.

    Without a mixture each source's share is that of its texts' bytes in the whole corpus.
    """
    if mixture is None:
        size = F.sum(F.octet_length(F.coalesce(F.col("text").cast("string"), F.lit(""))) + 4).alias("n")
        sums = docs.groupBy(F.col("source").cast("string").alias("source")).agg(size)
        largest = sums.orderBy(F.desc("n"), "source").limit(QUEUES).collect()
        everything = docs.agg(size).first()["n"] or 1
        weights = {r["source"]: r["n"] / everything for r in largest}
    else:
        weights = mixture
    known = sum(weights.values())
    shares = [w / max(known, 1) for w in weights.values()]
    return list(weights), [*shares, max(0.0, 1.0 - sum(shares))]


def pack(docs: DataFrame, ranks_path: str, length: int = 2048, quantum: int = 256, mixture: dict[str, float] | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Each id of each row's tokens (its text's, then END_ID) lies in exactly one piece; a
    sequence is filled from offset 0 without gaps to ``length``, or to a power of two for the
    rest. Null and empty texts are the end id alone. A null source is a source of its own.
    ``mixture`` gives target shares by source (others share what it leaves); a source that
    runs out leaves its part to the others. The vocabulary's ``.json`` form lies beside the ranks. Rows that share a doc_id are packed as separate
    documents. An empty table gives no piece. Other input columns are ignored.
    """
    spark = docs.sparkSession
    slim = payload(docs, "doc_id", "source", "text")
    sources, shares = queue_shares(slim, mixture)
    with open(ranks_path, "rb") as file:
        shared = spark.sparkContext.broadcast(file.read())
    full = spark.sparkContext.broadcast(Path(ranks_path).with_suffix(".json").read_bytes())
    key = zlib.crc32(shared.value)
    id_type = dict(slim.dtypes)["doc_id"]
    number = {s: n for n, s in enumerate(sources)}
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "queue", "deficit", "part", "ids"]
    schema = f"doc_id {id_type}, {FIELDS}, queue int, deficit double, part int, ids binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ENCODERS.get(key) or ENCODERS.setdefault(key, Encoder(shared.value, lambda: full.value))
        part = TaskContext.get().partitionId()
        packer = Packer(shares, length, quantum, part << 32)
        ids_of = None

        def rows(pieces: list[tuple], rest: list[tuple]) -> pa.RecordBatch:
            every = [(*p, None, None, None, None) for p in pieces] + rest
            types = [ids_of, *[pa.int64()] * 6, pa.int32(), pa.float64(), pa.int32(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([r[n] for r in every], t) for n, t in enumerate(types)], names)

        for batch in batches:
            ids_of = batch.column(0).type
            end = END_ID.to_bytes(4, "little")
            for doc_id, source, text in zip(*(batch.column(c) for c in range(3)), strict=True):
                packer.add(number.get(source.as_py(), len(sources)), doc_id.as_py(), encoder.encode(text.as_py()) + end)
                while packer.ready():
                    packer.window()
            yield rows(packer.taken(), [])
        if ids_of is not None:
            packer.fill()
            rest = [
                (doc_id, start, len(ids) // 4, None, doc_tokens, None, None, q, None, part, ids)
                for q, line in enumerate(packer.queues)
                for doc_id, ids, start, doc_tokens in line
            ]
            # every queue's deficit, of empty ones too: a starved source may wait in another partition
            carried = [(None, None, None, None, None, None, None, q, d, part, b"") for q, d in enumerate(packer.deficit) if d]
            yield rows(packer.taken(), rest + carried)

    def join_rest(rest: pa.Table) -> pa.Table:
        ids_of = rest.schema.field("doc_id").type
        rest = rest.sort_by([(c, "ascending") for c in ("part", "queue", "place")])
        packer = Packer(shares, length, quantum, 1 << 62 | rest.column("part")[0].as_py() // JOINED << 32)
        for r in rest.select(["queue", "deficit", "doc_id", "ids", "start", "doc_tokens"]).to_pylist():
            if r["deficit"] is not None:
                packer.deficit[r["queue"]] += r["deficit"]
            else:
                packer.add(r["queue"], r["doc_id"], r["ids"], r["start"], r["doc_tokens"])
        packer.finish()
        columns = zip(*packer.taken(), strict=True) if packer.pieces else [[]] * 7
        return pa.table([pa.array(list(c), t) for c, t in zip(columns, [ids_of, *[pa.int64()] * 6], strict=True)], names=names[:7])

    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    dealt = slim.select("doc_id", F.col("source").cast("string").alias("source"), text).repartition(F.xxhash64("doc_id", F.length("text")))
    packed = settle(dealt.mapInArrow(run, schema))
    rest = packed.where(F.col("ids").isNotNull()).withColumn("place", F.monotonically_increasing_id())
    late = rest.groupBy((F.col("part") / JOINED).cast("int").alias("joined")).applyInArrow(join_rest, f"doc_id {id_type}, {FIELDS}")
    return packed.where(F.col("ids").isNull()).select(*names[:7]).unionByName(late)
