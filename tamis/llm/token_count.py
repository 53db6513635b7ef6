"""Token counts of a sentencepiece BPE vocabulary through a compiled finite-state transducer.

BPE output is settled left to right: the last token of each prefix is the one token that
ends there and may follow the last token before it (two tokens may be neighbours if merging
their joined text gives just these two). So a deterministic machine that reads characters,
remembers the last tokens of the recent prefixes and may emit a token needs no look-ahead
inside a unit; no piece spans a unit's border (a space after anything but a space), where it returns to its start.
Its states are made as texts ask for them; the transition over a whole unit is kept, annotated
with the number of emitted tokens, so a text is one look-up per unit.

Texts are read in chunks of bounded size. A chunk's state map takes any state (the
unfinished unit before it) to the state after it and the tokens emitted; it is held as (head,
tokens, tail), or as a head alone where no unit begins inside. Maps compose associatively; a
text's count is the composition of its chunks' maps by a prefix scan in pairs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamis.llm.common import payload

SPACE = "\u2581"
CHUNK_CHARS = 65_536
KEPT = 300_000  # unit transitions, and neighbour pairs, that a machine keeps before it starts anew
UNITS = re.compile(r"^ *[^ ]+| +[^ ]*|^ +$")

StateMap = tuple[str, int, str | None]


class Transducer:
    """Counts of tokens by unit, compiled from the vocabulary's pieces and their ranks."""

    def __init__(self, rank: dict[str, int]):
        self.rank = rank
        # any order finds the one token that fits; the usual lengths first
        self.sizes = [2, 3, 1, *range(4, max(map(len, rank), default=1) + 1)]
        self.pairs = {p[i : i + 2] for p in rank for i in range(len(p) - 1)}
        self.words: dict[str, int] = {}  # a space and the word
        self.parts: dict[str, int] = {}  # between resets
        self.neighbours: dict[tuple[str, str], bool] = {}

    def merged(self, text: str) -> list[str]:
        """BPE by definition: the best-ranked neighbour pair is joined, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            ranks = [self.rank.get(a + b, 1 << 30) for a, b in pairwise(parts)]
            best = min(ranks)
            if best == 1 << 30:
                break
            at = ranks.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def follows(self, left: str, right: str) -> bool:
        """Whether the tokens may be neighbours; after nothing, whether a token may begin a unit."""
        known = self.neighbours.get((left, right))
        if known is None:
            if len(self.neighbours) >= KEPT:
                self.neighbours.clear()
            known = self.neighbours[left, right] = self.merged(left + right) == ([left, right] if left else [right])
        return known

    def emitted(self, unit: str) -> int:
        """Tokens of a unit, read character by character; each prefix has one last token."""
        rank, known = self.rank, self.neighbours.get
        last, count = [""], [0]
        for end in range(1, len(unit) + 1):
            for size in self.sizes:
                if size > end:
                    continue
                token = unit[end - size : end]
                if token in rank or size == 1:
                    left = last[end - size]
                    follows = known((left, token))
                    if self.follows(left, token) if follows is None else follows:
                        last.append(token)
                        # a character outside the vocabulary is emitted byte by byte
                        count.append(count[end - size] + (1 if token in rank else len(token.encode("utf-8", "surrogatepass"))))
                        break
        return count[-1]

    def read(self, word: str) -> int:
        """The transition over a space and a word without spaces."""
        found = self.words.get(word)
        if found is None:
            if len(self.words) >= KEPT:
                self.words.clear()
            found = self.words[word] = self.read_unit(SPACE + word)
        return found

    def read_unit(self, unit: str) -> int:
        """Between two characters that no piece has side by side the machine is at its start again."""
        pairs, parts, known = self.pairs, self.parts, self.parts.get
        cuts = [i for i in range(1, len(unit)) if unit[i - 1 : i + 1] not in pairs]
        total = 0
        for a, b in zip([0, *cuts], [*cuts, len(unit)], strict=True):
            part = unit[a:b]
            found = known(part)
            if found is None:
                if len(parts) >= KEPT:
                    parts.clear()
                found = parts[part] = self.emitted(part)
            total += found
        return total

    def settled(self, text: str) -> int:
        """Tokens of text that ends where a unit ends."""
        units = UNITS.findall(text)
        return sum(self.read(u[1:]) if u[0] == " " and " " not in u[1:] else self.read_unit(u.replace(" ", SPACE)) for u in units)

    def chunk_map(self, chunk: str) -> StateMap:
        """(head, tokens, tail): up to the first unit that begins inside, the whole units after it, the unfinished unit."""
        if "  " in chunk:
            units = UNITS.findall(chunk)
            if len(units) < 2:
                return chunk, 0, None
            return units[0], sum(map(self.settled, units[1:-1])), units[-1]
        units = chunk.split(" ")
        if chunk.startswith(" "):
            units = [" " + units[1], *units[2:]]
        if len(units) < 2:
            return chunk, 0, None
        known = self.words.get
        found = [known(u) for u in units[1:-1]]
        if None in found:
            found = [self.read(u) if n is None else n for u, n in zip(units[1:-1], found, strict=True)]
        return units[0], sum(found), " " + units[-1]

    def compose(self, a: StateMap, b: StateMap) -> StateMap:
        """The map of a's chunk followed by b's."""
        middle = (a[0] if a[2] is None else a[2]) + b[0]
        head, tokens, tail = self.chunk_map(middle)
        if a[2] is not None:
            inner = 0 if tail is None and b[2] is None else self.settled(head)
            if b[2] is None:
                return a[0], a[1] + inner + tokens, head if tail is None else tail
            return a[0], a[1] + inner + tokens + (0 if tail is None else self.settled(tail)) + b[1], b[2]
        if b[2] is None:
            return head, tokens, tail
        return head, tokens + (0 if tail is None else self.settled(tail)) + b[1], b[2]

    def count(self, text: str, chunk: int = CHUNK_CHARS) -> int:
        """Tokens of a whole text; the vocabulary's normaliser puts a space before it."""
        if not text:
            return 0
        text = " " + text.replace(SPACE, " ")
        maps = [self.chunk_map(text[at : at + chunk]) for at in range(0, len(text), chunk)]
        while len(maps) > 1:
            pairs = [self.compose(a, b) for a, b in zip(maps[::2], maps[1::2], strict=False)]
            maps = pairs + maps[len(pairs) * 2 :]
        head, tokens, tail = maps[0]
        return self.settled(head) + tokens + (self.settled(tail) if tail is not None else 0)


def vocabulary(path: str) -> dict[str, int]:
    """Ranks of a sentencepiece BPE model's ordinary pieces; models with another normaliser are refused."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    probe = " a  \ufb01\uff41 "
    if model.normalize(probe) != (" " + probe).replace(" ", SPACE):
        raise ValueError("the model's normaliser must keep the text and put one space before it")
    ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i) or model.is_unused(i))]
    pieces = {model.id_to_piece(i): -model.get_score(i) for i in ids}
    if any(SPACE in p.lstrip(SPACE) for p in pieces):
        raise ValueError("no piece may reach over the end of a word")
    return {p: n for n, p in enumerate(sorted(pieces, key=pieces.get))}


MACHINES: dict[int, Transducer] = {}  # of this Python worker, by vocabulary


def token_counts(docs: DataFrame, path: str, limit: int = 4096) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens).

    Counts are those of the sentencepiece BPE model at ``path`` without begin and end tokens.
    Null texts count as empty, with no tokens. Null and repeated doc_ids are kept as they
    are. Other input columns are ignored. The vocabulary (a file of bounded size) is broadcast.
    """
    ranks = vocabulary(path)
    key = hash(tuple(sorted(ranks.items())))
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = MACHINES.get(key) or MACHINES.setdefault(key, Transducer(shared.value))
        for batch in batches:
            counts = [machine.count(text.as_py()) for text in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    slim = payload(docs, "doc_id", "text").select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    counted = slim.mapInArrow(run, f"doc_id {dict(slim.dtypes)['doc_id']}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
