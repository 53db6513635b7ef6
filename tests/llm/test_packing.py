import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tamis.llm import packing

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def rows_of(n, seed=1):
    rng = random.Random(seed)
    words = ["alpha", "beta", "<|endoftext|>", "don't", "\n\n", "  ", "é", "日本", "12", "😀"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice([0, 3, 40, 400]))) for _ in range(n)]
    return [(d, t, rng.choice(["big"] * 5 + ["mid"] * 2 + ["small", None])) for d, t in enumerate(texts)]


def check_pieces(pieces, rows, tokenizer, length):
    ids = {d: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for d, t, _ in rows}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    assert set(by_doc) == set(ids)
    for d, own in by_doc.items():
        at = 0
        for p in sorted(own, key=lambda p: p.start):
            assert p.start == at and p.length > 0 and p.doc_tokens == len(ids[d])
            part = np.array(ids[d][at : at + p.length], "<u4").tobytes()
            assert p.ids_crc32 == zlib.crc32(part)
            at += p.length
        assert at == len(ids[d])
    padded = 0
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= length
        padded += 0 if at & (at - 1) == 0 else length - at
    assert padded == 0
    return by_sequence


def test_round_trip(spark, docs_of, tokenizer):
    rows = [*rows_of(120), (500, None, "big"), (501, "", None)]
    pieces = packing.pack(docs_of(rows), RANKS, length=256, quantum=32).collect()
    check_pieces(pieces, rows, tokenizer, 256)


def test_long_white_space(spark, docs_of, tokenizer):
    rng = random.Random(9)
    mixed = "".join(rng.choice(" \n\t\u00a0") for _ in range(1_200_000))
    long = [" " * 2_000_000, "\n" * 2_000_000, "it's,\x1c" + " " * 1_100_000 + "word 12 end", mixed + "<|endoftext|> x" + " " * 1_300_000 + "\x1f,\u3000é\n"]
    rows = [(d, t, "big") for d, t in enumerate([*long, "plain text"])]
    pieces = packing.pack(docs_of(rows), RANKS).collect()
    check_pieces(pieces, rows, tokenizer, 2048)


def test_windows_hold_the_mixture(spark, docs_of, tokenizer):
    rng = random.Random(4)
    rows = [(d, "token " * rng.randrange(50, 200), rng.choice(["a", "a", "a", "b"])) for d in range(1200)]
    mixture = {"a": 0.5, "b": 0.5}
    pieces = packing.pack(docs_of(rows), RANKS, length=512, quantum=64, mixture=mixture).collect()
    sequences = check_pieces(pieces, rows, tokenizer, 512)
    source = {d: s for d, _, s in rows}
    share = []
    for own in sequences.values():
        of_b = sum(p.length for p in own if source[p.doc_id] == "b")
        share.append(of_b / sum(p.length for p in own))
    balanced = [s for s in share if abs(s - 0.5) <= 64 / 512 + 0.01]
    # b has a quarter of the tokens: about half of the windows can hold it at its target share
    assert len(balanced) >= 0.4 * len(share)


def test_deficits_carry_over():
    packer = packing.Packer([0.9, 0.1], 100, 50, 0)
    packer.add(0, "x", bytes(4 * 2000))
    packer.add(1, "y", bytes(4 * 200))
    packer.fill()
    by_window = defaultdict(int)
    for doc_id, _, n, _, _, sequence, _ in packer.taken():
        by_window[sequence] += n if doc_id == "y" else 0
    served = np.cumsum([by_window[w] for w in range(16)])
    assert max(served) > 0 and all(abs(s - 10 * (w + 1)) <= 60 for w, s in enumerate(served))
    assert sum(packer.deficit) == pytest.approx(0)


def test_other_rows(spark, docs_of):
    assert packing.pack(docs_of([]), RANKS).count() == 0
    rows = [(None, "no id", "s"), (7, "same", "s"), (7, "same", "s")]
    pieces = packing.pack(docs_of(rows), RANKS).collect()
    assert sorted(str(p.doc_id) for p in pieces if p.start == 0) == ["7", "7", "None"]
    assert sum(p.length for p in pieces) == sum(p.doc_tokens for p in pieces if p.start == 0)


def test_large_ids_beside_a_null(spark, docs_of, tokenizer):
    rows = [((1 << 60) + 2 * i + 1, f"text {i} " * 9, "a") for i in range(30)] + [(None, "of no id", "b")]
    pieces = packing.pack(docs_of(rows), RANKS, length=256, quantum=32).collect()
    check_pieces(pieces, rows, tokenizer, 256)


def test_deficits_of_empty_queues_are_carried(spark):
    """A source that lies in one partition alone is owed what the others' windows lacked."""
    shares = [0.5, 0.5, 0.0]
    first, last = (packing.Packer(shares, 64, 16, n << 32) for n in (0, 1))
    for n in range(20):
        first.add(0, n, bytes(4 * 64))
    first.fill()
    assert first.deficit[1] == pytest.approx(20 * 32) and first.waiting[1] == 0
    for n in range(20):
        last.add(n % 2, 100 + n, bytes(4 * 64))
    for q, d in enumerate(first.deficit):
        last.deficit[q] += d
    last.window()
    served = {q: sum(p[2] for p in last.pieces if (p[0] - 100) % 2 == q) for q in (0, 1)}
    assert served[1] > served[0]


def test_source_in_one_partition(spark, tokenizer):
    schema = "doc_id long, text string, source string"
    rows = [(i, "alpha beta " * 40, "a") for i in range(60)] + [(100 + i, "gamma delta " * 40, "b") for i in range(6)]
    pieces = packing.pack(spark.createDataFrame(rows, schema).repartition(6), RANKS, length=128, quantum=16, mixture={"a": 0.5, "b": 0.5}).collect()
    check_pieces(pieces, rows, tokenizer, 128)
