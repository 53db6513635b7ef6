import random

import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor

from tamis.llm.token_count import KEPT, Transducer, token_counts, vocabulary

PATH = public_tokenizers.path("piece_bpe_32k.model")
PARTS = ["a", "b", " ", "  ", "\n", "the", "é", "▁", ".", "日本", "ing", "\t", "xxxxx", "​", "😀", "<s>", "the the", "0", "\r\n", "\x00"]


@pytest.fixture(scope="module")
def library():
    return SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def machine():
    return Transducer(vocabulary(PATH))


def random_texts(n):
    rng = random.Random(2)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randrange(0, 25))) for _ in range(n)]


@pytest.mark.parametrize("chunk", [1, 3, 7, 64, 65_536])
def test_chunk_maps_compose_to_the_librarys_counts(library, machine, chunk):
    for text in random_texts(500):
        assert machine.count(text, chunk) == len(library.encode(text)), text


def test_composition_is_associative(machine):
    text = " the cat  sat on\nthe mat and read " * 3
    for a in range(0, len(text), 5):
        for b in range(a, len(text), 9):
            x, y, z = (machine.chunk_map(t) for t in (text[:a], text[a:b], text[b:]))
            assert machine.compose(machine.compose(x, y), z) == machine.compose(x, machine.compose(y, z))


def test_small_memory_changes_nothing(library, monkeypatch):
    from tamis.llm import token_count

    monkeypatch.setattr(token_count, "KEPT", 3)
    small = Transducer(vocabulary(PATH))
    for text in random_texts(100):
        assert small.count(text) == len(library.encode(text))
    assert len(small.words) <= 3 < KEPT


def test_rows(spark, docs_of, library):
    texts = [*random_texts(50), "", None, "word " * 40_000, "x" * 9_000, "no end " * 3]
    rows = [*enumerate(texts), (None, "null id"), (3, "again")]
    got = sorted(((r.doc_id if r.doc_id is not None else -1), r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts(docs_of(rows), PATH).collect())
    want = []
    for d, t in rows:
        n = len(library.encode(t or ""))
        want.append((d if d is not None else -1, len((t or "").encode()), n, n > 4096))
    assert got == sorted(want)
    assert token_counts(docs_of([]), PATH).count() == 0
