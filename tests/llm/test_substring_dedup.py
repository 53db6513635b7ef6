import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from tamis.llm import substring_dedup as sd


def brute(rows, window):
    texts = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + window]) for w in texts for i in range(len(w) - window + 1))
    out = []
    for (d, _), w in zip(rows, texts, strict=True):
        gone = {i + k for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for k in range(window)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def found(df, window):
    return sorted((tuple(r) for r in sd.digest(sd.without_repeated_substrings(df, window)).collect()), key=str)


@pytest.mark.parametrize("window", [1, 2, 3, 5, 12, 22, 35, 40, 100])
def test_cover_holds_every_difference(window):
    period, cover = sd.difference_cover(window)
    assert period <= max(1, 0.6 * window) or period == 1
    for i in range(period):
        assert any((i + s) % period in cover and s % period in cover for s in range(period))


def corpus(seed, window):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdéf") + str(rng.randrange(4))
    passages = [[word() for _ in range(rng.choice([window - 1, window, window + 1, 3 * window]))] for _ in range(8)]
    rows = []
    for d in range(60):
        text = []
        for _ in range(rng.randrange(5)):
            text += rng.choice(passages) if rng.random() < 0.5 else [word() for _ in range(rng.randrange(2 * window))]
        rows.append((d, rng.choice([" ", "\n", "\t ", " \r\n"]).join(text)))
    return rows


@pytest.mark.parametrize("window", [1, 4, 35])
def test_matches_brute_force(spark, docs_of, window):
    rows = corpus(window, window)
    rows += [(100, None), (101, ""), (102, " \n"), (None, rows[3][1]), (5, rows[5][1]), (5, "other text"), (103, "x " * 200)]
    rows += [(104, "a b  c\x0bd\x1ce\x85f " * window)]  # only ASCII white space ends words
    assert found(docs_of(rows).repartition(5), window) == brute(rows, window)


def test_many_chunks_and_a_hot_passage(spark, docs_of, monkeypatch):
    monkeypatch.setattr(sd, "CHUNK_BYTES", 500)
    rng = random.Random(5)
    passage = " ".join(str(rng.randrange(50)) for _ in range(60))
    rows = [(d, " ".join(str(rng.randrange(10**6)) for _ in range(40)) + (" " + passage if d % 3 == 0 else "")) for d in range(200)]
    got = found(docs_of(rows).repartition(3), 35)
    assert got == brute(rows, 35)
    assert sum(r[2] for r in got) == 60 * 67


def test_spans_and_text(spark, docs_of):
    rows = [(1, "p q r a b c d x"), (2, "a b c d"), (3, "c d x")]
    got = {r.doc_id: r for r in sd.without_repeated_substrings(docs_of(rows), 3).collect()}
    assert [tuple(s) for s in got[1].removed] == [(3, 5)] and got[1].kept == "p q r"
    assert got[2].kept == "" and got[3].kept == "" and got[3].n_words == 3


def test_long_text_and_runs(spark, docs_of):
    rng = random.Random(9)
    rows = [(1, " ".join(str(rng.randrange(3)) for _ in range(60_000))), (2, "z " * 50_000), (3, "z " * 34), (4, "z " * 35)]
    got = {r[0]: r[1:3] for r in found(docs_of(rows), 35)}
    assert got[2] == (50_000, 50_000) and got[3] == (34, 0) and got[4] == (35, 35)
    assert found(docs_of(rows[:1]), 35) == brute(rows[:1], 35)


def test_empty_table(spark, docs_of):
    assert sd.without_repeated_substrings(docs_of([])).count() == 0


def test_pairs_that_share_one_half():
    known = (np.array([5, 5, 9]), np.array([1, 2, 3]))
    assert sd.among((np.array([5, 5, 5, 9, 1]), np.array([2, 1, 3, 3, 1])), known).tolist() == [True, True, False, True, False]
