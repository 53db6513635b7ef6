import hashlib
import random
import re
from zlib import crc32

import numpy as np
import pytest

from tamis.llm import periodic_runs as pr


def planted(doc_id, words):
    h = crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def brute_runs(w, min_words=6):
    """Every period from the shortest on; a stretch counts for the smallest period only."""
    found = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            start = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            length = i + q - start
            if length >= max(min_words, 4 * q) and (start, length) not in found:
                found[start, length] = q
    return sorted((s, n, q) for (s, n), q in found.items())


def brute(rows, plant=True):
    out = []
    for d, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        w = planted(d, w) if plant and d is not None else w
        runs = brute_runs(w)
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        best = min(((-n, s, q) for s, n, q in runs), default=None)
        top = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
        sha = [hashlib.sha256(t.encode()).hexdigest() for t in ("".join(f"{s},{n},{q}\n" for s, n, q in runs), " ".join(x for i, x in enumerate(w) if i not in gone))]
        out.append((d, len(runs), *top, *sha))
    return sorted(out, key=str)


def found(df, plant=True):
    rows = pr.with_planted_runs(df) if plant else df
    return sorted((tuple(r) for r in pr.digest(pr.periodic_runs(rows)).collect()), key=str)


def corpus(seed, n):
    rng = random.Random(seed)
    rows = []
    for d in range(n):
        words = []
        for _ in range(rng.randrange(6)):
            period = [rng.choice("aaabé") for _ in range(rng.randrange(1, 9))]
            words += (period * 9)[: rng.randrange(1, 9 * len(period))]
            words += [rng.choice("abcdefgh") for _ in range(rng.randrange(9))]
        rows.append((d, rng.choice([" ", "\n\t"]).join(words)))
    return rows


def test_matches_brute_force(spark, docs_of):
    rows = corpus(1, 400)
    rows += [(1000, None), (1001, ""), (1002, " \n"), (None, "a b " * 9), (7, rows[7][1]), (7, "x x x x x x"), (1003, "x\x1cx " * 7), (1004, "x x x x x")]
    assert found(docs_of(rows).repartition(3)) == brute(rows)
    assert found(docs_of(rows), plant=False) == brute(rows, plant=False)


def test_fibonacci_and_binary_words(spark, docs_of):
    a, b = "a", "ab"
    for _ in range(12):
        a, b = b, b + a
    rng = random.Random(3)
    rows = [(1, " ".join(b)), (2, " ".join(b * 5)), (3, " ".join(rng.choice("ab") for _ in range(900))), (4, " ".join("aab" * 40 + "a" * 30 + "aab" * 40))]
    assert found(docs_of(rows), plant=False) == brute(rows, plant=False)


@pytest.mark.parametrize("block", [2, 512])
def test_suffix_order_and_prefixes(block, monkeypatch):
    monkeypatch.setattr(pr, "BLOCK", block)
    rng = np.random.default_rng(2)
    number = rng.integers(0, 2, 300)
    text = np.repeat([0, 1, 2], [100, 1, 199])
    ends = {0: 100, 1: 101, 2: 300}
    suffix = [tuple(number[i : ends[int(text[i])]]) for i in range(300)]
    order, lcp = pr.suffixes(number, text)
    assert [(text[i], suffix[i]) for i in order] == sorted((int(text[i]), suffix[i]) for i in range(300))
    for a, b, k in zip(order[:-1], order[1:], lcp[1:], strict=True):
        common = next((n for n, (x, y) in enumerate(zip(suffix[a], suffix[b], strict=False)) if x != y), min(len(suffix[a]), len(suffix[b])))
        assert k == (common if text[a] == text[b] else 0)
    # a neighbour of a class at its LCP: nothing of the class between
    for i, j, k in pr.seeds(order, lcp, 3):
        assert i < j and suffix[i][:k] == suffix[j][:k]
        assert not any(suffix[x][: k + 1] == suffix[i][: k + 1] == suffix[j][: k + 1] for x in range(i + 1, j))


def test_long_texts(spark, docs_of):
    rng = random.Random(8)
    noise = [str(rng.randrange(10**6)) for _ in range(30_000)]
    rows = [(1, "z " * 200_000), (2, " ".join(noise + noise[:7000] * 5))]
    got = {r[0]: r for r in found(docs_of(rows), plant=False)}
    assert got[1][1:6] == (1, 0, 200_000, 1, 200_000_000)
    assert got[2][1:6] == (1, 30_000, 35_000, 7000, 5000)


def test_spans_and_text(spark, docs_of):
    row = pr.periodic_runs(docs_of([(1, "x a b a b a b a b a y")])).first()
    assert [tuple(r) for r in row.runs] == [(1, 9, 2)] and row.collapsed == "x a b y"


def test_empty_table(spark, docs_of):
    assert found(docs_of([])) == []
