import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tamis.llm import ranked_search as rs

WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items, k):
    texts = [(d, words(t)) for d, t in docs]
    texts = [(d, w, Counter(w)) for d, w in texts if w]
    rows, total = len(texts), sum(len(w) for _, w, _ in texts)
    df = Counter(t for _, _, c in texts for t in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(words(text))
    out = []
    for item, terms in asked.items():
        scored = []
        for d, w, c in texts:
            m = 50 + (50 * len(w) * rows) // total
            score = sum(
                math.floor(1000 * math.log((2 * rows + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in terms if c[t]
            )
            if score > 0:
                scored.append((-score, d is None, d or 0, len(w), d))
        out += [(item, n + 1, x[4], -x[0]) for n, x in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def corpus(seed, n, vocabulary):
    rng = random.Random(seed)
    word = lambda: rng.choice(["W", "w", "é", "9"]) + str(int(rng.paretovariate(0.7)) % vocabulary)
    text = lambda most: rng.choice([" ", "\n", "-", " _ "]).join(word() for _ in range(rng.randrange(most)))
    docs = [(d, text(rng.choice([8, 60, 400]))) for d in range(n)]
    docs += [(n + d, docs[3][1]) for d in range(40)]
    docs += [(n + 50, None), (n + 51, ""), (n + 52, "..."), (None, docs[5][1]), (6, docs[6][1]), (6, "w1 w2 w3"), (n + 60, "w1 " * 5000)]
    items = [(i, text(40)) for i in range(12)] + [(20, None), (21, ""), (22, "none of these"), (3, "W1 w7"), (None, "w2 é3"), (23, docs[3][1])]
    return docs, items


@pytest.mark.parametrize(("seed", "k"), [(1, 5), (2, 50)])
def test_matches_brute_force(spark, docs_of, seed, k):
    docs, items = corpus(seed, 300, 60)
    asked = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS terms", "2 AS q")
    got = sorted((tuple(r) for r in rs.ranked_search(docs_of(docs).repartition(4), asked, k).collect()), key=str)
    assert got == brute(docs, items, k)


def test_small_blocks(spark, docs_of, monkeypatch):
    monkeypatch.setattr(rs, "QUERIES", 4)
    monkeypatch.setattr(rs, "CELLS", 400)
    docs, items = corpus(3, 200, 30)
    got = rs.ranked_search(docs_of(docs), spark.createDataFrame([(f"i{i}", t) for i, t in items], "item_id string, text string"), 7)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(docs, [(f"i{i}", t) for i, t in items], 7)


def test_buckets_and_bounds_prune():
    """Few rows are rescored when one row per query stands out; the search agrees with all scores."""
    rng = np.random.default_rng(4)
    at = np.concatenate([np.sort(rng.choice(100, 10, replace=False)) for _ in range(3000)])
    starts, n, tf = np.arange(3001) * 10, np.full(3000, 40), np.ones(30_000, np.int64)
    tf[:100] = 9
    index = rs.Index([np.arange(q, q + 10) for q in range(0, 90, 10)], np.arange(1, 101) * 50, k=3)
    least = np.zeros(9, np.int64)
    got = {}
    for q, r, score in index.search(tf, at, starts, n, np.arange(3000), (3000, 120_000), least):
        got.update({(int(a), int(b)): int(c) for a, b, c in zip(q, r, score, strict=True)})
    impact = rs.impacts(tf, np.full(30_000, 40), 3000, 120_000)
    for q in range(9):
        every = np.zeros(3000, np.int64)
        inside = (at >= 10 * q) & (at < 10 * q + 10)
        np.add.at(every, np.repeat(np.arange(3000), 10)[inside], impact[inside] * index.weight[at[inside]])
        best = np.lexsort((np.arange(3000), -every))[:3]
        assert {r: s for (p, r), s in got.items() if p == q} == {int(r): int(every[r]) for r in best}
        assert least[q] == every[best[-1]]


def test_large_numbers():
    n, rows = np.array([1 << 40]), 1 << 30
    assert rs.impacts(np.array([1 << 20]), n, rows, 1 << 50)[0] == (10**9 << 20) // ((1000 << 20) + 20 * (50 + (50 << 70 >> 50)))


def test_empty(spark, docs_of):
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert rs.ranked_search(docs_of([]), items).count() == 0
    assert rs.ranked_search(docs_of([(1, "a b")]), items.limit(0)).count() == 0
    assert rs.ranked_search(docs_of([(1, None)]), items).count() == 0
