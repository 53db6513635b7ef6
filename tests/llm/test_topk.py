import math
import random

import pytest

from tamis.llm.topk import top_k


def brute(rows, every, k):
    usable = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in {(i, tuple(v)) for i, v in usable if i % every == 0}:
        scored = sorted((-sum(x * y for x, y in zip(a, v)), i) for i, v in usable if i != q)[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    return sorted(out)


def vectors(n, width, seed, grain):
    rng = random.Random(seed)
    return [(i, [round(rng.uniform(-1, 1) * grain) / grain for _ in range(width)]) for i in range(n)]


def test_matches_brute_force(spark):
    for n, width, grain in ((400, 40, 64), (300, 24, 1), (12, 8, 64)):
        rows = vectors(n, width, n, grain)
        rows += [(n + 1, None), (n + 2, [None] * width), (n + 3, [float("nan")] * width), (n + 4, [float("inf")] * width), (None, rows[0][1])]
        rows += [(7, rows[7][1]), (7, rows[8][1])]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS shard", "2 AS v")
        got = sorted(tuple(r) for r in top_k(df, every=20, k=5).collect())
        assert got == brute(rows, 20, 5)


def test_many_shards_and_blocks(spark, monkeypatch):
    from tamis.llm import topk

    monkeypatch.setattr(topk, "SHARD_ROWS", 64)
    monkeypatch.setattr(topk, "QUERY_ROWS", 16)
    rows = vectors(500, 20, 9, 8)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in topk.top_k(df, every=5, k=7).collect())
    assert got == brute(rows, 5, 7)


def test_empty(spark):
    assert top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert top_k(spark.createDataFrame([(0, [1.0])], "vec_id long, embedding array<float>")).count() == 0


@pytest.mark.parametrize("size", [3e6, 2e7, 1.5e8])
def test_large_components(spark, size):
    """Sums from 2 ** 53 on: doubles would round, and near ties would change places."""
    rng = random.Random(int(size))
    base = [rng.uniform(-size, size) for _ in range(12)]
    rows = [(i, [x + rng.randrange(3) / 64 for x in base]) for i in range(150)] + [(i, [rng.uniform(-size, size) for _ in range(12)]) for i in range(150, 300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = brute(rows, 20, 6)
    if max(abs(s) for *_, s in want) < 2**63:
        assert sorted(tuple(r) for r in top_k(df, every=20, k=6).collect()) == want


def test_scores_beyond_a_long_raise(spark):
    for x in (1e17, 1e300):
        df = spark.createDataFrame([(i, [x, x]) for i in range(4)], "vec_id long, embedding array<double>")
        with pytest.raises(Exception, match="beyond a 64-bit integer"):
            top_k(df, every=2, k=2).collect()
