import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tamis.functions import neighbours
from tamis.session import reliable_checkpoint

NAN = float("nan")


def brute(x, points, at, k):
    """Values at ``at`` of the k nearest donors."""
    found = []
    for n, p in enumerate(points):
        if p[at] is None:
            continue
        both = [(a - b) ** 2 for a, b in zip(x, p, strict=True) if a is not None and b is not None]
        if both:
            found.append((sum(both) * len(x) / len(both), n, p[at]))
    best = sorted(found)[:k]
    return sum(v for _, _, v in best) / len(best) if best else None


def points(rng, n, gaps, width=4):
    return [tuple(None if c and rng.random() < gaps else float(rng.randrange(1000)) for c in range(width)) for _ in range(n)]


def frame(spark, rows, key):
    return spark.createDataFrame([(n, list(r)) for n, r in enumerate(rows)], f"{key} long, x array<double>")


@pytest.mark.parametrize("gaps", [0.0, 0.3, 0.95])
def test_cells_match_brute_force(spark, monkeypatch, gaps):
    monkeypatch.setattr(neighbours, "CELL", 20)
    rng = random.Random(int(gaps * 10))
    donors = points(rng, 400, gaps) + [(5.0, 5.0, 5.0, 5.0)] * 150  # a hot point
    asked = [(*p[:3], None) for p in points(rng, 60, gaps)] + [(5.0, 5.0, 5.0, None)] * 10 + [(None,) * 4]
    search = neighbours.Search(frame(spark, donors, "donor"), 3, 4, 16)
    assert len(search.boxes.cells) > (8 if gaps < 0.5 else 2)
    got = {r["__row"]: r.value for r in search.mean(frame(spark, asked, "__row"), reliable_checkpoint).collect()}
    for n, x in enumerate(asked):
        want = brute(x, donors, 3, 4)
        assert (n not in got) if want is None else got[n] == pytest.approx(want)


def compared(spark, n, seed):
    """Pairs of (row, donor) that the two rounds compare, for n rows and n donors."""
    rng = np.random.default_rng(seed)
    donors = frame(spark, rng.random((n, 3)).tolist(), "donor")
    needy = frame(spark, [[*r, None] for r in rng.random((n, 2)).tolist()], "__row")
    search = neighbours.Search(donors, 2, 3, 8_192)
    needy = reliable_checkpoint(needy.withColumn("cell", search.cell_of()))
    first = reliable_checkpoint(search.best(search.meet(needy)))
    visited = needy.select("cell").unionAll(search.visits(needy, first).select("cell")).groupBy("cell").agg(F.count("*").alias("n")).collect()
    return sum(r["n"] * search.sizes[r["cell"]] for r in visited)


def test_pairs_grow_far_slower_than_rows_times_donors(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CELL", 32)
    small, large = compared(spark, 1_000, 1), compared(spark, 4_000, 2)
    assert large < 6 * small  # 16 times as many pairs exist
    assert large < 4_000 * 4_000 / 20


def test_bound_is_below_every_distance():
    rng = random.Random(4)
    for _ in range(200):
        cell = points(rng, 5, 0.4)
        x = points(rng, 1, 0.4)[0]
        rows = []
        for c in range(4):
            known = [p[c] for p in cell if p[c] is not None]
            rows.append({"cell": 0, "pos": c, "low": min(known, default=None), "high": max(known, default=None), "known": len(known), "donors": 5})
        bound = neighbours.Boxes(rows, 4).bound(neighbours.matrix([x])[0])[0]
        for p in cell:
            both = [(a - b) ** 2 for a, b in zip(x, p, strict=True) if a is not None and b is not None]
            if both:
                assert bound <= sum(both) * 4 / len(both) + 1e-9


def test_no_donors_and_no_rows(spark):
    none = frame(spark, [], "donor")
    asked = frame(spark, [(1.0, None)], "__row")
    assert neighbours.Search(none, 1, 3, 16).mean(asked, reliable_checkpoint).count() == 0
    some = frame(spark, [(1.0, 2.0)], "donor")
    assert neighbours.Search(some, 1, 3, 16).mean(asked.limit(0), reliable_checkpoint).count() == 0
    assert [r.value for r in neighbours.Search(some, 1, 3, 16).mean(asked, reliable_checkpoint).collect()] == [2.0]


def block(rng, n, m, gaps, high):
    """Donors with many equal points and a column with a frequent greatest value, and rows that lack the last coordinate."""
    points = rng.integers(0, high, (n + m, 4)).astype(float)
    points[:, 0] = np.where(rng.random(n + m) < 0.7, high, points[:, 0])
    points[rng.random(points.shape) < gaps] = NAN
    points[:: n // 20, 1] = np.inf
    points[:n, 3], points[n:, 3] = rng.random(n), NAN
    names = [f"x{c}" for c in range(4)]
    give, ask = (pd.DataFrame(p, columns=names) for p in (points[:n], points[n:]))
    return ask.assign(__row=range(m), reach=np.inf), give.assign(donor=range(n)).sample(frac=1.0, random_state=1), names


@pytest.mark.parametrize("gaps", [0.0, 0.3, 0.9])
@pytest.mark.parametrize("high", [2, 1_000])
def test_block_matches_brute_force(monkeypatch, gaps, high):
    for name, value in (("LEAF", 8), ("PAIRS", 100), ("AT_ONCE", 7)):
        monkeypatch.setattr(neighbours, name, value)
    ask, give, names = block(np.random.default_rng(high), 400, 30, gaps, high)
    ask["reach"] = np.where(ask["__row"] % 2 == 0, np.inf, high)
    got = neighbours.compare(ask, give, names, 3, 5)
    points = give.sort_values("donor")[names].to_numpy()
    for row, x, reach in zip(ask["__row"], ask[names].to_numpy(), ask["reach"], strict=True):
        both = ~np.isnan(points) & ~np.isnan(x)
        with np.errstate(divide="ignore", invalid="ignore"):
            d = np.where(both, (points - x) ** 2, 0.0).sum(1) * (4 / both.sum(1))
        want = [n for n in np.argsort(d, kind="stable") if d[n] <= reach and np.isfinite(d[n])][:5]
        assert got.loc[got["__row"] == row, "donor"].tolist() == want


def test_pairs_in_a_block_grow_far_slower_than_rows_times_donors(monkeypatch):
    counted = []
    plain = neighbours.Leaves.distance
    monkeypatch.setattr(neighbours.Leaves, "distance", lambda self, x, row, donor: counted.append(len(row)) or plain(self, x, row, donor))

    def pairs(n):
        counted.clear()
        ask, give, names = block(np.random.default_rng(n), n, n, 0.0, 10_000)
        neighbours.compare(ask, give, names, 3, 5)
        return sum(counted)

    small, large = pairs(1_000), pairs(8_000)
    assert large < 12 * small  # 64 times as many pairs exist
    assert large < 8_000 * 8_000 / 10


def test_cells_within_reach_are_found_from_the_top():
    rng = np.random.default_rng(6)
    points = rng.random((600, 3))
    points[rng.random(points.shape) < 0.2] = NAN
    cells = neighbours.Tree(points, 64, 2).cell(points)
    order = np.argsort(cells, kind="stable")
    known = ~np.isnan(points[order])
    boxes = neighbours.Boxes.over(cells[order], points[order], points[order], known, known)
    x, reach = points[:50], rng.random(50) / 10
    row, box = neighbours.within(boxes.levels(), x, reach)
    found = sorted(zip(row.tolist(), box.tolist(), strict=True))
    assert found == [(n, int(b)) for n in range(50) for b in np.flatnonzero(boxes.bound(x[n]) <= reach[n])]
