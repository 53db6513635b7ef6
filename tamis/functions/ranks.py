"""Rank correlations of many columns at once: all columns are stacked, counted and ranked in one scan.

The number of Spark jobs doesn't depend on the number of columns. Values are counted first, so a
value that a third of the rows share is one row of the scan.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.functions.exprs import bounded_broadcast
from tamis.functions.gram import correlation, pair_sums
from tamis.functions.ordering import CumulativeKernel, PositionKernel, ordered_scan
from tamis.session import reliable_checkpoint

BLOCK = 500_000  # rows whose inversions one task counts
FAN = 64  # blocks that are merged at a time


def stacked(rows: DataFrame, entries: list[Column], key: str) -> DataFrame:
    """One row for each entry (a struct) whose ``key`` isn't null, beside the row's __rid if there is one."""
    kept = ["__rid"] if "__rid" in rows.columns else []
    return rows.select(*kept, F.inline(F.array(*entries))).where(F.col(key).isNotNull())


def numbers(df: DataFrame, columns: list[Column]) -> DataFrame:
    """c0, c1, ...: the columns as doubles, NaN as null, written to the checkpoint folder; __rid numbers the rows."""
    doubles = [c.cast("double") for c in columns]
    narrow = df.select(*[F.when(~F.isnan(c), c).alias(f"c{i}") for i, c in enumerate(doubles)])
    # numbered when read back, so that a row keeps its number
    return reliable_checkpoint(narrow).withColumn("__rid", F.monotonically_increasing_id())


def rankings_for(counts: np.ndarray) -> tuple[list[tuple[int, int]], dict[tuple[int, int], int]]:
    """Which rankings all pairs of columns need.

    ``counts[i, j]`` is the number of rows where columns i and j both have a value. Gives the
    rankings, (i, k): column i among the rows where column k has a value too, and for each (i, j)
    the ranking of i that the pair uses. Columns with the same missing rows share rankings.
    """
    d = len(counts)
    first = [next(k for k in range(i + 1) if counts[k, k] == counts[i, i] == counts[k, i]) for i in range(d)]
    found: dict[tuple[int, int], int] = {}
    used = {}
    for i in range(d):
        for j in range(d):
            if i != j:
                # where j misses nothing that i has, i's own ranking holds
                key = (i, i) if counts[i, j] == counts[i, i] else (i, first[j])
                used[i, j] = found.setdefault(key, len(found))
    return list(found), used


def spearman(df: DataFrame, columns: list[Column]) -> dict[tuple[int, int], tuple]:
    """{(i, j): (Spearman rho, n)} for i < j: Pearson r of tie-averaged ranks among the rows where both have a value."""
    pairs = list(combinations(range(len(columns)), 2))
    if not pairs:
        return {}
    rows = numbers(df, columns)
    own = [F.col(f"c{i}") for i in range(len(columns))]
    size, *there = rows.agg(F.count(F.lit(1)), *[F.count(c) for c in own]).first()
    counts = np.full((len(columns), len(columns)), size, np.int64)
    if min(there) < size:
        for (i, j), sums in pair_sums(rows, own, [*pairs, *((i, i) for i in range(len(columns)))]).items():
            counts[i, j] = counts[j, i] = int(sums[0])
    rankings, used = rankings_for(counts)

    entries = [
        F.struct(F.lit(r).alias("r"), (own[i] if i == k else F.when(own[k].isNotNull(), own[i])).alias("v")) for r, (i, k) in enumerate(rankings)
    ]
    cells = stacked(rows, entries, "v")
    held = reliable_checkpoint(cells.groupBy("r", "v").agg(F.count(F.lit(1)).alias("cnt")))
    total = [int(counts[i, k]) for i, k in rankings]
    # ranks less their mean: their squares and products are added up as they are
    scanned = reliable_checkpoint(ordered_scan(held, CumulativeKernel("cnt", "before"), ["v"], ["r"]))
    middle = F.element_at(F.array(*[F.lit((n + 1) / 2.0) for n in total]), F.col("r") + 1)
    ranks = scanned.select("r", "v", (F.col("before") + (F.col("cnt") + 1) / 2.0 - middle).alias("rank"))
    ranked = cells.join(bounded_broadcast(ranks), ["r", "v"])
    wide = ranked.groupBy("__rid").agg(F.map_from_entries(F.collect_list(F.struct("r", "rank"))).alias("m"))
    sums = pair_sums(wide, [F.col("m")[r] for r in range(len(rankings))], [(used[i, j], used[j, i]) for i, j in pairs])
    return {(i, j): correlation(sums[used[i, j], used[j, i]]) for i, j in pairs}


def inversions(a: np.ndarray) -> int:
    """#{i < j : a[i] > a[j]} by merging sorted blocks."""
    a = np.asarray(a)
    base, total = 64, 0
    above = np.triu(np.ones((base, base), bool), 1)
    blocks = []
    for s in range(0, len(a), base):
        block = a[s : s + base]
        total += int(np.count_nonzero((block[:, None] > block[None, :]) & above[: len(block), : len(block)]))
        blocks.append(np.sort(block))
    while len(blocks) > 1:
        merged = []
        for left, right in zip(blocks[::2], blocks[1::2], strict=False):
            total += len(left) * len(right) - int(np.searchsorted(left, right, side="right").sum())
            merged.append(np.sort(np.concatenate((left, right)), kind="stable"))
        blocks = merged + blocks[len(merged) * 2 :]
    return total


def in_tasks(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """(p, inv): inversions of y in each group of ``keys`` (p first), sorted by ``order``."""

    def run(group: pa.Table) -> pa.Table:
        y = group.sort_by([(c, "ascending") for c in order]).column("y").to_numpy()
        return pa.table({"p": group.column("p").slice(0, 1), "inv": pa.array([inversions(y)], pa.int64())})

    narrow = rows.select(*dict.fromkeys([*keys, *order, "y"]))
    return narrow.groupBy(*keys).applyInArrow(run, "p int, inv long").select("p", F.col("inv").cast("decimal(38,0)").alias("inv"))


def between(cut: DataFrame, fan: int) -> DataFrame:
    """(p, inv): pairs of rows (p, g, s, c) of one (p, g), the one with the larger slice s in the smaller block c."""
    blocks = range(fan)
    slices = cut.groupBy("p", "g", "s").agg(*[F.count(F.when(F.col("c") == c, 1)).alias(f"n{c}") for c in blocks])
    scanned = ordered_scan(slices, CumulativeKernel([f"n{c}" for c in blocks], [f"u{c}" for c in blocks]), ["s"], ["p", "g"])
    held, under = F.array(*[f"n{c}" for c in blocks]), F.array(*[f"u{c}" for c in blocks])
    rows = F.zip_with(held, under, lambda n, u: F.struct(n.alias("n"), u.alias("u")))
    whole = "decimal(19,0)"
    # from the last block on: the rows of later blocks in earlier slices so far, and the pairs
    start = F.struct(F.lit(0).cast(whole).alias("under"), F.lit(0).cast("decimal(38,0)").alias("inv"))
    pairs = F.aggregate(
        F.reverse(rows), start,
        lambda t, r: F.struct((t["under"] + r["u"]).cast(whole).alias("under"), (t["inv"] + r["n"].cast(whole) * t["under"]).cast("decimal(38,0)").alias("inv")),
    )
    return scanned.select("p", pairs["inv"].alias("inv"))


def discordant(cells: DataFrame, block: int = BLOCK, fan: int = FAN) -> dict[int, int]:
    """{p: pairs with (x - x')(y - y') < 0} for rows (p, x, y) without nulls: a merge sort that counts inversions.

    With each p's rows in (x, y) order these are the inversions of y. Positions are cut into blocks
    whose inversions one task counts. Then ``fan`` blocks at a time are merged, level by level:
    a merged group's rows are cut by y, so that a task sees a slice of y and counts the
    inversions between blocks in it, and the inversions between slices follow from how many
    rows of each block lie in each slice. A value of y that fills a slice is a slice by itself,
    and has none inside.
    """
    rows = ordered_scan(cells.select("p", "x", "y"), PositionKernel("at"), ["x", "y"], ["p"])
    rows = reliable_checkpoint(rows.withColumn("b", F.floor(F.col("at") / block)))
    found = in_tasks(rows, ["p", "b"], ["at"])
    most = rows.agg(F.max("b")).first()[0] or 0
    width = 1
    while width <= most:
        level = rows.select("p", "y", F.floor(F.col("b") / (width * fan)).alias("g"), (F.floor(F.col("b") / width) % fan).cast("int").alias("c"))
        held = level.groupBy("p", "g", "y").agg(F.count(F.lit(1)).alias("cnt"))
        before = ordered_scan(held, CumulativeKernel("cnt", "before"), ["y"], ["p", "g"])
        heavy = F.col("cnt") > block
        cuts = before.select("p", "g", "y", (F.floor(F.col("before") / block) * 2 + heavy.cast("int")).alias("s"), heavy.alias("heavy"))
        cut = reliable_checkpoint(level.join(cuts, ["p", "g", "y"]))
        found = found.unionAll(in_tasks(cut.where("NOT heavy"), ["p", "g", "s"], ["c", "y"])).unionAll(between(cut, fan))
        width *= fan
    return {r["p"]: int(r["inv"]) for r in found.groupBy("p").agg(F.sum("inv").alias("inv")).collect()}


def kendall(df: DataFrame, columns: list[Column], pairs: list[tuple[int, int]] | None = None, block: int = BLOCK, fan: int = FAN) -> dict[tuple[int, int], tuple]:
    """{(i, j): (tau-b, n)} over the rows where both columns have a value; no tau where a column doesn't vary.

    tau-b = (n0 - n1 - n2 + n3 - 2 D) / sqrt((n0 - n1)(n0 - n2)), where n1, n2, n3 are the pairs of
    rows tied in x, in y and in both (grouped counts), and D the discordant pairs.
    """
    pairs = list(combinations(range(len(columns)), 2)) if pairs is None else pairs
    if not pairs:
        return {}
    rows = numbers(df, columns)
    x = [F.col(f"c{i}") for i in range(len(columns))]
    entries = [
        F.struct(F.lit(p).alias("p"), F.when(x[j].isNotNull(), x[i]).alias("x"), x[j].alias("y")) for p, (i, j) in enumerate(pairs)
    ]
    cells = stacked(rows.drop("__rid"), entries, "x")
    whole = F.col("n").cast("decimal(19,0)")
    tied = {}
    for keys in ((), ("x",), ("y",), ("x", "y")):
        counted = cells.groupBy("p", *keys).agg(F.count(F.lit(1)).alias("n"))
        found = counted.groupBy("p").agg(F.sum(whole * (whole - 1)).alias("twice"), F.sum("n").alias("n")).collect()
        tied[keys] = {r["p"]: (int(r["twice"]) // 2, r["n"]) for r in found}
    crossed = discordant(cells, block, fan)
    out = {}
    for p, pair in enumerate(pairs):
        n0, n = tied[()].get(p, (0, 0))
        n1, n2, n3 = (tied[keys].get(p, (0, 0))[0] for keys in (("x",), ("y",), ("x", "y")))
        varied = (n0 - n1) * (n0 - n2)
        out[pair] = ((n0 - n1 - n2 + n3 - 2 * crossed.get(p, 0)) / math.sqrt(varied) if varied else None, n)
    return out
