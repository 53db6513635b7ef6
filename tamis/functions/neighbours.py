"""Nearest donors through a tree of cells, for points that may lack coordinates.

The distance is the Euclidean one over the coordinates both points have, scaled up to all of
them. A tree over a bounded sample of donors cuts space into at most ``MAX_CELLS`` cells; each
cell's box is then taken from all of its donors. A row first meets the donors of its own cell: its
k-th distance there bounds the true one, so that it goes on only to cells whose box lies
within that distance. Two rounds, exact for any data; rows whose own cell has no k donors go
to every cell that can hold any. Inside a cell, rows and donors meet in blocks, and a block's
donors are cut into leaves in the same way, so that a row is compared with few of them.
"""

from __future__ import annotations

from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELL = 4_096  # donors a cell should hold
MAX_CELLS = 4_096
SAMPLE = 16  # sampled donors a cell, at most; what the driver holds
LEAF = 64  # donors a leaf of a block should hold; more where k is large
AT_ONCE = 1_024
PAIRS = 65_536  # boxes or donors, times rows, held at a time
SLACK = 1e-9  # for the rounding of distances and boxes


def matrix(points) -> np.ndarray:
    """Points by row, absent coordinates as NaN."""
    return np.array([np.asarray(p, float) for p in points], float)


class Tree:
    """Complete binary tree of median cuts, flattened; a point that lacks the coordinate of a cut goes by the sample's median."""

    def __init__(self, sample: np.ndarray, cells: int, skip: int) -> None:
        self.depth = max(0, (cells - 1).bit_length())
        inner = 2**self.depth - 1
        self.feature, self.cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        if not len(sample):
            self.middle = np.zeros(sample.shape[1])
            return
        absent = np.isnan(sample)
        empty = absent.all(0)
        self.middle = np.where(empty, 0.0, np.nanmedian(np.where(empty, 0.0, sample), axis=0))
        parts = {0: np.where(absent, self.middle, sample)}
        for node in range(inner):
            rows = parts.pop(node)
            if len(rows):
                with np.errstate(invalid="ignore"):
                    spread = np.nan_to_num(rows.std(0), nan=0.0)  # none where values are endless
                spread[skip] = -1.0
                f = self.feature[node] = int(spread.argmax())
                cut = np.median(rows[:, f])
                if spread[f] > 0 and cut == rows[:, f].max():  # most rows have the greatest value
                    cut = rows[rows[:, f] < cut, f].max()
                self.cut[node] = cut
                right = rows[:, f] > cut
            else:
                right = np.zeros(0, bool)
            parts[2 * node + 1], parts[2 * node + 2] = rows[~right], rows[right]

    def cell(self, x: np.ndarray) -> np.ndarray:
        x = np.where(np.isnan(x), self.middle, x)
        node = np.zeros(len(x), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[np.arange(len(x)), self.feature[node]] > self.cut[node])
        return node - (2**self.depth - 1)


class Boxes:
    """Per cell and coordinate the least and greatest known value, and how many donors know it."""

    def __init__(self, rows, width: int) -> None:
        self.cells = np.array(sorted({r["cell"] for r in rows}), np.int64)
        place = {c: n for n, c in enumerate(self.cells.tolist())}
        shape = (len(self.cells), width)
        self.low, self.high = np.full(shape, np.nan), np.full(shape, np.nan)
        self.always, self.ever = np.zeros(shape, bool), np.zeros(shape, bool)
        for r in rows:
            at = place[r["cell"]], r["pos"]
            self.ever[at], self.always[at] = r["known"] > 0, r["known"] == r["donors"]
            if r["known"]:
                self.low[at], self.high[at] = r["low"], r["high"]

    @classmethod
    def over(cls, cells: np.ndarray, low: np.ndarray, high: np.ndarray, always: np.ndarray, ever: np.ndarray) -> Boxes:
        """Boxes around the parts given, in the order of their cells."""
        own = cls([], low.shape[1])
        own.cells, first = np.unique(cells, return_index=True)
        own.first, own.many = first, np.diff(first, append=len(cells))
        if len(cells):
            own.low, own.high = np.fmin.reduceat(low, first), np.fmax.reduceat(high, first)
            own.always, own.ever = np.logical_and.reduceat(always, first), np.logical_or.reduceat(ever, first)
        return own

    def levels(self) -> list[Boxes]:
        """These boxes, the boxes around pairs of them as the tree has them, and so on up to one around all."""
        found = [self]
        while len(found[-1].cells) > 1:
            b = found[-1]
            found.append(Boxes.over(b.cells >> 1, b.low, b.high, b.always, b.ever))
        return found

    def bound(self, x: np.ndarray, at=slice(None)) -> np.ndarray:
        """Least scaled squared distance that any donor of each cell can have; infinite where no coordinate is shared.

        ``x`` is one point, or one for each of the cells ``at``. The bound
        is a mean of squared gaps over shared coordinates. All that every donor knows take part; of the others, a
        donor may lack any, so the smallest gaps join as long as they lower the mean.
        """
        own = ~np.isnan(x)
        with np.errstate(invalid="ignore"):
            gap = np.fmax(np.fmax(self.low[at] - x, x - self.high[at]), 0.0) ** 2  # none between endless values
        always = self.always[at]
        firm, loose = own & always, own & self.ever[at] & ~always
        total, count = np.where(firm, gap, 0.0).sum(1), firm.sum(1)
        best = np.where(count > 0, total / np.maximum(count, 1), np.inf)
        if loose.any():
            extra = np.sort(np.where(loose, gap, np.inf), axis=1)
            for j in range(extra.shape[1]):
                total, count = total + extra[:, j], count + 1
                best = np.minimum(best, total / count)
        return best * x.shape[-1]


def within(levels: list[Boxes], x: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, box) numbers: the boxes of the lowest level that can hold a donor within a row's reach, from the top down."""
    row, box = np.arange(len(x)), np.zeros(len(x), np.int64)
    if not len(levels[-1].cells):
        return row[:0], box[:0]
    for n in range(len(levels) - 1, -1, -1):
        level, keep = levels[n], np.zeros(len(row), bool)
        for start in range(0, len(row), PAIRS):
            part = slice(start, start + PAIRS)
            bound = level.bound(x[row[part]], box[part])
            keep[part] = np.isfinite(bound) & (bound * (1 - SLACK) <= reach[row[part]] * (1 + SLACK))
        row, box = row[keep], box[keep]
        if n:
            row, box = spread(row, level.first[box], level.many[box])
    return row, box


def spread(row: np.ndarray, first: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row beside the ``many`` numbers from ``first`` on."""
    start = np.cumsum(many) - many
    return np.repeat(row, many), np.arange(many.sum()) + np.repeat(first - start, many)


def first_of_equal(points: np.ndarray, k: int) -> np.ndarray:
    """Ascending numbers of the points that have fewer than k equal ones before them."""
    keys = np.column_stack((np.nan_to_num(points), np.isnan(points)))
    order = np.lexsort(keys.T)
    new = np.append(True, (keys[order[1:]] != keys[order[:-1]]).any(1))
    start = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    return np.sort(order[np.arange(len(order)) - start < k])


class Leaves:
    """Donors of one block (ascending numbers, points) in leaves of a tree."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, at: int, k: int) -> None:
        self.k, self.values = k, points[:, at]
        self.tree = Tree(points, -(-len(ids) // max(LEAF, 4 * k)), at)
        leaf = self.tree.cell(points)
        order = np.argsort(leaf, kind="stable")
        self.ids, self.points, self.values = ids[order], points[order], self.values[order]
        self.known = ~np.isnan(self.points)
        self.filled = np.where(self.known, self.points, 0.0)
        self.boxes = Boxes.over(leaf[order], self.points, self.points, self.known, self.known)
        self.levels = self.boxes.levels()

    def distance(self, x: np.ndarray, row: np.ndarray, donor: np.ndarray) -> np.ndarray:
        own = ~np.isnan(x)
        square, common = np.zeros(len(row)), np.zeros(len(row))
        for c in np.flatnonzero(own.any(0)):
            both = own[row, c] & self.known[donor, c]
            with np.errstate(invalid="ignore"):
                square += np.where(both, (np.where(own[:, c], x[:, c], 0.0)[row] - self.filled[donor, c]) ** 2, 0.0)
            common += both
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where((common > 0) & ~np.isnan(square), square * (x.shape[1] / common), np.inf)

    def home(self, x: np.ndarray) -> np.ndarray:
        """A row's k-th distance in its own leaf; infinite where that has no k donors."""
        own = np.minimum(np.searchsorted(self.boxes.cells, self.tree.cell(x)), len(self.boxes.cells) - 1)
        reach = np.full(len(x), np.inf)
        many = self.boxes.many[own]
        step = max(1, PAIRS // int(many.max()))
        for start in range(0, len(x), step):
            part = slice(start, start + step)
            row, donor = spread(np.arange(len(x))[part], self.boxes.first[own[part]], many[part])
            near = np.full((len(many[part]), max(self.k, int(many[part].max()))), np.inf)
            near[np.arange(near.shape[1]) < many[part, None]] = self.distance(x, row, donor)
            reach[part] = np.partition(near, self.k - 1, axis=1)[:, self.k - 1]
        return reach

    def nearest(self, x: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, donor place, distance) of the k nearest within reach."""
        reach = np.minimum(reach, self.home(x))
        row, box = within(self.levels, x, reach)
        found, pairs = [], np.cumsum(self.boxes.many[box])
        slices = np.searchsorted(pairs, np.arange(0, pairs[-1] if len(pairs) else 0, PAIRS))
        for start, end in pairwise(np.unique([0, *slices, len(box)])):
            b = box[start:end]
            r, donor = spread(row[start:end], self.boxes.first[b], self.boxes.many[b])
            d = self.distance(x, r, donor)
            keep = np.isfinite(d) & (d <= reach[r])
            found.append((r[keep], donor[keep], d[keep]))
        if not found:
            return row[:0], row[:0], np.zeros(0)
        row, donor, d = (np.concatenate(f) for f in zip(*found, strict=True))
        order = np.lexsort((self.ids[donor], d, row))
        row, donor, d = row[order], donor[order], d[order]
        best = np.arange(len(row)) - np.searchsorted(row, row) < self.k
        return row[best], donor[best], d[best]


def compare(ask: pd.DataFrame, give: pd.DataFrame, names: list[str], at: int, k: int) -> pd.DataFrame:
    """The k nearest of ``give`` for each row of ``ask``, within its reach: distance, then donor number."""
    give = give.sort_values("donor")
    ids, points = give["donor"].to_numpy(), give[names].to_numpy(float)
    kept = first_of_equal(np.delete(points, at, 1), k)  # the rows lack the coordinate ``at``
    leaves, out = Leaves(ids[kept], points[kept], at, k), []
    rows, asked, reach = ask["__row"].to_numpy(), ask[names].to_numpy(float), ask["reach"].to_numpy(float)
    for start in range(0, len(ask), AT_ONCE):
        part = slice(start, start + AT_ONCE)
        row, donor, d = leaves.nearest(asked[part], reach[part])
        out.append(pd.DataFrame({"__row": rows[part][row], "donor": leaves.ids[donor], "d": d, "v": leaves.values[donor]}))
    return pd.concat(out)


class Search:
    """Donors (donor, x) that know coordinate ``at``, in cells; ``k`` nearest of them for rows (__row, x)."""

    def __init__(self, donors: DataFrame, at: int, k: int, block: int) -> None:
        self.at, self.k, self.block = at, k, block
        donors = donors.where(F.col("x")[at].isNotNull())
        size = donors.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("width")).first()
        self.many, self.width = size["n"], size["width"] or 1
        wanted = min(MAX_CELLS, max(1, self.many // CELL))
        share = min(1.0, wanted * SAMPLE / max(self.many, 1))
        picked = donors.where(F.pmod(F.xxhash64("donor", F.lit("tree")), F.lit(1_000_000)) < int(share * 1_000_000)) if wanted > 1 else donors.limit(0)
        sample = picked.select("x").limit(2 * wanted * SAMPLE).toPandas()["x"]
        self.tree = Tree(matrix(sample).reshape(-1, self.width), wanted, at)
        self.donors = donors.withColumn("cell", self.cell_of())
        sides = self.donors.select("cell", F.posexplode("x").alias("pos", "value")).groupBy("cell", "pos")
        rows = sides.agg(
            F.min("value").alias("low"), F.max("value").alias("high"), F.count("value").alias("known"), F.count("*").alias("donors")
        ).collect()  # at most MAX_CELLS rows a coordinate
        self.boxes = Boxes(rows, self.width)
        self.levels = self.boxes.levels()
        self.sizes = {r["cell"]: r["donors"] for r in rows}

    def cell_of(self) -> Column:
        tree = self.tree

        @F.pandas_udf("int")
        def cell(*x: pd.Series) -> pd.Series:
            return pd.Series(tree.cell(np.column_stack(x).astype(float)), index=x[0].index).astype("int32")

        return cell(*self.coordinates())

    def coordinates(self) -> list[Column]:
        return [F.col("x")[c].alias(f"x{c}") for c in range(self.width)]

    def meet(self, asked: DataFrame) -> DataFrame:
        """The k nearest donors in the named cell, within ``reach`` if there is one, for each (__row, x, cell), as (__row, donor, d, v)."""
        spark, at, k = asked.sparkSession, self.at, self.k
        names = [f"x{c}" for c in range(self.width)]
        if "reach" not in asked.columns:
            asked = asked.withColumn("reach", F.lit(float("inf")))
        counts = {r["cell"]: r["count"] for r in asked.groupBy("cell").count().collect()}  # at most MAX_CELLS rows
        grid = [(c, -(-n // self.block), -(-self.sizes[c] // self.block)) for c, n in counts.items() if c in self.sizes]
        cells = F.broadcast(spark.createDataFrame(grid, "cell int, across long, down long"))

        def blocks(key: str, own: str, mine: str, other: str, theirs: str):
            copies = F.explode(F.sequence(F.lit(0).cast("long"), F.col(theirs) - 1)).alias(other)
            return ["cell", key, *self.coordinates(), F.pmod(F.xxhash64(key), F.col(mine)).alias(own), copies]

        left = asked.join(cells, "cell").select("reach", *blocks("__row", "a", "across", "b", "down"))
        right = self.donors.join(cells, "cell").select(*blocks("donor", "b", "down", "a", "across"))

        def nearest(ask: pd.DataFrame, give: pd.DataFrame) -> pd.DataFrame:
            if ask.empty or give.empty:
                return pd.DataFrame({"__row": [], "donor": [], "d": [], "v": []}).astype({"__row": "int64", "donor": "int64"})
            return compare(ask, give, names, at, k)

        keys = ["cell", "a", "b"]
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(nearest, "__row long, donor long, d double, v double")

    def best(self, pairs: DataFrame) -> DataFrame:
        order = Window.partitionBy("__row").orderBy("d", "donor")
        return pairs.withColumn("n", F.row_number().over(order)).where(F.col("n") <= self.k)

    def visits(self, needy: DataFrame, first: DataFrame) -> DataFrame:
        """(__row, x, cell, reach): the further cells that can hold one of a row's k nearest donors, and its k-th distance so far."""
        levels, cells, k = self.levels, self.boxes.cells, self.k

        @F.pandas_udf("array<int>")
        def further(home: pd.Series, reach: pd.Series, *x: pd.Series) -> pd.Series:
            points, reached, found = np.column_stack(x).astype(float), reach.to_numpy(float), []
            for start in range(0, len(points), AT_ONCE):
                part = slice(start, start + AT_ONCE)
                row, box = within(levels, points[part], reached[part])
                other = cells[box] != home.to_numpy()[part][row]
                row, box = row[other], box[other]
                order = np.argsort(row, kind="stable")
                found += np.split(cells[box[order]], np.searchsorted(row[order], np.arange(1, len(points[part]))))
            return pd.Series(found, index=home.index)

        reach = first.groupBy("__row").agg(F.max("d").alias("d"), F.count("*").alias("got"))
        reach = reach.select("__row", F.when(F.col("got") >= k, F.col("d")).alias("reach"))
        known = needy.join(reach, "__row", "left").select("__row", "x", "cell", F.coalesce("reach", F.lit(float("inf"))).alias("reach"))
        return known.select("__row", "x", "reach", F.explode(further("cell", "reach", *self.coordinates())).alias("cell"))

    def mean(self, needy: DataFrame, settle) -> DataFrame:
        """(__row, value): the mean of coordinate ``at`` over each row's k nearest donors; rows that share no coordinate with any are absent."""
        if not self.many:
            return needy.select("__row", F.lit(None).cast("double").alias("value")).limit(0)
        needy = settle(needy.withColumn("cell", self.cell_of()))
        first = settle(self.best(self.meet(needy)).drop("n"))
        if len(self.boxes.cells) > 1:
            first = first.unionByName(self.meet(settle(self.visits(needy, first))))
        return self.best(first).groupBy("__row").agg(F.avg("v").alias("value"))
