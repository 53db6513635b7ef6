"""Ordered scans over a whole table without a single-partition window.

pandas leans on row order (ffill, rolling means, interpolation, ranks). A Spark window
with ``orderBy`` and no ``partitionBy`` moves every row into one task, and a window
partitioned by a group key moves a hot group into one task. Both are avoided here:

1. The rows are counted. A table, or a group, that fits a slice of ``ROWS`` rows needs nothing else: a
   plain window does it.
2. Otherwise a sample of sort keys (chosen by their hash, so the same rows each time) gives
   bounds that cut each large group into slices. A row's slice is a function of its own sort
   key, found by binary search: no checkpoint is needed for it to hold in every stage.
3. The scan is a window over (group, slice), one exchange.
4. What a slice needs from its neighbours (the last value, counts, totals, the values next to
   its ends) comes from an edge table: one row for each slice of a cut group, aggregated from the keys and
   the scanned columns only, chained by windows over the slices and joined back. It has at most
   two rows a bound, which is what makes its broadcast safe.

Everything stays in the JVM, and a scan is lazy but for the count and the sample.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, MapType, TimestampNTZType, TimestampType

ROWS = 250_000  # of a slice, while there are at most SLICES of them
SLICES = 16_384  # of a table; beyond, slices grow
SAMPLE = 16  # sampled keys a slice
TIE, SLICE = "__tie", "__slice"


def _sort_exprs(order_by, partition_by):
    return [F.col(f"`{c}`").asc_nulls_first() for c in [*partition_by, *order_by]]


def with_tie_breaker(df: DataFrame, order_by, partition_by=()) -> tuple[DataFrame, list[str]]:
    """Make the order total: rows with equal keys are ordered by a 64-bit hash of their
    remaining columns (pandas' row order has no Spark counterpart). One compact long keeps
    the sort keys small even for wide text rows."""
    used = set(order_by) | set(partition_by)
    rest = [f.name for f in df.schema.fields if f.name not in used and not isinstance(f.dataType, MapType)]
    if not rest:
        return df, list(order_by)
    return df.withColumn(TIE, F.xxhash64(*[F.col(f"`{c}`") for c in rest])), list(order_by) + [TIE]


def sortable(df: DataFrame, column: str) -> Column:
    """A sort key in a form that keeps its order and that the driver can hold: dates and timestamps become whole numbers."""
    c, kind = F.col(f"`{column}`"), df.schema[column].dataType
    if isinstance(kind, DateType):
        return F.unix_date(c)
    if isinstance(kind, TimestampType):
        return F.unix_micros(c)
    if isinstance(kind, TimestampNTZType):
        seconds = F.hour(c) * 3600 + F.minute(c) * 60 + F.expr(f"extract(second from `{column}`)")
        return F.unix_date(c.cast("date")).cast("long") * 86_400_000_000 + (seconds * 1_000_000).cast("long")
    return c


def slice_bounds(df: DataFrame, order_by, partition_by=(), num_partitions: int | None = None) -> list[tuple]:
    """Sort keys (partition_by, order_by; ``sortable``) that begin a new slice inside a large group, in order.

    ``num_partitions`` sets the number of slices for a table that is one group. Rows whose whole
    sort key agrees can't be told apart and lie in one slice.
    """
    rows = df.count()
    size = -(-rows // num_partitions) if num_partitions else max(ROWS, -(-rows // SLICES))
    if rows <= size:
        return []
    keys = [*partition_by, *order_by]
    step = max(1, size // SAMPLE)
    # the k-th column of the sample is called k: column names may hold anything
    narrow = df.select(*[sortable(df, c).alias(f"k{i}") for i, c in enumerate(keys)])
    names = narrow.columns
    sample = narrow.where(F.pmod(F.xxhash64(*names), F.lit(step)) == 0).groupBy(*names).count()
    found = sample.orderBy(*[F.col(k).asc_nulls_first() for k in names]).collect()
    bounds, at = [], 0
    while at < len(found):
        group = found[at][: len(partition_by)]
        end = at
        while end < len(found) and found[end][: len(partition_by)] == group:
            end += 1
        held = sum(r["count"] for r in found[at:end]) * step
        pieces = -(-held // size) if held > 1.5 * size or not partition_by else 1
        before, cut = 0, 1
        for row in found[at:end]:
            if cut < pieces and before * step >= cut * held / pieces:
                bounds.append(tuple(row)[: len(keys)])
                while cut < pieces and before * step >= cut * held / pieces:
                    cut += 1
            before += row["count"]
        at = end
    return bounds


def _typed(values, types, names) -> Column:
    return F.struct(*[F.lit(v).cast(t).alias(n) for v, t, n in zip(values, types, names, strict=True)])


def slice_number(df: DataFrame, keys: list[str], bounds: list[tuple]) -> Column:
    """How many bounds a row's sort key has reached, by binary search over them."""
    names = [f"k{i}" for i in range(len(keys))]
    parts = [sortable(df, k).alias(n) for k, n in zip(keys, names, strict=True)]
    types, own = [f.dataType for f in df.select(*parts).schema.fields], F.struct(*parts)
    every = F.array(*[_typed(b, types, names) for b in bounds])
    rounds = F.array(*[F.lit(1 << b) for b in reversed(range(len(bounds).bit_length()))])
    # the largest number whose bound is reached, bit by bit
    reached = lambda n, width: (n + width <= len(bounds)) & (F.get(every, n + width - 1) <= own)
    return F.aggregate(rounds, F.lit(0), lambda n, width: F.when(reached(n, width), n + width).otherwise(n))


class Scan:
    """A table in (partition_by, order_by) order, cut into slices where a group is large."""

    def __init__(self, df: DataFrame, order_by, partition_by=(), num_partitions: int | None = None) -> None:
        self.keys = list(partition_by)
        rows, self.order = with_tie_breaker(df, list(order_by), self.keys)
        bounds = slice_bounds(rows, self.order, self.keys, num_partitions)
        self.sliced = bool(bounds)
        number = slice_number(rows, [*self.keys, *self.order], bounds) if bounds else F.lit(0)
        self.rows = rows.withColumn(SLICE, number)
        # groups that a bound may cut: at most one a bound
        self.cut = list(dict.fromkeys(b[: len(self.keys)] for b in bounds))

    def window(self, reverse: bool = False):
        """The rows of a slice up to the current one, from its start or, reversed, from its end."""
        order = [F.col(f"`{c}`").desc_nulls_last() if reverse else F.col(f"`{c}`").asc_nulls_first() for c in self.order]
        held = Window.partitionBy(*[F.col(f"`{k}`") for k in self.keys], SLICE).orderBy(*order)
        return held.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def whole(self):
        return Window.partitionBy(*[F.col(f"`{k}`") for k in self.keys], SLICE)

    def edges(self, rows: DataFrame, **aggregates: Column) -> DataFrame:
        """One row for each slice of a cut group: g0, g1, ... (the group), SLICE and the aggregates."""
        if self.keys:
            own = [sortable(rows, k).alias(f"c{i}") for i, k in enumerate(self.keys)]
            cut = rows.sparkSession.createDataFrame(self.cut, rows.select(*own).schema)
            same = [sortable(rows, k).eqNullSafe(F.col(f"c{i}")) for i, k in enumerate(self.keys)]
            rows = rows.join(F.broadcast(cut), same, "left_semi")
        group = [F.col(f"`{k}`").alias(f"g{i}") for i, k in enumerate(self.keys)]
        return rows.groupBy(*group, SLICE).agg(*[a.alias(n) for n, a in aggregates.items()])

    def along(self, *also: str, reverse: bool = False):
        """The edge rows of a group, in order; at most as many as there are slices."""
        order = F.col(SLICE).desc() if reverse else F.col(SLICE).asc()
        return Window.partitionBy(*[f"g{i}" for i in range(len(self.keys))], *also).orderBy(order)

    def earlier(self, reverse: bool = False):
        return self.along(reverse=reverse).rowsBetween(Window.unboundedPreceding, -1)

    def attach(self, rows: DataFrame, edges: DataFrame) -> DataFrame:
        """The edge columns beside the rows of their slice, null in groups that aren't cut."""
        edges = edges.withColumnRenamed(SLICE, "__s")
        same = [F.col(f"`{k}`").eqNullSafe(F.col(f"g{i}")) for i, k in enumerate(self.keys)] + [F.col(SLICE) == F.col("__s")]
        return rows.join(F.broadcast(edges), same, "left").drop("__s", *[f"g{i}" for i in range(len(self.keys))])

    def numbered(self) -> DataFrame:
        """The rows with __rn, their number in the slice, from 1."""
        return self.rows.withColumn("__rn", F.row_number().over(self.window()).cast("long"))

    def neighbours(self, rows: DataFrame, value: Column, reach: int) -> DataFrame:
        """Adds __n (rows of the slice), __glen (rows of the group), __offset (rows of the group before the slice), and the
        up to ``reach`` values of the group just before and after the slice, __left and __right, in order."""
        if not self.sliced:
            nothing = F.array().cast("array<double>")
            count = F.count(F.lit(1)).over(self.whole())
            return rows.withColumns({"__n": count, "__glen": count, "__offset": F.lit(0).cast("long"), "__left": nothing, "__right": nothing})
        narrow = rows.select(*[F.col(f"`{k}`") for k in self.keys], SLICE, "__rn", value.alias("__x"))
        narrow = narrow.withColumn("__n", F.count(F.lit(1)).over(self.whole()))
        item = F.struct("__rn", "__x")
        edges = self.edges(
            narrow, __n=F.max("__n"),
            head=F.array_sort(F.collect_list(F.when(F.col("__rn") <= reach, item))),
            tail=F.array_sort(F.collect_list(F.when(F.col("__rn") > F.col("__n") - reach, item))),
        )
        edges = edges.withColumns({side: F.transform(side, lambda x: x["__x"]) for side in ("head", "tail")})
        full = F.when(F.col("__n") >= reach, 1).otherwise(0)
        for name, own, reverse in (("__left", "tail", False), ("__right", "head", True)):
            # from the last slice that fills the reach by itself on, the values add up
            every = lambda *also, r=reverse: self.along(*also, reverse=r).rowsBetween(Window.unboundedPreceding, 0)
            edges = edges.withColumn("__f", F.sum(full).over(every()))
            lists = F.collect_list(own).over(every("__f"))
            joined = F.flatten(F.reverse(lists) if reverse else lists)
            size = F.size(joined)
            near = F.slice(joined, 1, F.least(size, F.lit(reach))) if reverse else F.slice(joined, F.greatest(size - reach, F.lit(0)) + 1, F.lit(reach))
            edges = edges.withColumn("__near", near).withColumn(name, F.lag("__near").over(self.along(reverse=reverse))).drop("__f", "__near")
        group = Window.partitionBy(*[f"g{i}" for i in range(len(self.keys))])
        edges = edges.withColumns({"__glen": F.sum("__n").over(group), "__offset": F.coalesce(F.sum("__n").over(self.earlier()), F.lit(0))})
        rows = self.attach(rows, edges.withColumnRenamed("__n", "__en").drop("head", "tail"))
        own = F.count(F.lit(1)).over(self.whole())
        nothing = F.array().cast("array<double>")
        return rows.withColumns(
            {
                "__n": own, "__glen": F.coalesce("__glen", own), "__offset": F.coalesce("__offset", F.lit(0)),
                "__left": F.coalesce("__left", nothing), "__right": F.coalesce("__right", nothing),
            }
        ).drop("__en")


class Kernel:
    """What a scan computes: ``add`` gives the scan's rows with new or replaced columns; those of ``df`` and
    those whose names don't begin with two underscores stay, and ``output``."""

    output: str | None = None

    def add(self, scan: Scan) -> DataFrame:
        raise NotImplementedError


def ordered_scan(df: DataFrame, kernel: Kernel, order_by, partition_by=(), num_partitions: int | None = None) -> DataFrame:
    """Apply ``kernel`` to ``df`` in (partition_by, order_by) order."""
    out = kernel.add(Scan(df, order_by, partition_by, num_partitions))
    new = [c for c in out.columns if c not in df.columns and (not c.startswith("__") or c == kernel.output)]
    return out.select(*[F.col(f"`{c}`") for c in [*df.columns, *new]])


def _number(column: str) -> Column:
    """The column as a double, NaN counted as missing."""
    x = F.col(f"`{column}`").cast("double")
    return F.when(~F.isnan(x), x)


class FillKernel(Kernel):
    """Forward (``ffill``) or backward (``bfill``) fill inside each group."""

    def __init__(self, columns, direction="ffill"):
        self.columns = list(columns)
        self.direction = direction

    def add(self, scan):
        reverse = self.direction != "ffill"
        window, rows = scan.window(reverse), scan.rows
        local = {c: F.last(F.col(f"`{c}`"), ignorenulls=True).over(window) for c in self.columns}
        if not scan.sliced:
            return rows.withColumns(local)
        place = F.struct(*[F.col(f"`{c}`") for c in scan.order])
        pick = F.min_by if reverse else F.max_by
        names = {c: f"__e{i}" for i, c in enumerate(self.columns)}
        ends = {e: pick(F.col(f"`{c}`"), F.when(F.col(f"`{c}`").isNotNull(), place)) for c, e in names.items()}
        narrow = rows.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*scan.keys, *scan.order, *self.columns])], SLICE)
        edges = scan.edges(narrow, **ends)
        edges = edges.withColumns({e: F.last(e, ignorenulls=True).over(scan.earlier(reverse)) for e in names.values()})
        return scan.attach(rows, edges).withColumns({c: F.coalesce(local[c], F.col(e)) for c, e in names.items()})


class InterpolateKernel(Kernel):
    """Linear interpolation by row position; head gaps stay, tail gaps carry the last value."""

    def __init__(self, columns):
        self.columns = list(columns)

    def add(self, scan):
        rows = scan.numbered()
        known = {c: F.when(_number(c).isNotNull(), F.struct(F.col("__rn").alias("p"), _number(c).alias("v"))) for c in self.columns}
        if scan.sliced:
            narrow = rows.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*scan.keys, *self.columns])], SLICE, "__rn")
            ends = {"__cnt": F.max("__rn")}
            for i, c in enumerate(self.columns):
                ends |= {f"__a{i}": F.min(known[c]), f"__b{i}": F.max(known[c])}
            edges = scan.edges(narrow, **ends)
            edges = edges.withColumn("__offset", F.coalesce(F.sum("__cnt").over(scan.earlier()), F.lit(0)))
            for i in range(len(self.columns)):
                for end, reverse in (("__a", True), ("__b", False)):
                    at = F.col(f"{end}{i}")
                    moved = F.when(at.isNotNull(), F.struct((at["p"] + F.col("__offset")).alias("p"), at["v"].alias("v")))
                    edges = edges.withColumn(f"{end}{i}", F.last(moved, ignorenulls=True).over(scan.earlier(reverse)))
            rows = scan.attach(rows, edges.drop("__cnt")).withColumn("__offset", F.coalesce("__offset", F.lit(0)))
            rows = rows.withColumn("__rn", F.col("__rn") + F.col("__offset"))
        out = {}
        for i, c in enumerate(self.columns):
            before, after = (F.last(known[c], ignorenulls=True).over(scan.window(r)) for r in (False, True))
            if scan.sliced:
                before, after = F.coalesce(before, F.col(f"__b{i}")), F.coalesce(after, F.col(f"__a{i}"))
            rows = rows.withColumns({f"__p{i}": before, f"__q{i}": after})
            p, q = F.col(f"__p{i}"), F.col(f"__q{i}")
            line = p["v"] + (q["v"] - p["v"]) / (q["p"] - p["p"]).cast("double") * (F.col("__rn") - p["p"])
            out[c] = F.when(_number(c).isNotNull(), _number(c)).when(q.isNull(), p["v"]).when(p.isNotNull(), line)
        return rows.withColumns(out)


class RollingMeanKernel(Kernel):
    """Trailing mean over ``window`` rows; ``min_count`` non-null values required."""

    def __init__(self, column, window, min_count=1, output=None):
        self.column, self.window, self.min_count = column, int(window), int(min_count)
        self.output = output or column

    def add(self, scan):
        x = _number(self.column)
        if not scan.sliced:
            frame = scan.window().rowsBetween(1 - self.window, 0)
            return scan.rows.withColumn(self.output, F.when(F.count(x).over(frame) >= max(self.min_count, 1), F.avg(x).over(frame)))
        rows = scan.neighbours(scan.numbered(), x, self.window - 1)
        return rows.withColumn(self.output, trailing_mean(scan, x, self.window, self.min_count))


def trailing_mean(scan: Scan, x: Column, window: int, min_count: int) -> Column:
    """Mean of the last ``window`` rows, those before the slice (``neighbours``) included."""
    frame = scan.window().rowsBetween(1 - window, 0)
    size = F.size("__left")
    more = F.least(size, F.greatest(F.lit(window) - F.col("__rn").cast("int"), F.lit(0)))
    outside = F.filter(F.slice("__left", size - more + 1, more), lambda v: v.isNotNull())
    total = F.aggregate(outside, F.lit(0.0), lambda a, v: a + v) + F.coalesce(F.sum(x).over(frame), F.lit(0.0))
    count = F.size(outside) + F.count(x).over(frame)
    return F.when(count >= max(min_count, 1), total / count)


def savgol_coeffs(window: int, order: int, pos: int | None = None) -> np.ndarray:
    """Least-squares polynomial smoothing weights for the sample at offset ``pos``."""
    half = window // 2
    pos = half if pos is None else pos
    t = np.arange(window, dtype=float) - pos
    A = np.vander(t, order + 1, increasing=True)
    return np.linalg.pinv(A)[0]


class SavgolKernel(Kernel):
    """Savitzky-Golay smoothing, polynomial fit at the group edges (SciPy's ``interp`` mode)."""

    def __init__(self, column, window, order, fill_value, output=None):
        self.column, self.window, self.order = column, int(window), int(order)
        self.fill = float(fill_value) if fill_value is not None else math.nan
        self.output = output or column

    def add(self, scan):
        w, half, x = self.window, self.window // 2, _number(self.column)
        fill = F.lit(self.fill)
        rows = scan.neighbours(scan.numbered(), x, w - 1)
        near = F.collect_list(F.coalesce(x, fill)).over(scan.window().rowsBetween(1 - w, w - 1))
        left, right = (F.transform(side, lambda v: F.coalesce(v, fill)) for side in ("__left", "__right"))
        rn, n, reach = F.col("__rn").cast("int"), F.col("__n").cast("int"), F.lit(w - 1)
        inner = F.least(rn - 1, reach)  # rows of the slice before this one, within reach
        more_left = F.least(F.size(left), reach - inner)
        more_right = F.least(F.size(right), reach - F.least(n - rn, reach))
        around = F.concat(F.slice(left, F.size(left) - more_left + 1, more_left), near, F.slice(right, F.lit(1), more_right))
        rows = rows.withColumns({"__around": around, "__at": more_left + inner, "__pos": F.col("__rn") - 1 + F.col("__offset")})
        rows = rows.withColumn("__short", trailing_mean(scan, x, w, 1))  # too short a group for the window
        # the place in a window of the polynomial that gives the row: its middle, but for the group's first and last rows
        last = F.col("__glen") - w
        place = F.when(F.col("__pos") < half, F.col("__pos")).when(F.col("__pos") >= F.col("__glen") - half, F.col("__pos") - last).otherwise(half)
        rows = rows.withColumn("__place", place.cast("int"))
        begin = F.col("__at") - F.col("__place")
        inside = sum(F.get("__around", begin + k) * F.lit(float(c)) for k, c in enumerate(savgol_coeffs(w, self.order)))
        # the few rows next to a group's ends look their place's weights up
        weights = F.array(*[F.array(*[F.lit(float(c)) for c in savgol_coeffs(w, self.order, g)]) for g in range(w)])
        products = F.zip_with(F.slice("__around", F.greatest(begin, F.lit(0)) + 1, F.lit(w)), F.get(weights, "__place"), lambda v, c: v * c)
        smooth = F.when(F.col("__place") == half, inside).otherwise(F.aggregate(products, F.lit(0.0), lambda total, p: total + p))
        smooth = F.when(~F.isnan(smooth), smooth)
        return rows.withColumn(self.output, F.when(F.col("__glen") > w, smooth).otherwise(F.col("__short")))


class PositionKernel(Kernel):
    """Row position inside the group, from 0."""

    def __init__(self, group_pos="_pos"):
        self.output = group_pos

    def add(self, scan):
        rows = scan.numbered()
        if not scan.sliced:
            return rows.withColumn(self.output, F.col("__rn") - 1)
        counts = scan.edges(scan.rows.select(*[F.col(f"`{k}`") for k in scan.keys], SLICE), __cnt=F.count(F.lit(1)))
        edges = counts.withColumn("__offset", F.sum("__cnt").over(scan.earlier())).drop("__cnt")
        return scan.attach(rows, edges).withColumn(self.output, F.col("__rn") - 1 + F.coalesce("__offset", F.lit(0)))


class CumulativeKernel(Kernel):
    """Running totals before each row inside its group, of one column or of several."""

    def __init__(self, weight, output="before"):
        self.totals = {output: weight} if isinstance(weight, str) else dict(zip(output, weight, strict=True))

    def add(self, scan):
        before = scan.window().rowsBetween(Window.unboundedPreceding, -1)
        local = {o: F.coalesce(F.sum(F.col(f"`{w}`")).over(before), F.lit(0)) for o, w in self.totals.items()}
        if not scan.sliced:
            return scan.rows.withColumns(local)
        narrow = scan.rows.select(*[F.col(f"`{k}`") for k in dict.fromkeys([*scan.keys, *self.totals.values()])], SLICE)
        held = {f"__t{i}": w for i, w in enumerate(self.totals.values())}
        edges = scan.edges(narrow, **{t: F.sum(F.col(f"`{w}`")) for t, w in held.items()})
        edges = edges.withColumns({t: F.sum(t).over(scan.earlier()) for t in held})
        rows = scan.attach(scan.rows, edges)
        return rows.withColumns({o: local[o] + F.coalesce(t, F.lit(0)) for o, t in zip(self.totals, held, strict=True)})


def value_counts_cumulative(df: DataFrame, column: str, num_partitions=None) -> DataFrame:
    """(value, cnt, before): distinct non-null values in order with the rows before them.

    Values are counted first (map-side combine), so a value repeated in a third of the
    rows is one row here.
    """
    counts = df.where(F.col(f"`{column}`").isNotNull()).groupBy(F.col(f"`{column}`").alias("value")).agg(
        F.count(F.lit(1)).alias("cnt")
    )
    return ordered_scan(counts, CumulativeKernel("cnt", "before"), ["value"], (), num_partitions)


def average_rank(df: DataFrame, column: str, output: str, num_partitions=None) -> DataFrame:
    """1-based average rank of ``column`` among the non-null rows of ``df`` (ties share it)."""
    ranks = value_counts_cumulative(df, column, num_partitions).select(
        F.col("value").alias("__rv"), (F.col("before") + (F.col("cnt") + 1) / 2.0).alias(output)
    )
    return df.join(ranks, F.col(f"`{column}`") == F.col("__rv"), "left").drop("__rv")


def exact_quantiles_multi(df: DataFrame, columns, probs, num_partitions=None) -> dict:
    """Linear-interpolated quantiles (pandas/NumPy "linear") of several columns, exact.

    One job for all columns: values are unpivoted to (column index, value), counted
    (map-side combine), range-partitioned by (column, value) and scanned for running
    counts; only the rows holding the wanted ranks reach the driver. No task ever holds
    a whole column.
    """
    columns, probs = list(columns), list(probs)
    if not columns:
        return {}
    stacked = df.select(
        F.explode(F.array(*[F.struct(F.lit(i).alias("ci"), F.col(f"`{c}`").cast("double").alias("v")) for i, c in enumerate(columns)])).alias("r")
    ).select("r.ci", "r.v").where(F.col("v").isNotNull() & ~F.isnan("v"))
    counts = stacked.groupBy("ci", "v").agg(F.count(F.lit(1)).alias("cnt"))
    scanned = ordered_scan(counts, CumulativeKernel("cnt", "before"), ["v"], ["ci"], num_partitions)
    totals = {r["ci"]: r["n"] for r in counts.groupBy("ci").agg(F.sum("cnt").alias("n")).collect()}
    wanted = {}
    cond = None
    for i in range(len(columns)):
        n = totals.get(i)
        if not n:
            continue
        ranks = sorted({r for p in probs for r in (int(np.floor(p * (n - 1))), int(np.ceil(p * (n - 1))))})
        wanted[i] = ranks
        for r in ranks:
            c = (F.col("ci") == i) & (F.col("before") <= F.lit(r)) & (F.lit(r) < F.col("before") + F.col("cnt"))
            cond = c if cond is None else cond | c
    rows = scanned.where(cond).select("ci", "v", "before", "cnt").collect() if cond is not None else []
    out = {}
    for i, c in enumerate(columns):
        n = totals.get(i)
        if not n:
            out[c] = [None for _ in probs]
            continue
        mine = [r for r in rows if r["ci"] == i]

        def at(rank):
            for row in mine:
                if row["before"] <= rank < row["before"] + row["cnt"]:
                    return float(row["v"])
            return None

        vals = []
        for p in probs:
            h = p * (n - 1)
            lo, hi = int(np.floor(h)), int(np.ceil(h))
            a, b = at(lo), at(hi)
            vals.append(a + (h - lo) * (b - a))
        out[c] = vals
    return out


def exact_quantiles(df: DataFrame, column: str, probs, num_partitions=None) -> list:
    """Exact linear-interpolated quantiles of one column (see ``exact_quantiles_multi``)."""
    return exact_quantiles_multi(df, [column], probs, num_partitions)[column]
