"""T11 ``rebalance``: exact, seeded over- and under-sampling per class.

Rows are ordered inside their class by a seeded hash. For oversampling their positions come
from an ordered scan over (class, hash), which spreads a majority class over many tasks.

* undersample finds each class's hash of the last kept row by counting hashes in bins of
  falling width, and then filters by it: no row is moved;
* oversample numbers the rows of a class and draws, for class c with n_c rows, m_c positions
  ``pmod(hash(seed, c, i), n_c)`` for i < m_c; the draws are generated by ``spark.range``
  (distributed) and equi-joined on (class, position), so no task builds a class alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from tamis.functions.exprs import stable_hash
from tamis.functions.ordering import PositionKernel, ordered_scan
from tamis.operators.base import FittedStep, Step, StepError, clamp, col, register_step

MAX_CLASSES = 10_000
DRAW_CHUNK = 1_000_000
HASH_BITS, ROUND_BITS = 60, 10
BRACKET_ROWS = 20_000  # hashes of one class that are sorted in one task


def class_counts(df: DataFrame, target: str) -> list[tuple]:
    rows = df.where(col(target).isNotNull()).groupBy(col(target).alias("cls")).count().limit(MAX_CLASSES + 1).collect()
    if len(rows) > MAX_CLASSES:
        raise StepError(f"rebalance: more than {MAX_CLASSES} classes")
    return sorted(((r["cls"], r["count"]) for r in rows), key=lambda t: (-t[1], str(t[0])))


def with_hash(df: DataFrame, target: str, key_cols, seed: int) -> DataFrame:
    return df.where(col(target).isNotNull()).withColumn("__h", stable_hash([col(c) for c in key_cols], seed))


def class_table(df: DataFrame, target: str, rows: list[tuple], *names: str) -> DataFrame:
    """A small table (__cls, names...) to broadcast: one row a class."""
    kinds = [StructField(n, BooleanType() if n == "__whole" else LongType()) for n in names]
    return F.broadcast(df.sparkSession.createDataFrame(rows, StructType([StructField("__cls", df.schema[target].dataType), *kinds])))


def last_hashes(keyed: DataFrame, target: str, counts: dict, size: int) -> list[tuple]:
    """For each class with more than ``size`` rows: (class, its hash of rank ``size``, rows up to and with that hash, those below it).

    Each round counts the rows of the current bracket (a common beginning of the hash's
    bits) in 1,024 bins and keeps the bin that holds the rank; a bracket of at most ``BRACKET_ROWS``
    rows, or of one hash, is then sorted. Only counts are shuffled.
    """
    left = HASH_BITS  # bits that are open
    brackets = [(c, 0, 0, n) for c, n in counts.items() if n > size]  # class, beginning, rows below, rows inside
    while brackets and left and max(b[3] for b in brackets) > BRACKET_ROWS:
        left -= ROUND_BITS
        known = class_table(keyed, target, [b[:3] for b in brackets], "__start", "__below")
        inside = keyed.join(known, col(target) == F.col("__cls")).where(F.shiftright("__h", left + ROUND_BITS) == F.col("__start"))
        bins = inside.groupBy("__cls", "__below", F.shiftright("__h", left).alias("__start")).count()
        upto = F.col("__below") + F.sum("count").over(Window.partitionBy("__cls").orderBy("__start"))
        found = bins.withColumn("upto", upto).where(F.col("upto") >= size).where(F.col("upto") - F.col("count") < size).collect()
        brackets = [(r["__cls"], r["__start"], r["upto"] - r["count"], r["count"]) for r in found]
    if not brackets:
        return []
    known = class_table(keyed, target, [b[:3] for b in brackets], "__start", "__below")
    inside = keyed.join(known, col(target) == F.col("__cls")).where(F.shiftright("__h", left) == F.col("__start"))
    upto = F.col("__below") + F.sum("count").over(Window.partitionBy("__cls").orderBy("__h"))
    hashes = inside.groupBy("__cls", "__below", "__h").count().withColumn("upto", upto)
    found = hashes.where(F.col("upto") >= size).where(F.col("upto") - F.col("count") < size).collect()
    return [(r["__cls"], r["__h"], r["upto"], r["upto"] - r["count"]) for r in found]


def undersample(df: DataFrame, target: str, counts: dict, size: int, key_cols, seed: int, num_partitions=None) -> DataFrame:
    """The first ``size`` rows of each class in the order of hash, then key columns; smaller classes whole.

    One filter, unless rows share the last hash and only some of them have room (repeated
    rows): those alone are numbered.
    """
    keyed = with_hash(df, target, key_cols, seed)
    last = last_hashes(keyed, target, counts, size)
    cut = {c for c, *_ in last}
    limits = [(c, h, upto == size, size - below) for c, h, upto, below in last] + [(c, 1 << HASH_BITS, True, 0) for c in counts if c not in cut]
    placed = keyed.join(class_table(df, target, limits, "__last", "__whole", "__room"), col(target) == F.col("__cls"))
    kept = placed.where((F.col("__h") < F.col("__last")) | (F.col("__whole") & (F.col("__h") == F.col("__last")))).select(*df.columns)
    if all(whole for _, _, whole, _ in limits):
        return kept
    tied = placed.where(~F.col("__whole") & (F.col("__h") == F.col("__last"))).select(*keyed.columns, "__room")
    numbered = ordered_scan(tied, PositionKernel("__pos"), ["__h", *key_cols], [target], num_partitions)
    return kept.unionByName(numbered.where(F.col("__pos") < F.col("__room")).select(*df.columns))


def with_class_position(df: DataFrame, target: str, key_cols, seed: int, num_partitions=None) -> DataFrame:
    keyed = with_hash(df, target, key_cols, seed)
    return ordered_scan(keyed, PositionKernel("__pos"), ["__h", *key_cols], [target], num_partitions)


def rebalance(df: DataFrame, target: str, method="oversample", ratio=1.0, seed=42, key_cols=None, num_partitions=None) -> DataFrame:
    ratio = clamp(float(ratio), 0.1, 10.0)
    counts = class_counts(df, target)
    if len(counts) < 2:
        raise StepError("rebalance: target column must have at least 2 classes")
    cols = df.columns
    key_cols = list(key_cols or cols)
    maj_cls, maj_n = counts[0]
    if method == "undersample":
        size = max(int(min(n for _, n in counts) * ratio), 100)
        return undersample(df, target, dict(counts), size, key_cols, seed, num_partitions)
    positioned = with_class_position(df, target, key_cols, seed, num_partitions)
    # oversample: majority as is, every other class replaced by m draws with replacement
    plan = [(c, n, min(int(maj_n * ratio), n * 10)) for c, n in counts[1:]]
    majority = positioned.where(col(target) == F.lit(maj_cls)).select(*cols)
    spark = df.sparkSession
    chunk_rows = [
        (c, lo, min(m, lo + DRAW_CHUNK), n) for c, n, m in plan for lo in range(0, m, DRAW_CHUNK)
    ]
    if not chunk_rows:
        return majority
    schema = StructType(
        [
            StructField("__cls", df.schema[target].dataType),
            StructField("lo", LongType()),
            StructField("hi", LongType()),
            StructField("n", LongType()),
        ]
    )
    # one small row per million draws; each task expands its chunks into draw indexes
    chunks = spark.createDataFrame(chunk_rows, schema)
    chunks = chunks.repartition(max(1, min(len(chunk_rows), spark.sparkContext.defaultParallelism)))
    draws = chunks.select("__cls", "n", F.explode(F.sequence("lo", F.col("hi") - 1)).alias("i"))
    draws = draws.select("__cls", F.pmod(stable_hash([F.col("__cls"), F.col("i")], seed), F.col("n")).alias("__dpos"))
    minority = positioned.where(col(target) != F.lit(maj_cls))
    sampled = minority.join(draws, (col(target) == F.col("__cls")) & (F.col("__pos") == F.col("__dpos")), "inner").select(*cols)
    return majority.unionByName(sampled)


@register_step("rebalance")
class Rebalance(Step):
    required = ("target", "method")
    rowwise = False

    def check_params(self):
        if self.params["method"] not in ("oversample", "undersample"):
            raise StepError("rebalance: method must be oversample or undersample")

    def fit(self, df):
        p = self.params
        return FittedStep(
            self.kind,
            p,
            {},
            lambda d: rebalance(d, p["target"], p["method"], p.get("ratio", 1.0), p.get("seed", 42), p.get("key_columns")),
        )
