"""Reusable column expressions (all JVM-side, inside whole-stage codegen)."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, StringType


def c_(name: str) -> Column:
    return F.col(f"`{name}`")


def is_missing(df: DataFrame, name: str) -> Column:
    """NULL, or NaN for floating columns (pandas counts both as missing)."""
    t = df.schema[name].dataType
    if isinstance(t, (DoubleType, FloatType)):
        return c_(name).isNull() | F.isnan(c_(name))
    return c_(name).isNull()


def nan_to_null(df: DataFrame) -> DataFrame:
    """Turn NaN into NULL in floating columns (Spark keeps them apart, pandas does not)."""
    if not any(isinstance(f.dataType, (DoubleType, FloatType)) for f in df.schema.fields):
        return df
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (DoubleType, FloatType)):
            out.append(F.when(~F.isnan(c_(f.name)), c_(f.name)).alias(f.name))
        else:
            out.append(c_(f.name))
    return df.select(*out)


def nan_as_null(fn):
    """For functions of a table: NaN counts as missing, as everywhere in this package."""

    @functools.wraps(fn)
    def wrapped(df, *args, **kwargs):
        return fn(nan_to_null(df), *args, **kwargs)

    return wrapped


BROADCAST_BYTES = 32_000_000


def bounded_broadcast(table: DataFrame) -> DataFrame:
    """Broadcast a lookup table if its measured bytes allow it; otherwise it is joined by a shuffle."""
    sizes = [F.coalesce(F.length(c_(f.name)), F.lit(0)) if isinstance(f.dataType, StringType) else F.lit(0) for f in table.schema.fields]
    size = table.agg(F.sum(sum(sizes, F.lit(16 * len(sizes))))).first()[0] or 0
    return F.broadcast(table) if size <= BROADCAST_BYTES else table


def clip(x: Column, lo, hi) -> Column:
    """Clip that keeps NULL as NULL (``greatest``/``least`` would skip the NULL)."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(lo)), F.lit(hi)))


def stable_hash(cols: list[Column], seed: int = 42) -> Column:
    """A 60-bit non-negative hash of the values, reproducible in any SQL engine with md5.

    Used for seeded, order-free sampling and hashing encoders.
    """
    parts = [F.lit(str(seed))] + [F.coalesce(c.cast("string"), F.lit("\u0000")) for c in cols]
    digest = F.md5(F.concat_ws("|", *parts))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def strftime_to_java(fmt: str) -> str:
    """Translate a Python strftime pattern into a Spark datetime pattern."""
    # Strftime directive -> Spark datetime pattern.
    table = {
        "%Y": "yyyy", "%y": "yy", "%m": "MM", "%d": "dd", "%H": "HH", "%I": "hh", "%M": "mm",
        "%S": "ss", "%f": "SSSSSS", "%p": "a", "%b": "MMM", "%B": "MMMM", "%a": "EEE", "%A": "EEEE",
        "%j": "DDD", "%Z": "z", "%z": "Z", "%%": "%",
    }
    out, i = [], 0
    literal = []
    while i < len(fmt):
        two = fmt[i : i + 2]
        if two in table:
            if literal:
                out.append("'" + "".join(literal).replace("'", "''") + "'")
                literal = []
            out.append(table[two])
            i += 2
        elif fmt[i] == "%":
            raise ValueError(f"unsupported strftime directive {two!r}")
        else:
            ch = fmt[i]
            if ch.isalpha() or ch == "'":
                literal.append(ch)
            else:
                if literal:
                    out.append("'" + "".join(literal).replace("'", "''") + "'")
                    literal = []
                out.append(ch)
            i += 1
    if literal:
        out.append("'" + "".join(literal).replace("'", "''") + "'")
    return "".join(out)
