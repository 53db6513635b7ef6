"""Header CSV with inferred (or given) types; the usual NA strings become NULL.

Spark reads any size the same way (file splits sized by
``spark.sql.files.maxPartitionBytes``), so the reference's pandas/Dask switch at 100 MB
has no counterpart.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tamis.functions.exprs import nan_to_null
from tamis.functions.fixed import CSV_DELIMITERS, CSV_ENCODINGS, NA_STRINGS
from tamis.operators.base import StepError, col


def null_out_na_strings(df: DataFrame) -> DataFrame:
    """Spark takes one ``nullValue``; the full NA list is applied in one projection."""
    return df.select(*_na_columns(df))


def _na_columns(df: DataFrame) -> list:
    texts = {f.name for f in df.schema.fields if isinstance(f.dataType, StringType)}
    return [F.when(~col(c).isin(*NA_STRINGS), col(c)).alias(c) if c in texts else col(c) for c in df.columns]


# What bytes 0x80 to 0x9F are in cp1252; elsewhere it is latin-1.
LATIN_ONLY = "".join(map(chr, range(0x80, 0xA0)))
CP1252_ONLY = bytes(range(0x80, 0xA0)).decode("cp1252", "replace")


def _from_cp1252(df: DataFrame) -> DataFrame:
    """Names and texts that were read as latin-1."""
    table = str.maketrans(LATIN_ONLY, CP1252_ONLY)
    texts = {f.name for f in df.schema.fields if isinstance(f.dataType, StringType)}
    return df.select(*[(F.translate(col(c), LATIN_ONLY, CP1252_ONLY) if c in texts else col(c)).alias(c.translate(table)) for c in df.columns])


def read_csv(
    spark: SparkSession,
    path: str,
    schema: StructType | str | None = None,
    encoding: str = "utf-8",
    delimiter: str = ",",
    multiline: bool = False,
    rejects: str | None = None,
) -> DataFrame:
    """A CSV file with a header, its NA strings as null, columns typed by ``schema`` or by their values.

    ``multiline`` lets quoted values hold newlines (a file is then one task's unit). Rows that don't
    parse, by their number of values or by ``schema``, keep what could be read; ``rejects`` names
    a column that holds such a row's text and is null elsewhere (see ``rejected``).
    """
    if encoding.lower() not in CSV_ENCODINGS:
        raise StepError(f"encoding must be one of {CSV_ENCODINGS}")
    windows = encoding.lower() == "cp1252"
    # cp1252 is read as latin-1, of which Spark has the charset, and its own characters are put in
    charset = "iso-8859-1" if windows or encoding.lower() == "latin-1" else encoding.lower()
    if delimiter not in CSV_DELIMITERS:
        raise StepError(f"delimiter must be one of {CSV_DELIMITERS!r}")

    reader = (
        spark.read.option("header", True).option("encoding", charset).option("sep", delimiter).option("multiLine", multiline)
        .option("quote", '"').option("escape", '"').option("nanValue", "NaN")
    )
    fields = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    if fields is not None and not rejects:
        raw = reader.schema(fields).csv(path)
        return nan_to_null(null_out_na_strings(_from_cp1252(raw) if windows else raw))
    # everything as text first, so that NA strings are no malformed numbers
    names = reader.option("inferSchema", False).csv(path).columns
    texts = StructType([StructField(n, StringType()) for n in [*names, *([rejects] if rejects else [])]])
    if rejects:  # a row is judged by all its values, whichever are asked for
        reader = reader.option("columnNameOfCorruptRecord", rejects).option("columnPruning", False)
    raw = reader.schema(texts).csv(path)
    raw = _from_cp1252(raw) if windows else raw
    if rejects and names:
        # Spark refuses to read the rejects alone: an empty part of the first column goes along
        raw = raw.withColumn(rejects, F.concat(col(rejects), F.substring(F.coalesce(col(raw.columns[0]), F.lit("")), 1, 0)))
    kept = raw.select(*_na_columns(raw.drop(rejects) if rejects else raw), *([col(rejects)] if rejects else []))
    return _infer_types(kept, skip=rejects) if fields is None else nan_to_null(_typed(kept, fields, rejects, delimiter))


def _typed(df: DataFrame, fields: StructType, rejects: str, delimiter: str) -> DataFrame:
    """The text columns, by position, as ``fields`` has them; a row with a value that doesn't fit is a reject."""
    texts = [c for c in df.columns if c != rejects]
    values = [col(c).try_cast(f.dataType).alias(f.name) for c, f in zip(texts, fields.fields, strict=True)]
    unfit = [col(c).isNotNull() & col(c).try_cast(f.dataType).isNull() for c, f in zip(texts, fields.fields, strict=True)]
    line = F.concat_ws(delimiter, *[F.coalesce(col(c), F.lit("")) for c in texts])
    return df.select(*values, F.coalesce(col(rejects), F.when(reduce(or_, unfit), line)).alias(rejects))


def rejected(df: DataFrame, rejects: str) -> tuple[DataFrame, DataFrame, int]:
    """(sound rows, texts of the rejected rows, their number) of a table read with ``rejects``."""
    bad = df.where(col(rejects).isNotNull()).select(col(rejects))
    return df.where(col(rejects).isNull()).drop(rejects), bad, bad.count()


def _infer_types(df: DataFrame, skip: str | None = None) -> DataFrame:
    """Type each text column as the narrowest of long, double, timestamp that parses
    every non-null value (one aggregation for all columns)."""
    tests = []
    for c in df.columns:
        if c == skip:
            continue
        x = col(c)
        tests += [
            F.bool_and(x.isNull() | x.try_cast("long").isNotNull()).alias(f"{c}\u0001l"),
            F.bool_and(x.isNull() | x.try_cast("double").isNotNull()).alias(f"{c}\u0001d"),
            F.bool_and(x.isNull() | F.try_to_timestamp(x).isNotNull()).alias(f"{c}\u0001t"),
            F.bool_and(x.isNull() | F.lower(x).isin("true", "false")).alias(f"{c}\u0001b"),
            F.count(x).alias(f"{c}\u0001n"),
        ]
    if not tests:
        return df
    row = df.agg(*tests).first().asDict()
    out = []
    for c in df.columns:
        if c == skip or row[f"{c}\u0001n"] == 0:
            out.append(col(c))
        elif row[f"{c}\u0001b"]:
            out.append((F.lower(col(c)) == "true").alias(c))
        elif row[f"{c}\u0001l"]:
            out.append(col(c).try_cast("long").alias(c))
        elif row[f"{c}\u0001d"]:
            d = col(c).try_cast("double")
            out.append(F.when(~F.isnan(d), d).alias(c))
        elif row[f"{c}\u0001t"]:
            out.append(F.try_to_timestamp(col(c)).cast("timestamp_ntz").alias(c))
        else:
            out.append(col(c))
    return df.select(*out)
