import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("source", T.StringType())])


@pytest.fixture
def docs_of(spark):
    """A documents table from (doc_id, text[, source]) rows, with columns whose names might clash with inner ones."""

    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "s") for r in rows]
        df = spark.createDataFrame(full, DOCS)
        for name in ("fp", "key", "words", "line", "gone", "rank", "asked", "queue", "pos", "h", "y"):
            df = df.selectExpr("*", f"'x' AS {name}")
        return df

    return make
