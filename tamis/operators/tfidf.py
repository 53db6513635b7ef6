"""T18 ``extract_tfidf`` and A18 word frequencies.

Fit: a document's tokens are exploded beside its distinct tokens, so that one tokenising and one
``groupBy(term)`` with map-side combine give total and document counts. The vocabulary is the
top ``max_features`` (≤ 1,000) terms by total count among those in at least 2 documents and at
most 95% of them.

Transform: row by row, without a shuffle or an id, on streams too. Raw term counts
(``CountVectorizerModel`` over the fitted vocabulary) × smooth idf ln((1+n)/(1+df)) + 1,
L2-normalised. The long form is (id, term, term_index, tfidf), the wide form the ``tfidf_i``
columns in alphabetical term order.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.functions.fixed import ENGLISH_STOP_WORDS, TFIDF_TOKEN_PATTERN
from tamis.operators.base import FittedStep, Step, StepError, clamp, col, register_step


def all_tokens(x: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(x.cast("string"), F.lit(""))), F.lit(TFIDF_TOKEN_PATTERN), 0)


def tfidf_tokens(x: Column) -> Column:
    return F.filter(all_tokens(x), lambda t: ~t.isin(*ENGLISH_STOP_WORDS))


def fit_vocabulary(df: DataFrame, column: str, max_features=100, min_df=2, max_df=0.95) -> tuple[list[tuple[str, float]], int]:
    """[(term, idf)] of the kept vocabulary by term, and the document count. Stop words leave once the terms are counted."""
    n_docs = df.count()
    docs = df.select(all_tokens(col(column)).alias("t"))
    lists = [F.struct(F.lit(once).alias("once"), terms.alias("terms")) for once, terms in ((False, F.col("t")), (True, F.array_distinct("t")))]
    terms = docs.select(F.explode(F.array(*lists)).alias("e")).select("e.once", F.explode("e.terms").alias("term"))
    stats = terms.groupBy("term").agg(F.count_if(~F.col("once")).alias("tf"), F.count_if("once").alias("df"))
    kept = stats.where((F.col("df") >= min_df) & (F.col("df") <= F.lit(max_df * n_docs)) & ~F.col("term").isin(*ENGLISH_STOP_WORDS))
    top = kept.orderBy(F.desc("tf"), F.asc("term")).limit(int(max_features)).collect()
    if not top:
        raise StepError("extract_tfidf: no terms remain after document-frequency pruning")
    return sorted((r["term"], math.log((1 + n_docs) / (1 + r["df"])) + 1.0) for r in top), n_docs


VECTOR = "__tfidf"


def with_vector(df: DataFrame, column: str, vocab: list[tuple[str, float]]) -> DataFrame:
    """Adds VECTOR, an array with one value for each term of the vocabulary."""
    terms, idf = zip(*vocab, strict=True)
    rows = df.withColumn("__tokens", all_tokens(col(column)))
    rows = CountVectorizerModel.from_vocabulary(list(terms), inputCol="__tokens", outputCol="__counts").transform(rows)
    rows = ElementwiseProduct(scalingVec=Vectors.dense(list(idf)), inputCol="__counts", outputCol="__weighted").transform(rows)
    rows = Normalizer(p=2.0, inputCol="__weighted", outputCol="__unit").transform(rows)
    return rows.withColumn(VECTOR, vector_to_array("__unit")).drop("__tokens", "__counts", "__weighted", "__unit")


def tfidf_long(df: DataFrame, id_col: str, column: str, vocab) -> DataFrame:
    rows = with_vector(df.select(*[col(c) for c in dict.fromkeys((id_col, column))]), column, vocab)
    terms = F.lit([t for t, _ in vocab])
    places = rows.select(col(id_col), F.posexplode_outer(VECTOR).alias("term_index", "tfidf")).where("tfidf > 0")
    return places.select(col(id_col), F.get(terms, "term_index").alias("term"), "term_index", "tfidf")


def tfidf_wide(df: DataFrame, column: str, vocab) -> DataFrame:
    """The rows without their text, with one column a term."""
    columns = [F.get(VECTOR, F.lit(i)).alias(f"tfidf_{i}") for i in range(len(vocab))]
    return with_vector(df, column, vocab).select(*[col(c) for c in df.columns if c != column], *columns)


@register_step("extract_tfidf")
class ExtractTfidf(Step):
    required = ("column", "max_features")

    def check_params(self):
        form = self.params.get("form", "wide")
        if form not in ("wide", "long"):
            raise StepError("extract_tfidf: form must be wide or long")
        if form == "long" and not self.params.get("id_column"):
            raise StepError("extract_tfidf: the long form needs 'id_column' to name the rows")

    def fit(self, df):
        p = self.params
        vocab, n = fit_vocabulary(df, p["column"], clamp(int(p["max_features"]), 10, 1000))
        fn = (lambda d: tfidf_long(d, p["id_column"], p["column"], vocab)) if p.get("form") == "long" else (lambda d: tfidf_wide(d, p["column"], vocab))
        return FittedStep(self.kind, p, {"vocabulary": [t for t, _ in vocab], "n_docs": n}, fn)


def word_frequencies(df: DataFrame, column: str, top: int = 200) -> DataFrame:
    """The most frequent words (after stop words), for a word cloud."""
    words = df.select(F.explode(tfidf_tokens(col(column))).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), F.asc("word")).limit(top)
