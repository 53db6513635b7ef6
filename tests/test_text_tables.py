"""TF-IDF inside the row and lemma tables."""

import math
from collections import Counter

import pytest
import regex as re
from pyspark.sql import functions as F

from tamis.functions.fixed import ENGLISH_STOP_WORDS, TFIDF_TOKEN_PATTERN
from tamis.operators.base import StepError
from tamis.plans.pipeline import make_step

TEXTS = [
    (1, "apple banana apple"), (1, "banana cherry"), (2, None), (3, ""), (4, "the of and"), (None, "cherry cherry apple date"), (5, "unseen words"),
    (6, "Banana DATE, apple-date; apple " * 40), (7, "apple banana apple"),
]


def brute(texts, k):
    tokens = [[t for t in re.findall(TFIDF_TOKEN_PATTERN, (x or "").lower()) if t not in ENGLISH_STOP_WORDS] for x in texts]
    df, tf, n = Counter(t for d in tokens for t in set(d)), Counter(t for d in tokens for t in d), len(texts)
    kept = sorted(sorted((t for t in df if 2 <= df[t] <= 0.95 * n), key=lambda t: (-tf[t], t))[:k])
    out = []
    for d in tokens:
        raw = {t: c * (math.log((1 + n) / (1 + df[t])) + 1) for t, c in Counter(d).items() if t in kept}
        norm = math.sqrt(sum(v * v for v in raw.values()))
        out.append([raw.get(t, 0.0) / norm if norm else 0.0 for t in kept])
    return kept, out


def test_tfidf_rows_that_share_an_id(spark):
    df = spark.createDataFrame(TEXTS, "id int, text string").repartition(3).withColumn("other", F.lit("x"))
    kept, want = brute([t for _, t in TEXTS], 10)
    fitted = make_step({"kind": "extract_tfidf", "params": {"column": "text", "max_features": 10}}).fit(df)
    wide = fitted.transform(df)
    assert wide.columns == ["id", "other", *(f"tfidf_{i}" for i in range(len(kept)))] and fitted.state["vocabulary"] == kept
    key = lambda r: str(r)
    got = sorted([(r[0], *(round(v, 9) for v in r[2:])) for r in wide.collect()], key=key)
    assert got == sorted([(i, *(round(v, 9) for v in w)) for (i, _), w in zip(TEXTS, want, strict=True)], key=key)
    long = make_step({"kind": "extract_tfidf", "params": {"column": "text", "max_features": 10, "form": "long", "id_column": "id"}}).fit(df).transform(df)
    assert sorted((str(r.id), r.term, round(r.tfidf, 9)) for r in long.collect()) == sorted(
        (str(i), t, round(v, 9)) for (i, _), w in zip(TEXTS, want, strict=True) for t, v in zip(kept, w, strict=True) if v
    )
    for form in ({}, {"form": "long", "id_column": "id"}):
        step = make_step({"kind": "extract_tfidf", "params": {"column": "text", "max_features": 10, **form}}).fit(df)
        stored = spark.createDataFrame(TEXTS, "id int, text string")
        assert "Exchange" not in step.transform(stored)._jdf.queryExecution().executedPlan().toString()


def test_tfidf_params(spark):
    with pytest.raises(StepError):
        make_step({"kind": "extract_tfidf", "params": {"column": "text", "max_features": 10, "form": "long"}})
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, text string")
    with pytest.raises(StepError):
        make_step({"kind": "extract_tfidf", "params": {"column": "text", "max_features": 10}}).fit(df)


@pytest.mark.parametrize("as_table", [False, True])
def test_a_hundred_thousand_lemmas(spark, as_table):
    lemmas = {f"w{i}": f"lemma{i % 1000}" for i in range(100_000)}
    rows = [(i, f"W{i * 37} x{i} W{i * 37}, the w{i}") for i in range(300)] + [(900, None), (901, ""), (902, "the"), (903, "w5 " * 3000), (1, "w1 w2 W1")]
    df = spark.createDataFrame(rows, "id int, text string").withColumn("__row", F.lit("kept")).repartition(4)
    table = spark.createDataFrame([*lemmas.items(), ("w5", "zz"), (None, "q"), ("w6", None)], "token string, lemma string") if as_table else lemmas
    out = make_step({"kind": "clean_text", "params": {"column": "text", "remove_stopwords": True, "lemmas": table}}).fit(df).transform(df)
    want = []
    for i, t in rows:
        tokens = [w for w in re.findall(r"\w+", (t or "").lower()) if w not in ENGLISH_STOP_WORDS and len(w) > 1]
        want.append((i, " ".join(lemmas.get(w, w) for w in tokens), "kept"))
    assert out.columns == df.columns
    assert sorted(tuple(r) for r in out.collect()) == sorted(want)


def test_lemma_params(spark):
    for bad in ([1], spark.range(1)):
        with pytest.raises(StepError):
            make_step({"kind": "clean_text", "params": {"column": "text", "lemmas": bad}})
