import random
import zlib

import numpy as np
import pytest

from tamis.llm import quality, toxicity


def corpus():
    rng = random.Random(8)
    vocab = ["".join(rng.choice("abcdefghijklm") for _ in range(rng.randrange(2, 9))) for _ in range(400)]
    docs, labels = [], []
    for d in range(900):
        words = [rng.choice(vocab) for _ in range(rng.randrange(5, 120))]
        bad = d % 5 == 0
        toxic = d % 4 == 1
        if bad:
            words = [w.upper() + "!!" for w in words] if d % 2 else [words[0]] * len(words)
        if toxic:
            # the pair tells, neither word alone does
            words += ["insultus", "groupius"]
        elif d % 4 == 2:
            words += ["insultus"]
        elif d % 4 == 3:
            words += ["groupius"]
        rng.shuffle(words)
        docs.append((d, " ".join(words)))
        if d % 10 != 9:
            labels.append((d, 0 if bad else 1, int(toxic)))
    return docs, labels


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = corpus()
    docs += [(2000, None), (2001, ""), (None, "some words here"), (0, "a second row with this id"), (2002, "x " * 50_000)]
    labels += [(2001, None, None), (None, 1, 1), (5555, 1, 0)]
    frame = spark.createDataFrame([(*r, "x", "x", "x") for r in docs], "doc_id long, text string, score string, y string, x string")
    return docs, frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), dict((d, (q, t)) for d, q, t in labels)


def held_out_accuracy(rows, truth, which):
    held = [r for r in rows if r.held_out and truth.get(r.doc_id, (None, None))[which] is not None]
    assert len(held) > 100
    return np.mean([r.predicted == truth[r.doc_id][which] for r in held])


@pytest.mark.parametrize(("module", "which", "folds", "left", "least"), [(quality, 0, 4, 2, 0.97), (toxicity, 1, 3, 1, 0.95)])
def test_held_out_accuracy_and_shape(tables, module, which, folds, left, least):
    docs, frame, labels, truth = tables
    rows = module.classify(frame, labels).collect()
    assert len(rows) == len(docs)
    for r in rows:
        text = "" if r.doc_id is None else str(r.doc_id)
        assert r.held_out == (zlib.crc32(text.encode()) % folds == left)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    assert held_out_accuracy([r for r in rows if r.doc_id != 0], truth, which) >= least
    again = module.classify(frame, labels).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_without_labels(spark, tables):
    _, frame, labels, _ = tables
    for module in (quality, toxicity):
        assert {r.score for r in module.classify(frame, labels.limit(0)).collect()} == {0.5}
        assert module.classify(frame.limit(0), labels).count() == 0


def test_keep_good(tables):
    _, frame, labels, _ = tables
    kept = quality.keep_good(frame, labels)
    want = sorted(str(r.doc_id) for r in quality.classify(frame, labels).collect() if r.predicted)
    assert kept.columns == frame.columns and sorted(str(r.doc_id) for r in kept.collect()) == want


def test_flattened_trees_match_a_walk():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 6))
    y = ((x[:, 0] > 0.3) ^ (x[:, 3] > 0)).astype(float)
    trees = quality.fit(x, y)
    assert np.mean((trees.scores(x) > 0.5) == y) > 0.97

    def walk(row):
        out = trees.base
        for f, t, v in zip(trees.feature, trees.threshold, trees.value, strict=True):
            node = 0
            while node < len(f):
                node = 2 * node + (2 if row[f[node]] > t[node] else 1)
            out += v[node - len(f)]
        return out

    assert np.allclose(trees.margins(x), [walk(r) for r in x])


def test_factorization_machine_learns_pairs():
    rng = np.random.default_rng(1)
    x = (rng.random((3000, 6)) < 0.4).astype(np.uint8)
    y = (x[:, 1] & x[:, 4]).astype(float)
    bias, w, v = toxicity.fit(x, y)
    machine = toxicity.Machine(np.arange(6), bias, w, v)
    scores = np.array([machine.score(list(np.flatnonzero(r))) for r in x])
    assert np.mean((scores > 0.5) == y) > 0.98


def test_statistics_of_odd_texts():
    for text in ("", " \n\t", "\x00", "é" * 10, "a", "\ud800", "| | |"):
        assert len(quality.statistics(text)) == len(quality.STATISTICS) and np.isfinite(quality.statistics(text)).all()


def test_terms_that_tell_only_in_pairs(spark):
    rng = random.Random(3)
    vocab = ["".join(rng.choice("abcdefghijklm") for _ in range(rng.randrange(2, 9))) for _ in range(400)]
    docs, labels = [], []
    for d in range(4_000):
        words = [rng.choice(vocab) for _ in range(rng.randrange(5, 120))]
        one, other = rng.random() < 0.5, rng.random() < 0.5
        words += ["insultus"] * one + ["groupius"] * other
        rng.shuffle(words)
        docs.append((d, " ".join(words)))
        labels.append((d, int(one == other)))
    frame, marks = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    rows = toxicity.classify(frame, marks).collect()
    assert held_out_accuracy(rows, {d: (None, t) for d, t in labels}, 1) >= 0.95


def test_chance_labels_add_few_pairs():
    rng = np.random.default_rng(2)
    places = [np.flatnonzero(rng.random(300) < 0.1).astype(np.int32) for _ in range(2_000)]
    counts = np.bincount(np.concatenate(places), minlength=300).astype(float)
    assert len(toxicity.telling_pairs(places, counts, rng.normal(size=2_000), 100)) <= 3
    assert len(toxicity.telling_pairs(places[:0], counts[:0], np.zeros(0), 100)) == 0


def test_sparse_rows_match_dense():
    rng = np.random.default_rng(4)
    places = [np.flatnonzero(rng.random(30) < share).astype(np.int32) for share in (0.3, 0.0, 0.9, 0.1, 0.0)]
    x = toxicity.dense(places, np.arange(30), 30).astype(float)
    rows, v, e = toxicity.Rows(places), rng.normal(size=(30, 3)), rng.normal(size=(5, 2))
    assert np.allclose(rows.times(v), x @ v)
    assert np.allclose(rows.sums(e), (x.T @ e)[rows.columns])


def test_scores_of_a_fixed_machine_are_sums_over_pairs():
    rng = np.random.default_rng(6)
    w, v = rng.normal(size=9), rng.normal(size=(9, 4))
    machine = toxicity.Machine(np.arange(9), 0.3, w, v)
    for places in ([], [2], [0, 3, 4, 8], list(range(9))):
        margin = 0.3 + sum(w[i] for i in places) + sum(v[i] @ v[j] for i in places for j in places if i < j)
        assert machine.score(places) == pytest.approx(1 / (1 + np.exp(-margin)))


def test_repeated_ids_stay_within_the_bound(spark):
    from tamis.llm.labelled import reduced_sample

    frame = spark.createDataFrame([(d % 3, f"word{d}") for d in range(90)], "doc_id long, text string").repartition(7)
    marks = spark.createDataFrame([(d, d % 2) for d in range(3)], "doc_id long, toxic int")

    def reduce(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([[int(t[4:])] for t in b.column(2).to_pylist()], pa.list_(pa.int32()))], ["hash", "y", "b"])

    first = sorted(map(str, reduced_sample(frame, marks, "toxic", 3, 9, 10, reduce).collect()))
    assert len(first) == 10 and first == sorted(map(str, reduced_sample(frame.coalesce(2), marks, "toxic", 3, 9, 10, reduce).collect()))
    assert reduced_sample(frame, marks, "toxic", 3, 9, 90, reduce).count() == 90
