import random

import numpy as np
import pytest

from tamis.llm import line_dedup as ld


def brute(docs, min_words):
    """Deleted lines: any run of enough words, equal to a run that begins earlier."""
    lines = {}
    for d, text in docs:
        every = (text or "").split("\n")
        lines[d] = [(i, line.strip(" "), len(line.split())) for i, line in enumerate(every) if line.strip(" ")]
    first, gone = {}, {d: set() for d in lines}
    for d in sorted(lines):
        seq = lines[d]
        for s in range(len(seq)):
            total = 0
            for e in range(s, len(seq)):
                total += seq[e][2]
                if total >= min_words:
                    run = tuple(x[1] for x in seq[s : e + 1])
                    if run in first:
                        gone[d].update(x[0] for x in seq[s : e + 1])
                    else:
                        first[run] = d
    return gone


def fixture():
    rng = random.Random(11)
    line = lambda n: " ".join(rng.choice("abcdefgh") + str(rng.randrange(30)) for _ in range(n))
    shared = [line(rng.choice([2, 5, 9])) for _ in range(30)]
    long = line(14)
    docs = []
    for d in range(40):
        out = []
        for _ in range(rng.randrange(1, 5)):
            kind = rng.randrange(4)
            a = rng.randrange(25)
            if kind == 0:
                out += [line(6), ""]
            elif kind == 1:
                out += shared[a : a + rng.randrange(1, 5)]
            elif kind == 2:
                out += ["  " + x + " " for x in shared[a : a + 6]]
            else:
                out += [long] * rng.randrange(1, 3)
        docs.append((d, "\n".join(out)))
    docs += [(40, docs[0][1]), (41, docs[0][1] + "\n" + line(3)), (42, ""), (43, None), (44, "\n\n"), (45, "x y\n" * 30), (46, "x y\n" * 12)]
    return docs


def test_matches_brute_force(spark, docs_of):
    docs = fixture()
    for min_words in (10, 20, 1):
        want = brute(docs, min_words)
        got = {r.doc_id: r for r in ld.without_repeated_lines(docs_of(docs), min_words).collect()}
        assert {d: set(r.removed) for d, r in got.items()} == want
        for d, text in docs:
            every = (text or "").split("\n")
            assert got[d].text == "\n".join(x for i, x in enumerate(every) if i not in want[d])
            assert got[d].n_lines == len(every)
    assert sum(map(len, brute(docs, 10).values())) > 50


def test_shuffled_joins_give_the_same(spark, docs_of, monkeypatch):
    docs = fixture()
    monkeypatch.setattr(ld, "BROADCAST_ROWS", -1)
    got = {r.doc_id: set(r.removed) for r in ld.without_repeated_lines(docs_of(docs), 10).collect()}
    assert got == brute(docs, 10)


def test_rows_without_id_or_repeated(spark, docs_of):
    run = "one two three\nfour five six"
    rows = [(5, run), (5, run), (None, run), (2, "other\n" + run), (5, "more\n" + run)]
    got = sorted((r.doc_id or -1, len(r.removed), r.text) for r in ld.without_repeated_lines(docs_of(rows), 6).collect())
    # doc 2 comes first; rows that agree in id and text share their fate
    assert got == [(-1, 2, ""), (2, 0, "other\n" + run), (5, 2, ""), (5, 2, ""), (5, 2, "more")]


def test_empty_table_and_columns(spark, docs_of):
    out = ld.without_repeated_lines(docs_of([]), 10)
    assert out.count() == 0
    assert out.columns == [*docs_of([]).columns, "n_lines", "removed"]


@pytest.mark.parametrize("blank", ["\t", "\r", "\x0c", " \t "])
def test_lines_without_words_inside_a_run(spark, docs_of, blank):
    word = lambda n: " ".join(f"w{x}" for x in range(n))
    run = "\n".join([word(25), *[blank] * 100, word(24) + " end"])
    short = "\n".join([word(20), *[blank] * 70, word(20)])
    docs = [(1, "first\n" + run), (2, run + "\nlast"), (3, short), (4, short), (5, "x y\n" * 30), (6, (blank + "\n") * 300), (7, run + "\n" + run)]
    want = brute([(d, t.replace(blank, "\t")) for d, t in docs], 50)
    got = {r.doc_id: set(r.removed) for r in ld.without_repeated_lines(docs_of(docs), 50).collect()}
    assert got == want
    assert len(want[2]) == 102 and len(want[7]) == 204 and not want[1] | want[4] | want[6]


def test_shortest_runs():
    s, m = ld.shortest_runs(np.array([5, 60, 3, 3]), 50)
    assert list(zip(s.tolist(), m.tolist(), strict=True)) == [(0, 2), (1, 1), (1, 2), (1, 3)]


def test_ranks_order_suffixes(spark):
    words = [1] * 7
    ids = list("banana") + ["b"]
    lines = spark.createDataFrame([(1, 0, 0, n, n, w, ord(c)) for n, (c, w) in enumerate(zip(ids, words, strict=True))], "doc_id long, h long, part int, at int, i int, words int, r0 long")
    got = ld.doubled(lines, 8).orderBy("at").collect()
    order = sorted(range(7), key=lambda n: got[n].r2)
    assert order == sorted(range(7), key=lambda n: ids[n : n + 4])
