import hashlib
import random
import re

from tamis.llm import decontaminate as dc


def words(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def brute(docs, items, window=10):
    out = []
    for doc_id, text in docs:
        w = words(text)
        hit, ids = set(), set()
        for item_id, item in items:
            v = words(item)
            n = min(window, len(v))
            for s in range(len(v) - n + 1 if v else 0):
                for at in range(len(w) - n + 1):
                    if w[at : at + n] == v[s : s + n]:
                        hit.update(range(at, at + n))
                        ids.add(item_id)
        listed = sorted(str(i) for i in ids if i is not None)
        out.append((doc_id, len(w), len(hit), len(listed), hashlib.sha256(",".join(listed).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def fixture():
    rng = random.Random(3)
    vocab = ["the", "of", "a"] * 6 + [f"w{i}" for i in range(40)] + ["é", "Ünder"]
    sentence = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, sentence(rng.choice([14, 25, 10]))) for i in range(12)]
    items += [(100, "the of a"), (101, "short item"), (102, ""), (103, None), (104, items[0][1]), (None, items[1][1]), (105, "the " * 15), (106, "never seen anywhere")]
    docs = []
    for d in range(60):
        text = sentence(30)
        if d % 3 == 0:
            item = items[rng.randrange(12)][1].split()
            a = rng.randrange(4)
            text += ". " + ", ".join(item[a : a + rng.randrange(8, 16)]).upper() + "! " + sentence(5)
        docs.append((d, text))
    docs += [(60, None), (61, ""), (62, "THE of-A short item"), (62, "nothing"), (None, items[2][1]), (63, "the " * 40), (64, "...the of a"), (65, items[3][1] + " " + items[3][1])]
    return docs, items


def test_matches_brute_force(spark, docs_of):
    docs, items = fixture()
    benchmark = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'x' AS word", "1 AS p")
    got = [tuple(r) for r in dc.digest(dc.decontaminate(docs_of(docs), benchmark)).collect()]
    want = brute(docs, items)
    assert sorted(got, key=str) == want
    assert sum(r[5] for r in want) > 10
    kept = dc.without_contaminated(docs_of(docs), benchmark)
    assert kept.columns == docs_of(docs).columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r[0]) for r in want if not r[5])


def test_shuffled_joins_give_the_same(spark, docs_of, monkeypatch):
    docs, items = fixture()
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(dc, "BROADCAST_BYTES", -1)
    got = [tuple(r) for r in dc.digest(dc.decontaminate(docs_of(docs), benchmark)).collect()]
    assert sorted(got, key=str) == brute(docs, items)


def test_empty_tables(spark, docs_of):
    empty = spark.createDataFrame([], "item_id long, text string")
    full = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert [r.contaminated for r in dc.decontaminate(docs_of([(1, "a b c")]), empty).collect()] == [False]
    assert dc.decontaminate(docs_of([]), full).count() == 0


def test_proximity(spark, docs_of):
    item = "common common rareone common common common raretwo common common common"
    docs = [(1, "rareone x x x raretwo common " * 1), (2, "rareone x x x x x x raretwo common"), (3, "raretwo rareone"), (4, "common " * 30)]
    benchmark = spark.createDataFrame([(7, item)], "item_id long, text string")
    got = {(r.doc_id, r["shift"]) for r in dc.proximity_matches(docs_of(docs), benchmark, slop=3).collect()}
    assert {d for d, _ in got} == {1, 2}
    assert (1, 0) in got
