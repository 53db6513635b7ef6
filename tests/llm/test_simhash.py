import random
import re

import numpy as np
import pytest
import xxhash

from tamis.llm import simhash
from tamis.llm.components import connected_components


def brute_print(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(prints, max_bits=4):
    parent = list(range(len(prints)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= max_bits:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(prints))]


def texts():
    rng = random.Random(5)
    base = [" ".join(rng.choice("alpha beta gamma delta Epsilon zeta eta theta".split()) + str(rng.randrange(40)) for _ in range(80)) for _ in range(25)]
    out = list(base)
    for t in base[:12]:
        for _ in range(4):
            words = t.split()
            words[rng.randrange(len(words))] = "changed"
            out.append("\t".join(words))
    out += [base[0], base[0].upper(), "", None, "one", "one two three four", "  \n ", "É é K"]
    rng.shuffle(out)
    return out


def test_groups_match_brute_force(spark, docs_of):
    rows = list(enumerate(texts()))
    got = {r.doc_id: r for r in simhash.near_duplicate_groups(docs_of(rows)).collect()}
    prints = [brute_print(t) for _, t in rows]
    roots = brute_groups(prints)
    assert [got[i].fingerprint for i, _ in rows] == [f"{p:016x}" for p in prints]
    assert [got[i].component_id for i, _ in rows] == roots
    assert len(set(roots)) < len(rows)
    kept = [r.doc_id for r in simhash.one_of_each_group(docs_of(rows)).collect()]
    assert sorted(kept) == sorted(set(roots))


@pytest.mark.parametrize("max_bits", [0, 1, 2, 3, 4, 5])
def test_every_link_meets_at_an_anchor(spark, max_bits):
    rng = np.random.default_rng(max_bits)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    prints = [int(b) for b in base]
    for b in base:
        for _ in range(3):
            flips = rng.choice(64, max_bits, replace=False)
            prints.append(int(b) ^ sum(1 << int(f) for f in flips))
    prints = sorted(set(prints))
    signed = [(p - 2**64 if p >= 2**63 else p,) for p in prints]
    nodes = spark.createDataFrame(signed, "fp long")
    for cell_rows in (32_768, 2):
        found = connected_components(simhash.links(nodes, max_bits, cell_rows)).collect()
        root = {r.node: r.root for r in found}
        got = [root.get(s, s) for (s,) in signed]
        want = brute_groups(prints, max_bits)
        assert [got.index(g) for g in got] == want


def test_forest_connects_large_groups():
    rng = np.random.default_rng(1)
    fps = np.unique(np.concatenate([np.uint64(b) ^ (np.uint64(1) << rng.integers(0, 6, 60).astype(np.uint64)) for b in rng.integers(0, 2**62, 3)] + [rng.integers(0, 2**62, 50).astype(np.uint64)]))
    u, v = simhash.forest(np.zeros(len(fps), np.int64), fps, 4)
    assert len(u) < len(fps)
    roots = brute_groups([int(f) for f in fps])
    assert len(fps) - len(u) == len(set(roots))


def test_repeated_and_null_ids(spark, docs_of):
    rows = [(None, "a b c d e"), (3, "a b c d e"), (3, "a b c d e"), (7, None), (None, ""), (9, "other words stand here now")]
    got = simhash.near_duplicate_groups(docs_of(rows)).collect()
    assert sorted((r.doc_id or -1, r.component_id) for r in got) == [(-1, 3), (-1, 7), (3, 3), (3, 3), (7, 7), (9, 9)]
    kept = simhash.one_of_each_group(docs_of(rows))
    assert sorted(r.doc_id for r in kept.collect()) == [3, 7, 9]
    assert kept.columns == docs_of(rows).columns


def test_empty_table(spark, docs_of):
    assert simhash.near_duplicate_groups(docs_of([])).count() == 0
    assert simhash.one_of_each_group(docs_of([])).count() == 0


def test_components(spark):
    links = spark.createDataFrame([(5, 4), (4, 3), (3, 2), (2, 1), (9, 8), (8, 9), (7, 7), (None, 1)], "u long, v long")
    got = {r.node: r.root for r in connected_components(links).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 8: 8, 9: 8}
