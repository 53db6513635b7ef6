"""The pipeline's stages against brute force on their own inputs, on the smallest tables."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from test_decontaminate import brute as brute_decontaminate
from test_line_dedup import brute as brute_lines
from test_simhash import brute_groups, brute_print
from tokenizers import Tokenizer

import corpus_pipeline
from tamis.llm import quality
from tamis.llm.common import table

SMALL = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SMALL, "documents")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "line_dedup", "near_dedup", "decontamination", "packing"]
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, kept[-1], SMALL)
        if name != "packing":
            assert out.columns == columns and out.dtypes == docs.dtypes
        kept.append(spark.createDataFrame(out.collect(), out.schema))
    rows = [{r.doc_id: r for r in k.collect()} for k in kept[:-1]]

    good = {r.doc_id for r in quality.classify(docs, table(spark, SMALL, "labels")).collect() if r.predicted}
    assert set(rows[1]) == good

    gone = brute_lines([(d, r.text) for d, r in sorted(rows[1].items())], 50)
    for d, r in rows[1].items():
        text = "\n".join(x for i, x in enumerate(r.text.split("\n")) if i not in gone[d])
        assert rows[2][d].text == text and rows[2][d].n_chars == len(text)
    assert set(rows[2]) == good and any(gone.values())

    ids = sorted(rows[2])
    groups = brute_groups([brute_print(rows[2][d].text) for d in ids])
    assert set(rows[3]) == {ids[g] for g in groups}

    items = [(r.item_id, r.text) for r in table(spark, SMALL, "benchmark").collect()]
    clean = {r[0] for r in brute_decontaminate([(d, r.text) for d, r in rows[3].items()], items) if not r[5]}
    assert set(rows[4]) == clean

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = defaultdict(list)
    for p in kept[5].collect():
        pieces[p.doc_id].append(p)
    assert set(pieces) == clean
    for d, own in pieces.items():
        tokens = [*tokenizer.encode(rows[4][d].text, add_special_tokens=False).ids, 1]
        at = 0
        for p in sorted(own, key=lambda p: p.start):
            assert p.start == at and p.ids_crc32 == zlib.crc32(np.array(tokens[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(tokens)


def test_run_is_the_stages(spark):
    found = corpus_pipeline.run(spark, SMALL)
    assert found.select("doc_id").distinct().count() > 50
