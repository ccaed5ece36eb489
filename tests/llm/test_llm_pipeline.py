"""The pipeline against brute force on the smallest tables, its stages' contract, and the queries against their SQL."""

import os
import zlib

import numpy as np
import pytest
from test_llm_decontaminate import brute as overlap
from test_llm_packing import check_layout
from test_llm_repetition import brute as repeated
from test_llm_similar import least_of_classes

import __spark_entry__ as entry
import corpus_pipeline
from corpuslake.llm import packing, pii

SF = "/root/testdata/sf0.001"


def good(text):
    words = text.encode().split()
    five, covered, longest = repeated(words, 15)
    n = len(words)
    return n >= 10 and 100 * five <= 20 * n and 100 * covered <= 10 * n and longest <= 50


def test_pipeline_equals_brute_force(spark):
    from tokenizers import Tokenizer

    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = [(i, t) for i, t in docs if good(t)]
    least = set(least_of_classes(kept))
    assert len(least) < len(kept)
    kept = [(i, t) for i, t in kept if i in least]
    kept = [(i, t) for i, t in kept if not overlap(t, items)[-1]]
    f = pii.Feistel(pii.DEMO_KEY)
    kept = [(i, pii.mask_text(f, t)[0]) for i, t in kept]
    whole = Tokenizer.from_file(packing.public_files()[0])
    expected = []
    for i, t in kept:
        data = np.array([*whole.encode(t, add_special_tokens=False).ids, 0], "<u4").tobytes()
        expected += [(i, k, s, n, zlib.crc32(data[4 * s : 4 * (s + n)])) for k, (s, n) in enumerate(packing.cut(len(data) // 4, 2048))]
    assert 0 < len(kept) < len(docs)
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        frame = stage(spark, frame, SF)
    rows = frame.collect()
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(expected)
    check_layout(((r["sequence_id"], r["offset"], r["length"]) for r in rows), 2048)


def test_stages_keep_the_columns_and_stand_odd_rows(spark, make):
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None
    text = " ".join(f"w{i}" for i in range(30))
    docs = make([(1, text), (1, text), (None, text), (2, None), (3, ""), (4, "mail a.bc@d.org " + text[::-1])], extra=("fp", "row", "piece", "overlap"))
    for frame in (docs, docs.limit(0)):
        now = frame
        for _, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, SF)
            assert now.columns == docs.columns
        last = corpus_pipeline.STAGES[-1][1](spark, now, SF)
        assert last.count() == (2 if frame is docs else 0)


def test_run_over_the_table(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
    assert "pipeline" in entry.queries() and "pipeline" not in entry.oracle_sql()


def test_one_query_for_each_operator():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))


@pytest.mark.parametrize("name", ["op2_url_graph", "op6_decontamination", "op10_quality_rules", "op11_centroids", "op12_turns", "op13_topk"])
def test_query_equals_sql(spark, name):
    from check import compare, duck

    sf = SF if not os.environ.get("CORPUSLAKE_ALL") else "/root/testdata/sf0.01"
    note, ok, _, _ = compare(spark, duck(sf), sf, entry.queries()[name], entry.oracle_sql()[name])
    assert ok, note
