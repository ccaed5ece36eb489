"""Registered queries against their SQL on the smallest tables.

By default one or two queries per family run; CORPUSLAKE_ALL=1 runs every one.
``tools/check.py --sf 0.01`` is the full check.
"""

import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
DEFAULT = (
    "s2_chunk_schema s3_write_append s8_upsert w2_main_content w5_outlinks w9_pages_to_corpus c1_blocks c4_overlap "
    "t3_quality_gate t5_profile l1_tokenize l3_bm25_topk l4_bm25_partial l7_filename_search v1_embed v3_knn v6_knn_multi "
    "c2_pack_blocks c3_split_oversize c6_split_sentences v5_ann_full r11_search_lexical k4_refresh_stored "
    "r2_fuse_scores r3_threshold r5_mmr r7_hybrid x4_dedupe x6_enrich k3_plan_smart k4_refresh_records "
    "k8_delete_cascade m1_page_offset m6_collapse p1_perf_stats p7_trend z1_stream_ingest z2_stream_metrics"
).split()


def names():
    every = sorted(entry.oracle_sql())
    return every if os.environ.get("CORPUSLAKE_ALL") else [n for n in every if n in DEFAULT]


@pytest.fixture(scope="module")
def duck_con():
    from check import duck

    return duck(SF)


def test_every_default_name_is_registered():
    assert set(DEFAULT) <= set(entry.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", names())
def test_query_equals_sql(spark, duck_con, name):
    from check import compare

    note, ok, _, _ = compare(spark, duck_con, SF, entry.queries()[name], entry.oracle_sql()[name])
    assert ok, note


def test_entry(spark):
    assert entry.entry(spark).count() > 0
