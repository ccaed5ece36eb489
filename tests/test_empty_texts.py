"""Queries against their SQL where some documents have an empty text or none."""

import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def empty_texts(tmp_path_factory):
    """The smallest tables, with every tenth text empty and every tenth null."""
    import duckdb

    folder = str(tmp_path_factory.mktemp("empty_texts"))
    for f in os.listdir(SF):
        if f != "documents.parquet":
            os.symlink(f"{SF}/{f}", f"{folder}/{f}")
    text = "case doc_id % 10 when 3 then '' when 4 then null else text end"
    columns = f"doc_id, {text} as text, lang, source, coalesce(length({text}), 0)::bigint as n_chars"
    duckdb.sql(f"copy (select {columns} from read_parquet('{SF}/documents.parquet')) to '{folder}/documents.parquet' (format parquet)")
    return folder


def same(spark, folder, name):
    from check import compare, duck

    note, ok, _, _ = compare(spark, duck(folder), folder, entry.queries()[name], entry.oracle_sql()[name])
    assert ok, note


@pytest.mark.parametrize("kind", ["summary", "entities", "key_points", "comprehensive"])
def test_texts_without_pieces_give_no_row(spark, empty_texts, kind):
    same(spark, empty_texts, f"c10_map_reduce_{kind}")


@pytest.mark.parametrize("name", ["k5_rebuild", "k5_rebuild_counts"])
def test_a_file_without_text_is_rebuilt(spark, empty_texts, name):
    same(spark, empty_texts, name)
