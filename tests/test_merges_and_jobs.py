"""Merges of several updates, versioned writes, the search's row limit, and shipping of the package."""

import os
import subprocess
import sys

import pytest

from corpuslake.functions import scale
from corpuslake.operators import conversations as cv
from corpuslake.plans.search import SearchConfig, search
from corpuslake.sources import tables as st
from corpuslake.sources import versions as vs

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_partial_updates_of_one_key_all_count(spark):
    target = spark.createDataFrame([(1, "x", "y")], "k int, a string, b string")
    updates = spark.createDataFrame([(1, "a1", None, 1), (1, None, "b2", 2), (2, "n", None, 1)], "k int, a string, b string, v int")
    assert sorted(map(tuple, st.upsert(target, updates, ["k"], "v").collect())) == [(1, "a1", "b2"), (2, "n", None)]


def test_replace_clears_and_later_updates_apply(spark):
    msgs = spark.createDataFrame([("m", 1, "user", "old", 1), ("u", 1, "user", "same", 2)], "id string, conv_id int, role string, text string, ts int")
    convs = spark.createDataFrame([(1, "c", 2)], "conv_id int, label string, ts int")
    rows = [("m", 1, "late", None, 3, "update"), ("m", 1, None, "new", 4, "replace"), ("m", 1, None, "newer", 5, "update"), ("u", 1, "helper", None, 6, "update"), ("u", 1, None, "text", 7, None)]
    batch = spark.createDataFrame(rows, "id string, conv_id int, role string, text string, ts int, op string")
    out, parents = cv.save_messages(msgs, convs, batch)
    assert sorted(map(tuple, out.collect())) == [("m", 1, None, "newer", 5), ("u", 1, "helper", "text", 7)]
    assert parents.first()["ts"] == 7


def test_a_version_is_read_only_once_complete(spark):
    root = scale.shared_dir(spark)
    frame = spark.range(3).toDF("x")
    assert vs.current_version(spark, root) == 0
    assert vs.publish({"t": frame}, root) == 1
    frame.where("x = 0").write.parquet(f"{root}/v2/t")  # a job that died before its switch
    assert vs.read_current(spark, root, "t").count() == 3
    assert vs.publish({"t": vs.read_current(spark, root, "t").union(frame)}, root) == 2
    assert vs.read_current(spark, root, "t").count() == 6


def test_a_definition_question_gets_its_adaptive_number_of_rows(spark):
    docs = spark.createDataFrame([(i, f"alpha beta number {i} " + "word%d " % (i % 7) * 5, f"a/{i}.txt", ["t" if i % 2 else "s"]) for i in range(30)], "doc_id long, text string, source string, tags array<string>")
    queries = spark.createDataFrame([(1, "what is alpha"), (2, "alpha beta")], "query_id long, text string")
    got = search(docs, queries, SearchConfig(partial=False)).groupBy("query_id").count().collect()
    assert {r["query_id"]: r["count"] for r in got} == {1: 5, 2: 6}
    tagged = search(docs, queries, SearchConfig(partial=False, tags=("s",))).collect()
    assert tagged and all(r["doc_id"] % 2 == 0 for r in tagged)


def test_a_cluster_needs_a_shared_folder():
    class Fake:
        class conf:
            get = staticmethod(lambda *a: None)

        class sparkContext:
            master = "spark://host:7077"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scale.shared_dir(Fake)


def test_workers_find_the_package_from_any_folder(tmp_path):
    code = f"""
import sys; sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
import __spark_entry__ as e
print("ROWS", e.queries()["v3_knn"](spark, "/root/testdata/sf0.001").count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS 5000" in said.stdout, said.stderr[-2000:]
