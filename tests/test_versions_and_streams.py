"""Bucketed catalogs, conflicting writers, and the streamed tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from corpuslake.functions.scale import shared_dir
from corpuslake.operators import catalog as ct
from corpuslake.operators import chunking as ck
from corpuslake.operators import metrics as mt
from corpuslake.sources import versions as vs
from corpuslake.streaming import jobs

RECORD = "path string, chunk_count long, preview string, size long, updated_at long, file_hash string, source_type string, tags array<string>"
FOUND = "path string, text string, size long, file_hash string, mtime long"


def catalog(spark, n=60):
    texts = {f"Dir/File{i}.txt": f"text number {i} " * 30 for i in range(n)}
    records = spark.createDataFrame([(p, 1, "", len(t), 1, str(hash(t)), "file", ["t"]) for p, t in texts.items()], RECORD)
    inventory = spark.createDataFrame([(p, t, len(t), str(hash(t)), 1) for p, t in texts.items()], FOUND)
    cut = lambda d: ck.split_fixed(d, 200)
    chunks = cut(inventory.select(F.col("path").alias("doc_id"), "text")).select(F.col("doc_id").alias("path"), "chunk_no", "content", F.array(F.lit("t")).alias("tags"))
    return chunks, records, inventory, cut


def test_a_refresh_of_one_file_writes_one_bucket(spark):
    chunks, records, inventory, cut = catalog(spark)
    root = shared_dir(spark)
    ct.store(chunks, records, root, buckets=16)
    before = vs.folders(spark, root, "chunks")
    assert ct.refresh_stored(root, inventory, cut, buckets=16) == (1, [])
    changed = inventory.withColumn("text", F.when(F.col("path") == "Dir/File7.txt", "new text").otherwise(F.col("text")))
    changed = changed.withColumn("file_hash", F.when(F.col("path") == "Dir/File7.txt", "x").otherwise(F.col("file_hash")))
    version, touched = ct.refresh_stored(root, changed, cut, buckets=16)
    after = vs.folders(spark, root, "chunks")
    assert version == 2 and len(touched) == 1
    assert {b for b in before if before[b] != after.get(b)} == set(touched)
    want, _ = ct.refresh(chunks, records, changed, cut)
    rows = lambda df: sorted((r["path"], r["chunk_no"], r["content"]) for r in df.collect())
    assert rows(ct.stored(spark, root, "chunks")) == rows(want)
    assert rows(vs.read_buckets(spark, root, "chunks", version=1)) == rows(chunks)  # the version before is still whole
    gone, _ = ct.refresh_stored(root, changed.limit(0), cut, buckets=16)
    assert gone == 3 and ct.stored(spark, root, "chunks").count() == 0 and ct.stored(spark, root, "records").count() == 0


def test_a_writer_that_was_overtaken_switches_nothing(spark):
    root, frame = shared_dir(spark), spark.range(3).toDF("x")
    vs.publish({"t": frame}, root)
    base = vs.current_version(spark, root)
    vs.publish({"t": frame.union(frame)}, root)
    with pytest.raises(vs.Conflict):
        vs.publish({"t": frame.limit(1)}, root, base)
    assert vs.read_current(spark, root, "t").count() == 6
    assert vs.publish({"t": frame}, root) == 4  # the number that the other had claimed is passed over


def at(seconds):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=seconds)


def test_windows_follow_the_stream_and_a_repeated_batch_changes_nothing(spark):
    base = shared_dir(spark)
    schema = "name string, duration double, ts timestamp"
    deliveries = [[("a", 1.0, at(10)), ("a", 3.0, at(200)), ("b", 5.0, at(290))], [("a", 8.0, at(299)), ("a", 2.0, at(301))], [("b", 7.0, at(5000))]]
    want = {}
    for rows in deliveries:
        spark.createDataFrame(rows, schema).write.mode("append").parquet(f"{base}/inbox")
        stream = jobs.stream_metrics(jobs.stream_documents(spark, f"{base}/inbox", spark.createDataFrame([], schema).schema))
        jobs.run_to_windows(stream, f"{base}/windows", f"{base}/ckpt", buckets=4).awaitTermination()
        for name, duration, ts in rows:
            want.setdefault((int((ts - at(0)).total_seconds()) // 300, name), []).append(duration)
        got = {((r["start"] - at(0)).total_seconds() // 300, r["name"]): (r["n"], r["avg"], r["max"]) for r in jobs.current_windows(spark, f"{base}/windows").collect()}
        assert got == {k: (len(v), sum(v) / len(v), max(v)) for k, v in want.items()}
    version = vs.current_version(spark, f"{base}/windows")
    jobs.run_to_windows(stream, f"{base}/windows", f"{base}/ckpt", buckets=4).awaitTermination()
    assert vs.current_version(spark, f"{base}/windows") == version


def test_pairs_across_deliveries_and_starts_that_never_end(spark):
    base = shared_dir(spark)
    schema = "event_id long, name string, phase string, ts timestamp"
    deliveries = [
        [(1, "a", "start", at(0)), (2, "a", "start", at(5)), (3, "b", "start", at(6)), (3, "b", "end", at(7)), (9, "a", "mark", at(7))],
        [(1, "a", "end", at(60)), (4, "b", "start", at(4000))],
        [(4, "b", "end", at(4100)), (2, "a", "end", at(4101))],  # 2 ends long after its timer
    ]
    for rows in deliveries:
        spark.createDataFrame(rows, schema).write.mode("append").parquet(f"{base}/inbox")
        stream = jobs.stream_pairs(jobs.stream_documents(spark, f"{base}/inbox", spark.createDataFrame([], schema).schema))
        jobs.run_to_table(stream, f"{base}/out", f"{base}/ckpt")
    got = sorted(map(tuple, spark.read.parquet(f"{base}/out").collect()))
    assert got == [(1, "a", 60000.0), (3, "b", 1000.0), (4, "b", 100000.0)]
    batch = spark.createDataFrame([r for d in deliveries for r in d if r[0] != 2], schema)
    assert sorted(map(tuple, mt.paired(batch).collect())) == got


def test_open_events_share_states(spark):
    """The state of a pairing stream grows with its buckets, not with its events: each state is one call of Python."""
    base = shared_dir(spark)
    schema = "event_id long, name string, phase string, ts timestamp"
    big = 1 << 60
    starts = [(big + i, f"n{i % 3}", "start", at(i % 50 + n)) for i in range(600) for n in (0, 3)]
    some = [(None, "x", "start", at(1)), (5, None, "start", at(2)), (6, "y", "start", None), (None, None, "end", at(4))]
    ends = [(big + i, f"n{i % 3}", "end", at(100 + i % 50 + n)) for i in range(0, 600, 2) for n in (0, 5)]
    last = [(None, "x", "end", at(3)), (5, None, "end", at(4)), (6, "y", "end", at(5)), (None, None, "start", at(1))]
    for rows in (starts + some, ends + last):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(f"{base}/inbox")
        stream = jobs.stream_pairs(jobs.stream_documents(spark, f"{base}/inbox", spark.createDataFrame([], schema).schema), buckets=4)
        query = (
            stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/ckpt")
            .outputMode("append").trigger(availableNow=True).start()
        )
        query.awaitTermination()
        assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]) <= 4
    got = {(r["event_id"], r["name"]): r["duration"] for r in spark.read.parquet(f"{base}/out").collect()}
    want = {(big + i, f"n{i % 3}"): 105000.0 for i in range(0, 600, 2)}
    assert got == want | {(None, "x"): 2000.0, (5, None): 2000.0, (None, None): 3000.0}
