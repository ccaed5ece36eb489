"""Structured Streaming jobs: continuous corpus ingest and live metric roll-up."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpuslake.functions.scale import discard, materialise
from corpuslake.functions.text import norm_path
from corpuslake.sources.versions import bucket_of, current_version, publish, publish_buckets, read_buckets, read_current


def stream_documents(spark: SparkSession, folder: str, schema, pattern: str | None = None) -> DataFrame:
    """Stream of newly arriving document files (Parquet)."""
    reader = spark.readStream.schema(schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.parquet(folder)


def stream_ingest(docs: DataFrame, chunk_path: str, checkpoint: str, chunk_fn):
    """Chunk arriving documents (path, text, version[, deleted]) into an append-only chunk log.

    Each micro-batch overwrites its own ``batch_id`` folder, so a repeated batch
    changes nothing. A row with ``deleted`` stands for a file that is gone.
    ``current_chunks`` reads the state: the newest batch of
    every path, as an upsert would leave it. Returns the streaming query.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        gone = F.coalesce("deleted", F.lit(False)) if "deleted" in batch.columns else F.lit(False)
        last = batch.groupBy(norm_path("path").alias("norm")).agg(
            F.max_by(F.struct("path", "text", gone.alias("gone")), "version").alias("d")
        )
        found = last.select(F.col("d.path").alias("doc_id"), F.col("d.text").alias("text"), "d.gone").persist()
        chunks = chunk_fn(found.where("not gone").drop("gone")).select(F.col("doc_id").alias("path"), "chunk_no", "content")
        chunks.write.mode("overwrite").parquet(f"{chunk_path}/chunks/batch_id={batch_id}")
        found.select(F.col("doc_id").alias("path"), "gone").write.mode("overwrite").parquet(
            f"{chunk_path}/paths/batch_id={batch_id}"
        )
        found.unpersist()

    return (
        docs.writeStream.foreachBatch(save)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _log(spark: SparkSession, chunk_path: str) -> tuple[DataFrame, DataFrame]:
    """(chunks, paths) with ``batch_id``: what was compacted, and the batches since."""
    chunks, paths = (spark.read.parquet(f"{chunk_path}/{name}") for name in ("chunks", "paths"))
    base = f"{chunk_path}/base"
    if not current_version(spark, base):
        return chunks, paths
    old_chunks, old_paths = (read_current(spark, base, name) for name in ("chunks", "paths"))
    upto = old_paths.agg(F.max("batch_id")).first()[0]
    since = lambda df: df.where(F.col("batch_id") > (-1 if upto is None else upto))
    return old_chunks.unionByName(since(chunks)), old_paths.unionByName(since(paths))


def current_chunks(spark: SparkSession, chunk_path: str) -> DataFrame:
    """(path, chunk_no, content) of the newest version of every path; a path now gone or without chunks has none."""
    chunks, paths = _log(spark, chunk_path)
    return _newest(chunks, paths).select("path", "chunk_no", "content")


def _newest(rows: DataFrame, paths: DataFrame) -> DataFrame:
    newest = paths.groupBy(norm_path("path").alias("norm")).agg(F.max("batch_id").alias("batch_id"))
    return rows.withColumn("norm", norm_path("path")).join(newest, ["norm", "batch_id"], "left_semi").drop("norm")


def current_records(spark: SparkSession, chunk_path: str) -> DataFrame:
    """(path, n_chunks) of every file that is not gone."""
    chunks, paths = _log(spark, chunk_path)
    counts = _newest(chunks, paths).groupBy(norm_path("path").alias("norm")).agg(F.count("*").alias("n"))
    here = _newest(paths, paths).where("not gone").withColumn("norm", norm_path("path"))
    return here.join(counts, "norm", "left").select("path", F.coalesce("n", F.lit(0)).alias("n_chunks"))


def compact(spark: SparkSession, chunk_path: str) -> None:
    """Rewrite the log's state as one version and switch to it; readers then skip the batches it holds."""
    chunks, paths = _log(spark, chunk_path)
    last = paths.agg(F.max("batch_id")).first()[0]
    state = {
        "chunks": _newest(chunks, paths).withColumn("batch_id", F.lit(last).cast("int")),
        "paths": _newest(paths, paths).withColumn("batch_id", F.lit(last).cast("int")),
    }
    publish(state, f"{chunk_path}/base")


LATENESS, WIDTH = "10 minutes", "5 minutes"


def stream_metrics(events: DataFrame) -> DataFrame:
    """Per-name 5-minute statistics of a stream (name, duration, ts) with a 10-minute watermark."""
    return (
        events.withWatermark("ts", LATENESS)
        .groupBy(F.window("ts", WIDTH), "name")
        .agg(
            F.count("*").alias("n"),
            F.avg("duration").alias("avg"),
            F.min("duration").alias("min"),
            F.max("duration").alias("max"),
        )
        .select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "name", "n", "avg", "min", "max")
    )


#: Buckets of the keyed table of windows.
WINDOW_BUCKETS = 32


def run_to_windows(stream: DataFrame, root: str, checkpoint: str, buckets: int = WINDOW_BUCKETS):
    """Keep a table of all windows, open ones included, in step with a metric stream. Returns the streaming query.

    In update mode every batch gives the windows it changed, with their whole aggregates; these replace the rows of the same
    start and name. Only buckets of changed windows are written, as a new version (``current_windows`` reads the last), so a
    batch that is repeated after a failure changes nothing, and readers never see half a batch.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        changed = materialise(batch, "changed")
        at = bucket_of(F.col("start"), buckets)
        touched = sorted(r["b"] for r in changed.select(at.alias("b")).distinct().collect())  # at most ``buckets``
        if not touched:
            return
        base = current_version(spark, root)
        rows = changed
        if base:
            old = read_buckets(spark, root, "windows", touched, base)
            rows = changed.unionByName(old.join(changed.select("start", "name"), ["start", "name"], "left_anti").select(changed.columns))
        publish_buckets({"windows": (rows, F.col("start"))}, root, buckets, touched, base)
        discard(changed)

    return (
        stream.writeStream.foreachBatch(merge).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def current_windows(spark: SparkSession, root: str) -> DataFrame:
    """The table that ``run_to_windows`` keeps."""
    return read_buckets(spark, root, "windows")


PAIRED = "event_id long, name string, duration double"
PAIR_STATE = "ids array<long>, known array<boolean>, names array<string>, starts array<long>, ends array<long>, until array<long>"
#: Groups that hold the open events of a pairing stream; a call of Python serves a whole group.
PAIR_BUCKETS = 1024
#: What no start and no end stand as, in microseconds.
NO_START, NO_END = (1 << 63) - 1, -(1 << 63)


def stream_pairs(events: DataFrame, patience: str = LATENESS, buckets: int = PAIR_BUCKETS) -> DataFrame:
    """(event_id, name, duration in ms) of a stream of starts and ends (event_id, name, phase, ts), one row per completed event.

    The state of an event holds its first start and last end until both are there; then it gives its row and is done. A start or
    end without the other is dropped by a timer when the watermark has passed its time by ``patience``, so the state
    stays bounded by what is open. A pair that comes within one batch never waits. Like the batch form it needs ``start`` and
    ``end`` rows with a time; other phases are ignored. Events are dealt to ``buckets`` by a hash, and a bucket's open events are
    one state, so the rows of many events are folded at once.
    """
    wait = _milliseconds(patience)
    key = ["event_id", "known", "name"]

    def fold(parts: list[pd.DataFrame]) -> pd.DataFrame:
        rows = pd.concat(parts, ignore_index=True)
        return rows.groupby(key, sort=False, dropna=False, as_index=False).agg(
            start=("start", "min"), end=("end", "max"), until=("until", "min"), latest=("latest", "max")
        )

    def step(_, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentWatermarkMs()
        held = None
        for rows in batches:
            us, start, end = rows["us"], rows["phase"] == "start", rows["phase"] == "end"
            rows = rows[key].assign(start=us.where(start, NO_START), end=us.where(end, NO_END), until=NO_START, latest=us)
            held = fold([rows] if held is None else [held, rows])
        if state.exists:
            old = pd.DataFrame(dict(zip([*key, "start", "end", "until"], state.get, strict=True))).assign(latest=NO_END)
            held = old if held is None else fold([old, held])
        if held is None:
            return
        done = (held["start"] != NO_START) & (held["end"] != NO_END)
        paired, held = held[done], held[~done]
        # an event with a row in this batch waits from its latest time on; another keeps its timer
        fresh = held["latest"] != NO_END
        until = held["until"].where(~fresh, (held["latest"] // 1000 + wait).clip(lower=now + 1))
        held = held.assign(until=until)[fresh | (until >= now)]
        if len(held):
            names = held["name"].astype(object).where(held["name"].notna(), None)
            state.update((held["event_id"].tolist(), held["known"].tolist(), names.tolist(), *(held[c].tolist() for c in ("start", "end", "until"))))
            state.setTimeoutTimestamp(max(int(held["until"].min()), now + 1))
        elif state.exists:
            state.remove()
        if len(paired):
            ids = paired["event_id"].astype("Int64").where(paired["known"].astype(bool))
            names = paired["name"].astype(object).where(paired["name"].notna(), None)
            yield pd.DataFrame({"event_id": ids, "name": names, "duration": (paired["end"] - paired["start"]) / 1000})

    marked = events.withWatermark("ts", patience).where(F.col("phase").isin("start", "end") & F.col("ts").isNotNull()).select(
        F.pmod(F.xxhash64("event_id", "name"), F.lit(buckets)).cast("int").alias("bucket"),
        F.coalesce("event_id", F.lit(0)).cast("long").alias("event_id"), F.col("event_id").isNotNull().alias("known"),
        "name", "phase", F.unix_micros("ts").alias("us"), "ts",
    )
    return marked.groupBy("bucket").applyInPandasWithState(step, PAIRED, PAIR_STATE, "append", GroupStateTimeout.EventTimeTimeout)


def _milliseconds(interval: str) -> int:
    number, unit = interval.split()
    return int(number) * {"second": 1000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000}[unit.rstrip("s")]


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Drain a stream into Parquet (append mode)."""
    query = (
        stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination()
