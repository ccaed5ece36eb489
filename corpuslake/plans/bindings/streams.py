"""Streaming queries, drained with the available-now trigger."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslake.functions.scale import shared_dir
from corpuslake.operators import chunking as ck
from corpuslake.plans.bindings.inputs import NTZ_MICROS
from corpuslake.plans.bindings.metrics import phases
from corpuslake.streaming import jobs

SIZE = 1000


def deliveries(spark, sf):
    """Three deliveries of files: all as drafts; then most whole, some gone; after a compaction some once more."""
    d = spark.read.parquet(f"{sf}/documents.parquet")
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    kind = F.col("doc_id") % 10
    text, no = F.col("text"), F.lit(False)
    draft = d.select(F.upper(path).alias("path"), F.concat(F.lit("draft "), text).alias("text"), F.lit(1).alias("version"), no.alias("deleted"))
    whole = d.where(kind != 3).select(path.alias("path"), F.when(kind != 7, text).alias("text"), F.lit(2).alias("version"), (kind == 7).alias("deleted"))
    again = d.where(kind == 5).select(path.alias("path"), F.concat(F.lit("again "), text).alias("text"), F.lit(3).alias("version"), no.alias("deleted"))
    return draft, whole, again


def _ingested(spark, sf):
    """One target and one checkpoint; each delivery is a new run of the job, with a compaction before the last."""
    base = shared_dir(spark)
    inbox, target = f"{base}/inbox", f"{base}/target"
    for i, files in enumerate(deliveries(spark, sf)):
        files.write.mode("append").parquet(inbox)
        stream = jobs.stream_documents(spark, inbox, files.schema)
        jobs.stream_ingest(stream, target, f"{base}/ckpt", lambda d: ck.split_fixed(d, SIZE)).awaitTermination()
        if i == 1:
            jobs.compact(spark, target)
    return target


def ingest(spark, sf):
    out = jobs.current_chunks(spark, _ingested(spark, sf))
    return out.select("path", "chunk_no", F.md5("content").alias("content"))


def ingest_records(spark, sf):
    return jobs.current_records(spark, _ingested(spark, sf))


def _events(raw):
    return raw.select(
        F.col("event_type").alias("name"), (F.col("value") * 10).alias("duration"), F.timestamp_micros(F.expr(NTZ_MICROS)).alias("ts")
    )


def in_deliveries(frame, time, parts=3):
    """The rows in deliveries by time; each holds a run of it, and windows lie across their borders."""
    cuts = frame.select(F.percentile_approx(F.unix_micros(time), [i / parts for i in range(1, parts)], 10_000).alias("c")).first()["c"] or []
    at = F.unix_micros(time)
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        rows = frame if low is None else frame.where(at > low)
        yield rows if high is None else rows.where(at <= high)


def roll_up(spark, sf):
    """Windows as the stream's table holds them after three deliveries, each a new run of the job."""
    base = shared_dir(spark)
    events = _events(spark.read.parquet(f"{sf}/events.parquet"))
    for part in in_deliveries(events, "ts"):
        part.write.mode("append").parquet(f"{base}/inbox")
        stream = jobs.stream_metrics(jobs.stream_documents(spark, f"{base}/inbox", events.schema))
        jobs.run_to_windows(stream, f"{base}/windows", f"{base}/ckpt").awaitTermination()
    return jobs.current_windows(spark, f"{base}/windows").select(
        F.unix_micros("start").alias("start_us"), "name", "n", *[F.round(c, 6).alias(c) for c in ("avg", "min", "max")]
    )


def closed_windows(spark, sf):
    """Windows that the watermark has closed, from the append-only sink: those that end ten minutes before the last event seen."""
    base = shared_dir(spark)
    events = _events(spark.read.parquet(f"{sf}/events.parquet"))
    events.write.parquet(f"{base}/inbox")
    stream = jobs.stream_metrics(jobs.stream_documents(spark, f"{base}/inbox", events.schema))
    jobs.run_to_table(stream, f"{base}/stats", f"{base}/ckpt")
    out = spark.read.schema(stream.schema).parquet(f"{base}/stats")
    return out.select(F.unix_micros("start").alias("start_us"), "name", "n", F.round("avg", 6).alias("avg"))


def pairs(spark, sf):
    """Starts and ends of the same events as the batch pairing, in three deliveries by time."""
    base = shared_dir(spark)
    rows = phases(spark, sf)
    for part in in_deliveries(rows, "ts"):
        part.write.mode("append").parquet(f"{base}/inbox")
        stream = jobs.stream_pairs(jobs.stream_documents(spark, f"{base}/inbox", rows.schema))
        jobs.run_to_table(stream, f"{base}/paired", f"{base}/ckpt")
    done = spark.read.schema(jobs.PAIRED).parquet(f"{base}/paired")
    return done.groupBy("name").agg(F.round(F.avg("duration"), 2).alias("avg"), F.count("*").alias("n"))


QUERIES = {"z1_stream_ingest": ingest, "z1_stream_records": ingest_records, "z2_stream_metrics": roll_up, "z2_closed_windows": closed_windows, "z2_stream_pairs": pairs}

STATE = """state as (select case when doc_id % 10 = 3 then upper(source || '/' || doc_id || '.txt') else source || '/' || doc_id || '.txt' end as path,
  case when doc_id % 10 = 3 then 'draft ' || text when doc_id % 10 = 5 then 'again ' || text else text end as text
  from documents where doc_id % 10 <> 7)"""

ORACLES = {
    "z1_stream_ingest": f"""with {STATE} select path, cast(i as integer) as chunk_no, md5(substr(text, i * {SIZE} + 1, {SIZE})) as content from (
      select path, text, unnest(range(cast(ceil(length(text) / {SIZE}) as bigint))) as i from state)""",
    "z1_stream_records": f"with {STATE} select path, cast(ceil(length(text) / {SIZE}) as bigint) as n_chunks from state",
    # the stream's table holds open windows too
    "z2_stream_metrics": """with b as (select epoch_us(ts) // 300000000 * 300000000 as start_us, event_type as name, value * 10 as d from events)
      select start_us, name, count(*) as n, round(avg(d), 6) as avg, round(min(d), 6) as min, round(max(d), 6) as max from b group by 1, 2""",
    "z2_closed_windows": """with b as (select epoch_us(ts) // 300000000 * 300000000 as start_us, event_type as name, value * 10 as d from events)
      select start_us, name, count(*) as n, round(avg(d), 6) as avg from b
      where start_us + 300000000 <= (select max(epoch_us(ts)) // 1000 * 1000 - 600000000 from events) group by 1, 2""",
    "z2_stream_pairs": "select event_type as name, round(avg(round(value * 1000000) / 1000), 2) as avg, count(*) as n from events where event_type <> 'error' group by 1",
}
