"""Operational metrics: statistics, errors, health, pairing, dashboard, trends.

Metric tables hold ``name``, ``duration`` (ms) and ``ts``. Few names share all
rows, so everything is partially aggregated and trends are split by time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SLOW_MS, VERY_SLOW_MS, MANY_ERRORS = 1_000, 5_000, 10


def perf_stats(events: DataFrame) -> DataFrame:
    """(name, n, avg, max, slowest): one row per name and one (null name) overall."""
    return (
        events.rollup("name")
        .agg(
            F.count("*").alias("n"),
            F.avg("duration").alias("avg"),
            F.max("duration").alias("max"),
            F.max_by("name", F.struct("duration", "ts")).alias("slowest"),
            F.grouping("name").alias("overall"),
        )
    )


def timings(events: DataFrame) -> DataFrame:
    """(name, avg, min, max, n) rounded to two places."""
    return events.groupBy("name").agg(
        F.round(F.avg("duration"), 2).alias("avg"),
        F.round(F.min("duration"), 2).alias("min"),
        F.round(F.max("duration"), 2).alias("max"),
        F.count("*").alias("n"),
    )


def write_timings_csv(stats: DataFrame, path: str) -> None:
    heads = ["Operation", "Average", "Min", "Max", "Count"]
    stats.select("name", "avg", "min", "max", "n").toDF(*heads).write.mode("overwrite").option("header", True).csv(path)


def error_stats(errors: DataFrame, last: int = 10) -> DataFrame:
    """(section, key, value): total, count by module, most recent errors (newest first by value)."""
    row = lambda s, k, v: [F.lit(s).alias("section"), k.cast("string").alias("key"), v.cast("bigint").alias("value")]
    by = errors.groupBy(F.coalesce("module", F.lit("unknown")).alias("m")).agg(F.count("*").alias("n"))
    total = errors.agg(F.count("*").alias("n"))
    newest = errors.orderBy(F.col("ts").desc(), F.col("error_id").desc()).limit(last)
    return (
        total.select(*row("total", F.lit("errors"), F.col("n")))
        .unionByName(by.select(*row("module", F.col("m"), F.col("n"))))
        .unionByName(newest.select(*row("recent", F.col("error_id"), F.unix_micros("ts"))))
    )


def slow_operations(events: DataFrame, limit_ms: float = SLOW_MS) -> DataFrame:
    return events.where(F.col("duration") > limit_ms)


def health(events: DataFrame, errors: DataFrame, corpus: DataFrame) -> DataFrame:
    """One row: status and issues (many errors, very slow operation, empty corpus)."""
    n_err = errors.agg(F.count("*").alias("n")).scalar()
    n_doc = corpus.agg(F.count("*").alias("n")).scalar()
    top = events.agg(
        F.max("duration").alias("slowest"),
        F.max_by("name", F.struct("duration", "ts")).alias("name"),
        F.count_if(F.col("duration") > SLOW_MS).alias("slow_operations"),
    )
    issues = F.array_compact(
        F.array(
            F.when(n_err > MANY_ERRORS, F.concat(F.lit("many_errors: "), n_err.cast("string"))),
            F.when(
                F.col("slowest") > VERY_SLOW_MS,
                F.concat(F.lit("very_slow: "), "name", F.lit(" "), F.round("slowest").cast("bigint").cast("string")),
            ),
            F.when(n_doc == 0, F.lit("empty_corpus")),
        )
    )
    size = F.size("issues")
    return (
        top.withColumn("issues", issues)
        .withColumn("status", F.when(size == 0, "healthy").when(size < 3, "warning").otherwise("error"))
        .select("status", "issues", "slow_operations")
    )


def paired(events: DataFrame) -> DataFrame:
    """(event_id, name, duration_ms) of completed events; input event_id, name, phase, ts."""
    t = F.unix_micros("ts")
    g = events.groupBy("event_id", "name").agg(
        F.min(F.when(F.col("phase") == "start", t)).alias("s"), F.max(F.when(F.col("phase") == "end", t)).alias("e")
    )
    return g.where("s is not null and e is not null").select("event_id", "name", ((F.col("e") - F.col("s")) / 1000).alias("duration"))


def pair_events(events: DataFrame) -> DataFrame:
    """(name, avg_ms, n) over completed events."""
    return paired(events).groupBy("name").agg(F.round(F.avg("duration"), 2).alias("avg"), F.count("*").alias("n"))


META = "avgTopScore string, latencyMs string, ms string, phase string, sources array<string>"


def search_dashboard(log: DataFrame) -> DataFrame:
    """One row from log rows (message, context, metadata JSON): score, latency, coverage, steps."""
    df = log.select("message", "context", F.from_json("metadata", META).alias("m"))
    num = lambda c: F.coalesce(F.col(f"m.{c}"), F.lit("0")).try_cast("double")
    metric, done = F.col("message") == "Search metrics", F.col("message") == "Search completed"
    step = (F.col("context") == "LangGraph") & (F.col("message") == "LangGraph step") & (F.col("m.phase") == "end")
    agg = df.agg(
        F.coalesce(F.avg(F.when(metric, num("avgTopScore"))), F.lit(0.0)).alias("s"),
        F.coalesce(F.avg(F.when(done, num("latencyMs"))), F.lit(0.0)).alias("l"),
        F.count_if(step).alias("step_count"),
        F.coalesce(F.avg(F.when(step & (num("ms") > 0), num("ms"))), F.lit(0.0)).alias("st"),
    )
    sources = (
        df.where(done).select(F.explode("m.sources").alias("src")).where("src <> ''").agg(F.count_distinct("src").alias("n"))
    ).scalar()
    return agg.select(
        F.round("s", 3).alias("mean_score"),
        F.round("l").cast("bigint").alias("mean_latency"),
        sources.alias("coverage"),
        "step_count",
        F.round("st").cast("bigint").alias("step_mean_latency"),
    )


def trend(events: DataFrame, seconds: int = 300, bucket: int = 3_600) -> DataFrame:
    """Add avg, min, max over the last ``seconds`` per name, the row itself included.

    Names are few and hot, so each is cut into time buckets; rows close to a
    bucket's end are also shown to the next one, which is all it looks back to.
    """
    width, span = max(bucket, seconds) * 1_000_000, seconds * 1_000_000
    t = F.unix_micros("ts")
    own = F.floor(t / width)
    near = (own + 1) * width - t <= span
    homes = F.array_compact(
        F.array(
            F.struct(own.alias("b"), F.lit(True).alias("own")),
            F.when(near, F.struct((own + 1).alias("b"), F.lit(False).alias("own"))),
        )
    )
    spread = events.withColumn("_t", t).withColumn("_h", F.explode(homes))
    w = Window.partitionBy("name", "_h.b").orderBy("_t").rangeBetween(-span, 0)
    return (
        spread.withColumn("avg", F.avg("duration").over(w))
        .withColumn("min", F.min("duration").over(w))
        .withColumn("max", F.max("duration").over(w))
        .where("_h.own")
        .drop("_t", "_h")
    )
