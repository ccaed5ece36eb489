"""Metric queries over the event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslake.functions.scale import shared_dir
from corpuslake.operators import metrics as mt
from corpuslake.plans.bindings.inputs import events, table


def metrics(spark, sf):
    return events(spark, sf).select(
        F.col("event_type").alias("name"), (F.col("value") * 10).alias("duration"), "ts", "event_id"
    )


def errors(spark, sf):
    e = events(spark, sf).where("event_type = 'error'")
    m = F.col("user_id") % 5
    return e.select(
        F.col("event_id").alias("error_id"), F.when(m > 0, F.concat(F.lit("mod"), m.cast("string"))).alias("module"), F.col("props").alias("message"), "ts"
    )


def perf(spark, sf):
    return mt.perf_stats(metrics(spark, sf)).select("name", "n", F.round("avg", 6).alias("avg"), "max", "slowest", F.col("overall").cast("int").alias("overall"))


def timings(spark, sf):
    return mt.timings(metrics(spark, sf))


def timings_csv(spark, sf):
    path = f"{shared_dir(spark)}/timings"
    mt.write_timings_csv(mt.timings(metrics(spark, sf)), path)
    schema = "Operation string, Average double, Min double, Max double, Count bigint"
    return spark.read.schema(schema).option("header", True).csv(path)


def health(spark, sf):
    out = mt.health(metrics(spark, sf), errors(spark, sf), table(spark, sf, "documents"))
    return out.withColumn("issues", F.array_join("issues", "|"))


def phases(spark, sf):
    """Start and end of every event; errors never end, the end comes value seconds later."""
    e = events(spark, sf)
    us = F.unix_micros("ts")
    start = e.select("event_id", F.col("event_type").alias("name"), F.lit("start").alias("phase"), "ts")
    end = e.where("event_type <> 'error'").select(
        "event_id", "event_type", F.lit("end"), F.timestamp_micros(us + F.round(F.col("value") * 1000000).cast("bigint"))
    )
    return start.union(end)


def log(spark, sf):
    """Events as search-log rows: clicks are metrics, views completed searches, purchases ended steps."""
    e = events(spark, sf)
    t = F.col("event_type")
    k = F.get_json_object("props", "$.k")
    kind = F.when(t == "click", "Search metrics").when(t == "view", "Search completed").otherwise("LangGraph step")
    meta = F.to_json(
        F.struct(
            F.when(t == "click", F.col("value")).alias("avgTopScore"),
            F.when(t == "view", F.col("value")).alias("latencyMs"),
            F.when(~t.isin("click", "view"), F.col("value") - 20).alias("ms"),
            F.when(t == "purchase", "end").otherwise("start").alias("phase"),
            F.when(t == "view", F.array(F.concat(F.lit("doc"), k), F.lit(""))).alias("sources"),
        )
    )
    return e.select(kind.alias("message"), F.when(t == "click", "Search").otherwise("LangGraph").alias("context"), meta.alias("metadata"))


def trend(spark, sf):
    out = mt.trend(metrics(spark, sf))
    return out.select("event_id", "name", *[F.round(c, 6).alias(c) for c in ("duration", "avg", "min", "max")])


def slow(spark, sf):
    return mt.slow_operations(metrics(spark, sf)).select("event_id", "name", F.round("duration", 6).alias("duration"))


QUERIES = {
    "p1_perf_stats": perf,
    "p2_timings": timings,
    "p2_timings_csv": timings_csv,
    "p3_error_stats": lambda spark, sf: mt.error_stats(errors(spark, sf)),
    "p4_health": health,
    "p4_slow_operations": slow,
    "p5_pair_events": lambda spark, sf: mt.pair_events(phases(spark, sf)),
    "p6_search_dashboard": lambda spark, sf: mt.search_dashboard(log(spark, sf)),
    "p7_trend": trend,
}

M = "m as (select event_type as name, value * 10 as duration, ts, event_id from events)"
_T = f"with {M} select name, round(avg(duration), 2) as avg, round(min(duration), 2) as min, round(max(duration), 2) as max, count(*) as n from m group by 1"

ORACLES = {
    "p1_perf_stats": f"""with {M} select name, count(*) as n, round(avg(duration), 6) as avg, max(duration) as max, name as slowest, 0 as overall from m group by name
      union all select null, count(*), round(avg(duration), 6), max(duration), arg_max(name, (duration, ts)), 1 from m""",
    "p2_timings": _T,
    "p2_timings_csv": f'select name as "Operation", avg as "Average", min as "Min", max as "Max", n as "Count" from ({_T})',
    "p3_error_stats": """with e as (select event_id, ts, case when user_id % 5 > 0 then 'mod' || (user_id % 5) else 'unknown' end as m from events where event_type = 'error')
      select 'total' as section, 'errors' as key, count(*) as value from e union all select 'module', m, count(*) from e group by m
      union all select 'recent', event_id::varchar, epoch_us(ts) from (select * from e order by ts desc, event_id desc limit 10)""",
    "p4_health": f"""with {M}, x as (select list_filter([case when (select count(*) from events where event_type = 'error') > 10 then 'many_errors: ' || (select count(*) from events where event_type = 'error') end,
        case when max(duration) > 5000 then 'very_slow: ' || arg_max(name, (duration, ts)) || ' ' || cast(round(max(duration)) as bigint) end,
        case when (select count(*) from documents) = 0 then 'empty_corpus' end], lambda i: i is not null) as xs, count(*) filter (duration > 1000) as slow_operations from m)
      select case when len(xs) = 0 then 'healthy' when len(xs) < 3 then 'warning' else 'error' end as status, array_to_string(xs, '|') as issues, slow_operations from x""",
    "p4_slow_operations": f"with {M} select event_id, name, round(duration, 6) as duration from m where duration > 1000",
    "p5_pair_events": "select event_type as name, round(avg(round(value * 1000000) / 1000), 2) as avg, count(*) as n from events where event_type <> 'error' group by 1",
    "p6_search_dashboard": """select round(avg(value) filter (event_type = 'click'), 3) as mean_score, cast(round(avg(value) filter (event_type = 'view')) as bigint) as mean_latency,
        count(distinct json_extract_string(props, '$.k')) filter (event_type = 'view') as coverage, count(*) filter (event_type = 'purchase') as step_count,
        cast(round(coalesce(avg(value - 20) filter (event_type = 'purchase' and value > 20), 0)) as bigint) as step_mean_latency from events""",
    "p7_trend": f"""with {M} select event_id, name, round(duration, 6) as duration, round(avg(duration) over w, 6) as avg, round(min(duration) over w, 6) as min, round(max(duration) over w, 6) as max
      from m window w as (partition by name order by ts range between interval 300 seconds preceding and current row)""",
}
