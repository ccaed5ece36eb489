"""Operator inputs derived from the driver tables, in Spark and in SQL.

Every derivation covers whole tables and whole texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table. On one machine its single row group is dealt to all cores; on a cluster it is read as it lies."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.repartition(spark.sparkContext.defaultParallelism) if spark.sparkContext.master.startswith("local[") else df


def corpus(spark, sf_dir):
    """doc_id, text, source (a file path), lang, n_chars, label folder."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        "doc_id",
        "text",
        F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("source"),
        "lang",
        F.col("source").alias("folder"),
        "n_chars",
    )


CORPUS = """corpus as (
  select doc_id, text, source || '/' || doc_id || '.txt' as source, lang, source as folder, n_chars
  from documents)"""


def queries(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


QUERIES_CTE = "queries as (select item_id as query_id, text from benchmark)"


def user_queries(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where("role = 'user'")
    return c.select((F.col("conv_id") * 100 + F.col("turn")).alias("query_id"), "text")


USER_QUERIES_CTE = (
    "user_queries as (select conv_id * 100 + turn as query_id, text from conversations where role = 'user')"
)


NTZ_MICROS = (
    "cast(cast(cast(ts - timestamp_ntz'1970-01-01 00:00:00' as interval second) as decimal(20, 6)) * 1000000 as bigint)"
)


def events(spark, sf_dir):
    """Events with ``ts`` as an instant (the stored wall time read as UTC, whatever the session zone)."""
    return table(spark, sf_dir, "events").withColumn("ts", F.timestamp_micros(F.expr(NTZ_MICROS)))


def files(spark, sf_dir):
    """File records: one per document."""
    return corpus(spark, sf_dir).select(
        F.col("source").alias("path"),
        F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"),
        F.col("folder").alias("source"),
        F.array("lang", "folder").alias("tags"),
        F.col("n_chars").alias("size"),
        F.col("doc_id").alias("updated_at"),
        F.ceil(F.col("n_chars") / 1000).alias("chunk_count"),
        F.md5("text").alias("file_hash"),
        F.lit("file").alias("source_type"),
        "doc_id",
    )


FILES = CORPUS + """, files as (
  select source as path, doc_id || '.txt' as name, folder as source, [lang, folder] as tags, n_chars as size,
    doc_id as updated_at, cast(ceil(n_chars / 1000.0) as bigint) as chunk_count, md5(text) as file_hash,
    'file' as source_type, doc_id
  from corpus)"""


def inventory(spark, sf_dir):
    """What a later folder scan finds.

    Files labelled toxic are gone, files labelled low quality were edited, and
    each benchmark item arrived as a new file.
    """
    lab = table(spark, sf_dir, "labels")
    old = (
        corpus(spark, sf_dir)
        .join(lab, "doc_id", "left")
        .where("coalesce(toxic, 0) = 0")
        .withColumn(
            "text", F.when(F.col("quality") == 0, F.concat("text", F.lit(" (edited)"))).otherwise(F.col("text"))
        )
        .select(F.col("source").alias("path"), "text", "doc_id")
    )
    new = table(spark, sf_dir, "benchmark").select(
        F.concat(F.lit("bench/"), F.col("item_id").cast("string"), F.lit(".md")).alias("path"),
        "text",
        F.lit(0).cast("long").alias("doc_id"),
    )
    return old.union(new).select(
        "path",
        "text",
        F.length("text").cast("long").alias("size"),
        F.md5("text").alias("file_hash"),
        F.col("doc_id").alias("mtime"),
    )


INVENTORY = """inventory as (
  select path, text, cast(length(text) as bigint) as size, md5(text) as file_hash, mtime from (
    select c.source as path, case when l.quality = 0 then text || ' (edited)' else text end as text, c.doc_id as mtime
    from corpus c left join labels l on l.doc_id = c.doc_id where coalesce(l.toxic, 0) = 0
    union all
    select 'bench/' || item_id || '.md', text, cast(0 as bigint) from benchmark))"""


def collections(spark, sf_dir):
    """One per folder, with one member that no longer exists."""
    f = files(spark, sf_dir)
    return f.groupBy(F.col("source").alias("id")).agg(
        F.concat(F.lit("Set "), F.max("source")).alias("name"),
        F.concat(
            F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "path"))), lambda x: x["path"]),
            F.array(F.concat(F.max("source"), F.lit("/gone.txt"))),
        ).alias("files"),
    )


def sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_list(items) -> str:
    return "[" + ", ".join(sql_str(x) for x in items) + "]"
