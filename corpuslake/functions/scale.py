"""Small helpers that keep plans safe at scale.

* ``broadcast_if_small`` hints a broadcast only after a bounded count proves
  the side is small; otherwise the shuffle join stays.
* ``contains_join`` is a substring join written as an equi-join on q-grams.
* ``skew_safe_lag`` gives LAG over a hot key without one task owning the key.
* ``arrow_rows`` bounds the rows that a Python worker holds at a time.
* ``shared_dir`` names the folder for tables written between job stages.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MAX_BROADCAST_ROWS = 200_000
MAX_BROADCAST_BYTES = 64 << 20


def is_small(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS, max_bytes: int = MAX_BROADCAST_BYTES) -> bool:
    """Measure at most ``max_rows + 1`` rows, and their bytes as JSON, against the bounds.

    It runs ``df``: give a stored table, or one that is cheap to make twice.
    """
    size = df.limit(max_rows + 1).select(F.length(F.to_json(F.struct("*"))).alias("b"))
    rows, total = size.agg(F.count("*"), F.sum("b")).first()
    return rows <= max_rows and (total or 0) <= max_bytes


def broadcast_if_small(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint behind checked row and byte bounds; beyond them a hint that keeps the shuffle join."""
    return hint_small(df, is_small(df, max_rows))


def hint_small(df: DataFrame, small: bool) -> DataFrame:
    """Broadcast hint for a frame whose bound the caller has checked; Spark itself goes by the files' size, and repeated values take next to none."""
    return F.broadcast(df) if small else df.hint("merge")


def shared_dir(spark: SparkSession) -> str:
    """A fresh sub-folder of the cluster's checkpoint folder.

    ``spark.checkpoint.dir`` is read from the session. Where it is unset, a
    temporary folder is made and set in local mode only (tests on one machine);
    on a cluster, executors could not see it, so an error is raised instead.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/corpuslake-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back (lineage is cut, executors may be lost)."""
    path = f"{shared_dir(df.sparkSession)}/{name}"
    df.write.mode("overwrite").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


@contextmanager
def arrow_rows(spark: SparkSession, most: int) -> Iterator[None]:
    """Jobs that run inside hand Python workers ``most`` rows at a time, so that rows of whole texts take bounded memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(most, int(before)) if int(before) > 0 else most))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def discard(*tables: DataFrame | None) -> None:
    """Delete tables that ``materialise`` returned, once nothing will read them again."""
    for table in tables:
        path = getattr(table, "_stored_at", None)
        if path:
            delete_folder(table.sparkSession, path.rsplit("/", 1)[0])


def delete_folder(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def grams_of(text: Column, size: int) -> Column:
    """Distinct ``size``-character substrings of a text, found in one regex pass."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(rf"(?s)(?=(.{{{size}}}))"), F.lit(1)))


def contains_join(
    hay: DataFrame,
    hay_col: str,
    needles: DataFrame,
    needle_col: str,
    small_side: str = "needles",
    min_len: int = 1,
) -> DataFrame:
    """Rows of ``hay`` joined to every needle that occurs in ``hay_col`` as a substring.

    A needle of four or more characters is anchored by its first four
    characters, a shorter one by its first two (or one). The text's own grams
    are produced row-locally and equi-joined with the anchors, so only rows that
    share an anchor are verified; no other row pairs are formed. It is meant for
    short texts (terms, names): each gram's row carries the text. The named small
    side is broadcast once its size is proven small, so the other is not
    shuffled. ``min_len`` may state that no needle is shorter, which saves grams.
    """
    n = F.length(needle_col)
    anchor = F.substring(F.col(needle_col), F.lit(1), F.when(n >= 4, 4).when(n >= 2, 2).otherwise(1))
    sized = needles.where(n > 0).withColumn("_anchor", anchor)
    sizes = [size for size in (1, 2, 4) if size >= min(min_len, 2)]
    grams = F.flatten(F.array(*[grams_of(F.col(hay_col), size) for size in sizes]))
    exploded = hay.withColumn("_anchor", F.explode(grams))
    if small_side == "needles":
        sized = broadcast_if_small(sized)
    else:
        exploded = broadcast_if_small(exploded)
    return (
        exploded.join(sized, "_anchor")
        .where(F.col(hay_col).contains(F.col(needle_col)))
        .drop("_anchor")
    )


def skew_safe_lag(
    df: DataFrame, keys: list[str], pos: str, cols: dict[str, str], width: int = 10_000
) -> DataFrame:
    """Add LAG values over (keys, pos) where ``pos`` is a whole number.

    Rows are windowed in position buckets of ``width``; the first row of each
    bucket takes its predecessor from the last row of the previous non-empty
    bucket (one small row per bucket). A key holding a third of the table is
    thus spread over many tasks. ``cols`` maps source column -> output column.
    """
    bucket = F.floor(F.col(pos) / width)
    df = df.withColumn("_bucket", bucket)
    last = F.max_by(F.struct(*[F.col(c) for c in cols]), F.col(pos))
    tails = df.groupBy(*keys, "_bucket").agg(last.alias("_tail"))
    over_buckets = Window.partitionBy(*keys).orderBy("_bucket")
    heads = tails.select(
        *keys, "_bucket", F.lag("_tail").over(over_buckets).alias("_before")
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy(pos)
    here = F.struct(*[F.col(c) for c in cols])
    out = (
        df.withColumn("_first", F.row_number().over(inside) == 1)
        .withColumn("_prev", F.lag(here).over(inside))
        .join(heads, [*keys, "_bucket"], "left")
        .withColumn("_prev", F.when(F.col("_first"), F.col("_before")).otherwise(F.col("_prev")))
    )
    for src, dst in cols.items():
        out = out.withColumn(dst, F.col("_prev").getField(src))
    return out.drop("_bucket", "_first", "_before", "_prev")
