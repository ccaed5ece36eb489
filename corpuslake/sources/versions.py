"""Versioned tables: write a new version beside the old one, then switch.

A version is a folder ``v<n>`` with a table for each name. Readers use the last
version named in the small ``versions`` table, which is written when all
tables of a version are complete; a job that dies before leaves readers on the old one.

A table may also be kept in buckets, by a hash of its key. Then a version holds no rows but a list (table, bucket, folder), and
buckets that a change does not touch are shared with the versions before: ``publish_buckets`` writes the touched ones only.

Writers do not wait for each other. A version's number is claimed by a file that only one can create, and a writer that
finds another version in use than the one it started from raises ``Conflict`` and switches nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Name of the list of a version's buckets.
LIST = "buckets"


class Conflict(RuntimeError):
    """Another writer switched versions meanwhile; read again and repeat the change."""


def current_version(spark: SparkSession, root: str) -> int:
    """Number of the version in use; 0 where there is none yet."""
    try:
        return spark.read.parquet(f"{root}/versions").agg(F.max("version")).first()[0] or 0
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return 0
        raise


def _claim(spark: SparkSession, root: str, version: int) -> int:
    """The first free number from ``version`` on; a number that a dead job has claimed is passed over."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/claims")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    while not fs.createNewFile(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/claims/v{version}")):
        version += 1
    return version


def publish(frames: dict[str, DataFrame], root: str, base: int | None = None) -> int:
    """Write the frames as the next version and switch to it. They may read the version in use, whose number is ``base``."""
    spark = next(iter(frames.values())).sparkSession
    base = current_version(spark, root) if base is None else base
    version = _claim(spark, root, base + 1)
    for name, df in frames.items():
        df.write.mode("overwrite").parquet(f"{root}/v{version}/{name}")
    if current_version(spark, root) != base:
        raise Conflict(f"{root} has moved on from version {base}")
    spark.range(1).select(F.lit(version).alias("version")).write.mode("append").parquet(f"{root}/versions")
    return version


def read_current(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/v{current_version(spark, root)}/{name}")


# ---------------------------------------------------------------- buckets


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _listed(spark: SparkSession, root: str, version: int) -> list:
    """(name, bucket, folder) of a version: a row for each bucket, not for each row of data; folder is null for the schema's row."""
    return spark.read.parquet(f"{root}/v{version}/{LIST}").collect() if version else []


def publish_buckets(frames: dict[str, tuple[DataFrame, Column]], root: str, buckets: int, touched: Iterable[int] | None = None, base: int | None = None) -> int:
    """Write the ``touched`` buckets (None: all) of each table, given as (rows, key), and switch to a version that lists these and the old others.

    The rows are those of the touched buckets, whole. A bucket without rows is not listed.
    """
    spark = next(iter(frames.values()))[0].sparkSession
    base = current_version(spark, root) if base is None else base
    only = None if touched is None else set(touched)
    stays = lambda r: r["name"] not in frames or (only is not None and (r["folder"] is None or r["bucket"] not in only))
    listed = [tuple(r) for r in _listed(spark, root, base) if stays(r)]
    for name, (df, key) in frames.items():
        folder = f"{root}/data/{name}-{uuid.uuid4().hex}"
        dealt = df.withColumn("_bucket", bucket_of(key, buckets))
        dealt.repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(folder)
        written = spark.read.schema(dealt.schema).parquet(folder)
        listed += [(name, r["_bucket"], folder) for r in written.select("_bucket").distinct().collect()]
        if not any(x[0] == name and x[2] is None for x in listed):
            df.limit(0).write.mode("overwrite").parquet(f"{root}/schemas/{name}")
            listed.append((name, -1, None))
    return publish({LIST: spark.createDataFrame(listed, "name string, bucket int, folder string")}, root, base)


def read_buckets(spark: SparkSession, root: str, name: str, only: Iterable[int] | None = None, version: int | None = None) -> DataFrame:
    """The table as of a version (default: the one in use); with ``only`` just these buckets' files are read."""
    version = current_version(spark, root) if version is None else version
    wanted = None if only is None else set(only)
    rows = [r for r in _listed(spark, root, version) if r["name"] == name and r["folder"] is not None and (wanted is None or r["bucket"] in wanted)]
    schema = spark.read.parquet(f"{root}/schemas/{name}").schema
    if not rows:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{r['folder']}/_bucket={r['bucket']}" for r in rows])


def folders(spark: SparkSession, root: str, name: str, version: int | None = None) -> dict[int, str]:
    """Bucket -> folder of a table as of a version."""
    version = current_version(spark, root) if version is None else version
    return {r["bucket"]: r["folder"] for r in _listed(spark, root, version) if r["name"] == name and r["folder"] is not None}
