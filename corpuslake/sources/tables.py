"""Scans, the chunk table, folder inventories, import plans, source deletes, upserts, logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslake.functions import fixed_values as fv
from corpuslake.functions.scale import broadcast_if_small
from corpuslake.functions.text import blank_to_null, extension, norm_path, path_tail, trim_ws


def scan(spark: SparkSession, path: str, cols: list[str] | None = None, limit: int | None = None, key: str | None = None) -> DataFrame:
    """Projected corpus scan; a row cap needs an order key, so it is repeatable."""
    df = spark.read.parquet(path)
    df = df.select(*cols) if cols else df
    if limit is None:
        return df
    if key is None:
        raise ValueError("a row cap needs an order key")
    return df.orderBy(key).limit(limit)


# ------------------------------------------------------------- chunk schema

STRINGS = ["source", "fileName", "fileType", "sourceType", "chunkingStrategy"]
INTS = ["pageNumber", "position", "chunkIndex"]
TEXTS = ["title", "description", "author", "created", "modified"]
LISTS = ["tags", "blockTypes"]
KNOWN_FIELDS = STRINGS + INTS + TEXTS + LISTS + ["importedAt", "hasHeading", "headingText"]
# fields of the metadata struct, and the copies kept as top-level columns
STRUCT_ORDER = (
    "source tags fileName fileType pageNumber position sourceType importedAt chunkIndex blockTypes hasHeading "
    "headingText chunkingStrategy title description author created modified"
).split()
TOP_ORDER = [c for c in STRUCT_ORDER if c not in ("created", "modified")]


def _number(c: Column) -> Column:
    n = F.try_cast(trim_ws(c), "double") if hasattr(F, "try_cast") else trim_ws(c).try_cast("double")
    return F.when(F.isnan(n) | (F.abs(n) == float("inf")), None).otherwise(n)


def _clean(field: str, m: Column) -> Column:
    v = m[field]
    if field in STRINGS:
        return blank_to_null(v)
    if field in INTS:
        return F.when(F.abs(_number(v)) < 2147483648.0, _number(v).cast("int"))
    if field == "importedAt":
        return _number(v)
    if field in LISTS:
        items = F.from_json(v, "array<string>")
        return F.coalesce(F.filter(items, lambda x: x.isNotNull()), F.array().cast("array<string>"))
    if field == "hasHeading":
        return F.coalesce(~F.lower(v).isin("", "false", "0", "null"), F.lit(False))
    return F.coalesce(v, F.lit(""))


def to_chunk_schema(df: DataFrame, dim: int | None = None) -> DataFrame:
    """Coerce (text, metadata map<string,string>[, vector]) to the fixed chunk schema.

    List values are JSON text. Unknown keys go to ``metadata.extra`` as JSON.
    A vector whose length differs from ``dim`` becomes null and, with ``dim``
    given, ``vector_ok`` says so: one bad row does not end a job.
    """
    m = F.col("metadata")
    fields = {f: _clean(f, m) for f in STRUCT_ORDER}
    rest = F.map_filter(m, lambda k, v: ~k.isin(*KNOWN_FIELDS))
    extra = F.when(F.size(rest) > 0, F.to_json(rest))
    # an empty list, false or '' is kept in the struct and left null at top level
    empty = lambda f: (
        F.when(F.size(fields[f]) > 0, fields[f]) if f in LISTS
        else F.when(fields[f], True) if f == "hasHeading"
        else blank_to_null(fields[f]) if f in TEXTS + ["headingText"]
        else fields[f]
    )
    cols = ["text", F.struct(*[c.alias(f) for f, c in fields.items()], extra.alias("extra")).alias("metadata")]
    cols += [empty(f).alias(f) for f in TOP_ORDER]
    keys = [c for c in df.columns if c not in ("text", "metadata", "vector")]
    if "vector" in df.columns:
        vec = F.col("vector").cast("array<float>")
        if dim is not None:
            fits = F.coalesce(F.size(vec) == dim, F.lit(False))
            cols.append(fits.alias("vector_ok"))
            vec = F.when(fits, vec)
        cols.insert(0, vec.alias("vector"))
    return df.select(*keys, *cols)


def _default(t: T.DataType) -> Column:
    if isinstance(t, T.ArrayType):
        return F.array().cast(t)
    if isinstance(t, T.BooleanType):
        return F.lit(False)
    return F.lit(None).cast(t)


def _align(value: Column | None, have: T.DataType | None, want: T.DataType) -> Column:
    if value is None:
        if isinstance(want, T.StructType):
            return F.struct(*[_align(None, None, f.dataType).alias(f.name) for f in want])
        return _default(want)
    if isinstance(want, T.StructType) and isinstance(have, T.StructType):
        inner = F.struct(
            *[
                _align(
                    value.getField(f.name) if f.name in have.names else None,
                    have[f.name].dataType if f.name in have.names else None,
                    f.dataType,
                ).alias(f.name)
                for f in want
            ]
        )
        return F.when(value.isNotNull(), inner)
    if (
        isinstance(want, T.ArrayType) and isinstance(want.elementType, T.StructType)
        and isinstance(have, T.ArrayType) and isinstance(have.elementType, T.StructType)
    ):
        return F.transform(value, lambda x: _align(x, have.elementType, want.elementType))
    if have == want:
        return value
    if isinstance(have, (T.StructType, T.ArrayType, T.MapType)) or isinstance(want, (T.StructType, T.ArrayType, T.MapType)):
        return _default(want) if type(have) is not type(want) else value.cast(want)
    return value.try_cast(want)


def align_to(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Shape rows to a schema at every depth: drop unknown fields, fill missing ones, cast the rest."""
    return df.select(
        *[
            _align(
                F.col(f.name) if f.name in df.columns else None,
                df.schema[f.name].dataType if f.name in df.columns else None,
                f.dataType,
            ).alias(f.name)
            for f in schema
        ]
    )


def write_chunks(df: DataFrame, path: str, mode: str = "append") -> None:
    """Overwrite, or append aligned to the schema already at ``path``."""
    if mode == "overwrite":
        df.write.mode("overwrite").parquet(path)
    elif mode == "append":
        spark = df.sparkSession
        try:
            schema = spark.read.parquet(path).schema
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            schema = None
        (df if schema is None else align_to(df, schema)).write.mode("append").parquet(path)
    else:
        raise ValueError(f"unknown write mode: {mode}")


# ---------------------------------------------------------------- inventory


def scan_folder(spark: SparkSession, path: str) -> DataFrame:
    """(path, folder, name, format, size, mtime) of supported files below ``path``; contents are not read."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
        .select("path", "length", "modificationTime")
    )
    ext = extension("path")
    return files.where(ext.isin(*fv.FOLDER_EXTENSIONS)).select(
        "path",
        F.regexp_extract("path", r"^(.*)/[^/]*\z", 1).alias("folder"),
        path_tail("path").alias("name"),
        ext.alias("format"),
        F.col("length").alias("size"),
        F.unix_millis("modificationTime").alias("mtime"),
    )


def folder_totals(inventory: DataFrame) -> DataFrame:
    """One row: file_count, total_size, folder_count."""
    return inventory.agg(
        F.count("*").alias("file_count"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("total_size"),
        F.count_distinct("folder").alias("folder_count"),
    )


def auto_tags(path: Column) -> Column:
    parts = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    parent = F.when(F.size(parts) > 1, F.element_at(parts, -2))
    parent = F.when(~parent.isin("", ".", ".."), parent)
    return F.array_distinct(F.array_compact(F.array(parent, blank_to_null(F.upper(extension(path))))))


PREVIEW_CHARS = 160


def plan_import(inventory: DataFrame, records: DataFrame, chunks: DataFrame, auto_tag: bool = True) -> DataFrame:
    """Outcome per found file: path, status ('added' | 'exists' | 'empty'), message and the new record.

    ``inventory``: path, size. ``records``: path. ``chunks``: path, chunk_no, content.
    """
    known = records.select(norm_path("path").alias("_np"), F.lit(True).alias("_known")).distinct()
    made = chunks.groupBy(norm_path("path").alias("_np")).agg(
        F.count("*").alias("chunk_count"),
        F.min_by(F.substring("content", 1, PREVIEW_CHARS), "chunk_no").alias("preview"),
    )
    df = (
        inventory.withColumn("_np", norm_path("path"))
        .join(known, "_np", "left")
        .join(made, "_np", "left")
    )
    status = F.when(F.col("_known"), "exists").when(F.col("chunk_count").isNull(), "empty").otherwise("added")
    name = path_tail("path")
    new = lambda c: F.when(F.col("status") == "added", c)
    return df.withColumn("status", status).select(
        "path",
        "status",
        F.when(F.col("status") == "exists", F.concat(F.lit("文件已存在，跳过: "), name))
        .when(F.col("status") == "empty", F.concat(F.lit("文件内容为空或无法解析: "), name))
        .alias("message"),
        new(name).alias("name"),
        new(F.col("chunk_count")).alias("chunk_count"),
        new(F.col("preview")).alias("preview"),
        new(F.col("size")).alias("size"),
        new(extension("path")).alias("format"),
        new(auto_tags(F.col("path")) if auto_tag else F.array().cast("array<string>")).alias("tags"),
    )


def import_totals(plan: DataFrame) -> DataFrame:
    return plan.groupBy("status").agg(F.count("*").alias("n"))


# ------------------------------------------------------- deletes and upserts


def _paths(sources: DataFrame) -> DataFrame:
    return broadcast_if_small(sources.select(norm_path("path").alias("_np")).distinct())


def delete_sources(chunks: DataFrame, sources: DataFrame, col: str = "source") -> DataFrame:
    """Chunks whose source is none of ``sources`` (column ``path``), in any spelling."""
    return chunks.withColumn("_np", norm_path(col)).join(_paths(sources), "_np", "left_anti").drop("_np")


def by_source(chunks: DataFrame, sources: DataFrame, col: str = "source") -> DataFrame:
    """Chunks whose source is one of ``sources`` (column ``path``), in any spelling."""
    return chunks.withColumn("_np", norm_path(col)).join(_paths(sources), "_np", "left_semi").drop("_np")


def upsert(target: DataFrame, updates: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """Merge field by field: a new non-null value wins, unknown keys are added.

    With ``order`` all updates of a key are applied in turn: for each field the
    latest non-null value counts. Partial aggregation makes hot keys cheap.
    """
    fields = [c for c in target.columns if c not in keys]
    if order:
        set_here = lambda c: F.when(F.col(c).isNotNull(), F.col(order))
        updates = updates.groupBy(*keys).agg(
            *[F.max_by(c, set_here(c)).alias(c) for c in fields if c in updates.columns]
        )
    new = updates.select(*keys, *[F.col(c).alias(f"_n_{c}") for c in fields if c in updates.columns])
    joined = target.join(new, keys, "full_outer")
    return joined.select(
        *[
            c if c in keys or f"_n_{c}" not in new.columns else F.coalesce(f"_n_{c}", c).alias(c)
            for c in target.columns
        ]
    )


# --------------------------------------------------------------------- logs

LEVELS = ["DEBUG", "INFO", "WARN", "ERROR"]
LOG_SCHEMA = "level string, message string, timestamp bigint, context string, metadata string, error string"


def level_rank(c: Column) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in LEVELS]), c) - 1


def write_log(df: DataFrame, path: str, min_level: str = "DEBUG") -> None:
    """Append entries at or above a level as JSON lines."""
    df.where(level_rank(F.col("level")) >= LEVELS.index(min_level)).write.mode("append").json(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOG_SCHEMA).json(path)


def recent(log: DataFrame, n: int = 100, level: str | None = None) -> DataFrame:
    """The most recent ``n`` entries, newest first."""
    if level:
        log = log.where(level_rank(F.col("level")) >= LEVELS.index(level))
    return log.orderBy(F.col("timestamp").desc(), F.col("message").desc()).limit(n)
