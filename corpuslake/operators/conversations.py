"""Conversation logs: pages, lists, batch saves, deletes, titles, frame clean-up, routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslake.functions import fixed_values as fv
from corpuslake.functions.scale import broadcast_if_small, skew_safe_lag
from corpuslake.functions.text import contains_any, trim_ws


def page(msgs: DataFrame, limit: int = 50, offset: int = 0, order: str = "turn") -> DataFrame:
    """The latest ``limit`` messages after ``offset`` per conversation, with ``ord`` oldest first."""
    w = Window.partitionBy("conv_id").orderBy(F.col(order).desc())
    last = msgs.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= offset + limit)
    page_rows = last.where(F.col("_r") > offset)
    n = F.count("*").over(Window.partitionBy("conv_id"))
    return page_rows.withColumn("ord", (n + offset + 1 - F.col("_r")).cast("int")).drop("_r")


def list_conversations(convs: DataFrame, starred: DataFrame | None = None) -> DataFrame:
    """Starred first, then newest first."""
    if starred is None:
        marked = convs.withColumn("starred", F.lit(False))
    else:
        s = starred.select("conv_id").distinct().withColumn("_s", F.lit(True))
        marked = (
            convs.join(broadcast_if_small(s), "conv_id", "left")
            .withColumn("starred", F.coalesce("_s", F.lit(False)))
            .drop("_s")
        )
    return marked.orderBy(F.col("starred").desc(), F.col("ts").desc(), "conv_id")


def save_messages(msgs: DataFrame, convs: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(messages, conversations) after a batch: saved by id, missing conversations added, parent time raised.

    ``msgs``/``batch``: id, conv_id, role, text, ts. ``convs``: conv_id, label, ts.
    A batch row with ``op`` 'replace' sets the whole row, nulls too; any other (or
    without that column) is a partial update, of which null fields change
    nothing. All rows of an id apply in order of ts.
    """
    fields = [c for c in msgs.columns if c != "id"]
    op = F.col("op") if "op" in batch.columns else F.lit("update")
    ops = batch.withColumn("_replace", F.coalesce(op == "replace", F.lit(False)))
    whole = ops.where("_replace").groupBy("id").agg(
        F.max_by(F.struct(*fields), "ts").alias("_whole"), F.max("ts").alias("_since")
    )
    parts = ops.where("not _replace").join(whole.select("id", "_since"), "id", "left").where(
        F.col("_since").isNull() | (F.col("ts") > F.col("_since"))
    )
    latest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("ts")))
    parts = parts.groupBy("id").agg(*[latest(c).alias(f"_p_{c}") for c in fields])
    joined = msgs.join(whole, "id", "full_outer").join(parts, "id", "full_outer")
    kept = lambda c: F.when(F.col("_since").isNotNull(), F.col(f"_whole.{c}")).otherwise(F.col(c))
    out = joined.select("id", *[F.coalesce(f"_p_{c}", kept(c)).alias(c) for c in fields])
    touched = batch.groupBy("conv_id").agg(F.max("ts").alias("_t"))
    parents = (
        convs.join(touched, "conv_id", "full_outer")
        .select(
            "conv_id",
            F.coalesce("label", F.lit("")).alias("label"),
            F.coalesce("_t", "ts").alias("ts"),
        )
    )
    return out, parents


def delete_conversations(keys: DataFrame, *tables: DataFrame) -> tuple[DataFrame, ...]:
    """Every table (keyed by conv_id) without the given conversations."""
    gone = broadcast_if_small(keys.select("conv_id").distinct())
    return tuple(t.join(gone, "conv_id", "left_anti") for t in tables)


TITLE_CHARS = 20


def titles(msgs: DataFrame) -> DataFrame:
    """(conv_id, title): first user turn cut to 20 characters."""
    mine = msgs.where("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("t"))
    dots = F.when(F.length("t") > TITLE_CHARS, "...").otherwise("")
    return mine.select("conv_id", F.concat(F.substring(trim_ws("t"), 1, TITLE_CHARS), dots).alias("title"))


def collapse(frames: DataFrame) -> DataFrame:
    """Last version of each message at its last place, runs of equal (role, text) reduced to one.

    ``frames``: conv_id, idx, id, role, text.
    """
    last = (
        frames.groupBy("conv_id", "id")
        .agg(F.max_by(F.struct("idx", "role", "text"), "idx").alias("m"))
        .select("conv_id", "id", "m.idx", "m.role", "m.text")
    )
    seen = skew_safe_lag(last, ["conv_id"], "idx", {"role": "_r", "text": "_t"})
    same = F.col("role").eqNullSafe(F.col("_r")) & F.col("text").eqNullSafe(F.col("_t"))
    return seen.where(~same).drop("_r", "_t")


def route(msgs: DataFrame, web_search: bool = True) -> DataFrame:
    """Add doc_type, doc_title, overview, analysis, search, route ('error', 'document', 'overview', 'answer')."""
    q = trim_ws("text")
    low = F.lower(q)
    ppt, word = contains_any(low, fv.PPT_WORDS), contains_any(low, fv.WORD_WORDS)
    title: Column = q
    for w in fv.PPT_WORDS + fv.WORD_WORDS + fv.TITLE_NOISE_WORDS:
        title = F.regexp_replace(title, f"(?i){w}", "")
    title = trim_ws(title)
    analysis = contains_any(low, fv.ANALYSIS_WORDS)
    for p in fv.ANALYSIS_PATTERNS:
        analysis = analysis | low.rlike(p)
    df = (
        msgs.withColumn("doc_type", F.when(ppt, "ppt").when(word, "word"))
        .withColumn("_title", title)
        .withColumn("overview", contains_any(low, fv.OVERVIEW_SUBJECTS) & contains_any(low, fv.OVERVIEW_ASKS))
        .withColumn("analysis", analysis)
        .withColumn("search", contains_any(low, fv.WEB_SEARCH_WORDS) & F.lit(web_search))
    )
    default = F.when(F.col("doc_type") == "ppt", "演示文稿").otherwise("文档报告")
    return (
        df.withColumn(
            "doc_title",
            F.when(
                F.col("doc_type").isNotNull(),
                F.when(F.length("_title") < 2, default).otherwise(F.col("_title")),
            ),
        )
        .withColumn(
            "route",
            F.when(q == "", "error")
            .when(F.col("doc_type").isNotNull(), "document")
            .when(F.col("overview"), "overview")
            .otherwise("answer"),
        )
        .drop("_title")
    )
