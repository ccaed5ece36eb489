"""Retrieved context and citations: admission, assembly, cleaning, statistics, export.

Citation tables are keyed by ``query_id`` (one list per answer) with a position
``pos`` from 1. Lists are as long as the retrieval depth, so per-query windows
and ordered collections stay small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslake.functions import fixed_values as fv
from corpuslake.functions.scale import broadcast_if_small, materialise
from corpuslake.functions.text import (
    CJK, WS, blank_to_null, clip, extract_all, map_value, norm_path, path_tail, safe_url_decode, trim_ws,
)


def per_query():
    return Window.partitionBy("query_id")


def _opt(df: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


# ------------------------------------------------------------------ context


def admit(hits: DataFrame, queries: DataFrame, t: float = fv.RELEVANCE_THRESHOLD) -> DataFrame:
    """Add ``threshold`` and ``admitted`` to hits (query_id, rank, score, source, ...).

    The threshold is max(0.1, t - 0.15) when the top score reaches it or the top
    source names a CJK query keyword, else 0. Rows below it stay when their
    source names a keyword.
    """
    low = max(0.1, t - 0.15)
    q = queries.select("query_id", F.lower("text").alias("_q"))
    named = lambda s: F.exists("_kw", lambda w: F.lower(s).contains(w))
    top = F.max_by(F.struct("score", "source"), -F.col("rank")).over(per_query())
    df = (
        hits.join(broadcast_if_small(q), "query_id")
        .withColumn("_kw", extract_all("_q", f"[{CJK}]{{2,4}}"))
        .withColumn("_top", top)
    )
    thr = F.when(named(F.coalesce("_top.source", F.lit(""))) | (F.col("_top.score") >= low), F.lit(low)).otherwise(
        F.lit(0.0)
    )
    df = df.withColumn("threshold", thr)
    keep = (F.col("score") >= F.col("threshold")) | named(F.coalesce("source", F.lit("")))
    return df.withColumn("admitted", keep).drop("_q", "_kw", "_top")


def use_hybrid(question: Column, is_global: Column | None = None) -> Column:
    """Route to hybrid search: Latin letters, digits, a blank, or 20 characters, on a global search."""
    rich = question.rlike("[a-zA-Z0-9]") | question.contains(" ") | (F.length(question) >= 20)
    return rich if is_global is None else rich & is_global


def assemble(admitted: DataFrame, ident_chars: int | None = None) -> DataFrame:
    """One row per query: context text and retrieval metrics, from ``admit`` output.

    Sources are told apart by path, page and text, or by the first ``ident_chars`` of the text.
    """
    text_id = F.col("text") if ident_chars is None else F.substring("text", 1, ident_chars)
    page = F.coalesce(_opt(admitted, "page_number", "int"), F.lit(0))
    ident = F.when(F.col("admitted"), F.struct("source", page, F.md5(text_id)))
    item = F.when(F.col("admitted"), F.struct((-F.col("score")).alias("s"), "rank", "text"))
    out = admitted.groupBy("query_id").agg(
        F.count("*").alias("retrieved"),
        F.count_if("admitted").alias("effective"),
        F.count_distinct(ident).alias("unique_sources"),
        F.max_by("score", -F.col("rank")).alias("top_score"),
        F.max("threshold").alias("threshold"),
        F.array_sort(F.collect_list(item)).alias("_items"),
    )
    text = F.array_join(F.transform("_items", lambda x: x["text"]), "\n\n")
    return out.withColumn("context", text).drop("_items")


def is_url(c: Column) -> Column:
    return c.startswith("http://") | c.startswith("https://")


def infer_type(name: Column) -> Column:
    last = F.lower(F.element_at(F.split(name, r"\."), -1))
    return map_value(last, fv.CITATION_FILE_TYPES, "unknown")


def to_citations(hits: DataFrame, excerpt: int = 300) -> DataFrame:
    """Project hits (query_id, rank, text, source, score, optional metadata) to citations."""
    src = F.col("source")
    url = F.coalesce(is_url(src), F.lit(False))
    tail = F.when(path_tail(src) == "", "Unknown").otherwise(path_tail(src))
    name = F.coalesce(
        blank_to_null(_opt(hits, "title")),
        blank_to_null(_opt(hits, "file_name")),
        safe_url_decode(F.coalesce(tail, F.lit("Unknown"))),
    )
    kind = F.coalesce(
        blank_to_null(_opt(hits, "file_type")),
        blank_to_null(_opt(hits, "type")),
        F.when(url, F.lit("url")).otherwise(
            F.when(infer_type(name) == "unknown", F.when(is_url(name), "url").otherwise("unknown")).otherwise(infer_type(name))
        ),
    )
    page = _opt(hits, "page_number", "int")
    typed_url = url | F.coalesce(_opt(hits, "type") == "url", F.lit(False))
    extra = [c for c in ("site_name", "ocr_confidence", "tags", "search_sources", "paragraph_index", "related") if c in hits.columns]
    return hits.select(
        "query_id",
        F.col("rank").alias("pos"),
        clip("text", excerpt).alias("content"),
        name.alias("file_name"),
        F.when(page > 0, page).alias("page_number"),
        src.alias("file_path"),
        kind.alias("file_type"),
        F.greatest(F.lit(0.0), F.coalesce("score", 1 - (F.col("rank") - 1) * 0.15)).alias("score"),
        _opt(hits, "position", "int").alias("position"),
        F.coalesce(
            blank_to_null(_opt(hits, "source_type")), F.when(typed_url, "url").otherwise("file")
        ).alias("source_type"),
        F.when(typed_url, src).alias("url"),
        F.coalesce(_opt(hits, "fetched_at", "long"), _opt(hits, "imported_at", "long")).alias("fetched_at"),
        *extra,
    )


def dedupe_citations(df: DataFrame, key_chars: int | None = None) -> DataFrame:
    """Same path, page and content (or its first ``key_chars``): keep the best score; re-position by score."""
    content = F.coalesce(F.col("content"), F.lit(""))
    if key_chars is not None:
        content = F.substring(content, 1, key_chars)
    who = F.coalesce(blank_to_null("file_path"), blank_to_null("url"), blank_to_null("file_name"), F.lit("unknown"))
    key = F.concat_ws(
        ":", who, F.coalesce("page_number", F.lit(0)), content
    )
    score = F.coalesce("score", F.lit(0.0))
    others = [c for c in df.columns if c != "query_id"]
    best = df.groupBy("query_id", F.md5(key).alias("_k")).agg(
        F.max_by(F.struct(*others), F.struct(score, -F.col("pos"))).alias("b"), F.min("pos").alias("_first")
    )
    order = per_query().orderBy(F.coalesce("b.score", F.lit(0.0)).desc(), "_first")
    ranked = best.withColumn("_n", F.row_number().over(order))
    return ranked.select("query_id", *[F.col(f"b.{c}").alias(c) for c in others if c != "pos"], F.col("_n").alias("pos"))


def _known(c: Column) -> Column:
    low = F.lower(trim_ws(c))
    return (low != "") & (low != "unknown")


def merge_by_file(df: DataFrame) -> DataFrame:
    """One row per source of a query: best and mean score, chunks by score, first known name and type."""
    path, name, url, site = F.col("file_path"), F.col("file_name"), F.col("url"), _opt(df, "site_name")
    by_url = F.col("source_type") == "url"
    ident = F.coalesce(
        F.replace(blank_to_null(path), F.lit("\\"), F.lit("/")),
        F.when(by_url, blank_to_null(url)),
        blank_to_null(name),
        F.lit("unknown"),
    )
    url_tail = F.regexp_extract(url, r"^[a-z]+://[^/?#]*(?:[^?#]*/)?([^/?#]+)/?(?:[?#].*)?\z", 1)
    from_url = safe_url_decode(F.coalesce(blank_to_null(url_tail), F.regexp_extract(url, "^[a-z]+://([^/?#:]*)", 1)))
    shown = (
        F.when(_known(name), name)
        .when(by_url, F.coalesce(blank_to_null(trim_ws(site)), from_url, F.lit("网页")))
        .when(blank_to_null(path).isNotNull(), safe_url_decode(path_tail(path)))
        .otherwise("引用来源")
    )
    guessed = map_value(F.lower(F.element_at(F.split(name, r"\."), -1)), fv.MERGED_FILE_TYPES, "text")
    kind = F.when(_known(F.col("file_type")), F.col("file_type")).when(by_url, "url").otherwise(
        F.coalesce(guessed, F.lit("text"))
    )
    s = F.coalesce("score", F.lit(0.0))
    rows = df.select(
        "query_id", ident.alias("id"), shown.alias("_name"), kind.alias("_kind"), s.alias("_s"), "pos", "page_number",
        F.coalesce("content", F.lit("")).alias("content"), "source_type",
    )
    out = rows.groupBy("query_id", "id").agg(
        F.coalesce(
            F.min_by(F.when(_known(F.col("_name")), F.col("_name")), F.when(_known(F.col("_name")), F.col("pos"))),
            F.min_by("_name", "pos"),
        ).alias("file_name"),
        F.min_by("_kind", "pos").alias("file_type"),
        F.min_by("source_type", "pos").alias("source_type"),
        F.max("_s").alias("max_score"),
        F.avg("_s").alias("avg_score"),
        F.min("pos").alias("_first"),
        F.transform(
            F.array_sort(F.collect_list(F.struct((-F.col("_s")).alias("o"), "pos", "content", "page_number"))),
            lambda c: F.struct(c["content"], c["page_number"], (-c["o"]).alias("score")),
        ).alias("chunks"),
    )
    order = per_query().orderBy(F.col("max_score").desc(), "_first")
    return out.withColumn("rank", F.row_number().over(order)).drop("_first")


# --------------------------------------------------------------- enrichment

SIZE_UNITS = ["B", "KB", "MB", "GB", "TB"]


def size_text(n: Column) -> Column:
    i = F.floor(F.log(n) / F.log(F.lit(1024.0)))
    shown = F.round(n / F.pow(F.lit(1024.0), i), 2).cast("string")
    unit = F.get(F.array(*[F.lit(u) for u in SIZE_UNITS]), i.cast("int"))
    return F.when(n > 0, F.concat(F.regexp_replace(shown, r"\.0\z", ""), F.lit(" "), unit))


def preview_of(content: Column) -> Column:
    body = trim_ws(content)
    parts = F.split(body, rf"(?<=[。！？.!?])[{WS}]+")
    return F.when(body == "", None).when(F.size(parts) > 1, F.array_join(F.slice(parts, 1, 3), " ")).otherwise(clip(body, 200))


def enrich(cits: DataFrame, files: DataFrame, tags: DataFrame | None = None, max_related: int = 3) -> DataFrame:
    """Add file size, dates, version, tag names, preview, related snippets, place text, kind counts, OCR band.

    ``files``: path, size, created_at, updated_at, version, tags (ids). ``tags``: id, name.
    """
    has = lambda c: c in files.columns
    rec = files.select(
        norm_path("path").alias("_np"),
        F.col("size").alias("_size"),
        *[F.col(c).alias(f"file_{c}") for c in ("created_at", "updated_at", "version") if has(c)],
    )
    df = cits.withColumn("_np", norm_path("file_path")).join(rec, "_np", "left")
    if tags is not None and has("tags"):
        named = (
            files.select(norm_path("path").alias("_np"), F.posexplode("tags").alias("_i", "id"))
            .join(tags.select("id", "name"), "id")
            .groupBy("_np")
            .agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "name"))), lambda x: x["name"]).alias("tag_names"))
        )
        df = df.join(named, "_np", "left")
    body = trim_ws("content")
    related = F.coalesce(_opt(cits, "related", "array<string>"), F.array().cast("array<string>"))
    others = F.transform(
        F.filter(F.transform(related, trim_ws), lambda r: (r != "") & (r != body)), lambda r: clip(r, 150)
    )
    page, place, para = _opt(cits, "page_number", "int"), _opt(cits, "position", "int"), _opt(cits, "paragraph_index", "int")
    parts = F.array_compact(
        F.array(
            F.when(page.isNotNull(), F.format_string("第 %d 页", page)),
            F.when(place.isNotNull(), F.format_string("位置 %d", place)),
            F.when(para.isNotNull() & (page.isNotNull() | place.isNotNull()), F.format_string("段落 %d", para + 1)),
        )
    )
    kinds = _opt(cits, "search_sources", "array<string>")
    count_of = lambda k: F.size(F.filter(kinds, lambda x: x == k))
    conf = _opt(cits, "ocr_confidence", "double")
    return (
        df.withColumn("file_size", size_text(F.col("_size")))
        .withColumn("preview", preview_of(F.col("content")))
        .withColumn(
            "related_content",
            F.slice(F.concat(F.array_compact(F.array(preview_of(F.col("content")))), others), 1, max_related),
        )
        .withColumn("place_text", blank_to_null(F.array_join(parts, " · ")))
        .withColumn("from_vector", count_of("vector"))
        .withColumn("from_keyword", count_of("keyword"))
        .withColumn("from_ocr", count_of("ocr"))
        .withColumn(
            "ocr_quality",
            F.when(
                (F.col("source_type") == "ocr") & conf.isNotNull(),
                F.when(conf >= 0.9, "高").when(conf >= 0.7, "中").otherwise("低"),
            ),
        )
        .drop("_np", "_size")
    )


def citation_stats(df: DataFrame) -> DataFrame:
    """(query_id, section, key, value): totals, counts per kind, tag and type, means, distinct sources."""
    cols = lambda section, key, value: [
        "query_id", F.lit(section).alias("section"), key.cast("string").alias("key"), value.cast("double").alias("value")
    ]
    head = df.groupBy("query_id").agg(
        F.count("*").alias("n"), F.avg("score").alias("s"), F.avg(_opt(df, "ocr_confidence", "double")).alias("c")
    )
    parts = [
        head.select(*cols("total", F.lit("all"), F.col("n"))),
        head.select(*cols("avg_score", F.lit("all"), F.coalesce("s", F.lit(0.0)))),
        head.select(*cols("avg_confidence", F.lit("all"), F.coalesce("c", F.lit(0.0)))),
    ]
    marked = df.select(
        "query_id",
        F.explode(
            F.concat(
                F.array(
                    F.struct(F.lit("source_type").alias("section"), F.col("source_type").alias("key")),
                    F.struct(F.lit("file_type").alias("section"), F.col("file_type").alias("key")),
                    F.struct(F.lit("source").alias("section"), F.col("file_path").alias("key")),
                ),
                F.transform(
                    F.coalesce(F.array_distinct(_opt(df, "tags", "array<string>")), F.array().cast("array<string>")),
                    lambda t: F.struct(F.lit("tag").alias("section"), t.alias("key")),
                ),
            )
        ).alias("x"),
    )
    counted = (
        marked.select("query_id", "x.section", "x.key")
        .where(F.col("key").isNotNull())
        .groupBy("query_id", "section", "key")
        .agg(F.count("*").cast("double").alias("value"))
    )
    out = counted
    for p in parts:
        out = out.unionByName(p)
    return out


def citation_summary(df: DataFrame) -> DataFrame:
    """One line of prose per query about its citations."""
    seen = lambda c: F.array_distinct(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", c))), lambda x: x[c])
    )
    df = df.withColumn("tags", F.coalesce(_opt(df, "tags", "array<string>"), F.array().cast("array<string>")))
    g = df.groupBy("query_id").agg(
        F.count("*").alias("n"),
        F.count_distinct("file_path").alias("docs"),
        F.avg("score").alias("s"),
        F.array_distinct(
            F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "tags"))), lambda x: x["tags"]))
        ).alias("tags"),
        F.filter(seen("file_type"), lambda x: x.isNotNull()).alias("types"),
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "source_type"))), lambda x: x["source_type"]).alias("kinds"),
    )
    label = lambda k: F.when(k == "file", "文件").when(k == "url", "URL").otherwise("OCR")
    detail = F.transform(
        F.filter(F.array_distinct("kinds"), lambda k: k.isNotNull()),
        lambda k: F.concat(label(k), F.lit(": "), F.size(F.filter("kinds", lambda x: x == k)).cast("string"), F.lit("个")),
    )
    empty = F.lit("")
    text = F.concat(
        F.format_string("共引用 %d 个来源", "n"),
        F.when(F.col("docs") > 0, F.format_string("，来自 %d 个文档", "docs")).otherwise(empty),
        F.when(
            F.size("tags") > 0,
            F.concat(
                F.format_string("，涉及 %d 个主题：", F.size("tags")),
                F.array_join(F.slice("tags", 1, 3), "、"),
                F.when(F.size("tags") > 3, " 等").otherwise(empty),
            ),
        ).otherwise(empty),
        F.when(F.size("types") > 0, F.concat(F.lit("，包含 "), F.array_join("types", "、"), F.lit(" 类型文件"))).otherwise(empty),
        F.when(F.col("s") > 0, F.concat(F.lit("，平均相关度 "), F.round(F.col("s") * 100).cast("int").cast("string"), F.lit("%"))).otherwise(empty),
        F.when(F.size(detail) > 0, F.concat(F.lit("（"), F.array_join(detail, "，"), F.lit("）"))).otherwise(empty),
    )
    return g.select("query_id", text.alias("summary"))


def validate(df: DataFrame) -> DataFrame:
    """Add ``issues`` (array) and ``valid``."""
    conf = _opt(df, "ocr_confidence", "double")
    blank = lambda c: F.coalesce(trim_ws(c) == "", F.lit(True))
    issues = F.array_compact(
        F.array(
            F.when(blank("content"), "内容为空"),
            F.when(
                F.coalesce(blank_to_null("file_name"), blank_to_null("file_path")).isNull(), "缺少文件标识"
            ),
            F.when((F.col("score") < 0) | (F.col("score") > 1), "分数超出范围"),
            F.when((F.col("source_type") == "ocr") & (conf < 0.5), "OCR置信度较低"),
        )
    )
    return df.withColumn("issues", issues).withColumn("valid", F.size("issues") == 0)


def order_citations(df: DataFrame, strategy: str = "relevance") -> DataFrame:
    """Add ``ord`` per query: relevance, quality, source or date."""
    some = lambda c: F.when(c != 0, c)
    score = F.coalesce("score", F.lit(0.0))
    keys = {
        "relevance": score.desc(),
        "quality": F.coalesce(some(_opt(df, "ocr_confidence", "double")), score).desc(),
        "source": F.coalesce(blank_to_null("source_type"), F.lit("unknown")).asc(),
        "date": F.coalesce(_opt(df, "fetched_at", "long"), F.lit(0)).desc(),
    }
    return df.withColumn("ord", F.row_number().over(per_query().orderBy(keys[strategy], "pos")))


def grounding(answers: DataFrame) -> DataFrame:
    """Add status ('ok', 'missing_citations', 'invalid_citations'), cited, invalid, retry."""
    cited = F.array_distinct(F.transform(extract_all("answer", r"\[([0-9]+)\]", 1), lambda n: n.cast("long")))
    df = answers.withColumn("cited", cited)
    bad = F.filter("cited", lambda n: n.isNull() | (n < 1) | (n > F.col("n_sources")))
    skip = F.coalesce(F.col("answer") == "", F.lit(True)) | (F.coalesce("n_sources", F.lit(0)) == 0)
    status = (
        F.when(skip, "ok")
        .when(F.size("cited") == 0, "missing_citations")
        .when(F.size(bad) > 0, "invalid_citations")
        .otherwise("ok")
    )
    retries = F.coalesce(_opt(answers, "retry_count", "int"), F.lit(0))
    return (
        df.withColumn("invalid", bad)
        .withColumn("status", status)
        .withColumn("retry", (F.col("status") == "invalid_citations") & (retries < 1))
    )


def outline_context(
    docs: DataFrame,
    sections: DataFrame,
    section_hits: DataFrame,
    topic_hits: DataFrame,
    section_chars: int | None = None,
    topic_chars: int | None = None,
    max_sources: int | None = None,
) -> DataFrame:
    """(topic_id, section_no, context, sources) for every outline section.

    ``sections``: topic_id, section_no, title. ``section_hits``: topic_id,
    section_no, doc_id, rank. ``topic_hits``: topic_id, doc_id, rank. A section
    without hits uses its topic's context. Contexts and source names are whole;
    the other arguments may cut them to fit a prompt (1500, 3000 and 2 in an
    interactive tool), before anything is collected.
    """

    def context(hits: DataFrame, keys: list[str], chars: int | None) -> DataFrame:
        text = F.col("text") if chars is None else F.substring("text", 1, chars)
        rows = docs.select("doc_id", text.alias("text"), "source").join(broadcast_if_small(materialise(hits, "hits")), "doc_id")
        ordered = F.array_sort(F.collect_list(F.struct("rank", "text", path_tail("source").alias("name"))))
        g = rows.groupBy(*keys).agg(ordered.alias("_o"))
        whole = F.array_join(F.transform("_o", lambda x: x["text"]), "\n\n")
        first = F.col("_o") if max_sources is None else F.slice("_o", 1, max_sources)
        return g.select(
            *keys,
            (whole if chars is None else F.substring(whole, 1, chars)).alias("_ctx"),
            F.filter(F.transform(first, lambda x: x["name"]), lambda n: n != "").alias("_src"),
        )

    own = context(section_hits, ["topic_id", "section_no"], section_chars)
    whole = context(topic_hits, ["topic_id"], topic_chars).select("topic_id", F.col("_ctx").alias("_topic"))
    return (
        sections.join(own, ["topic_id", "section_no"], "left")
        .join(whole, "topic_id", "left")
        .select(
            "topic_id",
            "section_no",
            F.coalesce("_ctx", "_topic", F.lit("")).alias("context"),
            F.coalesce("_src", F.array().cast("array<string>")).alias("sources"),
        )
    )


# ------------------------------------------------------------------- export


def export_citations(df: DataFrame, fmt: str = "json") -> DataFrame:
    """(query_id, ord, text): one export entry per citation, numbered in order, for ``write.text``."""
    df = df.withColumn("ord", F.row_number().over(per_query().orderBy("pos")))
    pct = F.concat(F.round(F.col("score") * 100).cast("int").cast("string"), F.lit("%"))
    kind = F.coalesce(blank_to_null("source_type"), F.lit("未知"))
    place, preview = _opt(df, "place_text"), _opt(df, "preview")
    tags = _opt(df, "tags", "array<string>")
    line = lambda cond, *parts: F.when(cond, F.concat(*parts)).otherwise(F.lit(""))
    if fmt == "json":
        text = F.to_json(F.struct(*[c for c in df.columns if c not in ("query_id", "ord")]))
    elif fmt == "markdown":
        text = F.concat(
            F.format_string("### %d. %s\n\n", "ord", "file_name"),
            F.concat(F.lit("**来源类型**: "), kind, F.lit("\n\n")),
            line(place.isNotNull(), F.lit("**位置**: "), place, F.lit("\n\n")),
            line(F.col("score").isNotNull(), F.lit("**相关度**: "), pct, F.lit("\n\n")),
            line(F.size(tags) > 0, F.lit("**标签**: "), F.array_join(tags, ", "), F.lit("\n\n")),
            F.concat(F.lit("**内容**:\n> "), "content", F.lit("\n\n")),
            line(preview.isNotNull(), F.lit("**预览**:\n> "), preview, F.lit("\n\n")),
            line(blank_to_null("file_path").isNotNull(), F.lit("**路径**: `"), "file_path", F.lit("`\n\n")),
            F.lit("---\n\n"),
        )
    elif fmt == "text":
        text = F.concat(
            F.format_string("%d. %s\n", "ord", "file_name"),
            F.concat(F.lit("   类型: "), kind, F.lit("\n")),
            line(place.isNotNull(), F.lit("   位置: "), place, F.lit("\n")),
            line(F.col("score").isNotNull(), F.lit("   相关度: "), pct, F.lit("\n")),
            line(F.size(tags) > 0, F.lit("   标签: "), F.array_join(tags, ", "), F.lit("\n")),
            F.concat(F.lit("   内容: "), clip("content", 100), F.lit("\n\n")),
        )
    else:
        raise ValueError(f"unknown export format: {fmt}")
    return df.select("query_id", "ord", text.alias("text"))


EXPORT_HEADS = {"json": "", "markdown": "## 引用来源\n\n", "text": "引用来源\n" + "=" * 50 + "\n\n"}
