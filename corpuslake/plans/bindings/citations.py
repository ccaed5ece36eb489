"""Context and citation queries over BM25 hits."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslake.functions.scale import materialise
from corpuslake.operators import citations as ci
from corpuslake.operators import lexical as lx
from corpuslake.plans.bindings.inputs import CORPUS, FILES, QUERIES_CTE, corpus, files, queries, table
from corpuslake.plans.bindings.lexical import INDEX, bm25_sql, hits
from corpuslake.plans.bindings.pages import trim_sql

NL = "chr(10)"
N = 20


def hit_rows(spark, sf):
    """Hits with metadata: kind by language, score 1/(1+rank), OCR confidence by rank."""
    h = hits(spark, sf, N).select("query_id", "doc_id", "rank")
    c = corpus(spark, sf).join(h, "doc_id")
    kind = F.when(F.col("lang") == "fr", "url").when(F.col("lang") == "es", "ocr").otherwise("file")
    r = F.col("rank")
    return c.select(
        "query_id", "rank", "text", "doc_id",
        F.when(kind == "url", F.concat(F.lit("https://docs.example.com/"), "source")).otherwise(F.col("source")).alias("source"),
        (1 / (1 + r)).alias("score"),
        kind.alias("source_type"),
        F.when(kind == "ocr", r / 20.0).alias("ocr_confidence"),
        F.array("lang", "folder").alias("tags"),
        (r % 3).cast("int").alias("page_number"),
        F.col("n_chars").cast("int").alias("position"),
        F.col("doc_id").alias("fetched_at"),
        r.cast("int").alias("paragraph_index"),
        F.when(r < 5, F.array(F.lit("vector"), F.lit("keyword"), F.lit("keyword"))).otherwise(F.array(F.lit("vector"))).alias("search_sources"),
        F.array(F.lit("  "), F.col("folder"), F.col("text")).alias("related"),
    )


HIT_ROWS = f"""{INDEX}, {bm25_sql('h', 'queries', 'query_id', N)},
hr0 as (select h.query_id, h.rank, c.*, case lang when 'fr' then 'url' when 'es' then 'ocr' else 'file' end as source_type from h join corpus c on c.doc_id = h.doc_id),
hit_rows as (select query_id, rank, text, doc_id, case when source_type = 'url' then 'https://docs.example.com/' || source else source end as source,
  1.0::double / (1 + rank) as score, source_type, case when source_type = 'ocr' then rank / 20.0::double end as ocr_confidence,
  [lang, folder] as tags, cast(rank % 3 as integer) as page_number, cast(n_chars as integer) as position, doc_id as fetched_at,
  cast(rank as integer) as paragraph_index, case when rank < 5 then ['vector', 'keyword', 'keyword'] else ['vector'] end as search_sources,
  folder from hr0),
cits as (select query_id, rank as pos, case when length(text) > 300 then substr(text, 1, 300) || '...' else text end as content,
  doc_id || '.txt' as file_name, case when page_number > 0 then page_number end as page_number, source as file_path,
  case when source_type = 'url' then 'url' else 'text' end as file_type, score, position, source_type,
  case when source_type = 'url' then source end as url, fetched_at, ocr_confidence, tags, search_sources, paragraph_index, folder, text, doc_id
  from hit_rows)"""


def cits(spark, sf):
    return ci.to_citations(hit_rows(spark, sf))


def admitted(spark, sf):
    return ci.admit(hit_rows(spark, sf), queries(spark, sf), 0.4)


def admit(spark, sf):
    out = admitted(spark, sf)
    return out.select("query_id", "rank", "admitted", F.round("threshold", 6).alias("threshold"))


def assemble(spark, sf):
    out = ci.assemble(admitted(spark, sf))
    return out.select(
        "query_id", "retrieved", "effective", "unique_sources", F.round("top_score", 6).alias("top_score"),
        F.round("threshold", 6).alias("threshold"), F.md5("context").alias("context"),
    )


def routing(spark, sf):
    c = table(spark, sf, "conversations")
    return c.select("conv_id", "turn", ci.use_hybrid(F.col("text"), F.col("role") == "user").alias("hybrid"))


def to_citations(spark, sf):
    return cits(spark, sf).select(
        "query_id", "pos", "file_name", "page_number", "file_path", "file_type", F.round("score", 6).alias("score"),
        "position", "source_type", "url", "fetched_at", F.md5("content").alias("content"),
    )


def doubled(spark, sf):
    """The citation list followed by itself with every score halved, and pages without number once more raised."""
    c = cits(spark, sf)
    again = c.withColumn("pos", F.col("pos") + N).withColumn("score", F.when(F.col("page_number").isNull(), F.col("score") * 1.5).otherwise(F.col("score") / 2))
    return c.union(again)


DOUBLED = f"""doubled as (select query_id, pos, content, file_path, page_number, score, file_name from cits union all
  select query_id, pos + {N}, content, file_path, page_number, case when page_number is null then score * 1.5 else score / 2 end, file_name from cits)"""


def dedupe(spark, sf):
    out = ci.dedupe_citations(doubled(spark, sf))
    return out.select("query_id", "pos", "file_path", "page_number", F.round("score", 6).alias("score"))


def merge(spark, sf):
    c = doubled(spark, sf).withColumn("file_path", F.concat(F.lit("Lib\\"), F.element_at("tags", -1)))
    out = ci.merge_by_file(c)
    return out.select(
        "query_id", "id", "rank", "file_name", "file_type", F.round("max_score", 6).alias("max_score"), F.round(F.col("avg_score") + 1e-9, 6).alias("avg_score"),
        F.array_join(F.transform("chunks", lambda x: F.format_string("%.4f", x["score"])), "|").alias("scores"),
    )


def tag_table(spark, sf):
    d = table(spark, sf, "documents")
    ids = d.select(F.col("lang").alias("id")).distinct()
    return ids.select("id", F.concat(F.lit("Language "), F.upper("id")).alias("name"))


def enrich(spark, sf):
    f = materialise(files(spark, sf).withColumn("path", F.upper("path")), "files")
    out = ci.enrich(cits(spark, sf), f, tag_table(spark, sf))
    return out.select(
        "query_id", "pos", "file_size", "file_updated_at", F.array_join("tag_names", "|").alias("tag_names"), F.md5("preview").alias("preview"),
        F.size("related_content").alias("n_related"), F.md5(F.array_join("related_content", "|")).alias("related"),
        "place_text", "from_vector", "from_keyword", "from_ocr", "ocr_quality",
    )


def stats(spark, sf):
    return ci.citation_stats(cits(spark, sf)).withColumn("value", F.round("value", 6))


def validate(spark, sf):
    c = doubled(spark, sf).withColumn("score", F.col("score") * 3).withColumn(
        "content", F.when(F.col("page_number") == 2, "  \n").otherwise(F.col("content"))
    )
    return ci.validate(c).select("query_id", "pos", "valid", F.array_join("issues", "|").alias("issues"))


def ordered(strategy):
    def run(spark, sf):
        return ci.order_citations(cits(spark, sf), strategy).select("query_id", "pos", "ord")

    return run


def answers(spark, sf):
    """Assistant turns citing their turn number; turn 1 cites nothing."""
    c = table(spark, sf, "conversations").where("role = 'assistant'")
    n = F.length("text") % 4
    mark = F.when(F.col("turn") == 1, F.lit("")).otherwise(F.concat(F.lit(" [1] and ["), F.col("turn").cast("string"), F.lit("]")))
    return c.select("conv_id", "turn", F.concat("text", mark).alias("answer"), n.alias("n_sources"))


def grounding(spark, sf):
    j = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return ci.grounding(answers(spark, sf)).select("conv_id", "turn", "status", j("cited"), j("invalid"), "retry")


def outline(spark, sf):
    q = queries(spark, sf)
    titles = F.filter(F.transform(F.split("text", r"\."), lambda s: F.trim(s)), lambda s: s != "")
    s = q.select(F.col("query_id").alias("topic_id"), F.posexplode(titles).alias("section_no", "title"))
    s = materialise(s, "sections")
    c = corpus(spark, sf)
    ask = s.select((F.col("topic_id") * 1000 + F.col("section_no")).alias("query_id"), F.col("title").alias("text"))
    both = q.select((-F.col("query_id") - 1).alias("query_id"), "text").union(ask)
    found = materialise(lx.bm25_search(c, both, 10), "found")
    sec = found.where("query_id >= 0 and rank <= 5").select(
        F.floor(F.col("query_id") / 1000).alias("topic_id"), (F.col("query_id") % 1000).cast("int").alias("section_no"), "doc_id", "rank"
    )
    top = found.where("query_id < 0").select((-F.col("query_id") - 1).alias("topic_id"), "doc_id", "rank")
    out = ci.outline_context(c, s.select("topic_id", "section_no", "title"), sec, top)
    return out.select("topic_id", "section_no", F.md5("context").alias("context"), F.array_join("sources", "|").alias("sources"))


def export(fmt):
    def run(spark, sf):
        cols = ["query_id", "pos", "content", "file_name", "file_path", "score", "source_type", "tags"]
        c = cits(spark, sf).select(*cols)
        if fmt == "json":
            c = c.select("query_id", "pos", "content", "file_name")
        return ci.export_citations(c, fmt).withColumn("text", F.md5("text"))

    return run


QUERIES = {
    "x1_admit": admit,
    "x2_assemble": assemble,
    "x2_routing": routing,
    "x3_to_citations": to_citations,
    "x4_dedupe": dedupe,
    "x5_merge_by_file": merge,
    "x6_enrich": enrich,
    "x7_stats": stats,
    "x7_summary": lambda spark, sf: ci.citation_summary(cits(spark, sf)),
    "x8_validate": validate,
    "x9_order_relevance": ordered("relevance"),
    "x9_order_quality": ordered("quality"),
    "x9_order_source": ordered("source"),
    "x9_order_date": ordered("date"),
    "x10_grounding": grounding,
    "x11_outline_context": outline,
    "s9_export_markdown": export("markdown"),
    "s9_export_text": export("text"),
    "s9_export_json": export("json"),
}


def order_sql(key: str) -> str:
    return f"with {HIT_ROWS} select query_id, pos, row_number() over (partition by query_id order by {key}, pos) as ord from cits"


_prev = f"regexp_replace({trim_sql('content')}, '([。！？.!?])\\s+', '\\1' || chr(1), 'g')"
_preview = f"""case when contains({_prev}, chr(1)) then array_to_string(string_split({_prev}, chr(1))[1:3], ' ')
  when length({trim_sql('content')}) > 200 then substr({trim_sql('content')}, 1, 200) || '...' else {trim_sql('content')} end"""
_pct = "cast(cast(floor(score * 100 + 0.5) as integer) as varchar) || '%'"

ORACLES = {
    "x1_admit": f"""with {HIT_ROWS} select query_id, rank, round(case when max(case when rank = 1 then score end) over (partition by query_id) >= 0.25 then 0.25 else 0 end, 6) as threshold,
        score >= case when max(case when rank = 1 then score end) over (partition by query_id) >= 0.25 then 0.25 else 0 end as admitted from hit_rows""",
    "x2_assemble": f"""with {HIT_ROWS} select query_id, count(*) as retrieved, count(*) filter (score >= 0.25) as effective,
        count(distinct source || ':' || page_number || ':' || md5(text)) filter (score >= 0.25) as unique_sources,
        round(max(score), 6) as top_score, 0.25::double as threshold,
        md5(string_agg(text, {NL} || {NL} order by score desc, rank) filter (score >= 0.25)) as context from hit_rows group by 1""",
    "x2_routing": """select conv_id, turn, role = 'user' and (regexp_matches(text, '[a-zA-Z0-9]') or contains(text, ' ') or length(text) >= 20) as hybrid from conversations""",
    "x3_to_citations": f"""with {HIT_ROWS} select query_id, pos, file_name, page_number, file_path, file_type, round(score, 6) as score, position,
        source_type, url, fetched_at, md5(content) as content from cits""",
    "x4_dedupe": f"""with {HIT_ROWS}, {DOUBLED}, k as (select *, file_path || ':' || coalesce(page_number, 0) || ':' || content as k from doubled),
      b as (select query_id, k, arg_max({{'f': file_path, 'p': page_number, 's': score}}, {{'s': score, 'o': -pos}}) as b, min(pos) as first from k group by 1, 2)
      select query_id, row_number() over (partition by query_id order by b.s desc, first) as pos, b.f as file_path, b.p as page_number, round(b.s, 6) as score from b""",
    "x5_merge_by_file": f"""with {HIT_ROWS}, d as (select query_id, pos, score, folder, file_name, file_type from cits union all
        select query_id, pos + {N}, case when page_number is null then score * 1.5 else score / 2 end, folder, file_name, file_type from cits),
      g as (select query_id, 'Lib/' || folder as id, arg_min(file_name, pos) as file_name, arg_min(file_type, pos) as file_type, max(score) as m, avg(score) as a,
        min(pos) as first, string_agg(format('{{:.4f}}', score), '|' order by score desc, pos) as scores from d group by 1, 2)
      select query_id, id, row_number() over (partition by query_id order by m desc, first) as rank, file_name, file_type, round(m, 6) as max_score,
        round(a + 1e-9, 6) as avg_score, scores from g""",
    "x6_enrich": f"""with {HIT_ROWS}, e as (select *, case when source_type = 'url' then null else true end as known, {_preview} as pv from cits),
      f as (select e.*, n_chars, lang from e join documents d on d.doc_id = e.doc_id),
      r as (select *, list_concat([pv], list_transform(list_filter([folder, {trim_sql('text')}], lambda s: s <> '' and s <> {trim_sql('content')}),
        lambda s: case when length(s) > 150 then substr(s, 1, 150) || '...' else s end))[1:3] as rel from f)
      select query_id, pos, case when known then case when n_chars < 1024 then n_chars || ' B'
          else regexp_replace(cast(round(n_chars / 1024, 2) as varchar), '\\.0$', '') || ' KB' end end as file_size,
        case when known then fetched_at end as file_updated_at, case when known then 'Language ' || upper(lang) end as tag_names, md5(pv) as preview,
        len(rel) as n_related, md5(array_to_string(rel, '|')) as related,
        case when page_number is not null then '第 ' || page_number || ' 页 · ' else '' end || '位置 ' || position || ' · 段落 ' || (paragraph_index + 1) as place_text,
        1 as from_vector, case when pos < 5 then 2 else 0 end as from_keyword, 0 as from_ocr,
        case when source_type = 'ocr' then case when ocr_confidence >= 0.9 then '高' when ocr_confidence >= 0.7 then '中' else '低' end end as ocr_quality from r""",
    "x7_stats": f"""with {HIT_ROWS} select query_id, 'total' as section, 'all' as key, count(*)::double as value from cits group by 1
      union all select query_id, 'avg_score', 'all', round(avg(score), 6) from cits group by 1
      union all select query_id, 'avg_confidence', 'all', round(coalesce(avg(ocr_confidence), 0), 6) from cits group by 1
      union all select query_id, 'source_type', source_type, count(*) from cits group by 1, 3
      union all select query_id, 'file_type', file_type, count(*) from cits group by 1, 3
      union all select query_id, 'source', file_path, count(*) from cits group by 1, 3
      union all select query_id, 'tag', t, count(*) from (select query_id, unnest(tags) as t from cits) group by 1, 3""",
    "x7_summary": f"""with {HIT_ROWS}, t as (select query_id, t, min(pos * 10 + i) as p from (select query_id, pos, unnest(tags) as t, unnest([0, 1]) as i from cits) group by 1, 2),
      tg as (select query_id, list(t order by p) as ts from t group by 1),
      k as (select query_id, source_type as st, min(pos) as p, count(*) as n from cits group by 1, 2),
      kg as (select query_id, string_agg(case st when 'file' then '文件' when 'url' then 'URL' else 'OCR' end || ': ' || n || '个', '，' order by p) as ks from k group by 1),
      y as (select query_id, file_type, min(pos) as p from cits group by 1, 2),
      yg as (select query_id, string_agg(file_type, '、' order by p) as ys from y group by 1),
      g as (select query_id, count(*) as n, count(distinct file_path) as d, avg(score) as s from cits group by 1)
      select g.query_id, '共引用 ' || n || ' 个来源，来自 ' || d || ' 个文档，涉及 ' || len(ts) || ' 个主题：' || array_to_string(ts[1:3], '、') ||
        case when len(ts) > 3 then ' 等' else '' end || '，包含 ' || ys || ' 类型文件，平均相关度 ' || cast(floor(s * 100 + 0.5) as integer) || '%（' || ks || '）' as summary
      from g join tg on tg.query_id = g.query_id join kg on kg.query_id = g.query_id join yg on yg.query_id = g.query_id""",
    "x8_validate": f"""with {HIT_ROWS}, d as (select query_id, pos, page_number, score, source_type, ocr_confidence from cits union all
        select query_id, pos + {N}, page_number, case when page_number is null then score * 1.5 else score / 2 end, source_type, ocr_confidence from cits),
      i as (select query_id, pos, list_filter([case when page_number = 2 then '内容为空' end, case when score * 3 > 1 then '分数超出范围' end,
        case when source_type = 'ocr' and ocr_confidence < 0.5 then 'OCR置信度较低' end], lambda x: x is not null) as xs from d)
      select query_id, pos, len(xs) = 0 as valid, array_to_string(xs, '|') as issues from i""",
    "x9_order_relevance": order_sql("score desc"),
    "x9_order_quality": order_sql("coalesce(ocr_confidence, score) desc"),
    "x9_order_source": order_sql("source_type"),
    "x9_order_date": order_sql("fetched_at desc"),
    "x10_grounding": """with a as (select conv_id, turn, text || case when turn = 1 then '' else ' [1] and [' || turn || ']' end as answer, length(text) % 4 as n from conversations where role = 'assistant'),
      b as (select *, regexp_extract_all(answer, '\\[([0-9]+)\\]', 1) as m from a),
      c as (select *, list_filter(m, lambda x, i: list_position(m, x) = i) as cited from b),
      d as (select *, list_filter(cited, lambda x: x::bigint < 1 or x::bigint > n) as bad from c),
      e as (select *, case when answer = '' or n = 0 then 'ok' when len(cited) = 0 then 'missing_citations' when len(bad) > 0 then 'invalid_citations' else 'ok' end as status from d)
      select conv_id, turn, status, array_to_string(cited, ',') as cited, array_to_string(bad, ',') as invalid, status = 'invalid_citations' as retry from e""",
    "x11_outline_context": f"""with {INDEX}, secs as (select query_id as topic_id, unnest(range(len(ts))) as section_no, unnest(ts) as title from (
        select query_id, list_filter(list_transform(string_split(text, '.'), lambda s: trim(s)), lambda s: s <> '') as ts from queries)),
      asked as (select topic_id * 1000 + section_no as query_id, title as text from secs union all select -query_id - 1, text from queries),
      {bm25_sql('f', 'asked', 'query_id', 10)},
      fr as (select f.query_id, f.rank, c.text, c.doc_id || '.txt' as name from f join corpus c on c.doc_id = f.doc_id),
      own as (select query_id, string_agg(text, {NL} || {NL} order by rank) as ctx, string_agg(name, '|' order by rank) as src
        from fr where query_id >= 0 and rank <= 5 group by 1),
      top as (select -query_id - 1 as topic_id, string_agg(text, {NL} || {NL} order by rank) as ctx from fr where query_id < 0 group by 1)
      select s.topic_id, cast(s.section_no as integer) as section_no, md5(coalesce(o.ctx, t.ctx, '')) as context, coalesce(o.src, '') as sources from secs s
        left join own o on o.query_id = s.topic_id * 1000 + s.section_no left join top t on t.topic_id = s.topic_id""",
    "s9_export_markdown": f"""with {HIT_ROWS} select query_id, pos as ord, md5('### ' || pos || '. ' || file_name || {NL} || {NL} || '**来源类型**: ' || source_type || {NL} || {NL}
        || '**相关度**: ' || {_pct} || {NL} || {NL} || '**标签**: ' || array_to_string(tags, ', ') || {NL} || {NL} || '**内容**:' || {NL} || '> ' || content || {NL} || {NL}
        || '**路径**: `' || file_path || '`' || {NL} || {NL} || '---' || {NL} || {NL}) as text from cits""",
    "s9_export_text": f"""with {HIT_ROWS} select query_id, pos as ord, md5(pos || '. ' || file_name || {NL} || '   类型: ' || source_type || {NL} || '   相关度: ' || {_pct} || {NL}
        || '   标签: ' || array_to_string(tags, ', ') || {NL} || '   内容: ' || case when length(content) > 100 then substr(content, 1, 100) || '...' else content end || {NL} || {NL}) as text from cits""",
    "s9_export_json": f"""with {HIT_ROWS} select query_id, pos as ord, md5('{{"pos":' || pos || ',"content":' || to_json(content) || ',"file_name":"' || file_name || '"}}') as text from cits""",
}
