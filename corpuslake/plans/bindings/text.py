"""Text analytics queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslake.functions import fixed_values as fv
from corpuslake.operators import chunking as ck
from corpuslake.operators import textstats as ts
from corpuslake.plans.bindings.inputs import CORPUS, USER_QUERIES_CTE, corpus, sql_list, sql_str, table, user_queries
from corpuslake.plans.bindings.pages import trim_sql

NL = "chr(10)"
WORDS = "[a-zA-Z]{3,10}"  # the driver text holds no CJK


def docs(spark, sf):
    return corpus(spark, sf)


def page_texts(spark, sf):
    """Raw page sources: the tables' richest punctuation."""
    return table(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("text"))


def parts(spark, sf):
    """Lines of documents and pages as the parts whose quality is judged."""
    d = docs(spark, sf).select("doc_id", "text").union(
        page_texts(spark, sf).select((-F.col("doc_id") - 1).alias("doc_id"), "text")
    )
    return d.select("doc_id", F.explode(F.split("text", "[.\n]")).alias("text"))


_mean = "length(regexp_replace(text, '[^\\x{4e00}-\\x{9fa5}a-zA-Z0-9]', '', 'g'))"
_punc = "length(regexp_replace(text, '[^!\"#$%&''()*+,\\-./:;<=>?@\\[\\\\\\]^_`{|}~！（）【】、，。；：？《》]', '', 'g'))"
_garbled = f"""(length(text) >= 50 and (({_mean} / length(text) < 0.3 and {_punc} / length(text) > 0.4)
  or regexp_matches(text, '[!"#$%&''()*]{{5,}}') or regexp_matches(text, '[!"][#$][!"][%&]') or regexp_matches(text, '(?:!["#$%&]){{3,}}')))"""
PARTS = """parts as (select doc_id, unnest(string_split_regex(text, '[.\\n]')) as text from (
  select doc_id, text from documents union all select -page_id - 1, html from pages))"""


def script(spark, sf):
    d = ts.detect_script(docs(spark, sf)).select("doc_id", "script")
    q = ts.detect_script(user_queries(spark, sf)).select((-F.col("query_id") - 1).alias("doc_id"), "script")
    return d.union(q)


def garbled(spark, sf):
    return ts.garbled(parts(spark, sf)).groupBy("doc_id").agg(
        F.count("*").alias("n"), F.count_if("garbled").alias("n_garbled")
    )


def quality(spark, sf):
    out = ts.quality_gate(parts(spark, sf))
    return out.select(
        "doc_id", F.round("garbled_ratio", 6).alias("garbled_ratio"), F.round("meaningful_ratio", 6).alias("meaningful_ratio"), "keep"
    )


def keywords(spark, sf):
    return ts.keywords(docs(spark, sf)).select("doc_id", "term", "n", F.col("rank").cast("long").alias("rank"))


def profile(spark, sf):
    j = lambda c: F.array_join(c, "|").alias(c)
    return ts.profile(docs(spark, sf)).select(
        "doc_id", "topic", j("keywords"), F.md5(F.array_join("entities", "|")).alias("entities"), "complexity", j("questions")
    )


def summarize(spark, sf):
    j = lambda c: F.array_join(c, "|").alias(c)
    return ts.summarize(docs(spark, sf), "short").select("doc_id", "summary", j("key_points"), j("tags"))


def feedback(spark, sf):
    return ts.feedback_terms(docs(spark, sf).select("doc_id", "text"), table(spark, sf, "labels"))


def numbered(spark, sf):
    d = docs(spark, sf)
    return d.select("doc_id", F.concat(F.lit("# List\n1. "), F.replace("text", F.lit(". "), F.lit(".\n2)  ")), F.lit("\n3.\n生成 x\n")).alias("text"))


def list_items(spark, sf):
    return ts.list_items(numbered(spark, sf)).withColumn("item", F.md5("item"))


def messages(spark, sf):
    """Turns with two reasoning parts, the second left open on user turns."""
    c = table(spark, sf, "conversations")
    step = lambda i, t, s, b: [F.lit(f"[STEP:{i}:{t}:{s}:Icon]"), b, F.lit("[/STEP]")]
    tail = F.when(F.col("role") == "user", F.lit("<think>open end")).otherwise(F.lit("<think>more</think> bye"))
    return c.select(
        "conv_id", "turn",
        F.concat(
            F.lit("<think>"), *step("a", "Find", "loading", F.col("role")), *step("b", "Plan", "success", F.lit(" plan\n")),
            *step("a", "Found", "success", F.col("turn").cast("string")), F.lit("</think>"), "text", tail,
        ).alias("text"),
    )


MESSAGES = """messages as (select conv_id, turn, '<think>[STEP:a:Find:loading:Icon]' || role || '[/STEP][STEP:b:Plan:success:Icon] plan' || chr(10)
  || '[/STEP][STEP:a:Found:success:Icon]' || turn || '[/STEP]</think>' || text ||
  case when role = 'user' then '<think>open end' else '<think>more</think> bye' end as text from conversations)"""


def reasoning(spark, sf):
    return ts.split_reasoning(messages(spark, sf)).select("conv_id", "turn", "reasoning", F.md5("answer").alias("answer"))


def steps(spark, sf):
    return ts.steps(ts.split_reasoning(messages(spark, sf)))


QUERIES = {
    "t1_detect_script": script,
    "t2_garbled": garbled,
    "t3_quality_gate": quality,
    "t4_keywords": keywords,
    "t5_profile": profile,
    "t6_summarize": summarize,
    "t7_feedback_terms": feedback,
    "t8_list_items": list_items,
    "t9_split_reasoning": reasoning,
    "t9_steps": steps,
}

_script = """case when length(regexp_replace(text, '[^\\x{4e00}-\\x{9fa5}]', '', 'g')) = 0 and length(regexp_replace(text, '[^a-zA-Z]', '', 'g')) = 0 then 'mixed'
  when length(regexp_replace(text, '[^\\x{4e00}-\\x{9fa5}]', '', 'g')) > length(regexp_replace(text, '[^a-zA-Z]', '', 'g')) then 'zh' else 'en' end"""
KEYWORDS = f"""{CORPUS}, w as (select doc_id, unnest(ws) as term, unnest(range(len(ws))) as pos
    from (select doc_id, regexp_extract_all(lower(text), '{WORDS}') as ws from corpus)),
  c as (select doc_id, term, count(*) as n, min(pos) as p from w group by 1, 2),
  kw as (select * from (select *, row_number() over (partition by doc_id order by n desc, p) as rank from c) where rank <= 8)"""

ORACLES = {
    "t1_detect_script": f"""with {USER_QUERIES_CTE} select doc_id, {_script} as script from documents
      union all select -query_id - 1, {_script} from user_queries""",
    "t2_garbled": f"with {PARTS} select doc_id, count(*) as n, count(*) filter ({_garbled}) as n_garbled from parts group by 1",
    "t3_quality_gate": f"""with {PARTS}, r as (select doc_id, avg({_garbled}::int) as g,
        case when sum(length(text)) > 0 then sum({_mean}) / sum(length(text)) else 0.0 end as m from parts group by 1)
      select doc_id, round(g, 6) as garbled_ratio, round(m, 6) as meaningful_ratio, not (g > 0.2 or m < 0.4) as keep from r""",
    "t4_keywords": f"with {KEYWORDS} select doc_id, term, n, rank from kw",
    "t5_profile": f"""with {KEYWORDS}, k as (select doc_id, list(term order by rank) as ks from kw group by 1),
      d as (select corpus.doc_id, text, coalesce(ks, []) as ks from corpus left join k on k.doc_id = corpus.doc_id)
      select doc_id, case when len(ks) = 0 then '未知主题' else array_to_string(ks[1:2], '、') end as topic, array_to_string(ks, '|') as keywords,
        md5(array_to_string(regexp_extract_all(text, '[A-Z][a-zA-Z]+'), '|')) as entities,
        cast(least(10, greatest(1, floor(length(text) / 100))) as integer) as complexity,
        array_to_string(list_transform(ks[1:3], lambda k: '关于' || k || '有什么信息？'), '|') as questions from d""",
    "t6_summarize": f"""select doc_id, case when length(text) > 200 then substr(text, 1, 200) || '...' else text end as summary,
        array_to_string(list_filter(string_split_regex(text, '[。！？.!?]'), lambda s: {trim_sql('s')} <> '')[1:3], '|') as key_points,
        array_to_string(list_filter(ws, lambda x, i: list_position(ws, x) = i)[1:5], '|') as tags
      from (select doc_id, text, regexp_extract_all(text, '{WORDS}') as ws from documents)""",
    "t7_feedback_terms": """with w as (select doc_id, unnest(ws) as term, unnest(range(len(ws))) as pos from (
        select d.doc_id, regexp_extract_all(lower(text), '[a-zA-Z]{3,}') as ws from documents d join labels l on l.doc_id = d.doc_id where quality = 1)),
      f as (select term, min((doc_id, pos)) as seen, count(distinct doc_id) as n_docs from w group by 1)
      select 'relevant' as label, term, seen[1] as first_doc, cast(seen[2] as integer) as first_pos, n_docs from f order by seen limit 20""",
    "t8_list_items": f"""with d as (select doc_id, '# List' || {NL} || '1. ' || replace(text, '. ', '.' || {NL} || '2)  ') || {NL} || '3.' || {NL} || '生成 x' || {NL} as text from documents),
      l as (select doc_id, list_filter(list_transform(list_transform(string_split(text, {NL}), lambda s: {trim_sql('s')}), lambda s:
        case when regexp_matches(s, '^[0-9]+[.)]') then nullif({trim_sql("regexp_replace(s, '^[0-9]+[.)]', '')")}, '')
          when s <> '' and not starts_with(s, '#') and not starts_with(s, '生成') then s end), lambda x: x is not null) as xs from d)
      select doc_id, cast(unnest(range(len(xs))) as integer) as ord, md5(unnest(xs)) as item from l""",
    "t9_split_reasoning": f"""with {MESSAGES} select conv_id, turn,
        {trim_sql("array_to_string(regexp_extract_all(text, '(?s)<think>(.*?)(?:</think>|$)', 1), chr(10))")} as reasoning,
        md5(regexp_replace(text, '(?s)<think>(.*?)(?:</think>|$)', '', 'g')) as answer from messages""",
    "t9_steps": """select conv_id, turn, 0 as ord, 'a' as id, 'Found' as title, 'success' as status, 'Icon' as icon, cast(turn as varchar) as content from conversations
      union all select conv_id, turn, 1, 'b', 'Plan', 'success', 'Icon', 'plan' from conversations""",
}
