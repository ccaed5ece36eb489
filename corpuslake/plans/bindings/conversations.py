"""Conversation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslake.functions import fixed_values as fv
from corpuslake.operators import conversations as cv
from corpuslake.plans.bindings.inputs import sql_str, table


def turns(spark, sf):
    return table(spark, sf, "conversations")


def convs(spark, sf):
    return turns(spark, sf).groupBy("conv_id").agg(
        F.concat(F.lit("Chat "), F.col("conv_id").cast("string")).alias("label"), F.count("*").alias("ts")
    )


def messages(spark, sf):
    t = turns(spark, sf)
    return t.select(F.concat_ws(":", "conv_id", "turn").alias("id"), "conv_id", "role", "text", F.col("turn").alias("ts"))


def page(limit, offset):
    def run(spark, sf):
        return cv.page(turns(spark, sf), limit, offset).select("conv_id", "turn", "role", F.md5("text").alias("text"), "ord")

    return run


def listing(spark, sf):
    star = turns(spark, sf).where("role = 'system'").select("conv_id").distinct()
    return cv.list_conversations(convs(spark, sf), star)


def batch(spark, sf):
    """Assistant turns get two partial updates (a role, then a text); every other user turn is replaced by a row without role;
    every conversation gets one message in a new twin."""
    t = turns(spark, sf)
    a = t.where("role = 'assistant'")
    ident = F.concat_ws(":", "conv_id", "turn").alias("id")
    one = a.select(ident, "conv_id", F.lit("helper").alias("role"), F.lit(None).cast("string").alias("text"), (F.col("turn") + 1000).alias("ts"), F.lit("update").alias("op"))
    two = a.select(ident, "conv_id", F.lit(None).cast("string").alias("role"), F.concat(F.lit("final "), F.length("text")).alias("text"), (F.col("turn") + 2000).alias("ts"), F.lit("update").alias("op"))
    swap = t.where("role = 'user' and turn % 4 = 2").select(ident, "conv_id", F.lit(None).cast("string").alias("role"), F.lit("gone").alias("text"), (F.col("turn") + 500).alias("ts"), F.lit("replace").alias("op"))
    new = t.where("turn = 0").select(
        F.concat(F.lit("new:"), "conv_id").alias("id"), (-F.col("conv_id") - 1).alias("conv_id"), F.lit("user").alias("role"), F.lit("hi").alias("text"), F.lit(5).cast("long").alias("ts"), F.lit("replace").alias("op")
    )
    return one.union(two).union(swap).union(new)


def saved_messages(spark, sf):
    m, _ = cv.save_messages(messages(spark, sf), convs(spark, sf), batch(spark, sf))
    return m.select("id", "conv_id", "role", F.md5("text").alias("text"), "ts")


def saved_parents(spark, sf):
    return cv.save_messages(messages(spark, sf), convs(spark, sf), batch(spark, sf))[1]


def deleted(spark, sf):
    gone = turns(spark, sf).where("role = 'system'").select("conv_id")
    c, m = cv.delete_conversations(gone, convs(spark, sf), messages(spark, sf))
    return c.select("conv_id", F.lit("conversation").alias("part"), F.lit("").alias("id")).union(m.select("conv_id", F.lit("message"), "id"))


def frames(spark, sf):
    """Each turn streams in three growing frames; the last is repeated under a second id."""
    t = turns(spark, sf)
    return t.select("conv_id", "turn", "role", "text", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("f")).select(
        "conv_id", (F.col("turn") * 4 + F.col("f")).alias("idx"),
        F.concat(F.col("turn").cast("string"), F.when(F.col("f") == 3, "b").otherwise("a")).alias("id"),
        "role", F.when(F.col("f") < 2, F.concat(F.lit("part "), "f")).otherwise(F.col("text")).alias("text"),
    )


def collapsed(spark, sf):
    return cv.collapse(frames(spark, sf)).select("conv_id", "idx", "id", "role", F.md5("text").alias("text"))


PHRASES = {
    "user": " 请帮我生成PPT 关于Spark ", "assistant": "知识库里有哪些文档？分析一下 ", "system": "  写报告 最新 ",
}


def asked(spark, sf):
    """Turns behind intent phrases: one per role, none from the third turn on, blank for the last."""
    t = turns(spark, sf)
    phrase = F.lit("")
    for role, p in PHRASES.items():
        phrase = F.when(F.col("role") == role, p).otherwise(phrase)
    return t.select(
        "conv_id", "turn",
        F.when(F.col("turn") == 0, phrase).when(F.col("turn") == 1, F.concat(phrase, "text")).when(F.col("turn") == 5, " \n").otherwise(F.col("text")).alias("text"),
    )


_phrase = "case role " + " ".join(f"when '{r}' then '{p}'" for r, p in PHRASES.items()) + " else '' end"
_strip = "trim(text, ' ' || chr(10))"
for _w in fv.PPT_WORDS + fv.WORD_WORDS + fv.TITLE_NOISE_WORDS:
    _strip = f"regexp_replace({_strip}, '{_w}', '', 'gi')"
_any = lambda words: "(" + " or ".join(f"contains(low, {sql_str(w)})" for w in words) + ")"
_analysis = _any(fv.ANALYSIS_WORDS) + "".join(f" or regexp_matches(low, '{p}')" for p in [x.replace("\\n", chr(92) + "n") for x in fv.ANALYSIS_PATTERNS])


def routed(spark, sf):
    out = cv.route(asked(spark, sf))
    return out.select("conv_id", "turn", "doc_type", F.md5("doc_title").alias("doc_title"), "overview", "analysis", "search", "route")


QUERIES = {
    "m1_page": page(3, 0),
    "m1_page_offset": page(2, 1),
    "m2_list": listing,
    "m3_save_messages": saved_messages,
    "m3_save_parents": saved_parents,
    "m4_delete": deleted,
    "m5_titles": lambda spark, sf: cv.titles(turns(spark, sf)),
    "m6_collapse": collapsed,
    "m7_route": routed,
}


def page_sql(limit, offset):
    return f"""select conv_id, turn, role, md5(text) as text, cast(row_number() over (partition by conv_id order by turn) as integer) as ord from (
      select *, row_number() over (partition by conv_id order by turn desc) as r from conversations) where r > {offset} and r <= {offset + limit}"""


ORACLES = {
    "m1_page": page_sql(3, 0),
    "m1_page_offset": page_sql(2, 1),
    "m2_list": """select conv_id, 'Chat ' || conv_id as label, count(*) as ts, bool_or(role = 'system') as starred from conversations group by conv_id""",
    "m3_save_messages": """select conv_id || ':' || turn as id, conv_id,
        case when role = 'assistant' then 'helper' when role = 'user' and turn % 4 = 2 then null else role end as role,
        md5(case when role = 'assistant' then 'final ' || length(text) when role = 'user' and turn % 4 = 2 then 'gone' else text end) as text,
        case when role = 'assistant' then turn + 2000 when role = 'user' and turn % 4 = 2 then turn + 500 else turn end as ts from conversations
      union all select 'new:' || conv_id, -conv_id - 1, 'user', md5('hi'), 5 from conversations where turn = 0""",
    "m3_save_parents": """select conv_id, 'Chat ' || conv_id as label, coalesce(max(case when role = 'assistant' then turn + 2000 when role = 'user' and turn % 4 = 2 then turn + 500 end), count(*)) as ts from conversations group by conv_id
      union all select -conv_id - 1, '', 5 from conversations where turn = 0""",
    "m4_delete": """with g as (select distinct conv_id from conversations where role = 'system')
      select distinct conv_id, 'conversation' as part, '' as id from conversations where conv_id not in (select conv_id from g)
      union all select conv_id, 'message', conv_id || ':' || turn from conversations where conv_id not in (select conv_id from g)""",
    "m5_titles": """select conv_id, substr(trim(t, ' ' || chr(10)), 1, 20) || case when length(t) > 20 then '...' else '' end as title
      from (select conv_id, arg_min(text, turn) as t from conversations where role = 'user' group by 1)""",
    "m6_collapse": """with l as (select *, lag(role) over w as pr, lag(text) over w as pt from conversations window w as (partition by conv_id order by turn))
      select conv_id, turn * 4 + 2 as idx, turn || 'a' as id, role, md5(text) as text from l where not (role is not distinct from pr and text is not distinct from pt)""",
    "m7_route": f"""with a as (select conv_id, turn, case when turn = 0 then {_phrase} when turn = 1 then {_phrase} || text when turn = 5 then ' ' || chr(10) else text end as text from conversations),
      b as (select *, lower(trim(text, ' ' || chr(10))) as low, trim({_strip}, ' ' || chr(10)) as title from a),
      c as (select *, case when {_any(fv.PPT_WORDS)} then 'ppt' when {_any(fv.WORD_WORDS)} then 'word' end as doc_type,
        {_any(fv.OVERVIEW_SUBJECTS)} and {_any(fv.OVERVIEW_ASKS)} as overview, ({_analysis}) as analysis, {_any(fv.WEB_SEARCH_WORDS)} as search from b)
      select conv_id, turn, doc_type, md5(case when doc_type is not null then case when length(title) < 2 then case doc_type when 'ppt' then '演示文稿' else '文档报告' end else title end end) as doc_title,
        overview, analysis, search, case when low = '' then 'error' when doc_type is not null then 'document' when overview then 'overview' else 'answer' end as route from c""",
}
