"""Keyword retrieval queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslake.functions import fixed_values as fv
from corpuslake.functions.scale import materialise
from corpuslake.operators import blocks
from corpuslake.operators import lexical as lx
from corpuslake.plans.bindings.inputs import CORPUS, QUERIES_CTE, corpus, queries, sql_list, sql_str, table

# ---- SQL building blocks (the driver text holds no CJK, see FIXTURES.md)


def tokens_sql(expr: str) -> str:
    return (
        f"list_filter(list_concat(regexp_extract_all(lower({expr}), '[a-z][a-z0-9-]*'), "
        f"regexp_extract_all(lower({expr}), '[0-9]+')), "
        f"lambda t: length(t) > 1 and not list_contains({sql_list(fv.INDEX_STOP_WORDS)}, t))"
    )


INDEX = f"""{CORPUS}, {QUERIES_CTE},
doc_tokens as (select doc_id, {tokens_sql("text || ' ' || source")} as toks from corpus),
doc_len as (select doc_id, cast(len(toks) as bigint) as dl from doc_tokens),
stats as (select count(*) as n, sum(dl) / count(*) as avg_len from doc_len),
postings as (select doc_id, term, cast(count(*) as bigint) as tf
  from (select doc_id, unnest(toks) as term from doc_tokens) group by all),
terms as (select term, cast(count(*) as bigint) as df from postings group by term),
idf as (select term, df, ln((n - df + 0.5) / (df + 0.5) + 1) as idf from terms, stats)"""


def bm25_sql(name: str, query_cte: str, ids: str, k: int, partial: bool = False) -> str:
    """CTEs ``{name}`` (ids, doc_id, score, rank) over ``query_cte`` (ids, text)."""
    eff = (
        f"""{name}_hit as (select distinct q.term, p.doc_id from (select distinct term from {name}_q) q
          join terms v on contains(v.term, q.term) or contains(q.term, v.term)
          join postings p on p.term = v.term),
        {name}_tf as (select h.term, h.doc_id, coalesce(p.tf, 1) as tf from {name}_hit h
          left join postings p on p.term = h.term and p.doc_id = h.doc_id),"""
        if partial
        else f"{name}_tf as (select term, doc_id, tf from postings),"
    )
    return f"""{name}_q as (select {ids}, unnest({tokens_sql('text')}) as term from {query_cte}),
    {name}_qt as (select {ids}, term, count(*) as qtf from {name}_q group by all),
    {eff}
    {name}_s as (
      select {ids}, t.doc_id, sum(qtf * coalesce(idf, ln(n + 1)) * tf * {fv.BM25_K1 + 1}
        / (tf + {fv.BM25_K1} * (1 - {fv.BM25_B} + {fv.BM25_B} * dl / avg_len))) as score
      from {name}_qt q join {name}_tf t on t.term = q.term left join idf i on i.term = q.term
      join doc_len d on d.doc_id = t.doc_id, stats
      group by {ids}, t.doc_id),
    {name} as (select * from (select *, row_number() over (partition by {ids}
        order by round(score, 9) desc, doc_id) as rank from {name}_s where score > 0) z where rank <= {k})"""


def keywords_sql(expr: str) -> str:
    """SQL list expression of a query's keywords in order."""
    chars = "".join(c for c in fv.QUESTION_CHARS)
    words = "|".join(fv.QUESTION_WORDS)
    clean = (
        f"trim(regexp_replace(regexp_replace({expr}, '[{chars}]', ' ', 'g'), "
        f"'\\b(?:{words})\\b', ' ', 'gi'), chr(9) || chr(10) || chr(13) || ' ')"
    )
    parts = ["regexp_extract_all(c, '[a-zA-Z][a-zA-Z0-9_-]{1,24}')"]
    for term, aliases in fv.TERM_ALIASES.items():
        parts.append(f"case when contains(c, {sql_str(term)}) then {sql_list(aliases)} else [] end")
        for a in aliases:
            rest = [term] + [x for x in aliases if x != a]
            parts.append(f"case when contains(lower(c), {sql_str(a.lower())}) then {sql_list(rest)} else [] end")
    allkw = "flatten([" + ", ".join(parts) + "])"
    kept = (
        f"list_filter({allkw}, lambda w: length(w) >= 2 and not regexp_full_match(w, '[0-9]+') "
        f"and not list_contains({sql_list(fv.COMMON_KEYWORDS)}, lower(w)))"
    )
    distinct = f"list_filter(kw, lambda w, i: list_position(kw, w) = i)"
    return clean, kept, distinct


def keywords_cte(source: str, name: str = "kw", ids: str = "query_id") -> str:
    clean, kept, distinct = keywords_sql("text")
    return f"""{name}_c as (select {ids}, text, {clean} as c from {source}),
    {name}_k as (select {ids}, text, {kept} as kw from {name}_c),
    {name}_l as (select {ids}, text, {distinct} as kws from {name}_k),
    {name} as (select {ids}, unnest(kws) as keyword, cast(generate_subscripts(kws, 1) - 1 as integer) as ord from {name}_l)"""


def filename_sql(name: str, limit: str, kw: str = "kw") -> str:
    return f"""{name}_n as (select query_id, count(*) as n_kw from {kw} group by 1),
    {name}_h as (select k.query_id, c.doc_id,
        count(*) filter (contains(lower(string_split(source, '/')[-1]), lower(keyword))) as nh,
        count(*) filter (contains(lower(text), lower(keyword))) as th
      from {kw} k join corpus c on contains(lower(text), lower(keyword))
        or contains(lower(string_split(source, '/')[-1]), lower(keyword))
      group by 1, 2),
    {name}_t as (select h.query_id, doc_id, case when nh > 0 then 1
        when th >= ceil(n_kw * 0.5) and th >= 2 then 2 when th > 0 then 3 end as tier
      from {name}_h h join {name}_n n on n.query_id = h.query_id),
    {name} as (select query_id, doc_id, cast(tier as integer) as tier, rank from (select *, row_number() over
        (partition by query_id order by tier, doc_id) as rank from {name}_t where tier is not null)
      z where rank <= {limit})"""


VARIANTS_SQL = f"""{keywords_cte('queries')},
variants as (select query_id, 0 as ord, text from queries
  union all select query_id, ord + 1, keyword from kw)"""


def variants(spark, sf):
    """The query itself and each of its keywords."""
    q = queries(spark, sf)
    kw = lx.expand_keywords(q).select("query_id", (F.col("ord") + 1).alias("ord"), F.col("keyword").alias("text"))
    return q.select("query_id", F.lit(0).alias("ord"), "text").union(kw)


# ---- Spark side


def index_for(spark, sf, query_table):
    return blocks.ad_hoc(corpus(spark, sf), query_table)


def hits(spark, sf, k=20):
    """BM25 top ``k`` with score, the input of ranking and citation queries."""
    return lx.bm25_search(corpus(spark, sf), queries(spark, sf), k)


def tokens(spark, sf):
    return lx.tokenize(corpus(spark, sf)).groupBy("doc_id").agg(
        F.count("*").alias("n_tokens"),
        F.countDistinct("term").alias("n_terms"),
        F.min("term").alias("first_term"),
        F.max("term").alias("last_term"),
    )


def term_stats(spark, sf):
    ix = lx.build_index(corpus(spark, sf)).materialised()
    return ix.terms.select("term", "df", F.round("idf", 6).alias("idf"))


def doc_lengths(spark, sf):
    ix = lx.build_index(corpus(spark, sf)).materialised()
    avg_len = ix.stats.select("avg_len").scalar()
    return ix.docs.select("doc_id", "doc_len", F.round(F.col("doc_len") / avg_len, 6).alias("rel_len"))


def _scored(df):
    return df.withColumn("score", F.round("score", 5))


def bm25_topk(spark, sf):
    return _scored(hits(spark, sf, 10))


def bm25_partial(spark, sf):
    q = queries(spark, sf)
    return _scored(lx.bm25(blocks.build(corpus(spark, sf)), q, 10, partial=True))


def _stages(spark, sf):
    """The corpus in three deliveries: a first version of two thirds, all with a mark in the text; the rest; and the real texts in place of the marked."""
    docs = corpus(spark, sf).select("doc_id", "text", "source")
    marked = docs.withColumn("text", F.concat("text", F.lit(" earlier version of this file")))
    return marked.where("doc_id % 3 <> 0"), docs.where("doc_id % 3 = 0"), docs.where("doc_id % 3 <> 0")


def refreshed_index(spark, sf):
    """An index that followed the deliveries by delta segments, and forgot the extra documents of the first one."""
    first, second, third = _stages(spark, sf)
    extra = table(spark, sf, "benchmark").select((-1 - F.col("item_id")).alias("doc_id"), "text", F.lit("bench").alias("source"))
    index = blocks.build(first.union(extra))
    return index.refresh(second).refresh(third, deletes=extra.select("doc_id"))


def bm25_refreshed(spark, sf):
    """Search over the segments: as over an index built anew."""
    return _scored(lx.bm25(refreshed_index(spark, sf), queries(spark, sf), 10))


def statistics_refreshed(spark, sf):
    """Statistics over the segments, and after the merge: both are those of an index built anew."""
    index = refreshed_index(spark, sf)
    both = index.terms.withColumn("state", F.lit("segments")).unionByName(index.merge().terms.withColumn("state", F.lit("merged")))
    return both.select("state", "term", "df", F.round("idf", 6).alias("idf"))


def bm25_multi(spark, sf):
    v = materialise(variants(spark, sf), "variants")
    return _scored(lx.bm25_multi(index_for(spark, sf, v), v, corpus(spark, sf), 10))


def keyword_expansion(spark, sf):
    return lx.expand_keywords(queries(spark, sf))


def named(spark, sf):
    """The corpus under file names that hold the first Latin word of the text, so that keywords meet names."""
    word = F.regexp_extract("text", "[a-zA-Z]+", 0)
    name = F.concat("folder", F.lit("/"), word, F.lit("-"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return corpus(spark, sf).withColumn("source", name)


NAMED = """corpus as (select doc_id, text, source || '/' || regexp_extract(text, '[a-zA-Z]+', 0) || '-' || doc_id || '.txt' as source,
  lang, source as folder, n_chars from documents)"""


def filename_search(spark, sf):
    kw = materialise(lx.expand_keywords(queries(spark, sf)), "keywords")
    return lx.filename_search(named(spark, sf), kw, 20)


def matched_keywords(spark, sf):
    return lx.matched_keywords(named(spark, sf), lx.expand_keywords(queries(spark, sf)))


def coverage(spark, sf):
    h = hits(spark, sf, 20).select("query_id", "doc_id")
    pairs = (
        corpus(spark, sf).select("doc_id", "text").join(h, "doc_id")
        .join(queries(spark, sf).withColumnRenamed("text", "query_text"), "query_id")
    )
    return lx.coverage(pairs).select(
        "query_id", "doc_id", F.round("match_score", 6).alias("match_score"), "relevant",
        F.array_join("matched_terms", "|").alias("matched_terms"),
    )


QUERIES = {
    "l1_tokenize": tokens,
    "l2_term_statistics": term_stats,
    "l2_document_lengths": doc_lengths,
    "l3_bm25_topk": bm25_topk,
    "l2_refreshed_statistics": statistics_refreshed,
    "l3_bm25_refreshed": bm25_refreshed,
    "l4_bm25_partial": bm25_partial,
    "l5_bm25_multi": bm25_multi,
    "l6_expand_keywords": keyword_expansion,
    "l7_filename_search": filename_search,
    "l7_matched_keywords": matched_keywords,
    "l8_coverage": coverage,
}

ORACLES = {
    "l1_tokenize": f"""with {CORPUS}, t as (select doc_id, unnest({tokens_sql('text')}) as term from corpus)
      select doc_id, count(*) as n_tokens, count(distinct term) as n_terms, min(term) as first_term,
        max(term) as last_term from t group by doc_id""",
    "l2_term_statistics": f"with {INDEX} select term, df, round(idf, 6) as idf from idf",
    "l2_document_lengths": f"with {INDEX} select doc_id, dl as doc_len, round(dl / avg_len, 6) as rel_len from doc_len, stats",
    "l3_bm25_topk": f"with {INDEX}, {bm25_sql('h', 'queries', 'query_id', 10)} "
    "select query_id, doc_id, round(score, 5) as score, rank from h",
    "l2_refreshed_statistics": f"with {INDEX} select unnest(['segments', 'merged']) as state, term, df, round(idf, 6) as idf from idf",
    "l3_bm25_refreshed": f"with {INDEX}, {bm25_sql('h', 'queries', 'query_id', 10)} "
    "select query_id, doc_id, round(score, 5) as score, rank from h",
    "l4_bm25_partial": f"with {INDEX}, {bm25_sql('h', 'queries', 'query_id', 10, partial=True)} "
    "select query_id, doc_id, round(score, 5) as score, rank from h",
    "l5_bm25_multi": f"""with {INDEX}, {VARIANTS_SQL}, {bm25_sql('h', 'variants', 'query_id, ord', 10)},
      best as (select query_id, md5(text) as k, arg_max({{'d': h.doc_id, 's': score}},
          (round(score, 9), -ord, -rank)) as b from h join corpus c on c.doc_id = h.doc_id group by 1, 2)
      select query_id, b.d as doc_id, round(b.s, 5) as score, rank from (select query_id, b, row_number() over
        (partition by query_id order by round(b.s, 9) desc, b.d) as rank from best) where rank <= 10""",
    "l6_expand_keywords": f"with {QUERIES_CTE}, {keywords_cte('queries')} select query_id, ord, keyword from kw",
    "l7_filename_search": f"with {NAMED}, {QUERIES_CTE}, {keywords_cte('queries')}, {filename_sql('f', '20')} select * from f",
    "l7_matched_keywords": f"""with {NAMED}, {QUERIES_CTE}, {keywords_cte('queries')}
      select distinct query_id, keyword from kw where exists (select 1 from corpus
        where contains(lower(string_split(source, '/')[-1]), lower(keyword)))""",
    "l8_coverage": f"""with {INDEX}, {bm25_sql('h', 'queries', 'query_id', 20)}, {keywords_cte('queries')},
      p as (select h.query_id, h.doc_id, lower(c.text) as low, k.kws, lower(k.text) as ql
        from h join corpus c on c.doc_id = h.doc_id join kw_l k on k.query_id = h.query_id),
      m as (select *, list_filter(kws, lambda w: contains(low, lower(w))) as mt,
        len(list_filter(regexp_split_to_array(ql, '\\s+'), lambda w: length(w) > 2 and contains(low, w))) > 0 as wh from p)
      select query_id, doc_id, round(case when len(kws) = 0 then 0.5 else len(mt) / len(kws) end, 6) as match_score,
        len(kws) = 0 or len(mt) > 0 or wh as relevant, array_to_string(mt, '|') as matched_terms from m""",
}
