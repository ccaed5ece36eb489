"""Fusion, threshold, diversification, re-ranking, planning and full search queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslake.functions import fixed_values as fv
from corpuslake.functions.scale import materialise
from corpuslake.operators import blocks
from corpuslake.operators import lexical as lx
from corpuslake.operators import ranking as rk
from corpuslake.plans.bindings.inputs import (
    CORPUS, QUERIES_CTE, USER_QUERIES_CTE, corpus, queries, sql_str, table, user_queries,
)
from corpuslake.plans.bindings.lexical import (
    INDEX, VARIANTS_SQL, bm25_sql, filename_sql, hits, keywords_cte,
)
from corpuslake.plans.bindings.vectors import vector_list, vector_list_sql
from corpuslake.plans.hybrid import hybrid_search
from corpuslake.plans.ingest import ingest
from corpuslake.plans.search import SearchConfig, search

N = 20


def three_lists(spark, sf):
    """(query_id, list, key, rank, distance) from vector, BM25 and file-name search."""
    q = queries(spark, sf)
    kw = materialise(lx.expand_keywords(q), "keywords")
    vec = vector_list(spark, sf, N).select("query_id", F.lit("vector").alias("list"), F.col("doc_id").alias("key"), "rank", "distance")
    bm = hits(spark, sf, N).select("query_id", F.lit("bm25").alias("list"), F.col("doc_id").alias("key"), "rank", (1 / (F.col("score") + 1)).alias("distance"))
    fn = lx.filename_search(corpus(spark, sf), kw, N).select("query_id", F.lit("filename").alias("list"), F.col("doc_id").alias("key"), "rank", F.lit(0.0).alias("distance"))
    return vec.union(bm).union(fn)


LISTS_SQL = f"""{INDEX}, {bm25_sql('h', 'queries', 'query_id', N)}, {keywords_cte('queries')},
{filename_sql('fn', str(N))}, {vector_list_sql('vl', str(N))},
lists as (select query_id, 'vector' as list, 0 as prio, doc_id as key, rank, distance from vl
  union all select query_id, 'bm25', 1, doc_id, rank, 1 / (score + 1) from h
  union all select query_id, 'filename', 2, doc_id, rank, 0.0 from fn)"""


def relevance_hits(spark, sf, k=N):
    """BM25 hits with score / best score, text and source."""
    h = hits(spark, sf, k)
    top = F.max("score").over(rk.per_query())
    rel = h.withColumn("score", F.round(F.col("score") / top, 9))
    return corpus(spark, sf).select("doc_id", "text", "source", "folder").join(rel, "doc_id")


HITS_SQL = f"""{INDEX}, {bm25_sql('h', 'queries', 'query_id', N)},
rel as (select h.query_id, h.doc_id, h.rank, c.text, c.source, c.folder,
  round(h.score / max(h.score) over (partition by h.query_id), 9) as score
  from h join corpus c on c.doc_id = h.doc_id)"""


def rrf(spark, sf):
    out = rk.rrf(three_lists(spark, sf))
    return out.select("query_id", "key", F.round("score", 6).alias("score"), "rank")


def fuse(spark, sf):
    out = rk.fuse_scores(three_lists(spark, sf))
    cols = [F.round(c, 6).alias(c) for c in ("rrf_score", "distance", "score")]
    return out.select("query_id", "key", "rank", *cols)


def threshold(spark, sf):
    return rk.threshold(relevance_hits(spark, sf), 0.9).select("query_id", "doc_id", F.round("score", 6).alias("score"))


def scopes(spark, sf):
    """Scope of a query: every path of the folder named by its number, given as bare file names, or none."""
    q = queries(spark, sf).select("query_id", F.concat(F.lit("src"), (F.col("query_id") % 25).cast("string")).alias("folder"))
    f = corpus(spark, sf).select("folder", "source")
    return q.join(f, "folder").select("query_id", F.concat(F.lit(" C:\\Docs\\"), F.upper("source")).alias("path"))


SCOPES_SQL = """scopes as (select query_id, ' C:\\Docs\\' || upper(source) as path from queries
  join corpus on folder = 'src' || (query_id % 25))"""


def scope_filter(spark, sf):
    s = materialise(scopes(spark, sf), "scopes")
    return rk.scope_filter(relevance_hits(spark, sf), s).select("query_id", "doc_id", "source")


def words_sql(expr: str) -> str:
    return f"list_distinct(list_filter(regexp_split_to_array(lower({expr}), '\\s+'), lambda w: length(w) > 1))"


def mmr_sql(name: str, source: str, k: int, lam: str, need: str, extra: str = "") -> str:
    """CTEs: ``k`` greedy picks over ``source`` (query_id, doc_id, rank, score, text)."""
    out = f"""{name}_0 as (select *, {words_sql('text')} as w, count(*) over (partition by query_id) as n,
      row_number() over (partition by query_id order by rank) as in_order,
      cast(null as integer) as picked, cast(0 as double) as sim from {source})"""
    for t in range(1, k + 1):
        key = (
            "{'s': round(score, 9), 'o': rank}" if t == 1
            else f"{{'s': round({lam} * score - (1 - {lam}) * sim, 9), 'o': -rank}}"
        )
        out += f""",
    {name}_b{t} as (select query_id, arg_max(rank, {key}) as p, arg_max(w, {key}) as bw from {name}_{t - 1}
      where picked is null group by query_id),
    {name}_{t} as (select a.* exclude (picked, sim),
      case when picked is null and rank = p then {t} else picked end as picked,
      greatest(sim, case when len(w) + len(bw) - len(list_intersect(w, bw)) > 0
        then len(list_intersect(w, bw)) / (len(w) + len(bw) - len(list_intersect(w, bw))) else 0 end) as sim
      from {name}_{t - 1} a left join {name}_b{t} b on b.query_id = a.query_id)"""
    out += f""",
    {name} as (select *, case when n <= {need} then in_order else picked end as mmr_rank from {name}_{k}
      where n <= {need} or picked is not null)"""
    return out


def mmr(spark, sf):
    return rk.mmr(relevance_hits(spark, sf), 8).select("query_id", "doc_id", F.col("mmr_rank").cast("long").alias("mmr_rank"))


def diversify(spark, sf):
    h = relevance_hits(spark, sf).drop("source").withColumnRenamed("folder", "source")
    return rk.diversify(h, 8).select("query_id", "doc_id", "source", "div_rank")


def hybrid(spark, sf):
    lists = (
        vector_list(spark, sf, 10).select("query_id", F.lit("vector").alias("kind"), F.lit(0).alias("variant"), "doc_id", "rank")
        .union(hits(spark, sf, 10).select("query_id", F.lit("keyword"), F.lit(0), "doc_id", "rank"))
    )
    out = rk.hybrid(lists, corpus(spark, sf), 10)
    return out.select("query_id", "doc_id", "rank", "kinds", F.round("score", 6).alias("score"))


def rerank(spark, sf):
    h = relevance_hits(spark, sf).join(
        queries(spark, sf).withColumnRenamed("text", "query_text"), "query_id"
    )
    scored = lx.coverage(h)
    return rk.rerank(scored, F.col("match_score")).select(
        "query_id", "doc_id", "new_rank", F.round("rerank_score", 6).alias("rerank_score")
    )


def all_queries(spark, sf):
    return user_queries(spark, sf)


def plan(spark, sf):
    out = rk.query_plan(all_queries(spark, sf))
    return out.select("query_id", "intent", "k", "fetch_k", F.round("complexity", 6).alias("complexity"))


def plan_sql(source: str, k: int = fv.DEFAULT_K) -> str:
    """CTE ``plan`` over ``source`` (query_id, text)."""
    def any_of(words):
        return " or ".join(f"contains(lower(text), {sql_str(w)})" for w in words)

    return f"""plan0 as (select *,
      least(1, 0.4 * least(1, length(text) / 200) + 0.3 * least(1, len(list_filter(ws, lambda w: w <> '')) / 30)
        + 0.2 * least(1, len(list_distinct(list_filter(lw, lambda w: w <> ''))) / 30)
        + 0.1 * least(1, (length(text) - length(regexp_replace(text, '[，。？！?,.!;:]', '', 'g'))) / 10)) as complexity,
      case when {any_of(fv.DEFINITION_WORDS)} then 'definition' when {any_of(fv.SUMMARY_WORDS)} then 'summary'
        when {any_of(fv.COMPARISON_WORDS)} then 'comparison' else 'other' end as intent
      from (select *, regexp_split_to_array(text, '\\s+') as ws, regexp_split_to_array(lower(text), '\\s+') as lw from {source})),
    plan1 as (select *, case intent when 'definition' then greatest(3, floor({k} * 0.8 + 0.5))
      when 'summary' then floor({k} * 1.5 + 0.5) when 'comparison' then floor({k} * 1.6 + 0.5) else {k} end as base from plan0),
    plan2 as (select *, cast(least({fv.MAX_K}, greatest(base, floor(base + complexity * {fv.DEFAULT_K} + 0.5))) as bigint) as k from plan1),
    plan as (select *, cast(floor(greatest(greatest(k * {fv.GLOBAL_FETCH_FACTOR}, {fv.MAX_FETCH_K}), k * 10) * (1 + complexity * 0.5) + 0.5) as bigint) as fetch_k
      from plan2)"""


def variants(spark, sf):
    return rk.query_variants(all_queries(spark, sf))


def search_lexical(spark, sf):
    cfg = SearchConfig(vector=False, partial=False)
    return search(corpus(spark, sf), queries(spark, sf), cfg).withColumn("score", F.round("score", 6))


def search_full(spark, sf):
    return search(corpus(spark, sf), queries(spark, sf)).withColumn("score", F.round("score", 6))


def search_scoped(spark, sf):
    """Every query limited to the files of one folder (or, for a missing folder, to nothing: global)."""
    s = materialise(scopes(spark, sf).withColumn("path", F.substring("path", 10, 1000)), "scopes")
    cfg = SearchConfig(partial=False)
    return search(corpus(spark, sf), queries(spark, sf), cfg, s).withColumn("score", F.round("score", 6))


def stored_tables(spark, sf):
    """Chunks with vectors and tags, stored, and their stored index."""
    docs = corpus(spark, sf)
    chunks = ingest(docs.select("doc_id", "text", "source"), "fixed", gate=False)
    tags = docs.select("source", F.array("lang").alias("tags"))
    number = F.regexp_extract("source", r"/([0-9]+)\.txt$", 1).cast("long") * 1_000_000 + F.col("chunk_index")
    rows = chunks.join(tags, "source").select(number.alias("doc_id"), "text", "source", "embedding", "tags")
    rows = materialise(rows, "chunks")
    return rows, blocks.build(rows)


def search_stored(spark, sf, ready=None):
    """The search reads stored chunks, vectors and index (``ready``, or made here) and keeps two tags."""
    rows, index = ready or stored_tables(spark, sf)
    cfg = SearchConfig(partial=False, tags=("fr", "de"))
    return search(rows, queries(spark, sf), cfg, index=index).withColumn("score", F.round("score", 6))


def hybrid_job(spark, sf):
    """Variants, adaptive and keyword search, fusion, least score and re-ranking end to end."""
    cfg = SearchConfig(partial=False)
    out = hybrid_search(corpus(spark, sf), queries(spark, sf), 10, cfg, min_score=0.018)
    return out.withColumn("score", F.round("score", 6))


CHUNK_CORPUS = """corpus as (
  select doc_id * 1000000 + i as doc_id, substr(text, i * 2000 + 1, 2000) as text, source || '/' || doc_id || '.txt' as source, lang, source as folder, n_chars
  from (select *, unnest(range(cast(ceil(length(text) / 2000) as bigint))) as i from documents where lang in ('fr', 'de')))"""


def search_sql(vector: bool, partial: bool, scoped: bool = False) -> str:
    """The search in SQL; with ``scoped`` a query that has paths is compared with the vectors inside them only."""
    deep = "(select fetch_k from plan p where p.query_id = z.query_id)"
    wide = "(select * from queries where query_id not in (select query_id from scoped))" if scoped else "queries"
    vec_cte = f"{vector_list_sql('vl0', deep)}, vl as (select * from vl0)," if vector else ""
    plan_ctes, scope_ctes = plan_sql("queries"), ""
    if scoped:
        scope_ctes = f"""{SCOPES_SQL}, scoped as (select distinct query_id from scopes),
          wide as {wide},"""
        vec_cte = f"""{vector_list_sql('vl0', deep)},
          inside as (select distinct s.query_id, c.doc_id from (select distinct query_id, lower(replace(trim(path), '\\', '/')) as p from scopes) s
            join corpus c on lower(c.source) = replace(s.p, 'c:/docs/', '')),
          in_d as (select i.query_id, i.doc_id, round(1 - coalesce(dot, 0), 9) as distance from inside i left join
            (select q.query_id, d.doc_id, sum(q.v * d.v) as dot from vl0_q q join vl0_d d on d.cell = q.cell group by 1, 2) x
            on x.query_id = i.query_id and x.doc_id = i.doc_id),
          vl as (select query_id, doc_id, distance, rank from vl0 where query_id not in (select query_id from scoped)
            union all select query_id, doc_id, distance, rank from (select *, row_number() over (partition by query_id order by distance, doc_id) as rank
              from in_d) z where rank <= {deep}),"""
        plan_ctes = plan_ctes.replace("plan as (select *,", "plan_all as (select *,") + f""",
          plan as (select * exclude (fetch_k), case when query_id in (select query_id from scoped)
            then cast(floor(greatest(greatest(k * {fv.SCOPED_FETCH_FACTOR}, {fv.MIN_FETCH_K}), k * 10) * (1 + complexity * 0.5) + 0.5) as bigint)
            else fetch_k end as fetch_k from plan_all)"""
    asked = "wide" if scoped else "queries"
    variants_sql = VARIANTS_SQL.replace("from queries", f"from {asked}")
    vec_list = "select query_id, 'vector' as list, 0 as prio, doc_id as key, rank, distance from vl union all" if vector else ""
    return f"""with {INDEX}, {scope_ctes} {plan_ctes}, {variants_sql}, {bm25_sql('h', 'variants', 'query_id, ord', deep, partial)},
      best as (select query_id, md5(text) as tk, arg_max({{'d': h.doc_id, 's': score}}, (round(score, 9), -ord, -rank)) as b
        from h join corpus c on c.doc_id = h.doc_id group by 1, 2),
      bl as (select query_id, b.d as doc_id, b.s as score, rank from (select *, row_number() over
        (partition by query_id order by round(b.s, 9) desc, b.d) as rank from best) z where rank <= {deep}),
      {filename_sql('fn', deep)}, {vec_cte}
      lists0 as ({vec_list} select query_id, 'bm25' as list, 1 as prio, doc_id as key, rank, 1 / (score + 1) as distance from bl
        union all select query_id, 'filename', 2, doc_id, rank, 0.0 from fn),
      lists as (select l.query_id, list, prio, rank, distance, min(key) over (partition by l.query_id, md5(source || '::' || text)) as key
        from lists0 l join corpus c on c.doc_id = l.key),
      f as (select query_id, key, sum((case list when 'filename' then 2.0 else 1.0 end) / (50 + rank)) as s,
        min(prio * 1000000 + rank) as seen, min(distance) as own from lists group by 1, 2),
      g as (select query_id, sum(distinct case list when 'filename' then 20 when 'bm25' then 1 else 1.5 end) as kinds from lists group by 1),
      m as (select f.*, max(s) over (partition by f.query_id) as hi, min(s) over (partition by f.query_id) as lo, kinds
        from f join g on g.query_id = f.query_id),
      d as (select query_id, key, seen, case when kinds in (1, 1.5) then own
        else (1 - (s - lo) / (case when hi = lo then 1.0 else hi - lo end)) * 0.8 end as distance from m),
      r as (select query_id, key, 1 / (1 + distance) as score, row_number() over (partition by query_id order by round(distance, 9), seen, key) as rank from d),
      z1 as (select z.*, p.k as adaptive_k, case when intent in ('summary', 'comparison') then 0.6 else 0.7 end as lam
        from r z join plan p on p.query_id = z.query_id where rank <= p.fetch_k),
      th0 as (select *, count(*) filter (score >= 0.25) over (partition by query_id) as hi3, count(*) filter (score >= 0.05) over (partition by query_id) as lo3,
        count(*) over (partition by query_id) as n3, row_number() over (partition by query_id order by round(score, 9) desc, rank) as r3 from z1),
      th as (select query_id, key as doc_id, score, rank, adaptive_k, lam, text from th0 join corpus on corpus.doc_id = key
        where case when hi3 >= 3 then score >= 0.25 when lo3 >= 2 then score >= 0.05 else r3 <= greatest(5, ceil(n3 * 0.3)) end),
      {mmr_sql('mm', 'th', fv.DEFAULT_K, 'lam', 'adaptive_k')}
      select query_id, doc_id, round(score, 6) as score, cast(mmr_rank as bigint) as rank from mm where mmr_rank <= least({fv.DEFAULT_K}, adaptive_k)"""


QUERIES = {
    "r1_rrf": rrf,
    "r2_fuse_scores": fuse,
    "r3_threshold": threshold,
    "r4_scope_filter": scope_filter,
    "r5_mmr": mmr,
    "r6_diversify": diversify,
    "r7_hybrid": hybrid,
    "r8_rerank": rerank,
    "r9_query_plan": plan,
    "r10_query_variants": variants,
    "r11_search_lexical": search_lexical,
    "r11_search": search_full,
    "r11_search_scoped": search_scoped,
    "r11_search_stored": search_stored,
    "r7_hybrid_job": hybrid_job,
}

ORACLES = {
    "r1_rrf": f"""with {LISTS_SQL}, f as (select query_id, key, sum(1.0 / (60 + rank)) as score, min((list, rank)) as seen
        from lists group by 1, 2)
      select query_id, key, round(score, 6) as score, row_number() over
        (partition by query_id order by round(score, 9) desc, seen, key) as rank from f""",
    "r2_fuse_scores": f"""with {LISTS_SQL},
      f as (select query_id, key, sum((case list when 'filename' then 2.0 else 1.0 end) / (50 + rank)) as s,
        min(prio * 1000000 + rank) as seen, min(distance) as own from lists group by 1, 2),
      g as (select query_id, sum(distinct case list when 'filename' then 20 when 'bm25' then 1 else 1.5 end) as kinds from lists group by 1),
      m as (select f.*, max(s) over (partition by f.query_id) as hi, min(s) over (partition by f.query_id) as lo, kinds
        from f join g on g.query_id = f.query_id),
      d as (select query_id, key, seen, s, case when kinds in (1, 1.5) then own
        else (1 - (s - lo) / (case when hi = lo then 1.0 else hi - lo end)) * 0.8 end as distance from m)
      select query_id, key, round(s, 6) as rrf_score, round(distance, 6) as distance, round(1 / (1 + distance), 6) as score,
        row_number() over (partition by query_id order by round(distance, 9), seen, key) as rank from d""",
    "r3_threshold": f"""with {HITS_SQL}, c as (select *, count(*) filter (score >= 0.9) over (partition by query_id) as hi,
        count(*) filter (score >= 0.05) over (partition by query_id) as lo, count(*) over (partition by query_id) as n,
        row_number() over (partition by query_id order by score desc, rank) as r from rel)
      select query_id, doc_id, round(score, 6) as score from c where case when hi >= 3 then score >= 0.9
        when lo >= 2 then score >= 0.05 else r <= greatest(5, ceil(n * 0.3)) end""",
    "r4_scope_filter": f"""with {HITS_SQL}, {SCOPES_SQL},
      p as (select distinct query_id, lower(replace(trim(path), '\\', '/')) as p from scopes),
      n as (select query_id, count(*) as n from p group by 1)
      select query_id, doc_id, source from rel r where not exists (select 1 from n where n.query_id = r.query_id)
        or exists (select 1 from p join n on n.query_id = p.query_id where p.query_id = r.query_id
          and (ends_with(p.p, lower(source)) or ends_with(lower(source), p.p)))""",
    "r5_mmr": f"""with {HITS_SQL}, {mmr_sql('m', 'rel', 8, '0.7', '8')}
      select query_id, doc_id, cast(mmr_rank as bigint) as mmr_rank from m""",
    "r6_diversify": f"""with {HITS_SQL}, t as (select query_id, doc_id, folder as source,
        row_number() over (partition by query_id, folder order by score desc, rank) as turn,
        min(rank) over (partition by query_id, folder) as first from rel)
      select * from (select query_id, doc_id, source, row_number() over (partition by query_id order by turn, first) as div_rank from t)
      where div_rank <= 8""",
    "r7_hybrid": f"""with {INDEX}, {bm25_sql('h', 'queries', 'query_id', 10)}, {vector_list_sql('vl', '10')},
      l as (select query_id, 'vector' as kind, 0 as p, doc_id, rank from vl
        union all select query_id, 'keyword', 1, doc_id, rank from h),
      f as (select l.query_id, md5(source || ':' || text) as k, sum(1.0 / (50 + rank)) as score,
        string_agg(distinct kind, ',' order by kind desc) as kinds, min((p, rank, l.doc_id)) as seen
        from l join corpus c on c.doc_id = l.doc_id group by 1, 2)
      select query_id, seen[3] as doc_id, rank, kinds, round(score, 6) as score from (select *, row_number() over
        (partition by query_id order by round(score, 9) desc, seen) as rank from f) where rank <= 20""",
    "r7_hybrid_job": f"""with s as ({search_sql(vector=True, partial=False)}), {INDEX}, {bm25_sql('h', 'queries', 'query_id', 10)}, {keywords_cte('queries')},
      l as (select query_id, 'vector' as kind, 0 as p, doc_id, rank from s
        union all select query_id, 'keyword', 1, doc_id, rank from h where query_id in (select query_id from s)),
      f as (select l.query_id, md5(source || ':' || text) as k, sum(1.0 / (50 + rank)) as score,
        string_agg(distinct kind, ',' order by kind desc) as kinds, min((p, rank, l.doc_id)) as seen
        from l join corpus c on c.doc_id = l.doc_id group by 1, 2),
      t as (select query_id, seen[3] as doc_id, rank, kinds, score from (select *, row_number() over
        (partition by query_id order by round(score, 9) desc, seen) as rank from f) where rank <= 20 and score >= 0.018),
      r as (select t.*, case when len(kws) = 0 then 0.5 else
        len(list_filter(kws, lambda w: contains(lower(c.text), lower(w)))) / len(kws) end as m
        from t join corpus c on c.doc_id = t.doc_id join kw_l k on k.query_id = t.query_id)
      select query_id, doc_id, new_rank, kinds, round(score, 6) as score from (select *, row_number() over
        (partition by query_id order by round(m, 9) desc, rank) as new_rank from r) where new_rank <= 6""",
    "r8_rerank": f"""with {HITS_SQL}, {keywords_cte('queries')},
      s as (select r.query_id, r.doc_id, r.rank, case when len(kws) = 0 then 0.5 else
        len(list_filter(kws, lambda w: contains(lower(r.text), lower(w)))) / len(kws) end as s
        from rel r join kw_l k on k.query_id = r.query_id)
      select query_id, doc_id, new_rank, round(s, 6) as rerank_score from (select *, row_number() over
        (partition by query_id order by round(s, 9) desc, rank) as new_rank from s) where new_rank <= 6""",
    "r9_query_plan": f"""with {USER_QUERIES_CTE}, {plan_sql('user_queries')}
      select query_id, intent, k, fetch_k, round(complexity, 6) as complexity from plan""",
    "r10_query_variants": f"""with {USER_QUERIES_CTE},
      v as (select query_id, list_concat([text], case when length(text) < 10 then
        [text || ' 管理', text || ' 系统', text || ' 方案'] else [] end) as vs from user_queries)
      select query_id, cast(generate_subscripts(vs, 1) - 1 as integer) as ord, unnest(vs) as variant from v""",
    "r11_search_lexical": search_sql(vector=False, partial=False),
    "r11_search": search_sql(vector=True, partial=True),
    "r11_search_scoped": search_sql(vector=True, partial=False, scoped=True),
    "r11_search_stored": search_sql(vector=True, partial=False).replace(CORPUS, CHUNK_CORPUS),
}
