"""Hybrid search: query variants, adaptive search and BM25 for each, fusion, minimum score, re-ranking."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslake.functions import fixed_values as fv
from corpuslake.functions.scale import materialise
from corpuslake.operators import blocks
from corpuslake.operators import lexical as lx
from corpuslake.operators import ranking as rk
from corpuslake.plans.search import SearchConfig, search


def hybrid_search(
    docs: DataFrame,
    queries: DataFrame,
    limit: int = 10,
    cfg: SearchConfig = SearchConfig(),
    min_score: float = 0.0,
    k: int = fv.RERANK_TOP_K,
    index: blocks.BlockIndex | lx.KeywordIndex | None = None,
    scorer: Column | None = None,
    rules=None,
    suffixes=None,
) -> DataFrame:
    """(query_id, doc_id, new_rank, kinds, score): the first ``k`` of each query after re-ranking.

    Every variant of a query runs the adaptive search and BM25, both over one (stored)
    index; lists are fused by rank over documents of equal source and text, rows below
    ``min_score`` drop out, and ``scorer``, a column over query_text and text
    (default: the share of the query's keywords found), decides the final order.
    """
    forms = rk.query_variants(queries, rules, suffixes)
    forms = materialise(forms.withColumn("form", F.monotonically_increasing_id()), "forms")
    asked = forms.select(F.col("form").alias("query_id"), F.col("variant").alias("text"))
    if cfg.tags:
        docs = docs.where(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in cfg.tags])))
    keep = docs.select("doc_id") if cfg.tags and index is not None else None
    if index is None:
        index, cfg = blocks.build(docs), replace(cfg, tags=())
    found = search(docs, asked, cfg, index=index).select("query_id", F.lit("vector").alias("kind"), "doc_id", "rank")
    words = lx.bm25(index, asked, limit, keep=keep).select("query_id", F.lit("keyword").alias("kind"), "doc_id", "rank")
    lists = found.unionByName(words).withColumnRenamed("query_id", "form").join(forms.drop("variant"), "form")
    lists = lists.select("query_id", "kind", F.col("ord").alias("variant"), "doc_id", "rank")
    fused = materialise(rk.hybrid(lists, docs, limit, cfg.rrf_k, min_score), "fused")
    pairs = fused.join(docs.select("doc_id", "text"), "doc_id").join(
        queries.select("query_id", F.col("text").alias("query_text")), "query_id"
    )
    scored = lx.coverage(pairs)
    best = rk.rerank(scored, F.col("match_score") if scorer is None else scorer, k)
    return best.select("query_id", "doc_id", "new_rank", "kinds", "score")
