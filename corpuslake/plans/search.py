"""Adaptive search: planning, three retrieval lists, fusion, threshold, diversification."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslake.functions import fixed_values as fv
from corpuslake.functions.scale import broadcast_if_small, discard, hint_small, is_small, materialise
from corpuslake.functions.text import norm_path
from corpuslake.functions.vectors import cosine
from corpuslake.operators import blocks
from corpuslake.operators import lexical as lx
from corpuslake.operators import ranking as rk
from corpuslake.operators import vectors as vx


@dataclass(frozen=True)
class SearchConfig:
    k: int = fv.DEFAULT_K
    vector: bool = True
    partial: bool = True  # substring matches in the keyword search
    encoder: object = None
    min_relevance: float = fv.RELEVANCE_THRESHOLD
    mmr_lambda: float = fv.MMR_LAMBDA
    rrf_k: int = fv.RRF_K
    max_keywords: int | None = None  # how many keywords become BM25 variants of their own; None: all
    tags: tuple[str, ...] = ()  # only documents with one of these (column ``tags``)


def search(
    docs: DataFrame,
    queries: DataFrame,
    cfg: SearchConfig = SearchConfig(),
    scopes: DataFrame | None = None,
    index: blocks.BlockIndex | lx.KeywordIndex | None = None,
) -> DataFrame:
    """(query_id, doc_id, score, rank) for a table of queries, min(k, adaptive k) rows each at most.

    ``docs``: doc_id, text, source[, embedding][, tags]; stored vectors are in
    ``embedding``. ``index``: a stored keyword index over these documents; else one is
    made for this call. ``scopes``: query_id, path; a
    query with a scope searches vectors inside it only, any other runs keyword,
    file-name and vector search over everything. Empty lists drop out of the
    fusion. Each list is cut to the query's own fetch depth before it is shuffled; up to the
    last step only ids and scores are carried, then the kept hits' word sets are joined.
    """
    if cfg.tags:
        docs = docs.where(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in cfg.tags])))
    # a stored index covers all documents: those with the tags are marked shard by shard after its terms are picked
    keep = docs.select("doc_id") if cfg.tags and index is not None else None
    plan = _plan(queries, cfg, scopes)
    wide = plan.where("is_global").select("query_id", "text", "fetch_k")
    kw = materialise(lx.expand_keywords(wide), "keywords")
    lists = _bm25_list(docs, wide, kw, cfg, index, keep).unionByName(_name_list(docs, wide, kw))
    if cfg.vector:
        lists = lists.unionByName(_vector_list(docs, plan, cfg, scopes))
    lists = materialise(lists, "lists")
    found = materialise(_hit_docs(docs, lists), "found")
    small = is_small(found)  # else Spark goes by the files' size and may broadcast the lists
    fused = rk.fuse_scores(_by_content(found, lists, small), rrf_k=cfg.rrf_k, limit=plan)
    hits = fused.withColumnRenamed("key", "doc_id").join(hint_small(found.select("doc_id", "source"), small), "doc_id")
    if scopes is not None:
        hits = rk.scope_filter(hits, scopes)
    kept = materialise(rk.threshold(hits, cfg.min_relevance), "kept")
    return _select(docs, kept, plan, cfg)


def _plan(queries, cfg, scopes) -> DataFrame:
    if scopes is None:
        q = queries.withColumn("is_global", F.lit(True))
    else:
        s = scopes.select("query_id").distinct().withColumn("_s", F.lit(False))
        q = queries.join(broadcast_if_small(s), "query_id", "left").withColumn(
            "is_global", F.coalesce("_s", F.lit(True))
        ).drop("_s")
    plan = rk.query_plan(q, None, cfg.k, F.col("is_global")).withColumnRenamed("k", "adaptive_k")
    return materialise(plan, "plan")


def _bm25_list(docs, queries, kw, cfg, index, keep) -> DataFrame:
    if cfg.max_keywords is not None:
        kw = kw.where(F.col("ord") < cfg.max_keywords)
    variants = materialise(
        queries.select("query_id", F.lit(0).alias("ord"), "text", "fetch_k").unionByName(
            kw.join(queries.select("query_id", "fetch_k"), "query_id").select(
                "query_id", (F.col("ord") + 1).alias("ord"), F.col("keyword").alias("text"), "fetch_k"
            )
        ),
        "variants",
    )
    given = index is not None
    if not given:
        index = blocks.build(docs) if cfg.partial else blocks.ad_hoc(docs, variants) or blocks.build(docs)
    depth = queries.select("query_id", "fetch_k")
    hits = lx.bm25_multi(index, variants, docs, depth, cfg.partial, keep)
    if not given:
        index.discard()  # the variants' hits are stored, nothing else reads it
    discard(variants)
    return hits.select(
        "query_id", F.lit("bm25").alias("list"), "doc_id", "rank", (1 / (F.col("score") + 1)).alias("distance")
    )


def _name_list(docs, queries, kw) -> DataFrame:
    hits = lx.filename_search(docs, kw, queries.select("query_id", "fetch_k"))
    return hits.select("query_id", F.lit("filename").alias("list"), "doc_id", "rank", F.lit(0.0).alias("distance"))


def _vector_list(docs, plan, cfg, scopes) -> DataFrame:
    # the default encoder runs where the vectors are compared
    text_col = None if "embedding" in docs.columns or cfg.encoder else "text"
    vectors = docs if "embedding" in docs.columns else vx.embed(docs, encoder=cfg.encoder)
    vectors = vectors.select("doc_id", "embedding", "source")
    forms = rk.query_variants(plan.where("is_global"), rules=[], suffixes=[])
    asked = vx.embed(forms.withColumnRenamed("variant", "text"), encoder=cfg.encoder)
    asked = asked.select(F.concat_ws(":", "query_id", "ord").alias("_variant"), "embedding")
    depth = plan.agg(F.max("fetch_k")).first()[0] or 1
    raw = vx.knn(docs if text_col else vectors, asked, int(depth), id_col="doc_id", query_id="_variant", text_col=text_col).select(
        F.split("_variant", ":")[0].cast("long").alias("query_id"),
        F.split("_variant", ":")[1].cast("int").alias("ord"),
        "doc_id", "rank", "distance",
    )
    raw = raw.join(broadcast_if_small(plan.select("query_id", "fetch_k")), "query_id").where("rank <= fetch_k")
    # several variants fuse by reciprocal rank, a single one keeps its distances
    several = F.max("ord").over(Window.partitionBy("query_id")) > 0
    fused = (
        raw.withColumn("_several", several)
        .groupBy("query_id", "doc_id")
        .agg(
            F.max("_several").alias("_several"),
            F.sum(1 / (cfg.rrf_k + F.col("rank"))).alias("_rrf"),
            F.min("distance").alias("_d"),
            F.min(F.struct("ord", "rank")).alias("_seen"),
            F.max("fetch_k").alias("fetch_k"),
        )
        .withColumn("distance", F.when(F.col("_several"), 1 / (1 + F.col("_rrf"))).otherwise(F.col("_d")))
    )
    order = Window.partitionBy("query_id").orderBy(F.round("distance", 9), "_seen", "doc_id")
    out = fused.withColumn("rank", F.row_number().over(order)).where("rank <= fetch_k")
    out = out.select("query_id", F.lit("vector").alias("list"), "doc_id", "rank", "distance")
    if scopes is None:
        return out
    return out.unionByName(_scoped_list(vectors, plan, cfg, scopes))


def _scoped_list(vectors, plan, cfg, scopes) -> DataFrame:
    """Vectors of the scoped paths only, compared with their own query."""
    inside = scopes.select("query_id", norm_path("path").alias("_np")).distinct()
    asked = vx.embed(plan.where("not is_global"), encoder=cfg.encoder).select(
        "query_id", "fetch_k", F.col("embedding").alias("_q")
    )
    pairs = (
        vectors.withColumn("_np", norm_path("source"))
        .join(broadcast_if_small(inside), "_np")
        .join(broadcast_if_small(asked), "query_id")
        .withColumn("distance", F.round(1 - cosine("embedding", "_q"), 9))
    )
    depth = plan.where("not is_global").select("query_id", "fetch_k")
    ranked = lx.cut(pairs.drop("fetch_k"), ["query_id"], depth, [F.col("distance"), F.col("doc_id")])
    return ranked.select("query_id", F.lit("vector").alias("list"), "doc_id", "rank", "distance")


def _hit_docs(docs, lists) -> DataFrame:
    """Documents found at least once: source and content key."""
    ids = broadcast_if_small(lists.select("doc_id").distinct())
    return docs.join(ids, "doc_id", "left_semi").select(
        "doc_id", "source", F.md5(F.concat_ws("::", "source", "text")).alias("content")
    )


def _by_content(found, lists, small) -> DataFrame:
    """Equal (source, text) is one result: key = the lowest document id of the content."""
    rows = lists.join(hint_small(found.select("doc_id", "content"), small), "doc_id")
    same = Window.partitionBy("query_id", "content")
    return rows.select("query_id", "list", F.min("doc_id").over(same).alias("key"), "rank", "distance")


def _select(docs, kept, plan, cfg) -> DataFrame:
    """MMR where candidates exceed the adaptive depth, round-robin for broad intents, then the first min(k, adaptive k)."""
    wide = F.col("intent").isin("summary", "comparison")
    info = plan.select(
        "query_id", "adaptive_k", "intent",
        F.when(wide, cfg.mmr_lambda - 0.1).otherwise(cfg.mmr_lambda).alias("_lam"),
    )
    n = F.count("*").over(Window.partitionBy("query_id"))
    df = kept.join(broadcast_if_small(info), "query_id").withColumn("_all", n)
    # word sets once per document that is compared with others, joined by id
    compared = broadcast_if_small(materialise(df.where("_all > adaptive_k").select("doc_id").distinct(), "compared"))
    words = docs.join(compared, "doc_id", "left_semi").select("doc_id", rk.word_set(F.col("text")).alias("words"))
    picked = rk.mmr(df.join(words, "doc_id", "left"), cfg.k, "_lam", min_rows="adaptive_k")
    turned = rk.diversify(picked, "_all", out="_turn_rank")
    place = F.when((F.col("_all") <= F.col("adaptive_k")) & wide, F.col("_turn_rank")).otherwise(F.col("mmr_rank"))
    return (
        turned.withColumn("final", place)
        .where(F.col("final") <= F.least(F.lit(cfg.k), F.col("adaptive_k")))
        .select("query_id", "doc_id", "score", F.col("final").cast("long").alias("rank"))
    )
