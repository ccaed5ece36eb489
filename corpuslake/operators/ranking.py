"""Fusion, thresholds, diversification, re-ranking and query planning.

Inputs are ranked candidate tables keyed by ``query_id``; the searches before
them already cut each query to its fetch depth, so a window over one query is
small. Equal scores (to nine places) fall back to an explicit position or key.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslake.functions import fixed_values as fv
from corpuslake.functions.scale import broadcast_if_small, hint_small, is_small, materialise
from corpuslake.functions.text import CJK, WS, contains_any, extract_all, let, norm_path, script_of, trim_ws

def per_query():
    return Window.partitionBy("query_id")


def rrf(ranked: DataFrame, k: int = fv.RRF_K_DEFAULT, weights: dict[str, int] | None = None) -> DataFrame:
    """Reciprocal rank fusion of (query_id, list, key, rank), ranks from 1.

    ``weights`` repeats a list (2 = entered twice). Equal sums keep the order in
    which keys are first met: by list, then rank.
    """
    w = F.lit(1)
    for name, n in (weights or {}).items():
        w = F.when(F.col("list") == name, n).otherwise(w)
    summed = ranked.groupBy("query_id", "key").agg(
        F.sum(w / (k + F.col("rank"))).alias("score"),
        F.min(F.struct("list", "rank")).alias("_seen"),
    )
    order = per_query().orderBy(F.round("score", 9).desc(), "_seen", "key")
    return summed.withColumn("rank", F.row_number().over(order)).drop("_seen")


LIST_ORDER = {"vector": 0, "bm25": 1, "filename": 2}
LIST_WEIGHTS = {"vector": 1, "bm25": 1, "filename": 2}


def fuse_scores(
    lists: DataFrame,
    weights: dict[str, int] | None = None,
    rrf_k: int = fv.RRF_K,
    limit: DataFrame | int | None = None,
) -> DataFrame:
    """Fuse (query_id, list, key, rank, distance) into distance and score per key.

    With several lists: weighted RRF, min-max over all fused keys of the query,
    distance = (1 - normalised) * 0.8. A query with one single-weight list keeps
    that list's distances. ``limit`` keeps the first rows per query.
    """
    weights = weights or LIST_WEIGHTS
    w, prio = F.lit(1), F.lit(9)
    for name, n in weights.items():
        w = F.when(F.col("list") == name, n).otherwise(w)
        prio = F.when(F.col("list") == name, LIST_ORDER.get(name, 9)).otherwise(prio)
    summed = lists.groupBy("query_id", "key").agg(
        F.sum(w / (rrf_k + F.col("rank"))).alias("rrf_score"),
        F.min(F.struct(prio.alias("p"), F.col("rank").alias("r"))).alias("_seen"),
        F.min("distance").alias("_own"),
        F.max(w).alias("_w"),
        F.max(prio).alias("_hi"),
        F.min(prio).alias("_lo"),
    )
    top, low = F.max("rrf_score").over(per_query()), F.min("rrf_score").over(per_query())
    # one list of weight 1: every key was seen by the same list and counted once
    single = (
        (F.max("_hi").over(per_query()) == F.min("_lo").over(per_query()))
        & (F.max("_w").over(per_query()) == 1)
    )
    span = F.when(top == low, 1.0).otherwise(top - low)
    fused = (1 - (F.col("rrf_score") - low) / span) * 0.8
    out = summed.withColumn("distance", F.when(single, F.col("_own")).otherwise(fused))
    order = per_query().orderBy(F.round("distance", 9), "_seen", "key")
    out = out.withColumn("rank", F.row_number().over(order)).withColumn(
        "score", F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 / (1 + F.col("distance"))))
    )
    if isinstance(limit, DataFrame):
        out = out.join(broadcast_if_small(limit.select("query_id", "fetch_k")), "query_id").where(
            F.col("rank") <= F.col("fetch_k")
        )
    elif limit:
        out = out.where(F.col("rank") <= limit)
    return out.select("query_id", "key", "rrf_score", "distance", "score", "rank")


def threshold(df: DataFrame, t: float = fv.RELEVANCE_THRESHOLD, pos: str = "rank") -> DataFrame:
    """Keep score >= t; when fewer than 3, relax to min(t, 0.05) if 2 remain; else the top share."""
    low = min(t, fv.RELEVANCE_THRESHOLD_LOW)
    s = F.col("score")
    by_score = per_query().orderBy(F.round("score", 9).desc(), pos)
    df = (
        df.withColumn("_hi", F.count_if(s >= t).over(per_query()))
        .withColumn("_lo", F.count_if(s >= low).over(per_query()))
        .withColumn("_n", F.count("*").over(per_query()))
        .withColumn("_r", F.row_number().over(by_score))
    )
    keep = (
        F.when(F.col("_hi") >= 3, s >= t)
        .when(F.col("_lo") >= 2, s >= low)
        .otherwise(F.col("_r") <= F.greatest(F.lit(5), F.ceil(F.col("_n") * 0.3)))
    )
    return df.where(keep).drop("_hi", "_lo", "_n", "_r")


def scope_filter(df: DataFrame, scopes: DataFrame, suffixes: bool = True) -> DataFrame:
    """Keep rows whose source lies in the query's scope (query_id, path).

    Normalised paths match if they are equal or, with ``suffixes``, if one ends
    with the other, for any number of paths. A path that ends with a shorter one of c parts (between slashes) has the same last
    c - 1 parts, so the shorter one is a row, the longer one a row for each of its parts, and pairs are equi-joined and
    verified. Only names without a slash are compared with the character suffixes of last parts. Queries without a
    scope keep all rows.
    """
    src = F.coalesce(norm_path("source"), F.lit(""))
    paths = scopes.select("query_id", norm_path("path").alias("_p")).distinct()
    if not is_small(scopes):
        paths = hint_small(paths, False)
    rows = df.withColumn("_src", src)
    asked = rows.select("query_id", "_src").distinct()
    if suffixes:
        inside = _ends_with(asked, paths, "_src", "_p").union(_ends_with(paths, asked, "_p", "_src").select("query_id", "_src", "_p"))
    else:
        inside = asked.join(paths, (asked["query_id"] == paths["query_id"]) & (F.col("_src") == F.col("_p"))).select(asked["query_id"], "_src", "_p")
    inside = inside.select("query_id", "_src").distinct()
    scoped = paths.select("query_id", F.lit(True).alias("_scoped")).distinct()
    marked = rows.join(scoped, "query_id", "left").join(
        inside.withColumn("_in", F.lit(True)), ["query_id", "_src"], "left"
    )
    return marked.where(F.col("_scoped").isNull() | F.col("_in").isNotNull()).select(*df.columns)


def _ends_with(longer: DataFrame, shorter: DataFrame, long_col: str, short_col: str) -> DataFrame:
    """(query_id, long, short) where a path of ``longer`` ends with one of ``shorter``."""
    parts = lambda c: F.split(F.col(c), "/")
    last = lambda c, n: F.array_join(F.slice(parts(c), F.size(parts(c)) - n + 1, F.greatest(n, F.lit(0))), "/")
    key = longer.select("query_id", long_col, F.explode(F.sequence(F.lit(1), F.greatest(F.size(parts(long_col)) - 1, F.lit(1)))).alias("_n"))
    key = key.where(F.col("_n") < F.size(parts(long_col))).withColumn("_key", last(long_col, F.col("_n")))
    named = shorter.where(F.col(short_col).contains("/")).withColumn("_n", F.size(parts(short_col)) - 1).withColumn("_key", last(short_col, F.col("_n")))
    found = key.join(named, ["query_id", "_n", "_key"]).where(F.col(long_col).endswith(F.col(short_col))).select("query_id", long_col, short_col)
    bare = shorter.where(~F.col(short_col).contains("/"))
    tail = F.element_at(parts(long_col), -1)
    ends = F.transform(F.sequence(F.lit(1), F.length(tail) + 1), lambda i: F.substring(tail, i, F.length(tail)))
    asking = bare.select("query_id").distinct()
    by_tail = longer.join(asking, "query_id", "left_semi").select("query_id", long_col, F.explode(ends).alias(short_col))
    return found.union(by_tail.join(bare, ["query_id", short_col], "left_semi").select("query_id", long_col, short_col))


def word_set(text: Column) -> Column:
    """Distinct lower-cased words longer than one character, as 64-bit hashes.

    Only overlaps of two sets are ever taken, and hashed sets are several times
    smaller and faster to intersect than strings.
    """
    words = F.filter(F.split(F.lower(text), f"[{WS}]+"), lambda w: F.length(w) > 1)
    return F.array_distinct(F.transform(words, lambda w: F.xxhash64(w)))


def mmr(
    df: DataFrame,
    k: int,
    lam: float | str = fv.MMR_LAMBDA,
    pos: str = "rank",
    min_rows: str | None = None,
) -> DataFrame:
    """Maximal marginal relevance over (query_id, text | words, score, pos): adds ``mmr_rank`` 1..k.

    Greedy: the best score first (the later row on a tie), then the largest
    lam*score - (1-lam)*(highest word overlap with a chosen row), earlier row on
    a tie. A query with no more rows than ``k`` (or than its ``min_rows``
    column) keeps its order. One shuffle by query; each query's rows, which its
    fetch depth bounds, are picked in one pass that keeps each row's highest
    overlap so far. Texts become word sets first and are not carried along; a
    ``words`` column made by ``word_set`` may be given instead.
    """
    words = F.col("words") if "words" in df.columns else word_set(F.col("text"))
    df = df.withColumn("_words", words).drop("text", "words")
    df = df.withColumn("_lam", F.col(lam) if isinstance(lam, str) else F.lit(lam))
    df = df.withColumn("_need", F.col(min_rows) if min_rows else F.lit(k))
    out = [c for c in df.columns if c not in ("_words", "_need") and (c != "_lam" or lam == "_lam")]

    def pick(rows: pa.Table) -> pa.Table:
        n, need = rows.num_rows, rows.column("_need")[0].as_py()
        order = rows.column(pos).to_numpy(zero_copy_only=False)
        if n <= need:
            rank = np.argsort(np.argsort(order, kind="stable"), kind="stable") + 1
            chosen = np.arange(n)
        else:
            chosen = np.array(_greedy(rows, order, k), dtype=np.int64)
            rank = np.arange(1, len(chosen) + 1)
        kept = rows.select(out).take(pa.array(chosen))
        return kept.append_column("mmr_rank", pa.array(rank, pa.int32()))

    schema = T.StructType([*(f for f in df.schema.fields if f.name in out), T.StructField("mmr_rank", T.IntegerType())])
    return df.groupBy("query_id").applyInArrow(pick, schema)


def _greedy(rows: pa.Table, order: np.ndarray, k: int) -> list[int]:
    """Indices picked, in order."""
    lists = rows.column("_words").combine_chunks()
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    size = np.asarray(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(size)), size)
    score = np.array([-np.inf if s is None else s for s in rows.column("score").to_pylist()])
    lam = rows.column("_lam")[0].as_py()
    overlap, open_ = np.zeros(len(size)), np.ones(len(size), bool)
    picked: list[int] = []
    while len(picked) < k and open_.any():
        gain = score if not picked else lam * score - (1 - lam) * overlap
        gain = np.where(open_, np.round(gain, 9), -np.inf)
        best = np.flatnonzero(open_ & (gain == gain[open_].max()))
        i = int(best[np.argmax(order[best])] if not picked else best[np.argmin(order[best])])
        picked.append(i)
        open_[i] = False
        both = np.bincount(owner[np.isin(flat, flat[start[i] : start[i] + size[i]])], minlength=len(size))
        union = size + size[i] - both
        overlap = np.maximum(overlap, np.where(union > 0, both / np.maximum(union, 1), 0.0))
    return picked


def diversify(df: DataFrame, n: int | str, pos: str = "rank", out: str = "div_rank") -> DataFrame:
    """Round-robin over sources in order of first appearance, best row of each first."""
    by_source = Window.partitionBy("query_id", "source")
    df = df.withColumn(
        "_turn", F.row_number().over(by_source.orderBy(F.round("score", 9).desc(), pos))
    ).withColumn("_first", F.min(pos).over(by_source))
    limit = F.col(n) if isinstance(n, str) else F.lit(n)
    return (
        df.withColumn(out, F.row_number().over(per_query().orderBy("_turn", "_first")))
        .where(F.col(out) <= limit)
        .drop("_turn", "_first")
    )


def hybrid(lists: DataFrame, docs: DataFrame, limit: int, rrf_k: int = fv.RRF_K, min_score: float = 0.0) -> DataFrame:
    """Fuse vector and keyword lists with provenance.

    ``lists``: query_id, kind ('vector' | 'keyword'), variant, doc_id, rank.
    Keyword lists count only for variants whose vector list has rows. Rows of
    one source and text are one result. Returns
    the top 2*limit: (query_id, doc_id, score, rank, kinds).
    """
    has_vec = F.max(F.when(F.col("kind") == "vector", 1).otherwise(0)).over(
        Window.partitionBy("query_id", "variant")
    )
    # stored, as its size is measured and its rows are joined
    used = materialise(lists.withColumn("_v", has_vec).where("kind = 'vector' or _v = 1").drop("_v"), "used")
    key = F.concat(F.coalesce("source", F.lit("")), F.lit(":"), F.col("text"))
    keyed = docs.select("doc_id", "source", "text").join(broadcast_if_small(used), "doc_id").select(
        "query_id", "kind", "variant", "doc_id", "rank", F.md5(key).alias("_key")
    )
    prio = F.when(F.col("kind") == "vector", 0).otherwise(1)
    fused = keyed.groupBy("query_id", "_key").agg(
        F.sum(1 / (rrf_k + F.col("rank"))).alias("score"),
        F.array_join(F.sort_array(F.collect_set("kind"), asc=False), ",").alias("kinds"),
        F.min(F.struct(prio.alias("p"), "variant", "rank", "doc_id")).alias("_seen"),
    )
    order = per_query().orderBy(F.round("score", 9).desc(), "_seen")
    return (
        fused.withColumn("rank", F.row_number().over(order))
        .where((F.col("rank") <= 2 * limit) & (F.col("score") >= min_score))
        .select("query_id", F.col("_seen.doc_id").alias("doc_id"), "score", "rank", "kinds")
    )


def rerank(cands: DataFrame, scorer: Column, k: int = fv.RERANK_TOP_K, pos: str = "rank") -> DataFrame:
    """Second-stage order by any scorer column (or pandas UDF): adds rerank_score, new_rank."""
    df = cands.withColumn("rerank_score", scorer.cast("double"))
    order = per_query().orderBy(F.round("rerank_score", 9).desc(), pos)
    return df.withColumn("new_rank", F.row_number().over(order)).where(F.col("new_rank") <= k)


# ------------------------------------------------------------ query planning


def half_up(c: Column) -> Column:
    return F.floor(c + 0.5)


def complexity_of(q: Column) -> Column:
    words = F.filter(F.split(q, f"[{WS}]+"), lambda w: w != "")
    lower_words = F.array_distinct(F.filter(F.split(F.lower(q), f"[{WS}]+"), lambda w: w != ""))
    marks = F.length(q) - F.length(F.regexp_replace(q, "[，。？！?,.!;:]", ""))
    one = F.lit(1.0)
    return F.least(
        one,
        0.4 * F.least(one, F.length(q) / 200)
        + 0.3 * F.least(one, F.size(words) / 30)
        + 0.2 * F.least(one, F.size(lower_words) / 30)
        + 0.1 * F.least(one, marks / 10),
    )


def intent_of(q: Column) -> Column:
    low = F.lower(q)
    return (
        F.when(contains_any(low, fv.DEFINITION_WORDS), "definition")
        .when(contains_any(low, fv.SUMMARY_WORDS), "summary")
        .when(contains_any(low, fv.COMPARISON_WORDS), "comparison")
        .otherwise("other")
    )


def query_plan(
    queries: DataFrame,
    n_docs: Column | None = None,
    k: int = fv.DEFAULT_K,
    is_global: Column | None = None,
    max_k: int = fv.MAX_K,
    depth: int = fv.DEFAULT_K,
) -> DataFrame:
    """Add complexity, intent, adaptive k and fetch_k to each query.

    The depth is the same at every corpus size. With ``n_docs`` a small corpus
    is searched less deeply (a tenth of it, within limits).
    """
    is_global = F.lit(True) if is_global is None else is_global
    df = queries.withColumn("complexity", complexity_of(F.col("text"))).withColumn(
        "intent", intent_of(F.col("text"))
    )
    base = (
        F.when(F.col("intent") == "definition", F.greatest(F.lit(3), half_up(F.lit(k * 0.8))))
        .when(F.col("intent") == "summary", half_up(F.lit(k * 1.5)))
        .when(F.col("intent") == "comparison", half_up(F.lit(k * 1.6)))
        .otherwise(F.lit(k))
    )
    df = df.withColumn("_base", base).withColumn(
        "k",
        F.least(
            F.lit(max_k),
            F.greatest(F.col("_base"), half_up(F.col("_base") + F.col("complexity") * depth)),
        ).cast("long"),
    )
    wide = F.greatest(
        F.col("k") * fv.GLOBAL_FETCH_FACTOR,
        F.lit(fv.MAX_FETCH_K)
        if n_docs is None
        else F.least(
            F.lit(fv.MAX_FETCH_K),
            F.greatest(F.lit(fv.MIN_FETCH_K), F.floor(n_docs * fv.GLOBAL_FETCH_RATIO)),
        ),
    )
    narrow = F.greatest(F.col("k") * fv.SCOPED_FETCH_FACTOR, F.lit(fv.MIN_FETCH_K))
    fetch = F.greatest(F.when(is_global, wide).otherwise(narrow), F.col("k") * 10)
    return df.withColumn(
        "fetch_k", half_up(fetch * (1 + F.col("complexity") * 0.5)).cast("long")
    ).drop("_base")


def core_keywords(q: Column) -> Column:
    clean = trim_ws(F.regexp_replace(q, f"[{fv.CORE_QUESTION_CHARS}]", " "))
    return F.filter(
        extract_all(clean, f"[{CJK}]{{2,4}}"), lambda w: ~w.isin(*fv.CORE_COMMON_KEYWORDS)
    )


def query_variants(queries: DataFrame, rules=None, suffixes=None, max_keywords: int | None = None) -> DataFrame:
    """(query_id, ord, variant): keyword forms for Chinese queries, synonym swaps, short-query suffixes.

    All core keywords become variants, or the first ``max_keywords``.
    """
    rules = fv.SYNONYM_RULES if rules is None else rules
    suffixes = fv.SHORT_QUERY_SUFFIXES if suffixes is None else suffixes
    df = queries.withColumn("_kw", core_keywords(F.col("text"))).withColumn("_zh", script_of("text") == "zh")
    q = F.col("text")
    none = F.array().cast("array<string>")
    zh = F.when(
        F.col("_zh") & (F.size("_kw") > 0),
        F.concat(
            F.col("_kw") if max_keywords is None else F.slice("_kw", 1, max_keywords),
            F.when(F.size("_kw") >= 2, F.array(F.array_join(F.slice("_kw", 1, 2), " "))).otherwise(none),
            F.array(F.concat(F.lit("关于"), F.get("_kw", F.lit(0)))),
        ),
    ).otherwise(none)
    forms = [F.array(q), zh]
    for pattern, words in rules:
        for w in words:
            swap = q.rlike(pattern) & ~q.contains(w)
            forms.append(F.when(swap, F.array(F.regexp_replace(q, pattern, w))).otherwise(none))
    forms.append(
        F.when(F.length(q) < 10, F.array(*[F.concat(q, F.lit(s)) for s in suffixes])).otherwise(none)
    )
    return df.select("query_id", F.posexplode(F.array_distinct(F.concat(*forms))).alias("ord", "variant"))
