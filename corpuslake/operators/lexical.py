"""Keyword retrieval: tokens, inverted index, BM25, keyword and file-name search.

Every search takes a *table* of queries. Documents are never collected: the
query side is broadcast behind a row-count check, postings are spread by
document, and only ``k`` rows per query and partition reach the final ranking
(Spark plans the ``rank <= k`` filters as partial group limits).

Ranking ties are broken by document id after rounding scores to nine places,
so results do not depend on the order in which partial sums meet.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslake.functions import fixed_values as fv
from corpuslake.functions.scale import (
    broadcast_if_small,
    contains_join,
    hint_small,
    is_small,
    materialise,
)
from corpuslake.functions.text import CJK, WS, extract_all, index_tokens, let, path_tail, trim_ws

DOC_MARK = ""  # the pseudo-term that carries one row per document


def tokenize(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, term) with repetition."""
    return df.select(id_col, F.explode(index_tokens(text_col)).alias("term"))


def _with_term_counts(df: DataFrame, tokens: str) -> DataFrame:
    """Turn a token array column into ``counts: array<struct<term, tf>>`` row by row.

    The array is sorted once and run boundaries give the counts, so the work is
    linear after the sort and no shuffle by (document, term) is needed.
    """
    df = df.withColumn("_sorted", F.sort_array(tokens))
    at = lambda i: F.element_at("_sorted", i)
    starts = F.filter(
        F.when(F.size("_sorted") > 0, F.sequence(F.lit(1), F.size("_sorted"))).otherwise(
            F.array().cast("array<int>")
        ),
        lambda i: (i == 1) | (at(i) != at(F.greatest(i - 1, F.lit(1)))),
    )
    df = df.withColumn("_starts", starts)
    counts = F.transform(
        "_starts",
        lambda s, j: F.struct(
            at(s).alias("term"),
            (
                F.coalesce(F.get("_starts", j + 1), F.size("_sorted") + 1) - s
            ).cast("long").alias("tf"),
        ),
    )
    return df.withColumn("counts", counts).drop("_sorted", "_starts")


@dataclass(frozen=True)
class KeywordIndex:
    """Inverted index as tables.

    ``postings``: doc_id, term, tf, doc_len. One extra row per document with the
    empty term keeps documents and their lengths in the same table.
    """

    postings: DataFrame

    @property
    def entries(self) -> DataFrame:
        return self.postings.where(F.col("term") != DOC_MARK)

    @property
    def docs(self) -> DataFrame:
        return self.postings.where(F.col("term") == DOC_MARK).select("doc_id", "doc_len")

    @property
    def stats(self) -> DataFrame:
        """One row: n_docs, avg_len."""
        return self.docs.agg(
            F.count("*").alias("n_docs"),
            (F.sum("doc_len") / F.greatest(F.count("*"), F.lit(1))).alias("avg_len"),
        )

    @property
    def terms(self) -> DataFrame:
        """term, df, idf."""
        n = self.stats.select("n_docs").scalar()
        df = self.entries.groupBy("term").agg(F.count("*").alias("df"))
        return df.withColumn("idf", idf(n, F.col("df")))

    def save(self, path: str) -> "KeywordIndex":
        """Persist sorted by term, so query terms prune row groups on read."""
        (
            self.postings.repartitionByRange("term", "doc_id")
            .sortWithinPartitions("term", "doc_id")
            .write.mode("overwrite")
            .parquet(path)
        )
        return KeywordIndex(self.postings.sparkSession.read.parquet(path))

    def materialised(self) -> "KeywordIndex":
        return KeywordIndex(materialise(self.postings, "postings"))


def idf(n: Column, df: Column) -> Column:
    return F.log((n - df + 0.5) / (df + 0.5) + 1)


def build_index(
    docs: DataFrame,
    vocabulary: DataFrame | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str | None = "source",
    small: bool | None = None,
) -> KeywordIndex:
    """Index body + blank + source. With ``vocabulary`` (column ``term``) keep only those terms.

    Row-local up to the explode: no shuffle. A vocabulary restricts the postings
    before anything leaves the scan task, document lengths stay exact. ``small``
    says that the vocabulary's row bound was already checked.
    """
    body = F.coalesce(F.col(text_col), F.lit(""))
    if source_col:
        body = F.concat(body, F.lit(" "), F.coalesce(F.col(source_col), F.lit("")))
    tok = docs.select(F.col(id_col).alias("doc_id"), index_tokens(body).alias("_tokens"))
    tok = _with_term_counts(tok.withColumn("doc_len", F.size("_tokens").cast("long")), "_tokens")
    mark = F.array(F.struct(F.lit(DOC_MARK).alias("term"), F.lit(0).cast("long").alias("tf")))
    postings = tok.select("doc_id", "doc_len", F.explode(F.concat(mark, "counts")).alias("p")).select(
        "doc_id", "p.term", "p.tf", "doc_len"
    )
    if vocabulary is not None:
        spark = docs.sparkSession
        keep = vocabulary.select("term").union(
            spark.range(1).select(F.lit(DOC_MARK).alias("term"))
        ).distinct()
        small = is_small(vocabulary) if small is None else small
        postings = postings.join(hint_small(keep, small), "term", "left_semi").select(
            "doc_id", "term", "tf", "doc_len"
        )
    return KeywordIndex(postings)


def query_terms(queries: DataFrame, id_cols: list[str], text_col: str = "text") -> DataFrame:
    """(id columns, term, qtf): how often each token occurs in each query."""
    return (
        queries.select(*id_cols, F.explode(index_tokens(text_col)).alias("term"))
        .groupBy(*id_cols, "term")
        .agg(F.count("*").alias("qtf"))
    )


def top_k(df: DataFrame, id_cols: list[str], k, order: list[Column], rank: str = "rank") -> DataFrame:
    """Rank within id columns and keep ``rank <= k`` (int, or a column of ``df``)."""
    w = Window.partitionBy(*id_cols).orderBy(*order)
    limit = F.lit(k) if isinstance(k, int) else k  # an int lets Spark plan a partial group limit
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= limit)


def bm25_score(tf: Column, doc_len: Column, avg_len: Column, weight: Column) -> Column:
    k1, b = fv.BM25_K1, fv.BM25_B
    return weight * (tf * (k1 + 1)) / (tf + k1 * (1 - b + b * (doc_len / avg_len)))


def bm25(
    index: KeywordIndex,
    queries: DataFrame,
    k: int | DataFrame,
    partial: bool = False,
    id_cols: list[str] | None = None,
    small: bool | None = None,
    keep: DataFrame | None = None,
) -> DataFrame:
    """BM25 top ``k`` per query: (id columns, doc_id, score, rank). ``keep``: the only ids that count.

    Query tokens count with repetition. With ``partial`` a query term absent
    from a document still counts once if some document token contains it or is
    contained by it, weighted by its own idf, or ln(N+1) when the corpus lacks
    the term.
    """
    id_cols = id_cols or ["query_id"]
    if hasattr(index, "search"):  # a stored index in blocks
        most = k if isinstance(k, int) else int(k.agg(F.max("fetch_k")).first()[0] or 1)
        return cut(index.search(queries, most, partial, id_cols, keep), id_cols, k, [F.round("score", 9).desc(), F.col("doc_id")])
    if keep is not None:
        index = KeywordIndex(index.postings.join(keep.select("doc_id").distinct(), "doc_id", "left_semi"))
    wanted = query_terms(queries, id_cols)
    # one check bounds every table derived from the query terms below
    small = is_small(wanted) if small is None else small
    terms_in_queries = wanted.select("term").distinct()
    n_docs = index.stats.select("n_docs").scalar()
    avg_len = index.stats.select("avg_len").scalar()

    if partial:
        by_doc = _partial_postings(index, terms_in_queries)
    else:
        by_doc = index.entries.join(
            hint_small(terms_in_queries, small), "term", "left_semi"
        ).repartition("doc_id")

    weights = index.terms.join(hint_small(terms_in_queries, small), "term", "left_semi")
    weighted = wanted.join(weights, "term", "left").select(
        *id_cols,
        "term",
        (F.col("qtf") * F.coalesce("idf", F.log(n_docs + 1))).alias("weight"),
    )
    scored = (
        by_doc.join(hint_small(weighted, small), "term")
        .withColumn("_s", bm25_score(F.col("tf"), F.col("doc_len"), avg_len, F.col("weight")))
        .groupBy(*id_cols, "doc_id")
        .agg(F.sum("_s").alias("score"))
        .where(F.col("score") > 0)
    )
    return cut(scored, id_cols, k, [F.round("score", 9).desc(), F.col("doc_id")])


def cut(scored: DataFrame, id_cols: list[str], k: int | DataFrame, order: list[Column]) -> DataFrame:
    """Top ``k`` rows; ``k`` may be a table (query_id, fetch_k)."""
    if isinstance(k, int):
        return top_k(scored, id_cols, k, order)
    most = int(k.agg(F.max("fetch_k")).first()[0] or 1)
    first = top_k(scored, id_cols, most, order)  # partial limit by the largest depth
    depth = broadcast_if_small(k.select("query_id", "fetch_k"))
    return first.join(depth, "query_id").where("rank <= fetch_k").drop("fetch_k")


def bm25_search(docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Index only what the queries ask for, then rank: one pass over the corpus."""
    from corpuslake.operators.blocks import ad_hoc

    index = ad_hoc(docs, queries)
    if index is None:
        index = build_index(docs, vocabulary=query_terms(queries, ["query_id"]).select("term").distinct()).materialised()
    return bm25(index, queries, k)


def partial_pairs(index: KeywordIndex, terms_in_queries: DataFrame) -> DataFrame:
    """(qterm, term): query term and index term, one a substring of the other."""
    q = terms_in_queries.select(F.col("term").alias("qterm"))
    vocab = index.entries.select("term").distinct()
    # index tokens have two characters or more
    longer = contains_join(vocab, "term", q, "qterm", min_len=2).select("qterm", "term")
    shorter = contains_join(q, "qterm", vocab, "term", small_side="hay", min_len=2).select("qterm", "term")
    return longer.union(shorter).distinct()


def _partial_postings(index: KeywordIndex, terms_in_queries: DataFrame) -> DataFrame:
    """(doc_id, term = query term, tf, doc_len) with tf = 1 where only parts match."""
    pairs = materialise(partial_pairs(index, terms_in_queries), "pairs")  # measured, then joined
    hits = index.entries.join(broadcast_if_small(pairs), "term").select(
        "doc_id", "doc_len", "qterm", F.when(F.col("term") == F.col("qterm"), F.col("tf")).alias("tf")
    )
    return (
        hits.groupBy("doc_id", F.col("qterm").alias("term"))
        .agg(F.coalesce(F.max("tf"), F.lit(1)).alias("tf"), F.max("doc_len").alias("doc_len"))
    )


def bm25_multi(
    index: KeywordIndex, variants: DataFrame, docs: DataFrame, k: int | DataFrame, partial: bool = False, keep: DataFrame | None = None
) -> DataFrame:
    """Several variants per query merged by best score per distinct text.

    ``variants``: query_id, ord, text. ``docs`` supplies the text of the hits.
    """
    # variants of one text are searched once, to the largest depth, and dealt to their queries
    forms = materialise(variants.select("text").distinct().withColumn("form", F.monotonically_increasing_id()), "forms")
    most = k if isinstance(k, int) else int(k.agg(F.max("fetch_k")).first()[0] or 1)
    found = bm25(index, forms, most, partial, id_cols=["form"], keep=keep)
    asked = variants.join(forms, "text").select("query_id", "ord", "form")
    if not isinstance(k, int):
        asked = asked.join(k.select("query_id", "fetch_k"), "query_id")
    limit = F.lit(k) if isinstance(k, int) else F.col("fetch_k")
    hits = found.join(asked, "form").where(F.col("rank") <= limit).select("query_id", "ord", "doc_id", "score", "rank")
    # written once: the size check and the join below both read it
    hits = materialise(hits, "variant_hits")
    found = hits.select("doc_id").distinct()
    small = is_small(found)
    keys = docs.join(hint_small(found, small), "doc_id", "left_semi").select("doc_id", F.md5("text").alias("text_key"))
    # millions of hits may take less in files than Spark's bound, so it would broadcast them: the keys go, or a shuffle join stays
    keyed = hits.join(hint_small(keys, small), "doc_id").select("query_id", "ord", "rank", "doc_id", "score", "text_key")
    best = keyed.groupBy("query_id", "text_key").agg(
        F.max_by(
            F.struct("doc_id", "score", "ord", "rank"),
            F.struct(F.round("score", 9), -F.col("ord"), -F.col("rank")),
        ).alias("b")
    )
    flat = best.select("query_id", "b.doc_id", "b.score")
    return cut(flat, ["query_id"], k, [F.round("score", 9).desc(), F.col("doc_id")])


# ---------------------------------------------------------------- keywords


def keyword_array(text: Column, term_map: dict[str, list[str]] | None = None) -> Column:
    """Distinct keywords of a query in order, with aliases in both directions."""
    term_map = fv.TERM_ALIASES if term_map is None else term_map
    words = "|".join(fv.QUESTION_WORDS)
    clean = F.regexp_replace(text, f"[{fv.QUESTION_CHARS}]", " ")
    clean = F.regexp_replace(clean, rf"(?i)(?<![A-Za-z0-9_])(?:{words})(?![A-Za-z0-9_])", " ")
    return let(
        trim_ws(clean), lambda c: let(F.lower(c), lambda low: _keywords_of(c, low, term_map))
    )


def _keywords_of(clean: Column, low: Column, term_map: dict[str, list[str]]) -> Column:
    found = [
        extract_all(clean, f"[{CJK}]{{2,8}}"),
        extract_all(clean, rf"[぀-ヿ{CJK}]{{2,10}}"),
        extract_all(clean, r"[가-힯]{2,10}"),
        extract_all(clean, r"[a-zA-Z][a-zA-Z0-9_-]{1,24}"),
    ]
    if term_map:
        table = F.array(
            *[
                F.struct(
                    F.lit(t).alias("term"), F.array(*[F.lit(a) for a in al]).alias("aliases")
                )
                for t, al in term_map.items()
            ]
        )
        none = F.array().cast("array<string>")
        found.append(
            F.flatten(
                F.transform(
                    table,
                    lambda t: F.concat(
                        F.when(clean.contains(t["term"]), t["aliases"]).otherwise(none),
                        F.flatten(
                            F.transform(
                                t["aliases"],
                                lambda a: F.when(
                                    low.contains(F.lower(a)),
                                    F.concat(
                                        F.array(t["term"]),
                                        F.filter(t["aliases"], lambda x: x != a),
                                    ),
                                ).otherwise(none),
                            )
                        ),
                    ),
                )
            )
        )
    keep = lambda w: (
        ~F.lower(w).isin(*fv.COMMON_KEYWORDS) & (F.length(w) >= 2) & ~w.rlike(r"^[0-9]+\z")
    )
    return F.array_distinct(F.filter(F.concat(*found), keep))


def expand_keywords(
    queries: DataFrame, term_map: dict[str, list[str]] | None = None, text_col: str = "text"
) -> DataFrame:
    """(query_id, ord, keyword)."""
    return queries.select(
        "query_id", F.posexplode(keyword_array(F.col(text_col), term_map)).alias("ord", "keyword")
    )


def filename_search(docs: DataFrame, keywords: DataFrame, limit) -> DataFrame:
    """Three-tier keyword search: (query_id, doc_id, tier, rank).

    Tier 1: a keyword in the file name; tier 2: at least max(2, half) of the
    keywords in the text; tier 3: any keyword in the text. Tier order, then
    document order. ``limit`` is an int or a table (query_id, fetch_k).
    """
    kw = F.lower("keyword")
    asked = keywords.select("query_id", kw.alias("kw")).groupBy("query_id", "kw").agg(F.count("*").alias("n"))
    n_kw = F.sum("n").over(Window.partitionBy("query_id")).alias("n_kw")
    asked = materialise(asked.select("query_id", "kw", "n", n_kw).where("kw <> ''"), "asked")
    if isinstance(limit, int):
        asked = asked.withColumn("depth", F.lit(limit))
    else:
        asked = asked.join(limit.select("query_id", F.col("fetch_k").cast("int").alias("depth")), "query_id")
    size = asked.agg(F.sum(F.length(F.col("kw").cast("binary")) + ASKED_BYTES)).first()[0] or 0
    passes = max(1, -(-int(size) // KEYWORD_BYTES))
    rows = _by_document(docs)
    schema = f"query_id {dict(asked.dtypes)['query_id']}, doc_id {dict(docs.dtypes)['doc_id']}, tier int"
    out = None
    for i in range(passes):
        mine = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == i).toArrow()
        found = rows.mapInArrow(_tiers(docs.sparkSession, mine), schema)
        out = found if out is None else out.union(found)
    return cut(out, ["query_id"], limit, [F.col("tier"), F.col("doc_id")]).select("query_id", "doc_id", "tier", "rank")


#: Bytes of keywords that are searched for in one pass, and what a row of a query's keyword takes beside its text.
KEYWORD_BYTES, ASKED_BYTES = 8 << 20, 16
#: Texts that are Python strings at the same time; counts of documents x queries.
TEXTS_AT_ONCE, COUNTS_AT_ONCE = 256, 1 << 20
KEEP_ROWS = 500_000  # rows found before a task cuts them to each query's depth


def _by_document(docs: DataFrame) -> DataFrame:
    """(doc_id, parts): names and texts of a document, in lower case; only rows of a repeated id are shuffled."""
    part = F.struct(
        path_tail(F.lower(F.coalesce("source", F.lit("")))).alias("name"), F.lower(F.coalesce("text", F.lit(""))).alias("text")
    )
    twice = docs.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("_again"))
    twice = materialise(twice, "twice")
    rows = docs.select("doc_id", part.alias("part"))
    one = F.array("part").alias("parts")
    if not twice.limit(1).count():
        return rows.select("doc_id", one)
    again, same = hint_small(twice, is_small(twice)), F.col("doc_id").eqNullSafe(F.col("_again"))
    several = rows.join(again, same, "left_semi").groupBy("doc_id").agg(F.collect_list("part").alias("parts"))
    return rows.join(again, same, "left_anti").select("doc_id", one).union(several)


def _tiers(spark, asked: pa.Table):
    """Documents -> (query_id, doc_id, tier), in each task the first ``depth`` of a query by tier and document.

    Each text is scanned once for all keywords by an automaton, and its hits are counted by query at once.
    """
    words = asked["kw"].combine_chunks().dictionary_encode()
    ids = asked["query_id"].combine_chunks().dictionary_encode()
    code, query = words.indices.to_numpy(), ids.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    order = np.argsort(code, kind="stable")
    n_kw, depth = (np.zeros(len(ids.dictionary), np.int64) for _ in range(2))
    n_kw[query], depth[query] = asked["n_kw"].to_numpy(), asked["depth"].to_numpy()
    plan = {
        "words": words.dictionary.to_pylist(), "starts": np.searchsorted(code[order], np.arange(len(words.dictionary) + 1)),
        "query": query[order], "n": asked["n"].to_numpy()[order].astype(np.int64), "n_kw": n_kw, "depth": depth, "ids": ids.dictionary,
    }
    shared = spark.sparkContext.broadcast(plan)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        p = shared.value
        machine = ahocorasick.Automaton()
        for i, w in enumerate(p["words"]):
            machine.add_word(w, i)
        machine.make_automaton()
        starts, query, times, n_kw = p["starts"], p["query"], p["n"], p["n_kw"]

        width = max(1, len(n_kw))

        def count(texts: list[set[int]]) -> np.ndarray:
            """Documents x queries: how many of a query's keywords are among those found in a document."""
            found = np.fromiter(chain.from_iterable(texts), np.int64)
            doc = np.repeat(np.arange(len(texts)), [len(x) for x in texts])
            sizes = starts[found + 1] - starts[found]
            at = np.repeat(starts[found] - np.r_[0, np.cumsum(sizes)[:-1]][: len(sizes)], sizes) + np.arange(sizes.sum())
            return np.bincount(np.repeat(doc, sizes) * width + query[at], times[at], len(texts) * width)

        def tiers(docs: list[list[dict]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Places of documents, queries and tiers; a document of several rows counts the keywords of all."""
            doc = np.repeat(np.arange(len(docs)), [len(parts) for parts in docs])
            one = doc if len(doc) > len(docs) else None
            names, texts = ([{i for _, i in machine.iter(x[c])} for parts in docs for x in parts] for c in ("name", "text"))
            in_name, in_text = count(names), count(texts)
            if one is not None:
                in_name, in_text = (np.add.reduceat(x.reshape(-1, width), np.searchsorted(one, np.arange(len(docs))), axis=0).ravel() for x in (in_name, in_text))
            at = np.flatnonzero((in_name > 0) | (in_text > 0))
            q, text = at % width, in_text[at]
            second = (text >= np.ceil(n_kw[q] * 0.5)) & (text >= 2)
            return at // width, q, np.where(in_name[at] > 0, 1, np.where(second, 2, 3))

        def kept(tables: list[pa.Table]) -> pa.Table:
            table = pa.concat_tables(tables)
            keys = [("q", "ascending"), ("tier", "ascending"), ("doc_id", "ascending")]
            table = table.take(pc.sort_indices(table, sort_keys=keys, null_placement="at_start"))
            q = table["q"].to_numpy()
            first = np.searchsorted(q, q)
            return table.filter(pa.array(np.arange(len(q)) - first < p["depth"][q])).combine_chunks()

        held, size = [], 0
        for batch in batches if len(machine) else ():
            step = max(1, min(TEXTS_AT_ONCE, COUNTS_AT_ONCE // width))
            for start in range(0, len(batch), step):
                some = batch.slice(start, step)
                doc, q, tier = tiers(some.column(1).to_pylist())
                held.append(pa.table({"q": q, "doc_id": some.column(0).take(pa.array(doc)), "tier": tier.astype(np.int32)}))
                size += len(doc)
                if size > KEEP_ROWS:
                    held = [kept(held)]
                    size = min(KEEP_ROWS // 2, len(held[0]))
        if held:
            table = kept(held)
            table = pa.table({"query_id": p["ids"].take(table["q"]), "doc_id": table["doc_id"], "tier": table["tier"]})
            yield from table.to_batches(max_chunksize=10_000)

    return run


def matched_keywords(docs: DataFrame, keywords: DataFrame) -> DataFrame:
    """(query_id, keyword): keywords that occur in at least one file name."""
    names = docs.select(path_tail(F.lower("source")).alias("_name")).distinct()
    asked = keywords.select("query_id", "keyword", F.lower("keyword").alias("kw"))
    found = contains_join(names, "_name", asked.select("kw").distinct(), "kw").select("kw").distinct()
    return asked.join(found, "kw", "left_semi").select("query_id", "keyword").distinct()


def coverage(pairs: DataFrame, query_col: str = "query_text", doc_col: str = "text") -> DataFrame:
    """Add ``match_score``, ``matched_terms``, ``relevant`` to (query text, document text) rows."""
    low = F.lower(F.col(doc_col))
    df = pairs.withColumn("_kw", keyword_array(F.col(query_col))).withColumn("_low", low)
    df = df.withColumn("matched_terms", F.filter("_kw", lambda w: F.col("_low").contains(F.lower(w))))
    words = F.split(F.lower(F.col(query_col)), f"[{WS}]+")
    word_hit = F.exists(words, lambda w: (F.length(w) > 2) & F.col("_low").contains(w))
    none = F.size("_kw") == 0
    score = F.when(none, F.lit(0.5)).otherwise(F.size("matched_terms") / F.size("_kw"))
    relevant = none | (F.size("matched_terms") > 0) | word_hit | (score >= 0.25)
    return (
        df.withColumn("match_score", score)
        .withColumn("relevant", relevant)
        .drop("_kw", "_low")
    )
