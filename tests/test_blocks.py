"""The stored keyword index against the plain one: scores, substrings, refreshes, merges, filters, and how much it reads."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslake.functions.scale import arrow_rows, shared_dir
from corpuslake.operators import blocks as B
from corpuslake.operators import lexical as lx


def words(rng, n, spread=400):
    return " ".join(f"w{int(i)}" for i in np.minimum(rng.zipf(1.3, n), spread))


@pytest.fixture(scope="module")
def tables(spark):
    rng = np.random.default_rng(1)
    docs = [(i, words(rng, int(rng.integers(0, 60))) + (" 中文 搜索" if i % 9 == 0 else ""), f"dir/file{i}.txt") for i in range(400)]
    docs[17] = (17, None, None)
    queries = [(q, words(rng, 5)) for q in range(12)] + [(12, "中文搜索 w3"), (13, "absent terms"), (14, "")]
    return (
        spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(4),
        spark.createDataFrame(queries, "query_id long, text string"),
    )


def found(df):
    return sorted((r["query_id"], r["rank"], r["doc_id"], round(r["score"], 7)) for r in df.collect())


@pytest.mark.parametrize("partial", [False, True])
def test_scores_are_those_of_the_plain_index(tables, monkeypatch, partial):
    docs, queries = tables
    monkeypatch.setattr(B, "SHARD", 8)  # many shards, so that rare terms are searched first
    index = B.build(docs)
    assert index.stats.first()["shards"] >= B.SEED
    want = found(lx.bm25(lx.build_index(docs), queries, 5, partial=partial))
    assert found(lx.bm25(index, queries, 5, partial=partial)) == want
    monkeypatch.setattr(B, "ASKED", 20)  # several passes over the queries
    assert found(lx.bm25(index, queries, 5, partial=partial)) == want


def test_search_without_an_index(tables):
    docs, queries = tables
    assert found(lx.bm25_search(docs, queries, 5)) == found(lx.bm25(lx.build_index(docs), queries, 5))
    assert lx.bm25_search(docs.limit(0), queries, 5).count() == 0
    assert lx.bm25_search(docs, queries.limit(0), 5).count() == 0


def test_filter_counts_in_the_statistics(tables):
    docs, queries = tables
    keep = docs.where("doc_id % 3 = 1").select("doc_id")
    want = found(lx.bm25(lx.build_index(docs.join(keep, "doc_id")), queries, 5))
    assert found(lx.bm25(B.build(docs), queries, 5, keep=keep)) == want
    assert found(lx.bm25(B.build(docs), queries, 5, keep=keep.limit(0))) == []


@pytest.mark.parametrize("partial", [False, True])
def test_refreshes_and_merge_equal_a_new_index(spark, tables, partial):
    docs, queries = tables
    old = docs.where("doc_id < 250").withColumn("text", F.when(F.col("doc_id") % 4 == 0, F.lit("w1 w2 old words")).otherwise(F.col("text")))
    index = B.build(old)
    index = index.refresh(docs.where("doc_id >= 250 or doc_id % 4 = 0"))
    index = index.refresh(deletes=docs.where("doc_id % 10 = 0"))
    index = index.refresh(docs.where("doc_id % 20 = 0"))
    live = docs.where("doc_id % 10 <> 0 or doc_id % 20 = 0")
    plain = lx.build_index(live)
    want = found(lx.bm25(plain, queries, 5, partial=partial))
    terms = lambda x: sorted((r["term"], r["df"], round(r["idf"], 9)) for r in x.terms.collect())
    merged = index.merge()
    assert len(index.names) == 4 and len(merged.names) == 1
    for x in (index, merged, B.BlockIndex(spark, index.root)):
        assert found(lx.bm25(x, queries, 5, partial=partial)) == want
        assert terms(x) == terms(plain)


def test_substrings_come_from_the_vocabulary(spark, tables):
    docs, _ = tables
    asked = spark.createDataFrame([("w1",), ("2",), ("w33",), ("file12x",), ("中文",), ("txt",)], "term string")
    want = lx.partial_pairs(lx.build_index(docs), asked.where("length(term) > 1"))
    got = B.build(docs).partial_pairs(asked.where("length(term) > 1"))
    assert sorted(map(tuple, got.select("qterm", "term").collect())) == sorted(map(tuple, want.select("qterm", "term").collect()))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "tfs" not in plan and "lens" not in plan


def test_few_postings_are_scored(spark, monkeypatch):
    """With a score to beat, common terms are looked up for candidates only."""
    rng = np.random.default_rng(2)
    docs = [(i, "common other usual " + words(rng, 30, 5000) + (" rare1 rare2 rare3" if i % 500 == 7 else ""), "") for i in range(6000)]
    docs = spark.createDataFrame(docs, "doc_id long, text string, source string")
    monkeypatch.setattr(B, "SHARD", 128)
    index = B.build(docs)
    queries = spark.createDataFrame([(1, "common other usual rare1 rare2 rare3")], "query_id long, text string")
    seen = []
    real = B._score

    def counted(*args):
        run = real(*args)

        def watch(batches):
            yield from run(batches)

        seen.append(run)
        return watch

    monkeypatch.setattr(B, "_score", counted)
    best = found(lx.bm25(index, queries, 5))
    assert best == found(lx.bm25(lx.build_index(docs), queries, 5))
    asked = index.table("terms").where(F.col("term").isin("common", "other", "usual", "rare1", "rare2", "rare3")).agg(F.sum("df")).first()[0]
    rows = index._input(spark.createDataFrame([(t,) for t in "common other usual rare1 rare2 rare3".split()], "term string"), True, None)
    scored = rows.mapInArrow(seen[-1], "q int, doc_id long, score double").where("q < 0").agg(F.sum("score")).first()[0]
    assert scored < asked / 20


def test_an_index_of_nothing(spark, tables):
    docs, queries = tables
    empty = B.build(docs.limit(0))
    assert lx.bm25(empty, queries, 5).count() == 0 and lx.bm25(empty, queries, 5, partial=True).count() == 0
    index = empty.refresh(docs.where("doc_id < 30"))
    assert found(lx.bm25(index, queries, 5)) == found(lx.bm25(lx.build_index(docs.where("doc_id < 30")), queries, 5))
    assert shared_dir(spark) not in index.root


def test_substring_pairs_stay_on_the_cluster(spark, monkeypatch):
    """The driver gets the query terms only, however many index terms match them."""
    docs = spark.range(3000).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("ab cd ab"), "id", F.lit(" x"), F.col("id") % 7).alias("text"), F.lit("f").alias("source")
    )
    queries = spark.createDataFrame([(1, "ab ab99 cdab12"), (2, "b2 x3"), (3, "zz")], "query_id long, text string")
    index, frame, sizes = B.build(docs), type(docs), []
    whole = frame.toArrow

    def watched(self):
        out = whole(self)
        sizes.append(len(out))
        return out

    monkeypatch.setattr(frame, "toArrow", watched)
    got = found(lx.bm25(index, queries, 40, partial=True))
    assert sizes and max(sizes) <= 10
    assert got == found(lx.bm25(lx.build_index(docs), queries, 40, partial=True))


def test_terms_are_counted_from_batches_of_a_bounded_size(spark):
    docs = spark.createDataFrame([(1, "bb aa aa", ""), (2, "", ""), (3, None, None), (4, "aa", "")], "doc_id long, text string, source string").coalesce(1)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    with arrow_rows(spark, 2):
        assert spark.conf.get(key) == "2"
        rows = B.forward(docs).collect()
    assert spark.conf.get(key) == before
    got = {r["doc_id"]: (r["doc_len"], sorted((c["term"], c["tf"]) for c in r["counts"])) for r in rows}
    assert got == {1: (3, [("aa", 2), ("bb", 1)]), 2: (0, []), 3: (0, []), 4: (1, [("aa", 1)])}


def test_partial_searches_hand_on_few_rows(spark, monkeypatch):
    """With a score to beat from some shards, tasks do not hand on k rows a query and shard."""
    rng = np.random.default_rng(5)
    docs = [(i, words(rng, 12, 400), f"src/file{i % 7}.txt") for i in range(1000)]
    docs = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(4)
    monkeypatch.setattr(B, "SHARD", 16)
    index = B.build(docs)
    queries = spark.createDataFrame([(q, words(rng, 3, 400)) for q in range(10)], "query_id long, text string")
    every = index.search(queries, 5, partial=True)
    monkeypatch.setattr(B, "HANDED", 0, raising=False)
    monkeypatch.setattr(B, "FEW", 4, raising=False)
    some = index.search(queries, 5, partial=True)
    assert some.count() < every.count() / 2
    best = lambda rows: sorted((r["query_id"], r["doc_id"], round(r["score"], 9)) for r in lx.cut(rows, ["query_id"], 5, [F.round("score", 9).desc(), F.col("doc_id")]).collect())
    assert best(some) == best(every)


def test_query_terms_are_marked_in_ranges(monkeypatch):
    """A query term's postings are those of the terms that match it, however many terms and postings are looked at at once."""
    rng = np.random.default_rng(3)
    n_terms, n_docs = 40, 50
    holds = rng.random((60, n_docs)) < 0.1  # the first 40 of the index terms are query terms
    pairs = np.array([(q, t) for q in range(n_terms) for t in range(60) if rng.random() < 0.1 or q == t])
    shard = B._Shard.__new__(B._Shard)

    def spread():
        code, place = np.nonzero(holds)
        shard.ids, shard.place, shard.tf, shard.length = np.arange(n_docs), place, 2.0 + code, np.full(n_docs, 7.0)
        shard._group(code, 7.0)
        order = rng.permutation(len(pairs))
        shard.spread(pairs[order, 0], pairs[order, 1], n_terms, 7.0)
        return {(c, int(shard.place[i])): shard.tf[i] for c, (s, e) in shard.span.items() for i in range(s, e)}

    want = {(q, d): 2.0 + q if holds[q, d] else 1.0 for q, t in pairs.tolist() for d in np.flatnonzero(holds[t]).tolist()}
    assert spread() == want
    monkeypatch.setattr(B, "MARKS", 170, raising=False)
    monkeypatch.setattr(B, "AT_ONCE", 9, raising=False)
    assert spread() == want


def test_a_search_deletes_its_own_index(spark, tables, tmp_path, monkeypatch):
    import uuid

    from corpuslake.functions import scale
    from corpuslake.plans.search import SearchConfig, search

    docs, queries = tables
    for module in (scale, B):
        monkeypatch.setattr(module, "shared_dir", lambda _: f"{tmp_path}/{uuid.uuid4().hex}")
    search(docs, queries, SearchConfig(vector=False)).collect()
    assert not [p for p in tmp_path.rglob("*") if p.name in ("segments", "pairs", "qterms")]
    assert [p for p in tmp_path.rglob("*") if p.name == "lists"]
