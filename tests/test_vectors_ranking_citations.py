import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslake.functions.vectors import cosine
from corpuslake.operators import citations as ci
from corpuslake.operators import ranking as rk
from corpuslake.operators import vectors as vx
from corpuslake.sources import tables as st


def test_cosine_edge_cases(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 2.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    got = [r.c for r in df.select(cosine("a", "b").alias("c")).collect()]
    assert abs(got[0] - 2**-0.5) < 1e-12 and got[1:] == [0.0, 0.0]


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(5)
    mat = rng.normal(size=(700, 8))
    mat[100:400] = mat[100]  # a third of the rows are copies of one vector
    return mat, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(mat)], "vec_id long, embedding array<double>").repartition(5)


def brute(mat, k):
    unit = mat / np.linalg.norm(mat, axis=1, keepdims=True)
    dist = np.round(1 - unit @ unit.T, 9)
    ids = np.arange(len(mat))
    return {(q, int(i), r + 1) for q in range(len(mat)) for r, i in enumerate(np.lexsort((ids, dist[q]))[:k])}


def test_knn_exact_with_ties_on_both_paths(spark, cloud, monkeypatch):
    mat, df = cloud
    q = df.select(F.col("vec_id").alias("query_id"), "embedding")
    want = brute(mat, 5)
    assert {(r.query_id, r.vec_id, r["rank"]) for r in vx.knn(df, q, 5).collect()} == want
    monkeypatch.setattr(vx, "MAX_LOCAL_QUERIES", 10)
    monkeypatch.setattr(vx, "QUERY_BLOCK", 256)
    monkeypatch.setattr(vx, "VECTOR_BLOCK", 200)
    assert {(r.query_id, r.vec_id, r["rank"]) for r in vx.knn(df, q, 5).collect()} == want


def test_ann_recall(spark, cloud):
    mat, df = cloud
    q = df.select(F.col("vec_id").alias("query_id"), "embedding")
    exact = vx.knn(df, q, 10)
    model = vx.ann_fit(df)
    assert len(model.centroids) > 1
    some = vx.recall(vx.ann(model, q, 10, nprobe=4), exact).first()["recall"]
    every = vx.recall(vx.ann(model, q, 10, nprobe=128), exact).first()["recall"]
    assert some >= 0.9 and every == 1.0


def test_ann_queries_go_once_to_a_block_of_cells(spark, cloud, monkeypatch):
    mat, df = cloud
    q = df.select(F.col("vec_id").alias("query_id"), "embedding")
    model = vx.ann_fit(df)
    got = lambda n: {(r.query_id, r.vec_id, r["rank"]) for r in vx.ann(model, q, 5, n).collect()}
    near = got(4)
    monkeypatch.setattr(vx, "MAX_LOCAL_QUERIES", 10)
    monkeypatch.setattr(vx, "VECTOR_BLOCK", 350)
    assert got(4) == near
    assert got(len(model.centroids)) == brute(mat, 5)
    kept, final = [], vx._final_rank
    monkeypatch.setattr(vx, "_final_rank", lambda found, *a: kept.append(found.count()) or final(found, *a))
    got(len(model.centroids))
    assert kept[0] <= 3 * 5 * len(mat)  # k rows a block, not a cell


def words(t):
    return {w for w in t.lower().split() if len(w) > 1}


def plain_mmr(rows, k, lam):
    """rows: (pos, score, text) in order."""
    if len(rows) <= k:
        return [r[0] for r in rows]
    left = list(rows)
    best = left[0]
    for r in left[1:]:
        if not best[1] > r[1]:
            best = r
    chosen = [best]
    left.remove(best)
    while len(chosen) < k and left:
        def gain(r):
            sims = [len(words(r[2]) & words(c[2])) / len(words(r[2]) | words(c[2])) if words(r[2]) | words(c[2]) else 0 for c in chosen]
            return round(lam * r[1] - (1 - lam) * max(sims), 9)

        best = max(left, key=lambda r: (gain(r), -r[0]))
        chosen.append(best)
        left.remove(best)
    return [c[0] for c in chosen]


def test_mmr_equals_plain_python(spark):
    rnd = random.Random(1)
    vocab = "red green blue fox cat dog sun moon a b".split()
    data, want = [], {}
    for q in range(12):
        n = rnd.randint(1, 14)
        rows = [(p + 1, rnd.choice([0.5, 0.7, 0.9, 0.9]), " ".join(rnd.choices(vocab, k=rnd.randint(0, 6)))) for p in range(n)]
        data += [(q, *r) for r in rows]
        want[q] = plain_mmr(rows, 5, 0.7)
    df = spark.createDataFrame(data, "query_id int, rank int, score double, text string")
    got = {}
    for r in rk.mmr(df, 5).orderBy("query_id", "mmr_rank").collect():
        got.setdefault(r.query_id, []).append(r["rank"])
    assert got == want
    # with lambda 1 the order is by score alone
    top = rk.mmr(df, 5, 1.0).orderBy("query_id", "mmr_rank").collect()
    for q in range(12):
        s = [r.score for r in top if r.query_id == q and len(want[q]) == 5]
        n = sum(1 for d in data if d[0] == q)
        assert n <= 5 or s == sorted(s, reverse=True)


@pytest.mark.parametrize(
    "scores, kept",
    [
        ([], 0), ([0.1], 1), ([0.9, 0.01], 2), ([0.9, 0.1], 2), ([0.9, 0.8, 0.7, 0.1], 3), ([0.9, 0.06, 0.04], 2),
        ([0.01] * 20, 6), ([0.3, 0.3] + [0.01] * 18, 2),
    ],
)
def test_threshold_cascade(spark, scores, kept):
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate(scores)], "query_id int, rank int, score double")
    assert rk.threshold(df, 0.25).count() == kept


def test_fusion_single_list_keeps_distances_and_filename_counts_twice(spark):
    df = spark.createDataFrame(
        [(1, "bm25", 10, 1, 0.2), (1, "bm25", 11, 2, 0.3), (2, "filename", 10, 1, 0.0), (2, "filename", 11, 2, 0.0),
         (3, "vector", 10, 1, 0.4), (3, "filename", 11, 1, 0.0)],
        "query_id int, list string, key long, rank int, distance double",
    )
    got = {(r.query_id, r.key): (round(r.distance, 6), r["rank"]) for r in rk.fuse_scores(df).collect()}
    assert got == {
        (1, 10): (0.2, 1), (1, 11): (0.3, 2), (2, 10): (0.0, 1), (2, 11): (0.8, 2), (3, 11): (0.0, 1), (3, 10): (0.8, 2),
    }


def test_rrf_ignores_row_order_and_breaks_ties_by_list(spark):
    data = [(1, "a", "x", 1), (1, "b", "y", 1), (1, "a", "y", 2), (1, "b", "x", 2)]
    for rows in (data, data[::-1]):
        df = spark.createDataFrame(rows, "query_id int, list string, key string, rank int")
        assert [r.key for r in rk.rrf(df).orderBy("rank").collect()] == ["x", "y"]


def test_diversify_round_robin(spark):
    df = spark.createDataFrame(
        [(1, 1, "a", 0.9), (1, 2, "a", 0.8), (1, 3, "b", 0.5), (1, 4, "a", 0.7), (1, 5, "c", 0.6)],
        "query_id int, rank int, source string, score double",
    )
    assert [r["rank"] for r in rk.diversify(df, 4).orderBy("div_rank").collect()] == [1, 3, 5, 2]


def test_scope_suffixes_for_lists_of_any_length(spark):
    hits = spark.createDataFrame([(1, "docs/a.txt"), (1, "b.txt"), (2, "a.txt"), (3, "any")], "query_id int, source string")
    long = [(2, f"x/{i}/a.txt") for i in range(60)]
    sc = spark.createDataFrame([(1, "C:\\Docs\\A.txt")] + long, "query_id int, path string")
    got = sorted((r.query_id, r.source) for r in rk.scope_filter(hits, sc).collect())
    assert got == [(1, "docs/a.txt"), (2, "a.txt"), (3, "any")]


def test_variants_of_a_chinese_query(spark):
    q = spark.createDataFrame([(1, "张三丰的武当剑法技术如何")], "query_id int, text string")
    got = [r.variant for r in rk.query_variants(q).orderBy("ord").collect()]
    assert got[0] == "张三丰的武当剑法技术如何"
    assert "张三丰" in got and "关于张三丰" in got and any(" " in g for g in got)
    assert "张三丰的武当剑法科技如何" in got and "张三丰的武当剑法工程技术如何" in got
    short = spark.createDataFrame([(1, "spark")], "query_id int, text string")
    assert [r.variant for r in rk.query_variants(short).orderBy("ord").collect()] == ["spark", "spark 管理", "spark 系统", "spark 方案"]


def test_admission_by_keyword_in_source(spark):
    hits = spark.createDataFrame([(1, 1, 0.01, "docs/财务报告.txt", "t"), (1, 2, 0.02, "x", "u"), (2, 1, 0.01, "x", "v")], "query_id int, rank int, score double, source string, text string")
    q = spark.createDataFrame([(1, "财务报告 在哪里"), (2, "abc")], "query_id int, text string")
    got = {(r.query_id, r["rank"]): (round(r.threshold, 3), r.admitted) for r in ci.admit(hits, q).collect()}
    assert got == {(1, 1): (0.1, True), (1, 2): (0.1, False), (2, 1): (0.0, True)}


def test_dedupe_keeps_first_on_equal_scores(spark):
    df = spark.createDataFrame(
        [(1, 1, "same", "a", 0.5, "first"), (1, 2, "same", "a", 0.5, "second"), (1, 3, "same", "b", 0.9, "third")],
        "query_id int, pos int, content string, file_path string, score double, file_name string",
    ).withColumn("url", F.lit(None).cast("string")).withColumn("page_number", F.lit(None).cast("int"))
    got = [(r.pos, r.file_name) for r in ci.dedupe_citations(df).orderBy("pos").collect()]
    assert got == [(1, "third"), (2, "first")]


def test_grounding_states(spark):
    df = spark.createDataFrame([(1, "a [1][2]", 2), (2, "none", 2), (3, "[9] [1]", 2), (4, "", 2), (5, "[9]", 0)], "id int, answer string, n_sources int")
    got = {r.id: (r.status, r.retry) for r in ci.grounding(df).collect()}
    assert got == {1: ("ok", False), 2: ("missing_citations", False), 3: ("invalid_citations", True), 4: ("ok", False), 5: ("ok", False)}


def test_align_fills_drops_and_casts(spark):
    want = spark.createDataFrame([], "id long, m struct<a:string,b:int,flag:boolean>, tags array<string>, items array<struct<x:int,y:string>>").schema
    df = spark.createDataFrame([("7", ("z", True), [(1,)])], "id string, m struct<a:string,other:boolean>, items array<struct<x:int>>")
    r = st.align_to(df, want).first()
    assert (r.id, r.m.a, r.m.b, r.m.flag, r.tags, r["items"][0].x, r["items"][0].y) == (7, "z", None, False, [], 1, None)


def test_vector_length_is_checked(spark):
    df = spark.createDataFrame([("t", {"k": "v"}, [1.0, 2.0])], "text string, metadata map<string,string>, vector array<double>")
    assert st.to_chunk_schema(df, 2).first().metadata.extra == '{"k":"v"}'
    bad = st.to_chunk_schema(df, 3).first()
    assert bad.vector is None and not bad.vector_ok and st.to_chunk_schema(df, 2).first().vector_ok


def test_scopes_equal_endswith_both_ways(spark):
    """Paths that end with each other at a slash, inside a part, or as bare names."""
    import random

    from corpuslake.operators import ranking as rk

    rng = random.Random(3)
    part = lambda: rng.choice(["a", "ba", "aba", "x.md", "ax.md", "dir"])
    path = lambda: rng.choice(["", "/"]) + "/".join(part() for _ in range(rng.randint(1, 4)))
    rows = [(q, i, path()) for q in range(6) for i in range(25)] + [(0, 99, None), (1, 99, "")]
    scopes = [(q, path()) for q in range(5) for _ in range(4)] + [(2, "X.MD"), (3, "dir\\a")]
    df = spark.createDataFrame(rows, "query_id long, doc_id long, source string")
    asked = spark.createDataFrame(scopes, "query_id long, path string")
    norm = lambda p: (p or "").strip().lower().replace("\\", "/")

    def inside(q, source):
        mine = [norm(p) for n, p in scopes if n == q]
        return not mine or any(norm(source).endswith(p) or p.endswith(norm(source)) for p in mine)

    got = sorted((r["query_id"], r["doc_id"]) for r in rk.scope_filter(df, asked).collect())
    assert got == sorted((q, i) for q, i, source in rows if inside(q, source))


def test_a_source_filter_reaches_the_scan(spark):
    from corpuslake.functions.scale import shared_dir
    from corpuslake.operators import vectors as vx

    path = f"{shared_dir(spark)}/vectors"
    rows = [(i, [float(i), 1.0], f"Dir\\File{i}.txt") for i in range(50)]
    vx.with_norm(spark.createDataFrame(rows, "vec_id long, embedding array<double>, source string")).write.parquet(path)
    stored = vx.filter_vectors(spark.read.parquet(path), sources=["dir/file7.txt", "dir/file8.txt"])
    assert sorted(r["vec_id"] for r in stored.collect()) == [7, 8]
    plan = stored._jdf.queryExecution().executedPlan().toString()
    assert "In(source_norm" in plan.split("PushedFilters:")[1]


def test_scopes_of_many_rows_are_not_broadcast(spark):
    """Repeated paths take few bytes in files, so their stored size must not decide."""
    from corpuslake.functions.scale import materialise

    paths = spark.range(300_000).select((F.col("id") % 300).alias("query_id"), F.concat(F.lit("dir/"), (F.col("id") / 300).cast("int"), F.lit(".txt")).alias("path"))
    scopes = materialise(paths.repartition(1).sortWithinPartitions("path"), "scopes")
    hits = spark.createDataFrame([(1, "x/dir/5.txt"), (1, "dir/2000.txt"), (400, "y")], "query_id long, source string")
    out = rk.scope_filter(hits, scopes)
    plan = out._jdf.queryExecution().executedPlan().toString()
    joins = [x for x in plan.splitlines() if "BroadcastHashJoin" in x and ("_key" in x or "_p#" in x)]
    assert not joins
    assert sorted(map(tuple, out.collect())) == [(1, "x/dir/5.txt"), (400, "y")]


def test_distances_are_held_for_few_queries_at_once():
    import tracemalloc

    rng = np.random.default_rng(3)
    q, v = vx.unit_rows(rng.normal(size=(300, 8))), vx.unit_rows(rng.normal(size=(40_000, 8)))
    tracemalloc.start()
    at, ids, dist = vx.nearest_rows(q, np.arange(len(v)), v, 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6  # 96 MB would be the distances of all 300 queries alone
    best = np.argsort(np.round(1 - q[299] @ v.T, vx.DIST_DIGITS), kind="stable")[:5]
    assert sorted(ids[at == 299]) == sorted(best) and len(dist) == 1500
