import math
import re

import pyarrow as pa
from pyspark.sql import functions as F

from corpuslake.functions import text as tx
from corpuslake.functions.scale import contains_join, skew_safe_lag
from corpuslake.operators import lexical as lx
from corpuslake.operators import textstats as ts


def one(spark, col, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values))
    return df.select(col.alias("x")).first()["x"]


def test_tokens_latin_digits_and_cjk_runs(spark):
    got = one(spark, tx.index_tokens("t"), t="The abc123 state-of-art 数据库 7 42 与")
    assert sorted(got) == sorted(["abc123", "state-of-art", "数据", "据库", "数据库", "数据库", "123", "42"])


def test_long_cjk_run_gives_grams_up_to_four_and_the_run(spark):
    got = one(spark, tx.index_tokens("t"), t="机器学习法")
    assert sorted(got) == sorted(["机器", "器学", "学习", "习法", "机器学", "器学习", "学习法", "机器学习", "器学习法", "机器学习法"])


def test_script_rules(spark):
    for text, want in [("中文ab", "en"), ("中文字a", "zh"), ("12 !", "mixed"), ("abc", "en"), ("中", "zh")]:
        assert one(spark, tx.script_of("t"), t=text) == want


def test_trim_knows_ideographic_space_and_norm_path(spark):
    assert one(spark, tx.trim_ws("t"), t="\u3000 a b\ufeff\n") == "a b"
    assert one(spark, tx.norm_path("t"), t=" C:\\Docs\\A.TXT ") == "c:/docs/a.txt"


def test_bm25_against_plain_python(spark):
    docs = {1: "red fox red", 2: "blue fox", 3: "green cat with hat", 4: "foxes run"}
    ddf = spark.createDataFrame([(i, t, "s") for i, t in docs.items()], "doc_id long, text string, source string")
    qdf = spark.createDataFrame([(9, "red fox fox")], "query_id long, text string")
    for partial in (False, True):
        got = {r.doc_id: r.score for r in lx.bm25(lx.build_index(ddf), qdf, 10, partial).collect()}
        toks = {i: [w for w in re.findall("[a-z]+", t + " s") if len(w) > 1 and w not in ("with",)] for i, t in docs.items()}
        n, avg = len(toks), sum(map(len, toks.values())) / len(toks)
        want = {}
        for i, words in toks.items():
            s = 0.0
            for q in ["red", "fox", "fox"]:
                df = sum(q in w for w in toks.values())
                weight = math.log((n - df + 0.5) / (df + 0.5) + 1) if df else math.log(n + 1)
                tf = words.count(q)
                if not tf and partial and any(q in w or w in q for w in words):
                    tf = 1
                if tf:
                    s += weight * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(words) / avg))
            if s > 0:
                want[i] = s
        assert got.keys() == want.keys()
        assert all(abs(got[i] - want[i]) < 1e-9 for i in want)
    assert 4 in want  # "foxes" only matches in part


def test_keywords_expand_in_both_directions(spark):
    q = spark.createDataFrame([(1, "什么是向量数据库?"), (2, "RAG overview 12")], "query_id int, text string")
    got = {}
    for r in lx.expand_keywords(q).orderBy("query_id", "ord").collect():
        got.setdefault(r.query_id, []).append(r.keyword)
    assert got[1][:2] == ["向量数据库", "vector"]
    assert "database" in got[1] and "SQL" in got[1]
    assert got[2][0] == "RAG" and "检索" in got[2] and "overview" not in got[2] and "12" not in got[2]


def test_filename_tiers(spark, rows):
    docs = spark.createDataFrame(
        [(1, "alpha only", "d/x.txt"), (2, "nothing", "d/Beta.txt"), (3, "alpha gamma", "d/y.txt"), (4, "none", "d/z.txt")],
        "doc_id long, text string, source string",
    )
    kw = spark.createDataFrame([(7, i, k) for i, k in enumerate(["Alpha", "beta", "gamma"])], "query_id long, ord int, keyword string")
    got = lx.filename_search(docs, kw, 10)
    assert rows(got, "doc_id", "tier", "rank") == [(1, 3, 3), (2, 1, 1), (3, 2, 2)]
    assert rows(lx.filename_search(docs, kw, 2), "doc_id") == [(2,), (3,)]
    assert rows(lx.matched_keywords(docs, kw), "keyword") == [("beta",)]


def test_contains_join_equals_brute_force(spark):
    hay = ["abcabc", "x", "日本語テキスト", "aab", "cab\ncab", ""]
    needles = ["a", "ab", "abca", "本語", "cab", "b\nc", "zz", "x", "日本語テキスト"]
    h = spark.createDataFrame(list(enumerate(hay)), "i int, t string")
    n = spark.createDataFrame([(x,) for x in needles], "k string")
    want = sorted((i, k) for i, t in enumerate(hay) for k in needles if k in t)
    for side in ("needles", "hay"):
        got = sorted((r.i, r.k) for r in contains_join(h, "t", n, "k", small_side=side, min_len=1).collect())
        assert got == want


def test_skew_safe_lag_crosses_buckets(spark):
    data = [(1, p, p * 10) for p in (0, 1, 5, 6, 17, 30, 31)] + [(2, 3, 7)]
    df = spark.createDataFrame(data, "k int, pos long, v int")
    got = {(r.k, r.pos): r.before for r in skew_safe_lag(df, ["k"], "pos", {"v": "before"}, width=4).collect()}
    assert got == {(1, 0): None, (1, 1): 0, (1, 5): 10, (1, 6): 50, (1, 17): 60, (1, 30): 170, (1, 31): 300, (2, 3): None}


def test_garbled_length_and_patterns(spark):
    bad49, bad50 = "!" * 4 + "a" * 45, "!!!!!" + "a" * 45
    assert one(spark, ts.is_garbled(F.col("t")), t=bad49) is False
    assert one(spark, ts.is_garbled(F.col("t")), t=bad50) is True
    assert one(spark, ts.is_garbled(F.col("t")), t="!" + "#" + "!" + "%" + "a" * 46) is True
    assert one(spark, ts.is_garbled(F.col("t")), t=".,-;" * 12 + "ab") is True
    assert one(spark, ts.is_garbled(F.col("t")), t="plain words " * 5) is False


def test_feedback_terms_use_both_scripts(spark, rows):
    docs = spark.createDataFrame([(1, "很好的系统 Fast fast go"), (2, "坏的例子文本，一二")], "doc_id int, text string")
    lab = spark.createDataFrame([(1, 1), (2, 0)], "doc_id int, quality int")
    assert rows(ts.feedback_terms(docs, lab), "label", "term") == [
        ("irrelevant", "坏的例子文本"), ("relevant", "fast"), ("relevant", "很好的系"),
    ]


def test_reasoning_and_steps(spark):
    t = "a<think> x [STEP:1:T:loading:I]one[/STEP]</think>b<think>[STEP:1:T:done:I] two [/STEP]"
    df = ts.split_reasoning(spark.createDataFrame([(1, 2, t), (1, 3, "plain")], "conv_id int, turn int, text string"))
    r = {x.turn: x for x in df.collect()}
    assert r[2].answer == "ab" and r[3].reasoning is None and r[3].answer == "plain"
    s = ts.steps(df).collect()
    assert [(x.id, x.status, x.content) for x in s] == [("1", "done", "two")]


def test_filename_search_cuts_in_the_scan(spark, rows, monkeypatch):
    """Each task hands on no more rows of a query than its depth; repeated ids and several passes change nothing."""
    docs = spark.createDataFrame([(i % 90, f"alpha beta text {i}", f"d/gamma{i}.txt" if i % 7 == 0 else f"d/{i}.txt") for i in range(100)], "doc_id long, text string, source string")
    kws = [(1, 0, "Alpha"), (1, 1, "beta"), (1, 2, "gamma"), (2, 0, "alpha"), (3, 0, "gamma"), (3, 1, "none"), (4, 0, "absent")]
    kw = spark.createDataFrame(kws, "query_id long, ord int, keyword string")

    def plain(depth):
        out = []
        for q in range(1, 5):
            words, found = [w.lower() for a, _, w in kws if a == q], []
            for d in range(90):
                mine = [i for i in range(100) if i % 90 == d]
                names = sum(w in (f"gamma{i}.txt" if i % 7 == 0 else f"{i}.txt") for i in mine for w in words)
                texts = sum(w in f"alpha beta text {i}" for i in mine for w in words)
                if names or texts:
                    found.append((1 if names else 2 if texts >= max(2, -(-len(words) // 2)) else 3, d))
            out += [(q, d, t, r) for r, (t, d) in enumerate(sorted(found)[:depth], 1)]
        return sorted(out)

    assert rows(lx.filename_search(docs, kw, 5), "query_id", "doc_id", "tier", "rank") == plain(5)
    depths = spark.createDataFrame([(1, 200), (2, 3), (3, 1), (4, 1)], "query_id long, fetch_k long")
    want = [r for r in plain(200) if r[3] <= {1: 200, 2: 3, 3: 1, 4: 1}[r[0]]]
    monkeypatch.setattr(lx, "KEYWORD_BYTES", 60)
    monkeypatch.setattr(lx, "KEEP_ROWS", 20)
    assert rows(lx.filename_search(docs, kw, depths), "query_id", "doc_id", "tier", "rank") == want
    seen, cut = [], lx.cut
    monkeypatch.setattr(lx, "cut", lambda found, *a: seen.append(found) or cut(found, *a))
    lx.filename_search(docs.repartition(2), kw, 5)
    tasks = seen[0].rdd.getNumPartitions()
    assert seen[0].count() <= 4 * 5 * tasks
    assert "Generate" not in seen[0]._jdf.queryExecution().executedPlan().toString()


def test_variant_hits_are_never_broadcast(spark, monkeypatch, rows):
    """Their files are far below Spark's bound; beyond the checked bound of documents the shuffle join stays."""
    from corpuslake.functions import scale
    from corpuslake.operators import blocks

    docs = spark.createDataFrame([(i, f"red fox {i % 3}", "d") for i in range(40)], "doc_id long, text string, source string")
    variants = spark.createDataFrame([(q, o, t) for q in range(4) for o, t in enumerate(["red fox", "fox"])], "query_id long, ord int, text string")
    index, seen, cut = blocks.build(docs), [], lx.cut
    monkeypatch.setattr(lx, "cut", lambda found, *a: seen.append(found) or cut(found, *a))

    def joins():
        want = rows(lx.bm25_multi(index, variants, docs, 5), "query_id", "doc_id", "rank")
        plan = seen[-1]._jdf.queryExecution().executedPlan().toString()
        return want, plan.count("SortMergeJoin"), plan.count("BroadcastHashJoin")

    small = joins()
    monkeypatch.setattr(lx, "is_small", lambda df: scale.is_small(df, 2))
    large = joins()
    assert small == (large[0], 0, 2) and large[1:] == (2, 0)


def test_trim_takes_every_blank_of_the_class_without_a_scan_of_the_text(spark):
    blanks = tx.WS_CHARS
    assert re.fullmatch(f"[{tx.WS}]+", blanks) and len(blanks) == sum(bool(re.match(f"[{tx.WS}]", chr(i))) for i in range(0x10000))
    df = spark.createDataFrame([(f"{blanks}a {blanks}b.{blanks}",), (blanks,), ("",), (None,), ("数\u00e9",)], "t string").select(tx.trim_ws("t").alias("x"))
    assert [r.x for r in df.collect()] == [f"a {blanks}b.", "", "", None, "数\u00e9"]
    assert "regexp" not in df._jdf.queryExecution().optimizedPlan().toString().lower()


def test_tokens_of_arrow_batches_equal_the_column(spark):
    """The tokens that indexes and the default encoder count in Arrow batches are those of ``index_tokens``, on odd texts too."""
    import hashlib
    from collections import Counter

    from corpuslake.functions import fixed_values as fv
    from corpuslake.functions.text import flat_tokens, index_tokens
    from corpuslake.functions.vectors import hashed_bag_encoder
    from corpuslake.operators import blocks

    texts = [
        "The cat-9 sat a1 x 42 7 007 and-or", "", None, "a b c 1 2", "中文检索 的 和平 一", "前a中文b的了", "İstanbul Kelvin ΣΟΣ straße",
        "-x --ab a--b 9ab9 ab\ncd\x00ef", "\U00020000中\U00020001文字", "the of 的", "word " * 5_000, "É é ﬁne １２３ ٣٤",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = df.select("doc_id", F.lower("text").alias("low"), index_tokens("text").alias("t"), hashed_bag_encoder()(F.col("text")).alias("e")).collect()
    tokens, owner = flat_tokens(pa.array([None] + [r["low"] for r in rows])[1:])
    for i, r in enumerate(rows):
        want = Counter(r["t"] or [])
        assert Counter(t for t, o in zip(tokens.to_pylist(), owner) if o == i and t not in fv.INDEX_STOP_WORDS) == want
        bag = [0.0] * 64
        for t, n in want.items():
            bag[int(hashlib.md5(t.encode()).hexdigest()[:6], 16) % 64] += n
        norm = sum(x * x for x in bag) ** 0.5
        assert list(r["e"]) == [x / norm if norm else 0.0 for x in bag]
    counted = {r["doc_id"]: r for r in blocks.forward(df, source_col=None).collect()}
    for r in rows:
        got = counted[r["doc_id"]]
        assert {c["term"]: c["tf"] for c in got["counts"]} == Counter(r["t"] or []) and got["doc_len"] == len(r["t"] or [])
    assert {f.dataType.simpleString() for f in df.select(hashed_bag_encoder()(F.col("text"))).schema} == {"array<double>"}


def test_index_of_query_terms_holds_a_shard_of_texts_at_a_time(spark, monkeypatch, tmp_path):
    """A Python worker gets ``SHARD`` documents at most in a batch; it used to get as many as Arrow's own bound allows."""
    from corpuslake.operators import blocks

    made, seen = blocks._asked_blocks, str(tmp_path)

    def counting(shared):
        run = made(shared)

        def watch(batches):
            for b in batches:
                open(f"{seen}/{len(b)}", "w").close()
                yield from run(iter([b]))

        return watch

    monkeypatch.setattr(blocks, "_asked_blocks", counting)
    docs = spark.range(5_000).select(F.col("id").alias("doc_id"), F.lit("alpha beta").alias("text"), F.lit("s").alias("source")).coalesce(1)
    index = blocks.ad_hoc(docs, spark.createDataFrame([(1, "alpha")], "query_id long, text string"))
    assert 0 < max(int(p.name) for p in tmp_path.iterdir()) <= blocks.SHARD
    assert index.stats.select("n_docs", "avg_len", "shards").first() == (5_000, 2.0, 3)
    assert index.terms.select("term", "df").collect() == [("alpha", 5_000)]



def test_texts_are_encoded_where_they_are_compared(spark, rows):
    """k-NN over texts is k-NN over their vectors; a task takes one Python worker for both, not two."""
    from corpuslake.operators import vectors as vx

    docs = spark.createDataFrame([(i, f"alpha w{i % 7} w{i % 11} beta" if i % 5 else None) for i in range(60)], "doc_id long, text string")
    asked = vx.embed(spark.createDataFrame([(1, "alpha w3"), (2, ""), (3, "w5 w6 beta")], "query_id long, text string"))
    got = vx.knn(docs, asked, 9, id_col="doc_id", text_col="text")
    assert rows(got) == rows(vx.knn(vx.embed(docs), asked, 9, id_col="doc_id"))
    assert "ArrowEvalPython" not in got._jdf.queryExecution().executedPlan().toString()


def test_name_search_counts_blocks_of_documents(spark, rows, monkeypatch):
    """Keywords are counted for many documents at once; however few counts are held, tiers stay those of each document (all rows of its id)."""
    words = ["ab", "b", "cd", "zz", "AB"]
    docs = spark.createDataFrame(
        [(i % 37, "".join(w for j, w in enumerate(["ab", "x", "cd", "b", "q"]) if (i >> j) & 1) or None, f"d/{'zz' if i % 9 == 0 else 'n'}{i}.txt") for i in range(45)],
        "doc_id long, text string, source string",
    ).coalesce(2)
    asked = spark.createDataFrame([(q, w) for q in range(6) for j, w in enumerate(words) if (q + j) % 3], "query_id long, keyword string")
    parts, keywords = {}, {}
    for r in docs.collect():
        parts.setdefault(r["doc_id"], []).append((r["source"].split("/")[-1].lower(), (r["text"] or "").lower()))
    for r in asked.collect():
        keywords.setdefault(r["query_id"], []).append(r["keyword"].lower())
    want = []
    for q, kws in keywords.items():
        found = []
        for d, some in parts.items():
            name, text = (sum(w in x[i] for w in kws for x in some) for i in (0, 1))
            tier = 1 if name else 2 if text >= max(2, len(kws) / 2) else 3 if text else None
            found += [(tier, d)] if tier else []
        want += [(q, d, t, i + 1) for i, (t, d) in enumerate(sorted(found)[:30])]
    for most in (1 << 20, 13):
        monkeypatch.setattr(lx, "COUNTS_AT_ONCE", most)
        assert rows(lx.filename_search(docs, asked, 30)) == sorted(want)
