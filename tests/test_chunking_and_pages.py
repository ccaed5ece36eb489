import random
import re

import pyarrow as pa
from pyspark.sql import functions as F

from corpuslake.operators import chunking as ck
from corpuslake.operators import pages as pg


def docs(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def test_block_types_levels_and_offsets(spark):
    text = "# H\npara one\nline two\n\n- a\n  - b\n\n> q\n---\n| a |\n```py\nx\n\n```\n第一章 总则\n一、小节\n(1) 点\n1. Numbered\n1. sentence。\n```\nopen"
    got = ck.blocks(docs(spark, text)).orderBy("block_no").collect()
    kinds = [(b.type, b.level) for b in got]
    assert kinds == [
        ("heading", 1), ("paragraph", None), ("list", 1), ("quote", None), ("separator", None), ("table", None), ("code", None),
        ("heading", 1), ("heading", 2), ("heading", 3), ("heading", 3), ("list", 1), ("code", None),
    ]
    assert got[1].content == "para one\nline two" and got[6].lang == "py"
    assert (got[0].start, got[0].end) == (0, 4) and (got[1].start, got[1].end) == (4, 22)
    code = text.index("```py")
    assert got[6].start == code and got[6].end == text.index("```\n第")
    assert got[-1].end == len(text) + 1


def plain_pack(blocks, top, least):
    """Independent restatement: merge prose, then pack."""
    merged, cur = [], None
    for b in blocks:
        if b["type"] in ("heading", "code", "table", "list", "separator") or b["big"]:
            if cur:
                merged.append(cur)
                cur = None
            if b["type"] != "separator":
                merged.append(b)
        elif cur is None:
            cur = dict(b)
        elif len(cur["content"]) + len(b["content"]) + 2 <= top:
            cur["content"] += "\n\n" + b["content"]
            cur["end"] = b["end"]
        else:
            merged.append(cur)
            cur = dict(b)
    if cur:
        merged.append(cur)
    out, texts, kinds, start, last = [], [], [], 0, 0

    def flush(end):
        nonlocal texts, kinds, start
        if not texts:
            return
        body = "\n\n".join(texts).strip()
        if len(body) >= least or "heading" in kinds:
            out.append((body, list(dict.fromkeys(kinds)), start, end))
        texts, kinds, start = [], [], end

    for b in merged:
        if b["big"]:
            flush(b["start"])
            out.append((b["content"], [b["type"]], b["start"], b["end"]))
            start = last = b["end"]
            continue
        if texts and (b["type"] in ("heading", "code", "table") or sum(map(len, texts)) + len(b["content"]) > top):
            flush(b["start"])
        texts.append(b["content"])
        kinds.append(b["type"])
        last = b["end"]
    flush(last)
    return out


def test_packing_equals_plain_python(spark):
    rnd = random.Random(3)
    lines = ["# head", "", "", "word " * 6, "- item one", "> quoted words", "---", "| a | b |", "```", "Long sentence here. " * 9, "中文句子。" * 12]
    texts = ["\n".join(rnd.choice(lines) for _ in range(rnd.randint(1, 25))) for _ in range(60)]
    pieces = ck.split_oversize(ck.blocks(docs(spark, *texts)), 120, 30)
    rows = pieces.orderBy("doc_id", "block_no", "piece_no").collect()
    got = {}
    for c in ck.pack_blocks(pieces, 120, 30, drop_short=True).orderBy("doc_id", "chunk_no").collect():
        got.setdefault(c.doc_id, []).append((c.content, list(c.block_types), c.start, c.end))
    for d in range(len(texts)):
        mine = [dict(type=r.type, content=r.content, start=r.start, end=r.end, big=r.oversize) for r in rows if r.doc_id == d]
        assert got.get(d, []) == plain_pack(mine, 120, 30)


def test_cut_text_prefers_sentences_then_hard_cuts():
    assert ck.cut_text("One two. Three four. Five", 21, 5) == ["One two. Three four.", "Five"]
    assert ck.cut_text("a" * 25, 10, 3) == ["a" * 10, "a" * 10, "a" * 5]
    assert ck.cut_text("句子一。句子二。尾", 8, 2) == ["句子一。句子二。", "尾"]
    # a border at or before the minimum does not count
    assert ck.cut_text("a, bcdefghijkl", 8, 5) == ["a, bcdef", "ghijkl"]


def test_overlap_rules(spark):
    c = spark.createDataFrame(
        [(1, 0, "First part. Second tail"), (1, 1, "next"), (1, 2, "完整一句。"), (1, 3, "end"), (2, 0, "same"), (2, 1, "same again")],
        "doc_id int, chunk_no int, content string",
    )
    got = {(r.doc_id, r.chunk_no): r.content for r in ck.add_overlap(c, 15).collect()}
    assert got[(1, 1)] == "[...] Second tail\n\nnext"
    assert got[(1, 2)] == "[...] next\n\n完整一句。"
    assert got[(1, 3)] == "end"  # the previous chunk ends in a full stop
    assert got[(2, 1)] == "same again"  # already a prefix


def test_fixed_pieces_join_back_and_recursive_bounds(spark):
    text = "Alpha beta. Gamma! " * 40 + "\n\n" + "delta " * 90
    parts = ck.split_fixed(docs(spark, text, ""), 97).orderBy("chunk_no").collect()
    assert "".join(p.content for p in parts) == text
    chunks = ck.split_text(text, 100, 20, ck.SEPARATORS)
    assert max(map(len, chunks)) <= 100
    assert set(re.findall(r"\w+", " ".join(chunks))) == set(re.findall(r"\w+", text))


def test_sentences_pack_to_the_limit(spark):
    got = ck.split_sentences(docs(spark, "a b c. d e! f g h i? 中文。tail"), 5).orderBy("chunk_no").collect()
    assert [(g.content, g.n_tokens) for g in got] == [("a b c. d e!", 5), ("f g h i?", 4), ("中文。tail", 4)]
    assert "".join(g.content.replace(" ", "") for g in got) == "abc.de!fghi?中文。tail"


def test_map_reduce_may_use_ten_pieces(spark):
    out = ck.map_reduce(docs(spark, "x" * 50_000, "short", ""), lambda c: F.length(c).cast("string"), max_pieces=10).orderBy("doc_id").collect()
    assert [o.n_pieces for o in out] == [10, 1, 1]
    assert out[0].result.count("4000") == 10 and out[1].result == "5"


def one(spark, col, value):
    return spark.createDataFrame([(value,)], "h string").select(col.alias("x")).first()["x"]


def test_noise_and_main_content(spark):
    body = "w" * 150
    html = f'<body><nav>n</nav><!-- c --><div class="shadow">gone</div><article><p>{body}</p></article><footer>f</footer></body>'
    assert one(spark, pg.without_noise(F.col("h")), html) == f"<body><article><p>{body}</p></article></body>"
    assert "gone" in one(spark, pg.without_noise(F.col("h"), True), html)
    df = pg.main_content(spark.createDataFrame([(1, html), (2, "<body>tiny</body>"), (3, "bare")], "page_id int, html string"))
    got = {r.page_id: (r.content, r.selector) for r in df.collect()}
    assert got == {1: (f"<p>{body}</p>", 0), 2: ("tiny", None), 3: ("bare", None)}


def test_entities(spark):
    text = "&amp;lt; &LT;b&gt; &#65;&#x4E2D;&#20013; &unknown; A&amp;B &hellip;"
    assert one(spark, pg.decode_entities(F.col("h")), text) == "&lt; <b> A中中   A&B …"


def test_meta_orders_and_fallbacks(spark):
    html = (
        "<title> </title><meta property='og:title' content='Og &amp; T'><meta content='D1' name='description'>"
        "<meta name='keywords' content='a, b，c,'><time datetime='2020-01-01'><meta name='author' content='Me'>"
    )
    r = pg.page_meta(spark.createDataFrame([(1, html)], "page_id int, html string")).first()
    assert (r.title, r.description, r.keywords, r.publish_date, r.author) == ("Og & T", "D1", ["a", "b", "c"], "2020-01-01", "Me")


def test_links_resolve(spark):
    hrefs = ["/a", "b/./c", "../up", "//cdn.x.com/z", "?q=1", "mailto:x", "javascript:y", "#f", "https://o.com/p", "/a", "ftp://no", "/für x"]
    html = "".join(f'<a href="{h}">t</a>' for h in hrefs)
    df = spark.createDataFrame([(1, "http://Site.com/d/e?k=1", html)], "page_id int, url string, html string")
    got = [r.url for r in pg.outlinks(df).orderBy("ord").collect()]
    assert got == [
        "http://site.com/a", "http://site.com/d/b/c", "http://site.com/up", "http://cdn.x.com/z", "http://site.com/d/e?q=1",
        "https://o.com/p", "http://site.com/f%C3%BCr%20x",
    ]
    many = "".join(f'<a href="/{i}">t</a>' for i in range(150))
    assert pg.outlinks(spark.createDataFrame([(1, "http://s.com/", many)], "page_id int, url string, html string")).count() == 150


def test_dispatch_kinds(spark):
    raw = spark.createDataFrame(
        [
            ("http://a/x.json", "application/json", '{"b":[1.0,2.5],"a":"é"}'),
            ("http://a/bad.json", "application/json", "{oops"),
            ("http://a/x.md", "text/html", "# T"),
            ("http://a/x", "text/xml", "<?xml v?><r><![CDATA[in]]></r>"),
            ("http://a/%E4%B8%AD.txt", "text/plain", "p"),
            ("http://a/i.png", "image/png", "x"),
        ],
        "url string, content_type string, body string",
    )
    got = {r.url: (r.kind, r.title, r.text) for r in pg.extract_by_type(raw).collect()}
    assert got["http://a/x.json"] == ("json", "JSON: http://a/x.json", '{\n  "b": [\n    1,\n    2.5\n  ],\n  "a": "é"\n}')
    assert got["http://a/bad.json"] == ("json", "http://a/bad.json", "{oops")
    assert got["http://a/x.md"] == ("markdown", "x.md", "# T")
    assert got["http://a/x"] == ("xml", "XML: http://a/x", "in")
    assert got["http://a/%E4%B8%AD.txt"] == ("plain", "中.txt", "p")
    assert len(got) == 5


def test_packing_loses_no_text(spark):
    texts = ["short", "# head\n\nbody " + "x" * 40 + "\n\n---\n\ntiny", "tiny\n\n```\n" + "y" * 90 + "\n```\n\nend", "word " * 90 + "\n\nlast"]
    pieces = ck.split_oversize(ck.blocks(docs(spark, *texts)), 120, 30)
    whole = {}
    for r in pieces.where("type <> 'separator'").orderBy("doc_id", "block_no", "piece_no").collect():
        whole[r.doc_id] = whole.get(r.doc_id, "") + "".join(r.content.split())
    packed = {}
    for c in ck.pack_blocks(pieces, 120, 30).orderBy("doc_id", "chunk_no").collect():
        packed[c.doc_id] = packed.get(c.doc_id, "") + "".join(c.content.split())
    assert packed == whole


def test_cut_text_equals_the_slow_rule():
    import re

    def slow(text, size, least):
        out = []
        while len(text) > size:
            zh = len(re.findall("[一-龥]", text)) > len(re.findall("[a-zA-Z]", text))
            at = 0
            for border in ck.BORDERS_ZH if zh else ck.BORDERS_EN:
                at = max((m.end() for m in border.finditer(text) if m.end() <= size), default=0)
                if at > least:
                    break
            else:
                at = size
            out.append(text[:at].strip())
            text = text[at:].strip()
        return out + [text] if text or not out else out

    rnd = random.Random(5)
    for _ in range(3000):
        text = "".join(rnd.choice(["a", "bc", "中", "。", ". ", "; ", ", ", " ", "  ", "\n", "！"]) for _ in range(rnd.randint(0, 60)))
        assert ck.cut_text(text, 12, 4) == slow(text, 12, 4), text


def test_no_cap_on_links_pieces_and_keywords(spark):
    from corpuslake.operators import citations as ci
    from corpuslake.operators import lexical as lx
    from corpuslake.operators import pages as pg

    html = "".join(f'<a href="http://h.org/{i}">x</a>' for i in range(101))
    page = spark.createDataFrame([(1, "http://h.org/", html)], "page_id long, url string, html string")
    assert pg.outlinks(page).count() == 101 and pg.outlinks(page, max_links=100).count() == 100
    long = docs(spark, "y" * 44_000)
    pieces = ck.map_reduce(long, lambda c: c, joiner="").first()
    assert pieces.n_pieces == 11 and len(pieces.result) == 44_000
    head = "z" * 100
    cits = [(1, i, "/a.txt", 1, head + t, 0.5) for i, t in enumerate(("one", "two"))]
    frame = spark.createDataFrame(cits, "query_id int, pos int, file_path string, page_number int, content string, score double")
    frame = frame.selectExpr("*", "cast(null as string) as url", "cast(null as string) as file_name")
    assert ci.dedupe_citations(frame).count() == 2 and ci.dedupe_citations(frame, key_chars=50).count() == 1
    names = spark.createDataFrame([(1, "Some c text", "dir/a7.txt")], "doc_id long, text string, source string")
    kws = spark.createDataFrame([(1, "a", 0), (1, "Z", 1), (1, "TEXT", 2)], "query_id long, keyword string, ord int")
    assert [r["keyword"] for r in lx.matched_keywords(names, kws).collect()] == ["a"]
    assert lx.filename_search(names, kws, 5).first()["tier"] == 1


def test_many_scope_paths_match_by_suffix(spark):
    from corpuslake.operators import ranking as rk

    scope = spark.createDataFrame([(1, f"C:/x/f{i}.txt") for i in range(60)], "query_id int, path string")
    rows = spark.createDataFrame([(1, "f3.txt"), (1, "F59.TXT"), (1, "g.txt"), (2, "g.txt"), (1, None)], "query_id int, source string")
    assert sorted(map(str, (r["source"] for r in rk.scope_filter(rows, scope).collect()))) == ["F59.TXT", "None", "f3.txt", "g.txt"]


def test_sentences_of_odd_blanks_count_as_in_columns(spark):
    """One pass of a text gives the sentences, tokens and trimmed chunks that the column expressions give."""
    from corpuslake.functions.text import extract_all, trim_ws

    texts = [
        "a b. c\u00a0d! \u3000 e\x1cf\x85g? h", "\ufeffx y.\ufeffz", "中文 words 混合。下一句！ tail\u2003end", "...", " \n\t ", "", None,
        "no end", "a.\n\nb?!  c", "\U0001f600 \U0001f600\U0001f600. x", "1\x1f2 3\x0b4.\u180e5\u200b6",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    parts = F.transform(extract_all("text", ck.SENTENCE), lambda s: F.struct(s.alias("s"), ck.token_count(s).alias("n")))
    for most in (1, 3, 512):
        want = []
        for r in df.select("doc_id", parts.alias("p")).collect():
            done, held, n = [], "", 0
            for s, size in r.p or []:
                if n > 0 and n + size > most:
                    done.append((held, n))
                    held, n = "", 0
                held, n = held + s, n + size
            want += [(r.doc_id, c, n) for c, n in [*done, (held, n)]]
        trimmed = spark.createDataFrame(want, "doc_id int, c string, n int").select("doc_id", trim_ws("c").alias("c"), "n").where("c <> ''")
        want = sorted(map(tuple, trimmed.collect()))
        assert sorted((r.doc_id, r.content, r.n_tokens) for r in ck.split_sentences(df, most).collect()) == want
        assert sorted((i, c, n) for i, t in enumerate(texts) for c, n in ck.pack_sentences(t, most)) == want


def test_ingest_gates_once(spark):
    from corpuslake.plans.ingest import ingest

    docs = spark.createDataFrame([(1, "A good text. With words.", "a/1.txt"), (2, "!#!% ### 12", "a/2.txt")], "doc_id long, text string, source string")
    out = ingest(docs)
    assert [(r.source, r.text) for r in out.collect()] == [("a/1.txt", "A good text. With words.")]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("LeftSemi") == 1


def test_latin_letters_are_counted_only_beside_chinese_ones(monkeypatch):
    text = "One sentence here. Another, longer one there; and the rest of it without an end " * 5
    want = ck.cut_text(text, 60, 20)
    monkeypatch.setattr(ck, "EN", None)
    assert ck.cut_text(text, 60, 20) == want and all(len(p) <= 60 for p in want)


def test_blocks_of_a_document_are_read_by_field():
    kind = pa.list_(pa.struct([("type", pa.string()), ("content", pa.string())]))
    rows = [[{"type": "list", "content": "a"}, {"type": "code", "content": None}], None, [], [{"type": "list", "content": "b"}]]
    lists = pa.array([[{"type": "x", "content": "y"}], *rows], kind).slice(1)
    assert ck._block_lists(lists) == [r or [] for r in rows]


def test_more_documents_than_are_packed_at_once(spark, monkeypatch):
    monkeypatch.setattr(ck, "DOCS_AT_ONCE", 2)
    table = ck.split_oversize(ck.blocks(docs(spark, *[f"# H {i}\nbody {i}" for i in range(7)]).coalesce(1)))
    got = {r.doc_id: r.content for r in ck.pack_blocks(table).collect()}
    assert got == {i: f"# H {i}\n\nbody {i}" for i in range(7)}
