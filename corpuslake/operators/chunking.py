"""Documents to chunks: block structure, packing, overlap, sentence and fixed splits.

Windows run over one document's lines or chunks, so their partitions are as
small as the largest document; all steps of the block job share one shuffle.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslake.functions import fixed_values as fv
from corpuslake.functions.text import (
    CJK, WS, count_chars, extension, let, map_value, path_tail, trim_ws,
)

NUMERALS = "一二三四五六七八九十"
NUMBERED_HEADING = (
    rf"^(?:第[{NUMERALS}百千0-9]+[章节篇部]|[{NUMERALS}]+[、.．]|[(（][{NUMERALS}0-9]+[)）]|"
    rf"[0-9]+[.．、][{WS}]*[^0-9])"
)
LIST_LINE = rf"^([{WS}]*)(?:[-*•●○◆◇▪▸►]|[0-9]+[.、)）])[{WS}]+"
RULE_LINE = rf"^[-=_*]{{3,}}[{WS}]*\z"
TABLE_LINE = r"^\|.*\|\z"
HASH_HEADING = rf"^(#{{1,6}})[{WS}]+."


def _line_class(line: Column) -> Column:
    numbered = line.rlike(NUMBERED_HEADING) & (F.length(line) < 100) & ~line.rlike(r"[。！？]\z")
    return (
        F.when(line.rlike(TABLE_LINE), "table")
        .when(line.rlike(HASH_HEADING) | numbered, "heading")
        .when(line.rlike(LIST_LINE), "list")
        .when(trim_ws(line) == "", "blank")
        .when(line.startswith(">"), "quote")
        .when(line.rlike(RULE_LINE), "separator")
        .otherwise("paragraph")
    )


def _heading_level(line: Column) -> Column:
    return (
        F.when(line.rlike(HASH_HEADING), F.length(F.regexp_extract(line, HASH_HEADING, 1)))
        .when(line.rlike("^第.+[章部篇]"), 1)
        .when(line.rlike("^第.+节"), 2)
        .when(line.rlike(rf"^[{NUMERALS}]+[、.．]"), 2)
        .when(line.rlike(rf"^[(（][{NUMERALS}0-9]+[)）]"), 3)
        .when(line.rlike("^[0-9]+[.．、]"), 3)
        .otherwise(1)
    )


def blocks(docs: DataFrame) -> DataFrame:
    """(doc_id, block_no, type, level, lang, content, start, end).

    Lines get a class (code by the parity of fences so far), runs of one class
    become blocks. Headings and rules stand alone, blank lines end a run. Table
    rows after a code fence are tables.
    """
    by_doc = Window.partitionBy("doc_id").orderBy("line_no")
    before = by_doc.rowsBetween(Window.unboundedPreceding, -1)
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    fence = F.col("line").startswith("```")
    df = (
        lines.withColumn("_len", F.length("line") + 1)
        .withColumn("_fence", fence.cast("int"))
        .withColumn("_off", F.coalesce(F.sum("_len").over(before), F.lit(0)))
        .withColumn("_open", F.coalesce(F.sum("_fence").over(before), F.lit(0)) % 2)
    )
    df = df.withColumn(
        "cls",
        F.when((F.col("_fence") == 1) | (F.col("_open") == 1), "code").otherwise(_line_class(F.col("line"))),
    )
    starts = (
        F.when(F.col("cls") == "code", (F.col("_fence") == 1) & (F.col("_open") == 0))
        .when(F.col("cls").isin("heading", "separator"), True)
        .otherwise(~F.col("cls").eqNullSafe(F.lag("cls").over(by_doc)))
    )
    df = df.withColumn("_isle", F.sum(starts.cast("int")).over(by_doc)).where("cls <> 'blank'")
    piece = F.struct("line_no", "line")
    grouped = df.groupBy("doc_id", "_isle").agg(
        F.first("cls").alias("type"),
        F.min(F.struct("line_no", "line")).getField("line").alias("_head"),
        F.array_join(
            F.transform(F.array_sort(F.collect_list(piece)), lambda p: p["line"]), "\n"
        ).alias("_body"),
        F.min("_off").alias("_start"),
        F.max(F.struct("line_no", (F.col("_off") + F.col("_len")).alias("e"))).getField("e").alias("_stop"),
        F.max("_off").alias("_last"),
        F.sum("_fence").alias("_fences"),
    )
    in_order = Window.partitionBy("doc_id").orderBy("_isle")
    stop = F.when((F.col("type") == "code") & (F.col("_fences") == 2), F.col("_last")).otherwise(F.col("_stop"))
    alone = F.col("type").isin("heading", "separator")
    out = grouped.withColumn("end", stop).withColumn("_prev", F.lag("end").over(in_order))
    level = F.when(F.col("type") == "heading", _heading_level(F.col("_head"))).when(
        F.col("type") == "list",
        F.floor(F.length(F.regexp_extract("_head", LIST_LINE, 1)) / 2) + 1,
    )
    return out.select(
        "doc_id",
        F.row_number().over(in_order).alias("block_no"),
        "type",
        level.cast("int").alias("level"),
        F.when(F.col("type") == "code", F.regexp_extract("_head", r"^```(\w*)", 1)).alias("lang"),
        F.when(alone, F.col("_body")).otherwise(trim_ws("_body")).alias("content"),
        F.when(F.col("type") == "paragraph", F.coalesce("_prev", F.lit(0)))
        .otherwise(F.col("_start"))
        .cast("long")
        .alias("start"),
        F.col("end").cast("long").alias("end"),
    )


DEFAULTS = {"min_chars": 100, "max_chars": 2000, "overlap": 100}

# Sentence, clause and word borders tried in order.
BORDERS_ZH = [re.compile(p) for p in (r"[。！？]\s*", r"[；;]\s*", r"[，,]\s*", r"[、]\s*", r"\s+")]
BORDERS_EN = [re.compile(p) for p in (r"[.!?]\s+", r"[;]\s*", r"[,]\s+", r"\s+")]
ZH, EN = re.compile("[一-龥]"), re.compile("[a-zA-Z]")


def cut_text(text: str, size: int, least: int) -> list[str]:
    """Cut one text at the last border of the best kind that fits ``size``; only the next ``size`` characters are looked at."""
    if len(text) <= size:
        return [text]
    zh_left = len(ZH.findall(text))
    en_left = len(EN.findall(text)) if zh_left else 0  # without Chinese characters nothing is compared
    out, at, end = [], 0, len(text)
    while end - at > size:
        stop = at
        for border in BORDERS_ZH if zh_left > en_left else BORDERS_EN:
            # a match that reaches beyond the piece is cut off by the end given here, and so does not fit
            ends = (m.end() for m in border.finditer(text, at, at + size + 1) if m.end() <= at + size)
            stop = max(ends, default=at)
            if stop - at > least:
                break
        else:
            stop = at + size
        piece = text[at:stop]
        if zh_left:
            zh_left, en_left = zh_left - len(ZH.findall(piece)), en_left - len(EN.findall(piece))
        out.append(piece.strip())
        at, end = stop, len(text.rstrip())
        while at < end and text[at].isspace():
            at += 1
    return out + [text[at:end]] if at < end else out


def split_oversize(block_table: DataFrame, max_chars: int = 2000, min_chars: int = 100) -> DataFrame:
    """One row per piece: blocks over ``max_chars`` are cut, others pass through (piece_no 0)."""

    def cut(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else cut_text(t, max_chars, min_chars))

    udf = F.pandas_udf(cut, T.ArrayType(T.StringType()))
    big = F.length("content") > max_chars
    cut_up = udf(F.when(big, F.col("content")))
    return (
        block_table.withColumn("oversize", big)
        .withColumn("_cut", cut_up)
        .select("*", F.posexplode(F.coalesce("_cut", F.array("content"))).alias("piece_no", "_piece"))
        .withColumn("content", F.col("_piece"))
        .drop("_cut", "_piece")
    )


def pack_blocks(
    pieces: DataFrame,
    max_chars: int = 2000,
    min_chars: int = 100,
    keep_lists: bool = True,
    keep_code: bool = True,
    keep_tables: bool = True,
    drop_short: bool = False,
) -> DataFrame:
    """Greedy packing of a document's blocks into chunks.

    Input: the output of ``split_oversize``. Two passes over a document's
    blocks: adjacent prose is merged up to ``max_chars`` (headings, code, tables,
    lists stay whole, rules drop out), then blocks are packed, starting anew at a
    heading, at overflow and before code or tables. A chunk below ``min_chars``
    without a heading joins its neighbour, so no text is lost; ``drop_short``
    drops it instead. Output: doc_id, chunk_no, content, block_types,
    has_heading, heading_text, start, end.
    """
    whole = {"heading"} | {t for t, on in (("code", keep_code), ("table", keep_tables), ("list", keep_lists)) if on}
    fields = F.struct("block_no", "piece_no", "type", "content", "start", "end", "oversize")
    per_doc = pieces.groupBy("doc_id").agg(F.array_sort(F.collect_list(fields)).alias("_b"))

    def run(lists: pa.Array) -> pa.Array:
        out = []
        for at in range(0, len(lists), DOCS_AT_ONCE):
            docs = _block_lists(lists.slice(at, DOCS_AT_ONCE))
            rows = [_pack(_merge_prose(b, whole, max_chars), max_chars, min_chars, drop_short) for b in docs]
            out.append(pa.array(rows, _CHUNKS))
        return pa.concat_arrays(out) if out else pa.array([], _CHUNKS)

    run.__annotations__ = {"lists": pa.Array, "return": pa.Array}
    kind = "array<struct<content:string,block_types:array<string>,has_heading:boolean,heading_text:string,start:bigint,end:bigint>>"
    packed = F.arrow_udf(run, kind).asNondeterministic()
    return per_doc.select("doc_id", F.posexplode(packed("_b")).alias("chunk_no", "c")).select("doc_id", "chunk_no", "c.*")


DOCS_AT_ONCE = 256  # documents whose blocks are Python objects at the same time


def _block_lists(lists: pa.ListArray) -> list[list[dict]]:
    """The blocks of each document, read field by field."""
    flat = lists.flatten()
    names = [f.name for f in flat.type]
    blocks_ = [dict(zip(names, values, strict=True)) for values in zip(*(flat.field(n).to_pylist() for n in names), strict=True)]
    ends = np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).tolist()
    return [blocks_[start:end] for start, end in zip([0, *ends[:-1]], ends, strict=True)]


_CHUNKS = pa.list_(
    pa.struct(
        [("content", pa.string()), ("block_types", pa.list_(pa.string())), ("has_heading", pa.bool_()),
         ("heading_text", pa.string()), ("start", pa.int64()), ("end", pa.int64())]
    )
)
SPACE = re.compile(f"^[{WS}]+|[{WS}]+\\Z")


def _merge_prose(blocks_: list[dict], whole: set[str], most: int) -> list[dict]:
    """Adjacent prose joined up to ``most`` characters; whole and oversize blocks stand alone, rules drop out."""
    out: list[dict] = []
    open_ = None  # the prose block that may still grow, with its parts
    for b in blocks_:
        if b["type"] == "separator" or b["type"] in whole or b["oversize"]:
            open_ = None
            if b["type"] != "separator":
                out.append(dict(b, parts=[b["content"]], n=len(b["content"])))
        elif open_ is not None and open_["n"] + len(b["content"]) + 2 <= most:
            open_["parts"].append(b["content"])
            open_["n"] += len(b["content"]) + 2
            open_["end"] = b["end"]
        else:
            open_ = dict(b, parts=[b["content"]], n=len(b["content"]))
            out.append(open_)
    for b in out:
        b["content"] = "\n\n".join(b.pop("parts"))
    return out


def _pack(blocks_: list[dict], most: int, least: int, drop_short: bool) -> list[dict]:
    """Chunks of merged blocks; a short chunk without heading joins the one before it, else the one behind it."""
    chunks: list[dict] = []
    open_: list[dict] = []
    start = 0

    def flush(end: int) -> None:
        if open_:
            types = list(dict.fromkeys(b["type"] for b in open_))
            headings = [SPACE.sub("", re.sub(f"^#+[{WS}]*", "", b["content"])) for b in open_ if b["type"] == "heading"]
            chunks.append(
                {"content": SPACE.sub("", "\n\n".join(b["content"] for b in open_)), "block_types": types,
                 "has_heading": bool(headings), "heading_text": headings[0] if headings else "", "start": start, "end": end}
            )
            open_.clear()

    n = 0
    for b in blocks_:
        if b["oversize"]:
            flush(b["start"])
            chunks.append(
                {"content": b["content"], "block_types": [b["type"]], "has_heading": b["type"] == "heading",
                 "heading_text": "", "start": b["start"], "end": b["end"], "cut": True}
            )
            start = b["end"]
            continue
        if open_ and (b["type"] in ("heading", "code", "table") or n + len(b["content"]) > most):
            flush(b["start"])
            start = b["start"]
        if not open_:
            n = 0
        open_.append(b)
        n += len(b["content"])
    flush(blocks_[-1]["end"] if blocks_ else 0)
    short = [not c.pop("cut", False) and len(c["content"]) < least and not c["has_heading"] for c in chunks]
    if drop_short:
        return [c for c, s in zip(chunks, short, strict=True) if not s]
    out: list[dict] = []
    pending = None
    for c, s in zip(chunks, short, strict=True):
        if pending is not None:
            c, pending = _joined(pending, c), None
        if s and out:
            out[-1] = _joined(out[-1], c)
        elif s:
            pending = c
        else:
            out.append(c)
    return out + ([pending] if pending is not None else [])


def _joined(a: dict, b: dict) -> dict:
    return {
        "content": "\n\n".join(x for x in (a["content"], b["content"]) if x),
        "block_types": list(dict.fromkeys(a["block_types"] + b["block_types"])),
        "has_heading": a["has_heading"] or b["has_heading"],
        "heading_text": a["heading_text"] or b["heading_text"],
        "start": a["start"],
        "end": b["end"],
    }


def chunk_structured(docs: DataFrame, max_chars: int = 2000, min_chars: int = 100, overlap: int = 100) -> DataFrame:
    """Structure-aware chunks of whole documents: blocks, cuts, packing, overlap."""
    pieces = split_oversize(blocks(docs), max_chars, min_chars)
    return add_overlap(pack_blocks(pieces, max_chars, min_chars), overlap)


def _last_index(s: Column, needle: str) -> Column:
    """0-based position of the last occurrence, -1 when absent."""
    at = F.instr(F.reverse(s), needle[::-1])
    return F.when(at > 0, F.length(s) - at + 1 - len(needle)).otherwise(-1)


def add_overlap(chunks: DataFrame, n: int = 100) -> DataFrame:
    """Prefix each later chunk with the tail of the original previous chunk."""
    if n <= 0:
        return chunks
    prev = F.lag("content").over(Window.partitionBy("doc_id").orderBy("chunk_no"))
    df = chunks.withColumn("_p", prev)
    p = F.col("_p")
    base = F.length(p) - F.least(F.lit(n), F.length(p))
    full, dot = _last_index(p, "。"), _last_index(p, ". ")
    start = F.when(full > base, full + 1).when(dot > base, dot + 2).otherwise(base)
    df = df.withColumn("_t", trim_ws(F.substring(p, start + 1, F.length(p))))
    add = p.isNotNull() & (F.col("_t") != "") & ~F.startswith("content", F.col("_t"))
    return df.withColumn(
        "content",
        F.when(add, F.concat(F.lit("[...] "), "_t", F.lit("\n\n"), "content")).otherwise(F.col("content")),
    ).drop("_p", "_t")


SEPARATORS = ["\n\n", "\n", "。", "！", "？", "；", ".", "!", "?", ";", " ", ""]


def split_text(text: str, size: int, overlap: int, seps: list[str]) -> list[str]:
    """Split by the first separator present, pack pieces to ``size``, carry up to ``overlap``."""
    at = next((i for i, s in enumerate(seps) if s == "" or s in text), len(seps) - 1)
    sep, rest = seps[at], seps[at + 1 :]
    parts = list(text) if sep == "" else [p for p in re.split(f"(?={re.escape(sep)})", text) if p]
    out, window, width = [], [], 0

    def flush():
        done = "".join(window).strip()
        if done:
            out.append(done)

    for part in parts:
        if len(part) > size and rest:
            flush()
            window, width = [], 0
            out.extend(split_text(part, size, overlap, rest))
            continue
        if window and width + len(part) > size:
            flush()
            while window and (width > overlap or width + len(part) > size):
                width -= len(window.pop(0))
        window.append(part)
        width += len(part)
    flush()
    return out


def split_recursive(docs: DataFrame, size: int = 1000, overlap: int = 200, seps: list[str] | None = None) -> DataFrame:
    """(doc_id, chunk_no, content): recursive separator split, row by row."""
    seps = SEPARATORS if seps is None else seps

    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: split_text(t or "", size, overlap, seps))

    udf = F.pandas_udf(run, T.ArrayType(T.StringType()))
    return docs.select("doc_id", F.posexplode(udf("text")).alias("chunk_no", "content"))


SENTENCE = rf"[^。！？.!?]*[。！？.!?]+[{WS}]*|[^。！？.!?]+"


def token_count(s: Column) -> Column:
    """Whitespace words, plus one per CJK character."""
    cjk = count_chars(s, CJK)
    words = F.size(F.filter(F.split(F.regexp_replace(s, f"[{CJK}]", " "), f"[{WS}]+"), lambda w: w != ""))
    return (cjk + words).cast("int")


def split_sentences(docs: DataFrame, max_tokens: int = 512) -> DataFrame:
    """(doc_id, chunk_no, content, n_tokens): sentences packed greedily up to ``max_tokens``."""
    return docs.select("doc_id", F.posexplode(_sentence_chunks(max_tokens)("text")).alias("chunk_no", "c")).select(
        "doc_id", "chunk_no", "c.content", F.col("c.n").alias("n_tokens")
    )


SENTENCES = re.compile(SENTENCE)
TOKENS = re.compile(f"[{CJK}]|[^{WS}{CJK}]+")  # what token_count counts
BLANKS = "".join(filter(re.compile(f"[{WS}]").match, map(chr, range(0x10000))))
NOT_PLAIN = re.compile(f"[{CJK}\x1c-\x1f\x85\ufeff]")  # where str.split does not part the tokens
TEXTS_AT_ONCE = 256


def pack_sentences(text: str | None, most: int) -> list[tuple[str, int]]:
    """(content, tokens) of one text's chunks; blank ones are left out. Each sentence is handled once."""
    text = text or ""
    plain = NOT_PLAIN.search(text) is None
    out, start, at, n = [], 0, 0, 0
    for m in SENTENCES.finditer(text):
        s = m.group()
        size = len(s.split()) if plain else len(TOKENS.findall(s))
        if n > 0 and n + size > most:
            out.append((text[start:at], n))
            start, n = at, 0
        n += size
        at = m.end()
    out.append((text[start:at], n))
    return [(c, n) for c, n in ((c.strip(BLANKS), n) for c, n in out) if c]


def _sentence_chunks(most: int):
    """Arrow function: text -> array of (content, n)."""
    kind = pa.list_(pa.struct([("content", pa.string()), ("n", pa.int32())]))

    def run(texts: pa.Array) -> pa.Array:
        parts = []
        for start in range(0, max(1, len(texts)), TEXTS_AT_ONCE):
            rows = [pack_sentences(t, most) for t in texts.slice(start, TEXTS_AT_ONCE).to_pylist()]
            parts.append(pa.array([[{"content": c, "n": n} for c, n in row] for row in rows], kind))
        return pa.concat_arrays(parts)

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "array<struct<content:string,n:int>>").asNondeterministic()


def fixed_pieces(text: Column, n: int) -> Column:
    return F.when(
        F.length(text) > 0,
        F.transform(
            F.sequence(F.lit(1), F.length(text), F.lit(n)), lambda i: F.substring(text, i, F.lit(n))
        ),
    ).otherwise(F.array().cast("array<string>"))


def split_fixed(docs: DataFrame, n: int = 2000) -> DataFrame:
    """(doc_id, chunk_no, content): windows of ``n`` characters."""
    return docs.select("doc_id", F.posexplode(fixed_pieces(F.col("text"), n)).alias("chunk_no", "content"))


def finish_chunks(chunks: DataFrame, docs: DataFrame, strategy: str = "semantic") -> DataFrame:
    """Join document columns and complete chunk metadata.

    Position is the given ``start`` or the running length of earlier chunks.
    """
    before = Window.partitionBy("doc_id").orderBy("chunk_no").rowsBetween(Window.unboundedPreceding, -1)
    has = lambda c: c in chunks.columns
    run = F.coalesce(F.sum(F.length("content")).over(before), F.lit(0))
    c = chunks.withColumn("position", (F.coalesce("start", run) if has("start") else run).cast("int"))
    meta = docs.select(
        "doc_id",
        "source",
        path_tail("source").alias("file_name"),
        map_value(extension("source"), fv.CHUNK_FILE_TYPES, "unknown").alias("file_type"),
    )
    page = F.coalesce("page_number", F.lit(0)) if has("page_number") else F.lit(0)
    none = F.array().cast("array<string>")
    return c.join(meta, "doc_id").select(
        "doc_id",
        F.col("content").alias("text"),
        "source",
        "file_name",
        "file_type",
        page.cast("int").alias("page_number"),
        "position",
        F.lit("file").alias("source_type"),
        F.col("chunk_no").cast("int").alias("chunk_index"),
        (F.coalesce("block_types", none) if has("block_types") else none).alias("block_types"),
        (F.coalesce("has_heading", F.lit(False)) if has("has_heading") else F.lit(False)).alias("has_heading"),
        (F.coalesce("heading_text", F.lit("")) if has("heading_text") else F.lit("")).alias("heading_text"),
        F.lit(strategy).alias("chunking_strategy"),
    )


def paragraphs(docs: DataFrame) -> DataFrame:
    """(doc_id, paragraph_index, text): blank-line paragraphs."""
    parts = F.filter(F.transform(F.split("text", rf"\n[{WS}]*\n"), trim_ws), lambda p: p != "")
    return docs.select("doc_id", F.posexplode(parts).alias("paragraph_index", "text"))


PIECE_CHARS = 4000


def map_reduce(docs: DataFrame, map_fn, joiner: str = "\n\n---\n\n", max_pieces: int | None = None) -> DataFrame:
    """(doc_id, n_pieces, result): analyse a text's 4,000-character pieces and join them.

    ``map_fn`` is Column -> Column (text to text), a pandas UDF included. A
    document of one piece is analysed directly. ``max_pieces`` may limit the
    analysis to the first pieces (an interactive tool takes ten).
    """
    pieces = fixed_pieces(F.col("text"), PIECE_CHARS)
    if max_pieces is not None:
        pieces = F.slice(pieces, 1, max_pieces)
    mapped = (
        docs.select("doc_id", F.posexplode_outer(pieces).alias("piece_no", "piece"))
        .withColumn("_r", map_fn(F.coalesce("piece", F.lit(""))))
        .groupBy("doc_id")
        .agg(F.array_sort(F.collect_list(F.struct("piece_no", "_r"))).alias("_all"))  # the pieces of one text
    )
    return mapped.select(
        "doc_id",
        F.size("_all").alias("n_pieces"),
        F.array_join(F.transform("_all", lambda p: p["_r"]), joiner).alias("result"),
    )
