"""Benchmark decontamination (6) by winnowing.

Both sides' words are hashed in runs of ``GRAM``; in every window of consecutive
runs the rightmost least hash is kept. A window spans ``span`` words, so any
``span`` words in a row that a document shares with an item keep the same run in
both, and joining the kept fingerprints finds all of them. A hit is
extended to the windows around it, which are compared word by word: a window of an
item is ``span`` words in a row, or the whole item where it has fewer. Items that are shorter
than ``span`` are below the length that winnowing guarantees; their one window is
looked up at each position.

The item side is a table of a few thousand texts as a rule. Its size is
measured; up to ``BLOCK_BYTES`` of item text are broadcast at once, and a larger
benchmark is taken block by block against all documents, so nothing grows past
the bound and no document is shuffled unless there are several blocks.

Words: A-Z lower-cased, then runs of digits, a-z and characters beyond ASCII.

Cases: a null or empty text has no words and is never hit; a null or empty item has no
windows. An item id that is null hits, but is not listed. Repeated item ids are listed once.
Rows with equal or null document ids are treated one by one. An empty benchmark hits nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslake.llm.common import batches_of, materialise, per_text

SPAN, GRAM = 10, 5
#: Bytes of item text in one broadcast (its index takes some 100 times as much in a worker).
BLOCK_BYTES = 1_000_000
LOWER = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
FOUND = "struct<n_words:long,spans:array<struct<start:int,stop:int>>,items:array<string>>"


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(LOWER).split()


def run_hashes(ids: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of every ``size`` words in a row."""
    n = max(0, len(ids) - size + 1)
    h = np.zeros(n, np.uint64)
    for j in range(size):
        h = (h ^ (ids[j : j + n].astype(np.uint64) + np.uint64(0x632BE5AB))) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
    return h


def winnow(hashes: np.ndarray, window: int) -> np.ndarray:
    """Positions kept: in every ``window`` hashes in a row, the rightmost of the least."""
    if len(hashes) < window:
        return np.zeros(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(hashes[::-1], window)
    at = np.argmin(view, axis=1) + np.arange(len(view))
    return np.unique(len(hashes) - 1 - at)


class Index:
    """Windows and kept fingerprints of a block of items, given as (id, text)."""

    def __init__(self, items: list[tuple[str | None, bytes | None]], span: int = SPAN):
        self.span, self.gram = span, min(GRAM, span)
        self.vocabulary: dict[bytes, int] = {}
        self.windows: dict[bytes, set] = {}
        kept, short = [np.zeros(0, np.uint64)], {}
        for item, text in items:
            words = words_of(text)
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words], np.int32)
            size = min(len(ids), span)
            for i in range(len(ids) - size + 1 if size else 0):
                self.windows.setdefault(ids[i : i + size].tobytes(), set()).add(item)
            if size == span:
                hashes = run_hashes(ids, self.gram)
                kept.append(hashes[winnow(hashes, span - self.gram + 1)])
            elif size:
                short.setdefault(size, []).append(run_hashes(ids, size))
        self.kept = np.unique(np.concatenate(kept))
        self.short = {size: np.unique(np.concatenate(h)) for size, h in short.items()}

    def find(self, texts: list[bytes | None]) -> list[dict]:
        out = []
        get = self.vocabulary.get
        for start, stop in batches_of([len(t or b"") for t in texts], 2_000_000):
            words = [words_of(t) for t in texts[start:stop]]
            sizes = np.array([len(w) for w in words], np.int64)
            ids = np.fromiter((get(w, -1) for ws in words for w in ws), np.int32, int(sizes.sum()))
            ends = np.cumsum(sizes)
            found: list[dict] = [{"spans": [], "items": set()} for _ in words]
            for at, size in self._candidates(ids):
                text = int(np.searchsorted(ends, at, side="right"))
                if at + size <= ends[text] and (items := self.windows.get(ids[at : at + size].tobytes())):
                    first = ends[text] - sizes[text]
                    found[text]["spans"].append((int(at - first), int(at - first) + size))
                    found[text]["items"] |= items
            out += [
                {"n_words": int(n), "spans": merged(f["spans"]), "items": sorted(x for x in f["items"] if x is not None)}
                for n, f in zip(sizes, found, strict=True)
            ]
        return out

    def _candidates(self, ids: np.ndarray):
        """(start, size) of the windows that hits extend to."""
        window = self.span - self.gram + 1
        hashes = run_hashes(ids, self.gram)
        at = winnow(hashes, window)
        at = at[member(hashes[at], self.kept)]
        starts = np.unique((at[:, None] - np.arange(window)).ravel())
        yield from ((int(i), self.span) for i in starts if i >= 0)
        for size, wanted in self.short.items():
            yield from ((int(i), size) for i in np.flatnonzero(member(run_hashes(ids, size), wanted)))


def member(values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Which values are in the sorted array ``wanted``."""
    if not len(wanted):
        return np.zeros(len(values), bool)
    return wanted[np.minimum(np.searchsorted(wanted, values), len(wanted) - 1)] == values


def merged(spans: list[tuple[int, int]]) -> list[dict]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [{"start": a, "stop": b} for a, b in out]


ARROW = pa.struct(
    [("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))), ("items", pa.list_(pa.string()))]
)


def finder(spark, items: list[tuple[str | None, bytes | None]], span: int = SPAN):
    """Column function that looks a text up in a (bounded) block of items."""
    shared = spark.sparkContext.broadcast((items, span))

    def rows(texts: list) -> pa.Array:
        if getattr(rows, "index", None) is None:
            rows.index = Index(*shared.value)
        return pa.array(rows.index.find(texts), ARROW)

    return per_text(rows, FOUND)


def blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int) -> list[DataFrame]:
    """The items as (id, text) in parts of about ``block_bytes`` of text."""
    items = benchmark.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("binary").alias("text"))
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = int(-(-size // block_bytes)) or 1
    return [items.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == i) for i in range(n)]


def find_overlap(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    span: int = SPAN,
    block_bytes: int = BLOCK_BYTES,
    out: str = "overlap",
) -> DataFrame:
    """``docs`` with a struct column ``out``: n_words, spans of words hit, ids of the items hit."""
    spark = docs.sparkSession
    parts = blocks(benchmark, item_id, item_text, block_bytes)
    if len(parts) == 1:
        found = finder(spark, [tuple(r) for r in parts[0].collect()], span)
        return docs.withColumn(out, found(F.col(text_col)))
    rows = materialise(docs.select(F.struct(*docs.columns).alias("doc"), F.monotonically_increasing_id().alias("row")), "documents")
    hits = None
    for part in parts:
        found = finder(spark, [tuple(r) for r in part.collect()], span)
        new = rows.select("row", found(F.col("doc")[text_col]).alias("f"))
        new = materialise(new.select("row", "f.n_words", "f.spans", "f.items").where((F.size("spans") > 0) | F.lit(hits is None)), "hits")
        hits = new if hits is None else hits.union(new)
    merged_spans = per_merge(F.flatten(F.collect_list("spans")))
    by_row = hits.groupBy("row").agg(
        F.struct(
            F.max("n_words").alias("n_words"),
            merged_spans.alias("spans"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        ).alias(out)
    )
    return rows.join(by_row, "row", "left").select("doc.*", out)


def per_merge(spans: Column) -> Column:
    """Overlapping or touching spans joined into one."""
    start = F.array().cast("array<struct<start:int,stop:int>>")

    def step(acc, x):
        last = F.element_at(acc, -1)
        joins = (F.size(acc) > 0) & (x["start"] <= last["stop"])
        longer = F.struct(last["start"].alias("start"), F.greatest(last["stop"], x["stop"]).alias("stop"))
        return F.when(joins, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(longer))).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(F.array_sort(spans), start, step)


def n_hit(overlap: str = "overlap") -> Column:
    return F.aggregate(f"{overlap}.spans", F.lit(0).cast("long"), lambda acc, s: acc + s["stop"] - s["start"])


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """(id, n_words, n_hit, n_items, items_sha256, contaminated), a row per document."""
    found = find_overlap(docs.select(F.col(id_col).alias("id"), F.col(options.pop("text_col", "text")).alias("text")), benchmark, **options)
    return found.select(
        F.col("id").alias(id_col),
        "overlap.n_words",
        n_hit().alias("n_hit"),
        F.size("overlap.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("overlap.items", ","), 256).alias("items_sha256"),
        (F.size("overlap.spans") > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The documents without any hit, with their columns."""
    out = "_overlap" + "_" * max(len(c) for c in docs.columns)
    found = find_overlap(docs, benchmark, text_col, out=out, **options)
    return found.where(F.size(F.col(out)["spans"]) == 0).drop(out)
