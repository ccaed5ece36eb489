"""Quality rules (10): text measures, and repeated substrings found by suffix arrays over words.

A suffix array of the words of a text, with the longest common prefixes (LCP) of
neighbours, gives its repeats: an LCP interval of value v stands for a maximal
repeated substring of v words, and the suffixes in the interval are where it
occurs. The deepest interval around a suffix has the larger of the two LCPs
beside it, so the union of all intervals' spans is the union of [i, i + reach(i)),
where reach(i) is that larger LCP. Ranks come from prefix doubling; LCPs from the
kept ranks, by binary lifting. Suffixes of many texts are sorted together: the
first rank holds the text's number, so none reaches into another text.

Only texts in which some five words in a row occur twice are sorted (found by a
64-bit hash; a false hit only costs the sort), as all others have no repeat.

Cases: null text has no words, as the empty one; both fail the base rule
(fewer than ``min_words``). Rows with equal or null ids are judged one by one.
Texts of any length are read whole. Other columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslake.llm.common import batches_of, per_text, struct_of

SPACE = b" \t\n\x0b\x0c\r"
CONTINUATION = bytes(range(0x80, 0xC0))
SYMBOLS = b"#*$%&|<>"
WINDOW = 5
RETURNS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "covered_words long, longest_repeat long, base_failed boolean, kept boolean"
)


@dataclass(frozen=True)
class Limits:
    """The base rule's limits, then those on repeated substrings of ``min_repeat`` words or more."""

    min_words: int = 10
    max_repeat_pct: int = 20
    min_repeat: int = 15
    max_covered_pct: int = 10
    max_longest: int = 50


def verdict(text: Column, limits: Limits = Limits()) -> Column:
    """Struct of measures and verdict for a text (fields in ``RETURNS``)."""
    return per_text(lambda texts: judge(texts, limits), RETURNS)(text)


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limits: Limits = Limits()) -> DataFrame:
    """(id, measures, base_failed, kept), a row per document."""
    return docs.select(F.col(id_col), verdict(F.col(text_col), limits).alias("_v")).select(id_col, "_v.*")


def keep_good(docs: DataFrame, text_col: str = "text", limits: Limits = Limits()) -> DataFrame:
    """The documents that pass, with their columns."""
    name = "_verdict" + "_" * max(len(c) for c in docs.columns)  # longer than, so different from, every column
    return docs.withColumn(name, verdict(F.col(text_col), limits)).where(F.col(name)["kept"]).drop(name)


def judge(texts: list, limits: Limits) -> pa.Array:
    texts = [t or b"" for t in texts]
    out = np.zeros((7, len(texts)), np.int64)
    for start, stop in batches_of([len(t) for t in texts], 4_000_000):
        words = [t.split() for t in texts[start:stop]]
        out[0, start:stop] = [len(w) for w in words]
        for i, t in enumerate(texts[start:stop], start):
            out[1, i] = len(t.translate(None, SPACE + CONTINUATION))
            out[2, i] = len(t) - len(t.translate(None, SYMBOLS))
            lines = [x for x in t.split(b"\n") if x.strip()]
            out[3, i] = len(lines) - len(set(lines))
        suspects = [i for i, yes in enumerate(may_repeat(words)) if yes]
        for i, found in zip(suspects, repeats([words[i] for i in suspects], limits.min_repeat), strict=True):
            out[4:7, start + i] = found
    n, covered, longest = out[0], out[5], out[6]
    failed = (n < limits.min_words) | (100 * out[4] > limits.max_repeat_pct * n)
    kept = ~failed & (100 * covered <= limits.max_covered_pct * n) & (longest <= limits.max_longest)
    return struct_of(RETURNS, [*out, failed, kept])


def bounds(words: list[list]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts laid end to end: each word's text, each word's text's end, the texts' starts."""
    sizes = np.array([len(w) for w in words], np.int64)
    ends = np.cumsum(sizes)
    text = np.repeat(np.arange(len(words)), sizes)
    return text, ends[text] if len(text) else text, ends - sizes


def may_repeat(words: list[list]) -> np.ndarray:
    """Per text: may some ``WINDOW`` words in a row occur twice? No is certain."""
    text, end, _ = bounds(words)
    out = np.zeros(len(words), bool)
    total = len(text) - WINDOW + 1
    if total <= 0:
        return out
    h = np.fromiter((hash(x) for w in words for x in w), np.int64, len(text)).view(np.uint64)
    key = text[:total].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    odd = 0xD6E8FEB86659FD93
    for j in range(WINDOW):
        key = key * np.uint64(odd) + h[j : j + total]
    at = np.flatnonzero(np.arange(total) + WINDOW <= end[:total])
    key = key[at] ^ (key[at] >> np.uint64(29))
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    out[text[at[order[1:][same]]]] = True
    return out


def repeats(words: list[list], least: int) -> list[tuple[int, int, int]]:
    """Per text: words in 5-word windows found twice, words in repeats of ``least`` or more, longest repeat."""
    text, end, starts = bounds(words)
    if not len(text):
        return [(0, 0, 0)] * len(words)
    reach = reaches(words, text, end)
    covers = []
    for size in (WINDOW, least):
        edge = np.zeros(len(text) + 1, np.int64)
        i = np.flatnonzero(reach >= size)
        np.add.at(edge, i, 1)
        np.add.at(edge, i + reach[i], -1)
        covers.append(np.bincount(text, np.cumsum(edge)[:-1] > 0, len(words)).astype(int))
    longest = np.zeros(len(words), np.int64)
    np.maximum.at(longest, text, reach)
    return list(zip(covers[0].tolist(), covers[1].tolist(), longest.tolist(), strict=True))


def reaches(words: list[list], text: np.ndarray, end: np.ndarray) -> np.ndarray:
    """For each word, the length of the longest substring that starts there and also starts elsewhere in its text."""
    ids: dict = {}
    flat = np.fromiter((ids.setdefault(x, len(ids)) for w in words for x in w), np.int64, len(text))
    rank = np.unique(text * (len(ids) + 1) + flat, return_inverse=True)[1].astype(np.int64)
    n, size, levels, here = len(text), 1, [(1, rank)], np.arange(len(text))
    while rank.max() < n - 1:  # until each suffix has a rank of its own
        later = np.zeros(n, np.int64)
        inside = np.flatnonzero(here + size < end)
        later[inside] = rank[inside + size] + 1
        rank = np.unique(rank * (n + 1) + later, return_inverse=True)[1].astype(np.int64)
        size *= 2
        levels.append((size, rank))
    order = np.argsort(rank)
    a, b = order[:-1], order[1:]
    lcp = np.zeros(len(a), np.int64)
    for size, level in reversed(levels):  # equal ranks at a level: equal words for its size, or up to both ends
        i, j = a + lcp, b + lcp
        fits = (i + size <= end[a]) & (j + size <= end[b])
        fits[fits] = level[i[fits]] == level[j[fits]]
        lcp += size * fits
    reach = np.zeros(n, np.int64)
    reach[a] = lcp
    reach[b] = np.maximum(reach[b], lcp)
    return reach
