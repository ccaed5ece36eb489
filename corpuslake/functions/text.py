"""Column expressions over text: whitespace, paths, scripts, tokens, counting."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuslake.functions import fixed_values as fv

# The whitespace class used by trim/split rules: ASCII blanks, no-break space,
# Unicode space separators, line/paragraph separators and the byte-order mark.
WS = r"\t\n\x0B\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
WS_CHARS = (
    "\t\n\x0b\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)
CJK = r"\u4e00-\u9fa5"


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` as a bound variable.

    Lambda bodies are not covered by common-subexpression elimination, so a
    costly expression used inside one would otherwise run per element.
    """
    return F.transform(F.array(value), body)[0]


def trim_ws(c: Column | str) -> Column:
    """Trim every whitespace kind, not only the blank that ``F.trim`` knows; only the ends are compared."""
    return F.btrim(as_col(c), F.lit(WS_CHARS))


def blank_to_null(c: Column | str) -> Column:
    return F.nullif(as_col(c), F.lit(""))


def count_chars(c: Column | str, char_class: str) -> Column:
    """How many characters of ``c`` fall in the regex class (given without brackets)."""
    return F.length(F.regexp_replace(as_col(c), f"[^{char_class}]", ""))


def extract_all(c: Column | str, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(as_col(c), F.lit(pattern), F.lit(group))


def contains_any(c: Column, words: list[str]) -> Column:
    """True when any of the (literal, lower-case) words occurs in ``c``."""
    hit = F.lit(False)
    for w in words:
        hit = hit | c.contains(w)
    return hit


def norm_path(c: Column | str) -> Column:
    """Path identity: lower-case, forward slashes, no outer whitespace."""
    return trim_ws(F.lower(F.replace(as_col(c), F.lit("\\"), F.lit("/"))))


def path_tail(c: Column | str) -> Column:
    """Last part of a path or URL (either slash)."""
    return F.element_at(F.split(as_col(c), r"[\\/]"), -1)


def extension(c: Column | str) -> Column:
    """Lower-case extension without the dot, '' when there is none."""
    return F.lower(F.regexp_extract(path_tail(c), r"^.+\.([^.]*)\z", 1))


def map_value(c: Column, table: dict[str, str], default: str) -> Column:
    """Look a short fixed table up inside the expression (no join)."""
    out = F.lit(default)
    for key, value in table.items():
        out = F.when(c == key, F.lit(value)).otherwise(out)
    return out


def safe_url_decode(c: Column | str) -> Column:
    """Percent-decode; keep the input when it is malformed. '+' stays '+'."""
    c = as_col(c)
    return F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)


def distinct_in_order(c: Column) -> Column:
    """``array_distinct`` keeps first-seen order; named for the reader."""
    return F.array_distinct(c)


def clip(c: Column | str, n: int, tail: str = "...") -> Column:
    c = as_col(c)
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit(tail))).otherwise(c)


def script_of(c: Column | str) -> Column:
    """'zh' / 'en' / 'mixed': more CJK than Latin, the rest, or neither."""
    cjk, latin = count_chars(c, CJK), count_chars(c, "a-zA-Z")
    return (
        F.when((cjk == 0) & (latin == 0), "mixed")
        .when(cjk > latin, "zh")
        .otherwise("en")
    )


def cjk_grams(segments: Column, sizes: tuple[int, ...] = (2, 3, 4)) -> Column:
    """All n-grams of each CJK run, then the whole run (runs of 2 or more)."""

    def of_size(seg: Column, n: int) -> Column:
        starts = F.sequence(F.lit(1), F.length(seg) - (n - 1))
        return F.when(
            F.length(seg) >= n, F.transform(starts, lambda i: F.substring(seg, i, F.lit(n)))
        ).otherwise(F.array().cast("array<string>"))

    def grams(seg: Column) -> Column:
        whole = F.when(F.length(seg) >= 2, F.array(seg)).otherwise(F.array().cast("array<string>"))
        return F.concat(*[of_size(seg, n) for n in sizes], whole)

    return F.flatten(F.transform(segments, grams))


def index_tokens(c: Column | str, stop_words: list[str] | None = None) -> Column:
    """Keyword-index tokens of a text, with repetition, as one array column.

    Latin words (hyphens and digits inside), CJK 2-4-grams plus whole runs,
    digit runs. One-character tokens and stop words are dropped, so CJK single
    characters need not be produced. Row-local: nothing is shuffled.
    """
    stop = list(fv.INDEX_STOP_WORDS if stop_words is None else stop_words)
    keep = lambda t: (F.length(t) > 1) & ~t.isin(*stop) if stop else F.length(t) > 1

    def tokens_of(low: Column) -> Column:
        words = extract_all(low, "[a-z][a-z0-9-]*")
        cjk = cjk_grams(extract_all(low, f"[{CJK}]+"))
        return F.concat(words, cjk, extract_all(low, "[0-9]+"))

    return F.filter(let(F.lower(as_col(c)), tokens_of), keep)


_BYTES = np.arange(256)
_LETTER, _DIGIT = (_BYTES >= ord("a")) & (_BYTES <= ord("z")), (_BYTES >= ord("0")) & (_BYTES <= ord("9"))
_WORD, _CJK_LEAD = _LETTER | _DIGIT | (_BYTES == ord("-")), (_BYTES >= 0xE4) & (_BYTES <= 0xE9)
_CJK_RUN = re.compile(f"[{CJK}]{{2,}}")


def flat_tokens(low: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """``index_tokens`` of texts in lower case, stop words included and in any order: all tokens, and the index of each one's text.

    For Arrow batches: words and digit runs are cut out of the texts' bytes together; only texts with CJK characters are looked at one by one.
    """
    ended = pc.binary_join_element_wise(low.cast(pa.string()).fill_null(""), "\n", "")
    _, offsets, data = ended.buffers()
    offsets = np.frombuffer(offsets, np.int32)[ended.offset :][: len(ended) + 1]
    text = np.frombuffer(data or b"", np.uint8)[: offsets[-1]]
    words, letters = _runs(_WORD[text]), np.append(np.flatnonzero(_LETTER[text]), len(text))
    late = np.flatnonzero(~_LETTER[text[words[0]]])  # a word begins at the first letter
    words[0, late] = np.minimum(letters[np.searchsorted(letters, words[0, late])], words[1, late])
    tokens, owners = [], []
    for starts, ends in (words, _runs(_DIGIT[text])):
        long = ends - starts > 1
        starts, ends = starts[long], ends[long]
        step = np.zeros(len(text) + 1, np.int8)
        step[starts], step[ends] = 1, -1
        kept = text[np.cumsum(step[:-1], dtype=np.int8).astype(bool)]
        places = np.r_[0, np.cumsum(ends - starts)].astype(np.int32)
        tokens.append(pa.StringArray.from_buffers(len(starts), pa.py_buffer(places), pa.py_buffer(kept)))
        owners.append(np.searchsorted(offsets, starts, side="right") - 1)
    for i in np.unique(np.searchsorted(offsets, np.flatnonzero(_CJK_LEAD[text]), side="right") - 1):
        runs = _CJK_RUN.findall(low[int(i)].as_py())
        grams = runs + [run[j : j + n] for run in runs for n in (2, 3, 4) for j in range(len(run) - n + 1)]
        tokens.append(pa.array(grams, pa.string()))
        owners.append(np.full(len(grams), i))
    return pa.concat_arrays(tokens), np.concatenate(owners)


def _runs(member: np.ndarray) -> np.ndarray:
    """Starts and ends of the runs of True; the last element is False."""
    change = np.flatnonzero(np.diff(member, prepend=False))
    return np.stack([change[::2], change[1::2]])
