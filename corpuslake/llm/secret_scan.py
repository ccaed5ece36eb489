"""Secret scans (5): patterns of known forms, and sliding-window entropy of candidate strings.

Base spans are the leftmost matches of three forms (``assign``, ``access``, ``hex``); matches that fail a
form's length rule are dropped, and the search goes on behind them.

The method adds ``entropy`` spans. Candidates are runs of A-Z, a-z, 0-9, +, /, _, =, -
of at least ``WINDOW`` characters. Each belongs to the smallest class that holds its characters (digits, hex,
lower case and digits, mixed). Shannon entropy is taken over every window of ``WINDOW`` characters: counts of the window
change by one character in and one out, so the sum of c log c is kept up in constant time a step.
Windows at or over their class's limit are joined to a span. A span is suppressed if it overlaps a
base span, if its candidate is on the allow-list (see ``allowed``), or if its windows lack a digit beside letters.

Cases: a null text counts as empty and has no spans. Rows with equal or null ids are scanned one
by one. Texts are read whole; positions are code points, ends are exclusive.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslake.llm.common import per_text, struct_of

KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # the same as runs of any length of which the shorter are dropped
#: A quick look for an assignment: each of its words has one of these.
MAY_ASSIGN = re.compile(r"(?ai:passw|secret|token|api_?key)")
WINDOW = 20
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: Bits a character that a window of each class must reach (the most for 20 characters is 4.32, for digits 3.32).
LIMITS = {"digits": math.inf, "hex": 3.0, "lower": 3.4, "mixed": 3.6}
DEFAULT_ALLOWED = ("EXAMPLE", "example", "xxxx", "XXXX", "0123456789", "abcdefghij", "ABCDEFGHIJ")
UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
RETURNS = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_entropy long"
CLASSES = {
    "digits": re.compile(r"[0-9]+"),
    "hex": re.compile(r"[0-9a-f]+|[0-9A-F]+"),
    "lower": re.compile(r"[0-9a-z_-]+|[0-9A-Z_-]+"),
}


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base forms, in order."""
    out = []
    if MAY_ASSIGN.search(text):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def entropies(text: str, window: int = WINDOW) -> Iterator[float]:
    """Shannon entropy (bits) of every window, by counts kept up from one to the next."""
    table = [c * math.log2(c) if c else 0.0 for c in range(window + 1)]
    counts: dict[str, int] = {}
    total = 0.0
    for i, char in enumerate(text):
        n = counts.get(char, 0)
        counts[char] = n + 1
        total += table[n + 1] - table[n] if n < window else 0.0
        if i >= window:
            out = text[i - window]
            n = counts[out]
            counts[out] = n - 1
            total += table[n - 1] - table[min(n, window)]
        if i >= window - 1:
            yield math.log2(window) - total / window


def class_of(candidate: str) -> str:
    return next((name for name, p in CLASSES.items() if p.fullmatch(candidate)), "mixed")


def allowed(candidate: str, allow: tuple[str, ...]) -> bool:
    """Is it known to be harmless? UUIDs, paths and long words joined by separators, and strings with an allowed part."""
    if UUID.fullmatch(candidate) or any(a in candidate for a in allow):
        return True
    return all(p.isalpha() or p.isdigit() for p in re.split(r"[/_=+-]+", candidate) if p)


def entropy_spans(text: str, allow: tuple[str, ...] = DEFAULT_ALLOWED) -> list[tuple[int, int]]:
    out = []
    for m in CANDIDATE.finditer(text):
        candidate = m[0]
        limit = LIMITS[class_of(candidate)]
        if math.isinf(limit) or allowed(candidate, allow):
            continue
        digits, letters = ([0] for _ in range(2))  # prefix counts
        for c in candidate:
            digits.append(digits[-1] + c.isdigit())
            letters.append(letters[-1] + c.isalpha())
        first = last = -1
        for i, bits in enumerate(entropies(candidate)):
            if bits >= limit and digits[i + WINDOW] > digits[i] and letters[i + WINDOW] > letters[i]:
                if first >= 0 and i > last:
                    out.append((m.start() + first, m.start() + last))
                    first = -1
                first, last = (i if first < 0 else first), i + WINDOW
        if first >= 0:
            out.append((m.start() + first, m.start() + last))
    return out


def scan(text: str, allow: tuple[str, ...] = DEFAULT_ALLOWED) -> tuple[list, list]:
    """Base spans, and all spans, as (start, kind, end) in order."""
    base = base_spans(text)
    added = [(a, 3, b) for a, b in entropy_spans(text, allow) if not any(a < e and s < b for s, _, e in base)]
    return base, sorted(base + added)


def joined(spans: list) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def found(text: Column, allow: tuple[str, ...] = DEFAULT_ALLOWED) -> Column:
    """Struct of counts, digest and spans of a text (fields in ``RETURNS``)."""

    def rows(texts: list) -> pa.Array:
        out = []
        for t in texts:
            base, spans = scan((t or b"").decode("utf-8", "replace"), allow)
            n = [sum(k == kind for _, k, _ in spans) for kind in range(4)]
            out.append((*n[:3], hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), n[3]))
        return struct_of(RETURNS, list(zip(*out, strict=True)) if out else [[]] * 6)

    return per_text(rows, RETURNS)(text)


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", allow: tuple[str, ...] = DEFAULT_ALLOWED) -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_sha256, spans, n_entropy), a row per document."""
    return docs.select(F.col(id_col), found(F.col(text_col), allow).alias("_f")).select(id_col, "_f.*")
