"""Token counts (8): greedy longest-match word pieces, counted by a linear automaton.

Words are cut as the vocabulary's own rule does (``WORD``, after lower-casing), and written as bytes and
an end mark. The greedy rule takes the longest piece of the vocabulary at each place. The
automaton does so in one pass without building pieces: a trie of the vocabulary, in which each node knows
how many pieces greedy matching would cut off (pop) when the trie can't go on, and the node of what is then left (its
failure link). Both come from the parent's, in order of depth. A step either goes on in the
trie or follows a link, and links only shorten what is left, so a word costs steps in proportion to its length.

Every byte, with and without the end mark, is a piece of the vocabulary, so every word can be cut.
Words are remembered by a worker up to ``REMEMBERED``.

Cases: a null text counts as empty: no words, no tokens. Rows with equal or null ids are
counted one by one. Texts are read whole.
"""

from __future__ import annotations

import functools
import json
from collections import deque

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslake.llm.common import per_text, struct_of

WORD = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
END, END_SUFFIX = 256, "</w>"
REMEMBERED = 400_000
RETURNS = "n_words long, n_tokens long"


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file: printable Latin-1 for itself, others from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(hidden)}


def load_pieces(path: str) -> list[tuple[int, ...]]:
    """Pieces of a vocabulary with word ends, as bytes and the end mark; special tokens are left out."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    special = {t["content"] for t in model["added_tokens"]}
    letters = byte_letters()
    out = []
    for piece in model["model"]["vocab"]:
        if piece not in special:
            body, end = (piece[: -len(END_SUFFIX)], (END,)) if piece.endswith(END_SUFFIX) else (piece, ())
            out.append((*(letters[c] for c in body), *end))
    return out


class Automaton(dict):
    """Trie with failure links and popped-token counts; as a dict, word -> number of pieces (remembered)."""

    def __init__(self, pieces: list[tuple[int, ...]]):
        self.next: list[dict[int, int]] = [{}]
        final = [False]
        for piece in pieces:
            node = 0
            for symbol in piece:
                if symbol not in self.next[node]:
                    self.next[node][symbol] = len(self.next)
                    self.next.append({})
                    final.append(False)
                node = self.next[node][symbol]
            final[node] = True
        #: After failing at a node: the node to go on from (-1: none), and the pieces cut off by then.
        self.fail, self.popped = [-1] * len(final), [0] * len(final)
        queue = deque([0])
        while queue:
            node = queue.popleft()
            for symbol, child in self.next[node].items():
                if final[child]:
                    self.fail[child], self.popped[child] = 0, 1
                else:
                    z, n = self.fail[node], self.popped[node]
                    while z >= 0 and symbol not in self.next[z]:
                        z, n = self.fail[z], n + self.popped[z]
                    if z >= 0:
                        self.fail[child], self.popped[child] = self.next[z][symbol], n
                queue.append(child)

    def count(self, symbols) -> int:
        """Number of greedy pieces; 1 (an unknown token) where the vocabulary can't spell the word."""
        node, n = 0, 0
        for symbol in symbols:
            while symbol not in self.next[node]:
                if self.fail[node] < 0:
                    return 1
                node, n = self.fail[node], n + self.popped[node]
            node = self.next[node][symbol]
        while node:
            if self.fail[node] < 0:
                return 1
            node, n = self.fail[node], n + self.popped[node]
        return n

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = out = self.count((*word.encode(), END))
        return out


@functools.lru_cache(2)
def automaton(path: str) -> Automaton:
    return Automaton(load_pieces(path))


def public_vocabulary() -> str:
    import public_tokenizers as P

    return P.path("word_bpe_49k.json")


def counted(text: Column, vocabulary: str | None = None) -> Column:
    """Struct (n_words, n_tokens) of a text."""
    path = vocabulary or public_vocabulary()

    def rows(texts: list) -> pa.Array:
        pieces = automaton(path)
        find = regex.compile(WORD).findall
        words = [find((t or b"").decode("utf-8", "replace").lower()) for t in texts]
        return struct_of(RETURNS, [[len(w) for w in words], [sum(map(pieces.__getitem__, w)) for w in words]])

    return per_text(rows, RETURNS)(text)


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(id, n_words, n_tokens), a row per document."""
    return docs.select(F.col(id_col), counted(F.col(text_col), vocabulary).alias("_c")).select(id_col, "_c.*")
