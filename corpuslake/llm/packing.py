"""Best-fit packing (7) of token sequences, after dominance reduction.

1. Documents become pieces of at most ``capacity`` tokens in one pass over the text.
2. Only lengths matter for packing, so the problem is a histogram of at most
   ``capacity`` rows, however many documents there are. It is solved on the driver
   in counts: a step fixes or fills any number of equal bins at once.
   Reduction: for the longest piece j, a set S of others beside it dominates
   if every other set that fits can be parted into groups that fit into the places of
   S's pieces; {j} + S is then fixed for good. Tried are: nothing fits; a piece fills
   the rest; only one more fits; one piece at least as long as any pair; a pair
   that dominates all singles and pairs. The remainder is packed best-fit, longest first.
3. The plan is a list of bin kinds (a pattern of lengths, and how many bins have it). Pieces are ranked
   within their length, and rank r takes slot r of its length.
   Ranks are prefix sums over hash buckets, so a length that many pieces share is dealt to many tasks.

Cases: a null text counts as empty and is one piece of length 1 (the end token). Equal rows
are packed one by one, with null ids too. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import functools
import json
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslake.llm.common import as_bytes, materialise

CAPACITY, END = 2048, 0
#: Words whose ids a worker remembers; beyond, it starts over.
REMEMBERED = 400_000
#: Pieces of one length that are ranked together, about.
BUCKET = 2_000
#: Where two white-space characters meet, or one is at an end, words can't be encoded apart.
UNSAFE = re.compile(r"\s\s|^\s|\s$")


class Encoder(dict):
    """Ids of byte-level BPE as little-endian bytes; word -> ids of " word" are remembered.

    The pattern that splits texts before merging never joins across a single
    space between two other characters, so such a text is encoded word by word.
    """

    def __init__(self, vocabulary: str, ranks: str, pattern: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("bpe", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        with open(vocabulary, encoding="utf-8") as f:
            self.special = [t["content"] for t in json.load(f)["added_tokens"]]
        self.whole = Tokenizer.from_file(vocabulary)

    def ids(self, text: str) -> bytes:
        return array("I", self.fast.encode_ordinary(text)).tobytes()

    def __missing__(self, word: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = out = self.ids(" " + word)
        return out

    def encode(self, text: str) -> bytes:
        if any(s in text for s in self.special):  # their ids are the tokenizer's own affair
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if not text or UNSAFE.search(text):
            return self.ids(text)
        first, *words = text.split(" ")
        return self.ids(first) + b"".join(map(self.__getitem__, words))


@functools.lru_cache(1)
def encoder(vocabulary: str, ranks: str, pattern: str) -> Encoder:
    return Encoder(vocabulary, ranks, pattern)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: all full but the first."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def public_files() -> tuple[str, str, str]:
    import public_tokenizers as P

    return P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, files=None) -> DataFrame:
    """(id, piece, start, length, ids_crc32): documents' tokens plus the end token, cut to ``capacity``."""
    files = files or public_files()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(*files)
        end = np.array([END], "<u4").tobytes()
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(as_bytes(batch.column(1))):
                data = code.encode((text or b"").decode("utf-8", "replace")) + end
                for k, (s, n) in enumerate(cut(len(data) // 4, capacity)):
                    row.append(i)
                    piece.append(k)
                    start.append(s)
                    length.append(n)
                    crc.append(zlib.crc32(data[4 * s : 4 * (s + n)]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                names=[id_col, "piece", "start", "length", "ids_crc32"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long"
    return docs.select(F.col(id_col), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, schema)


class Plan:
    """Bins by kind: a pattern, as (length, times) pairs, and the number of bins that have it."""

    def __init__(self, counts: dict[int, int], capacity: int = CAPACITY):
        self.capacity = capacity
        self.left = np.zeros(capacity + 1, np.int64)
        for length, n in counts.items():
            self.left[length] = n
        self.kinds: list[tuple[tuple, int]] = []
        self.reduce()
        self.fixed = sum(n for _, n in self.kinds)
        self.best_fit()

    def fix(self, *lengths: int) -> None:
        """As many bins of these lengths as the pieces allow."""
        times = {x: lengths.count(x) for x in lengths}
        n = min(int(self.left[x]) // t for x, t in times.items())
        for x, t in times.items():
            self.left[x] -= n * t
        self.kinds.append((tuple(times.items()), n))

    def reduce(self) -> None:
        for j in range(self.capacity, 0, -1):
            while self.left[j] and (beside := self.dominating(j)) is not None:
                self.fix(j, *beside)

    def dominating(self, j: int) -> tuple[int, ...] | None:
        """Lengths that, beside j, dominate all else that fits there; None if none is proved."""
        rest, left = self.capacity - j, self.left.copy()
        left[j] -= 1
        have = np.flatnonzero(left[: rest + 1])
        if not len(have):
            return ()
        most = int(have[-1])
        small = np.repeat(have[:3], np.minimum(left[have[:3]], 3))[:3]
        if most == rest or len(small) < 2 or small[0] + small[1] > rest:
            return (most,)
        if len(small) > 2 and small.sum() <= rest:
            return None  # three more fit: not decided here
        partner = have[np.maximum(np.searchsorted(have, rest - have, side="right") - 1, 0)]
        fits = have + partner <= rest
        # a piece can only be its own partner if there are two; else the next shorter one is
        alone = fits & (partner == have) & (left[have] < 2)
        at = np.searchsorted(have, have[alone]) - 1
        partner[alone] = np.where(at >= 0, have[np.maximum(at, 0)], 0)
        fits[alone] = at >= 0
        pairs = np.where(fits, have + partner, 0)
        if pairs.max() <= most:
            return (most,)
        second = int(partner[-1]) if fits[-1] else 0
        if not second:
            return None
        both_longer = fits & (np.minimum(have, partner) > second)
        return (most, second) if not both_longer.any() or pairs[both_longer].max() <= most else None

    def best_fit(self) -> None:
        """Longest first, each into the bin with the least room that holds it; equal bins are filled together."""
        room: dict[int, list] = {}
        has = np.zeros(self.capacity + 1, bool)

        def put(space: int, pattern: tuple, n: int) -> None:
            if n:
                room.setdefault(space, []).append((pattern, n))
                has[space] = True

        for length in range(self.capacity, 0, -1):
            n = int(self.left[length])
            while n:
                open_ = np.flatnonzero(has[length:])
                if len(open_):
                    space = int(open_[0]) + length
                    pattern, bins = room[space].pop()
                    has[space] = bool(room[space])
                else:
                    space, pattern, bins = self.capacity, (), n
                each = space // length
                full = min(bins, n // each)
                put(space - each * length, (*pattern, (length, each)), full)
                n -= full * each
                bins -= full
                if n and bins:  # fewer than a bin takes
                    put(space - n * length, (*pattern, (length, n)), 1)
                    n, bins = 0, bins - 1
                if pattern:
                    put(space, pattern, bins)
        self.kinds += [x for group in room.values() for x in group]
        self.left[:] = 0

    @property
    def bins(self) -> int:
        return sum(n for _, n in self.kinds)

    def slots(self) -> dict[int, np.ndarray]:
        """length -> rows (first rank, times per bin, first bin, offset in the bin), by first rank."""
        out: dict[int, list] = {}
        ranks: dict[int, int] = {}
        first = 0
        for pattern, n in self.kinds:
            offset = 0
            for length, times in pattern:
                out.setdefault(length, []).append((ranks.get(length, 0), times, first, offset))
                ranks[length] = ranks.get(length, 0) + times * n
                offset += length * times
            first += n
        return {length: np.array(rows, np.int64) for length, rows in out.items()}


def place(length: np.ndarray, rank: np.ndarray, slots: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of pieces by length and rank within the length."""
    bin_, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
    for n in np.unique(length):
        at = np.flatnonzero(length == n)
        rows = slots[int(n)]
        row = rows[np.searchsorted(rows[:, 0], rank[at], side="right") - 1]
        k = rank[at] - row[:, 0]
        bin_[at] = row[:, 2] + k // row[:, 1]
        offset[at] = row[:, 3] + k % row[:, 1] * n
    return bin_, offset


def ranked(parts: DataFrame, order: list[str], bucket: int = BUCKET) -> DataFrame:
    """``parts`` with ``rank`` from 0 within each length."""
    n = max(1, -(-parts.count() // bucket))
    dealt = parts.withColumn("bucket", F.pmod(F.xxhash64(*order), F.lit(n)).cast("int"))
    counts = dealt.groupBy("length", "bucket").count()
    before = F.sum("count").over(Window.partitionBy("length").orderBy("bucket")) - F.col("count")
    inside = F.row_number().over(Window.partitionBy("length", "bucket").orderBy(*order)) - 1
    offsets = counts.select("length", "bucket", before.alias("before"))
    return dealt.withColumn("inside", inside).join(offsets, ["length", "bucket"]).withColumn("rank", F.col("inside") + F.col("before")).drop("inside", "before", "bucket")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, files=None) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset), a row per piece."""
    parts = materialise(pieces(docs, id_col, text_col, capacity, files), "pieces")
    counts = {r["length"]: r["count"] for r in parts.groupBy("length").count().collect()}  # capacity rows at most
    slots = docs.sparkSession.sparkContext.broadcast(Plan(counts, capacity).slots())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            bin_, offset = place(length, rank, slots.value)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(bin_), pa.array(offset)], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    columns = [id_col, "piece", "start", "length", "ids_crc32"]
    rows = ranked(parts, [id_col, "piece"]).select(*columns, "rank")
    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
