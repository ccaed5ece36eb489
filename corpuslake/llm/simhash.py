"""SimHash near-duplicates (4) by anchor points of a covering code.

Fingerprint: the words of the text (A-Z lower-cased, split at ASCII white space)
give shingles of ``WORDS`` words; a bit is set if it is set in over half the
shingles' XXH64 values. Fingerprints that differ in at most ``threshold`` bits
are linked, and a document's class is what it can reach.

Anchors. The 64 bits are dealt to ``threshold // 2 + 1`` segments, so two linked
fingerprints differ by at most 1 bit in one of them. In each segment the anchors are
the words of a perfect Hamming code on its first 15 bits, with its other bits
free: every segment value is within radius 1 of one anchor, its home. A
fingerprint is copied to every anchor within radius + 1 in the code's bits, or one
free bit away (at most 14 of them); so of two linked fingerprints each reaches the home of the other,
and it is enough to compare, per anchor, those at home there with all its members.
No fingerprint meets more than a 10,000th or so of the others.

Equal fingerprints are grouped before, so exact copies take part once. An anchor with over
``BLOCK`` members is cut into blocks by hash, and pairs of blocks are compared, each
in its own group of rows. What leaves a comparison is a spanning forest of the
links found there, never all pairs; any link between different fingerprints is in
the closure of these. Components are then found by joins (see ``components``).

Cases: null and empty texts, and texts without words, have fingerprint zero and
link as any other. A null id takes no part in the least id of a class (if all are null, the
class id is null). Repeated rows stay repeated.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslake.llm.common import materialise, per_text
from corpuslake.llm.components import components

BITS, SEED, WORDS, THRESHOLD = 64, 42, 4, 4
CODE_BITS = 15
#: Members of an anchor, or of a block of a larger one, that are compared in one group.
BLOCK = 4096
#: Groups of up to so many rows are compared together, larger ones home by home.
SMALL = 1024
#: Candidate pairs compared at once, to bound memory.
AT_ONCE = 1 << 20


def fingerprint(text: Column, words: int = WORDS) -> Column:
    """64-bit fingerprint of a text as a (signed) long."""
    return per_text(lambda texts: pa.array([simhash(t, words) for t in texts], pa.int64()), "long")(text)


def simhash(text: bytes | None, size: int) -> int:
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) < size:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False))
    digest = xxhash.xxh64_intdigest
    return majority(np.fromiter((digest(s, SEED) for s in shingles), np.uint64, max(1, len(words) - size + 1)))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half the hashes, as a (signed) long."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes)).view(">u8")[0].astype(np.uint64).view(np.int64))


def segments(threshold: int) -> list[np.ndarray]:
    """Bit numbers of each segment: the 64 bits are dealt out in turn."""
    n = threshold // 2 + 1
    return [np.arange(i, BITS, n) for i in range(n)]


def anchors(prints: np.ndarray, threshold: int = THRESHOLD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the fingerprint, anchor key, at home there) of every copy that is made."""
    at, keys, home = [], [], []
    everyone = np.arange(len(prints))
    for number, bits in enumerate(segments(threshold)):
        value = np.zeros(len(prints), np.int64)
        for i, bit in enumerate(bits):
            value |= ((prints >> np.uint64(bit)) & np.uint64(1)).astype(np.int64) << i
        syndrome = np.zeros(len(prints), np.int64)
        for i in range(CODE_BITS):
            syndrome ^= ((value >> i) & 1) * (i + 1)
        own = value ^ np.where(syndrome > 0, np.int64(1) << np.maximum(syndrome - 1, 0), 0)
        mark = np.int64(number) << 40

        def put(rows, anchor, is_home, mark=mark):
            at.append(rows)
            keys.append(anchor | mark)
            home.append(np.full(len(rows), is_home))

        put(everyone, own, True)
        for i in range(CODE_BITS, len(bits)):  # a free bit differs
            put(everyone, own ^ (np.int64(1) << i), False)
        for i in range(CODE_BITS):  # code words two bits away: flip bit i, then the one that makes a word of it
            j = (syndrome ^ (i + 1)) - 1
            rows = np.flatnonzero((syndrome > 0) & (j > i))
            put(rows, value[rows] ^ (np.int64(1) << i) ^ (np.int64(1) << j[rows]), False)
    return np.concatenate(at), np.concatenate(keys), np.concatenate(home)


def _copies(threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = batch.column(0).to_numpy(zero_copy_only=False)
            for start in range(0, len(prints), 4096):
                part = prints[start : start + 4096]
                at, keys, home = anchors(part.view(np.uint64), threshold)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(part[at]), pa.array(home)], names=["anchor", "fp", "home"])

    return run


class Forest:
    """Links that join what was not joined yet."""

    def __init__(self):
        self.parent: dict = {}

    def root(self, x):
        parent = self.parent
        while (p := parent.get(x, x)) != x:
            parent[x] = parent.get(p, p)
            x = p
        return x

    def add(self, a, b) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True


def _bucket_links(homes: np.ndarray, members: np.ndarray, threshold: int) -> Iterator[tuple[int, int]]:
    """Forest of the links between homes and members of one group, of at most ``BLOCK`` each."""
    group = np.arange(len(members))
    place = {int(x): i for i, x in enumerate(members)}
    for x in homes:
        near = np.flatnonzero(np.bitwise_count(members.view(np.uint64) ^ x.view(np.uint64)) <= threshold)
        mine = place.get(int(x))
        labels, first = np.unique(group[near], return_index=True)
        if mine is None:  # it is not a member of this block: linked to each part, and so these are to each other
            yield from ((int(x), int(members[near[i]])) for i in first)
        else:
            yield from ((int(x), int(members[near[i]])) for label, i in zip(labels, first, strict=True) if label != group[mine])
        if len(labels) > 1:
            group[np.isin(group, labels)] = labels[0]


def _links(threshold: int):
    """Rows sorted by group, as (group..., fp, home); a group never spans two calls of ``flush``."""

    def flush(key: np.ndarray, fp: np.ndarray, home: np.ndarray) -> Iterator[pa.RecordBatch]:
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.r_[starts, len(key)])
        found, forest = [], Forest()
        small = sizes <= SMALL
        for s, n in zip(starts[~small], sizes[~small], strict=True):
            h, f = home[s : s + n], fp[s : s + n]
            found += [p for p in _bucket_links(f[h > 0], f[h < 2], threshold) if forest.add(*p)]
        group = np.repeat(np.arange(len(starts)), sizes)
        who = np.flatnonzero((home > 0) & small[group])
        work = np.cumsum(sizes[group[who]])
        cut = np.searchsorted(work, np.arange(AT_ONCE, (work[-1] if len(work) else 0) + AT_ONCE, AT_ONCE), side="right")
        for part in np.split(who, np.unique(cut)):
            n = sizes[group[part]]
            x = np.repeat(part, n)
            y = np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[group[part]], n)
            near = np.flatnonzero((np.bitwise_count(fp[x].view(np.uint64) ^ fp[y].view(np.uint64)) <= threshold) & (fp[x] != fp[y]))
            found += [p for p in zip(fp[x[near]].tolist(), fp[y[near]].tolist(), strict=True) if forest.add(*p)]
        if found:
            a, b = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        for batch in batches:
            new = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            held = [np.concatenate(x) for x in zip(held, new, strict=True)] if held else new
            last = np.flatnonzero((held[0][1:] != held[0][:-1]) | (held[1][1:] != held[1][:-1]))
            if len(last) and len(held[0]) > 1 << 16:
                edge = last[-1] + 1
                yield from flush(_group_numbers(held[0][:edge], held[1][:edge]), held[2][:edge], held[3][:edge])
                held = [x[edge:] for x in held]
        if held and len(held[0]):
            yield from flush(_group_numbers(held[0], held[1]), held[2], held[3])

    return run


def _group_numbers(anchor: np.ndarray, cell: np.ndarray) -> np.ndarray:
    return np.cumsum(np.r_[0, (anchor[1:] != anchor[:-1]) | (cell[1:] != cell[:-1])])


def links(prints: DataFrame, threshold: int = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """(a, b) links that span every class of distinct fingerprints in column ``fp``; not all pairs of a class."""
    copies = materialise(prints.select("fp").mapInArrow(_copies(threshold), "anchor long, fp long, home boolean"), "anchors")
    large = copies.groupBy("anchor").count().where(F.col("count") > block)
    parts = large.select("anchor", F.ceil(F.col("count") / block).cast("int").alias("parts"))
    dealt = copies.join(parts, "anchor", "left").withColumn("n", F.coalesce("parts", F.lit(1)))
    mine = F.pmod(F.xxhash64("fp"), F.col("n")).cast("int")
    others = F.sequence(F.lit(0), F.col("n") - 1)
    # one block: a row that is at home serves as both (1). Otherwise its two parts go to a row (2) and a column (0) of cells.
    alone = F.array(F.struct(F.lit(0).alias("cell"), F.when(F.col("home"), 1).otherwise(0).alias("role")))
    across = F.transform(others, lambda i: F.struct((i * F.col("n") + mine).alias("cell"), F.lit(0).alias("role")))
    down = F.transform(others, lambda i: F.struct((mine * F.col("n") + i).alias("cell"), F.lit(2).alias("role")))
    cells = F.when(F.col("n") == 1, alone).otherwise(F.concat(across, F.when(F.col("home"), down).otherwise(F.array().cast("array<struct<cell:int,role:int>>"))))
    rows = dealt.select("anchor", "fp", F.explode(cells).alias("c")).select("anchor", F.col("c.cell").alias("cell"), "fp", F.col("c.role").alias("role"))
    grouped = rows.repartition("anchor", "cell").sortWithinPartitions("anchor", "cell")
    return grouped.mapInArrow(_links(threshold), "a long, b long").distinct()


def near_duplicates(prints: DataFrame, id_col: str, threshold: int = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """``prints`` (with a long column ``fp``) plus ``component_id``: the least id that each row can reach."""
    classes = materialise(prints.groupBy("fp").agg(F.min(id_col).alias("least")), "classes")
    reached = materialise(components(links(classes, threshold, block), "a", "b"), "reached")
    least = reached.join(classes, reached["node"] == classes["fp"]).groupBy("root").agg(F.min("least").alias("component_id"))
    named = reached.join(least, "root").select(F.col("node").alias("fp"), "component_id")
    by_print = classes.join(named, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    return prints.join(by_print, "fp", "left")


def simhash_clusters(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """(id, fingerprint as 16 hex digits, component_id), a row per document."""
    prints = materialise(docs.select(F.col(id_col).alias("id"), fingerprint(F.col(text_col)).alias("fp")), "fingerprints")
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return near_duplicates(prints, "id", threshold).select(F.col("id").alias(id_col), hexed.alias("fingerprint"), "component_id")


def keep_one(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: int = THRESHOLD,
    words: int = WORDS,
    block: int = BLOCK,
) -> DataFrame:
    """One document of each class, with its columns: that of least id (null last); of rows with equal ids, one."""
    names = docs.columns
    packed = docs.select(F.struct(*names).alias("doc"), fingerprint(F.col(text_col), words).alias("fp"))
    rows = materialise(packed.withColumn("row", F.monotonically_increasing_id()), "fingerprinted")
    prints = rows.select("fp", "row", F.col("doc")[id_col].alias("id"))
    order = F.struct(F.col("id").isNull().alias("no_id"), "id", "row")
    best = materialise(prints.groupBy("fp").agg(F.min(order).alias("best")), "best")
    reached = materialise(components(links(best, threshold, block), "a", "b"), "reached")
    kept = (
        best.join(reached, best["fp"] == reached["node"], "left")
        .groupBy(F.coalesce("root", "fp").alias("root"))
        .agg(F.min("best")["row"].alias("row"))
    )
    return rows.join(kept, "row", "left_semi").select("doc.*")
