"""Near-duplicates by exact shingle similarity: one document of each class, for the pipeline.

Two texts are linked if the Jaccard similarity of their sets of word shingles (XXH64 values; words as in
``simhash``) is at least ``SHARE``, an exact fraction; a document's class is what it can reach. No link is missed
and none is added. Candidates come from three sources, and each is compared by its whole sets:

1. Fingerprints (4): the links that ``simhash`` finds between fingerprints of five-word shingles by its anchors.
2. Prefixes. With the shingles of all texts in one common order, two linked sets share a shingle among the first
   n - ceil(SHARE n) + 1 of each. Any order is right; shingles that are common in a sample of texts come last, so
   that prefixes hold rare ones. Shingles of one prefix only are dropped where they are first met. Texts that share a
   prefix shingle are each compared with one of them (a star), so a large group of copies costs its size, not its square.
3. What shares a prefix shingle and is still in different classes is compared in blocks, first by size, place and parity
   bitmap. A bitmap holds for each of some cells whether an odd number of the set's shingles fall there: two sets differ in at least
   as many shingles as their bitmaps in bits, so a pair with too many is out for certain. Nearly all that remain are links.
   In ``ROUNDS`` rounds, each over a share of the shingles, every text gives only the nearest one of another class, and what is linked
   becomes one class; the last round takes all shingles and every pair that is left, so it is exact and finds little to do.

Equal sets are grouped before, so exact copies take part once. A shingle that the sample shows to be hot is dealt to
several tasks by a hash of the text, and in step 3 a shingle with more than ``BLOCK`` texts is compared block by block.

Cases: null and empty texts, and texts without words, have the empty set and are equal. Texts of fewer words than a
shingle have one shingle of all. Null ids come last; repeated rows count as copies.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslake.functions.scale import discard, hint_small, is_small
from corpuslake.llm import simhash
from corpuslake.llm.common import as_bytes, materialise, per_text
from corpuslake.llm.components import components
from corpuslake.llm.simhash import SEED

WORDS = 5
#: Least similarity, as a fraction.
SHARE = (4, 5)
#: Texts that the order of shingles is taken from, and shingles that it puts last, at most; they decide speed, not results.
SAMPLE, COMMON = 20_000, 100_000
#: Texts of a shingle that one group holds; members that one copy of a set is compared with.
BLOCK, MEMBERS = 1024, 512
#: Rounds in which a text names its nearest only, each over one shingle in ``PART``; they decide speed, not results.
ROUNDS, PART = 2, 8
#: Pairs of a group that are looked at at once.
AT_ONCE = 1 << 20


def hashes(text: bytes | None, size: int) -> np.ndarray:
    """XXH64 of each shingle, repeats included."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    parts = [b" ".join(words)] if len(words) < size else map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(s, SEED) for s in parts), np.uint64, max(1, len(words) - size + 1))


def shingles(text: bytes | None, size: int) -> np.ndarray:
    """Distinct shingles of a text, ascending, as signed longs."""
    return np.unique(hashes(text, size).view(np.int64))


def shingle_sets(text: Column, size: int) -> Column:
    return per_text(lambda texts: _lists([shingles(t, size) for t in texts]), "array<long>")(text)


def _lists(rows: Sequence[np.ndarray]) -> pa.Array:
    offsets = np.r_[0, np.cumsum([len(r) for r in rows])].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*rows, np.zeros(0, np.int64)])))


def prefix_length(n: int, share: tuple[int, int] = SHARE) -> int:
    over, under = share
    return n - -(-over * n // under) + 1 if n else 0


def parity(s: np.ndarray) -> np.ndarray:
    """Parity bitmap of a set, as 64-bit words: one to two bits a shingle, a power of two, 256 bits at least."""
    bits = 1 << max(8, len(s).bit_length())
    odd = np.bincount(s.view(np.uint64) & np.uint64(bits - 1), minlength=bits).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").view("<u8")


def fold(words: np.ndarray, n: int) -> np.ndarray:
    """The bitmaps (rows of words) in ``n`` words: cells that fall together add up."""
    while words.shape[1] > n:
        half = words.shape[1] // 2
        words = words[:, :half] ^ words[:, half:]
    return words


def common_shingles(texts: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several texts of a sample have, from the least to the most common, and in how many texts they are to be expected; ``COMMON`` at most."""
    parts = texts.count() // SAMPLE + 1
    sample = texts.where(F.pmod(F.xxhash64("text"), F.lit(parts)) == 0).distinct()
    counts = sample.select(F.explode(shingle_sets(F.col("text"), size)).alias("s")).groupBy("s").count().where("count > 1")
    found = counts.orderBy(F.desc("count"), "s").limit(COMMON).toArrow()
    return found["s"].to_numpy()[::-1], found["count"].to_numpy()[::-1] * parts


def _marks(spark, common: np.ndarray, size: int, share: tuple[int, int]):
    """Column function: text -> (key of its set, fingerprint, size of the set, prefix, bitmap)."""
    order = np.argsort(common)
    shared = spark.sparkContext.broadcast((common[order], order.astype(np.int64)))

    def rows(texts: list) -> pa.Array:
        names, ranks = shared.value
        keys, prints, sizes, prefixes, bitmaps = [], [], [], [], []
        for t in texts:
            every = hashes(t, size)
            s = np.unique(every.view(np.int64))
            keys.append(xxhash.xxh3_128_digest(s.tobytes()))
            prints.append(simhash.majority(every) if len(every) else 0)
            sizes.append(len(s))
            rank = np.full(len(s), -1, np.int64)
            if len(names) and len(s):
                at = np.minimum(np.searchsorted(names, s), len(names) - 1)
                rank = np.where(names[at] == s, ranks[at], -1)
            prefixes.append(s[np.argsort(rank, kind="stable")][: prefix_length(len(s), share)])
            bitmaps.append(parity(s).tobytes())
        arrays = [pa.array(keys, pa.binary()), pa.array(prints, pa.int64()), pa.array(sizes, pa.int32()), _lists(prefixes), pa.array(bitmaps, pa.binary())]
        return pa.StructArray.from_arrays(arrays, names=["key", "fp", "size", "prefix", "bitmap"])

    return per_text(rows, "struct<key:binary,fp:long,size:int,prefix:array<long>,bitmap:binary>")


def _may_link(n, m, i, j, share: tuple[int, int]) -> np.ndarray:
    """The sizes, and the places of a shared shingle, of two texts allow for the similarity."""
    over, under = share
    most = np.minimum(i, j) + np.minimum(n - i, m - j)
    return (np.minimum(n, m) * under >= np.maximum(n, m) * over) & (most * (over + under) >= (n + m) * over)


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Starts of runs of equal values."""
    n = len(columns[0])
    change = np.ones(n, bool)
    if n:
        change[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(change)


def _met(share: tuple[int, int]):
    """Rows sorted by (token, part, order): those whose token others have too, with the first of the group if they may be linked with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("token", "part", "hot", "u", "size", "place")
        kept: list | None = None  # the last group's rows so far, if one; else its first row
        first = None  # first row of the group that goes on, when it was already given out

        def out(rows: list, at: np.ndarray, hub: np.ndarray, has: np.ndarray):
            cols = [pa.array(rows[k][at]) for k in (0, 3, 4, 5)]
            return pa.RecordBatch.from_arrays([*cols, pa.array(hub, mask=~has)], names=["token", "u", "size", "place", "hub"])

        def give(rows: list, ahead) -> Iterator[pa.RecordBatch]:
            """Whole groups; ``ahead``: first row of the group that the first rows go on from."""
            n = len(rows[0])
            if not n:
                return
            starts = _runs(rows[0], rows[1])
            sizes = np.diff(np.r_[starts, n])
            group = np.repeat(np.arange(len(starts)), sizes)
            head = [rows[k][starts] for k in range(6)]
            goes_on = ahead is not None and (head[0][0], head[1][0]) == (ahead[0], ahead[1])
            if goes_on:
                for k in range(6):
                    head[k][0] = ahead[k]
            hub = [h[group] for h in head]
            several = (sizes[group] > 1) | (rows[2] > 0)
            if goes_on:
                several[group == 0] = True
            size, place, far, there = (x.astype(np.int64) for x in (rows[4], rows[5], hub[4], hub[5]))
            has = (hub[3] != rows[3]) & _may_link(size, far, place, there, share)
            at = np.flatnonzero(several)
            if len(at):
                yield out(rows, at, hub[3][at], has[at])

        for batch in batches:
            now = [batch.column(x).to_numpy(zero_copy_only=False) for x in names]
            if kept is not None:
                now = [np.concatenate(x) for x in zip(kept, now, strict=True)]
            if not len(now[0]):
                continue
            edge = _runs(now[0], now[1])[-1]  # the last group may go on
            if len(now[0]) - edge > 1:  # and has several rows already: they can go, its first row is remembered
                edge = len(now[0])
            done = [x[:edge] for x in now]
            yield from give(done, first)
            if edge == len(now[0]):
                start = _runs(now[0], now[1])[-1]
                if first is None or (first[0], first[1]) != (now[0][start], now[1][start]):
                    first = [x[start] for x in now]
                kept = None
            else:
                kept = [x[edge:] for x in now]
                if edge:
                    last = _runs(done[0], done[1])[-1]
                    if first is not None and (first[0], first[1]) != (done[0][last], done[1][last]):
                        first = None
        if kept is not None:
            yield from give(kept, first)

    return run


def _across(share: tuple[int, int], nearest: bool):
    """Rows sorted by (token, cell), as (token, cell, role, u, root, size, place, bitmap): pairs of different classes that may be linked.

    Role 0 is a member, 2 is compared with the members, 1 is both. With ``nearest`` a text gives the pair with fewest different bits only.
    """
    over, under = share

    def compare(rows: list, seen: set) -> Iterator[tuple[int, int]]:
        left, right = np.flatnonzero(rows[2] > 0), np.flatnonzero(rows[2] < 2)
        widths = np.array([len(b) // 8 for b in rows[7]])
        tables = {w: np.frombuffer(b"".join(rows[7][i] for i in np.flatnonzero(widths == w)), "<u8").reshape(-1, w) for w in np.unique(widths)}
        inside = np.zeros(len(widths), np.int64)
        for w in tables:
            inside[widths == w] = np.arange((widths == w).sum())
        step = max(1, AT_ONCE // max(1, len(right)))
        for start in range(0, len(left), step):
            x, y = (a.ravel() for a in np.meshgrid(left[start : start + step], right, indexing="ij"))
            u, v = rows[3][x], rows[3][y]
            n, m, i, j = (a.astype(np.int64) for a in (rows[5][x], rows[5][y], rows[6][x], rows[6][y]))
            fit = (u != v) & (rows[4][x] != rows[4][y]) & _may_link(n, m, i, j, share)
            x, y, n, m = x[fit], y[fit], n[fit], m[fit]
            near, apart = np.zeros(len(x), bool), np.zeros(len(x), np.int64)
            for a in tables:
                for b in tables:
                    at = np.flatnonzero((widths[x] == a) & (widths[y] == b))
                    w = min(a, b)
                    for part in np.array_split(at, len(at) * w // AT_ONCE + 1):
                        d = fold(tables[a][inside[x[part]]], w) ^ fold(tables[b][inside[y[part]]], w)
                        bits = np.bitwise_count(d).sum(axis=1, dtype=np.int64)
                        near[part] = bits * (over + under) <= (n[part] + m[part]) * (under - over)
                        apart[part] = bits
            if nearest:
                keep = np.flatnonzero(near)
                keep = keep[np.lexsort((apart[keep], x[keep]))]
                near[:] = False
                near[keep[_runs(x[keep])]] = True
            for a, b in zip(rows[3][x[near]].tolist(), rows[3][y[near]].tolist(), strict=True):
                pair = (min(a, b), max(a, b))
                if pair not in seen:
                    seen.add(pair)
                    yield pair

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list | None = None

        def flush(rows: list) -> Iterator[pa.RecordBatch]:
            seen: set = set()
            starts = np.r_[_runs(rows[0], rows[1]), len(rows[0])]
            found = [p for s, e in zip(starts[:-1], starts[1:], strict=True) for p in compare([r[s:e] for r in rows], seen)]
            if found:
                a, b = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            now = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(8)]
            held = now if held is None else [np.concatenate(x) for x in zip(held, now, strict=True)]
            edge = _runs(held[0], held[1])[-1] if len(held[0]) else 0
            if edge:
                yield from flush([x[:edge] for x in held])
                held = [x[edge:] for x in held]
        if held is not None and len(held[0]):
            yield from flush(held)

    return run


def _verify(size: int, share: tuple[int, int]):
    """Rows sorted by (a, part, member), as (a, part, member, b, text): the first of a group is a's own text; links (a, b)."""
    over, under = share

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own = None, np.zeros(0, np.int64)
        for batch in batches:
            a, part, member, b = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
            left, right = [], []
            for i, text in enumerate(as_bytes(batch.column(4))):
                s = shingles(text, size)
                if not member[i]:
                    key, own = (a[i], part[i]), s
                elif key == (a[i], part[i]):
                    common = int((own[np.minimum(np.searchsorted(own, s), len(own) - 1)] == s).sum()) if len(own) and len(s) else 0
                    if common * (over + under) >= (len(own) + len(s)) * over:
                        left.append(a[i])
                        right.append(b[i])
            if left:
                yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    return run


def _linked(pairs: DataFrame, text_of: DataFrame, size: int, share: tuple[int, int]) -> DataFrame:
    """Those of the stored pairs (a, b) whose sets have the similarity. A pair moves the text of b, and a's own once for ``MEMBERS`` of them."""
    small = is_small(pairs)
    n = pairs.groupBy("a").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("parts"))
    dealt = pairs.join(hint_small(n, small), "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), "b")
    members = text_of.join(hint_small(dealt, small), text_of["u"] == dealt["b"]).select("a", "part", F.lit(True).alias("member"), "b", "text")
    parts = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    heads = text_of.join(hint_small(n, small), text_of["u"] == n["a"]).select("a", parts, F.lit(False).alias("member"), F.col("u").alias("b"), "text")
    rows = members.union(heads).repartition("a", "part").sortWithinPartitions("a", "part", "member")
    return rows.select("a", "part", "member", "b", F.col("text").cast("binary")).mapInArrow(_verify(size, share), "a long, b long")


def classes(marked: DataFrame, text_of: DataFrame, size: int, share: tuple[int, int] = SHARE, common: tuple | None = None) -> DataFrame | None:
    """(node, root) of the texts that are linked with another; None if none is.

    marked: (u, fp, size, prefix, bitmap), a row per distinct set; text_of: (u, text), which may have more rows.
    """
    spark = marked.sparkSession
    names, expected = common or (np.zeros(0, np.int64), np.zeros(0, np.int64))
    warm = [(int(t), int(n // BLOCK) + 1) for t, n in zip(names, expected, strict=True) if n > BLOCK]
    hot = spark.createDataFrame(warm, "token long, parts int")  # at most COMMON rows
    tokens = marked.select("u", "size", F.posexplode("prefix").alias("place", "token")).join(F.broadcast(hot), "token", "left")
    part = F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("u"), F.col("parts"))).cast("int")
    dealt = tokens.select("token", part.alias("part"), F.coalesce("parts", F.lit(0)).alias("hot"), "u", "size", "place")
    grouped = dealt.repartition("token", "part").sortWithinPartitions("token", "part", F.xxhash64("u"))
    met = materialise(grouped.mapInArrow(_met(share), "token long, u long, size int, place int, hub long"), "met")
    pair = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    stars = met.where("hub is not null").select(*pair("u", "hub"))
    # fingerprints: texts of one print with the least of them, and the least of linked prints with each other
    prints = materialise(marked.groupBy("fp").agg(F.min("u").alias("least"), F.count("*").alias("n")), "prints")
    same = marked.join(prints.where("n > 1"), "fp").where("u <> least").select(*pair("u", "least"))
    found = simhash.links(prints.select("fp"))
    of = lambda x: prints.select(F.col("fp").alias(x), F.col("least").alias(f"u_{x}"))
    near = found.join(of("a"), "a").join(of("b"), "b").select(*pair("u_a", "u_b"))
    tested = materialise(stars.union(same).union(near).distinct(), "pairs")
    links = materialise(_linked(tested, text_of, size, share), "links")
    reached = None if links.isEmpty() else materialise(components(links, "a", "b"), "reached")
    # what still meets in different classes
    for turn in [*range(ROUNDS), None]:
        rest = _apart(met, marked, reached, share, turn)
        more = materialise(rest.join(tested, ["a", "b"], "left_anti"), "more")
        if more.isEmpty():
            discard(more)
            continue
        new = materialise(_linked(more, text_of, size, share), "links")
        tested = tested.union(more)
        if not new.isEmpty():
            links = links.union(new)
            before, reached = reached, materialise(components(links, "a", "b"), "reached")
            discard(before)
    discard(met, prints)
    return reached


def _apart(met: DataFrame, marked: DataFrame, reached: DataFrame | None, share: tuple[int, int], turn: int | None) -> DataFrame:
    """(a, b) of different classes that a shingle, the sizes and the bitmaps allow to be linked; all of them if ``turn`` is None."""
    now = met.drop("hub") if turn is None else met.drop("hub").where(F.pmod("token", F.lit(PART)) == turn)
    if reached is None:
        now = now.withColumn("root", F.col("u"))
    else:
        now = now.join(hint_small(reached, is_small(reached)), now["u"] == reached["node"], "left").select(*now.columns, F.coalesce("root", "u").alias("root"))
    several = now.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n")).where("low < high")
    several = several.select("token", F.ceil(F.col("n") / BLOCK).cast("int").alias("n"))
    left = now.join(several, "token").join(marked.select("u", "bitmap"), "u")
    mine = F.pmod(F.xxhash64("u"), F.col("n")).cast("int")
    others = F.sequence(F.lit(0), F.col("n") - 1)
    cell = lambda x, role: F.struct(x.cast("int").alias("cell"), F.lit(role).alias("role"))
    across, down = F.transform(others, lambda i: cell(i * F.col("n") + mine, 0)), F.transform(others, lambda i: cell(mine * F.col("n") + i, 2))
    cells = F.when(F.col("n") == 1, F.array(cell(F.lit(0), 1))).otherwise(F.concat(across, down))
    rows = left.select("*", F.explode(cells).alias("c")).select("token", "c.cell", "c.role", "u", "root", "size", "place", "bitmap")
    sorted_rows = rows.repartition("token", "cell").sortWithinPartitions("token", "cell")
    return sorted_rows.mapInArrow(_across(share, turn is not None), "a long, b long").distinct()


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, share: tuple[int, int] = SHARE) -> DataFrame:
    """One document of each class, with its columns: that of least id (null last); of rows with equal ids, one."""
    names = docs.columns
    common = common_shingles(docs.select(F.col(text_col).alias("text")), words)
    mark = _marks(docs.sparkSession, common[0], words, share)(F.col(text_col))
    rows = docs.select(F.struct(*names).alias("doc"), mark.alias("mark")).withColumn("row", F.monotonically_increasing_id())
    rows = materialise(rows, "marked")
    order = F.struct(F.col("doc")[id_col].isNull().alias("no_id"), F.col("doc")[id_col].alias("id"), "row")
    best = materialise(rows.groupBy("mark.key").agg(F.min(order).alias("best")), "best")
    marked = rows.select("row", "mark").join(best.select(F.col("best.row").alias("row")), "row", "left_semi")
    marked = materialise(marked.select(F.col("row").alias("u"), "mark.fp", "mark.size", "mark.prefix", "mark.bitmap"), "sets")
    reached = classes(marked, rows.select(F.col("row").alias("u"), F.col("doc")[text_col].alias("text")), words, share, common)
    kept = best.select("key", F.col("best").alias("b"))
    if reached is not None:
        kept = best.join(reached, best["best.row"] == reached["node"], "left").groupBy(F.coalesce("root", "best.row")).agg(F.min("best").alias("b"))
    kept = materialise(kept.select(F.col("b.row").alias("row")), "kept")
    gone = materialise(rows.select("row").join(kept, "row", "left_anti"), "gone")
    out = rows.join(hint_small(gone, is_small(gone)), "row", "left_anti").select("doc.*")
    discard(best, marked, kept)
    return out
