"""Exact top-k search (13) by inner product over a vector-approximation file.

Every distinct vector is stored once with an approximation: the cell of each component on a grid of 2^``BITS`` cells between the
least and largest value at that place. Approximations are a column of their own, so a pass over them reads a fraction of the vectors.
For a query, a cell's corners bound the score from below and above.

1. A pass over the approximations finds, for each query, the k-th best lower bound.
2. A second pass keeps the vectors whose upper bound reaches it: the candidates.
3. Exact vectors are read in the order of the bounds, best first: ``FIRST`` times k of each query, then those whose bound still
   reaches the k-th exact score. What is left cannot be among the first k, so the result is certain.

Queries are taken in blocks of bounded bytes; each block is broadcast and meets all approximations map-side, and a task keeps k
bounds a query. Equal vectors are searched as one: of the ids that share a vector only the k + 1 least can be in a result (one may
be the query's own), and equal queries are asked once. So a vector that a third of all rows hold costs one row and one query.

Results are exact whatever ``BITS``, ``BLOCK_BYTES`` and ``FIRST`` are. Scores are whole numbers (see ``lattice``).

Cases: vectors that are null or hold null or non-finite components take no part, neither as queries nor as candidates. Vectors meet
those of their own length only; empty ones score 0. Equal scores fall to the smaller id, null ids last. A row is left out of its own
result, other rows with the same id are not. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslake.functions.scale import discard, hint_small, is_small
from corpuslake.llm.common import materialise
from corpuslake.llm.lattice import by_length, checked, kind_for, matrix, packed, ranges, whole

#: Bits of a component's cell; bytes of a block of queries (as doubles); exact vectors read at first, times k.
BITS, BLOCK_BYTES, FIRST = 6, 32 << 20, 2
#: Vectors and queries that meet at once in a task.
VECTORS, ASKED = 4096, 512
#: Parts that the ids of one vector are first cut down in.
PARTS = 16


class Grid:
    """Cells of the components of vectors of one length."""

    def __init__(self, lo: np.ndarray, hi: np.ndarray, bits: int):
        self.bits, self.lo = bits, lo
        self.width = np.maximum(1.0, np.ceil((hi - lo + 1) / (1 << bits)))  # whole numbers a cell holds

    def cells(self, m: np.ndarray) -> pa.Array:
        cell = np.floor((m - self.lo) / self.width).astype(np.uint8)
        bits = np.unpackbits(cell[:, :, None], axis=2)[:, :, 8 - self.bits :]
        return pa.array([r.tobytes() for r in np.packbits(bits.reshape(len(m), -1), axis=1)], pa.binary())

    def corners(self, data: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest vector of each stored cell."""
        n, size = len(self.lo), -(-len(self.lo) * self.bits // 8)
        raw = np.frombuffer(b"".join(data.to_pylist()), np.uint8).reshape(len(data), size)
        bits = np.unpackbits(raw, axis=1)[:, : n * self.bits].reshape(len(data), n, self.bits)
        cell = (bits.astype(np.float64) * (1 << np.arange(self.bits)[::-1])).sum(axis=2)
        low = self.lo + cell * self.width
        return low, low + self.width - 1


def _meet(batches: Iterator[pa.RecordBatch], queries: np.ndarray, grid: Grid, above: bool):
    """(nodes, first query, bounds from above or below, queries x vectors) for blocks of both."""
    plus, minus = np.maximum(queries, 0), np.minimum(queries, 0)
    for batch in batches:
        for start in range(0, len(batch), VECTORS):
            part = batch.slice(start, VECTORS)
            low, high = grid.corners(part.column("cells"))
            with_plus, with_minus = (high, low) if above else (low, high)
            nodes = part.column("node").to_numpy(zero_copy_only=False)
            for q in range(0, len(queries), ASKED):
                yield nodes, q, plus[q : q + ASKED] @ with_plus.T + minus[q : q + ASKED] @ with_minus.T


def _lower(shared, grid: Grid, k: int):
    """The k best lower bounds of each query among a task's vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = shared.value
        best = np.full((len(queries), k), -np.inf)
        for _, q, lower in _meet(batches, queries, grid, above=False):
            both = np.concatenate([best[q : q + ASKED], lower], axis=1)
            best[q : q + ASKED] = np.partition(both, -k, axis=1)[:, -k:]
        rows, at = np.nonzero(best > -np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(best[rows, at])], names=["q", "bound"])

    return run


def _reaching(shared, grid: Grid, least: np.ndarray):
    """The vectors whose upper bound reaches ``least`` of a query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for nodes, q, upper in _meet(batches, shared.value, grid, above=True):
            rows, at = np.nonzero(upper >= least[q : q + ASKED, None])
            yield pa.RecordBatch.from_arrays([pa.array(rows + q), pa.array(nodes[at]), pa.array(upper[rows, at])], names=["q", "node", "bound"])

    return run


def _score(shared, kind: str, n: int) -> Column:
    def score(q: pa.Array, v: pa.Array) -> pa.Array:
        mine = shared.value[q.to_numpy(zero_copy_only=False)].astype(np.int64)
        return pa.array((mine * matrix(v, kind, n)).sum(axis=1))

    score.__annotations__ = {"q": pa.Array, "v": pa.Array, "return": pa.Array}
    return F.arrow_udf(score, "long")("q", "v")


def _kth(found: DataFrame, col: str, k: int) -> DataFrame:
    """(q, least): the k-th largest value, or none if there are fewer."""
    ranked = found.select("q", col, F.row_number().over(Window.partitionBy("q").orderBy(F.desc(col))).alias("r")).where(F.col("r") <= k)
    return ranked.groupBy("q").agg(F.min(col).alias("least"), F.count("*").alias("n")).where(F.col("n") == k)


def _filled(rows: list, n: int) -> np.ndarray:
    least = np.full(n, -np.inf)
    for r in rows:
        least[r["q"]] = r["least"]
    return least


def _stored(rows: DataFrame, kind: str) -> DataFrame:
    """(id, asked, v) with vectors as bytes."""

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, m in by_length(batch.column(2)):  # one length
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), packed(m, kind)], names=["id", "asked", "v"])

    return rows.select("id", "asked", "v").mapInArrow(store, "id long, asked boolean, v binary")


def _distinct(rows: DataFrame, n: int, k: int, kind: str, grid: Grid) -> DataFrame:
    """(node, asked, ids, v, cells): distinct vectors, with the k + 1 least of their ids and whether one is a query."""
    rows = _stored(rows, kind)
    rows = rows.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(PARTS)))
    order = Window.partitionBy("v", "part").orderBy(F.asc_nulls_last("id"))
    flags = rows.where("asked").groupBy("v").agg(F.lit(True).alias("asked"))
    few = rows.select("v", "id", F.row_number().over(order).alias("r")).where(F.col("r") <= k + 1)
    id_or_last = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"))
    ids = few.groupBy("v").agg(F.slice(F.sort_array(F.collect_list(id_or_last)), 1, k + 1).alias("ids"))  # at most PARTS * (k + 1)
    both = ids.join(flags, "v", "left").select("v", F.col("ids.id").alias("ids"), F.coalesce("asked", F.lit(False)).alias("asked"))
    numbered = materialise(both.withColumn("node", F.monotonically_increasing_id()), "nodes")

    def approximate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, grid.cells(matrix(batch.column("v"), kind, n))], names=["node", "asked", "ids", "v", "cells"])

    out = numbered.select("node", "asked", "ids", "v").mapInArrow(approximate, "node long, asked boolean, ids array<long>, v binary, cells binary")
    stored = materialise(out, "file")
    discard(numbered)
    return stored


def _block(file: DataFrame, nodes: np.ndarray, queries: np.ndarray, grid: Grid, kind: str, k: int, first: int, slack: float) -> DataFrame:
    """(asked, node, ids, score): the vectors that hold the k best rows of each query of a block."""
    spark, n = file.sparkSession, queries.shape[1]
    shared = spark.sparkContext.broadcast(queries)
    cells = file.select("node", "cells")
    bounds = cells.mapInArrow(_lower(shared, grid, k), "q long, bound double")
    least = _filled(_kth(bounds, "bound", k).collect(), len(queries)) - slack
    left = materialise(cells.mapInArrow(_reaching(shared, grid, least), "q long, node long, bound double"), "candidates")
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("bound"), "node"))
    head = materialise(left.withColumn("r", place).where(F.col("r") <= first * k).drop("r"), "head")

    def exact(pairs: DataFrame) -> DataFrame:
        hinted = hint_small(pairs, is_small(pairs))
        return file.select("node", "v", "ids").join(hinted, "node").select("q", "node", "ids", _score(shared, kind, n).alias("score"))

    read = materialise(exact(head), "read")
    sure = spark.sparkContext.broadcast(_filled(_kth(read, "score", k).collect(), len(queries)) - slack)

    def reach(q: pa.Array, bound: pa.Array) -> pa.Array:
        return pa.array(bound.to_numpy(zero_copy_only=False) >= sure.value[q.to_numpy(zero_copy_only=False)])

    reach.__annotations__ = {"q": pa.Array, "bound": pa.Array, "return": pa.Array}
    rest = left.where(F.arrow_udf(reach, "boolean")("q", "bound")).join(head.select("q", "node"), ["q", "node"], "left_anti")
    tail = materialise(rest, "tail")
    found = read.unionByName(exact(tail))
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last(F.col("ids")[0])))
    best = found.withColumn("r", rank).where(F.col("r") <= k)
    asked = spark.createDataFrame([(i, int(x)) for i, x in enumerate(nodes)], "q long, asked long")
    out = materialise(best.join(asked, "q").select("asked", "node", "ids", "score"), "best")
    discard(left, head, read, tail)
    return out


def _search(rows: DataFrame, n: int, lo: np.ndarray, hi: np.ndarray, k: int, bits: int, block_bytes: int, first: int) -> DataFrame:
    """(query_id, rank, id, score) for the rows (id, asked, v) of length n."""
    most = float(max(np.abs(lo).max(initial=0), np.abs(hi).max(initial=0))) + 2**bits
    kind, slack = kind_for(most), 0.0 if checked(most, max(n, 1), "scores") else n * most * most * 2.0**-48
    grid = Grid(lo, hi, bits)
    file = _distinct(rows, n, k, kind, grid)
    size = max(1, block_bytes // (8 * max(n, 1)))
    parts = file.where("asked").count() // size + 1
    results = None
    for part in range(parts):
        mark = F.pmod(F.xxhash64("node"), F.lit(parts)) == part
        taken = file.where(F.col("asked") & mark).select("node", "v").toArrow()  # about block_bytes
        if len(taken):
            queries = matrix(taken.column("v"), kind, n).astype(np.float64)
            best = _block(file, taken.column("node").to_numpy(), queries, grid, kind, k + 1, first, slack)
            results = best if results is None else results.unionByName(best)
    if results is None:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, id long, score long")
    # the k + 1 best rows of each distinct query; each of its rows leaves itself out of them
    own = F.when(F.col("node") == F.col("asked"), 0).otherwise(1)
    each = results.select("asked", (-F.col("score")).alias("less"), own.alias("other"), F.explode("ids").alias("id"))
    each = each.select("asked", F.struct("less", F.col("id").isNull().alias("none"), "id", "other").alias("x"))
    lists = each.groupBy("asked").agg(F.slice(F.sort_array(F.collect_list("x")), 1, k + 1).alias("top"))  # at most (k + 1) squared
    by_vector = lists.join(file.select(F.col("node").alias("asked"), "v"), "asked").drop("asked")
    mine = _stored(rows.where("asked"), kind).select(F.col("id").alias("query_id"), "v").join(by_vector, "v")
    me = F.expr("filter(sequence(1, size(top)), i -> top[i - 1].other = 0 and top[i - 1].id <=> query_id)")
    at = F.coalesce(F.try_element_at(me, F.lit(1)), F.size("top"))  # else the last one is over
    spare = (F.size(me) > 0) | (F.size("top") > k)
    kept = F.when(spare, F.expr("filter(top, (x, i) -> i + 1 <> at)")).otherwise(F.col("top"))
    out = mine.withColumn("at", at).select("query_id", F.posexplode(kept).alias("place", "x"))
    return out.select("query_id", (F.col("place") + 1).alias("rank"), F.col("x.id").alias("id"), (-F.col("x.less")).alias("score"))


def top_k(
    vectors: DataFrame, asked: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", bits: int = BITS, block_bytes: int = BLOCK_BYTES, first: int = FIRST
) -> DataFrame:
    """(query_id, rank, id, score): for each row with ``asked`` the k other rows of highest inner product."""
    named = vectors.select(F.col(id_col).cast("long").alias("id"), F.coalesce(asked, F.lit(False)).alias("asked"), F.col(vec_col).alias("v"))
    mine = named.where(whole(F.col("v")))
    out = None
    for n, (lo, hi) in ranges(mine, "v").items():
        found = _search(mine.where(F.size("v") == n), n, lo, hi, k, bits, block_bytes, first)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = vectors.sparkSession.createDataFrame([], "query_id long, rank int, id long, score long")
    return out.withColumnRenamed("id", id_col)
