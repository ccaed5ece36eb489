"""Centroid clustering (11): Lloyd's rounds with bounds that geometric drift tightening keeps close.

Every vector carries an upper bound on the distance to its centroid and a lower bound on that to every other one. When centroids
move, the upper bound grows by the own centroid's drift. The lower bound shrinks by less than the largest drift: the
vectors of a cluster lie in a sphere around its centroid, and how much closer a moved centroid can come to any point of
that sphere is bounded in the plane through the three points. On the line from the old place of the centroid to the new
one let t be a point's coordinate from the middle and h its distance from the line; the gain in distance,

    f(t, h) = |(t + d/2, h)| - |(t - d/2, h)|,

grows with t and falls with h, so over the sphere's disc in that plane it is largest on the quarter of the rim that faces the
new place and the line. That quarter is cut into arcs, and each arc's best corner bounds it. Only vectors whose bounds
still meet are ambiguous: the distance to their own centroid is taken, and if that does not decide, all centroids are
scanned exactly.

All distances that decide are whole numbers, and so are sums: results do not depend on partitions. A round is one pass over the
stored vectors, which are written again with their bounds (a written table cuts the lineage; the one before it is
deleted). New centroids come from the vectors that changed cluster only. The driver holds the centroids and sums of each
cluster: k times the length.

Cases: vectors that are null, of another length, or that hold null or non-finite components are left out. Null and repeated
ids keep their rows; a null id is the last to be a start. Fewer vectors than ``k`` give as many clusters; an empty table gives an
empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslake.functions.scale import discard
from corpuslake.llm.common import materialise
from corpuslake.llm.lattice import by_length, checked, kind_for, matrix, packed, ranges, whole

#: Arcs that the quarter of a rim is cut into.
ARCS = 24
#: Bounds are doubles: they are widened by this share, so that rounding decides nothing.
SLACK = 1e-9
STATE = "id long, v binary, was int, cluster int, upper double, lower double, scanned boolean"


def gain(old: np.ndarray, new: np.ndarray, middle: np.ndarray, radius: float) -> float:
    """Bound on d(x, old) - d(x, new) for points x of the sphere; at most the drift, at least 0."""
    step = new - old
    drift = float(np.sqrt(step @ step))
    if drift == 0:
        return 0.0
    away = middle - (old + new) / 2
    t = float(away @ step) / drift
    h = float(np.sqrt(max(0.0, away @ away - t * t)))
    angle = np.linspace(0, np.pi / 2, ARCS + 1)
    far = t + radius * np.cos(angle[:-1])
    near = np.maximum(0.0, h - radius * np.sin(angle[1:]))
    best = np.hypot(far + drift / 2, near) - np.hypot(far - drift / 2, near)
    return float(np.clip(best.max(), 0.0, drift)) * (1 + SLACK) + SLACK


def loosening(old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each cluster: by how much its vectors' upper bounds grow and their lower bounds shrink."""
    grow = np.sqrt(((new - old) ** 2).sum(axis=1)) * (1 + SLACK)
    moved = np.flatnonzero(grow > 0)
    shrink = [max((gain(old[j], new[j], old[a], radius[a]) for j in moved if j != a), default=0.0) for a in range(len(old))]
    return grow, np.array(shrink)


def distances(points: np.ndarray, centres: np.ndarray, doubles: bool) -> np.ndarray:
    """Exact squared distances; points x centres."""
    if doubles:
        p, c = points.astype(np.float64), centres.astype(np.float64)
        return (p * p).sum(axis=1)[:, None] - 2 * (p @ c.T) + (c * c).sum(axis=1)
    return np.stack([((points.astype(np.int64) - c) ** 2).sum(axis=1) for c in centres], axis=1)


def _scan(points: np.ndarray, centres: np.ndarray, doubles: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nearest, distance to it, distance to the next); the smaller number wins a tie."""
    d = distances(points, centres, doubles)
    best = d.argmin(axis=1)
    rows = np.arange(len(d))
    upper = np.sqrt(d[rows, best].astype(np.float64))
    if d.shape[1] == 1:
        return best, upper, np.full(len(d), np.inf)
    d = d.astype(np.float64)
    d[rows, best] = np.inf
    return best, upper, np.sqrt(d.min(axis=1))


def _assign(centres: np.ndarray, moved: tuple | None, kind: str, doubles: bool):
    """Pass over the state; ``moved``: (grow, shrink) since the last one, None at first."""
    length = centres.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for start in range(0, len(whole_batch), 1 << 14):
                batch = whole_batch.slice(start, 1 << 14)
                points = matrix(batch.column("v"), kind, length)
                was = batch.column("cluster").to_numpy(zero_copy_only=False)
                if moved is None:
                    at = np.arange(len(points))
                    now, upper, lower = was.copy(), np.zeros(len(points)), np.zeros(len(points))
                else:
                    now = was.copy()
                    upper = batch.column("upper").to_numpy(zero_copy_only=False) + moved[0][was]
                    lower = batch.column("lower").to_numpy(zero_copy_only=False) - moved[1][was]
                    meet = lambda rows: rows[upper[rows] * (1 + SLACK) >= lower[rows] * (1 - SLACK)]
                    at = meet(np.arange(len(points)))
                    gap = points[at].astype(np.int64) - centres[was[at]]
                    upper[at] = np.sqrt((gap * gap).sum(axis=1).astype(np.float64))
                    at = meet(at)
                if len(at):
                    now[at], upper[at], lower[at] = _scan(points[at], centres, doubles)
                scanned = np.zeros(len(points), bool)
                scanned[at] = True
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), batch.column("v"), pa.array(was, pa.int32()), pa.array(now.astype(np.int32)), pa.array(upper), pa.array(lower), pa.array(scanned)],
                    names=["id", "v", "was", "cluster", "upper", "lower", "scanned"],
                )

    return run


def _changes(kind: str, length: int, k: int):
    """Sums of what came to each cluster less what left it; place -1 counts vectors. A row a cluster and place for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((k, length + 1), np.int64)
        for batch in batches:
            points = np.c_[matrix(batch.column("v"), kind, length).astype(np.int64), np.ones(len(batch), np.int64)]
            for name, sign in (("cluster", 1), ("was", -1)):
                c = batch.column(name).to_numpy(zero_copy_only=False)
                order = np.argsort(c, kind="stable")
                order = order[c[order] >= 0]
                if len(order):
                    starts = np.flatnonzero(np.r_[True, np.diff(c[order]) > 0])
                    sums[c[order][starts]] += sign * np.add.reduceat(points[order], starts, axis=0)
        c, place = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(place), pa.array(sums[c, place])], names=["cluster", "place", "n"])

    return run


def starts(kept: DataFrame, k: int, salt: str) -> list:
    """The ``k`` stored vectors whose salted ids have the smallest SHA-256, in that order."""
    digest = F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256)
    return [r["v"] for r in kept.select(digest.alias("h"), "v").orderBy(F.asc_nulls_last("h"), "v").limit(k).collect()]


def fit(vectors: DataFrame, k: int = 40, rounds: int = 5, length: int = 64, salt: str = "2:", id_col: str = "vec_id", vec_col: str = "embedding"):
    """(state after the last assignment, centroids, type of stored numbers, shares of rows that were scanned in each pass).

    The state has a row per kept vector: id, v (bytes), cluster and the bounds; None if no vector is kept.
    """
    mine = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v")).where((F.size("v") == length) & whole(F.col("v")))
    lo, hi = ranges(mine, "v").get(length, (None, None))
    if lo is None:
        return None, np.zeros((0, length), np.int64), "<i2", []
    most = float(max(np.abs(lo).max(), np.abs(hi).max()))
    doubles, kind = checked(2 * most + 1, length, "distances"), kind_for(most + 1)

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, rows, m in by_length(batch.column(1)):
                none, zero = pa.array(np.full(len(rows), -1, np.int32)), pa.array(np.zeros(len(rows)))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), packed(m, kind), none, none, zero, zero, pa.array(np.zeros(len(rows), bool))], names=["id", "v", "was", "cluster", "upper", "lower", "scanned"])

    state = materialise(mine.mapInArrow(store, STATE), "vectors")
    centres = np.array([np.frombuffer(v, kind) for v in starts(state, k, salt)]).astype(np.int64)
    k = len(centres)
    sums, counts, moved, shares = [[0] * length for _ in range(k)], [0] * k, None, []
    for at in range(rounds + 1):
        new = materialise(state.mapInArrow(_assign(centres, moved, kind, doubles), STATE), "vectors")
        discard(state)
        state = new
        seen = state.groupBy("cluster").agg(F.max("upper").alias("radius"), F.count("*").alias("n"), F.sum(F.col("scanned").cast("long")).alias("scanned")).collect()
        shares.append(sum(r["scanned"] for r in seen) / sum(r["n"] for r in seen))
        if at == rounds:
            break
        came = state.where(F.col("was") != F.col("cluster")).mapInArrow(_changes(kind, length, k), "cluster long, place long, n long")
        for r in came.groupBy("cluster", "place").agg(F.sum("n").alias("n")).collect():
            if r["place"] == length:
                counts[r["cluster"]] += r["n"]
            else:
                sums[r["cluster"]][r["place"]] += r["n"]
        new = np.array([[s // counts[c] for s in sums[c]] if counts[c] else list(centres[c]) for c in range(k)], np.int64)
        radius = np.zeros(k)
        for r in seen:
            radius[r["cluster"]] = r["radius"] * (1 + SLACK)
        moved = loosening(centres.astype(np.float64), new.astype(np.float64), radius)
        centres = new
    return state, centres, kind, shares


def clusters(vectors: DataFrame, k: int = 40, rounds: int = 5, length: int = 64, salt: str = "2:", id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256), a row per kept vector.

    Starts are the ``k`` vectors whose salted ids have the smallest SHA-256; ``rounds`` times all are assigned and the centroids become
    the floor of their vectors' mean (an empty cluster keeps its own); then all are assigned once more.
    """
    spark = vectors.sparkSession
    schema = f"{id_col} long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    state, centres, kind, _ = fit(vectors, k, rounds, length, salt, id_col, vec_col)
    if state is None:
        return spark.createDataFrame([], schema)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = batch.column("cluster")
            gap = matrix(batch.column("v"), kind, length).astype(np.int64) - centres[c.to_numpy(zero_copy_only=False)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), c, pa.array((gap * gap).sum(axis=1))], names=["id", "cluster", "distance"])

    out = materialise(state.mapInArrow(measure, "id long, cluster int, distance long"), "clusters")
    discard(state)
    sums = {r["cluster"]: int(r["s"]) for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    total = sum(sums.values())
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centres]
    about = spark.createDataFrame([(c, s, total, digests[c]) for c, s in sorted(sums.items())], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    named = out.join(F.broadcast(about), "cluster")  # at most k rows
    return named.select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
