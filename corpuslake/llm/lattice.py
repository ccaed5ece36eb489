"""Vectors as whole numbers: what centroid clustering (11) and exact search (13) share.

A component x becomes floor(256 x), x as double, so inner products and squared distances are exact. A
vector that is null or holds a null or non-finite component takes no part. Vectors travel as little-endian
bytes of the narrowest type that holds every component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE = 256
#: Sums of products below this are exact in doubles, so that matrix products may be used; below the second, in longs.
EXACT, LARGEST = 2**53, 2**63


def whole(vector: Column) -> Column:
    """True for a vector without nulls, NaN and infinities."""
    fit = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return vector.isNotNull() & fit


def by_length(vectors: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, row numbers, matrix of floor(256 x) as doubles) of whole vectors, one matrix a length."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    sizes = np.diff(vectors.offsets.to_numpy())
    starts = vectors.offsets.to_numpy()[:-1]
    values = np.floor(vectors.values.to_numpy(zero_copy_only=False).astype(np.float64) * SCALE)
    for n in np.unique(sizes):
        rows = np.flatnonzero(sizes == n)
        yield int(n), rows, values[starts[rows][:, None] + np.arange(n)]


def kind_for(most: float) -> str:
    """Narrowest little-endian type of whole numbers up to ``most`` in size."""
    return next((k for k, limit in (("<i2", 2**15), ("<i4", 2**31), ("<i8", 2**62)) if most < limit), "")


def matrix(data: pa.Array, kind: str, n: int) -> np.ndarray:
    """Matrix of stored vectors of length ``n``."""
    return np.frombuffer(b"".join(data.to_pylist()), kind).reshape(len(data), n)


def packed(rows: np.ndarray, kind: str) -> pa.Array:
    return pa.array([r.tobytes() for r in rows.astype(kind)], pa.binary())


def ranges(vectors: DataFrame, vec_col: str) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Least and largest component at each place, for each length of vector: two numbers a place reach the driver."""

    def least_and_most(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict = {}
        for batch in batches:
            for n, _, m in by_length(batch.column(0)):
                lo, hi = (m.min(axis=0), m.max(axis=0)) if len(m) else (np.zeros(n), np.zeros(n))
                old = seen.get(n)
                seen[n] = (np.minimum(lo, old[0]), np.maximum(hi, old[1])) if old else (lo, hi)
        for n, (lo, hi) in seen.items():
            place = np.arange(n) if n else np.array([-1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(place), n)), pa.array(place), pa.array(lo if n else [0.0]), pa.array(hi if n else [0.0])], names=["n", "place", "lo", "hi"]
            )

    parts = vectors.select(vec_col).where(whole(F.col(vec_col))).mapInArrow(least_and_most, "n long, place long, lo double, hi double")
    found = parts.groupBy("n", "place").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).orderBy("n", "place").collect()
    out: dict = {}
    for r in found:
        lo, hi = out.setdefault(r["n"], ([], []))
        if r["place"] >= 0:
            lo.append(r["lo"])
            hi.append(r["hi"])
    return {n: (np.array(lo), np.array(hi)) for n, (lo, hi) in out.items()}


def checked(most: float, n: int, what: str) -> bool:
    """Whether doubles are exact for sums of n products of numbers up to ``most``; an error if longs are not either."""
    if n * most * most >= LARGEST:
        raise ValueError(f"{what} of vectors with components up to {most / SCALE:g} do not fit a long")
    return n * most * most < EXACT
