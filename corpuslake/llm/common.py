"""What several operators share: Arrow functions over one text column, shared tables, label samples."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslake.functions.scale import materialise

#: Labelled rows that a model is fitted on at most (the classifiers' documented bound).
FIT_ROWS = 20_000

TYPES = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}

__all__ = ["FIT_ROWS", "as_bytes", "batches_of", "fold", "label_sample", "materialise", "per_text", "struct_of"]


def per_text(rows: Callable[[list], pa.Array], returns: str) -> Callable[[Column], Column]:
    """Column function from a text column; ``rows`` gets the UTF-8 bytes (or None) of a batch of texts.

    It is marked as not deterministic so that Spark evaluates it exactly once
    per row: a filter on its result is then neither pushed below nor repeated.
    """

    def call(texts: pa.Array) -> pa.Array:
        return rows(as_bytes(texts))

    call.__annotations__ = {"texts": pa.Array, "return": pa.Array}  # as types: they decide the kind of function
    udf = F.arrow_udf(call, returns).asNondeterministic()
    return lambda text: udf(text.cast("binary"))


def as_bytes(texts: pa.Array) -> list:
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    return texts.cast(pa.binary()).to_pylist()


def struct_of(returns: str, columns: Sequence) -> pa.Array:
    """Struct array with fields as in ``returns``: "name type, ..." of plain types; ready arrays keep their own type."""
    fields = [f.split(" ", 1) for f in returns.split(", ")]
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, TYPES[kind]) for (_, kind), c in zip(fields, columns, strict=True)]
    return pa.StructArray.from_arrays(arrays, names=[name for name, _ in fields])


def batches_of(sizes: Sequence[int], most: int):
    """(start, stop) ranges of consecutive rows whose sizes add up to about ``most``; a larger row stands alone."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def fold(doc_id: Column, of: int) -> Column:
    """crc32 of the id as text, modulo ``of``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % of


def label_sample(labels: DataFrame, label: str, train: Column, rows: int = FIT_ROWS, salt: str = "fit") -> DataFrame:
    """At most ``rows`` labelled training rows as (doc_id, y), chosen by a hash of the id; safe to broadcast.

    Rows without id or label are left out; a document labelled more than once
    counts as positive if any of its labels is.
    """
    return (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & train)
        .groupBy("doc_id")
        .agg(F.max((F.col(label) > 0).cast("int")).alias("y"))
        .orderBy(F.xxhash64(F.lit(salt), "doc_id"), "doc_id")
        .limit(rows)
    )


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """Weights of a small logistic regression (a constant is the last) by Newton's method, on the driver."""
    x = np.column_stack([x, np.ones(len(x))]) if len(x) else np.zeros((0, (x.shape[1] if x.ndim > 1 else 1) + 1))
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + ridge * w
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w
