"""Column expressions over embedding arrays."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuslake.functions import fixed_values as fv
from corpuslake.functions.text import as_col, flat_tokens, index_tokens, let


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity in double precision; 0 on length mismatch or zero norm."""
    a, b = as_col(a), as_col(b)
    scale = norm(a) * norm(b)
    return F.when((F.size(a) != F.size(b)) | (scale == 0), F.lit(0.0)).otherwise(dot(a, b) / scale)


def l2_normalise(a: Column) -> Column:
    return let(
        a,
        lambda v: let(
            norm(v), lambda n: F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(F.lit(0.0)))
        ),
    )


def hashed_bag_encoder(dim: int = 64, token_of=index_tokens):
    """Default text encoder: token counts hashed into ``dim`` cells, L2-normalised.

    Needs no model files. Index tokens are counted in Arrow batches, those of another
    ``token_of`` in the JVM. Any ``Column -> Column`` function returning ``array<double>``
    (a pandas UDF around a neural model, for instance) can be used in its place.
    """
    if token_of is index_tokens:
        return lambda text: F.arrow_udf(bag_of(dim), "array<double>")(F.lower(text))

    def encode(text: Column) -> Column:
        cells = F.transform(
            token_of(text),
            lambda t: F.conv(F.substring(F.md5(t), 1, 6), 16, 10).cast("int") % dim,
        )
        counts = let(
            cells,
            lambda cs: F.transform(
                F.sequence(F.lit(0), F.lit(dim - 1)),
                lambda i: (F.size(cs) - F.size(F.array_remove(cs, i))).cast("double"),
            ),
        )
        return l2_normalise(counts)

    return encode


TEXTS_AT_ONCE = 256  # texts whose tokens are held at the same time
KEPT_CELLS = 200_000  # tokens whose cell a worker remembers


class _Cells(dict):
    """Token -> cell, none (``dim``) for stop words; filled as tokens are met, up to a bound."""

    def __init__(self, dim: int):
        super().__init__((w, dim) for w in fv.INDEX_STOP_WORDS)
        self.dim = dim

    def __missing__(self, token: str) -> int:
        cell = int(hashlib.md5(token.encode()).hexdigest()[:6], 16) % self.dim
        if len(self) < KEPT_CELLS:
            self[token] = cell
        return cell


def bag_of(dim: int = 64):
    """Texts in lower case -> unit vectors of their token counts by cell (no token: zeros)."""
    cells = None

    def bag(low: pa.Array) -> pa.Array:
        nonlocal cells
        cells = _Cells(dim) if cells is None else cells
        out = np.zeros((len(low), dim))
        for start in range(0, len(low), TEXTS_AT_ONCE):
            some = low.slice(start, TEXTS_AT_ONCE)
            tokens, text = flat_tokens(some)
            coded = tokens.dictionary_encode()
            cell = np.fromiter(map(cells.__getitem__, coded.dictionary.to_pylist()), np.int64, len(coded.dictionary))[coded.indices.to_numpy()]
            counts = np.bincount(text * (dim + 1) + cell, minlength=len(some) * (dim + 1)).reshape(-1, dim + 1)[:, :dim].astype(float)
            norms = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
            out[start : start + len(some)] = np.divide(counts, norms, out=np.zeros_like(counts), where=norms > 0)
        return pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, dim, dtype=np.int32)), pa.array(out.ravel()))

    return bag
