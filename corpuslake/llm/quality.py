"""Quality classifier (9): random Fourier features over document statistics, ridge scores, isotonic calibration.

1. ``statistics`` describes a whole text by a few numbers (``NAMES``).
2. These are standardised and mapped to ``WIDTH`` cosines of random projections, whose inner
   products approximate a Gaussian kernel of width ``KERNEL``.
3. Each task sums its rows' normal equations (a matrix of WIDTH + 1 columns); Spark sums
   these by cell, and only the sums reach the driver, which solves the ridge regression.
4. Labelled rows kept out of step 3 give an isotonic (pool adjacent violators)
   curve from ridge score to probability, drawn straight between blocks.

At most ``FIT_ROWS`` labelled documents, chosen by a hash of their id, take part in fitting; all
documents are scored, whole. Labels, language, source and id are not inputs of a score.

Cases: a null text counts as empty; both have all statistics zero. Null labels and ids are left
out of fitting; rows with equal ids are scored one by one. Without labels the score is
0; with labels of one class it is 0 or 1.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslake.llm.common import FIT_ROWS, fold, label_sample, materialise, per_text, struct_of

WIDTH, KERNEL, RIDGE, SEED = 160, 3.0, 1e-2, 9
CALIBRATION_PCT = 30
NAMES = (
    "log_words log_chars word_length unique_words commonest_word next_equal symbols marks upper digits accents "
    "line_words equal_lines bars stops commas word_entropy"
).split()
SYMBOLS, UPPER, DIGITS, HIGH = b"#*$%&<>{}[]\\^~_=+@", bytes(range(65, 91)), bytes(range(48, 58)), bytes(range(0xC0, 0x100))
RETURNS = "score double, predicted int"


def statistics(text: bytes | None) -> list[float]:
    t = text or b""
    words = t.split()
    n = len(words)
    if not n:
        return [0.0] * len(NAMES)
    chars = sum(map(len, words))
    counts = Counter(words)
    common = counts.most_common(1)[0][1]
    lines = [x for x in t.split(b"\n") if x.strip()]
    seen = np.fromiter(counts.values(), np.float64, len(counts)) / n

    def share(of: bytes) -> float:
        return (len(t) - len(t.translate(None, of))) / chars

    return [
        math.log1p(n),
        math.log1p(chars),
        min(chars / n, 40.0),
        len(counts) / n,
        common / n,
        sum(map(eq, words, words[1:])) / n,
        share(SYMBOLS),
        share(b"!?"),
        share(UPPER),
        share(DIGITS),
        share(HIGH),
        math.log1p(n / len(lines)),
        1 - len(set(lines)) / len(lines),
        share(b"|"),
        share(b"."),
        share(b","),
        float(-(seen * np.log(seen)).sum()) / math.log(n + 1.0),
    ]


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray | None = None
    knots: np.ndarray | None = None
    values: np.ndarray | None = None

    def __post_init__(self):
        rng = np.random.default_rng(SEED)
        self.directions = rng.normal(0, 1 / KERNEL, (len(NAMES), WIDTH))
        self.phases = rng.uniform(0, 2 * np.pi, WIDTH)

    def features(self, x: np.ndarray) -> np.ndarray:
        """Cosines that approximate the kernel, and a constant."""
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.column_stack([np.sqrt(2 / WIDTH) * np.cos(z @ self.directions + self.phases), np.ones(len(x))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def probability(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), self.knots, self.values)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the best rising curve through the rows: each block's ends, at its mean."""
    order = np.lexsort((-y, x))
    blocks: list[list[float]] = []  # sum, rows, least x, largest x
    for a, b in zip(x[order].tolist(), y[order].tolist(), strict=True):
        blocks.append([b, 1, a, a])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            total, rows, _, last = blocks.pop()
            blocks[-1][0] += total
            blocks[-1][1] += rows
            blocks[-1][3] = last
    knots = [p for b in blocks for p in ((b[2],) if b[2] == b[3] else (b[2], b[3]))]
    values = [b[0] / b[1] for b in blocks for _ in range(1 if b[2] == b[3] else 2)]
    return np.array(knots), np.array(values)


def fit(docs: DataFrame, labels: DataFrame, train: Column, label: str = "quality", rows: int = FIT_ROWS) -> Model:
    """Model from labelled rows that fulfil ``train`` (a condition on doc_id), ``rows`` at most. docs: doc_id and text."""
    sample = F.broadcast(label_sample(labels, label, train, rows, label))  # bounded by rows
    described = per_text(lambda texts: pa.array([statistics(t) for t in texts], pa.list_(pa.float64())), "array<double>")
    seen = materialise(docs.select("doc_id", "text").join(sample, "doc_id").select("doc_id", "y", described(F.col("text")).alias("x")), "statistics")
    held = F.pmod(F.xxhash64(F.lit("calibrate"), "doc_id"), F.lit(100)) < CALIBRATION_PCT
    moments = seen.agg(*(f(F.col("x")[i]) for i in range(len(NAMES)) for f in (F.avg, F.stddev_pop))).first()
    mean, scale = (np.array([v or 0.0 for v in moments[k::2]]) for k in (0, 1))
    model = Model(mean, np.where(scale > 1e-9, scale, 1.0))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A task's sums: rows (i, j, value) of the matrix (j <= i), and of the right side (j = -1)."""
        width = WIDTH + 1
        left, right = np.zeros((width, width)), np.zeros(width)
        for batch in batches:
            if batch.num_rows:
                z = shared.value.features(np.array(batch.column(1).to_pylist()))
                left += z.T @ z
                right += z.T @ np.array(batch.column(0).to_pylist(), float)
        i, j = np.tril_indices(width)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.r_[i, np.arange(width)].astype(np.int32)), pa.array(np.r_[j, np.full(width, -1)].astype(np.int32)), pa.array(np.r_[left[i, j], right])],
            names=["i", "j", "value"],
        )

    summed = seen.where(~held).select("y", "x").mapInArrow(equations, "i int, j int, value double").groupBy("i", "j").agg(F.sum("value")).toArrow()
    i, j, value = (c.to_numpy() for c in summed.columns)  # a row for each cell
    left, right = np.zeros((WIDTH + 1, WIDTH + 1)), np.zeros(WIDTH + 1)
    right[i[j < 0]] = value[j < 0]
    left[i[j >= 0], j[j >= 0]] = left[j[j >= 0], i[j >= 0]] = value[j >= 0]
    penalty = RIDGE * np.eye(WIDTH + 1)
    penalty[-1, -1] = 1e-9
    model.weights = np.linalg.solve(left + penalty, right)
    kept = seen.where(held).select("y", "x").toArrow()  # of FIT_ROWS at most, without texts
    y, x = np.array(kept["y"].to_pylist(), float), np.array(kept["x"].to_pylist(), float).reshape(-1, len(NAMES))
    model.knots, model.values = isotonic(model.raw(x), y) if len(y) else (np.zeros(1), np.zeros(1))
    shared.destroy()
    return model


def scored(spark, model: Model):
    """Column function: text -> struct of score and predicted."""
    shared = spark.sparkContext.broadcast(model)

    def rows(texts: list) -> pa.Array:
        p = shared.value.probability(np.array([statistics(t) for t in texts]).reshape(-1, len(NAMES)))
        return struct_of(RETURNS, [p, (p >= 0.5).astype(np.int32)])

    return per_text(rows, RETURNS)


def quality(docs: DataFrame, labels: DataFrame, of: int = 3, out: int = 1, rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted), a row per document.

    Held out are documents whose crc32(doc_id) modulo ``of`` is ``out``; these labels are not used.
    """
    docs = docs.select("doc_id", "text")
    model = fit(docs, labels, fold(F.col("doc_id"), of) != out, rows=rows)
    held = F.coalesce(fold(F.col("doc_id"), of) == out, F.lit(False))
    return docs.select("doc_id", held.alias("held_out"), scored(docs.sparkSession, model)(F.col("text")).alias("_s")).select("doc_id", "held_out", "_s.*")
