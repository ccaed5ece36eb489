"""Toxicity (1): significant toxic passages by maximum-scoring segments.

Model. A word's score is its log-odds of standing in toxic text, against the
share of toxic words over all, less ``DRIFT``, so that chance text scores below zero. Its counts, once
a document, are smoothed by a Dirichlet prior
whose mean comes from words that start alike, first by ``STEMS[-1]`` letters, these from
words that share fewer, and so on to the overall share; so a rare word scores near
zero unless its family says more. Words and stems are hashed to ``CELLS`` cells a
level, which bounds the model whatever the vocabulary.

Search. One linear scan over the word scores of a text, every occurrence of every word, finds all its maximal
scoring segments: disjoint runs that no longer or shorter run betters. As words come in bursts, a segment's score counts
a word above zero at its first place in the segment only (a repeat costs ``DRIFT``), whatever stands elsewhere in the text: of two equal
passages both are found. By extreme-value
theory the number of segments of chance text of m words that reach score s is about K m exp(-lambda s).
lambda and K are fitted to the best segments of clean documents that the counts did not use,
by the mean and variance of the extreme-value distribution. A segment is significant if its expected number is below
``ALPHA``. The number of segments of chance text above a score is nearly Poisson; the evidence of a
text is the best, over r, of the (Chernoff bound of the) log-improbability that r segments
score as high as its r highest; there the segments are taken from the highest down, and a word counts in the first of them only,
so a text is not toxic for saying one thing often. A logistic curve of it, fitted on labelled rows that the counts did not
use, is the score of the text.

At most ``FIT_ROWS`` labelled documents, chosen by a hash of their id, take part in fitting (see
``label_sample``); all documents are scored, whole. Labels, language, source and id are not
inputs of a score.

Cases: null and empty texts have no words, so the evidence of an empty list; null labels and ids
are left out of fitting; rows with equal ids are scored one by one. If the labels have only one class, or none,
all scores are that class's share (0 without labels).
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslake.llm.common import FIT_ROWS, as_bytes, fold, label_sample, logistic, materialise, per_text

CELLS = 1 << 18
#: Letters that the levels of a word's family share; the last level is the word itself.
STEMS = (2, 3, 4, 5, 6, 7)
LEVELS = len(STEMS) + 1
#: Pseudo-counts of each level's prior.
PRIOR = 16.0
DRIFT = 1.5
#: Words that a task remembers.
REMEMBERED = 300_000
ALPHA = 0.01
#: A share of the sample is kept for calibration.
CALIBRATION_PCT = 30
WORDS = re.compile(r"[^\W_]+")
EULER = 0.5772156649015329
RETURNS = "score double, predicted int, n_passages int, passages array<struct<start:int,stop:int,score:double>>"
ARROW = pa.struct([("score", pa.float64()), ("predicted", pa.int32()), ("n_passages", pa.int32()), ("passages", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("score", pa.float64())])))])


def words_of(text: bytes | None) -> list[str]:
    return WORDS.findall((text or b"").decode("utf-8", "replace").lower())


def cells(word: str) -> list[int]:
    """Cell of the word's family at each level, from few letters to the word."""
    return [xxhash.xxh32_intdigest(part.encode(), i) % CELLS for i, part in enumerate([*(word[:n] for n in STEMS), word])]


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, stop, score), in linear time.

    Runs of one sign are summed first. Candidates are kept with the total before and at their
    end; a new one is joined to the last candidate that began lower, if it ends higher than that
    one did. Each candidate is joined or skipped once, so a pointer to the next lower beginning
    makes the whole linear.
    """
    if not len(scores):
        return []
    up = scores > 0
    starts = np.flatnonzero(np.r_[True, up[1:] != up[:-1]])
    sums = np.add.reduceat(scores, starts)
    stops = np.r_[starts[1:], len(scores)]
    total = np.cumsum(sums)
    kept: list[tuple[int, int, float, float, int]] = []  # start, stop, total before, total at end, nearest earlier that begins lower
    for i in np.flatnonzero(up[starts]).tolist():
        start, stop, low, high = int(starts[i]), int(stops[i]), float(total[i] - sums[i]), float(total[i])
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= low:
                j = kept[j][4]
            if j < 0 or kept[j][3] >= high:
                kept.append((start, stop, low, high, j))
                break
            start, low = kept[j][0], kept[j][2]
            del kept[j:]
    return [(a, b, high - low) for a, b, low, high, _ in kept]


@dataclass
class Model:
    counts: np.ndarray  # words (toxic, all) by level and cell
    share: float
    lam: float = 1.0
    log_k: float = 0.0
    slope: float = 0.0
    constant: float = 0.0

    def word_score(self, word: str) -> float:
        p = base = min(max(self.share, 1e-6), 1 - 1e-6)
        for level, cell in enumerate(cells(word)):
            p = (float(self.counts[0, level, cell]) + PRIOR * p) / (float(self.counts[1, level, cell]) + PRIOR)
        p = min(max(p, 1e-6), 1 - 1e-6)
        return math.log(p / (1 - p)) - math.log(base / (1 - base)) - DRIFT

    def evidence(self, best: np.ndarray, n_words: int) -> float:
        """Of a text's segment scores: how improbable are so many so high in chance text; below zero, how far from it."""
        if not len(best):
            return -math.log(n_words + 1.0) - max(self.log_k, 0.0)
        mean = self.log_k + math.log(n_words + 1.0) - self.lam * np.sort(best)[::-1]  # log of the expected number
        r = np.arange(1, len(best) + 1)
        bits = np.where(np.log(r) > mean, r * (np.log(r) - mean) - r + np.exp(np.minimum(mean, 50.0)), 0.0)
        return float(bits.max()) if bits.max() > 0 else -max(0.0, float(mean[0]))

    def probability(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * squeezed(evidence) + self.constant, -40, 40)))

    def significant(self, found: list, n_words: int) -> list:
        limit = math.log(ALPHA)
        return [x for x in found if self.log_k + math.log(n_words + 1.0) - self.lam * x[2] < limit]


def squeezed(x: np.ndarray) -> np.ndarray:
    return np.sign(x) * np.log1p(np.abs(x))


class Scores(dict):
    """word -> score; remembered, and forgotten when many."""

    def __init__(self, model: Model):
        self.model = model

    def __missing__(self, word: str) -> float:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = out = self.model.word_score(word)
        return out


def scan(scores: Scores, texts: list) -> Iterator[tuple[list, list, int]]:
    """(segments, scores of evidence from the highest down, number of words) of each text."""
    for text in texts:
        words = words_of(text)
        values = np.fromiter(map(scores.__getitem__, words), np.float64, len(words))
        found = []
        for start, stop, _ in segments(values):
            own = _discounted(words, values, start, stop, set())
            if own > 0:
                found.append((start, stop, own))
        used: set[str] = set()
        fresh = [_discounted(words, values, a, b, used) for a, b, _ in sorted(found, key=lambda x: (-x[2], x[0]))]
        yield found, sorted((x for x in fresh if x > 0), reverse=True), len(words)


def _discounted(words: list[str], values: np.ndarray, start: int, stop: int, used: set) -> float:
    """Score of a segment where words above zero that were ``used`` before cost ``DRIFT``; its own are used from then on."""
    total = 0.0
    for word, value in zip(words[start:stop], values[start:stop].tolist(), strict=True):
        if value > 0:
            if word in used:
                value = -DRIFT
            else:
                used.add(word)
        total += value
    return total


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of a task by level and cell: (level, cell, toxic, total)."""
    counts = np.zeros((2, LEVELS, CELLS))
    words: tuple[Counter, Counter] = (Counter(), Counter())

    def spill() -> None:
        for y, own in enumerate(words):
            for word, n in own.items():
                for level, cell in enumerate(cells(word)):
                    counts[1, level, cell] += n
                    counts[0, level, cell] += n * y
            own.clear()

    for batch in batches:
        for y, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
            words[y].update(set(words_of(text)))
            if len(words[y]) > REMEMBERED:
                spill()
    spill()
    level, cell = np.nonzero(counts[1])
    yield pa.RecordBatch.from_arrays(
        [pa.array(level.astype(np.int32)), pa.array(cell.astype(np.int32)), *(pa.array(counts[i][level, cell]) for i in range(2))],
        names=["level", "cell", "toxic", "total"],
    )


def fit(docs: DataFrame, labels: DataFrame, train: Column, label: str = "toxic", rows: int = FIT_ROWS) -> Model:
    """Model from labelled rows that fulfil ``train`` (a condition on doc_id), ``rows`` at most.

    docs: doc_id and text. The sample's texts are written once and read for counting, chance and calibration.
    """
    sample = F.broadcast(label_sample(labels, label, train, rows, label))  # bounded by rows
    texts = materialise(docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(sample, "doc_id"), "sample")
    held = F.pmod(F.xxhash64(F.lit("calibrate"), "doc_id"), F.lit(100)) < CALIBRATION_PCT
    counted = texts.where(~held).select("y", "text").mapInArrow(_count, "level int, cell int, toxic double, total double")
    sums = counted.groupBy("level", "cell").agg(F.sum("toxic"), F.sum("total")).toArrow()  # LEVELS * CELLS rows at most
    level, cell, toxic, every = (c.to_numpy() for c in sums.columns)
    counts = np.zeros((2, LEVELS, CELLS), np.float32)
    counts[0, level, cell], counts[1, level, cell] = toxic, every
    total = every[level == LEVELS - 1].sum()
    model = Model(counts, float(toxic[level == LEVELS - 1].sum() / total) if total else 0.0)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per document: label, words, segment scores, highest first."""
        scores = Scores(shared.value)
        for batch in batches:
            rows = list(scan(scores, as_bytes(batch.column(1))))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([n for *_, n in rows], pa.int64()), pa.array([e for _, e, _ in rows], pa.list_(pa.float64()))],
                names=["y", "n", "segments"],
            )

    seen = texts.where(held).select("y", "text").mapInArrow(best, "y int, n long, segments array<double>").toArrow().to_pylist()  # of FIT_ROWS at most, without texts
    shared.destroy()
    clean = [(r["segments"][0], math.log(r["n"] + 1.0)) for r in seen if not r["y"] and r["segments"]]
    model.lam, model.log_k = extreme_value(np.array(clean).reshape(-1, 2))
    y = np.array([r["y"] for r in seen], float)
    if 0 < y.sum() < len(y):
        x = np.array([model.evidence(np.array(r["segments"]), r["n"]) for r in seen])
        model.slope, model.constant = logistic(squeezed(x)[:, None], y)
    else:
        p = np.clip(np.mean([r["y"] for r in seen]) if seen else 0.0, 1e-9, 1 - 1e-9)
        model.slope, model.constant = 0.0, math.log(p / (1 - p))
    return model


def extreme_value(best: np.ndarray) -> tuple[float, float]:
    """lambda and log K from rows (best score, log words): lambda s - log words has the mean log K + gamma and variance pi^2 / 6."""
    if len(best) < 10:
        return 1.0, 0.0
    lam = 1.0
    for _ in range(100):
        spread = float(np.std(best[:, 0] - best[:, 1] / lam))
        lam = 0.5 * lam + 0.5 * min(max(math.pi / math.sqrt(6) / max(spread, 1e-6), 0.05), 20.0)
    return lam, float(np.mean(lam * best[:, 0] - best[:, 1])) - EULER


def scored(spark, model: Model):
    """Column function: text -> struct of score, predicted and significant passages (word positions)."""
    shared = spark.sparkContext.broadcast(model)

    def rows(texts: list) -> pa.Array:
        model = shared.value
        if getattr(rows, "scores", None) is None:
            rows.scores = Scores(model)
        found = list(scan(rows.scores, texts))
        score = model.probability(np.array([model.evidence(np.array(e), n) for _, e, n in found]))
        out = []
        for (f, _, n), p in zip(found, score.tolist(), strict=True):
            passages = model.significant(f, n)
            out.append({"score": p, "predicted": int(p >= 0.5), "n_passages": len(passages), "passages": [{"start": a, "stop": b, "score": s} for a, b, s in passages]})
        return pa.array(out, ARROW)

    return per_text(rows, RETURNS)


def toxicity(docs: DataFrame, labels: DataFrame, of: int = 5, out: int = 0, rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted, passages), a row per document.

    Held out are documents whose crc32(doc_id) modulo ``of`` is ``out``; these labels are not used.
    """
    docs = docs.select("doc_id", "text")
    model = fit(docs, labels, fold(F.col("doc_id"), of) != out, rows=rows)
    held = F.coalesce(fold(F.col("doc_id"), of) == out, F.lit(False))
    return docs.select("doc_id", held.alias("held_out"), scored(docs.sparkSession, model)(F.col("text")).alias("_s")).select("doc_id", "held_out", "_s.*")
