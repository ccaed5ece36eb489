"""Toxicity and quality: their parts against brute force, and held-out accuracy on the given tables."""

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslake.llm import quality as Q
from corpuslake.llm import toxicity as X

SF = "/root/testdata/sf0.1"


def slow_segments(s):
    """By definition: the best segment, then the same left and right of it."""
    total = np.r_[0, np.cumsum(s)]
    best = (0, 0, 0.0)
    for i in range(len(s)):
        for j in range(i + 1, len(s) + 1):
            if total[j] - total[i] > best[2] + 1e-9:
                best = (i, j, total[j] - total[i])
    if best[2] <= 0:
        return []
    i, j, _ = best
    return slow_segments(s[:i]) + [(i, j)] + [(a + j, b + j) for a, b in slow_segments(s[j:])]


def test_segments_equal_definition():
    rng = np.random.default_rng(1)
    for _ in range(300):
        s = rng.normal(-0.3, 1, rng.integers(0, 30))
        assert [(a, b) for a, b, _ in X.segments(s)] == slow_segments(s)


def test_extreme_value_fit():
    rng = np.random.default_rng(2)
    words = np.log(rng.integers(50, 3000, 4000))
    best = (rng.gumbel(0, 1, 4000) + words + math.log(0.1)) / 0.7
    lam, log_k = X.extreme_value(np.column_stack([best, words]))
    assert abs(lam - 0.7) < 0.05 and abs(log_k - math.log(0.1)) < 0.3


def test_isotonic_equals_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(100):
        n = rng.integers(1, 12)
        x, y = rng.permutation(n).astype(float), rng.integers(0, 2, n).astype(float)
        knots, values = Q.isotonic(x, y)
        o = np.argsort(x)
        mean = lambda i, j: y[o][i : j + 1].mean()
        fit = [max(min(mean(i, j) for j in range(k, n)) for i in range(k + 1)) for k in range(n)]
        assert np.allclose(np.interp(x[o], knots, values), fit)


def test_features_approximate_the_kernel():
    model = Q.Model(np.zeros(len(Q.NAMES)), np.ones(len(Q.NAMES)))
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, (60, len(Q.NAMES)))
    z = model.features(x)[:, :-1]
    exact = np.exp(-((x[:, None] - x[None]) ** 2).sum(-1) / (2 * Q.KERNEL**2))
    assert np.abs(z @ z.T - exact).mean() < 0.08


def test_normal_equations_are_summed_over_partitions(spark, make):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(["aa", "b|", "C#", "dd."]) for _ in range(rng.randint(1, 60)))) for i in range(200)]
    docs = make(rows)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(200)], "doc_id long, quality int, toxic int")
    one, many = (Q.fit(docs.select("doc_id", "text").repartition(n, "doc_id"), labels, F.lit(True)) for n in (1, 7))
    assert np.allclose(one.weights, many.weights, atol=1e-6)


@pytest.mark.parametrize("run,label,of,out,least", [(X.toxicity, "toxic", 5, 0, 0.97), (Q.quality, "quality", 3, 1, 0.98)])
def test_held_out_accuracy(spark, run, label, of, out, least):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = {r["doc_id"]: r for r in run(docs, labels).select("doc_id", "held_out", "score", "predicted").collect()}
    assert len(got) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % of == out) for i, r in got.items())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values())
    held = [(got[r["doc_id"]]["predicted"], r[label]) for r in labels.collect() if got[r["doc_id"]]["held_out"]]
    assert sum(a == b for a, b in held) / len(held) >= least


@pytest.mark.parametrize("run,label", [(X.toxicity, "toxic"), (Q.quality, "quality")])
def test_held_out_labels_are_not_used(spark, make, run, label):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(["fine", "words", "here", "vile" if i % 2 else "nice"]) for _ in range(20)) + (" |#|" * 9 if i % 2 else "")) for i in range(300)]
    of, out = (5, 0) if label == "toxic" else (3, 1)
    held = lambda i: zlib.crc32(str(i).encode()) % of == out
    scores = []
    for flip in (False, True):
        labels = spark.createDataFrame([(i, (i + (flip and held(i))) % 2) for i in range(300)], f"doc_id long, {label} int")
        scores.append(sorted((r["doc_id"], round(r["score"], 9)) for r in run(make(rows), labels).collect()))
    assert scores[0] == scores[1]


@pytest.mark.parametrize("run,label", [(X.toxicity, "toxic"), (Q.quality, "quality")])
def test_odd_rows(spark, make, run, label):
    rows = [(i, f"some words number {i} " * 5 + ("scum trash" if i % 2 else "")) for i in range(60)]
    rows += [(1, "twice"), (1, "twice"), (None, "no id"), (70, None), (71, ""), (72, "long text " * 20000)]
    docs = make(rows, extra=("score", "_s", "y", "held_out"))
    body = [(i, i % 2) for i in range(60)] + [(1, 0), (None, 1), (5, None), (999, 1)]
    labels = spark.createDataFrame(body, f"doc_id long, {label} int")
    for own in (labels, labels.limit(0), labels.where(f"{label} = 1")):
        got = run(docs, own).collect()
        assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
        assert all(r["held_out"] is not None and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert run(docs.limit(0), labels).count() == 0


def test_bound_on_labels_is_kept(spark):
    from corpuslake.llm.common import label_sample

    labels = spark.range(1000).selectExpr("id as doc_id", "id % 2 as toxic")
    a, b = ({r["doc_id"] for r in label_sample(labels.repartition(n), "toxic", F.lit(True), 100).collect()} for n in (1, 5))
    assert a == b and len(a) == 100


def test_every_toxic_passage_is_found_whatever_stands_elsewhere():
    """Equal passages both, and a dense passage whose words were all met singly before."""
    bad = [f"vile{i}" for i in range(8)]
    counts = np.zeros((2, X.LEVELS, X.CELLS), np.float32)
    for word, toxic in [*((w, 400.0) for w in bad), *((f"plain{i}", 0.0) for i in range(50))]:
        for level, cell in enumerate(X.cells(word)):
            counts[0, level, cell] += toxic
            counts[1, level, cell] += 400.0
    model = X.Model(counts, 0.05, lam=1.0, log_k=-2.0)
    calm = [f"plain{i % 50}" for i in range(60)]
    twice = calm + bad + calm + bad + calm
    late = [x for i, w in enumerate(bad) for x in (*calm[:25], w)] + calm + bad + calm
    for words, places in ((twice, [60, 128]), (late, [8 * 26 + 60])):
        (found, evidence, n), = X.scan(X.Scores(model), [" ".join(words).encode()])
        starts = [a for a, b, _ in model.significant(found, n) if b - a == 8]
        assert starts == places and n == len(words)
    (_, once, _), = X.scan(X.Scores(model), [" ".join(calm + bad + calm).encode()])
    (_, evidence, _), = X.scan(X.Scores(model), [" ".join(twice).encode()])
    assert len(evidence) == len(once) == 1  # the words of the second passage are no new evidence
