"""The order of shingles that a sample gives decides speed only."""

import random

import numpy as np

from corpuslake.llm import similar


def test_no_link_depends_on_the_sample(spark, monkeypatch):
    rng = random.Random(8)
    base = [[f"w{rng.randrange(900)}" for _ in range(60)] for _ in range(25)]
    rows = []
    for words in base:
        for change in (0, 1, 2, 4):
            copy = list(words)
            for _ in range(change):
                copy[rng.randrange(60)] = "changed"
            rows.append((len(rows), " ".join(["the same first words of all"] * 2 + copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = lambda: sorted(r["doc_id"] for r in similar.keep_one(docs).collect())
    sets = [set(similar.shingles(t.encode(), 5).tolist()) for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if r == old else r for r in root]
    want = sorted(set(root))
    assert kept() == want and len(want) < len(rows)
    none = np.zeros(0, np.int64)
    monkeypatch.setattr(similar, "common_shingles", lambda texts, size: (none, none))
    assert kept() == want
