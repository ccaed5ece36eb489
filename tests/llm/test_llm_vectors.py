"""Centroid clustering and exact search against numpy over made-up vectors with ties, copies and odd rows."""

import hashlib

import numpy as np
from pyspark.sql import functions as F

from corpuslake.llm import centroids, vafile

SCHEMA = "vec_id long, embedding array<float>, label int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).repartition(4)


def whole(v):
    return v is not None and all(x is not None and np.isfinite(x) for x in v)


def lattice(v):
    return np.floor(np.array(v, np.float32).astype(float) * 256).astype(np.int64)


def lloyd(rows, k, rounds, length):
    kept = [(i, lattice(v)) for i, v in rows if whole(v) and len(v) == length]
    start = sorted(((i is None, hashlib.sha256(f"2:{i}".encode()).hexdigest(), v.tolist()) for i, v in kept))[:k]
    points, c = np.array([v for _, v in kept]), np.array([v for _, _, v in start])
    for r in range(rounds + 1):
        d = ((points[:, None] - c[None]) ** 2).sum(axis=2)
        near = d.argmin(axis=1)
        if r < rounds:
            c = np.array([points[near == j].sum(axis=0) // (near == j).sum() if (near == j).any() else c[j] for j in range(len(c))])
    least = d.min(axis=1)
    digest = [hashlib.sha256(",".join(map(str, x.tolist())).encode()).hexdigest() for x in c]
    return sorted(((i, int(j), int(x), int(least[near == j].sum()), int(least.sum()), digest[j]) for (i, _), j, x in zip(kept, near, least, strict=True)), key=repr)


def groups(n, length, seed=0, spread=0.05):
    """Vectors around ten centres: there the bounds save scans."""
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(10, length))
    return [(int(i), (middle[i % 10] + spread * rng.normal(size=length)).astype(np.float32).tolist()) for i in range(n)]


def test_clusters_equal_numpy(spark):
    rows = groups(700, 8)
    rows += [(5, rows[5][1])] * 3 + [(None, rows[9][1]), (900, None), (901, [1.0] * 7), (902, [float("nan")] * 8), (903, [float("inf")] + [0.0] * 7), (904, [None] + [0.0] * 7), (905, [])]
    rows += [(1000 + i, rows[3][1]) for i in range(300)]  # a third of all are copies
    frame = table(spark, rows).withColumn("cluster", F.lit("x")).withColumn("v", F.lit("x"))
    for k, rounds in ((12, 5), (1, 2), (5, 0)):
        out = centroids.clusters(frame, k=k, rounds=rounds, length=8)
        assert sorted(map(tuple, out.collect()), key=repr) == lloyd(rows, k, rounds, 8)


def test_bounds_save_scans(spark):
    """Far fewer than all rows are scanned once the centroids slow down."""
    *_, shares = centroids.fit(table(spark, groups(2000, 16)), k=10, rounds=5, length=16)
    assert shares[0] == 1.0 and shares[-1] < 0.3


def test_gain_bounds_every_point_of_the_sphere():
    rng = np.random.default_rng(1)
    less = 0
    for _ in range(300):
        n = int(rng.integers(2, 9))
        old, middle = rng.normal(size=(2, n)) * 5
        new, radius = old + rng.normal(size=n) * rng.uniform(0, 4), rng.uniform(0, 6)
        x = rng.normal(size=(400, n))
        x = middle + radius * x / np.linalg.norm(x, axis=1, keepdims=True) * rng.uniform(0, 1, size=(400, 1)) ** (1 / n)
        bound, drift = centroids.gain(old, new, middle, radius), np.linalg.norm(new - old)
        assert (np.linalg.norm(x - old, axis=1) - np.linalg.norm(x - new, axis=1)).max() <= bound <= drift * 1.001 + 1e-6
        less += bound < 0.9 * drift
    assert less > 100


def test_few_rows_and_empty_tables(spark):
    few = table(spark, [(1, [0.5] * 4), (2, [0.25] * 4)])
    assert sorted(r["cluster"] for r in centroids.clusters(few, length=4).collect()) == [0, 1]
    assert centroids.clusters(few).count() == 0  # none has 64 components
    assert centroids.clusters(few.limit(0), length=4).count() == 0
    assert vafile.top_k(few.limit(0), F.col("vec_id") == 1).count() == 0
    large = table(spark, [(1, [2.0e4] * 4), (2, [-2.0e4] * 4), (3, [1.9e4] * 4)])  # beyond exact products of doubles
    assert sorted(map(tuple, centroids.clusters(large, k=2, length=4).collect()), key=repr) == lloyd([(1, [2.0e4] * 4), (2, [-2.0e4] * 4), (3, [1.9e4] * 4)], 2, 5, 4)


def nearest(rows, asked, k):
    kept = [(i, lattice(v)) for i, v in rows if whole(v)]
    out = []
    for q, (i, v) in enumerate(kept):
        if i is None or not asked(i):
            continue
        others = [(-int(v @ w), j is None, j or 0, j) for p, (j, w) in enumerate(kept) if p != q and len(w) == len(v)]
        out += [(i, r + 1, j, -s) for r, (s, _, _, j) in enumerate(sorted(others, key=lambda x: x[:3])[:k])]
    return sorted(out, key=repr)


def test_top_k_equals_brute_force(spark):
    rows = groups(400, 8, seed=3, spread=0.4)
    rows += [(5, rows[5][1])] * 3 + [(None, rows[9][1]), (900, None), (905, []), (910, []), (902, [float("nan")] * 8), (915, [1.0] * 3), (920, [0.0] * 8)]
    rows += [(1000 + i, rows[3][1]) for i in range(250)]  # copies, queries and candidates both
    frame = table(spark, rows).withColumn("q", F.lit("x")).withColumn("node", F.lit("x"))
    want = nearest(rows, lambda i: i % 5 == 0, 5)
    assert sorted(map(tuple, vafile.top_k(frame, F.col("vec_id") % 5 == 0).collect()), key=repr) == want
    # coarse cells, blocks of a few queries, one exact vector at first: slower, and the same
    got = vafile.top_k(frame, F.col("vec_id") % 5 == 0, bits=2, block_bytes=64 * 60, first=1)
    assert sorted(map(tuple, got.collect()), key=repr) == want


def test_cells_hold_their_vectors():
    rng = np.random.default_rng(2)
    m = rng.integers(-300, 300, size=(50, 11)).astype(float)
    for bits in (1, 3, 6, 8):
        grid = vafile.Grid(m.min(axis=0), m.max(axis=0), bits)
        cells = grid.cells(m)
        low, high = grid.corners(cells)
        assert (low <= m).all() and (m <= high).all() and len(cells[0].as_py()) == -(-11 * bits // 8)
