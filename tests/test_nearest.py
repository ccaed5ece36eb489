"""Nearest rows by bounds in single precision, and variants of one vector."""

import numpy as np
import pytest

from corpuslake.operators import vectors as vx


@pytest.mark.parametrize("probes", [False, True])
@pytest.mark.parametrize("kind", ["random", "copies", "alike", "zero", "odd"])
def test_nearest_rows_equal_all_pairs(kind, probes):
    rng = np.random.default_rng(4)
    mat = rng.standard_normal((4000, 16))
    if kind == "copies":
        mat = mat[rng.integers(0, 40, len(mat))]
    if kind == "alike":  # nearer to each other than single precision tells
        mat = mat[0] + 1e-8 * mat
    if kind == "zero":
        mat[rng.random(len(mat)) < 0.9995] = 0
    mat, asked = vx.unit_rows(mat), vx.unit_rows(np.r_[mat[:60], rng.standard_normal((30, 16))])
    if kind == "odd":
        mat[::50] = np.nan
    ids, cell = rng.permutation(len(mat)), rng.integers(0, 30, len(mat))
    probed = rng.random((len(asked), 30)) < 0.2 if probes else None
    dist = np.round(1 - asked @ mat.T, vx.DIST_DIGITS)
    want = []
    for q in range(len(asked)):
        at = np.flatnonzero(np.isfinite(dist[q]) & (probed[q][cell] if probes else True))
        best = at[np.lexsort((ids[at], dist[q][at]))[:7]]
        want += [(q, int(ids[i]), float(dist[q][i])) for i in best]
    got = vx.nearest_rows(asked, ids, mat, 7, probed, cell if probes else None)
    assert np.allclose(got[2], [d for _, _, d in want], rtol=0, atol=2e-9)
    assert [(int(q), int(i)) for q, i in zip(*got[:2], strict=True)] == [(q, i) for q, i, _ in want]


def test_variants_of_one_vector_are_searched_once(spark, monkeypatch):
    rng = np.random.default_rng(6)
    vecs = [(i, [float(x) for x in rng.standard_normal(4)]) for i in range(50)]
    vectors = spark.createDataFrame(vecs, "vec_id long, embedding array<double>").selectExpr("*", "'s' as source", "array('t') as tags")
    rows = [(q, o, vecs[(q + o) % 5][1]) for q in range(20) for o in range(2)]
    variants = spark.createDataFrame(rows, "query_id long, ord int, embedding array<double>")
    seen, real = [], vx.knn

    def counted(v, queries, *args, **named):
        seen.append(queries.count())
        return real(v, queries, *args, **named)

    monkeypatch.setattr(vx, "knn", counted)
    got = {(r["query_id"], r["vec_id"]): r["score"] for r in vx.knn_multi(vectors, variants, 3).collect()}
    assert seen == [5]
    mat = vx.unit_rows(np.array([v for _, v in vecs]))
    for q in range(20):
        score: dict[int, float] = {}
        for o in range(2):
            d = np.round(1 - mat @ mat[(q + o) % 5], 9)
            for rank, i in enumerate(np.lexsort((np.arange(50), d))[:3]):
                score[int(i)] = score.get(int(i), 0) + 1 / (50 + rank + 1)
        for i in [i for (a, i) in got if a == q]:
            assert got[q, i] == pytest.approx(score[i])
        assert sum(a == q for a, _ in got) == 3
