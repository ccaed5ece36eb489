import random

import numpy as np
import pytest
import xxhash

from corpuslake.llm import simhash as S
from corpuslake.llm.components import components


def test_fingerprint_by_definition():
    def slow(text, size=4):
        w = text.lower().split()
        if not w:
            return 0
        shingles = [" ".join(w[i : i + size]) for i in range(len(w) - size + 1)] or [" ".join(w)]
        h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))

    random.seed(1)
    for n in (0, 1, 3, 4, 5, 30):
        t = " ".join(random.choice(["Ab", "c", "dd", "é"]) for _ in range(n))
        assert S.simhash(t.encode(), 4) % 2**64 == slow(t)
    assert S.simhash(None, 4) == 0


@pytest.mark.parametrize("threshold", [1, 2, 3, 4, 5, 6, 7])
def test_anchors_cover_every_link(threshold):
    rng = np.random.default_rng(threshold)
    a = rng.integers(0, 2**64, 500, dtype=np.uint64)
    b = a.copy()
    for i in range(len(b)):
        for bit in rng.choice(64, rng.integers(0, threshold + 1), replace=False):
            b[i] ^= np.uint64(1) << np.uint64(bit)
    reach = []
    for prints in (a, b):
        at, keys, home = S.anchors(prints, threshold)
        all_, own = [set() for _ in prints], [set() for _ in prints]
        for i, k, h in zip(at, keys, home, strict=True):
            all_[i].add(k)
            if h:
                own[i].add(k)
        reach.append((all_, own))
    for i in range(len(a)):
        assert reach[0][1][i] & reach[1][0][i] and reach[1][1][i] & reach[0][0][i]


def brute_classes(prints, threshold=4):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= threshold:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


@pytest.mark.parametrize("block", [4096, 16])
def test_classes_equal_brute_force(spark, block):
    """A chain, a dense cluster and strangers; with blocks of 16 the cluster is cut up."""
    rng = random.Random(3)
    prints = [rng.getrandbits(64) for _ in range(40)]
    x = prints[0]
    for _ in range(12):  # a chain of 4-bit steps
        x ^= sum(1 << b for b in rng.sample(range(64), 4))
        prints.append(x)
    prints += [prints[1] ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for _ in range(120)]
    prints += [0, 0, prints[5]]
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    ids = [None if i == 7 else 1000 - i for i in range(len(prints))]
    frame = spark.createDataFrame(list(zip(ids, signed, range(len(prints)), strict=True)), "id long, fp long, n int")
    got = {r["n"]: r["component_id"] for r in S.near_duplicates(frame, "id", block=block).collect()}
    classes = brute_classes(prints)
    least = {}
    for i, c in enumerate(classes):
        least[c] = min((v for v in (least.get(c), ids[i]) if v is not None), default=None)
    assert got == {i: least[c] for i, c in enumerate(classes)}


def test_links_span_but_do_not_multiply(spark):
    rng = random.Random(4)
    prints = {sum(1 << b for b in rng.sample(range(64), 2)) for _ in range(300)}
    frame = spark.createDataFrame([(p - 2**64 if p >= 2**63 else p,) for p in prints], "fp long")
    n = S.links(frame).count()
    assert len(prints) - 1 <= n < 20 * len(prints)  # all pairs: 300 * 299 / 2


def test_one_of_each_class_stays(spark, make):
    text = " ".join(f"w{i}" for i in range(80))
    near = text + " tail"
    docs = make([(5, text), (3, near), (9, text), (9, text), (None, text), (7, None), (8, ""), (1, "other words here now")], extra=("fp", "row", "component_id", "doc"))
    out = S.keep_one(docs)
    assert out.columns == docs.columns
    assert sorted(r["doc_id"] for r in out.collect()) == [1, 3, 7]
    both = make([(None, text), (None, text), (4, "other words"), (4, "other words")])
    assert S.keep_one(both).count() == 2
    rows = S.simhash_clusters(docs).collect()
    assert {(r["doc_id"], r["component_id"]) for r in rows} == {(5, 3), (3, 3), (9, 3), (None, 3), (7, 7), (8, 7), (1, 1)}
    assert {len(r["fingerprint"]) for r in rows} == {16}
    assert S.keep_one(docs.limit(0)).count() == 0 and S.simhash_clusters(docs.limit(0)).count() == 0


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(60)] + [(200, i) for i in range(201, 260)] + [(7, 7), (None, 3), (300, 301), (301, 300)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    expected = {i: 0 for i in range(61)} | {i: 200 for i in range(200, 260)} | {300: 300, 301: 300}
    assert got == expected
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0
