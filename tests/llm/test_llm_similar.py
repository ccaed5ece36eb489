import functools
import random
from fractions import Fraction

import numpy as np

from corpuslake.llm import similar as N
from corpuslake.llm.simhash import simhash


@functools.cache
def shingle_set(text):
    w = text.encode().lower().split()
    return frozenset([b" ".join(w)] if 0 < len(w) < 5 else (b" ".join(w[i : i + 5]) for i in range(len(w) - 4)))


def least_of_classes(docs):
    """Ids that stay, by comparing all pairs."""
    sets = [(i, shingle_set(t)) for i, t in docs]
    root = {i: i for i, _ in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a == b or Fraction(len(a & b), len(a | b)) >= Fraction(4, 5):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return sorted({find(i) for i in root})


def edited(rng, words, n):
    words = list(words)
    for i in rng.sample(range(len(words)), n):
        words[i] = f"new{rng.random()}"
    return words


def test_links_are_those_of_the_definition(spark, make):
    """Bases with copies of 0 to 5 edited words around the threshold, chains, a common passage and short texts."""
    rng = random.Random(1)
    passage = [f"common{i}" for i in range(30)]
    docs = []
    for _ in range(60):
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.randint(40, 160))] + (passage if rng.random() < 0.5 else [])
        docs += [" ".join(base), " ".join(base).upper()]
        docs += [" ".join(edited(rng, base, rng.randint(0, 5))) for _ in range(4)]
        chain = base
        for _ in range(3):
            chain = edited(rng, chain, 2)
            docs.append(" ".join(chain))
    docs += ["a b c", "A b  c", "a b", "a b c d e f", "a b c d e f g", "a b c d e f g h i j", "b c d e f g h i j"]
    rng.shuffle(docs)
    docs = list(enumerate(docs))
    pairs = [(a, b) for k, (_, a) in enumerate(docs) for _, b in docs[:k] if shingle_set(a) != shingle_set(b)]
    alike = lambda a, b: len(shingle_set(a) & shingle_set(b)) / len(shingle_set(a) | shingle_set(b)) >= 0.8
    far = lambda a, b: (simhash(a.encode(), 5) ^ simhash(b.encode(), 5)).bit_count() > 7
    assert any(alike(a, b) and far(a, b) for a, b in pairs)  # a limit of seven bits missed these
    assert sum(alike(a, b) for a, b in pairs) > 300
    want = least_of_classes(docs)
    frame = make(docs).repartition(7)
    assert sorted(r["doc_id"] for r in N.keep_one(frame).collect()) == want


def test_hot_shingles_and_blocks(make, monkeypatch):
    """Groups and hubs far over their block: the same classes."""
    rng = random.Random(4)
    passage = [f"common{i}" for i in range(40)]
    docs = [" ".join([f"w{rng.randrange(10**6)}" for _ in range(12)] + passage) for _ in range(60)]  # alike through the passage only
    base = [f"b{i}" for i in range(90)]
    docs += [" ".join(edited(rng, base, rng.randint(0, 4))) for _ in range(60)]
    docs = list(enumerate(docs))
    for name, value in (("BLOCK", 8), ("MEMBERS", 5), ("AT_ONCE", 64), ("COMMON", 30)):
        monkeypatch.setattr(N, name, value)
    assert sorted(r["doc_id"] for r in N.keep_one(make(docs).repartition(3)).collect()) == least_of_classes(docs)


def test_bitmaps_differ_in_fewer_bits_than_the_sets():
    rng = random.Random(6)
    for _ in range(200):
        a = {rng.getrandbits(63) for _ in range(rng.choice([0, 1, 30, 700, 3000]))}
        b = set(rng.sample(sorted(a), len(a) // 2)) | {rng.getrandbits(63) for _ in range(rng.choice([0, 5, 900]))}
        x, y = (N.parity(np.array(sorted(s), np.int64))[None] for s in (a, b))
        n = min(x.shape[1], y.shape[1])
        assert int(np.bitwise_count(N.fold(x, n) ^ N.fold(y, n)).sum()) <= len(a ^ b)


def test_near_by_bits_but_not_similar_stays(make):
    """Fingerprints within seven bits of each other do not make a link."""
    rng = random.Random(2)
    while True:
        base = [f"w{rng.randrange(10**6)}" for _ in range(60)]
        other = edited(rng, base, 3)
        a, b = " ".join(base), " ".join(other)
        x, y = shingle_set(a), shingle_set(b)
        if len(x & y) / len(x | y) < 0.8 and ((simhash(a.encode(), 5) ^ simhash(b.encode(), 5)) % 2**64).bit_count() <= 7:
            break
    assert N.keep_one(make([(1, a), (2, b)])).count() == 2


def test_large_group_of_copies_and_odd_rows(make):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(100)]
    docs = [(i, " ".join(edited(rng, base, rng.randint(0, 3)))) for i in range(150)]
    assert sorted(r["doc_id"] for r in N.keep_one(make(docs)).collect()) == least_of_classes(docs)
    odd = make([(5, "some text"), (None, "some text"), (7, None), (8, ""), (None, " \n"), (9, "x")], extra=("row", "doc", "mark", "u", "token"))
    out = N.keep_one(odd)
    assert out.columns == odd.columns and sorted(r["doc_id"] for r in out.collect()) == [5, 7, 9]
    assert N.keep_one(odd.limit(0)).count() == 0
