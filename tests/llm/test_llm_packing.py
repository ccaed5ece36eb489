import random
import zlib
from collections import Counter

import numpy as np
import pytest

from corpuslake.llm import packing as K


def laid_out(counts, capacity):
    plan = K.Plan(counts, capacity)
    slots = plan.slots()
    length = np.array([x for x, n in counts.items() for _ in range(n)])
    rank = np.concatenate([np.arange(n) for n in counts.values()])
    bin_, offset = K.place(length, rank, slots)
    check_layout(zip(bin_.tolist(), offset.tolist(), length.tolist(), strict=True), capacity)
    assert len(set(bin_.tolist())) == plan.bins
    return plan


def check_layout(rows, capacity):
    """Pieces of each sequence follow each other from 0 on, without gaps, up to the capacity."""
    at = {}
    for b, o, n in sorted(rows):
        assert o == at.get(b, 0)
        at[b] = o + n
    assert all(v <= capacity for v in at.values())
    return len(at)


def optimum(items, capacity):
    items, best = sorted(items, reverse=True), [len(items)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for room in sorted({b for b in bins if b >= items[i]}):
            rest = list(bins)
            rest[rest.index(room)] -= items[i]
            go(i + 1, rest)
        go(i + 1, [*bins, capacity - items[i]])

    go(0, [])
    return best[0]


def test_reduction_is_optimal_and_plan_is_valid():
    rng, reduced = random.Random(1), 0
    for _ in range(400):
        capacity = rng.randint(8, 40)
        items = [rng.randint(1, capacity) for _ in range(rng.randint(1, 9))]
        plan = laid_out(dict(Counter(items)), capacity)
        only = K.Plan.__new__(K.Plan)
        only.capacity, only.kinds = capacity, []
        only.left = np.bincount(items, minlength=capacity + 1).astype(np.int64)
        only.reduce()
        fixed = sum(n for _, n in only.kinds)
        rest = [x for x in range(capacity + 1) for _ in range(only.left[x])]
        assert fixed + optimum(rest, capacity) == optimum(items, capacity)
        assert plan.bins <= optimum(items, capacity) + 1
        reduced += fixed > 0
    assert reduced > 300


def test_large_plan_is_near_the_bound():
    rng = np.random.default_rng(0)
    counts = Counter(np.minimum(2048, rng.lognormal(5.8, 1.2, 20000).astype(int) + 1).tolist())
    plan = laid_out(dict(counts), 2048)
    assert plan.bins <= 1.01 * sum(k * n for k, n in counts.items()) / 2048 + 1
    assert K.Plan({}, 2048).bins == 0


def test_encoder_equals_the_tokenizer():
    from tokenizers import Tokenizer

    files = K.public_files()
    code, whole, rng = K.encoder(*files), Tokenizer.from_file(files[0]), random.Random(2)
    parts = ["a", "the", " ", "\n", "  ", "\t", "é", "'s", "'", "123", " ", "!!", "<|endoftext|>", "\x1c", "日本", "́", "\xa0", "'ll", "\r\n", "😀"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        assert np.frombuffer(code.encode(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("n,capacity,expected", [(1, 4, [(0, 1)]), (4, 4, [(0, 4)]), (5, 4, [(0, 1), (1, 4)]), (8, 4, [(0, 4), (4, 4)]), (9, 4, [(0, 1), (1, 4), (5, 4)])])
def test_only_the_first_piece_is_short(n, capacity, expected):
    assert K.cut(n, capacity) == expected


def test_query_against_brute_force(make):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(K.public_files()[0])
    rng = random.Random(3)
    texts = [(i, " ".join(rng.choice(["the", "cat", "sat", "Überall", "x"]) for _ in range(rng.randint(0, 300)))) for i in range(150)]
    texts += [(200, None), (201, ""), (202, "word " * 900), (3, "same"), (3, "same"), (None, "same")]
    docs = make(texts, extra=("piece", "rank", "bucket", "length"))
    capacity = 256
    rows = K.pack(docs, capacity=capacity).collect()
    expected = []
    for i, t in texts:
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 0]
        data = np.array(ids, "<u4").tobytes()
        expected += [(str(i), k, s, n, zlib.crc32(data[4 * s : 4 * (s + n)])) for k, (s, n) in enumerate(K.cut(len(ids), capacity))]
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(expected)
    n = check_layout(((r["sequence_id"], r["offset"], r["length"]) for r in rows), capacity)
    assert n <= -(-sum(r["length"] for r in rows) // capacity) + 2
    assert K.pack(docs.limit(0)).count() == 0


def test_ranks_of_a_hot_length_are_split(spark):
    parts = spark.range(5000).selectExpr("id as doc_id", "0 as piece", "if(id % 10 < 7, 5, id % 3 + 1) as length")
    rows = K.ranked(parts, ["doc_id", "piece"], bucket=100).groupBy("length").agg({"rank": "max", "*": "count"}).collect()
    assert all(r["max(rank)"] == r["count(1)"] - 1 for r in rows)
    assert K.ranked(parts, ["doc_id", "piece"], bucket=100).select("length", "rank").distinct().count() == 5000
