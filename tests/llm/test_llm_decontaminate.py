import hashlib
import random
import re

from corpuslake.llm import decontaminate as D


def brute(text, items):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    words, hit, ids = find(text), set(), set()
    for item, body in items:
        w = find(body)
        k = min(10, len(w))
        windows = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if k else set()
        for i in range(len(words) - k + 1 if k else 0):
            if tuple(words[i : i + k]) in windows:
                hit |= set(range(i, i + k))
                ids |= {str(item)} if item is not None else set()
    return len(words), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)


def test_winnowing_keeps_one_of_every_window():
    random.seed(2)
    import numpy as np

    for _ in range(200):
        h = np.array([random.randrange(5) for _ in range(random.randint(6, 40))], np.uint64)
        at = D.winnow(h, 6).tolist()
        for i in range(len(h) - 5):
            own = h[i : i + 6]
            assert i + max(j for j in range(6) if own[j] == own.min()) in at


def case(make, spark, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(30)] + ["É", "x1"]
    words = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(words(rng.randint(1, 40)))) for i in range(25)]
    items += [(None, "null id item of twelve words that are here to be hit now"), (40, None), (41, ""), (42, "..."), (43, items[0][1]), (43, "again again again again again again again again again again again"), (44, "Rareword"), (45, "two-words")]
    docs = []
    for i in range(120):
        body = words(rng.randint(0, 50))
        for _ in range(rng.randint(0, 2)):
            own = (rng.choice(items)[1] or "").split()
            a = rng.randint(0, max(0, len(own) - 3))
            at = rng.randint(0, len(body))
            body[at:at] = own[a : a + rng.randint(3, 20)]
        docs.append((i, rng.choice([" ", ", ", "\n"]).join(body).upper() if i % 3 == 0 else " ".join(body)))
    docs += [(500, None), (501, ""), (501, "again " * 30), (None, items[5][1]), (502, "rareword"), (503, "two words"), (504, "two")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    return docs, items, make(docs, extra=("overlap", "n_hit", "item_id")), bench


def test_equals_brute_force_in_one_block_and_in_many(make, spark):
    docs, items, frame, bench = case(make, spark, 5)
    expected = sorted((str(i), *brute(t, items)) for i, t in docs)
    assert sum(e[-1] for e in expected) > 40
    for size in (10**6, 800):
        got = D.contamination(frame, bench, block_bytes=size).collect()
        assert sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in got) == expected


def test_stage_drops_hit_documents_only(make, spark):
    docs, items, frame, bench = case(make, spark, 6)
    kept = D.drop_contaminated(frame, bench)
    assert kept.columns == frame.columns
    assert kept.count() == sum(not brute(t, items)[-1] for _, t in docs)
    assert D.drop_contaminated(frame, bench.limit(0)).count() == len(docs)
    assert D.drop_contaminated(frame.limit(0), bench).count() == 0
