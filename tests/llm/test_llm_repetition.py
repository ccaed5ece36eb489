import random
from collections import Counter

from corpuslake.llm.repetition import Limits, judge, keep_good, may_repeat, quality_rules, repeats


def brute(words, least):
    n = len(words)

    def windows(k):
        return [tuple(words[i : i + k]) for i in range(n - k + 1)]

    def covered(k):
        w = windows(k)
        c = Counter(w)
        return len({p for i, g in enumerate(w) if c[g] > 1 for p in range(i, i + k)})

    longest = max((k for k in range(1, n) if len(set(windows(k))) < n - k + 1), default=0)
    return covered(5), covered(least), longest


def test_repeats_equal_brute_force():
    random.seed(7)
    texts = [[b"w%d" % random.randrange(v) for _ in range(random.randint(0, 50))] for v in (1, 2, 3, 5, 9, 40) for _ in range(40)]
    for text, found, suspect in zip(texts, repeats(texts, 7), may_repeat(texts), strict=True):
        expected = brute(text, 7)
        assert found == expected
        assert bool(suspect) == (expected[0] > 0)


def test_measures_and_verdicts():
    good = " ".join(f"word{i}" for i in range(40))
    long_repeat = " ".join(f"a{i}" for i in range(60))
    rest = " ".join(f"b{i}" for i in range(900))
    texts = [None, "", " \n\t", good, "é #$% <x>\nline one\n\nline one\n" + good, "go " * 30, f"{long_repeat} {rest} {long_repeat}"]
    rows = judge([None if t is None else t.encode() for t in texts], Limits()).to_pylist()
    assert [r["kept"] for r in rows] == [False, False, False, True, True, False, False]
    assert [r["base_failed"] for r in rows] == [True, True, True, False, False, True, False]
    assert rows[4]["n_symbols"] == 5 and rows[4]["n_dup_lines"] == 1 and rows[4]["n_words"] == 47
    assert rows[4]["word_chars"] == sum(map(len, texts[4].split()))
    assert rows[6]["longest_repeat"] == 60 and rows[6]["covered_words"] == 120 and rows[6]["n_repeat_words"] == 120


def test_ascii_white_space_only():
    [r] = judge(["a b c\x1cd\x0be".encode()], Limits()).to_pylist()
    assert r["n_words"] == 2 and r["word_chars"] == 8


def test_query_keeps_rows_and_columns(make):
    good = " ".join(f"word{i}" for i in range(40))
    docs = make([(1, good), (1, good), (None, good), (2, None), (3, ""), (4, good * 1000)], extra=("kept", "_v", "n_words"))
    out = quality_rules(docs).collect()
    assert len(out) == 6 and sum(r["kept"] for r in out) == 3
    kept = keep_good(docs)
    assert kept.columns == docs.columns and kept.count() == 3
    assert quality_rules(docs.limit(0)).count() == 0 and keep_good(docs.limit(0)).count() == 0
