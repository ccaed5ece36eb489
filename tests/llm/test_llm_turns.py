"""Conversation repair against all edits tried by recursion, with memory so short that everything goes to scratch files."""

import functools
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from corpuslake.llm import turns

SCHEMA = "conv_id long, turn long, role string, text string"
WHITE = " \t\n\x0b\x0c\r"


def order(row):
    turn, role, text = row
    return turn is not None, turn or 0, role.encode(), text.encode()


def brute(conversation):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, digest) of sorted (turn, role, text) rows."""
    rows, seen, counts = [], set(), dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
    for _, role, text in conversation:
        s = text.strip(WHITE)
        fault = "blank" if not s else "duplicate" if (role, text) in seen else "truncated" if s[-1] not in ".!?" else None
        seen.add((role, text))
        rows.append((role, text, fault))
        if fault:
            counts[fault] += 1
    counts["illegal"] = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))

    @functools.lru_cache(None)
    def best(i, last, inserted):
        ways = [(0, "", ())] if i == len(rows) and last in ("", "a") else []
        name = "assistant" if last == "u" else "user"
        if inserted < 4:
            cost, audit, out = best(i, name[0], inserted + 1)
            ways.append((cost + 3, "I" + audit, (f"{name}:", *out)))
        if i < len(rows):
            role, text, fault = rows[i]
            more = 3 * (fault == "truncated")
            cost, audit, out = best(i + 1, last, 0)
            ways.append((cost + 4, "D" + audit, out))
            if fault not in ("blank", "duplicate"):
                cost, audit, out = best(i + 1, name[0], 0)
                ways.append((cost + 3 + more, "R" + audit, (f"{name}:{text}", *out)))
                first = role[:1]
                if (first == "u" and last != "u") or (first == "a" and last == "u") or (first == "s" and last == ""):
                    cost, audit, out = best(i + 1, first, 0)
                    ways.append((cost + more, "K" + audit, (f"{role}:{text}", *out)))
        return min(ways, default=(10**9, "~", ()))

    cost, audit, out = best(0, "", 0)
    known = [t for t, _, _ in conversation if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    return (gaps, *counts.values(), cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def made_up(n=300):
    rng, rows = random.Random(5), []
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None]
    for c in range(n):
        for t in range(rng.randint(1, 9)):
            turn = rng.choice([t, t, t, None, t + 1, 1000 + t])
            rows.append((c or None, turn, rng.choice(roles), rng.choice(["a.", "b.", "b", "", "  ", "c!\n", "d? x", None, "some text."])))
    return rows


def expected(rows):
    groups = {}
    space = lambda x: " " if x is None else x
    for c, t, role, text in rows:
        groups.setdefault(c, []).append((t, space(role), space(text)))
    return {c: brute(sorted(v, key=order)) for c, v in groups.items()}


@pytest.mark.parametrize("held", [(turns.HELD, turns.HELD_BYTES), (2, 1)])
def test_report_equals_brute_force(spark, held):
    rows = made_up()
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("letter", F.lit("x")).withColumn("digest", F.lit("x")).repartition(5)
    got = {r[0]: tuple(r)[1:] for r in turns.report(frame, held=held[0], held_bytes=held[1]).collect()}
    assert got == expected(rows)


def test_repaired_rows_give_the_digest(spark):
    rows = made_up(80)
    out = {}
    for r in sorted(turns.repaired(spark.createDataFrame(rows, SCHEMA)).collect(), key=lambda r: r["position"]):
        out.setdefault(r["conv_id"], []).append(r)
    for c, want in expected(rows).items():
        edits = out.get(c, [])
        assert "".join(r["edit"] for r in edits) == want[-2]
        lines = [f"{r['role']}:{r['text']}" for r in edits if r["edit"] != "D"]
        assert hashlib.sha256("\n".join(lines).encode()).hexdigest() == want[-1]


def test_giant_conversation_and_odd_tables(spark):
    """One conversation across many Arrow batches, its duplicates far apart; a conversation without rows; an empty table."""
    n = 30_000
    rows = [(7, i, "user" if i % 2 == 0 else "assistant", f"text {i % 29_000}.") for i in range(n)]
    frame = spark.createDataFrame(rows, SCHEMA)
    r = turns.report(frame, held=1000, held_bytes=10_000).first()
    assert (r["gaps"], r["duplicate"], r["blank"], r["illegal"]) == (0, 1000, 0, 0)
    assert r["audit"] == "K" * 29_000 + "D" * 1000 and r["cost"] == 4000
    gone = spark.createDataFrame([(1, 1, "user", "x."), (2, None, None, None)], SCHEMA)
    got = {x["conv_id"]: (x["cost"], x["audit"], x["repaired_sha256"]) for x in turns.report(gone, present=F.col("conv_id") == 2).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    assert got == {1: (0, "", empty), 2: (4, "D", empty)}
    assert turns.report(gone.limit(0)).count() == 0 and turns.repaired(gone.limit(0)).count() == 0


def test_damage_keeps_every_conversation(spark):
    rows = [(c, t, "assistant", "Some text. More!") for c in range(40) for t in range(3)] + [(None, None, None, None)]
    out = turns.damaged(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r["conv_id"] for r in out} == {r[0] for r in rows}
    kept = [r for r in out if r["present"]]
    assert {"user", "assistant"} <= {r["role"] for r in kept} and {"", "Some text More", "Some text. More!"} <= {r["text"] for r in kept}
