"""Conversation structure repair (12): the cheapest edits that give a conversation a proper order of roles.

Proper is nothing, or an optional system turn and then user and assistant in turn, ending with an assistant: ``(s?(ua)+)?`` over the
roles' first letters. Edits and costs: Keep 0, Rerole to user or assistant 3, Delete 4, Insert an empty user or assistant turn 3; a
blank or repeated row must be deleted, and a truncated one that stays adds 3. Of the cheapest edits those whose initials read
least in ASCII are taken.

Secondary-sorted streaming. Rows are dealt by conversation and sorted by turn, so a task reads a conversation as a run of rows across
Arrow batches. A dynamic program over four states (nothing yet, after system, user, assistant) goes along: for each state it keeps the
least cost so far, and the order of the states' edit strings. Strings of edits up to a row all end in the row's own edit and hold
as many of these, so none begins another, and their order decides between equal costs for good. Costs less their least and the order take
few values: the program is an automaton that is made as it is met, and a row costs one look-up.

What a row leaves behind is the number of the transition (four bytes). At a conversation's end they are walked backwards to
one byte of edit a row, and then the rows forwards. Beyond ``HELD`` rows or ``HELD_BYTES`` bytes a conversation's rows, transitions
and edits go to the task's own scratch files, which vanish with it; memory stays bounded for a conversation of any length. A lost
executor costs its tasks, which start anew.

Rows that repeat another turn's role and text are found by a grouped minimum of the turn before (digests, pre-aggregated), as
the texts of a giant conversation need not fit one task; repeats within a turn are neighbours in the order.

Order: turn (null first), then role, then text. Cases: a null role or text counts as one space; null conversation ids are one conversation.
Texts are taken whole. Rows with ``present`` false only name their conversation: one without other rows has no edits. Empty tables
give empty results. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import tempfile
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows and bytes of a conversation that are held in memory.
HELD, HELD_BYTES = 1 << 20, 32 << 20
#: Rows of output in a batch.
OUT = 4096

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: State after an inserted or reroled turn: a user turn opens or follows an assistant, an assistant turn follows a user.
NEXT = (USER, USER, ASSISTANT, USER)
NAME = {USER: "user", ASSISTANT: "assistant"}
#: Edits of one row: up to two turns inserted before it, then its own. The number is the code that is stored.
EDITS = [i * "I" + own for i in range(3) for own in "DKR"]
#: Turns to insert at the end of each state.
CLOSING = ("", "II", "I", "")
#: How a row stands: its first fault, and its letter.
FINE, CUT, GONE = range(3)
LETTERS = "uas"
KEEPS = {("u", NOTHING): USER, ("u", SYSTEM): USER, ("u", ASSISTANT): USER, ("a", USER): ASSISTANT, ("s", NOTHING): SYSTEM}


class Program:
    """The dynamic program as an automaton: states are (costs less the least, order of the strings)."""

    def __init__(self):
        self.states: list[tuple] = []
        self.number: dict[tuple, int] = {}
        self.made: dict[tuple[int, int], tuple[int, int]] = {}
        #: For each transition: what was added to the least cost, and for each state after it (state before, edit), or None.
        self.back: list[tuple[int, tuple]] = []
        self.start = self._state(((0, 0), None, None, None))

    def _state(self, key: tuple) -> int:
        if key not in self.number:
            self.number[key] = len(self.states)
            self.states.append(key)
        return self.number[key]

    def step(self, state: int, kind: int) -> tuple[int, int]:
        """(state, transition) after a row of this kind: 3 x letter (u, a, s, other) + how it stands."""
        found = self.made.get((state, kind))
        if found is None:
            found = self.made[state, kind] = self._make(state, kind)
        return found

    def _make(self, state: int, kind: int) -> tuple[int, int]:
        letter, how = "uas?"[kind // 3], kind % 3
        best: list = [None] * 4
        for before, entry in enumerate(self.states[state]):
            if entry is None:
                continue
            cost, order = entry
            at = before
            for inserted in range(3):
                ways = [(at, DELETE, "D")]
                if how != GONE:
                    extra = TRUNCATED if how == CUT else 0
                    ways.append((NEXT[at], REROLE + extra, "R"))
                    if (letter, at) in KEEPS:
                        ways.append((KEEPS[letter, at], extra, "K"))
                for after, price, own in ways:
                    edit = inserted * "I" + own
                    new = (cost + inserted * INSERT + price, order, edit, before)
                    if best[after] is None or new < best[after]:
                        best[after] = new
                at = NEXT[at]
        least = min(b[0] for b in best if b)
        ranks = {b[1:3]: i for i, b in enumerate(sorted((b for b in best if b), key=lambda b: b[1:3]))}
        after = self._state(tuple(b and (b[0] - least, ranks[b[1:3]]) for b in best))
        self.back.append((least, tuple(b and (b[3], EDITS.index(b[2])) for b in best)))
        return after, len(self.back) - 1

    def end(self, state: int) -> tuple[int, int]:
        """(state, cost above the least) that the cheapest edits end in."""
        ends = [(cost + len(CLOSING[q]) * INSERT, order, q) for q, entry in enumerate(self.states[state]) if entry for cost, order in [entry]]
        cost, _, q = min(ends)
        return q, cost


class Numbers:
    """Numbers in the order they are added; beyond ``held`` of them they go to a scratch file."""

    def __init__(self, code: str, held: int):
        self.code, self.held, self.here, self.file, self.written = code, held, array(code), None, 0

    def add(self, x: int) -> None:
        self.here.append(x)
        if len(self.here) >= self.held:
            self.file = self.file or tempfile.TemporaryFile()
            self.file.write(self.here.tobytes())
            self.written += len(self.here)
            self.here = array(self.code)

    def backwards(self) -> Iterator[int]:
        yield from reversed(self.here)
        stop = self.written
        while stop:
            start = max(0, stop - self.held)
            self.file.seek(start * self.here.itemsize)
            yield from reversed(array(self.code, self.file.read((stop - start) * self.here.itemsize)))
            stop = start


class Rows:
    """(role, text) rows; beyond ``held`` bytes they go to a scratch file of Arrow batches."""

    def __init__(self, held: int):
        self.held, self.here, self.bytes, self.file, self.writer = held, [], 0, None, None

    def add(self, part: pa.RecordBatch) -> None:
        self.here.append(part)
        self.bytes += part.nbytes
        if self.bytes > self.held:
            if self.file is None:
                self.file = tempfile.TemporaryFile()
                self.writer = pa.ipc.new_stream(self.file, part.schema)
            for x in self.here:
                self.writer.write_batch(x)
            self.here, self.bytes = [], 0

    def __iter__(self) -> Iterator[tuple[str, str]]:
        parts = list(self.here)
        if self.file is not None:
            self.writer.close()
            self.file.seek(0)
            for x in pa.ipc.open_stream(self.file):
                yield from zip(x.column(0).to_pylist(), x.column(1).to_pylist(), strict=True)
        for x in parts:
            yield from zip(x.column(0).to_pylist(), x.column(1).to_pylist(), strict=True)


class Conversation:
    """The state that is carried along the rows of one conversation."""

    def __init__(self, key, program: Program, held: int, held_bytes: int):
        self.key, self.program, self.held = key, program, held
        self.state, self.cost, self.n = program.start, 0, 0
        self.steps, self.rows = Numbers("I", held), Rows(held_bytes)
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
        self.turns = [None, None, 0]
        self.last = None

    def turn(self, turn) -> None:
        if turn is not None:
            first, last, n = self.turns
            if n == 0 or turn != last:
                self.turns = [turn if n == 0 else first, turn, n + 1]

    def row(self, turn, letter: str, code: int, fault: str | None) -> None:
        self.turn(turn)
        if fault:
            self.counts[fault] += 1
        if self.last is not None and self.last + letter not in ("su", "ua", "au"):
            self.counts["illegal"] += 1
        self.last = letter
        self.state, step = self.program.step(self.state, 3 * code + (GONE if fault in ("blank", "duplicate") else CUT if fault else FINE))
        self.cost += self.program.back[step][0]
        self.steps.add(step)
        self.n += 1

    def edits(self) -> Iterator[tuple[str, str, str]]:
        """(edit, role, text) of each edit in order; an inserted turn has an empty text, a deleted row its own."""
        end, more = self.program.end(self.state)
        self.cost += more
        way, q = Numbers("B", max(1, self.held)), end
        for step in self.steps.backwards():
            q, edit = self.program.back[step][1][q]
            way.add(edit)
        q = NOTHING
        for code, (role, text) in zip(way.backwards(), self.rows, strict=True):
            edit = EDITS[code]
            for _ in edit[:-1]:
                q = NEXT[q]
                yield "I", NAME[q], ""
            own = edit[-1]
            if own == "R":
                q = NEXT[q]
                role = NAME[q]
            elif own == "K":
                q = KEEPS[role[0], q]
            yield own, role, text
        for _ in CLOSING[end]:
            q = NEXT[q]
            yield "I", NAME[q], ""


class _Edited:
    """Output: a row for each edit."""

    schema = "conv_id {id}, position long, edit string, role string, text string"

    def __init__(self, id_type: pa.DataType):
        self.fields = pa.schema([("conv_id", id_type), ("position", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])

    def of(self, c: Conversation) -> Iterator[tuple]:
        for i, (edit, role, text) in enumerate(c.edits()):
            yield c.key, i, edit, role, text


class _Report(_Edited):
    """Output: a row for each conversation."""

    schema = "conv_id {id}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"

    def __init__(self, id_type: pa.DataType):
        counts = [(x, pa.int64()) for x in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
        self.fields = pa.schema([("conv_id", id_type), *counts, ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def of(self, c: Conversation) -> Iterator[tuple]:
        audit, digest, first = bytearray(), hashlib.sha256(), True
        for edit, role, text in c.edits():
            audit += edit.encode()
            if edit != "D":
                digest.update(b"" if first else b"\n")
                digest.update(role.encode())
                digest.update(b":")
                digest.update(text.encode())
                first = False
        low, high, n = c.turns
        yield c.key, high - low + 1 - n if n else 0, *c.counts.values(), c.cost, audit.decode(), digest.hexdigest()


def _stream(kind: type, held: int, held_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        program, now, before, ready, sink = Program(), None, None, [], None

        def flush(least: int) -> Iterator[pa.RecordBatch]:
            nonlocal ready
            if len(ready) >= least and ready:
                columns = [pa.array(x, f.type) for x, f in zip(zip(*ready, strict=True), sink.fields, strict=True)]
                ready = []
                yield pa.RecordBatch.from_arrays(columns, schema=sink.fields)

        def done() -> Iterator[pa.RecordBatch]:
            for x in sink.of(now):
                ready.append(x)
                yield from flush(OUT)

        for batch in batches:
            sink = sink or kind(batch.schema.field("conv_id").type)
            names = ("conv_id", "turn", "present", "letter", "code", "fault", "role", "text")
            columns = [batch.column(x).to_pylist() for x in names]
            pair = batch.select(["role", "text"])
            start = 0
            for i, (key, turn, present, letter, code, fault, role, text) in enumerate(zip(*columns, strict=True)):
                if now is None or key != now.key:
                    if now is not None:
                        now.rows.add(pair.slice(start, i - start))
                        yield from done()
                    now, before, start = Conversation(key, program, held, held_bytes), None, i
                if not present:  # it names the conversation only
                    if i > start:
                        now.rows.add(pair.slice(start, i - start))
                    start = i + 1
                    continue
                this = (turn, role, text)
                now.row(turn, letter, code, "duplicate" if fault != "blank" and this == before else fault)
                before = this
            if now is not None:
                now.rows.add(pair.slice(start))
        if now is not None:
            yield from done()
        yield from flush(1)

    return run


BLANK = r"^[\x20\x09-\x0D]*\z"
ENDED = r"(?s)[.!?][\x20\x09-\x0D]*\z"


def _sorted(rows: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str, present: Column | None) -> DataFrame:
    there = F.lit(True) if present is None else F.coalesce(present, F.lit(False))
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (role_col, text_col))
    mine = rows.select(F.col(id_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), there.alias("present"), role.alias("role"), text.alias("text"))
    digest = F.unhex(F.md5("text"))
    # the first turn of a role and text that several turns have; a null turn counts as the first of all
    spread = mine.where("present").groupBy("conv_id", "role", digest.alias("digest")).agg(
        F.min("turn").alias("low"), F.max("turn").alias("high"), F.count("*").alias("n"), F.count("turn").alias("known")
    )
    repeated = spread.where("low < high or (known > 0 and known < n)").select(
        "conv_id", "role", "digest", F.when(F.col("known") == F.col("n"), F.col("low")).alias("low")
    )
    named = mine.withColumn("digest", digest).alias("m").join(
        repeated.alias("r"), F.expr("m.conv_id <=> r.conv_id and m.role = r.role and m.digest = r.digest and m.present"), "left"
    )
    later = F.expr("r.digest is not null and m.turn is not null and (r.low is null or m.turn > r.low)")
    letter = F.substring("m.role", 1, 1)
    fault = (
        F.when(F.col("m.text").rlike(BLANK), "blank").when(later, "duplicate").when(~F.col("m.text").rlike(ENDED), "truncated")
    )
    code = F.when(letter == "u", 0).when(letter == "a", 1).when(letter == "s", 2).otherwise(3)
    flagged = named.select("m.conv_id", "m.turn", "m.present", letter.alias("letter"), code.alias("code"), fault.alias("fault"), "m.role", "m.text")
    return flagged.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def _run(kind: type, rows, id_col, turn_col, role_col, text_col, present, held, held_bytes) -> DataFrame:
    ready = _sorted(rows, id_col, turn_col, role_col, text_col, present)
    schema = kind.schema.format(id=dict(ready.dtypes)["conv_id"])
    return ready.mapInArrow(_stream(kind, held, held_bytes), schema).withColumnRenamed("conv_id", id_col)


def repaired(
    rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", present: Column | None = None, held: int = HELD, held_bytes: int = HELD_BYTES
) -> DataFrame:
    """(conversation, position, edit, role, text): every edit in order; the repaired conversation is all but the edits D."""
    return _run(_Edited, rows, id_col, turn_col, role_col, text_col, present, held, held_bytes)


def report(
    rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", present: Column | None = None, held: int = HELD, held_bytes: int = HELD_BYTES
) -> DataFrame:
    """A row per conversation: missing turns, counts of faults and improper neighbours, cost, edit initials, digest of the repaired rows."""
    return _run(_Report, rows, id_col, turn_col, role_col, text_col, present, held, held_bytes)


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with faults put in by crc32 of "conv_id:turn", modulo 20; dropped rows stay as not ``present``.

    0 drops a row, 1 empties its text, 2 removes ``.!?`` from it, 3 repeats it, 4 gives it to the user. A null counts as one space.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    draw = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    named = rows.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), draw.alias("draw"))
    text = F.when(F.col("draw") == 1, "").when(F.col("draw") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.explode(F.when(F.col("draw") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    role = F.when(F.col("draw") == 4, "user").otherwise(F.col("role"))
    out = named.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("draw") != 0).alias("present"), times.alias("copy"))
    return out.drop("copy")
