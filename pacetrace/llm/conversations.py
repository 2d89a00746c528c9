"""Repair of the role structure of conversations by streams that are sorted inside each conversation.

A repaired conversation follows ``(s?(ua)+)?`` in the first letters of its roles: an optional system turn, then user and
assistant in turn.  Rows may be kept, given another role, deleted, or empty turns inserted, each at a price.
"""

from __future__ import annotations

import functools
import hashlib
import tempfile
from array import array
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Prices of the edits, and of leaving a truncated row in.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3

# What the output ends with after some rows.
START, SYSTEM, USER, ASSISTANT = range(4)
_NEXT = {START: USER, SYSTEM: USER, ASSISTANT: USER, USER: ASSISTANT}  # the turn that an insertion or a new role gives
_NAME = {USER: "user", ASSISTANT: "assistant"}
_KEEPS = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
#: No cheapest repair inserts more than two turns in one place: the third leads back to where the first led.
MOST_INSERTS = 2
#: Entries of the trail that a conversation keeps in memory; what comes before goes to a file of the task.
TRAIL_ROWS = 1 << 20


class Machine:
    """The dynamic programme as a finite automaton.

    For each way the output can end, the cheapest edits of the rows so far are known by their price (relative to the
    cheapest) and by their rank in ASCII order among the four.  No such edit string is the beginning of another one, since
    all treat the same rows and end with a row's letter; so ranks decide later ties, and the strings needn't be carried.
    There are few such situations, so a row costs one look-up.  A step says, for each ending, where it came from.
    """

    def __init__(self) -> None:
        self.situations: list[tuple] = []
        self.number: dict[tuple, int] = {}
        self.steps: list[tuple] = []
        self.known: dict[tuple, int] = {}
        self._situation(((0, 0), None, None, None))

    def _situation(self, ends: tuple) -> int:
        if ends not in self.number:
            self.number[ends] = len(self.situations)
            self.situations.append(ends)
        return self.number[ends]

    def step(self, at: int, letter: str, gone: bool, truncated: bool) -> int:
        """Number of the step that a row makes from situation ``at``; ``gone``: the row must be deleted."""
        key = (at, letter if letter in _KEEPS else "", gone, truncated and not gone)
        if key not in self.known:
            self.known[key] = len(self.steps)
            self.steps.append(self._work_out(*key))
        return self.known[key]

    def _work_out(self, at: int, letter: str, gone: bool, truncated: bool) -> tuple:
        best: list = [None] * 4
        for start, end in enumerate(self.situations[at]):
            if end is None:
                continue
            price, rank = end
            state = start
            for n in range(MOST_INSERTS + 1):
                moves = [("D", state, DELETE)]
                if not gone:
                    extra = TRUNCATED if truncated else 0
                    kept = _KEEPS.get(letter, {}).get(state)
                    moves += [("K", kept, extra)] if kept is not None else []
                    moves.append(("R", _NEXT[state], REROLE + extra))
                for edit, to, cost in moves:
                    option = (price + n * INSERT + cost, rank, "I" * n + edit, start)
                    if best[to] is None or option < best[to]:
                        best[to] = option
                state = _NEXT[state]
        low = min(b[0] for b in best if b)
        order = {b[1:3]: i for i, b in enumerate(sorted((b for b in best if b), key=lambda b: b[1:3]))}
        after = self._situation(tuple((b[0] - low, order[b[1:3]]) if b else None for b in best))
        return after, low, tuple((b[3], b[2]) if b else None for b in best)

    def finish(self, at: int) -> tuple[int, int, int]:
        """Price of ending here, the number of turns to insert, and the ending that they follow."""
        missing = {START: 0, ASSISTANT: 0, USER: 1, SYSTEM: 2}
        options = [(end[0] + missing[state] * INSERT, end[1], missing[state], state) for state, end in enumerate(self.situations[at]) if end]
        price, _, inserts, state = min(options)
        return price, inserts, state


@functools.cache
def machine() -> Machine:
    """The worker's automaton."""
    return Machine()


class Trail:
    """Step numbers of a conversation's rows, two bytes a row, read back from the last to the first.

    What exceeds ``TRAIL_ROWS`` goes to an unnamed file that only this task sees and that ends with it.
    """

    def __init__(self) -> None:
        self.steps, self.file = array("H"), None

    def add(self, step: int) -> None:
        self.steps.append(step)
        if len(self.steps) >= TRAIL_ROWS:
            self.file = self.file or tempfile.TemporaryFile()
            self.steps.tofile(self.file)
            self.steps = array("H")

    def backwards(self) -> Iterator[int]:
        yield from reversed(self.steps)
        if self.file:
            for block in range(self.file.seek(0, 1) // (2 * TRAIL_ROWS) - 1, -1, -1):
                self.file.seek(block * 2 * TRAIL_ROWS)
                part = array("H")
                part.fromfile(self.file, TRAIL_ROWS)
                yield from reversed(part)
            self.file.close()


class Conversation:
    """What is known of the conversation at hand; texts are hashed as they pass, once for each ending, and not kept."""

    def __init__(self, name) -> None:
        self.name, self.machine, self.trail = name, machine(), Trail()
        self.at, self.cost = 0, 0
        self.hashes: list = [hashlib.sha256(), None, None, None]
        self.first_turn = self.last_turn = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.letter: str | None = None

    def _hash(self, start: int, edits: str, role: str, text: str):
        """The digest of the output that ended with ``start`` after ``edits``, which treat one row at most."""
        if edits == "D":
            return self.hashes[start]
        h, state = self.hashes[start].copy(), start
        for e in edits:
            if e == "D":
                continue
            h.update(b"" if state == START else b"\n")
            to = _KEEPS[role[:1]][state] if e == "K" else _NEXT[state]
            line = f"{role}:{text}" if e == "K" else f"{_NAME[to]}:{text if e == 'R' else ''}"
            h.update(line.encode())
            state = to
        return h

    def row(self, turn: int | None, role: str, text: str, blank: bool, repeated: bool, truncated: bool) -> None:
        if turn is not None:
            self.turns += turn != self.last_turn
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn
        letter = role[:1]
        if self.letter is not None:
            self.illegal += self.letter + letter not in ("su", "ua", "au")
        self.letter = letter
        repeated, truncated = repeated and not blank, truncated and not blank and not repeated
        self.blank, self.duplicate, self.truncated = self.blank + blank, self.duplicate + repeated, self.truncated + truncated
        step = self.machine.step(self.at, letter, blank or repeated, truncated)
        self.at, price, origins = self.machine.steps[step]
        self.cost += price
        self.hashes = [None if o is None else self._hash(o[0], o[1], role, text) for o in origins]
        self.trail.add(step)

    def result(self) -> tuple:
        price, inserts, state = self.machine.finish(self.at)
        digest = self._hash(state, "I" * inserts, "", "").hexdigest()
        edits, steps = ["I" * inserts], self.machine.steps
        for step in self.trail.backwards():
            state, letters = steps[step][2][state]
            edits.append(letters)
        gaps = 0 if self.first_turn is None else self.last_turn - self.first_turn + 1 - self.turns
        return (self.name, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost + price, "".join(reversed(edits)), digest)


_COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
_RESULT = "conv string, " + ", ".join(f"{c} long" for c in _COUNTS) + ", audit string, repaired_sha256 string"


def _run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [c.split()[0] for c in _RESULT.split(", ")]
    now, own, done = None, None, []
    for batch in batches:
        for name, unnamed, there, nothing, turn, role, text, blank, repeated, truncated in zip(*(batch[c].tolist() for c in batch.columns)):
            if own != (name, unnamed):
                if now is not None:
                    done.append(now.result())
                now, own = Conversation(None if unnamed else name), (name, unnamed)
            if there:
                now.row(None if nothing else turn, role, text, blank, repeated, truncated)
        if done:
            yield pd.DataFrame(done, columns=columns)
            done = []
    if now is not None:
        yield pd.DataFrame([now.result()], columns=columns)


def _ordered(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, present: Column | None) -> DataFrame:
    """The rows in order inside each conversation, with their faults; nulls of role and text are one space."""
    there = F.lit(True) if present is None else F.coalesce(present, F.lit(False))
    rows = conversations.select(
        F.col(conv_col).cast("string").alias("conv"), there.alias("there"), F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit(" ")).alias("text"),
    )
    solid = F.rtrim("text", F.lit(" \t\n\x0b\x0c\r"))
    same = Window.partitionBy("conv", "there", "same").orderBy("turn")
    return (
        rows.repartition("conv")  # the only shuffle: the two sorts below stay inside its partitions
        .withColumn("same", F.sha2(F.concat_ws("\x00", "role", "text"), 256))
        .withColumn("repeated", F.row_number().over(same) > 1).drop("same")
        .withColumn("blank", solid == "").withColumn("truncated", ~F.right(solid, F.lit(1)).isin(".", "!", "?"))
        .sortWithinPartitions("conv", "turn", "role", "text", "repeated")
    )


def repair(
    conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    present: Column | None = None,
) -> DataFrame:
    """One row per conversation: ``conv_col, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``.

    ``audit`` has the cheapest edits in order: K keep, R give the role user or assistant, D delete (blank rows and repeats of
    an earlier role and text must go), I insert an empty turn.  Of equally cheap ones it is the least in ASCII order.
    ``repaired_sha256`` is the digest of the repaired turns as ``role:text`` lines; ``repaired_turns`` gives them as rows.

    Method: rows are dealt by conversation and sorted by turn; ``mapInPandas`` goes through them and carries the state of the
    dynamic programme and the running digests from one Arrow batch to the next.  Two bytes a row remember how each state was
    reached; beyond ``TRAIL_ROWS`` rows of one conversation they spill to an unnamed file of the task.  No conversation is
    ever held in memory, however long; its audit is one string.

    Null roles and texts are one space.  Rows are ordered by turn (nulls first), then role and text; equal rows are repeats.
    A null conversation id is a conversation of its own.  Rows for which ``present`` is not true only name their conversation:
    one without other rows has zeros, an empty audit and the digest of nothing.  An empty role fits nowhere and is never kept.
    Extra columns are ignored; an empty table gives an empty table.
    """
    rows = _ordered(conversations, conv_col, turn_col, role_col, text_col, present)
    passed = rows.select(
        F.coalesce("conv", F.lit("")).alias("conv"), F.col("conv").isNull().alias("unnamed"), "there",
        F.col("turn").isNull().alias("nothing"), F.coalesce("turn", F.lit(0)).alias("turn"), "role", "text", "blank", "repeated", "truncated",
    )
    kind = conversations.schema[conv_col].dataType
    return passed.mapInPandas(_run, _RESULT).select(F.col("conv").cast(kind).alias(conv_col), *_COUNTS, "audit", "repaired_sha256")


def repaired_turns(
    conversations: DataFrame, repaired: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    present: Column | None = None,
) -> DataFrame:
    """The repaired conversations as rows ``conv_col, position, edit, turn, role, text``, from the audits of ``repair``.

    ``position`` counts from 0; ``turn`` is null for inserted turns.  Audits are cut into one piece per row (its insertions
    and its letter), and rows meet their piece by conversation and number.  Numbers are windows by conversation, which stream
    and spill.  Nulls, ties and empty tables: as in ``repair``.
    """
    kind = conversations.schema[conv_col].dataType
    rows = _ordered(conversations, conv_col, turn_col, role_col, text_col, present).filter("there")
    number = Window.partitionBy("conv").orderBy("turn", "role", "text", "repeated")
    rows = rows.select("conv", F.row_number().over(number).alias("n"), "turn", "role", "text")
    audits = repaired.select(F.col(conv_col).cast("string").alias("conv"), F.posexplode(F.regexp_extract_all("audit", F.lit("I*[DKR]|I+$"), F.lit(0))).alias("n", "piece"))
    letters = audits.withColumn("n", F.col("n") + 1).select("conv", "n", F.posexplode(F.split("piece", "")).alias("k", "edit")).filter("edit in ('I', 'K', 'R')")
    met = letters.join(rows.withColumnRenamed("conv", "own").withColumnRenamed("n", "m"), F.col("conv").eqNullSafe(F.col("own")) & (F.col("n") == F.col("m")), "left")
    order = Window.partitionBy("conv").orderBy("n", "k")
    # After a row of system or assistant, or first, comes user; so the role of an edit follows from the turns before it.
    placed = met.withColumn("position", F.row_number().over(order) - 1)
    system = F.max(F.when((F.col("position") == 0) & (F.col("edit") == "K") & F.col("role").startswith("s"), 1).otherwise(0)).over(Window.partitionBy("conv"))
    given = F.when((F.col("position") - system) % 2 == 0, "user").otherwise("assistant")
    own = F.col("edit") == "K"
    return placed.select(
        F.col("conv").cast(kind).alias(conv_col), "position", "edit", F.when(F.col("edit") != "I", F.col("turn")).alias("turn"),
        F.when(own, F.col("role")).otherwise(given).alias("role"), F.when(F.col("edit") == "I", "").otherwise(F.col("text")).alias("text"),
    )


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows of ``conversations`` with faults by ``crc32(conv_id:turn) % 20``, and ``present``: false for a row that is dropped.

    0 drops, 1 empties the text, 2 removes its ``.!?``, 3 repeats the row, 4 makes it a user's.  Nulls count as one space.
    """
    space = F.lit(" ")
    rows = conversations.select(
        "conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"),
        (F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))) % 20).alias("fault"),
    )
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select(
        "conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        (F.col("fault") != 0).alias("present"), F.explode(times).alias("copy"),
    ).drop("copy")
