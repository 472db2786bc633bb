"""Repairing the turn structure of conversations at least cost, by a lazily determinised automaton.

Role initials of a conversation should read ``(s?(ua)+)?``: four states, START, SYSTEM, USER and
ASSISTANT. A row is kept if its initial leads on (free), given the role that leads on (2) or deleted
(3; the only way for blank and repeated rows); an empty turn is inserted for 2; a truncated row that
stays costs 1 more.

Only two things of a row count, its initial and its fault, so a row is one of a few symbols. Costs to
go from the four states, less their least, are one state of a deterministic automaton; such vectors
are numbered as they turn up and the step that a symbol makes is kept in a transition table, so nearly
all rows are one look-up. The scan runs from a conversation's last row to its first and gives costs;
the trace runs against it, from the first row on, along tight arcs only. It holds all states that the
least audit so far can be in, so that among equally cheap repairs the ASCII-least audit is found
without trying any out; its steps are kept in a table as well.

Damage and faults are Spark expressions. Rows are dealt out by conversation once; within a task they
are sorted, spilling to disk where they must, by text for repeats and by turn for the rest, and
streamed: a conversation in work holds one symbol and one step a row, and its lines, of which those
beyond ``HELD`` bytes wait in the task's spill file. SHA-256 of a repaired conversation is one chain
from its first line to its last, so one conversation can't be split over tasks: of a conversation
that held most rows, one task would stream the lines, in bounded memory but for the symbol and the
step a row, which its audit needs anyway.

Defined results: a null role or text is one space, and so is a null conv_id or turn in the checksum
that chooses the damage; null conv_ids are one conversation; null turns come first; rows of one turn
are ordered by role, then text; rows that repeat are rows of their own; an empty table gives an empty
result; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_SPACE = " \t\n\x0b\f\r"
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state behind a user's or an assistant's turn, whichever leads on, and that turn's role.
NEXT, ROLE = (USER, USER, ASSISTANT, USER), (b"user", b"user", b"assistant", b"user")
ENDS = (START, ASSISTANT)
REROLE, DELETE, INSERT, CUT_SHORT = 2, 3, 2, 1
#: Symbols: a row that must go, then 1 + 2 * initial, and 1 more if truncated.
GONE = 0
_INITIALS = {"s": 1, "u": 2, "a": 3}
_FAR = 1 << 30
#: Bytes of a conversation's lines in memory.
HELD = 32 << 20


def kept_to(initial: int, state: int) -> int | None:
    """Where a row of this initial (1 s, 2 u, 3 a, 0 other) leads if it is kept."""
    if initial == 1:
        return SYSTEM if state == START else None
    if initial == 2:
        return USER if state != USER else None
    return ASSISTANT if initial == 3 and state == USER else None


class Automaton:
    """Vectors of normalised costs to go, numbered, with tables of scan and trace steps."""

    def __init__(self) -> None:
        self.vectors: list[tuple[int, ...]] = []
        self.numbers: dict[tuple[int, ...], int] = {}
        self.steps: dict[tuple[int, int], tuple[int, int]] = {}
        self.traced: dict[tuple[frozenset, int, int, int], tuple[bytes, frozenset]] = {}
        self.ended: dict[frozenset, bytes] = {}
        base = self._inserted([0 if q in ENDS else _FAR for q in range(4)])
        self.last, self.last_cost = self._number(base)

    @staticmethod
    def _inserted(costs: list[int]) -> list[int]:
        """Least costs if any number of turns may be inserted first; two are always enough."""
        for _ in range(2):
            costs = [min(c, INSERT + costs[NEXT[q]]) for q, c in enumerate(costs)]
        return costs

    def _number(self, costs: list[int]) -> tuple[int, int]:
        least = min(costs)
        vector = tuple(c - least for c in costs)
        if vector not in self.numbers:
            self.numbers[vector] = len(self.vectors)
            self.vectors.append(vector)
        return self.numbers[vector], least

    @staticmethod
    def arcs(symbol: int, state: int) -> list[tuple[bytes, int, int]]:
        """(edit, cost, next state) of the edits that use up a row."""
        out = [(b"D", DELETE, state)]
        if symbol != GONE:
            initial, short = divmod(symbol - 1, 2)
            if (to := kept_to(initial, state)) is not None:
                out.append((b"K", CUT_SHORT * short, to))
            out.append((b"R", REROLE + CUT_SHORT * short, NEXT[state]))
        return out

    def step(self, number: int, symbol: int) -> tuple[int, int]:
        """The vector before a row, and by how much costs rise."""
        if (number, symbol) not in self.steps:
            after = self.vectors[number]
            costs = [min(cost + after[to] for _, cost, to in self.arcs(symbol, q)) for q in range(4)]
            self.steps[number, symbol] = self._number(self._inserted(costs))
        return self.steps[number, symbol]

    def trace(self, states: frozenset, before: int, symbol: int, after: int) -> tuple[bytes, frozenset]:
        """Least edits from any of ``states`` up to and with one row, and the states that they can lead to.

        ``before`` and ``after`` number the costs to go before and behind the row. An insertion uses up
        no row, so edits are taken one by one until one does.
        """
        known = (states, before, symbol, after)
        if known not in self.traced:
            here, there, rise = self.vectors[before], self.vectors[after], self.step(after, symbol)[1]
            edits = b""
            while True:
                tight = {(edit, to) for q in states for edit, cost, to in self.arcs(symbol, q) if cost + there[to] == here[q] + rise}
                waits = {NEXT[q] for q in states if INSERT + here[NEXT[q]] == here[q]}
                least = min({edit for edit, _ in tight} | ({b"I"} if waits else set()))
                edits += least
                if least != b"I":
                    break
                states = frozenset(waits)
            self.traced[known] = edits, frozenset(to for edit, to in tight if edit == least)
        return self.traced[known]

    def ending(self, states: frozenset) -> bytes:
        """Insertions behind the last row."""
        if states not in self.ended:
            here, at, edits = self.vectors[self.last], states, b""
            while not any(q in ENDS and here[q] == 0 for q in at):
                at = frozenset(NEXT[q] for q in at if INSERT + here[NEXT[q]] == here[q])
                edits += b"I"
            self.ended[states] = edits
        return self.ended[states]

    def repair(self, symbols: bytes) -> tuple[int, list[bytes]]:
        """Cost, and the edits up to and with each row and behind the last, for rows in order."""
        numbers, cost, at = [self.last], self.last_cost, self.last
        steps = self.steps
        for symbol in reversed(symbols):
            found = steps.get((at, symbol))
            at, rise = found if found else self.step(at, symbol)
            cost += rise
            numbers.append(at)
        cost += self.vectors[at][START]
        numbers.reverse()
        states, edits = frozenset([START]), []
        for k, symbol in enumerate(symbols):
            found = self.traced.get((states, numbers[k], symbol, numbers[k + 1]))
            done, states = found if found else self.trace(states, numbers[k], symbol, numbers[k + 1])
            edits.append(done)
        return cost, [*edits, self.ending(states)]


class _Conversation:
    """Rows of one conversation in order, without keeping more of them than must be kept."""

    def __init__(self, key: object) -> None:
        self.key, self.symbols, self.lines = key, bytearray(), tempfile.SpooledTemporaryFile(max_size=HELD)
        self.first = self.last = self.turn = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.before: str | None = None

    def add(self, turn: int | None, initial: str, fault: int, role: bytes, text: bytes) -> None:
        if turn is not None:
            self.first = turn if self.first is None else self.first
            self.turns += turn != self.last
            self.last = turn
        self.blank += fault == 1
        self.duplicate += fault == 2
        self.truncated += fault == 3
        if self.before is not None:
            self.illegal += self.before + initial not in ("su", "ua", "au")
        self.before = initial
        self.symbols.append(GONE if fault in (1, 2) else 1 + 2 * _INITIALS.get(initial, 0) + (fault == 3))
        for part in (role, text):
            self.lines.write(len(part).to_bytes(8, "little"))
            self.lines.write(part)

    def _rows(self) -> Iterator[tuple[bytes, bytes]]:
        self.lines.seek(0)
        take = lambda: self.lines.read(int.from_bytes(self.lines.read(8), "little"))
        for _ in self.symbols:
            yield take(), take()

    def finish(self, automaton: Automaton) -> tuple:
        cost, edits = automaton.repair(bytes(self.symbols))
        digest, state, begun = hashlib.sha256(), START, False

        def put(role: bytes, text: bytes) -> None:
            nonlocal begun
            digest.update((b"\n" if begun else b"") + role + b":")
            digest.update(text)
            begun = True

        rows = self._rows()
        for done in edits:
            for edit in done.decode():
                role, text = (b"", b"") if edit == "I" else next(rows)
                if edit == "D":
                    continue
                to = NEXT[state] if edit != "K" or role[:1] != b"s" else SYSTEM
                put(role if edit == "K" else ROLE[state], text)
                state = to
        self.lines.close()
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return (self.key, gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, b"".join(edits).decode(), digest.hexdigest())


def damaged(rows: DataFrame) -> DataFrame:
    """``rows`` as ``told`` gives them, each with the damage that the checksum of its ids chooses.

    A row is lost (it stays for its conversation's sake, marked), emptied, without its ends of sentences,
    repeated (``copy`` 1) or the user's.
    """
    ids = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind = F.pmod(F.crc32(F.concat(ids[0], F.lit(":"), ids[1]).cast("binary")), F.lit(20))
    given = rows.withColumn("kind", kind)
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("first_text", ".!?", "")).otherwise(F.col("first_text"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("first_role"))
    return given.select("conv_id", "turn", "first_role", "first_text", role.alias("role"), text.alias("text"), (F.col("kind") == 0).alias("lost"), F.explode(copies).alias("copy"))


def told(conversations: DataFrame) -> DataFrame:
    """Rows dealt out by conversation, with roles and texts that are never null, no row lost or repeated."""
    parts = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    rows = conversations.select("conv_id", "turn", role.alias("first_role"), text.alias("first_text")).repartition(parts, "conv_id")
    return rows.select("*", F.col("first_role").alias("role"), F.col("first_text").alias("text"), F.lit(False).alias("lost"), F.lit(0).alias("copy"))


def _fault(text: Column, nth: Column) -> Column:
    """0 none, 1 blank, 2 duplicate, 3 truncated: the first that is true."""
    end = F.rtrim(text, F.lit(_SPACE))
    return F.when(end == "", 1).when(nth > 1, 2).when(~F.right(end, F.lit(1)).isin(".", "!", "?"), 3).otherwise(0)


def repair(rows: DataFrame) -> DataFrame:
    """``rows`` as ``told`` gives them, damaged or not -> one row per conversation."""
    order = [F.col("turn").asc_nulls_first(), "first_role", "first_text", "copy"]
    # Both sorts are of the same tasks' rows: repeats are told by (conversation, role, text).
    same = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    nth = F.row_number().over(Window.partitionBy("conv_id", "same").orderBy("lost", *order))
    known = rows.withColumn("same", same).withColumn("nth", nth).withColumn("fault", _fault(F.col("text"), F.col("nth")))
    ordered = known.sortWithinPartitions("conv_id", "lost", *order).select(
        "conv_id", F.col("turn").cast("long").alias("turn"), "lost", F.left("role", F.lit(1)).alias("initial"),
        F.col("fault").cast("int").alias("fault"), F.col("role").cast("binary").alias("role"), F.col("text").cast("binary").alias("text"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, talk, done = Automaton(), None, []
        names = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
        table = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), kinds, strict=True)], names)
        for batch in batches:
            kinds = (batch.schema.field("conv_id").type, *[pa.int64()] * 6, pa.string(), pa.string())
            for key, turn, lost, initial, fault, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if talk is None or key != talk.key:
                    if talk is not None:
                        done.append(talk.finish(automaton))
                    talk = _Conversation(key)
                if not lost:
                    talk.add(turn, initial, fault, role, text)
            if done:
                yield table()
                done = []
        if talk is not None:
            done = [talk.finish(automaton)]
            yield table()

    kind = rows.schema["conv_id"].dataType.simpleString()
    return ordered.mapInArrow(
        run, f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    )


def conversation_repair(conversations: DataFrame, damage: bool = True) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of every conversation."""
    rows = told(conversations)
    return repair(damaged(rows) if damage else rows)
