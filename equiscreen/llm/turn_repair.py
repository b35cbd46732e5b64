"""Repairing the structure of conversations by a square-root checkpointed DP.

A conversation's roles shall read ``(s?(ua)+)?`` by their initials.  Rows are kept, given another role, deleted, or empty turns
are inserted; the cheapest edits are found backwards over four states (nothing yet, after s, after u, after a).
Vectors of the four states' costs are stored at every square root of the rows only; walking forward, the rows up to the next
checkpoint are computed again, and of the edits that are tight (their cost is what the vectors differ by) the one with the
least letter is taken, which gives the ASCII-least of the cheapest edits.

Scale: equal rows of a conversation are one row with a count.  Rows are sorted by ranges of (conv_id, turn, role, text), so that
a conversation with a third of all rows goes over many tasks.  A task cuts conversations into blocks of bounded rows and
bytes.  One that lies in one block within a task is repaired there.  Of the others, each block gives what it
costs to come from each state to each other; a conversation's blocks meet as 16 numbers each, which give the vector at each
block's end, the distributed checkpoints.  Then its blocks stream in order through one task, as SHA-256 of the repaired text is
taken in that order; the task holds one block and the letters of the answer.

Defined results: nulls in conv_id, turn and role count as one blank where they are spelled, a null text is one blank; a null
conv_id is a conversation of its own; turns are ordered nulls first, ties by role, then text, after the damage; repeated rows are
rows; very long texts count whole; an empty table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, materialise, maybe_broadcast, small_batches, tidy

#: Rows and bytes of texts of a block of a conversation, about.
BLOCK_ROWS, BLOCK_BYTES = 1024, 1 << 20
#: States: nothing yet, after a system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
#: What an inserted or another role leads to, by state, and what a kept row leads to, by state and initial.
NEXT = (USER, USER, ASSISTANT, USER)
KEPT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: A way that does not exist.
NEVER = 1 << 60
#: Costs from each state where no row is left.
END = [0, 2 * INSERT, INSERT, 0]

#: Initials of neighbours that may be.
LEGAL = ("su", "ua", "au")

FACTS = "from_turn long, to_turn long, n_turns long, blank long, duplicate long, truncated long, illegal long, first_initial string, last_initial string"
BLOCK = f"conv_id long, part int, block int, whole boolean, {FACTS}, rows array<struct<role:string,text:string,kind:string,copies:bigint>>, ways array<bigint>, cost long, audit string, repaired_sha256 string"
ROWS = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string()), ("kind", pa.string()), ("copies", pa.int64())]))
VECTOR = "conv_id long, part int, block int, after array<bigint>, final boolean"
OUT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def damage(conversations: DataFrame) -> DataFrame:
    """Rows with ``copies``, damaged by crc32(conv_id:turn) % 20; dropped rows stay, marked, without text."""
    spelled = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), (F.crc32(spelled.cast("binary")) % 20).alias("harm"))
    harm = F.col("harm")
    text = F.when(harm <= 1, "").when(harm == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(harm == 0, "").when(harm == 4, "user").otherwise(F.col("role"))
    rows = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (harm == 0).alias("dropped"), F.when(harm == 3, 2).otherwise(1).alias("n"))
    return as_given(rows)


def as_given(rows: DataFrame) -> DataFrame:
    """Equal rows as one, with ``copies``, of rows (conv_id, turn, role, text, dropped, n)."""
    return rows.groupBy("conv_id", "turn", "role", "text", "dropped").agg(F.sum("n").alias("copies"))


def firsts(rows: DataFrame) -> DataFrame:
    """``rows`` with ``first``: no earlier row of the conversation has this role and text."""
    rows = materialise(rows.withColumn("key", F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256)), "repair-rows")
    at = F.struct(F.col("turn").isNotNull().alias("some"), "turn")
    repeated = rows.where(~F.col("dropped")).groupBy("conv_id", "key").agg(F.min(at).alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("conv_id").alias("c"), F.col("key").alias("k"), "least")
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("key") == F.col("k"))
    first = F.when(F.col("least").isNull(), True).otherwise((F.col("least.some") == F.col("turn").isNotNull()) & F.col("least.turn").eqNullSafe(F.col("turn")))
    return rows.join(maybe_broadcast(repeated), same, "left").select("conv_id", "turn", "role", "text", "copies", first.alias("first"), "dropped")


def kind(role: str, text: str, first: bool) -> str:
    """A row's first fault: b(lank), d(uplicate), t(runcated), or none of these."""
    last = text.rstrip(" \t\n\v\f\r")[-1:]
    return "b" if not last else "d" if not first else "" if last in ".!?" else "t"


def step(after: list[int], initial: str, fault: str, copies: int) -> list[int]:
    """Costs from each state before a row, insertions before it included, from those after it."""
    if fault in ("b", "d"):  # all copies go; what is inserted before or after them costs the same
        here = [v + DELETE * copies for v in after]
    else:
        more = TRUNCATED if fault == "t" else 0
        here = []
        for s in range(4):
            kept = KEPT[s].get(initial)
            here.append(min(DELETE + after[s], REROLE + more + after[NEXT[s]], NEVER if kept is None else more + after[kept]))
    for _ in range(2):
        for s in range(4):
            here[s] = min(here[s], INSERT + here[NEXT[s]])
    return here


def tight(rows: list[tuple[str, str, int]], after: list[int], state: int, last: bool) -> tuple[str, int]:
    """The least of the cheapest edits of ``rows`` (initial, fault, copies) from ``state``, and the state that they lead to.

    ``after`` are the costs behind the rows; with ``last``, the turns that are missing there are inserted too.
    """
    n = len(rows)
    every = max(1, isqrt(n))
    checkpoints, costs = {n: after}, after
    for i in range(n - 1, -1, -1):
        costs = step(costs, *rows[i])
        if i % every == 0:
            checkpoints[i] = costs
    out = []
    for a in range(0, n, every):
        z = min(a + every, n)
        costs = {z: checkpoints[z]}
        for i in range(z - 1, a - 1, -1):
            costs[i] = step(costs[i + 1], *rows[i])
        for i in range(a, z):
            initial, fault, copies = rows[i]
            here, behind = costs[i], costs[i + 1]
            must = fault in ("b", "d")
            more = TRUNCATED if fault == "t" else 0
            while True:
                value = here[state]
                if value == DELETE * copies + behind[state]:
                    out.append("D" * copies)
                    break
                if value == INSERT + here[NEXT[state]]:
                    out.append("I")
                    state = NEXT[state]
                    continue
                kept = KEPT[state].get(initial)
                if not must and kept is not None and value == more + behind[kept]:
                    out.append("K")
                    state = kept
                else:
                    out.append("R")
                    state = NEXT[state]
                break
    while last and END[state]:
        out.append("I")
        state = NEXT[state]
    return "".join(out), state


def ways(rows: list[tuple[str, str, int]]) -> list[int]:
    """What the rows cost from each state to each other: 16 numbers."""
    out = [[NEVER] * 4 for _ in range(4)]
    for z in range(4):
        costs = [NEVER] * 4
        costs[z] = 0
        for row in reversed(rows):
            costs = [min(c, NEVER) for c in step(costs, *row)]
        for a in range(4):
            out[a][z] = costs[a]
    return sum(out, [])


def apply(h, audit: str, rows: list[tuple[str, str, str, int]], state: int, begun: bool) -> bool:
    """Hashes the repaired turns of ``rows`` (role, text, kind, copies) by ``audit``; ``begun``: there were turns before."""
    at, left = 0, rows[0][3] if rows else 0
    for letter in audit:
        role = None
        if letter == "I":
            state, text = NEXT[state], ""
            role = "user" if state == USER else "assistant"
        else:
            while not left:
                at += 1
                left = rows[at][3]
            left -= 1
            if letter == "K":
                role, text = rows[at][0], rows[at][1]
                state = KEPT[state][role[:1]]
            elif letter == "R":
                state, text = NEXT[state], rows[at][1]
                role = "user" if state == USER else "assistant"
        if role is not None:
            h.update(b"\n" * begun + role.encode() + b":" + text.encode())
            begun = True
    return begun


def codes(rows: list[tuple[str, str, str, int]]) -> list[tuple[str, str, int]]:
    return [(role[:1], fault, copies) for role, _, fault, copies in rows]


class Block:
    """Rows of a conversation, one after the other, and what is known of them."""

    def __init__(self, conv: int | None, number: int):
        self.conv, self.number, self.rows, self.bytes = conv, number, [], 0
        self.from_turn = self.to_turn = self.last = self.first = None
        self.n_turns = self.blank = self.duplicate = self.truncated = self.illegal = 0

    def add(self, turn: int | None, role: str, text: str, copies: int, first: bool, dropped: bool) -> None:
        if dropped:
            return
        if turn is not None:
            self.n_turns += turn != self.to_turn
            self.from_turn = turn if self.from_turn is None else self.from_turn
            self.to_turn = turn
        given = [(kind(role, text, first), 1), (kind(role, text, False), copies - 1)]
        if given[0][0] == given[1][0]:
            given = [(given[0][0], copies)]
        for fault, n in given:
            if n:
                self.rows.append((role, text if fault not in ("b", "d") else "", fault, n))  # those rows go
                self.blank += n * (fault == "b")
                self.duplicate += n * (fault == "d")
                self.truncated += n * (fault == "t")
        self.bytes += len(text)
        initial = role[:1]
        if self.last is not None:
            self.illegal += self.last + initial not in LEGAL
        self.illegal += copies - 1
        self.last = initial
        self.first = initial if self.first is None else self.first

    def record(self, part: int, whole: bool) -> tuple:
        facts = (self.from_turn, self.to_turn, self.n_turns, self.blank, self.duplicate, self.truncated, self.illegal, self.first, self.last)
        if not whole:
            rows = [dict(zip(("role", "text", "kind", "copies"), r, strict=True)) for r in self.rows]
            return (self.conv, part, self.number, False, *facts, rows, ways(codes(self.rows)), None, None, None)
        audit, _ = tight(codes(self.rows), END, START, True)
        costs = END
        for row in reversed(codes(self.rows)):
            costs = step(costs, *row)
        h = hashlib.sha256()
        apply(h, audit, self.rows, START, False)
        return (self.conv, part, self.number, True, *facts, None, None, costs[START], audit, h.hexdigest())


def blocks(rows: DataFrame, block_rows: int = BLOCK_ROWS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Sorted rows as blocks, ``BLOCK``.  A conversation that may go on in another task is never ``whole``."""
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, now, one, out = TaskContext.get().partitionId(), None, True, []
        for b in batches:
            for conv, *row in zip(*(b.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "copies", "first", "dropped")), strict=True):
                if now is None or conv != now.conv:
                    if now is not None:
                        out.append(now.record(part, one and now.number == 0))
                        one = True
                    else:
                        one = False  # the first conversation of a task may have begun in another
                    now = Block(conv, 0)
                elif len(now.rows) >= block_rows or now.bytes >= block_bytes:
                    out.append(now.record(part, False))
                    now = Block(conv, now.number + 1)
                now.add(*row)
                if len(out) >= 256:
                    yield batch_of(out, BLOCK, rows=ROWS)
                    out = []
        if now is not None:
            out.append(now.record(part, False))  # and its last one may go on in another
        if out:
            yield batch_of(out, BLOCK, rows=ROWS)

    return rows.mapInArrow(run, BLOCK)


def more_facts(sofar: list, piece: dict) -> list:
    """One conversation's facts, as ``FACTS`` has them, with those of its next block."""
    low, high, n_turns, blank, duplicate, truncated, illegal, first, last = sofar
    if piece["from_turn"] is not None:
        n_turns += piece["n_turns"] - (piece["from_turn"] == high)
        low, high = piece["from_turn"] if low is None else low, piece["to_turn"]
    illegal += piece["illegal"]
    if piece["first_initial"] is not None:
        illegal += last is not None and last + piece["first_initial"] not in LEGAL
        first, last = piece["first_initial"] if first is None else first, piece["last_initial"]
    return [low, high, n_turns, blank + piece["blank"], duplicate + piece["duplicate"], truncated + piece["truncated"], illegal, first, last]


def missing(low: int | None, high: int | None, n_turns: int) -> int:
    """Turns that are missing between the least and the greatest."""
    return 0 if low is None else high - low + 1 - n_turns


def joined(cut: DataFrame) -> DataFrame:
    """The conversations that are in several blocks, or at a task's border, as ``OUT``."""

    @tidy
    def backward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        costs, now, final = END, None, True  # blocks come by conversation, the last one first
        for b in batches:
            out = []
            for conv, part, block, w in zip(*(b.column(c).to_pylist() for c in ("conv_id", "part", "block", "ways")), strict=True):
                if final or conv != now:
                    costs, now, final = END, conv, True
                out.append((conv, part, block, costs, final))
                costs = [min(min(w[4 * a + z] + costs[z] for z in range(4)), NEVER) for a in range(4)]
                final = False
            yield batch_of(out, VECTOR)

    @tidy
    def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = None
        for b in batches:
            for i in range(b.num_rows):  # a block at a time
                r = b.slice(i, 1).to_pylist()[0]
                if h is None:
                    h, state, begun, audit, cost, facts = hashlib.sha256(), START, False, [], 0, [None, None, 0, 0, 0, 0, 0, None, None]
                turns = [(x["role"], x["text"], x["kind"], x["copies"]) for x in r["rows"]]
                letters, after = tight(codes(turns), r["after"], state, r["final"])
                begun = apply(h, letters, turns, state, begun)
                cost, state, facts = cost + spent(letters, turns), after, more_facts(facts, r)
                audit.append(letters)
                if r["final"]:
                    yield batch_of([(r["conv_id"], missing(*facts[:3]), *facts[3:7], cost, "".join(audit), h.hexdigest())], OUT)
                    h = None

    ends = cut.select("conv_id", "part", "block", "ways").repartition("conv_id").sortWithinPartitions("conv_id", F.desc("part"), F.desc("block")).mapInArrow(backward, VECTOR)
    same = F.col("l.conv_id").eqNullSafe(F.col("r.conv_id")) & (F.col("l.part") == F.col("r.part")) & (F.col("l.block") == F.col("r.block"))
    rows = cut.drop("ways", "cost", "audit", "repaired_sha256", "whole").alias("l").join(ends.alias("r"), same).select("l.*", "r.after", "r.final")
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "part", "block").mapInArrow(forward, OUT)


def spent(letters: str, rows: list[tuple[str, str, str, int]]) -> int:
    """The cost of edits."""
    cost = letters.count("D") * DELETE + letters.count("I") * INSERT + letters.count("R") * REROLE
    at, left = 0, rows[0][3] if rows else 0
    for letter in letters.replace("I", ""):
        while not left:
            at += 1
            left = rows[at][3]
        left -= 1
        cost += TRUNCATED * (letter != "D" and rows[at][2] == "t")
    return cost


def repair(rows: DataFrame, block_rows: int = BLOCK_ROWS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``OUT`` for every conversation of ``rows`` (conv_id, turn, role, text, dropped, copies, as ``as_given`` gives them)."""
    small_batches(rows.sparkSession)
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "text"]
    ranged = firsts(rows).repartitionByRange(*order).sortWithinPartitions(*order)
    made = materialise(blocks(ranged, block_rows, block_bytes), "repair-blocks")
    done = made.where("whole").select("conv_id", F.coalesce(F.col("to_turn") - F.col("from_turn") + 1 - F.col("n_turns"), F.lit(0)).alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    return done.unionByName(joined(made.where(~F.col("whole"))))


def report(conversations: DataFrame) -> DataFrame:
    """The contract's row for every conversation, after the damage that it states."""
    return repair(damage(conversations))
