"""Conversation structure repair by depth-first branch-and-bound.

A conversation should read ``(s?(ua)+)?``: maybe a system turn, then user and assistant
turns in pairs.  Each turn is kept, reroled or deleted and empty turns may be inserted;
the cheapest edits win, and of equally cheap ones the ASCII-least string of their initials
(the audit).  The search walks nodes (turns consumed, last role) with an explicit stack.
A suffix lower bound (the cost to go, audits aside, by one backward pass) cuts what can't
reach the incumbent (cost, audit), and a table of each node's best (cost, audit) cuts
dominated prefixes, until the stack is empty and the incumbent proved.

Two passes keep memory bounded.  :func:`plans` streams one light row a turn, in order, and
searches pieces of PIECE turns: for each role that a piece may end in, the best way there
from each role it may begin in, so a conversation of any length holds four prefixes.
:func:`repaired` streams the texts behind their conversation's plan.  A conversation is
read by one task in both (its edits depend on each other) but never gathered; only its
audit, a letter a turn, which is also its result, is held whole.

Defined cases: a null text is blank, so its turn goes; a null or empty role, or one of
another initial, can only be reroled or deleted; null turns come first; turns that tie stand by role,
then by the text's digest; a null conv_id is a conversation; an empty table gives empty
results; a number of gaps beyond a long is the largest long; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hindcast.llm._spark import materialise

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Turns that one search covers.
PIECE = 256
BLANK, REPEATED, CUT = 1, 2, 3
LONG = 2**63 - 1

#: Last role so far; what an inserted or reroled turn then becomes, and where it leads.
START, SYSTEM, USER, ASSISTANT = range(4)
DUE = ("u", "u", "a", "u")
NEXT = (USER, USER, ASSISTANT, USER)
ENDS = frozenset((START, ASSISTANT))
ROLES = {"u": "user", "a": "assistant"}
LEGAL = frozenset(("su", "ua", "au"))


def _kept(q: int, mark: str) -> int:
    """The last role after keeping a turn of initial ``mark``, -1 if it can't stand here."""
    if mark == "s":
        return SYSTEM if q == START else -1
    return NEXT[q] if mark == DUE[q] else -1


def lower_bounds(marks: str, goals: frozenset[int]) -> list[list[float]]:
    """Least cost to go from each place and last role, audits aside, by one backward pass."""

    def inserted(to: list[float]) -> list[float]:
        for _ in range(2):  # two in a row lead to any role that can be reached
            to = [min(c, to[NEXT[q]] + INSERT) for q, c in enumerate(to)]
        return to

    bounds = [inserted([0 if q in goals else math.inf for q in range(4)])]
    for m in reversed(marks):
        after, low = bounds[-1], m.lower()
        to = [c + DELETE for c in after]
        if m != "x":
            more = TRUNCATED * (m != low)
            for q in range(4):
                kept = _kept(q, low)
                to[q] = min(to[q], more + (after[kept] if kept >= 0 else math.inf), more + after[NEXT[q]] + REROLE)
        bounds.append(inserted(to))
    return bounds[::-1]


def search(marks: str, entries: dict[int, tuple[int, str]], goals: frozenset[int]) -> tuple[int, str, int, int] | None:
    """(cost, audit, last role, entry) of the best edits of ``marks`` that end in one of ``goals``.

    A mark is a turn's initial (``o``: another), a capital if the text is truncated, ``x`` if
    it must go.  ``entries`` holds the cost and audit so far of each role it may begin in.
    """
    n, bounds = len(marks), lower_bounds(marks, goals)
    best: tuple[int, str, int, int] | None = None
    table: dict[tuple[int, int], tuple[int, str]] = {}
    stack = sorted(((cost + bounds[0][q], audit, cost, 0, q, q) for q, (cost, audit) in entries.items() if bounds[0][q] < math.inf), reverse=True)
    while stack:
        bound, audit, cost, i, q, entry = stack.pop()
        if best and (bound > best[0] or bound == best[0] and audit > best[1][: len(audit)]):
            continue
        known = table.get((i, q))
        if known and known <= (cost, audit):
            continue
        table[i, q] = (cost, audit)
        children = [("I", cost + INSERT, i, NEXT[q])]
        if i < n:
            m = marks[i]
            children.append(("D", cost + DELETE, i + 1, q))
            if m != "x":
                low = m.lower()
                more = cost + TRUNCATED * (m != low)
                to = _kept(q, low)
                if to >= 0:
                    children.append(("K", more, i + 1, to))
                children.append(("R", more + REROLE, i + 1, NEXT[q]))
        elif q in goals and (not best or (cost, audit) < best[:2]):
            best = (cost, audit, q, entry)
        stack += sorted(((c + bounds[j][p], audit + e, c, j, p, entry) for e, c, j, p in children if bounds[j][p] < math.inf), reverse=True)
    return best


@lru_cache(4096)
def _whole(marks: str) -> tuple[int, str]:
    return search(marks, {START: (0, "")}, ENDS)[:2]


def shortened(keys: list[str]) -> list[str]:
    """Short keys that order all continuations as the given distinct ones do."""
    common = len(os.path.commonprefix(keys))
    keys = [k[common:] for k in keys]
    order = sorted(keys)
    if any(b.startswith(a) for a, b in zip(order, order[1:])):
        return keys
    return [chr(ord("A") + order.index(k)) for k in keys]


class Plan:
    """The search over one conversation, a turn at a time."""

    def __init__(self, piece: int = PIECE):
        self.piece, self.marks = piece, ""
        self.entries: dict[int, tuple[int, str]] = {START: (0, "")}
        self.paths: dict[int, tuple | None] = {START: None}  # (path before, audit of the piece)

    def add(self, mark: str) -> None:
        if len(self.marks) >= self.piece:
            found = {q: x for q in range(4) if (x := search(self.marks, self.entries, frozenset((q,))))}
            self._go(found)
        self.marks += mark

    def _go(self, found: dict[int, tuple[int, str, int, int]]) -> None:
        # within the best edits of all, an audit's own part follows the key of its entry
        self.paths = {q: (self.paths[e], audit[len(self.entries[e][1]) :]) for q, (_, audit, _, e) in found.items()}
        self.entries = {q: (x[0], k) for (q, x), k in zip(found.items(), shortened([x[1] for x in found.values()]))}
        self.marks = ""

    def end(self) -> tuple[int, str]:
        """Cost and audit of the cheapest repair."""
        if self.paths.get(START, ()) is None:
            return _whole(self.marks)
        cost, audit, _, entry = search(self.marks, self.entries, ENDS)
        parts, path = [audit[len(self.entries[entry][1]) :]], self.paths[entry]
        while path is not None:
            path, part = path
            parts.append(part)
        return cost, "".join(reversed(parts))


def _ordered_by(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def with_faults(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, digest, nth of its like, mark and fault (0, 1 blank, 2 duplicate, 3 truncated) of each turn."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    blank = ~text.rlike(r"[^\x20\x09-\x0D]")
    ends = text.rlike(r"[.!?][\x20\x09-\x0D]*\z")
    initial = F.left(role, F.lit(1))
    rows = turns.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), _ordered_by(F.col("text")).alias("digest"),
        F.when(initial.isin("s", "u", "a"), initial).otherwise("o").alias("mark"), blank.alias("blank"), ends.alias("ends"),
    ).repartition("conv_id")
    # a window by more than the conversation needs no other exchange
    nth = F.row_number().over(Window.partitionBy("conv_id", "role", "digest").orderBy("turn"))
    fault = F.when(F.col("blank"), BLANK).when(F.col("nth") > 1, REPEATED).when(~F.col("ends"), CUT).otherwise(0)
    return rows.withColumn("nth", nth).select("conv_id", "turn", "role", "digest", "nth", "mark", fault.alias("fault"))


PLANS = "conv_id {id}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def plans(turns: DataFrame, piece: int = PIECE) -> DataFrame:
    """One row a conversation: its faults, and cost and audit of its repair."""
    schema = PLANS.format(id=turns.schema["conv_id"].dataType.simpleString())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, plan, state = None, None, []

        def row() -> tuple:
            low, high, distinct, faults, illegal = state[0], state[1], state[2], state[3], state[4]
            gaps = 0 if low is None else min(LONG, high - low + 1 - distinct)
            return (now, gaps, faults[BLANK], faults[REPEATED], faults[CUT], illegal, *plan.end())

        for batch in batches:
            types = batch.schema
            out = []
            for conv, turn, mark, fault in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if plan is None or conv != now:
                    if plan is not None:
                        out.append(row())
                    now, plan, state = conv, Plan(piece), [None, None, 0, [0] * 4, 0, None]
                if turn is not None:
                    if turn != state[1]:
                        state[2] += 1
                    state[0], state[1] = turn if state[0] is None else state[0], turn
                state[3][fault] += 1
                if state[5] is not None and state[5] + mark not in LEGAL:
                    state[4] += 1
                state[5] = mark
                plan.add("x" if fault in (BLANK, REPEATED) else mark.upper() if fault == CUT else mark)
            yield _rows(out, types.field(0).type)
        if plan is not None:
            yield _rows([row()], types.field(0).type)

    def _rows(rows: list[tuple], key: pa.DataType) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [()] * 8
        kinds = [key, *[pa.int64()] * 6, pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], [f.split()[0] for f in PLANS.split(", ")])

    ordered = with_faults(turns).sortWithinPartitions("conv_id", "turn", "role", "digest", "nth")
    return ordered.select("conv_id", "turn", "mark", "fault").mapInArrow(run, schema)


REPAIRED = "conv_id {id}, place long, edit string, turn long, role string, text string"


def repaired(turns: DataFrame, planned: DataFrame) -> DataFrame:
    """The turns of each conversation after its edits, in order, a conversation's rows together.

    ``edit`` is K, R, D or I; a deleted turn is there with its old role and text.
    """
    key = turns.schema["conv_id"].dataType.simpleString()
    rows = turns.select(
        "conv_id", F.lit(1).alias("head"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"),
        _ordered_by(F.col("text")).alias("digest"), F.coalesce("text", F.lit("")).alias("text"),
    )
    none = lambda t: F.lit(None).cast(t)
    heads = planned.select("conv_id", F.lit(0).alias("head"), none("long").alias("turn"), F.lit("").alias("role"), none("binary").alias("digest"), F.col("audit").alias("text"))
    both = rows.unionByName(heads).repartition("conv_id").sortWithinPartitions("conv_id", "head", "turn", "role", "digest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        audit, place, due = "", 0, "u"
        for batch in batches:
            convs, heads, turns_, roles, texts = (batch.column(i).to_pylist() for i in range(5))
            out: list[tuple] = []
            for conv, head, turn, role, text in zip(convs, heads, turns_, roles, texts):
                if head:
                    edit = audit[place]
                    if edit == "R":
                        role = ROLES[due]
                    if edit != "D":
                        due = "a" if role[0] == "u" else "u"
                    out.append((conv, place, edit, turn, role, text))
                    place += 1
                else:
                    audit, place, due = text, 0, "u"
                while place < len(audit) and audit[place] == "I":  # before the next turn, or after the last
                    out.append((conv, place, "I", None, ROLES[due], ""))
                    due = "a" if due == "u" else "u"
                    place += 1
            columns = list(zip(*out)) or [()] * 6
            kinds = [batch.schema.field(0).type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], [f.split()[0] for f in REPAIRED.split(", ")])

    return both.select("conv_id", "head", "turn", "role", "text").mapInArrow(run, REPAIRED.format(id=key))


def repair(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(plans, repaired turns) of conversations; plans are written once, as both use them."""
    planned = materialise(plans(turns), "repair-plans")
    return planned, repaired(turns, planned)


DIGESTS = "conv_id {id}, repaired_sha256 string"


def digests(rows: DataFrame) -> DataFrame:
    """SHA-256 of each repaired conversation (``role:text``, newline-joined); ``rows`` as
    :func:`repaired` gives them, read as a stream that holds one hash state."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, begun = None, None, False
        names = [f.split()[0] for f in DIGESTS.split(", ")]
        kind = None
        for batch in batches:
            kind, out = batch.schema.field(0).type, []
            for conv, place, edit, role, text in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if place == 0:
                    if state is not None:
                        out.append((now, state.hexdigest()))
                    now, state, begun = conv, hashlib.sha256(), False
                if edit != "D":
                    state.update(f"{chr(10) * begun}{role}:{text}".encode())
                    begun = True
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], kind), pa.array([x[1] for x in out], pa.string())], names)
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], kind), pa.array([state.hexdigest()], pa.string())], names)

    narrow = rows.select("conv_id", "place", "edit", "role", "text")
    return narrow.mapInArrow(run, DIGESTS.format(id=rows.schema["conv_id"].dataType.simpleString()))
