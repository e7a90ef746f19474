"""Conversation repair against exhaustive shortest paths and plain loops."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from hindcast.llm import queries, repair

STEPS = {("0", "s"): "1", ("0", "u"): "2", ("1", "u"): "2", ("2", "a"): "3", ("3", "u"): "2"}
KINDS = ["suaoSUAOx", "ua", "uaUA", "o", "uax", "su", "us", "uuuao", "sS", "x"]


def cheapest(marks: str) -> tuple[int, str]:
    """Uniform-cost search, ties by audit."""
    heap, done = [(0, "", 0, "0")], set()
    while True:
        cost, audit, i, q = heapq.heappop(heap)
        if (i, q) in done:
            continue
        done.add((i, q))
        if i == len(marks) and q in "03":
            return cost, audit
        moves = [(3, "I", i, STEPS.get((q, r))) for r in "ua"]
        if i < len(marks):
            m = marks[i]
            moves.append((4, "D", i + 1, q))
            if m != "x":
                more = 3 * m.isupper()
                moves.append((more, "K", i + 1, STEPS.get((q, m.lower()))))
                moves += [(3 + more, "R", i + 1, STEPS.get((q, r))) for r in "ua"]
        for c, e, j, to in moves:
            if to:
                heapq.heappush(heap, (cost + c, audit + e, j, to))


def planned(marks: str, piece: int) -> tuple[int, str]:
    plan = repair.Plan(piece)
    for m in marks:
        plan.add(m)
    return plan.end()


def test_search_is_the_cheapest_and_least():
    rng = random.Random(3)
    for n in [*range(12), 60]:
        for _ in range(30):
            marks = "".join(rng.choice(rng.choice(KINDS)) for _ in range(n))
            assert {planned(marks, p) for p in (1, 2, 3, 7, 100)} == {cheapest(marks)}, marks


def test_long_conversations_take_linear_work():
    for kind in KINDS:
        rng = random.Random(kind)
        marks = "".join(rng.choice(kind) for _ in range(3000))
        cost, audit = planned(marks, 256)
        assert len(audit.replace("I", "")) == 3000 and cost == planned(marks, 64)[0]


def test_shortened_keys_keep_the_order():
    rng = random.Random(8)
    for _ in range(500):
        keys = list({"".join(rng.choice("DIK") for _ in range(rng.randrange(6))) for _ in range(4)})
        short = repair.shortened(keys)
        for x, y in [("", ""), ("D", "K"), ("K", "D"), ("IK", "K"), ("K", "IK")]:
            for a, b in zip(range(len(keys)), range(1, len(keys))):
                if keys[a] + x != keys[b] + y:
                    assert (keys[a] + x < keys[b] + y) == (short[a] + x < short[b] + y)


def loop(rows):
    """{conv_id: result} of rows (conv_id, turn, role, text) after their damage."""
    out = {}
    for conv in {r[0] for r in rows}:
        kept = []
        for _, turn, role, text in (r for r in rows if r[0] == conv):
            hit = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            role, text = " " if role is None else role, " " if text is None else text
            text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
            if hit:
                kept += [(turn, "user" if hit == 4 else role, text)] * (2 if hit == 3 else 1)
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        seen, marks, faults, illegal = set(), "", [0, 0, 0], 0
        for i, (_, role, text) in enumerate(kept):
            body = text.rstrip("\t\n\x0b\x0c\r ")
            fault = 0 if not body else 1 if (role, text) in seen else 2 if body[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                faults[fault] += 1
            if i and kept[i - 1][1][:1] + role[:1] not in ("su", "ua", "au"):
                illegal += 1
            mark = role[:1] if role[:1] in ("s", "u", "a") else "o"
            marks += "x" if fault in (0, 1) else mark.upper() if fault == 2 else mark
        cost, audit = cheapest(marks)
        said, at, due = [], iter(kept), "user"
        for e in audit:
            role, text = (None, "") if e == "I" else next(at)[1:]
            if e == "D":
                continue
            role = role if e == "K" else due
            due = "assistant" if role[0] == "u" else "user"
            said.append(f"{role}:{text}")
        turns = {t for t, _, _ in kept if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = (min(gaps, 2**63 - 1), *faults, illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest())
    return out


def collected(df):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in df.collect()}


@pytest.fixture
def run(spark, tmp_path):
    def go(rows, schema="conv_id long, turn long, role string, text string, _conv string, nth int, head int, digest string"):
        full = [(*r, "z", 1, 2, None) for r in rows]
        spark.createDataFrame(full, schema).repartition(3).write.parquet(str(tmp_path / "conversations.parquet"))
        return queries.op11_conversation_repair(spark, str(tmp_path))

    return go


def test_query_equals_the_loop(run):
    rng = random.Random(5)
    roles, texts = ["user", "assistant", "system", "tool", "", None, "u"], ["Hi.", "no end", "", " \t\n", None, "Why? ", "é！", "ok. ", "x" * 70_000 + "!"]
    rows = [(rng.choice([None, 1, 2, 3, 4, -5]), rng.choice([None, *range(12)]), rng.choice(roles), rng.choice(texts)) for _ in range(150)]
    rows += [(9, t, "user" if t % 2 == 0 else "assistant", "All is well.") for t in range(700)]  # longer than a piece
    rows += [(10, 0, "user", "extreme."), (10, 2**63 - 1, "assistant", "far."), (10, -(2**63), "system", "near.")]
    dropped = next(i for i in range(100, 10**6) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    rows.append((dropped, 0, "user", "gone"))
    assert collected(run(rows)) == loop(rows)


def test_empty_table(run):
    assert run([]).count() == 0


def test_repaired_turns_have_the_grammar(spark):
    rows = [(c, t, ["user", "assistant", "system", "tool"][(c * t + t) % 4], f"text {t}." if t % 5 else "cut") for c in range(20) for t in range(c)]
    plans, turns = repair.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    kept = turns.where("edit <> 'D'").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", F.left("role", F.lit(1)).alias("r")))), lambda x: x["r"]), "").alias("said"))
    for r in kept.collect():
        assert re.fullmatch("(s?(ua)+)?", r.said)
    audits = {r.conv_id: r.audit for r in plans.collect()}
    edits = turns.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "edit"))), lambda x: x["edit"]), "").alias("edits"))
    assert {r.conv_id: r.edits for r in edits.collect()} == audits
