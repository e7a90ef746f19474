"""Chat formatting by schema fingerprints.

A record of any layout is JSON.  Its fingerprint is a hash of its sorted nested
field paths (array elements as ``[]``); a declarative mapping says which paths hold
prompts, instructions or messages and how their roles are named.  The first record
of a fingerprint selects the mapping whose required paths it has, the others reuse
the choice.  Canonical turns are rows, so no conversation has to fit into a row.

The template marks turns with control strings.  Inside a role or a text a
backslash is doubled and every control string gets one after its first character,
which ``unescape`` takes back.

Defined cases: null or absent text is empty, null roles are empty; records that no
mapping covers (and JSON that is broken or nested too deep to decode) give no turns
and a row in ``unmapped``; half a surrogate pair in a text becomes U+FFFD; turns that tie stand in the order of role and text, repeated rows stay repeated; a null
conversation id is a conversation of its own; an empty table gives an empty
result; other columns and unknown fields are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# -- layouts ------------------------------------------------------------------


@dataclass(frozen=True)
class Mapping:
    """How one layout becomes turns.

    Either ``items`` names a list of messages, and ``role`` and ``text`` are paths
    inside one, or ``fields`` lists (path, role) pairs of whole-record turns; a pair
    whose path is absent or empty is left out when ``optional`` names it.
    """

    name: str
    requires: tuple[str, ...]
    items: str | None = None
    role: str = ""
    text: str = ""
    fields: tuple[tuple[str, str], ...] = ()
    optional: tuple[str, ...] = ()
    roles: tuple[tuple[str, str], ...] = ()


#: In order: the first whose required paths a record has is taken.
MAPPINGS = (
    Mapping("messages", ("messages", "messages[].content", "messages[].role"), "messages", "role", "content"),
    Mapping("share", ("conversations", "conversations[].from", "conversations[].value"), "conversations", "from", "value", roles=(("human", "user"), ("gpt", "assistant"))),
    Mapping("turns", ("turns", "turns[].role", "turns[].text"), "turns", "role", "text"),
    Mapping("instruction", ("instruction", "output"), fields=(("system", "system"), ("instruction", "user"), ("input", "user"), ("output", "assistant")), optional=("system", "input")),
    Mapping("prompt_response", ("prompt", "response"), fields=(("system", "system"), ("prompt", "user"), ("response", "assistant")), optional=("system",)),
    Mapping("prompt_completion", ("completion", "prompt"), fields=(("system", "system"), ("prompt", "user"), ("completion", "assistant")), optional=("system",)),
    Mapping("question_answer", ("answer", "question"), fields=(("context", "system"), ("question", "user"), ("answer", "assistant")), optional=("context",)),
    Mapping("one_message", ("message.author.role", "message.content"), items="", role="message.author.role", text="message.content"),
    Mapping("one_content", ("content", "role"), items="", role="role", text="content"),
    Mapping("one_turn", ("role", "text"), items="", role="role", text="text"),
)


def paths(value) -> set[str]:
    """Nested field paths of a decoded record."""
    found: set[str] = set()
    todo = [(value, "")]
    while todo:
        value, prefix = todo.pop()
        if isinstance(value, dict):
            for k, v in value.items():
                at = f"{prefix}.{k}" if prefix else k
                found.add(at)
                todo.append((v, at))
        elif isinstance(value, list):
            todo += [(v, f"{prefix}[]") for v in value if isinstance(v, (dict, list))]
    return found


def fingerprint(value) -> str:
    """Hash of the sorted paths."""
    return hashlib.blake2b("\n".join(sorted(paths(value))).encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()


def select_mapping(value, mappings: tuple[Mapping, ...] = MAPPINGS) -> Mapping | None:
    have = paths(value)
    return next((m for m in mappings if have.issuperset(m.requires)), None)


def _get(value, path: str):
    for key in path.split("."):
        if not isinstance(value, dict):
            return None
        value = value.get(key)
    return value


def _text(value) -> str:
    """A text, or the joined texts of a list of content parts."""
    if value is None:
        return ""
    if isinstance(value, str):
        return value
    if isinstance(value, list):
        return "".join(_text(p.get("text") if isinstance(p, dict) else p) for p in value)
    return json.dumps(value, ensure_ascii=False, sort_keys=True)


def canonical(value, mapping: Mapping) -> list[tuple[str, str]]:
    """(role, text) turns of a record under a mapping."""
    named = dict(mapping.roles)
    if mapping.items is None:
        return [(role, _text(_get(value, p))) for p, role in mapping.fields if p not in mapping.optional or _text(_get(value, p))]
    items = _get(value, mapping.items) or [] if mapping.items else [value]
    turns = [(_text(_get(x, mapping.role)), _text(_get(x, mapping.text))) for x in items if isinstance(x, dict)]
    return [(named.get(r, r), t) for r, t in turns]


_TYPES = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    """Rows as a batch; whole numbers stay exact beside nulls."""
    fields = [c.split() for c in schema.split(", ")]
    columns = list(zip(*rows)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, _TYPES[t]) for c, (_, t) in zip(columns, fields)], [n for n, _ in fields])


def _whole(text: str) -> str:
    """A text as UTF-8 can hold it: halves of a surrogate pair become U+FFFD."""
    return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


TURNS = "conv_id long, turn long, item int, role string, text string, layout string, schema_fingerprint string"


def to_turns(records: DataFrame, record: str = "record", conv_id: str = "conv_id", turn: str = "turn", mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """Canonical turns of JSON records; a record without a mapping gives one row of null layout and item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen: dict[str, Mapping | None] = {}
        for batch in batches:
            rows = []
            for conv, at, raw in zip(*(c.to_pylist() for c in batch.columns)):
                try:
                    value = json.loads(raw) if raw is not None else None
                    mark = fingerprint(value)
                    if mark not in chosen:
                        chosen[mark] = select_mapping(value, mappings)
                    said = canonical(value, chosen[mark]) if chosen[mark] else None
                except (ValueError, RecursionError):  # no JSON, or nested too deep to be a conversation
                    mark, said = fingerprint(None), None
                if said is None:
                    rows.append((conv, at, None, None, None, None, mark))
                else:
                    rows += [(conv, at, i, _whole(r), _whole(t), chosen[mark].name, mark) for i, (r, t) in enumerate(said)]
            yield _batch(rows, TURNS)

    narrow = records.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.col(record).alias("record"))
    return narrow.mapInArrow(run, TURNS)


def unmapped(turns: DataFrame) -> DataFrame:
    """How many records of each fingerprint no mapping covers."""
    return turns.where("layout is null").groupBy("schema_fingerprint").agg(F.count(F.lit(1)).alias("records"))


# -- template -----------------------------------------------------------------

#: Control strings that texts must not be able to forge.
START, ROLE_END, TURN_END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
CONTROLS = (START, ROLE_END, TURN_END, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
LOSS_ROLES = ("assistant",)

_control = re.compile("(?=" + "|".join(map(re.escape, CONTROLS)) + ")(.)", re.S)
_escaped = re.compile(r"\\(.)", re.S)
_turn = re.compile(re.escape(START) + "(.*?)" + re.escape(ROLE_END) + "(.*?)" + re.escape(TURN_END), re.S)


def escape(text: str) -> str:
    return _control.sub(r"\1\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _escaped.sub(r"\1", text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """One turn as written, and the bounds of its text in it."""
    head = START + escape(role) + ROLE_END
    body = escape(text)
    return head + body + TURN_END, len(head), len(head) + len(body)


def parse(segment: str) -> list[tuple[str, str, int, int]]:
    """(role, text, text start, text end) of every turn written in a segment."""
    return [(unescape(m[1]), unescape(m[2]), m.start(2), m.end(2)) for m in _turn.finditer(segment)]


FORMATTED = "conv_id long, turn long, item int, role string, segment string, loss_start int, loss_end int"


def format_turns(turns: DataFrame, loss_roles: tuple[str, ...] = LOSS_ROLES) -> DataFrame:
    """One segment a turn; a conversation is its segments in order, without anything
    between.  [loss_start, loss_end) of a segment is under the loss mask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roles = batch.column(3).to_pylist()
            made = [render(r or "", t or "") for r, t in zip(roles, batch.column(4).to_pylist())]
            under = [(m[1], m[2]) if r in loss_roles else (0, 0) for m, r in zip(made, roles)]
            new = [pa.array([m[0] for m in made], pa.string()), *[pa.array([u[i] for u in under], pa.int32()) for i in range(2)]]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *new], [c.split()[0] for c in FORMATTED.split(", ")])

    return turns.where("layout is not null").select("conv_id", "turn", "item", "role", "text").mapInArrow(run, FORMATTED)


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(formatted: DataFrame) -> DataFrame:
    """What each conversation says, parsed from its segments.

    Segments are dealt by conversation, sorted (turns that tie by role and text), and read
    as a stream that holds hash states only, so a conversation of any length takes
    bounded memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None

        def row():
            n, turns, loss_n, loss, chars = state
            return (now, n, turns.hexdigest(), loss_n, loss.hexdigest(), chars)

        for batch in batches:
            rows = []
            for conv, segment, start, end in zip(*(c.to_pylist() for c in batch.columns)):
                if state is None or conv != now:
                    if state is not None:
                        rows.append(row())
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text, _, _ in parse(segment):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                under = unescape(segment[start:end])
                state[2] += len(under)
                state[3].update(under.encode())
                state[4] += len(segment)
            yield _batch(rows, DIGEST)
        if state is not None:
            yield _batch([row()], DIGEST)

    # the text as the segment has it: escapes undone, as they would change the order of ties
    said = F.regexp_replace(F.split(F.col("segment"), re.escape(ROLE_END), 2)[1], r"(?s)\\(.)|" + re.escape(TURN_END) + r"\z", "$1")
    ordered = formatted.withColumn("said", said).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "item", "role", "said")
    return ordered.select("conv_id", "segment", "loss_start", "loss_end").mapInArrow(run, DIGEST)
