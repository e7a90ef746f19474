"""Null and extreme ids, turns that tie, and columns named as operators name their own."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from hindcast.llm import chat, fingerprints, line_dedup, mixing, near_join, quality, queries

INNER = [
    "_score", "_near_row", "_copy", "_mix_key", "_mix_row", "_mix_whole", "_mix_ranges", "_mix_words", "n_lines", "n_removed", "_d", "_e", "_kd", "_ke", "_kept", "_lines", "_stay", "row", "row_key",
    "kept", "size", "source_size", "target", "taken", "l", "d", "e", "b", "part", "token", "score", "lang", "key", "epoch", "first", "last", "passages", "_bucket", "_amount", "a.dotted name",
]


def edited(text, after):
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


@pytest.mark.parametrize("ids", [[None, 5, 1], [None], [None, None, 7], [-(2**63), 2**63 - 1, None, 0], [-(2**63), -(2**63) + 1, None], [3, 3, None, None, 3]])
def test_fingerprints_of_null_and_extreme_ids(spark, ids):
    rows = [(x, f"text {i} " + "word other more " * (i + 2)) for i, x in enumerate(ids)]
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    want = Counter((d, hashlib.sha256(edited(t, order[(i + 1) % len(order)][1]).encode()).hexdigest()) for i, (d, t) in enumerate(order))
    got = fingerprints.edited_and_near(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert Counter((r.doc_id, r.edited_sha256) for r in got) == want


def test_turns_that_tie_stand_by_role_and_text(spark):
    texts = ["a", "a b", "a\\", "a\\ b", "a<|im_end|>", "<", "<|im_sep|>x", "a\nb", ""]
    rows = [(1, 0, role, t) for role in ("user", "user2", "us") for t in texts]
    random.Random(2).shuffle(rows)
    records = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = chat.to_turns(records.select("conv_id", "turn", F.to_json(F.struct("role", "text")).alias("record")))
    got = chat.read_back(chat.format_turns(made)).collect()[0]
    want = "".join(f"{r}\n{t}\n" for _, _, r, t in sorted(rows, key=lambda x: (x[1], x[2].encode(), x[3].encode())))
    assert got.n_turns == len(rows) and got.turns_sha256 == hashlib.sha256(want.encode()).hexdigest()


def table(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(200)]
    texts = [" ".join(rng.choices(words, k=rng.choice([3, 40, 90]))) for _ in range(30)]
    texts += [texts[1], texts[2] + " more", None, "", "line one here\nline one here\nother"]
    schema = "doc_id long, text string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in INNER)
    rows = [(i if i % 8 else None, t, f"s{i % 3}", len(t or ""), *(f"{c}-{i}" for c in INNER)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, schema).repartition(3)


def held(df):
    """Every row's own columns agree on the row they came from."""
    out = []
    for r in df.collect():
        numbers = {r[c].removeprefix(f"{c}-") for c in INNER}
        assert len(numbers) == 1
        out.append(int(numbers.pop()))
    return out


def test_stages_keep_columns_of_any_name(spark):
    docs = table(spark)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    stages = [lambda d: quality.good_documents(d, labels, 0.0), line_dedup.deduped_documents, near_join.one_of_each, mixing.mixed_documents]
    for stage in stages:
        out = stage(docs)
        assert out.columns == docs.columns and [t for _, t in out.dtypes] == [t for _, t in docs.dtypes]
        numbers = held(out)
        assert numbers and set(numbers) <= set(range(35))
        if stage is not stages[3]:
            assert len(numbers) == len(set(numbers))


def test_stages_equal_those_of_plain_tables(spark):
    docs = table(spark)
    plain = docs.select("doc_id", "text", "source", "n_chars")
    for stage in (line_dedup.deduped_documents, near_join.one_of_each, mixing.mixed_documents):
        both = [Counter((r.doc_id, r.text, r.n_chars) for r in stage(d).collect()) for d in (docs, plain)]
        assert both[0].total() == both[1].total() and set(both[0]) == set(both[1])


def test_pipeline_stages_are_those_named():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "n-gram Jaccard join", "mixing sources to target weights", "SentencePiece encoding and decoding"]
    assert "op1_chat_formatting" in queries.queries()
