"""Packing against the tokenizer itself, sequential best fit and plain loops."""

from __future__ import annotations

import random
import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from hindcast.llm import packing, queries

ODD = ["<|endoftext|>. a<|STARTOFTEXT|>b", "H̱ello. X̊, Å", "don't. I'll! 'S", "ΑΣ. ΟΔΟΣ, Σ", "a.b.c... ?!x", "   x", "日本語。テスト", "é.", "ª. ²,x", "\x00a \x00", "Ḱ. ͅ.", "ǅ; ŉ:", "", "à.", "x‍. İ.", "ß.", "   \x1c.\x0b", "💩!"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(packing.default_vocabulary())


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids + [0]


def test_encoder_equals_the_library(library):
    texts = [*ODD, *(a + b for a in ODD for b in ODD), *(f"{a}\n {b}" for a in ODD for b in ODD)]
    ids, bounds = packing.encoder(packing.default_vocabulary()).ids(pa.array(texts))
    for i, t in enumerate(texts):
        assert list(ids[bounds[i] : bounds[i + 1]]) == ids_of(library, t)[:-1], repr(t)


def test_forgetful_encoder(monkeypatch, library):
    monkeypatch.setattr(packing, "REMEMBERED", 5)
    coder = packing.Encoder(packing.default_vocabulary())
    rng = random.Random(1)
    for _ in range(30):
        texts = [" ".join(rng.choice(["one", "Two,", "three.", "<x>", "\x00", "four"]) for _ in range(rng.randrange(6))) for _ in range(3)]
        ids, bounds = coder.ids(pa.array(texts))
        assert [list(ids[a:b]) for a, b in zip(bounds, bounds[1:])] == [ids_of(library, t)[:-1] for t in texts]


def test_long_texts_are_cut_at_white_space(monkeypatch):
    monkeypatch.setattr(packing, "SLICE_BYTES", 50)
    text = "word " * 40 + "x" * 9000 + " end\n" * 30
    parts = packing._parts(pa.array([text])).to_pylist()
    assert "".join(parts) == text and all(p[0].isspace() for p in parts[1:])


def best_fit(sizes, capacity):
    gaps, n = [], 0
    for x in sorted(sizes, reverse=True):
        i = bisect_left(gaps, x)
        gap = gaps.pop(i) if i < len(gaps) else capacity
        n += gap == capacity
        if gap > x:
            insort(gaps, gap - x)
    return n


@pytest.mark.parametrize("last", [True, False])
def test_parts_pack_like_sequential_best_fit(last):
    rng = np.random.default_rng(4)
    for sizes in (rng.integers(1, 2048, 3000), rng.integers(1, 60, 3000), rng.integers(400, 1100, 3000), np.full(900, 700), np.array([5]), np.zeros(0, int), rng.integers(1, 20, 7)):
        sequence, offset = packing.pack_part(sizes, 2048, last)
        left = sizes[sequence < 0]
        assert len(left) == 0 if last else left.sum() < 11 * 2048
        rows = defaultdict(list)
        for s, o, n in zip(sequence, offset, sizes):
            if s >= 0:
                rows[s].append((o, n))
        for filled in rows.values():
            filled.sort()
            assert [o for o, _ in filled] == [sum(n for _, n in filled[:i]) for i in range(len(filled))] and sum(n for _, n in filled) <= 2048
        if last:
            assert len(rows) <= best_fit(sizes.tolist(), 2048) * 1.01 + 1


def test_one_sweep_ranks_conflicts():
    won = packing.sweep(np.array([9, 9, 9, 7, 5, 5]), np.array([5, 7, 9, 9]))
    assert won.tolist() == [2, 3, -1, 1, 0, -1]
    assert packing.sweep(np.array([3]), np.zeros(0, int)).tolist() == [-1]


@pytest.fixture
def table(spark, tmp_path):
    def write(texts):
        rows = [(i // 2 if i % 9 else None, t, 7, "c", 1) for i, t in enumerate(texts)]
        spark.createDataFrame(rows, "doc_id long, text string, piece int, row string, size int").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
        return rows, str(tmp_path)

    return write


def test_query_holds_every_token_once(spark, table, library):
    rng = random.Random(2)
    words = ["alpha", "Beta.", "γ", "日本", "word-with-dashes", "x1"]
    texts = [None, "", *ODD, *(" ".join(rng.choices(words, k=rng.choice([3, 50, 400, 900]))) for _ in range(60)), "same text " * 30, "same text " * 30, " ".join(rng.choices(words, k=6000)), "a" * 9000]
    rows, path = table(texts)
    got = queries.op13_best_fit_packing(spark, path).collect()
    want = Counter()
    for doc_id, text, *_ in rows:
        ids = ids_of(library, text)
        for piece, start in enumerate(range(0, len(ids), 2048)):
            cut = ids[start : start + 2048]
            want[doc_id, piece, start, len(cut), zlib.crc32(np.array(cut, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    filled = defaultdict(list)
    for r in got:
        filled[r.sequence_id].append((r.offset, r.length))
    for s in filled.values():
        s.sort()
        assert [o for o, _ in s] == [sum(n for _, n in s[:i]) for i in range(len(s))] and sum(n for _, n in s) <= 2048
    assert len(filled) <= best_fit([r.length for r in got], 2048)


def test_supersteps_and_clashing_names(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice([rng.randrange(1, 101), 40]), "k", "p", 3, -1) for i in range(3000)]
    packed = packing.pack(spark.createDataFrame(rows, "id long, length int, key string, part string, size int, offset int").repartition(4), 100, part=200)
    got = packed.collect()
    assert packed.columns == ["id", "length", "key", "part", "size", "sequence_id", "offset"] and Counter((r.id, r.length, r.key) for r in got) == Counter(r[:3] for r in rows)
    filled = Counter()
    for r in got:
        filled[r.sequence_id] += r.length
    assert max(filled.values()) <= 100 and len(filled) <= best_fit([r[1] for r in rows], 100) * 1.03


def test_sequences_and_empty_table(spark, table):
    _, path = table(["one two", "three", None])
    pieces = packing.pack(packing.tokenized(spark.read.parquet(path + "/documents.parquet")), 2048)
    whole = packing.sequences(pieces).collect()
    assert len(whole) == 1 and len(whole[0].ids) == 4 * sum(r.length for r in pieces.collect())
    none = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(packing.tokenized(none)).count() == 0
    assert packing.pack(packing.tokenized(none)).agg(F.sum("length")).first()[0] is None
