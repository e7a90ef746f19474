"""The divergence audit against plain loops and its SQL."""

from __future__ import annotations

import os
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from hindcast.llm import divergence, queries, sql

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
ASCII = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(ASCII))


def loop(rows, least, top):
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        found = Counter(terms(text))
        docs[lang].update(found.keys())
        counts[lang, source] += found
    out = set()
    for lang, sources in groups.items():
        kept = sorted(t for t, n in docs[lang].items() if n >= least)
        v = len(kept)

        def shares(count):
            n = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 5) // (n + 5 * v) for t in kept}

        p = {s: shares(counts[lang, s]) for s in sources}
        q = shares(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), "pair") for o in sources if o != s]
            over = [(q[t] - p[s][t], t.encode(), "term") for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part in (sorted(pairs), sorted(over)[:top]):
                out |= {(lang, s, kind, item.decode(), -value, i + 1) for i, (value, item, kind) in enumerate(part)}
    return out


def random_rows(n, seed):
    rng = random.Random(seed)
    vocabulary = ["The", "ÉTÉ", "日本", "x", "[y]", "a_b", "w z", "@", "don't", *(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))]
    rows = []
    for _ in range(n):
        text = rng.choice([None, "", " ".join(rng.choices(vocabulary, weights=[1 / (i + 1) for i in range(len(vocabulary))], k=rng.randrange(1, 30)))])
        rows.append((rng.choice(["en", "en", "en", "fr", None, "", "xx"]), rng.choice(["a", "a", "a", "b", "Z", "é", None, "q\nr"]), text))
    return [*rows, ("solo", "alone", "no kept terms"), ("solo", "other", None), ("one", "only", "x")]


def collected(df):
    got = df.collect()
    assert df.columns == ["lang", "source", "part", "item", "value", "rank"] and len(got) == len(set(got))
    return {tuple(r) for r in got}


SCHEMA = "lang string, source string, text string, g int, p int, term string, v long"


@pytest.fixture(scope="module")
def table(spark):
    def make(rows):
        return spark.createDataFrame([(*r, 1, 2, "t", 3) for r in rows], SCHEMA).repartition(5)

    return make


def test_audit_equals_the_loop(table):
    rows = random_rows(400, 1)
    assert collected(divergence.audit(table(rows), 12, 7)) == loop(rows, 12, 7)


def test_small_blocks_chunks_and_merges(table, monkeypatch):
    rows = random_rows(300, 2)
    spilled = divergence.runs(table(rows).na.fill("", ["lang", "source", "text"]), 3, block=400, chunk=3)
    got = defaultdict(Counter)
    for r in divergence.frequencies(spilled, 1, waiting=10).collect():
        for s, c in zip(r.sources, r.counts):
            assert (s, r.term) not in got[r.lang]
            got[r.lang][s, r.term] = c
    want = defaultdict(Counter)
    for lang, source, text in rows:
        for t in terms(text):
            want[lang or ""][source or "", t] += 1
    assert got == {k: v for k, v in want.items() if v}


def test_pair_corrections_spill(spark):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), [(g, rng.randrange(1, 1000), 3 + g) for g in sorted(rng.sample(range(12), rng.randrange(1, 12)))]) for _ in range(200)]
    want = Counter()
    for lang, held in rows:
        for i, (a, p, z) in enumerate(held):
            for b, q, y in held[i + 1 :]:
                want[lang, a, b] += abs(p - q) - abs(p - y) - abs(z - q) + abs(z - y)
    df = spark.createDataFrame(rows, "lang string, held array<struct<g:int,p:long,z:long>>").repartition(2)
    for limit in (4, 1000):
        assert {(r.lang, r.a, r.b): r.more for r in divergence.both_held(df, limit).collect()} == dict(want)


def test_long_text_is_one_document(table):
    rows = [("en", "a", "word " * 200_000 + "x")] + [("en", "b", "word y")] * 3
    assert collected(divergence.audit(table(rows), 4)) == loop(rows, 4, 50)


def test_empty_table(table):
    assert divergence.audit(table([])).count() == 0


def test_terms_of_whole_code_range():
    text = "".join(map(chr, [*range(0x180), 0x2028, 0xFFFD, 0x1F4A9]))
    assert [w for w in divergence.terms_of(pa.array([text, "", "A b"]))[0].as_py() if w] == terms(text)


def test_summed():
    keys, sums = divergence._summed(np.array([3, 1, 3]), np.array([1, 2, 5]))
    assert keys.tolist() == [1, 3] and sums.tolist() == [2, 6]


def test_query_equals_its_sql(spark, table, tmp_path):
    rows = random_rows(500, 4)
    table(rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = collected(queries.op12_source_divergence(spark, str(tmp_path)))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{os.path.join(str(tmp_path), 'documents.parquet')}/*.parquet')")
    want = con.execute("SELECT lang, source, part, item, value, rank FROM (" + sql.OP12 + ")").fetchall()
    assert got == set(want) == loop(rows, 30, 50)
