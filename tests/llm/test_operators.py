"""The corpus operators against brute force on small tables with awkward rows."""

from __future__ import annotations

import hashlib
import json
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from hindcast.llm import chat, exact_dedup, fingerprints, line_dedup, mixing, near_join, quality, sentencepiece_fst, sharding, url_filter
from hindcast.llm.sentencepiece_fst import merged
from hindcast.llm._spark import bitmap_filter, filter_bits, might_contain

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, shard int, _id string, key string"
SPACE = r"[\x20\x09-\x0D]"


def base_texts() -> list[str | None]:
    rng = np.random.default_rng(5)
    words = ["the", "of", "and", "été", "日本", *(f"w{i}" for i in range(400))]
    draw = lambda n: " ".join(rng.choice(words, n))
    long_ = "\n".join(draw(12) for _ in range(400))
    first = "\n".join(draw(14) for _ in range(6))
    near = first.split(" ")
    near[3] = "changed"
    lines = first.split("\n")
    return [
        first, " ".join(near), first, first.replace(" ", "\t"), None, "", " \n\t ", "one", "one two three four five", "one two three four five six",
        long_, draw(50), "\n".join([lines[2], draw(9), "", lines[2], lines[4] + " extra"]), "a b c d e", "b a c d e", "x", "x", None,
        "</s>[INST] \\ <|im_end|>", draw(50) + "\x0b\x0c\r", "▁ 💩 \x00 end", "mix MIXED " * 30,
    ]


def make(spark, texts):
    rows = [(i, t, "en", f"s{i % 3}" if i % 7 else None, len(t or ""), 1, 2, "z", None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    return make(spark, base_texts()).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return [w for w in re.split(SPACE + "+", t or "") if w]


def grams(t):
    w = words(t)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_bitmap_filter_has_no_false_negatives(spark):
    keys = spark.range(0, 5000, 3)
    bits = filter_bits(5000)
    found = might_contain(spark.range(5000), "id", bitmap_filter(keys, "id", bits), bits, "maybe").toPandas()
    hit = set(found.id[found.maybe])
    assert set(range(0, 5000, 3)) <= hit and len(hit) < 1800
    twice = bitmap_filter(keys.unionByName(spark.range(3, 4)), "id", bits, at_least=2)
    found = might_contain(spark.range(5000), "id", twice, bits, "maybe").where("maybe").toPandas()
    assert 3 in set(found.id) and len(found) < 100


def test_exact_dedup(docs, empty):
    texts = dict(enumerate(base_texts()))
    norm = {i: re.sub(SPACE, "", t or "") for i, t in texts.items()}
    groups: dict[str, list[int]] = {}
    for i, t in norm.items():
        groups.setdefault(t, []).append(i)
    rows = {r.doc_id: r for r in exact_dedup.exact_dedup(docs).collect()}
    assert len(rows) == len(texts)
    for i, r in rows.items():
        group = groups[norm[i]]
        keep = min(group, key=lambda j: (-len(texts[j] or ""), j))
        assert (r.keep_id, r.group_size, r.kept) == (keep, len(group), i == keep)
        assert r.text_sha256 == hashlib.sha256(norm[i].encode()).hexdigest()
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_exact_dedup_repeated_rows_and_null_ids(spark):
    rows = [(1, "a b"), (1, "a b"), (None, "ab"), (2, "ab")]
    out = exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sum(r.kept for r in out) == 1 and {r.keep_id for r in out} == {1} and {r.group_size for r in out} == {4}
    least = -(2**63)
    out = exact_dedup.exact_dedup(spark.createDataFrame([(least, "ab"), (2, "a b"), (least, "ab")], "doc_id long, text string")).collect()
    assert {r.keep_id for r in out} == {2} and len(out) == 3
    many = spark.range(3000).selectExpr("id as doc_id", "concat('t', if(id % 3 = 0, 0, id div 4)) as text")  # one class with a third of the rows
    out = exact_dedup.exact_dedup(many).collect()
    assert len(out) == 3000 and sum(r.kept for r in out) == len({r.text_sha256 for r in out})


def test_fingerprints(docs, empty):
    texts = base_texts()
    rows = {r.doc_id: r for r in fingerprints.edited_and_near(docs).collect()}
    order = sorted(range(len(texts)), reverse=True)
    jaccard = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for n, i in enumerate(order):
        text, after = texts[i] or "", texts[order[(n + 1) % len(order)]] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r = rows[i]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert abs(r.near_edited - jaccard(grams(text), grams(edited))) < 0.2
        assert abs(r.near_next - jaccard(grams(text), grams(after))) < 0.2
        if len(grams(text)) < 128:
            assert r.distinct_shingles == len(grams(text))
    assert rows[0].fingerprint == rows[2].fingerprint == rows[3].fingerprint
    assert fingerprints.edited_and_near(empty).count() == 0


def test_fingerprints_merge(docs):
    parts = fingerprints.fingerprint(docs.select("lang", "text"))
    whole = fingerprints.merge_fingerprints(parts, "lang").collect()
    assert len(whole) == 1
    kept = np.unique(np.concatenate([fingerprints.decode(r.fingerprint) for r in parts.collect()]))[:128]
    assert (fingerprints.decode(whole[0].fingerprint) == kept).all()
    a, b = kept[:100], kept[50:]
    assert fingerprints.containment(a[:40], kept) == 1.0 and 0 < fingerprints.resemblance(a, b) < 1
    assert fingerprints.resemblance(a[:0], b[:0]) == 1.0 and fingerprints.resemblance(a[:0], b) == 0.0


def test_one_document_is_its_own_next(spark):
    r = fingerprints.edited_and_near(spark.createDataFrame([(5, "a b c d e f")], "doc_id long, text string")).first()
    assert r.near_next == 1.0


def test_sharding(docs, empty):
    texts = base_texts()
    rows = sharding.shard(docs, 4).collect()
    assert len(rows) == len(texts)
    shard = {r.doc_id: r.shard for r in rows}
    for t in set(texts) - {None, ""}:
        assert len({shard[i] for i, x in enumerate(texts) if x == t}) == 1
    assert len({shard[i] for i, x in enumerate(texts) if not x}) == 1
    for s in set(shard.values()):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert r["size"] == len(raw) + 1 and r.text_crc32 == zlib.crc32(raw) and 0 <= r.shard < 4
    assert sharding.shard(empty, 4).count() == 0


def test_best_fit_decreasing():
    items = [(s, str(i)) for i, s in enumerate(sorted([7, 5, 5, 4, 3, 3, 2, 1], reverse=True))]
    bins = sharding.fewest_shards(items, 10)
    load = Counter()
    for (s, _), b in zip(items, bins):
        load[b] += s
    assert max(load.values()) <= 10 and len(load) == 3
    rng = np.random.default_rng(1)
    many = sorted(((int(x), str(i)) for i, x in enumerate(rng.integers(1, 1000, 3000))), reverse=True)
    load = Counter()
    for (s, _), b in zip(many, sharding.pack(many, 16)):
        load[b] += s
    assert len(load) == 16 and max(load.values()) - min(load.values()) < 0.01 * max(load.values())


@pytest.mark.parametrize("part_groups, capacity", [(None, 100), (8_000, 100), (8_000, 40_000), (8_000, 200_000)])
def test_sharding_by_capacity(spark, docs, empty, monkeypatch, part_groups, capacity):
    """Many small groups: hashed into crates of fixed number, they would exceed 100 bytes."""
    if part_groups:
        monkeypatch.setattr(sharding, "PART_GROUPS", part_groups)
    df = spark.range(200_000 if part_groups is None else 40_000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("y"), (F.col("id") % 3).cast("int")).alias("y"), F.col("id").cast("string").alias("t"))
    df = df.select("doc_id", F.concat("t", "y").alias("text")).union(spark.createDataFrame([(-1, "z" * 90), (-2, "z" * 9), (-3, "z" * 9), (-4, None), (-5, "")], "doc_id long, text string"))
    out = sharding.shard(df, capacity=capacity).cache()
    assert out.count() == df.count() == out.select("doc_id").distinct().count()
    loads = [r.n for r in out.groupBy("shard").agg(F.sum("size").alias("n")).orderBy("shard").collect()]
    assert max(loads) <= capacity
    groups = df.groupBy(F.coalesce("text", F.lit("")).alias("t")).agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1).alias("n")).collect()
    best = len(set(sharding.fewest_shards(sorted(((r.n, r.t) for r in groups), reverse=True), capacity)))  # all in one place
    assert best <= len(loads) <= best * 1.01 + 1 and out.agg(F.max("shard")).first()[0] == len(loads) - 1
    assert out.where("doc_id in (-2, -3)").select("shard").distinct().count() == 1
    assert out.groupBy("shard").agg((F.max("slot") + 1 == F.count("slot")).alias("ok")).where("not ok").count() == 0
    assert sharding.shard(empty, capacity=capacity).count() == 0
    assert max(r.n for r in sharding.shard(docs, capacity=10).groupBy("shard").agg(F.count_distinct("text_crc32").alias("n")).collect()) > 1


def test_mixing(docs, empty):
    texts = base_texts()
    documents, segments = mixing.mix(docs, block_words=8, shard_slots=16)
    rows = {r.doc_id: r for r in documents.collect()}
    assert len(rows) == len(texts)
    total = sum(len(words(t)) for t in texts)
    by: dict = {}
    for r in rows.values():
        assert r["size"] == len(words(texts[r.doc_id])) and 0 <= r.taken <= 2 * r["size"]
        by.setdefault(r.source, []).append(r)
    assert abs(sum(x[0].target for x in by.values()) - 1.5 * total) < 1e-6
    for x in by.values():
        assert x[0].source_size == sum(r["size"] for r in x)
        assert abs(sum(r.taken for r in x) - x[0].target) <= 0.5 and x[0].target <= 2 * x[0].source_size + 1e-9
    again = {r.doc_id: r.taken for r in mixing.mix(docs.repartition(5), block_words=8, shard_slots=16)[0].collect()}
    assert again == {i: r.taken for i, r in rows.items()}
    assert segments.groupBy("doc_id", "epoch").agg(F.sum(F.col("last") - F.col("first")).alias("n"), F.first("size").alias("size")).where("n > size").count() == 0
    assert mixing.mix(empty)[0].count() == 0


def test_mixed_documents(docs):
    texts = base_texts()
    out = mixing.mixed_documents(docs, block_words=8)
    assert out.columns == docs.columns
    got = Counter()
    for r in out.collect():
        assert not Counter(words(r.text)) - Counter(words(texts[r.doc_id]))
        got[r.doc_id] += len(words(r.text))
    assert got == Counter({r.doc_id: r.taken for r in mixing.mix(docs, block_words=8)[0].collect() if r.taken})


def test_mixed_documents_of_null_and_shared_ids(spark):
    """Every word that the mix takes of a row comes from that row, whatever its id."""
    rows = []
    for i in range(24):
        size = 20 + i % 3  # texts of one id and size too
        rows.append((None if i % 3 == 0 else i % 4, " ".join(f"d{i}x{j}" for j in range(size)), f"s{i % 2}"))
    rows.append((2, rows[1][1], "s1"))
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = mixing.mix(df, block_words=8)[0].agg(F.sum("taken")).first()[0]
    got, seen = Counter(), Counter()
    for r in mixing.mixed_documents(df, block_words=8).collect():
        owner = {w.split("x")[0] for w in words(r.text)}
        assert len(owner) == 1
        assert any(owner == {t.split("x")[0]} and i == r.doc_id for i, t, _ in rows)
        got[r.doc_id] += len(words(r.text))
        seen.update(words(r.text))
    assert sum(got.values()) == taken == round(1.5 * sum(len(words(t)) for _, t, _ in rows)) and got[None] > 0
    stands = Counter(w for _, t, _ in rows for w in words(t))
    assert all(n <= 2 * stands[w] for w, n in seen.items())


def test_water_fill_and_permutation():
    assert mixing.water_fill([100, 100, 10], [3, 1, 2], 300) == pytest.approx([200, 80, 20])
    assert mixing.water_fill([], [], 0) == []
    for n in (1, 2, 7, 100, 4097):
        at = mixing.permuted(np.arange(n), n, 12)
        assert sorted(at) == list(range(n))
        assert (mixing.permuted(at, n, 12, inverse=True) == np.arange(n)).all()
    quotas = np.array([50, 7, 0, 143])
    draws = [mixing.shard_draw(quotas, s, 9, 3) for s in range(9)]
    assert (sum(d[0] for d in draws) == quotas).all()
    assert all((draws[s][1] == sum((d[0] for d in draws[:s]), np.zeros(4, int))).all() for s in range(9))


def test_draws_have_one_law_at_every_size(monkeypatch):
    """The sampler for huge urns against numpy's, on urns that both can draw from."""
    rng = np.random.default_rng(6)
    for good, whole, take in [(3, 10, 4), (5, 8, 7), (400, 5000, 2500), (4_000_000, 9_000_000, 3_000_000), (2, 900_000_000, 400_000_000)]:
        mine = np.array([mixing.hypergeometric(good, whole, take, rng) for _ in range(3000)], float)
        mean, p = take * good / whole, good / whole
        sd = np.sqrt(take * p * (1 - p) * (whole - take) / (whole - 1))
        assert abs(mine.mean() - mean) < 5 * sd / np.sqrt(3000) and abs(mine.std() / sd - 1) < 0.08
        assert mine.min() >= max(0, take - whole + good) and mine.max() <= min(good, take)
    exact = np.bincount([mixing.hypergeometric(4, 9, 5, rng) for _ in range(20000)], minlength=5) / 20000
    want = [math.comb(4, x) * math.comb(5, 5 - x) / math.comb(9, 5) for x in range(5)]
    assert np.abs(exact - want).max() < 0.02
    huge = np.array([7 * 10**12, 5, 0, 3 * 10**12])
    out = mixing._split(huge, 4 * 10**12, rng)
    assert out.sum() == 4 * 10**12 and (out <= huge).all() and abs(out[0] - 2.8e12) < 1e7
    monkeypatch.setattr(mixing, "NUMPY_SLOTS", 0)
    quotas = np.array([50, 7, 0, 143])
    draws = [mixing.shard_draw(quotas, s, 9, 3) for s in range(9)]
    assert (sum(d[0] for d in draws) == quotas).all() and max(d[0].sum() for d in draws) - min(d[0].sum() for d in draws) <= 1


def test_line_dedup(docs, empty):
    texts = base_texts()
    order: list[tuple[frozenset, int, int]] = []
    for i, t in enumerate(texts):
        for j, line in enumerate(t.split("\n") if t is not None else []):
            order.append((frozenset(words(line)), i, j))
    gone = set()
    for n, (s, i, j) in enumerate(order):
        if s and any(x and len(s & x) / len(s | x) >= 0.8 for x, _, _ in order[:n]):
            gone.add((i, j))
    for r in line_dedup.dedup_lines(docs).collect():
        t = texts[r.doc_id]
        if t is None:
            assert r.text is None and r.n_lines == 0
            continue
        kept = [line for j, line in enumerate(t.split("\n")) if (r.doc_id, j) not in gone]
        assert r.text == "\n".join(kept) and r.n_removed == len(t.split("\n")) - len(kept)
    assert line_dedup.dedup_lines(empty).count() == 0
    assert line_dedup.deduped_documents(docs).columns == docs.columns


def test_line_dedup_plans_stay_small(spark):
    """The rarity table is printed in every event of a plan, which the driver keeps."""
    docs = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(100_000)))], "doc_id long, text string")
    assert len(line_dedup._sets(docs, "doc_id", "text")._jdf.queryExecution().executedPlan().toString()) < 400_000


def test_line_dedup_joins_sets_of_like_size(spark):
    """Strangers that share a prefix word but differ in size meet under no key; true pairs do."""
    from pyspark.sql import functions as F

    rows = [(i, n, list(range(n - -(-4 * n // 5) + 1))) for i, n in enumerate(range(4, 400))]
    sets = spark.createDataFrame(rows, "id long, n int, prefix array<int>").selectExpr("*", "0L sig", "0L sig2", "0 out")
    keys = line_dedup._postings(sets).select("key", F.shiftright("packed", 26).alias("n"), F.col("packed").bitwiseAND(F.lit(1)).alias("up"))
    x, y = keys.where("up = 0").alias("x"), keys.alias("y")
    met = {(r[0], r[1]) for r in x.join(y, "key").select("x.n", "y.n").distinct().collect()}
    assert all((a, b) in met for b in range(4, 400) for a in range(b, min(399, b * 5 // 4) + 1))
    assert not any(a > 2 * b or b > 2 * a for a, b in met)


def test_line_dedup_of_a_family(spark):
    rng = np.random.default_rng(2)
    base = [f"t{i}" for i in range(30)]
    rows = []
    for i in range(150):
        line = list(base)
        for p in rng.choice(30, 2, replace=False):
            line[p] = f"v{rng.integers(1000)}"
        rows.append((i, " ".join(line)))
    sets = [set(t.split()) for _, t in rows]
    want = {i for i in range(150) if not any(len(sets[i] & s) / len(sets[i] | s) >= 0.8 for s in sets[:i])}
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id for r in out if r.n_removed == 0} == want


def test_line_dedup_on_both_sides_of_long_sets(spark):
    """Sets of one and of two signatures meet, a word more or less than the bound and near it."""
    rng = np.random.default_rng(4)
    rows = []
    for family in range(40):
        size = line_dedup.LONG_SET + int(rng.integers(-8, 9))
        base = [f"f{family}w{i}" for i in range(size)]
        for _ in range(5):
            line = [w for w in base if rng.random() > 0.06] + [f"n{rng.integers(10**9)}" for _ in range(rng.integers(0, 9))]
            rows.append((len(rows), " ".join(line)))
    sets = [set(t.split()) for _, t in rows]
    want = {i for i in range(len(rows)) if not any(len(sets[i] & s) / len(sets[i] | s) >= 0.8 for s in sets[:i])}
    assert 40 < len(want) < 180
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id for r in out if r.n_removed == 0} == want


def test_line_dedup_of_null_and_shared_ids(spark):
    """Every row stands for itself: nothing unique goes, later copies do."""
    line = " ".join(f"u{i}" for i in range(10))
    rows = [(0, line), (None, line + " more"), (None, "only here"), (7, "seven one"), (7, "seven two\n" + line), (8, "same row"), (8, "same row"), (None, "no id\n\n"), (None, "no id\n\n"), (None, None), (None, ""), (None, "")]
    out = sorted((r.doc_id is None, r.doc_id or 0, r.text or "", r.n_removed) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    want = [(0, line, 0), (None, "", 1), (None, "only here", 0), (7, "seven one", 0), (7, "seven two", 1), (8, "same row", 0), (8, "", 1), (None, "no id\n\n", 0), (None, "\n", 1), (None, None, 0), (None, "", 0), (None, "", 0)]
    assert out == sorted((i is None, i or 0, t or "", n) for i, t, n in want)


def test_line_dedup_of_many_lines(spark):
    """Linear in the lines of one text."""
    lines = [f"w{i} v{i % 7} x{i // 3} y" for i in range(100_000)]
    text = "\n".join(lines + lines)
    row = line_dedup.dedup_lines(spark.createDataFrame([(1, text), (2, lines[5])], "doc_id long, text string")).orderBy("doc_id").collect()
    assert row[0].text == "\n".join(lines) and row[0].n_removed == 100_000 and row[1].text == ""


def test_near_groups(docs, empty):
    texts = base_texts()
    ids = {}
    for i, t in enumerate(texts):
        ids.setdefault(t or "", i)
    reps = list(ids)
    links = {t: {u for u in reps if u != t and grams(t) and len(grams(t) & grams(u)) / len(grams(t) | grams(u)) >= 0.8} for t in reps}
    for r in near_join.near_groups(docs).collect():
        t = texts[r.doc_id] or ""
        assert r.class_id == ids[t] and r.n_links == len(links[t])
        seen, todo = {t}, [t]
        while todo:
            for u in links[todo.pop()] - seen:
                seen.add(u)
                todo.append(u)
        assert r.group_id == min(ids[u] for u in seen) and r.kept == (r.doc_id == r.group_id)
    assert near_join.near_groups(empty).count() == 0
    assert near_join.one_of_each(docs).columns == docs.columns


def test_one_of_each_with_null_and_shared_ids(spark):
    near = lambda k, c: " ".join([f"{k}{i}" for i in range(80)] + [c])
    rows = [
        (None, near("a", "one")), (None, near("a", "two")), (None, near("a", "two")),  # no id at all
        (None, near("b", "one")), (7, near("b", "two")),  # the row with an id stays
        (3, near("c", "one")), (3, near("c", "two")), (3, near("c", "two")),  # one id, a group of its own
        (5, near("d", "one")), (4, near("d", "two")), (5, near("e", "one")),  # id 5 goes from one group and stays for another
        (9, "x"), (9, "x"), (None, None), (None, ""),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    groups = near_join.near_groups(df).collect()
    assert len(groups) == len(rows) and sum(r.kept for r in groups) == 7
    assert sorted(r.n_links for r in groups) == [0] * 5 + [1] * 10
    kept = Counter((r.doc_id, (r.text or "")[:1]) for r in near_join.one_of_each(df).collect())
    assert kept == Counter([(None, "a"), (7, "b"), (3, "c"), (4, "d"), (5, "e"), (9, "x"), (None, "")])


def test_near_groups_of_a_family_beyond_a_block(spark):
    rng = np.random.default_rng(8)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(700):
        t = list(base)
        t[rng.integers(120)] = f"c{i}"
        rows.append((i, " ".join(t)))
    sets = [grams(t) for _, t in rows]
    out = {r.doc_id: r for r in near_join.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i in range(0, 700, 35):
        assert out[i].n_links == sum(len(sets[i] & s) / len(sets[i] | s) >= 0.8 for j, s in enumerate(sets) if j != i)
    assert {r.group_id for r in out.values()} == {0} and sum(r.kept for r in out.values()) == 1


def test_bayesian_pruning_keeps_true_pairs():
    need = near_join.least_matches()
    assert all(need[n] <= 0.8 * n for n in need) and need[128] > 50


def test_quality(spark, empty):
    rng = np.random.default_rng(4)
    vocab = [f"{a}{b}" for a in "tanderis" for b in ("he", "on", "ing", "est", "a")]
    rows, labels = [], []
    for i in range(240):
        good = i % 3 > 0
        w = rng.choice(vocab, 90)
        rows.append((i, " ".join(w) + "." if good else " ".join(x.upper() + "!!%$" for x in w)))
        labels.append((i, int(good), 0))
    table, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in quality.classify(table, known).collect()}
    held = [i for i in out if out[i].held_out]
    assert all(out[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in out)
    assert np.mean([out[i].predicted == labels[i][1] for i in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in out.values())
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "x " * 30000)], "doc_id long, text string")
    assert {r.doc_id for r in quality.classify(odd, known).collect()} == {1, 2, 3}
    assert {r.score for r in quality.classify(table, known.limit(0)).collect()} == {0.5}
    assert quality.classify(empty, known).count() == 0


def _bag_loss(w, x, bags, y):
    """Forward pass of one bag after the other, as the formulas say."""
    loss, scores = 0.0, []
    for i in range(len(y)):
        h = np.tanh(x[bags[i] : bags[i + 1]] @ w["encode"] + w["encode0"])
        raw = np.array([w["attend"] @ (np.tanh(v @ w["value"]) / (1 + np.exp(-(v @ w["gate"])))) for v in h])
        a = np.exp(raw - raw.max())
        p = 1 / (1 + np.exp(-((a / a.sum()) @ h @ w["score"] + w["score0"])))
        scores.append(p)
        share = y.mean()
        loss -= (0.5 / share if y[i] else 0.5 / (1 - share)) / len(y) * np.log(p if y[i] else 1 - p)
    return loss, np.array(scores)


def test_forward_pass_and_gradient_against_loops():
    """Scores of whole bags, and the gradient against finite differences, of every weight."""
    rng = np.random.default_rng(11)
    x, bags, y = rng.normal(size=(23, 6)), np.array([0, 1, 7, 12, 23]), np.array([1.0, 0, 0, 1])
    w = {k: rng.normal(0, 0.5, s) for k, s in quality.shapes(6).items()}
    scores = quality._forward(w, x, bags)[0]
    assert np.allclose(scores, _bag_loss(w, x, bags, y)[1])
    grad = quality.gradient(w, x, bags, y)
    for k in w:
        for at in np.ndindex(np.shape(w[k])):
            moved = {j: np.array(v, float) for j, v in w.items()}
            moved[k][at] += 1e-5
            high = _bag_loss(moved, x, bags, y)[0]
            moved[k][at] -= 2e-5
            assert abs((high - _bag_loss(moved, x, bags, y)[0]) / 2e-5 - np.asarray(grad[k])[at]) < 1e-6


def test_attention_gradient():
    rng = np.random.default_rng(0)
    x, bags, y = rng.normal(size=(60, quality.N_FEATURES)), np.array([0, 10, 25, 40, 60]), np.array([0.0, 1, 1, 0])
    model = quality.fit(x, bags, y, steps=200)
    assert (np.round(model.score(x, bags)) == y).all()


def test_sentencepiece_matches_the_library(docs, empty):
    import sentencepiece

    path = sentencepiece_fst.default_model()
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = base_texts() + ["  two  blanks ", "aaaaaaaaaaaaaaaaaaaaaaaa", "\n\n\tx", "<s></s><unk><0x41>"]
    machine = sentencepiece_fst.compile_model(open(path, "rb").read())
    for t in texts:
        ids = machine.encode(t)
        assert ids == library.encode(t or "")
        assert machine.decode(ids) == (t or "").replace("▁", " ")
    coded = {r.doc_id: r for r in sentencepiece_fst.encode(docs, checked="same").collect()}
    back = {r.doc_id: r.decoded for r in sentencepiece_fst.decode(sentencepiece_fst.encode(docs)).collect()}
    for r in sentencepiece_fst.digest(docs).collect():
        ids = library.encode(base_texts()[r.doc_id] or "")
        assert coded[r.doc_id].ids == ids and r.n_pieces == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<i4").tobytes()).hexdigest()
        assert coded[r.doc_id].same == r.round_trip == (back[r.doc_id] == (base_texts()[r.doc_id] or ""))
    assert sentencepiece_fst.digest(empty).count() == 0


def _message(*fields) -> bytes:
    """A protocol-buffer message of (tag, int, float or bytes)."""

    def varint(n: int) -> bytes:
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    out = b""
    for tag, value in fields:
        if isinstance(value, bytes):
            out += varint(tag << 3 | 2) + varint(len(value)) + value
        elif isinstance(value, float):
            out += varint(tag << 3 | 5) + np.array(value, "<f4").tobytes()
        else:
            out += varint(tag << 3) + varint(value)
    return out


def written_model(pieces: list[tuple[str, float, int]], kind: int, byte_fallback: bool, tidy: bool, charmap: bytes = b"") -> bytes:
    """A model by hand: kind 1 is unigram, 2 merges."""
    rows = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{b:02X}>", 0.0, 6) for b in range(256) if byte_fallback] + pieces
    spec = _message((1, b"own"), (2, charmap), (3, 1), (4, int(tidy)), (5, 1))
    return b"".join(_message((1, _message((1, p.encode()), (2, s), (3, k)))) for p, s, k in rows) + _message((2, _message((3, kind), (35, int(byte_fallback))))) + _message((3, spec))


def _written_pieces(kind: int) -> list[tuple[str, float, int]]:
    """1,000 pieces; unigram scores are binary fractions, so that sums are exact and ties are ties,
    and each merge joins two neighbours of a text under the earlier merges."""
    rng = np.random.default_rng(kind)
    names, ranks = list("abcdefg▁é日"), {}
    while len(names) < 1000:
        if kind == 1:
            p = "".join(rng.choice(names[:40] if rng.random() < 0.7 else names[:9], 2))
        else:
            parts = merged("▁" + "".join(rng.choice(list("abcdefg日"), 8, p=[0.3, 0.2, 0.2, 0.1, 0.1, 0.04, 0.04, 0.02])), ranks)[0]
            k = rng.integers(len(parts))
            p = "".join(parts[k : k + 2])
        if p not in names and "▁" not in p[1:]:
            ranks[p] = len(names)
            names.append(p)
    return [(p, float(-k if kind == 2 else -int(rng.integers(1, 512)) / 64 - len(p) / 8), 1) for k, p in enumerate(names)]


@pytest.mark.parametrize("kind, fallback, tidy, rule, own", [(1, True, False, "", []), (1, False, True, "", []), (1, True, True, "nfkc", []), (1, False, False, "nmt_nfkc", ["ab<x>"]), (2, True, False, "", []), (2, False, True, "nmt_nfkc", []), (2, True, True, "nfkc_cf", ["ab<x>"])])
def test_written_models_match_the_library(kind, fallback, tidy, rule, own):
    import sentencepiece

    charmap = b""
    if rule:
        spec = sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_normalizer_spec()
        charmap = dict(sentencepiece_fst._fields(spec))[2]
    raw = written_model(_written_pieces(kind) + [(p, 0.0, 4) for p in own], kind, fallback, tidy, charmap)
    library = sentencepiece.SentencePieceProcessor(model_proto=raw)
    machine = sentencepiece_fst.compile_model(raw)
    rng = np.random.default_rng(9)
    letters = [*"abcdefghabcdefgh   é日zZÉ ﬁ①ＡＢ", "e\u0301", "\u3000", "\t", *own]
    texts = ["", " ", "  a  b ", "zzz", "z", " z z", "日日z日", "ab" * 100, "abcdefgh" * 30, "a" + "\u0301" * 3] + ["".join(rng.choice(letters, rng.integers(1, 120))) for _ in range(400)]
    texts += ["".join(rng.choice(list("abcdefgh"), 300)) for _ in range(5)]
    import pyarrow as pa

    ids, bounds = machine.encode_texts(pa.array(texts))
    for i, t in enumerate(texts):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == library.encode(t), t


@pytest.fixture
def walked(monkeypatch):
    """Lengths of the chunks that are walked byte by byte."""
    lengths, alone = [], sentencepiece_fst.Transducer._alone
    monkeypatch.setattr(sentencepiece_fst.Transducer, "_alone", lambda self, raw: lengths.append(len(raw)) or alone(self, raw))
    return lengths


def test_long_chunks_without_a_blank_match_the_library(walked):
    import sentencepiece

    path = sentencepiece_fst.default_model()
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    machine = sentencepiece_fst.compile_model(open(path, "rb").read())
    rng = np.random.default_rng(5)
    letters = "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 1_000_000))
    chinese = "".join(map(chr, rng.integers(0x4E00, 0x9FA5, 333_000)))
    runs = [p * (20_000 // len(p)) for p in ["a", "=", "ab", "abc", "abcde", "abcdefg", "abcdefghijk", "http://www.example.com/", "\U0001f600é"]]
    few = ["".join(rng.choice(list(some), n)) for some in ("ab", "01", "aab中文", "=-_", "é\U0001f600日x") for n in range(60, 2000, 97)]
    for t in [letters, chinese, *runs, *few]:
        assert machine.encode(t) == library.encode(t), t[:80]
    assert not walked


@pytest.mark.parametrize("kind", [1, 2])
def test_long_chunks_of_written_models_match_the_library(kind, walked):
    import pyarrow as pa
    import sentencepiece

    raw = written_model(_written_pieces(kind), kind, True, False)
    library = sentencepiece.SentencePieceProcessor(model_proto=raw)
    machine = sentencepiece_fst.compile_model(raw)
    rng = np.random.default_rng(6)
    texts = ["".join(rng.choice(list("abcdefgé日zZ"), n)) for n in range(50, 4000, 61)] + ["ab" * 2500, "a" * 5000, "日" * 3000, "abcdefg" * 700]
    ids, bounds = machine.encode_texts(pa.array(texts))
    for i, t in enumerate(texts):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == library.encode(t), t[:80]
    assert kind == 1 or not walked


def test_links_are_what_merging_gives():
    """The seam rule against merging the characters of both pieces."""
    pieces = _written_pieces(2)
    machine = sentencepiece_fst.compile_model(written_model(pieces, 2, True, False))
    ranks = {p: -s for p, s, _ in pieces if len(p) > 1}
    ids = {p: 259 + i for i, (p, _, _) in enumerate(pieces)}
    made = [p for p in ids if merged(p, ranks)[0] == [p]]
    rng = np.random.default_rng(3)
    a, b = rng.choice(made, 4000), rng.choice(made, 4000)
    got = machine.linked(np.array([ids[p] for p in a]), np.array([ids[p] for p in b]))
    want = np.array([merged(x + y, ranks)[0] == [x, y] for x, y in zip(a, b)])
    assert (got == want).all() and 0 < want.sum() < len(want)


LAYOUTS = [
    ({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": [{"type": "text", "text": "a"}, {"text": "b"}]}]}, [("user", "q"), ("assistant", "ab")]),
    ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": None}]}, [("user", "q"), ("assistant", "")]),
    ({"instruction": "i", "input": "", "output": "o"}, [("user", "i"), ("assistant", "o")]),
    ({"instruction": "i", "input": "x", "output": "o", "id": 3}, [("user", "i"), ("user", "x"), ("assistant", "o")]),
    ({"prompt": "p", "completion": "c"}, [("user", "p"), ("assistant", "c")]),
    ({"system": "s", "prompt": "p", "response": "c"}, [("system", "s"), ("user", "p"), ("assistant", "c")]),
    ({"question": "q", "answer": "a"}, [("user", "q"), ("assistant", "a")]),
    ({"role": "tool", "text": None}, [("tool", "")]),
]


def test_chat_layouts(spark):
    rows = [(i, 0, json.dumps(r)) for i, (r, _) in enumerate(LAYOUTS)] + [(90, 0, "{broken"), (91, 0, None), (92, 0, '{"odd": 1}')]
    turns = chat.to_turns(spark.createDataFrame(rows, "conv_id long, turn int, record string"))
    got: dict = {}
    for r in turns.where("layout is not null").orderBy("conv_id", "item").collect():
        got.setdefault(r.conv_id, []).append((r.role, r.text))
    assert got == {i: t for i, (_, t) in enumerate(LAYOUTS)}
    assert chat.unmapped(turns).agg(F.sum("records")).first()[0] == 3
    assert chat.fingerprint({"a": [{"b": 1}, {"c": 2}]}) == chat.fingerprint({"a": [{"c": 0, "b": None}]})


def test_chat_of_odd_records(spark):
    """Broken, too deep and half-encoded records neither crash nor change ids beside null."""
    big = 9007199254740993
    rows = [(big, 0, '{"role": "user", "text": "a\\ud800b"}'), (None, 0, '{"role": "user", "text": "x"}'), (3, 0, "[" * 100_000), (4, 0, "[" * 3_000 + "]" * 3_000),
            (5, 0, '{"messages": [{"role": "user", "content": ' + "[" * 3_000 + "]" * 3_000 + "}]}"), (6, 0, '{"\\udfff": 1}'), (7, 0, "17"), (8, 0, "")]
    turns = chat.to_turns(spark.createDataFrame(rows, "conv_id long, turn int, record string")).collect()
    assert {r.conv_id: r.text for r in turns if r.layout} == {big: "a\ufffdb", None: "x"}
    assert sorted(r.conv_id for r in turns if not r.layout) == [3, 4, 5, 6, 7, 8]
    out = chat.read_back(chat.format_turns(chat.to_turns(spark.createDataFrame(rows, "conv_id long, turn int, record string")))).collect()
    assert {r.conv_id for r in out} == {big, None}


def test_chat_round_trip(spark):
    rng = np.random.default_rng(1)
    parts = [*chat.CONTROLS, "\\", "x", "\n", "é", "<", "|", "[", "/"]
    rows = [(c, t, ["user", "assistant", "sys\ntem", None][t % 4], None if rng.random() < 0.1 else "".join(rng.choice(parts, 12))) for c in range(20) for t in range(c % 5 + 1)]
    rows.append((None, 1, "assistant", "no id"))
    for _, _, role, text in rows:
        segment, start, end = chat.render(role or "", text or "")
        assert [(r, t) for r, t, _, _ in chat.parse(segment * 2)] == [(role or "", text or "")] * 2
        assert chat.unescape(segment[start:end]) == (text or "")
    table = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    records = table.select("conv_id", "turn", F.to_json(F.struct("role", "text"), {"ignoreNullFields": "false"}).alias("record"))
    out = {r.conv_id: r for r in chat.read_back(chat.format_turns(chat.to_turns(records))).collect()}
    for c in {r[0] for r in rows}:
        said = sorted((r for r in rows if r[0] == c), key=lambda r: r[1])
        loss = "".join(r[3] or "" for r in said if r[2] == "assistant")
        assert out[c].n_turns == len(said)
        assert out[c].turns_sha256 == hashlib.sha256("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in said).encode()).hexdigest()
        assert (out[c].loss_chars, out[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert out[c].formatted_chars == sum(len(chat.render(r[2] or "", r[3] or "")[0]) for r in said)
    assert chat.read_back(chat.format_turns(chat.to_turns(records.limit(0)))).count() == 0


def test_url_filter(spark):
    ts = lambda d: f"2024-01-{d:02d} 00:00:00"
    entries = [("l", "bad.com", "block", "add", ts(2)), ("l", "bad.com", "block", "add", ts(3)), ("l", "bad.com", "block", "remove", ts(5)), ("l", "bad.com", "block", "add", ts(8)),
               ("l", "ok.bad.com", "allow", "add", ts(1)), ("m", "ok.bad.com", "allow", "remove", ts(4)), ("l", None, "block", "add", ts(1))]
    pages = [(1, "http://x.bad.com/a", ts(2)), (2, "https://BAD.com:80/", ts(5)), (3, "http://bad.com.", ts(9)), (4, "http://u@ok.bad.com", ts(9)), (5, None, ts(9)),
             (6, "", ts(9)), (7, "http://bad.com", None), (8, "http://notbad.com", ts(3)), (1, "http://x.bad.com/a", ts(2))]
    e = spark.createDataFrame(entries, "list string, name string, action string, op string, at string").withColumn("at", F.to_timestamp("at"))
    p = spark.createDataFrame(pages, "page_id long, url string, fetched_at string").withColumn("fetched_at", F.to_timestamp("fetched_at"))
    got = sorted((r.page_id, r.action) for r in url_filter.evaluate(p, e).collect() if r.action) 
    assert got == [(1, "block"), (1, "block"), (3, "block"), (4, "allow")]
    assert url_filter.evaluate(p, e).count() == len(pages)
    hosts = spark.createDataFrame([("http://[2001:DB8::1]:80/x",), ("http://1.2.3.4/",), ("http://a.b.c",)], "url string")
    named = hosts.select(url_filter.host_of(F.col("url")).alias("h")).select("h", url_filter.names_of(F.col("h")).alias("n")).collect()
    assert {r.h: r.n for r in named} == {"[2001:db8::1]": ["[2001:db8::1]"], "1.2.3.4": ["1.2.3.4"], "a.b.c": ["a.b.c", "b.c", "c"]}
    assert url_filter.evaluate(p, e.limit(0)).where("action is null").count() == len(pages)
    assert url_filter.evaluate(p.limit(0), e).count() == 0


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    texts = [t for t in base_texts()] * 3
    docs = make(spark, texts).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(60)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {"doc_id", "ids", "round_trip"} <= set(out.columns) and out.count() > 0
