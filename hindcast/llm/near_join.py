"""N-gram Jaccard join with Bayesian candidate pruning.

Equal texts are one class, so a class has one representative.  Representatives
get 128 MinHash values of their five-word shingles; 32 bands of four values bring
together all that share a band (a pair of similarity 0.8 misses every band with
probability 5e-8).  Each band links its members to its smallest one, so a family of
any size gives a linear number of links, and connected components of the links
hold every candidate pair in exactly one component.

Inside a component pairs are compared in blocks: MinHash values 16 at a time, and a
pair is dropped as soon as the posterior probability (uniform prior) that its
similarity reaches the threshold falls below the tolerance; what is left is
verified exactly by shingle sets.  A large component is cut into blocks by hash and
each pair of blocks is a task of its own, so neither all pairs of a group nor a
group as a whole ever stand in one place; blocks give counts and spanning links.

Defined cases: null counts as empty; texts without words have no shingles and only
equal texts are with them; texts under five words have one shingle of all words;
of repeated rows the smallest id represents (null last); texts that have only null
ids are compared like all others; of each group one row is kept, also where rows
share an id or have none; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hindcast.llm._spark import join_by_key, materialise, semi_by_filter, set_aside, set_back
from hindcast.llm._text import Words, buffers, fmix, shingle_hashes, slices, texts_shingles

PERMUTATIONS = 128
BAND_ROWS = 4
STEP = 16
THRESHOLD = 0.8
TOLERANCE = 1e-9
#: Bounds of a block: representatives, and shingles of them together.
BLOCK_TEXTS = 256
BLOCK_SHINGLES = 1 << 20
#: Columns of the incidence matrix that are multiplied at a time.
COLUMNS = 8_192

_rng = np.random.default_rng(99)
_A = _rng.integers(1, 1 << 63, PERMUTATIONS, dtype=np.uint64) | np.uint64(1)
_B = _rng.integers(1, 1 << 63, PERMUTATIONS, dtype=np.uint64)
NONE = np.uint32(0xFFFFFFFF)


def minhash(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(texts, PERMUTATIONS) smallest permuted hash of each text, 32 bits."""
    out = np.full((len(bounds) - 1, PERMUTATIONS), NONE, np.uint32)
    full = np.diff(bounds) > 0
    if full.any():
        starts = bounds[:-1][full]
        for i in range(PERMUTATIONS):
            x = (hashes * _A[i] + _B[i]) >> np.uint64(32)
            out[full, i] = np.minimum.reduceat(x.astype(np.uint32), starts)
    return out


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> dict[int, int]:
    """For n values compared: the fewest matches that keep a pair.

    With m of n values equal and a uniform prior, similarity is Beta(m+1, n-m+1);
    the probability of at least ``threshold`` is a binomial tail.
    """
    out = {}
    for n in range(STEP, PERMUTATIONS + 1, STEP):
        tail, m = 0.0, 0
        for m in range(n + 1):  # P(Beta(m+1, n-m+1) >= t) = P(Bin(n+1, t) <= m)
            tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= tolerance:
                break
        out[n] = m
    return out


def similar_pairs(signatures: tuple[np.ndarray, np.ndarray], sets: tuple[list[np.ndarray], list[np.ndarray]], same: bool, threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (left, right) of similarity >= threshold; with ``same`` each unordered pair once."""
    left, right = signatures
    need = least_matches(threshold)
    rows, cols = [], []
    for i in range(len(left)):
        j = np.arange(i + 1 if same else 0, len(right))
        matched = np.zeros(len(j), np.int32)
        for n in range(STEP, PERMUTATIONS + 1, STEP):
            if not len(j):
                break
            matched += (right[j, n - STEP : n] == left[i, n - STEP : n]).sum(1, dtype=np.int32)
            keep = matched >= need[n]
            j, matched = j[keep], matched[keep]
        rows.append(np.full(len(j), i))
        cols.append(j)
    a = np.concatenate(rows) if rows else np.zeros(0, int)
    b = np.concatenate(cols) if cols else np.zeros(0, int)
    if not len(a):
        return a, b
    shared = _overlaps(sets, a, b)
    sizes = np.array([len(s) for s in sets[0]])[a] + np.array([len(s) for s in sets[1]])[b] - shared
    hit = (shared >= threshold * sizes - 1e-9) & (shared > 0)
    return a[hit], b[hit]


def _overlaps(sets: tuple[list[np.ndarray], list[np.ndarray]], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Shared shingles of each pair, exactly."""
    if len(a) <= 64:
        return np.array([len(np.intersect1d(sets[0][i], sets[1][j], assume_unique=True)) for i, j in zip(a, b)])
    ua, ub = np.unique(a), np.unique(b)
    parts = [[sets[k][i] for i in u] for k, u in ((0, ua), (1, ub))]
    code, inverse = np.unique(np.concatenate([*parts[0], *parts[1]]), return_inverse=True)
    n_left = sum(map(len, parts[0]))
    at = [inverse[:n_left], inverse[n_left:]]
    of = [np.repeat(np.arange(len(p)), [len(x) for x in p]) for p in parts]
    both = np.zeros(len(code), np.uint8)
    both[at[0]] |= 1
    both[at[1]] |= 2
    column = np.cumsum(both == 3) - 1  # shingles that both sides have
    total = np.zeros((len(ua), len(ub)), np.float32)
    width = int(column[-1]) + 1 if len(column) else 0
    kept = [both[x] == 3 for x in at]
    spots = [(of[k][kept[k]], column[at[k][kept[k]]]) for k in (0, 1)]
    order = [np.argsort(s[1], kind="stable") for s in spots]
    spots = [(s[0][o], s[1][o]) for s, o in zip(spots, order)]
    for low in range(0, width, COLUMNS):
        dense = []
        for (row, col), n in zip(spots, (len(ua), len(ub))):
            lo, hi = np.searchsorted(col, [low, low + COLUMNS])
            m = np.zeros((n, min(COLUMNS, width - low)), np.float32)
            m[row[lo:hi], col[lo:hi] - low] = 1
            dense.append(m)
        total += dense[0] @ dense[1].T
    return total[np.searchsorted(ua, a), np.searchsorted(ub, b)].astype(np.int64)


def components(links: DataFrame, label: str) -> DataFrame:
    """(node, root) of every linked node: the smallest node of its component.

    links is (u, v).  Alternating large and small stars, each round written to the
    shared folder; rounds grow with the logarithm of the longest chain.
    """
    edges = materialise(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), label)
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        small = small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        edges = materialise(small, label)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first()
        if now == before:
            break
        before = now
    roots = edges.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


SIGNED = "doc_id long, text_key string, row long, n_shingles int, minhash binary"


def signatures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", row: str | None = None) -> DataFrame:
    """doc_id, text_key (sha256 of the text), row (its unique number), n_shingles, minhash of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, signs = [], []
            for low, high in slices(batch.column(3)):
                words = Words(*buffers(batch.column(3).slice(low, high - low)))
                found, bounds = shingle_hashes(words.hashes(), words.bounds)
                signs += [row.tobytes() for row in minhash(found, bounds)]
                counts += np.diff(bounds).tolist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(counts, pa.int32()), pa.array(signs, pa.binary())], ["doc_id", "text_key", "row", "n_shingles", "minhash"]
            )

    whole = F.coalesce(F.col(text), F.lit(""))
    number = F.col(row).cast("long") if row else F.monotonically_increasing_id()
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.sha2(whole.cast("binary"), 256).alias("text_key"), number.alias("row"), whole.alias("text")).mapInArrow(run, SIGNED)


def shingles(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, shingles: sorted distinct 64-bit shingle hashes as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array([s.tobytes() for s in texts_shingles(batch.column(1))], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), made], ["doc_id", "shingles"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).mapInArrow(run, "doc_id long, shingles binary")


def _band_links(reps: DataFrame) -> DataFrame:
    """(u, v): each representative and the smallest one of each of its bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = PERMUTATIONS // BAND_ROWS
        for batch in batches:
            signs = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, PERMUTATIONS)
            key = np.zeros((len(signs), n), np.uint64)
            for j in range(BAND_ROWS):
                key = fmix(key ^ signs[:, j::BAND_ROWS][:, :n].astype(np.uint64) + np.uint64(j + 1))
            key = key ^ fmix(np.arange(1, n + 1, dtype=np.uint64))[None, :]
            ids = np.repeat(np.asarray(batch.column(0)), n)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(key.ravel().view(np.int64))], ["doc_id", "band"])

    bands = reps.where("n_shingles > 0").select("doc_id", "minhash").mapInArrow(run, "doc_id long, band long")
    first = bands.groupBy("band").agg(F.min("doc_id").alias("v"), F.count(F.lit(1)).alias("n")).where("n > 1")
    # both sides grow with the corpus: no broadcast
    return bands.join(first.hint("merge"), "band").where("doc_id <> v").select(F.col("doc_id").alias("u"), "v").distinct()


BLOCKED = "doc_id long, root long, links long"


def _compare(threshold: float):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("doc_id", kind="stable").reset_index(drop=True)
        low, high = int(group["low"].iloc[0]), int(group["high"].iloc[0])
        ids = group["doc_id"].to_numpy()
        signs = np.frombuffer(b"".join(group["minhash"]), np.uint32).reshape(-1, PERMUTATIONS)
        sets = [np.frombuffer(s, np.uint64) for s in group["shingles"]]
        inside = np.nonzero(group["block"].to_numpy() == low)[0]
        other = inside if low == high else np.nonzero(group["block"].to_numpy() == high)[0]
        a, b = similar_pairs((signs[inside], signs[other]), ([sets[i] for i in inside], [sets[i] for i in other]), low == high, threshold)
        a, b = inside[a], other[b]
        links = np.bincount(a, minlength=len(ids)) + np.bincount(b, minlength=len(ids))
        root = np.arange(len(ids))
        while len(a):  # smallest index of each connected part
            least = root.copy()
            np.minimum.at(least, a, root[b])
            np.minimum.at(least, b, root[a])
            least = least[least]
            if (least == root).all():
                break
            root = least
        hit = links > 0
        return pd.DataFrame({"doc_id": ids[hit], "root": ids[root[hit]], "links": links[hit]})

    return run


def near_groups(docs: DataFrame, threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, class_id, class_size, n_links, group_id, kept.

    class_id is the smallest id with the same text, n_links the number of other
    texts of similarity >= threshold, group_id the smallest id of the texts that are
    linked directly or through others (null if none has an id); one row of each
    group is kept.
    """
    return _grouped(docs, threshold, doc_id, text).drop("row")


def _grouped(docs: DataFrame, threshold: float, doc_id: str = "doc_id", text: str = "text", row: str | None = None) -> DataFrame:
    """:func:`near_groups` with the unique number ``row`` of every row, from that column if it is named."""
    signed = materialise(signatures(docs, doc_id, text, row), "near-signed")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    classes = signed.groupBy("text_key").agg(first.alias("first"), F.count(F.lit(1)).alias("class_size"))
    classes = classes.select("text_key", F.col("first.doc_id").alias("class_id"), F.col("first.row").alias("first_row"), "class_size")
    firsts = signed.where("n_shingles > 0").groupBy("text_key").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), F.first("minhash").alias("minhash"))
    # an id may stand with several texts: its rows are told apart by a number of their own
    reps = materialise(firsts.select(F.xxhash64("text_key").alias("doc_id"), F.col("doc_id").alias("first_id"), "text_key", "n_shingles", "minhash"), "near-reps")
    family = components(_band_links(reps), "near-links")
    members = materialise(reps.join(family.hint("merge"), reps["doc_id"] == family["node"]).drop("node"), "near-members")
    sizes = members.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("s"))
    sizes = sizes.select("root", F.greatest(F.ceil(F.col("n") / BLOCK_TEXTS), F.ceil(F.col("s") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    # the texts of the members alone move, each as its shingle set
    whole = docs.select(F.col(text).alias("text"), F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256).alias("text_key"), F.col(doc_id).cast("long").alias("id"))
    wanted = members.select(F.concat_ws(":", "text_key", "first_id").alias("key"))
    held = semi_by_filter(whole.withColumn("key", F.concat_ws(":", "text_key", "id")), "key", wanted).select(F.xxhash64("text_key").alias("doc_id"), "text")
    sets = shingles(held, "doc_id", "text").groupBy("doc_id").agg(F.first("shingles").alias("shingles"))
    block = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(5)), F.col("blocks"))
    dealt = members.join(sizes, "root").withColumn("block", block).join(sets.hint("merge"), "doc_id")
    pair = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("block", o).alias("low"), F.greatest("block", o).alias("high")))
    spread = dealt.select("root", "block", "doc_id", "minhash", "shingles", F.explode(pair).alias("pair")).select("root", "block", "doc_id", "minhash", "shingles", "pair.low", "pair.high")
    found = materialise(spread.groupBy("root", "low", "high").applyInPandas(_compare(threshold), BLOCKED), "near-found")
    links = found.groupBy("doc_id").agg(F.sum("links").alias("n_links"))
    groups = components(found.select(F.col("doc_id").alias("u"), F.col("root").alias("v")), "near-groups")
    named = reps.select("doc_id", "text_key", "first_id").join(groups.hint("merge"), F.col("doc_id") == F.col("node")).join(links.hint("merge"), "doc_id")
    # texts may share their first id, or have none: the smallest number of those leads
    least = named.groupBy("root").agg(F.min(F.struct(F.col("first_id").isNull().alias("none"), "first_id", "doc_id")).alias("lead"))
    linked = named.join(least, "root").select("text_key", "n_links", F.col("lead.first_id").alias("group_id"), (F.col("doc_id") == F.col("lead.doc_id")).alias("leads"))
    every = classes.join(linked.hint("merge"), "text_key", "left").select("text_key", "class_id", "first_row", "class_size", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("group_id", "class_id").alias("group_id"), F.coalesce("leads", F.lit(True)).alias("leads"))
    out = join_by_key(signed.select("doc_id", "text_key", "row"), every, "text_key", "class_size", signed.count())
    return out.select("doc_id", "class_id", "class_size", "n_links", "group_id", (F.col("leads") & (F.col("row") == F.col("first_row"))).alias("kept"), "row")


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one row of each near-duplicate group, columns unchanged, whatever their names.

    Rows are told apart by a number written with them, as ids may be null or repeated.
    """
    numbered = materialise(set_aside(docs).withColumn("_near_row", F.monotonically_increasing_id()), "near-numbered")
    kept = _grouped(numbered, threshold, row="_near_row").where("kept").select(F.col("row").alias("_near_row"))
    return set_back(numbered.join(kept.hint("merge"), "_near_row", "left_semi"), docs.columns)
