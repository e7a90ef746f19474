"""Mixing sources to target weights.

The words of each source, documents end to end in a fixed order, are packed into
blocks of a fixed number of words.  A source whose target is e times its size and
a bit takes every block e times and then as many more as the bit needs, the last
one cut short, so the words taken meet the target exactly.  Those slots are dealt
over output shards: the source counts of a shard are a multinomial draw given the
sources' totals, drawn by splitting the totals down a binary tree so that each
shard finds its own draw, and the number of slots before it, in a few steps.  A
slot of a source is mapped to a block by a pseudorandom permutation of the block
index (a Feistel network with cycle walking) and joined to the block by index.

Defined cases: null and word-less texts have size 0 and take 0; null is a source
of its own, last in order; sources of no words get target 0; an empty table gives
an empty result; repeated rows, rows of one id and rows without an id are separate
documents of one order; other columns are ignored.  The sources' sizes, one number a source, are held by the driver, as
the mixture is specified by them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hindcast.llm._spark import ascii_words, materialise, running_start, set_aside, set_back, spread

BLOCK_WORDS = 64
SHARD_SLOTS = 4_096
WEIGHTS = (3, 1, 2)


def water_fill(sizes: list[int], weights: list[float], total: float, most: float = 2.0) -> list[float]:
    """Shares of ``total`` by weight, none above ``most`` times its size; what a
    capped source can't take is shared again by weight among the others."""
    target = [0.0] * len(sizes)
    open_, left = [i for i, s in enumerate(sizes) if s > 0], float(total)
    while open_ and left > 0:
        per = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if per * weights[i] > most * sizes[i]]
        if not full:
            for i in open_:
                target[i] = per * weights[i]
            break
        for i in full:
            target[i] = most * sizes[i]
            left -= target[i]
        open_ = [i for i in open_ if i not in set(full)]
    return target


def _rounds(key: int) -> list[np.uint64]:
    return [np.uint64((((key * 4 + r) & 0xFFFFFFFF) * 0xD1B54A32D192ED03) & 0xFFFFFFFFFFFFFFFF) for r in range(4)]


def _mixed(x: np.ndarray, salt: np.uint64) -> np.ndarray:
    f = x * np.uint64(0x9E3779B97F4A7C15) + salt
    f ^= f >> np.uint64(29)
    f *= np.uint64(0xBF58476D1CE4E5B9)
    return f ^ (f >> np.uint64(32))


def permuted(index: np.ndarray, n: int, key: int, inverse: bool = False) -> np.ndarray:
    """Pseudorandom permutation of 0..n-1 at ``index``, or where it puts ``index``."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    shift, mask = np.uint64(half), np.uint64((1 << half) - 1)
    out = np.asarray(index).astype(np.uint64)
    todo = np.ones(len(out), bool)
    while todo.any():
        left, right = out[todo] >> shift, out[todo] & mask
        for salt in reversed(_rounds(key)) if inverse else _rounds(key):
            if inverse:
                left, right = right ^ (_mixed(left, salt) & mask), left
            else:
                left, right = right, left ^ (_mixed(right, salt) & mask)
        out[todo] = (left << shift) | right
        todo = out >= np.uint64(n)
    return out.astype(np.int64)


#: Slots up to which numpy draws without replacement.
NUMPY_SLOTS = 1_000_000_000


def _log_step(a: float, d: float) -> float:
    """ln((a + d)! / a!), exact to rounding also where both are huge."""
    if min(a, a + d) < 1_000_000:
        return math.lgamma(a + d + 1) - math.lgamma(a + 1)
    return d * math.log(a) + (a + d + 0.5) * math.log1p(d / a) - d + (1 / (a + d) - 1 / a) / 12


def hypergeometric(good: int, whole: int, take: int, rng: np.random.Generator) -> int:
    """How many of ``take`` of ``whole`` slots are among ``good``, drawn without replacement at any size.

    Binomial draws are accepted in proportion to the two laws' ratio, which falls on
    both sides of (take - 1) * good / whole.
    """
    if not good or not take or good == whole or take == whole:
        return min(good, take)
    if 2 * take > whole:  # what is left behind is the smaller draw
        return good - hypergeometric(good, whole, whole - take, rng)
    bad, p = whole - good, good / whole
    low, high = max(0, take - bad), min(good, take)
    top = min(max(math.ceil((take - 1) * p), low), high)
    while True:
        x = int(rng.binomial(take, p))
        if not low <= x <= high:
            continue
        d = x - top
        ratio = d * math.log(bad / good) - _log_step(good - top, -d) - _log_step(bad - take + top, d)
        if math.log(1 - rng.random()) <= ratio:
            return x


def _split(counts: np.ndarray, take: int, rng: np.random.Generator) -> np.ndarray:
    """``take`` of the slots in ``counts``, drawn without replacement: one law at every size."""
    whole = int(counts.sum())
    if whole < NUMPY_SLOTS:
        return rng.multivariate_hypergeometric(counts, take, method="marginals")
    out = np.zeros_like(counts)
    for i, n in enumerate(counts.tolist()):
        out[i] = hypergeometric(n, whole, take, rng)
        whole, take = whole - n, take - int(out[i])
    return out


def shard_draw(quotas: np.ndarray, shard: int, shards: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Of one shard: slots of each source, and those in the shards before it."""
    before, counts, low, high = np.zeros_like(quotas), quotas, 0, shards
    while high - low > 1:
        mid = (low + high) // 2
        rng = np.random.default_rng([seed, low, high])
        take = int(counts.sum()) * (mid - low) // (high - low)
        left = _split(counts, take, rng)
        if shard < mid:
            counts, high = left, mid
        else:
            before, counts, low = before + left, counts - left, mid
    return counts, before


def mix(
    docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, factor: float = 1.5, most: float = 2.0,
    block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = 7, doc_id: str = "doc_id", text: str = "text", source: str = "source",
    row_key: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(documents, segments).

    documents: doc_id, source, size, source_size, target, taken of every row.
    segments: doc_id, row_key, size, epoch, shard, place, first, last: the words
    [first, last) of a document that the slot ``place`` of ``shard`` takes.  row_key
    is the column of that name, unique and not null, or else made here.
    """
    spark = docs.sparkSession
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = materialise(
        docs.select(
            F.col(doc_id).alias("doc_id"),
            F.col(source).cast("string").alias("source"),
            F.size(ascii_words(whole)).cast("long").alias("size"),
            F.crc32(whole.cast("binary")).alias("crc"),
            *([F.col(row_key).alias("row_key")] if row_key else []),
        ),
        "mix-sizes",
    )
    stats = rows.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows")).collect()
    stats.sort(key=lambda r: (r.source is None, (r.source or "").encode("utf-32-be")))
    sizes = [r["size"] for r in stats]
    targets = water_fill(sizes, [weights[i % len(weights)] for i in range(len(sizes))], factor * sum(sizes), most)

    blocks = np.array([-(-s // block_words) for s in sizes], np.int64)
    words = np.array([round(t) for t in targets], np.int64)  # to take of each source
    full = np.array([w // s if s else 0 for w, s in zip(words, sizes)], np.int64)
    extra = words - full * np.array(sizes, np.int64)
    keys = [i * 7919 + seed for i in range(len(sizes))]
    # further blocks after the full rounds, the last one cut; the short tail block counts what it has
    more, cut = np.zeros_like(blocks), np.zeros_like(blocks)
    for i, s in enumerate(sizes):
        need = int(extra[i])
        if need > 0:
            lacks = int(blocks[i]) * block_words - s
            tail_at = int(permuted(np.array([blocks[i] - 1]), int(blocks[i]), keys[i], inverse=True)[0])
            met = lambda k: k * block_words - lacks * (tail_at < k)  # noqa: E731, B023
            k = -(-need // block_words)
            more[i] = k if met(k) >= need else k + 1
            cut[i] = need - met(int(more[i]) - 1)
    quotas = full * blocks + more
    slots = int(quotas.sum())

    table = spark.createDataFrame(
        [(r.source, i, int(r["size"]), float(t)) for i, (r, t) in enumerate(zip(stats, targets))],
        "source string, source_no int, source_size long, target double",
    )
    numbered = rows.join(F.broadcast(table), rows.source.eqNullSafe(table.source)).drop(table.source)
    n = sum(r.rows for r in stats)
    placed = running_start(numbered, ["source_no"], ["doc_id", "crc"], F.col("size"), "start", spread(n))
    if not row_key:
        placed = placed.withColumn("row_key", F.concat_ws(":", "source_no", "start", "doc_id", "size"))
    placed = materialise(placed, "mix-placed")

    shards = max(1, -(-slots // shard_slots))
    spec = spark.sparkContext.broadcast((quotas, blocks, full, more, cut, keys))

    def slots_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        quotas, blocks, full, more, cut, keys = spec.value
        for batch in batches:
            for shard in batch["id"]:
                counts, before = shard_draw(quotas, int(shard), shards, seed)
                parts, place = [], 0
                for s in np.nonzero(counts)[0]:
                    k = before[s] + np.arange(counts[s], dtype=np.int64)
                    epoch, at = k // blocks[s], k % blocks[s]
                    length = np.full(len(k), block_words, np.int64)
                    length[k == full[s] * blocks[s] + more[s] - 1] = cut[s] if more[s] else block_words
                    parts.append(pd.DataFrame({"source_no": np.int32(s), "block": permuted(at, int(blocks[s]), keys[s]), "epoch": epoch.astype(np.int32), "shard": np.int64(shard), "place": place + np.arange(len(k)), "words": length}))
                    place += len(k)
                if parts:
                    yield pd.concat(parts)

    drawn = spark.range(0, shards if slots else 0, 1, min(shards, 256)).mapInPandas(
        slots_of, "source_no int, block long, epoch int, shard long, place long, words long"
    )
    block = F.lit(block_words).cast("long")
    pieces = placed.where("size > 0").select(
        "doc_id", "row_key", "source_no", "size", "start",
        F.explode(F.sequence(F.expr(f"start div {block_words}"), F.expr(f"(start + size - 1) div {block_words}"))).alias("block"),
    )
    # Spark can't know how many slots a shard draws, and would broadcast them
    joined = pieces.join(drawn.hint("merge"), ["source_no", "block"])
    first = F.greatest(F.lit(0), F.col("block") * block - F.col("start"))
    last = F.least(F.col("size"), F.col("block") * block + F.col("words") - F.col("start"))
    segments = joined.select("doc_id", "row_key", "size", "epoch", "shard", "place", first.alias("first"), last.alias("last")).where("last > first")
    taken = segments.groupBy("row_key").agg(F.sum(F.col("last") - F.col("first")).alias("taken"))
    documents = placed.join(taken, "row_key", "left").select(
        "doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")
    )
    return documents, segments


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents: for each round, the words of a document that it takes.

    A document taken whole keeps its text as it is; of one taken in part the taken
    words stay, a blank between.  Rows are told apart by a number written with them,
    as ids may be null or repeated.  Columns as in ``docs``, whatever their names; n_chars
    is set anew.
    """
    columns = docs.columns
    docs = materialise(set_aside(docs).withColumn("_mix_row", F.monotonically_increasing_id()), "mix-numbered")
    _, segments = mix(docs, row_key="_mix_row", **options)
    parts = segments.groupBy("row_key", "size", "epoch").agg(
        F.sum(F.col("last") - F.col("first")).alias("got"), F.array_sort(F.collect_set(F.struct("first", "last"))).alias("ranges")
    )
    parts = parts.select(F.col("row_key").alias("_mix_key"), (F.col("got") >= F.col("size")).alias("_mix_whole"), F.col("ranges").alias("_mix_ranges"))
    joined = docs.join(parts.hint("merge"), docs["_mix_row"] == parts["_mix_key"]).withColumn("_mix_words", ascii_words(F.col("text")))
    piece = lambda r: F.slice("_mix_words", r["first"].cast("int") + 1, (r["last"] - r["first"]).cast("int"))
    some = F.array_join(F.flatten(F.transform("_mix_ranges", piece)), " ")
    joined = joined.withColumn("text", F.when(F.col("_mix_whole"), F.col("text")).otherwise(some))
    if "n_chars" in columns:
        joined = joined.withColumn("n_chars", F.char_length("text").cast("long"))
    return set_back(joined, columns)
