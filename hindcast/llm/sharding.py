"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Equal texts form a group and never part.  Groups of at least 1/65,536 of all
bytes number at most 65,536 and are packed one by one; the rest are gathered by
hash into a fixed number of crates, so that at most 65,536 + 8,192 sized items
reach the packer however large the corpus is.  The packer takes items by falling
size and puts each into the bin whose remaining capacity is tightest, found by
binary search in a sorted list (the balanced tree); the least capacity that
needs no more than the wanted number of bins is found by bisection.

The fixed-capacity form packs each hash partition's groups (PART_GROUPS on
average) in a task of its own; a partition's two emptiest bins are left open and
cut into pieces of at most 1/32 of the capacity, a larger group being a piece of
its own, and the pieces of all partitions are packed together on the driver.  One
partition holds the groups of a small table, which are then packed as a whole.

Defined cases: null text has no bytes and groups with the empty text; repeated
rows and ties are grouped and packed by hash order; an empty table gives an empty
result; a group larger than the even share gets the bin it needs and the others
stay even among themselves; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hindcast.llm._spark import materialise, running_start, spread

BIG_PARTS = 65_536
CRATES = 8_192
PART_GROUPS = 131_072
OPEN_BINS = 2
PIECES = 32


def best_fit_decreasing(items: list[tuple[int, str]], capacity: int, most: int | None = None) -> list[int] | None:
    """Bin of each item (sorted by falling size); None if ``most`` bins are too few.

    Items beyond the capacity get a bin of their own, closed at once.
    """
    tree: list[tuple[int, int]] = []  # (remaining, bin), sorted
    bins = 0
    out = []
    for size, _ in items:
        at = bisect_left(tree, (size, -1))
        if at < len(tree):
            left, b = tree.pop(at)
        else:
            if most is not None and bins >= most:
                return None
            left, b, bins = max(capacity, size), bins, bins + 1
        out.append(b)
        insort(tree, (left - size, b))
    return out


def pack(items: list[tuple[int, str]], bins: int) -> list[int]:
    """Pack into at most ``bins`` bins of the least capacity that suffices."""
    if not items:
        return []
    even = max(1, -(-sum(s for s, _ in items) // bins))
    step, fails, fits, found = max(1, even // 1000), even - 1, even, None
    while (found := best_fit_decreasing(items, fits, bins)) is None:
        fails, fits, step = fits, fits + step, step * 2
    for _ in range(12):
        mid = (fails + fits) // 2
        if mid <= fails:
            break
        tried = best_fit_decreasing(items, mid, bins)
        if tried is None:
            fails = mid
        else:
            fits, found = mid, tried
    return found


def fewest_shards(items: list[tuple[int, str]], capacity: int) -> list[int]:
    """The fixed-capacity form: as few bins as best-fit-decreasing needs."""
    return best_fit_decreasing(items, capacity)


def _pack_part(capacity: int, whole: bool):
    """Pack one partition's groups: (text_key, bin, piece, bytes), bin null for what is left open."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["bytes", "text_key"], ascending=[False, True], kind="stable").reset_index(drop=True)
        sizes = group["bytes"].to_numpy()
        bins = np.array(fewest_shards([(int(s), "") for s in sizes], capacity))
        fill = np.bincount(bins, weights=sizes)
        open_ = [] if whole else [b for b in np.argsort(fill, kind="stable")[:OPEN_BINS] if fill[b] < capacity]
        number = np.cumsum(~np.isin(np.arange(len(fill)), open_)) - 1  # closed bins without gaps
        left = np.isin(bins, open_)
        most, piece, have = max(1, capacity // PIECES), -1, capacity
        pieces = np.full(len(group), -1)
        for i in np.nonzero(left)[0]:
            if have + sizes[i] > most:
                piece, have = piece + 1, 0
            pieces[i], have = piece, have + sizes[i]
        return pd.DataFrame({"text_key": group["text_key"], "part": group["part"], "bin": np.where(left, -1, number[bins]), "piece": pieces, "bytes": sizes})

    return run


def _shard_by_capacity(rows: DataFrame, capacity: int) -> DataFrame:
    """``rows`` with the shard of each: no shard is above ``capacity`` but for a group that is."""
    spark = rows.sparkSession
    groups = materialise(rows.groupBy("text_key").agg(F.sum("size").alias("bytes")), "shard-groups")
    parts = max(1, -(-groups.count() // PART_GROUPS))
    dealt = groups.withColumn("part", F.pmod(F.xxhash64("text_key"), F.lit(parts)).cast("int"))
    packed = dealt.groupBy("part").applyInPandas(_pack_part(capacity, parts == 1), "text_key string, part int, bin int, piece int, bytes long")
    packed = materialise(packed, "shard-packed")
    # one row a partition, and at most about 2 * OPEN_BINS * PIECES pieces of each
    closed = {r.part: r.bins for r in packed.groupBy("part").agg((F.max("bin") + 1).alias("bins")).toLocalIterator()}
    first, shards = [], 0
    for p in sorted(closed):
        first.append((p, shards))
        shards += closed[p]
    open_ = packed.where("piece >= 0").groupBy("part", "piece").agg(F.sum("bytes").alias("bytes"))
    items = sorted(((r.bytes, (r.part, r.piece)) for r in open_.toLocalIterator()), key=lambda x: (-x[0], x[1]))
    merged = [(*k, shards + b) for (_, k), b in zip(items, fewest_shards(items, capacity))]
    offsets = spark.createDataFrame(first, "part int, first int")
    last = spark.createDataFrame(merged, "part int, piece int, merged int")
    placed = packed.join(F.broadcast(offsets), "part").join(F.broadcast(last), ["part", "piece"], "left")
    placed = placed.select("text_key", F.coalesce("merged", F.col("first") + F.col("bin")).alias("shard"))
    return rows.join(placed.hint("merge"), "text_key")


def shard(docs: DataFrame, shards: int = 16, capacity: int | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every row.

    With ``capacity`` the number of shards is what packing needs instead.
    """
    spark = docs.sparkSession
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = materialise(
        docs.select(
            F.col(doc_id).alias("doc_id"),
            (F.octet_length(whole) + 1).cast("long").alias("size"),
            F.crc32(whole.cast("binary")).alias("text_crc32"),
            F.sha2(whole.cast("binary"), 256).alias("text_key"),
        ),
        "shard-rows",
    )
    n, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    if capacity:
        return _numbered(_shard_by_capacity(rows, capacity), n)
    crate = F.pmod(F.xxhash64("text_key"), F.lit(CRATES)).cast("string")
    groups = rows.groupBy("text_key").agg(F.sum("size").alias("bytes"))
    # at most BIG_PARTS groups reach this size, so the list is bounded
    big = groups.where(F.col("bytes") >= max(1, total // BIG_PARTS))
    big = materialise(big, "shard-big")
    # (key, item) is broadcast: one row per big group, BIG_PARTS at most
    tagged = rows.join(
        F.broadcast(big.select("text_key", F.lit(True).alias("is_big"))), "text_key", "left"
    ).withColumn("item", F.when(F.col("is_big"), F.col("text_key")).otherwise(crate))
    sizes = tagged.groupBy("item").agg(F.sum("size").alias("bytes"))
    items = sorted(((r.bytes, r.item) for r in sizes.toLocalIterator()), key=lambda x: (-x[0], x[1]))
    bins = pack(items, shards)
    placed = spark.createDataFrame([(k, b) for (_, k), b in zip(items, bins)], "item string, shard int")
    return _numbered(tagged.join(F.broadcast(placed), "item"), n)


def _numbered(dealt: DataFrame, n: int) -> DataFrame:
    dealt = dealt.select("doc_id", "size", "text_crc32", "shard")
    return running_start(dealt, ["shard"], ["doc_id", "text_crc32", "size"], F.lit(1).cast("long"), "slot", spread(n))
