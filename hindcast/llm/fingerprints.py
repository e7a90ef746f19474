"""Document fingerprints: bottom-k sketches of five-word shingle hashes.

A fingerprint keeps the k smallest distinct shingle hashes of a text, written as
Base64 of little-endian 64-bit numbers in rising order.  Sketches of parts merge
into the sketch of the whole; two sketches estimate resemblance, containment and
the number of distinct shingles, exactly while no more than k are held.

Defined cases: null counts as the empty text, whose fingerprint is empty; two
empty fingerprints resemble each other by 1, an empty and a filled one by 0; a
text under five words has one shingle of all its words; rows repeated or tied on
the id stand in text order, null ids after all others; one row is its own next; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hindcast.llm._text import texts_shingles

K = 128
_SPACE = float(2**64)


def sketch(hashes: np.ndarray, k: int = K) -> np.ndarray:
    """Bottom k of sorted distinct hashes."""
    return hashes[:k]


def merge(parts: list[np.ndarray], k: int = K) -> np.ndarray:
    """Sketch of the union of the parts' shingle sets."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *parts]))[:k]


def distinct_count(s: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles."""
    return float(len(s)) if len(s) < k else (k - 1) * _SPACE / (float(s[k - 1]) + 1.0)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard similarity."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = merge([a, b], k)
    shared = np.intersect1d(a, b, assume_unique=True)
    return float(np.isin(shared, both, assume_unique=True).sum()) / len(both)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has."""
    if not len(a):
        return 1.0
    both = distinct_count(merge([a, b], k), k)
    return min(1.0, resemblance(a, b, k) * both / max(1.0, distinct_count(a, k)))


def encode(s: np.ndarray) -> str:
    return base64.b64encode(s.astype("<u8").tobytes()).decode()


def decode(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), "<u8")


def fingerprint(df: DataFrame, text: str = "text", out: str = "fingerprint", k: int = K) -> DataFrame:
    """``df`` with the fingerprint of a text column added."""
    schema = df.drop(out).schema.add(out, "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = pa.array([encode(sketch(s, k)) for s in texts_shingles(batch.column(text))], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, prints], [*batch.schema.names, out])

    return df.drop(out).mapInArrow(run, schema)


def merge_fingerprints(df: DataFrame, key: str, column: str = "fingerprint", k: int = K) -> DataFrame:
    """(key, fingerprint) of each key's parts together; parts merge within
    partitions before they shuffle, so a hot key sends one sketch per partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            for name, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held[name] = merge([held.get(name, np.zeros(0, np.uint64)), decode(s or "")], k)
            if len(held) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(held), pa.array([encode(x) for x in held.values()])], [key, column])
                held = {}
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(held), pa.array([encode(x) for x in held.values()])], [key, column])

    narrow = df.select(F.col(key).cast("string").alias(key), F.col(column).alias(column))
    schema = f"`{key}` string, `{column}` string"
    partial = narrow.mapInArrow(run, schema)
    salted = partial.repartition(F.col(key), F.pmod(F.xxhash64(column), F.lit(16))).mapInArrow(run, schema)
    return salted.repartition(F.col(key)).sortWithinPartitions(key).mapInArrow(_sorted_merge(key, column, k), schema)


def _sorted_merge(key: str, column: str, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held = None, None
        for batch in batches:
            names, out = [], []
            for x, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if held is not None and x == name:
                    held = merge([held, decode(s)], k)
                    continue
                if held is not None:
                    names.append(name)
                    out.append(encode(held))
                name, held = x, decode(s)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(out, pa.string())], [key, column])
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([name], pa.string()), pa.array([encode(held)], pa.string())], [key, column])

    return run


def in_order(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """place, guest, doc_id, text, next_text in the order of falling doc_id within each place; null ids come last.

    next_text is the text of the next row (of the first row, after the last).  Rows
    are dealt into ranges of doc_id; the first rows of each range are also sent, as
    guests, to the end of the range before it, so that each text moves once.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    ids = rows.select("doc_id")
    ranges = max(64, min(4096, ids.count() // 20_000))
    # percentile_approx keeps longs as they are
    spots = F.array(*[F.lit(i / ranges) for i in range(1, ranges)])
    cuts = sorted(set(ids.agg(F.percentile_approx("doc_id", spots, F.lit(4 * ranges))).first()[0] or []))
    cut = F.array(*[F.lit(c).cast("long") for c in cuts]) if cuts else F.array().cast("array<bigint>")
    place = F.when(F.col("doc_id").isNull(), len(cuts)).otherwise(F.size(F.filter(cut, lambda c: c >= F.col("doc_id")))).cast("int")
    # one number a range comes to the driver: its largest doc_id, which is first
    firsts = sorted((r.place, r.first) for r in ids.groupBy(place.alias("place")).agg(F.max("doc_id").alias("first")).collect())
    head = F.lit(None).cast("int")
    if firsts:
        before = {first: firsts[i - 1][0] for i, (_, first) in enumerate(firsts)}
        pairs = [x for first, to in before.items() if first is not None for x in (F.lit(first).cast("long"), F.lit(to))]
        named = F.try_element_at(F.create_map(*pairs), F.col("doc_id")) if pairs else head
        head = F.when(F.col("doc_id").isNull(), F.lit(before.get(None)).cast("int")).otherwise(named)
    to = F.array(F.struct(place.alias("place"), F.lit(0).alias("guest")), F.struct(head.alias("place"), F.lit(1).alias("guest")))
    both = rows.select("doc_id", "text", F.explode(F.filter(to, lambda x: x["place"].isNotNull())).alias("to"))
    w = Window.partitionBy("place").orderBy("guest", F.col("doc_id").desc_nulls_last(), "text")
    return both.select("to.place", "to.guest", "doc_id", "text").withColumn("next_text", F.lead("text").over(w))


COLUMNS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, distinct_shingles double"


def edited_and_near(docs: DataFrame, k: int = K) -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likenesses.

    The edited text has its last floor(n_chars/2) code points replaced by the first
    as many (or all) of the next document's.
    """
    half = F.floor(F.char_length("text") / 2).cast("int")
    edited = F.concat(F.left(F.col("text"), F.char_length("text") - half), F.left(F.coalesce("next_text", F.lit("")), half))
    rows = in_order(docs).select("guest", "doc_id", F.char_length("text").cast("long").alias("n_chars"), "text", edited.alias("edited"))
    rows = rows.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))
    names = [x.split()[0] for x in COLUMNS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row that waits for its next one's sketch
        for batch in batches:
            out: list[list] = []
            own, changed = texts_shingles(batch.column("text")), texts_shingles(batch.column("edited"))
            narrow = zip(*(batch.column(c).to_pylist() for c in ("guest", "doc_id", "n_chars", "edited_sha256")))
            for (guest, doc_id, n_chars, sha), whole, new in zip(narrow, own, changed):
                mine = sketch(whole, k)
                if held is not None:
                    out.append([*held[:-1], resemblance(held[-1], mine, k), distinct_count(held[-1], k)])
                    held = None
                if not guest:
                    other = sketch(new, k)
                    held = [doc_id, n_chars, sha, encode(mine), encode(other), resemblance(mine, other, k), mine]
            if out:
                yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*out)))), schema=types)

    types = pa.schema([(c.split()[0], {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[c.split()[1]]) for c in COLUMNS.split(", ")])
    return rows.mapInArrow(run, COLUMNS)
