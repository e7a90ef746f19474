"""Best-fit packing of token sequences in bulk-synchronous supersteps.

:func:`tokenized` cuts each text's ids into pieces of at most the capacity.  :func:`pack`
puts pieces together in sequences without cutting them again.  In a superstep, pieces are
dealt by hash to parts of about PART rows, and each part packs in a task of its own:
documents and gaps are range-sorted, a sweep finds every document's successor (the
tightest gap it fits into) at once, documents that chose equal gaps are ranked and as many
win as there are gaps, gaps are updated, and the sweep is repeated until nothing fits.
Documents go in ranges of halving size, the largest first; what fits nowhere opens new
sequences, but only as many as it can fill.  The rest of each part, under a sequence's
worth for each range, meets in the next superstep, until one part is left, which opens
what it needs.  A part is bounded whatever one document or size repeats, no part waits
for another within a superstep, and only counts reach the driver.

Defined cases: a null text is empty and has its end mark only; repeated rows, ties and null
ids are pieces of their own; texts of any length are read in slices, cut at white space; an
empty table gives an empty result; other columns pass through :func:`pack`, but for own
columns of the names it adds.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hindcast.llm._spark import materialise
from hindcast.llm._text import _space, buffers, slices

CAPACITY = 2048
END = 0
#: Bytes of text that are encoded together.
SLICE_BYTES = 1 << 22
#: Rows of a part on average.
PART = 131_072
#: Words of which a worker remembers the ids, twice at most.
REMEMBERED = 600_000
#: A word that stands between others while they are encoded together, and marks that end a word.
BETWEEN, MARKS = "\x00", ".,!?;:"
TOGETHER = 256
#: Letters below this one stay one letter in lower case.
PLAIN = "\u0130"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Ids of texts by a word-level BPE vocabulary whose pieces never span white space.

    Distinct words are encoded once, many in one call with a null byte between them.  An
    end of common marks is a word by itself to such vocabularies, and ASCII words are
    lower-cased by them, so words that differ in that alone are encoded once.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}
        self.between = self._alone(BETWEEN)[0]

    def _alone(self, word: str) -> list[int]:
        return self.tokenizer.encode(word, add_special_tokens=False).ids

    def _learn(self, words: list[str]) -> None:
        for w in words:
            if BETWEEN in w:
                self.known[w] = np.array(self._alone(w), "<u4").tobytes()
        plain = [w for w in words if BETWEEN not in w]
        groups = [plain[i : i + TOGETHER] for i in range(0, len(plain), TOGETHER)]
        for group, coded in zip(groups, self.tokenizer.encode_batch_fast([f" {BETWEEN} ".join(g) for g in groups], add_special_tokens=False)):
            ids = np.array(coded.ids, "<u4")
            cuts = np.nonzero(ids == self.between)[0]
            low, high = [0, *(cuts + 1)], [*cuts, len(ids)]
            for w, a, b in zip(group, low, high):
                self.known[w] = ids[a:b].tobytes()

    def _cores(self, words: list[str]) -> list[bytes]:
        """Ids of words not seen lately: of what stands before an end of marks, and of the marks."""
        parts = []
        for w in words:
            core = w.rstrip(MARKS)
            tail = w[len(core) :]
            if tail and not (core[-1:].isalpha() and core[-1] < PLAIN):
                core, tail = w, ""  # marks may belong to what stands before them
            parts.append((core.lower() if core.isascii() and "<" not in core else core, tail))
        self._learn([x for x in dict.fromkeys(x for pair in parts for x in pair) if x not in self.known])
        return [self.known[a] + self.known[b] for a, b in parts]

    def _of_words(self, words: list[str]) -> list[bytes]:
        if len(self.known) > REMEMBERED:
            self.known, self.older = {"": b""}, self.known
        table = list(map(self.known.get, words))
        new = [w for w, ids in zip(words, table) if ids is None]
        if new:
            older = list(map(self.older.get, new))
            self.known.update((w, ids) for w, ids in zip(new, older) if ids is not None)
            fresh = [w for w, ids in zip(new, older) if ids is None]
            self.known.update(zip(fresh, self._cores(fresh)))
            table = list(map(self.known.__getitem__, words))
        return table

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and each text's bounds in them."""
        words = pc.ascii_split_whitespace(texts)
        coded = words.flatten().dictionary_encode()
        ids = pa.array(self._of_words(coded.dictionary.to_pylist()), pa.large_binary()).take(coded.indices)
        _, ends, data = ids.buffers()
        ends = np.frombuffer(ends, np.int64, len(ids) + 1) // 4
        offsets = np.asarray(words.offsets)
        return np.frombuffer(data, "<u4", ends[-1]) if data is not None else np.zeros(0, "<u4"), ends[offsets - offsets[0]]


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _parts(text: pa.Array) -> pa.Array:
    """One long text in parts of about a slice, cut at white space."""
    raw, _ = buffers(text)
    cuts = [0]
    while cuts[-1] + SLICE_BYTES < len(raw):
        at = cuts[-1] + SLICE_BYTES
        while at < len(raw) and not (hit := _space[raw[at : at + 4096]]).any():
            at += 4096
        cuts.append(min(len(raw), at + int(np.argmax(hit))) if at < len(raw) else len(raw))
    return pa.array([raw[a:b].tobytes() for a, b in zip(cuts, [*cuts[1:], len(raw)]) if b > a], pa.binary()).cast(pa.string())


def tokenized(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end: int = END, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece, start, length and ids (little-endian unsigned 32-bit) of every piece."""
    path = vocabulary or default_vocabulary()
    names = ["doc_id", "piece", "start", "length", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        last = np.array([end], "<u4")
        for batch in batches:
            column = batch.column(1).fill_null("")
            for low, high in slices(column, SLICE_BYTES):
                part = column.slice(low, high - low)
                if high - low == 1 and pc.binary_length(part)[0].as_py() > 2 * SLICE_BYTES:
                    whole = np.concatenate([coder.ids(p)[0] for p in (pa.array([x]) for x in _parts(part))])
                    ids, bounds = whole, np.array([0, len(whole)])
                else:
                    ids, bounds = coder.ids(part)
                rows, pieces, starts, lengths, coded = [], [], [], [], []
                for i in range(high - low):
                    own = np.concatenate([ids[bounds[i] : bounds[i + 1]], last])
                    for piece, start in enumerate(range(0, len(own), capacity)):
                        cut = own[start : start + capacity]
                        rows.append(i)
                        pieces.append(piece)
                        starts.append(start)
                        lengths.append(len(cut))
                        coded.append(cut.tobytes())
                out = [batch.column(0).slice(low, high - low).take(pa.array(rows, pa.int64())), pa.array(pieces, pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(coded, pa.binary())]
                yield pa.RecordBatch.from_arrays(out, names)

    key = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {key}, piece int, start long, length long, ids binary")


def sweep(sizes: np.ndarray, gaps: np.ndarray) -> np.ndarray:
    """Gap of each document (-1: none) after one successor sweep; both arrays are sorted, sizes
    falling and gaps rising.  Of the documents whose tightest gap has one size, the first win."""
    at = np.searchsorted(gaps, sizes)
    begins = np.concatenate([[True], at[1:] != at[:-1]])
    rank = np.arange(len(at)) - np.maximum.accumulate(np.where(begins, np.arange(len(at)), 0))
    if not len(gaps):
        return np.full(len(sizes), -1)
    equal = np.searchsorted(gaps, gaps[np.minimum(at, len(gaps) - 1)], "right") - at
    return np.where((at < len(gaps)) & (rank < equal), at + rank, -1)


def pack_part(sizes: np.ndarray, capacity: int, last: bool) -> tuple[np.ndarray, np.ndarray]:
    """Sequence (-1: left for the next superstep) and offset of each size."""
    order = np.argsort(-sizes, kind="stable")
    ranged = sizes[order]
    sequence, offset = np.full(len(sizes), -1, np.int64), np.zeros(len(sizes), np.int64)
    gaps, opened = np.zeros(0, np.int64), np.zeros(0, np.int64)  # rising, and whose they are
    begun, top = 0, capacity
    held = np.zeros(0, np.int64)  # places in ``order`` that await their turn
    while top >= 1:
        low = top // 2
        new = np.arange(np.searchsorted(-ranged, -top), np.searchsorted(-ranged, -low))  # low < size <= top
        held = np.concatenate([held, new])
        while len(held):
            chosen = sweep(ranged[held], gaps)
            won = chosen >= 0
            if not won.any():
                total = int(ranged[held].sum())
                n = len(held) if low >= capacity // 2 else -(-total // capacity) if last else total // capacity
                if not n:
                    break
                placed, held = held[:n], held[n:]
                sequence[order[placed]] = np.arange(begun, begun + n)
                gaps = np.concatenate([gaps, capacity - ranged[placed]])
                opened = np.concatenate([opened, np.arange(begun, begun + n)])
                begun += n
            else:
                placed, at = held[won], chosen[won]
                held = held[~won]
                sequence[order[placed]], offset[order[placed]] = opened[at], capacity - gaps[at]
                gaps[at] -= ranged[placed]
            by = np.argsort(gaps, kind="stable")
            by = by[gaps[by] > 0]
            gaps, opened = gaps[by], opened[by]
        top = low
    return sequence, offset


def pack(pieces: DataFrame, capacity: int = CAPACITY, length: str = "length", part: int = PART) -> DataFrame:
    """``pieces`` with sequence_id and offset: sequences of at most ``capacity`` in all.

    A piece's length must be from 1 to the capacity.
    """
    whole = pieces.drop("sequence_id", "offset")
    rows = whole.select(F.struct(*[F.col(f"`{c}`") for c in whole.columns]).alias("row"), F.col(length).cast("long").alias("size"), F.monotonically_increasing_id().alias("key"))
    rows = materialise(rows, "pack-pieces")
    done = [rows.where(F.col("size") >= capacity).select("row", (-1 - F.col("key")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    left, level = rows.where(F.col("size") < capacity), 0
    while True:
        parts = max(1, -(-left.count() // part))
        dealt = left.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(parts)))
        schema = left.select("row", "size", "key").schema.add("sequence_id", "long").add("offset", "long")
        found = dealt.groupBy("part").applyInArrow(_packer(capacity, parts == 1, level), schema)
        if parts == 1:
            done.append(found.select("row", "sequence_id", "offset"))
            break
        found = materialise(found, f"pack-{level}")
        done.append(found.where("sequence_id is not null").select("row", "sequence_id", "offset"))
        left, level = found.where("sequence_id is null").select("row", "size", "key"), level + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select("row.*", "sequence_id", "offset")


def _packer(capacity: int, last: bool, level: int):
    def run(table: pa.Table) -> pa.Table:
        sizes = table.column("size").to_numpy()
        # ties in size by key, so that reruns of a task agree
        by = np.argsort(table.column("key").to_numpy(), kind="stable")
        sequence, offset = np.empty(len(by), np.int64), np.empty(len(by), np.int64)
        sequence[by], offset[by] = pack_part(sizes[by], capacity, last)
        number = table.column("part")[0].as_py() if len(by) else 0
        named = pa.array(sequence + ((level << 58) | (number << 20)), mask=sequence < 0)
        return table.select(["row", "size", "key"]).append_column("sequence_id", named).append_column("offset", pa.array(offset))

    return run


def sequences(packed: DataFrame, ids: str = "ids") -> DataFrame:
    """(sequence_id, ids) of whole sequences, their pieces in place; ``packed`` holds the pieces' ids."""
    inside = F.array_sort(F.collect_list(F.struct("offset", F.col(ids).alias("ids"))))
    return packed.groupBy("sequence_id").agg(F.aggregate(inside, F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"])).alias("ids"))
