"""How sources of one language differ in their words: an audit over an inverted index.

The index is built by single-pass in-memory indexing.  A task takes rows until their
texts fill a block, turns the block into postings (term, source, occurrences, and the
documents that hold the term), and spills them as one term-sorted run, cut by hash of the
term into shards.  A shard's runs meet in one task, which merges their chunks with a heap
over the chunks' last terms: what no later chunk can add to is summed and kept if enough
documents of its language hold it.  Chunks that wait are merged among themselves when they
fill the memory, so a task holds a block, or the distinct postings of a part of a shard.
A frequent term or source is at most one posting a block, so no shard grows with it.

The divergence of two sources sums ``|p - q|`` over all kept terms.  It starts from what
terms absent from both add, then each source's own terms correct it against each other
source's constant, and the terms that both hold are streamed as pair corrections, summed in
the task up to PAIRS and spilled beyond.

Terms are maximal runs of ASCII letters and non-ASCII characters, A-Z in lower case.
Defined cases: null text, lang and source are ''; a source without kept terms has the
constant share everywhere; a language without kept terms has value 0 for each pair; equal
values rank by item; repeated rows count as often as they are there; an empty table gives
an empty result; texts of any length are one document; other columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hindcast.llm._spark import materialise
from hindcast.llm._text import buffers, slices

LEAST_DOCUMENTS, SMOOTHING, SCALE, TOP = 30, 5, 1_000_000_000, 50
#: Bytes of text in a block, terms in a chunk, terms that may wait in a merge, pairs held before a spill.
BLOCK, CHUNK, WAITING, PAIRS = 10 << 20, 4096, 1 << 17, 1 << 19

_term = np.full(256, 0x20, np.uint8)
_term[0x61:0x7B] = np.arange(0x61, 0x7B)
_term[0x41:0x5B] = np.arange(0x61, 0x7B)
_term[0x80:] = np.arange(0x80, 0x100)


def terms_of(texts: pa.Array) -> pa.ListArray:
    """The terms of each text."""
    raw, offsets = buffers(texts)
    plain = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(offsets), pa.py_buffer(_term[raw]))
    return pc.ascii_split_whitespace(plain)


def _summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys, rising, and the sums of the values of each."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.nonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))[0] if len(keys) else np.zeros(0, np.int64)
    return (keys[first], *(np.add.reduceat(v[order], first) if len(first) else v[:0] for v in values))


class Postings:
    """Term-sorted postings of one language: per term its documents, per (term, source) the occurrences."""

    def __init__(self, terms: list[bytes], documents: np.ndarray, fan: np.ndarray, sources: np.ndarray, counts: np.ndarray):
        self.terms, self.documents, self.fan, self.sources, self.counts = terms, documents, fan, sources, counts

    def cut(self, low: int, high: int) -> Postings:
        a, b = int(self.fan[:low].sum()), int(self.fan[:high].sum())
        return Postings(self.terms[low:high], self.documents[low:high], self.fan[low:high], self.sources[a:b], self.counts[a:b])

    def take(self, at: np.ndarray) -> Postings:
        ends = np.cumsum(self.fan)
        n = self.fan[at]
        rows = np.repeat(ends[at] - np.cumsum(n), n) + np.arange(n.sum())
        return Postings([self.terms[i] for i in at], self.documents[at], n, self.sources[rows], self.counts[rows])


def merged(parts: list[Postings]) -> Postings:
    """The sums of postings whose terms may meet."""
    terms = pa.array([t for p in parts for t in p.terms], pa.binary()).dictionary_encode()
    named = terms.dictionary.to_pylist()
    rank = np.empty(len(named), np.int64)
    order = sorted(range(len(named)), key=named.__getitem__)
    rank[order] = np.arange(len(named))
    code = rank[terms.indices.to_numpy(zero_copy_only=False)] if len(terms) else np.zeros(0, np.int64)
    fan = np.concatenate([p.fan for p in parts])
    sources, counts = np.concatenate([p.sources for p in parts]), np.concatenate([p.counts for p in parts])
    _, documents = _summed(code, np.concatenate([p.documents for p in parts]))
    wide = int(sources.max()) + 1 if len(sources) else 1
    keys, counts = _summed(np.repeat(code, fan) * wide + sources, counts)
    return Postings([named[i] for i in order], documents, np.bincount(keys // wide, minlength=len(named)), keys % wide, counts)


def block_postings(texts: pa.Array, groups: np.ndarray, langs: np.ndarray) -> Iterator[tuple[int, Postings]]:
    """(language, postings by group) of one block; ``groups`` and ``langs`` number each row's."""
    words = terms_of(texts)
    coded = words.flatten().dictionary_encode()
    named = coded.dictionary.cast(pa.large_binary()).to_pylist()
    rank = np.empty(len(named), np.int64)
    order = sorted(range(len(named)), key=named.__getitem__)
    rank[order] = np.arange(len(named))
    named = [named[i] for i in order]
    code = rank[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(texts)), np.diff(np.asarray(words.offsets)))
    if len(named) and named[0] == b"":
        code, row = code[code > 0], row[code > 0]
    n = len(texts)
    pairs, counts = _summed(code * n + row, np.ones(len(code), np.int64))
    code, row = pairs // n if n else pairs, pairs % n if n else pairs
    for lang in np.unique(langs):
        mine = langs[row] == lang
        t, g, c = code[mine], groups[row[mine]], counts[mine]
        ids, documents = _summed(t, np.ones(len(t), np.int64))
        wide = int(groups.max()) + 1
        keys, sums = _summed(t * wide + g, c)
        fan = np.bincount(np.searchsorted(ids, keys // wide), minlength=len(ids))
        yield int(lang), Postings([named[i] for i in ids], documents, fan, keys % wide, sums)


RUNS = "shard int, lang string, first binary, last binary, terms binary, documents binary, fan binary, source binary, counts binary, sources array<string>"


def runs(docs: DataFrame, shards: int, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """Term-sorted runs of the blocks of lang, source and text, in chunks by hash shard."""
    types = pa.schema([("shard", pa.int32()), ("lang", pa.string()), *[(c, pa.binary()) for c in ("first", "last", "terms", "documents", "fan", "source", "counts")], ("sources", pa.list_(pa.string()))])

    def spill(table: pa.Table) -> Iterator[pa.RecordBatch]:
        lang, source = (table.column(c).combine_chunks().dictionary_encode() for c in ("lang", "source"))
        langs, groups = (x.indices.to_numpy(zero_copy_only=False).astype(np.int64) for x in (lang, source))
        names, sources = lang.dictionary.to_pylist(), source.dictionary.to_pylist()
        for k, found in block_postings(table.column("text").combine_chunks(), groups, langs):
            shard = np.fromiter((zlib.crc32(t) % shards for t in found.terms), np.int64, len(found.terms))
            rows = []
            by = np.argsort(shard, kind="stable")
            cuts = np.searchsorted(shard[by], np.arange(shards + 1))
            for s in np.nonzero(np.diff(cuts))[0]:
                own = by[cuts[s] : cuts[s + 1]]
                for low in range(0, len(own), chunk):
                    p = found.take(own[low : low + chunk])
                    used, at = np.unique(p.sources, return_inverse=True)
                    numbers = [x.astype("<i8").tobytes() for x in (p.documents, p.fan, at, p.counts)]
                    rows.append((int(s), names[k], p.terms[0], p.terms[-1], b"\n".join(p.terms), *numbers, [sources[i] for i in used]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), types)], schema=types)
        pa.default_memory_pool().release_unused()  # a block's arrays go back before the next block

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for low, high in slices(batch.column("text"), block):
                part = batch.slice(low, high - low)
                more = pc.sum(pc.binary_length(part.column("text"))).as_py() or 0
                if held and size + more > block:
                    yield from spill(pa.Table.from_batches(held))
                    held, size = [], 0
                held.append(part)
                size += more
        if held:
            yield from spill(pa.Table.from_batches(held))

    return docs.select("lang", "source", "text").mapInArrow(run, RUNS)


FREQUENCIES = "lang string, term string, sources array<string>, counts array<bigint>"


class Merge:
    """The heap merge of one language's chunks in one shard, by rising first term."""

    def __init__(self, least: int, waiting: int):
        self.least, self.waiting, self.limit = least, waiting, waiting
        self.numbers: dict[str, int] = {}
        self.heap: list[tuple[bytes, int, Postings]] = []
        self.size = self.serial = 0

    def add(self, p: Postings, sources: list[str]) -> Iterator[Postings]:
        if self.size > self.limit:
            yield from self.below(p.terms[0])
        number = np.fromiter((self.numbers.setdefault(s, len(self.numbers)) for s in sources), np.int64, len(sources))
        p.sources = number[p.sources]
        self._push(p)

    def _push(self, p: Postings) -> None:
        if p.terms:
            self.serial += 1
            self.size += len(p.terms)
            heapq.heappush(self.heap, (p.terms[-1], self.serial, p))

    def below(self, first: bytes | None) -> Iterator[Postings]:
        """Sums of all terms under ``first`` (None: all); the rest waits, merged."""
        done, rest = [], []
        while self.heap:
            last, _, p = heapq.heappop(self.heap)
            if first is None or last < first:
                done.append(p)
                continue
            at = bisect_left(p.terms, first)
            done.append(p.cut(0, at))
            rest.append(p.cut(at, len(p.terms)))
        self.size = 0
        if rest:
            self._push(merged(rest))
        self.limit = max(self.waiting, 2 * self.size)
        if done:
            whole = merged(done)
            yield whole.take(np.nonzero(whole.documents >= self.least)[0])


def frequencies(spilled: DataFrame, least: int = LEAST_DOCUMENTS, waiting: int = WAITING) -> DataFrame:
    """lang, term, sources and counts of every term that ``least`` documents of its language hold."""
    types = pa.schema([("lang", pa.string()), ("term", pa.string()), ("sources", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])

    def rows(lang: str, names: list[str], kept: Iterator[Postings]) -> Iterator[pa.RecordBatch]:
        for p in kept:
            ends = pa.array(np.concatenate([[0], np.cumsum(p.fan)]), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, v) for v in (pa.array(names, pa.string()).take(pa.array(p.sources)), pa.array(p.counts))]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(p.terms), pa.string()), pa.array(p.terms, pa.binary()).cast(pa.string()), *lists], schema=types)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, merge = None, None
        for batch in batches:
            columns = [batch.column(c) for c in ("shard", "lang", "terms", "documents", "fan", "source", "counts", "sources")]
            for shard, lang, terms, documents, fan, source, counts, sources in ([c[i].as_py() for c in columns] for i in range(batch.num_rows)):
                if (shard, lang) != now:
                    if merge is not None:
                        yield from rows(now[1], list(merge.numbers), merge.below(None))
                    now, merge = (shard, lang), Merge(least, waiting)
                p = Postings(terms.split(b"\n"), *(np.frombuffer(x, "<i8") for x in (documents, fan, source, counts)))
                yield from rows(lang, list(merge.numbers), merge.add(p, sources))
        if merge is not None:
            yield from rows(now[1], list(merge.numbers), merge.below(None))

    ordered = spilled.repartition("shard").sortWithinPartitions("shard", "lang", "first", "last")
    return ordered.drop("first", "last").mapInArrow(run, FREQUENCIES)


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + SMOOTHING) / (total + SMOOTHING * terms)), exactly."""
    wide = lambda c: c.cast("decimal(20,0)")
    top, bottom = wide(count + SMOOTHING) * F.lit(SCALE).cast("decimal(10,0)"), wide(total + SMOOTHING * terms)
    return F.floor((top - top % bottom) / bottom).cast("long") + 1


PAIRED = "lang string, a int, b int, more long"


def both_held(shares: DataFrame, limit: int = PAIRS) -> DataFrame:
    """(lang, a, b, more) for a < b: what the terms that both sources hold add to the pair's sum beyond
    what each source's own correction has.  ``shares`` has lang and held, an array of (g, p, z): the
    source's number, its share of the term and of an absent one."""
    types = pa.schema([("lang", pa.string()), ("a", pa.int32()), ("b", pa.int32()), ("more", pa.int64())])

    def corrections(g: np.ndarray, p: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys and values of all pairs of k terms that m sources each hold."""
        i, j = np.triu_indices(g.shape[1], 1)
        away = lambda x, y: np.abs(x[:, i] - y[:, j])
        return ((g[:, i] << 32) | g[:, j]).ravel(), (away(p, p) - away(p, z) - away(z, p) + away(z, z)).ravel()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def spill() -> Iterator[pa.RecordBatch]:
            for lang, (keys, sums) in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys >> 32, pa.int32()), pa.array(keys & 0xFFFFFFFF, pa.int32()), pa.array(sums)], schema=types)
            held.clear()

        for batch in batches:
            lists = batch.column("held")
            fan = np.diff(np.asarray(lists.offsets))
            g, p, z = (lists.flatten().field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("g", "p", "z"))
            starts = np.cumsum(fan) - fan
            lang = batch.column("lang").dictionary_encode()
            for k, name in enumerate(lang.dictionary.to_pylist()):
                mine = lang.indices.to_numpy(zero_copy_only=False) == k
                for m in np.unique(fan[mine & (fan > 1)]):
                    own = starts[mine & (fan == m)]
                    step = max(1, limit // int(m * m))
                    for low in range(0, len(own), step):
                        at = own[low : low + step, None] + np.arange(m)
                        keys, sums = corrections(g[at], p[at], z[at])
                        old = held.get(name, (keys[:0], sums[:0]))
                        held[name] = _summed(np.concatenate([old[0], keys]), np.concatenate([old[1], sums]))
                if sum(len(x[0]) for x in held.values()) > limit:
                    yield from spill()
        yield from spill()

    return shares.select("lang", "held").mapInArrow(run, PAIRED).groupBy("lang", "a", "b").agg(F.sum("more").alias("more"))


def audit(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """lang, source, part, item, value and rank: how far each source is from each other one, and
    the terms that it has most beyond its language."""
    spark = docs.sparkSession
    plain = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))])
    shards = max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
    kept = materialise(frequencies(runs(plain, shards), least), "divergence-terms")
    held = kept.select("lang", "term", F.explode(F.arrays_zip("sources", "counts")).alias("x")).select("lang", "term", F.col("x.sources").alias("source"), F.col("x.counts").alias("count"))
    # one row a group: numbers, sums and the share of an absent term
    sums = held.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    terms = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    groups = plain.select("lang", "source").distinct().join(terms, "lang", "left").join(sums, ["lang", "source"], "left").na.fill(0, ["v", "n"])
    absent = F.when(F.col("v") > 0, share(F.lit(0).cast("long"), F.col("n"), F.col("v"))).otherwise(0)
    number = (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).cast("int")
    groups = materialise(groups.select("lang", "source", "v", "n", absent.alias("z"), number.alias("g")), "divergence-groups")
    shared = held.join(groups, ["lang", "source"]).withColumn("p", share(F.col("count"), F.col("n"), F.col("v")))
    return _pairs(shared, groups).unionByName(_terms(shared, kept, top)).select("lang", "source", "part", "item", "value", "rank")


def _ranked(rows: DataFrame, part: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))
    return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", rank.cast("int").alias("rank"))


def _terms(shared: DataFrame, kept: DataFrame, top: int) -> DataFrame:
    whole = kept.select("lang", "term", F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x).alias("all"))
    of = whole.groupBy("lang").agg(F.sum("all").alias("total"), F.count(F.lit(1)).alias("v"))
    mean = whole.join(of, "lang").select("lang", "term", share(F.col("all"), F.col("total"), F.col("v")).alias("q"))
    rows = shared.join(mean, ["lang", "term"]).where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    return _ranked(rows, "term").where(F.col("rank") <= top)


def _pairs(shared: DataFrame, groups: DataFrame) -> DataFrame:
    """Every ordered pair of sources of a language: this is the result's own size."""
    one, other = (groups.select("lang", *[F.col(c).alias(c + i) for c in ("source", "z", "g")], "v") for i in "12")
    pairs = one.join(other.drop("v"), "lang").where("g1 <> g2")
    # a source's own terms against another's constant: terms of one share count together
    own = shared.groupBy("lang", F.col("g").alias("g1"), F.col("z").alias("z1"), "p").agg(F.count(F.lit(1)).alias("terms"))
    away = F.abs(F.col("p") - F.col("z2")) - F.abs(F.col("z1") - F.col("z2"))
    one_sided = own.join(other.select("lang", "g2", "z2"), "lang").where("g1 <> g2").groupBy("lang", "g1", "g2").agg(F.sum(away * F.col("terms")).alias("own"))
    lists = shared.groupBy("lang", "term").agg(F.array_sort(F.collect_list(F.struct("g", "p", "z"))).alias("held"))
    met = both_held(lists)
    both = met.select("lang", F.col("a").alias("g1"), F.col("b").alias("g2"), "more").unionByName(met.select("lang", F.col("b").alias("g1"), F.col("a").alias("g2"), "more"))
    turned = one_sided.select("lang", F.col("g2").alias("g1"), F.col("g1").alias("g2"), F.col("own").alias("others"))
    by = ["lang", "g1", "g2"]
    rows = pairs.join(one_sided, by, "left").join(turned, by, "left").join(both, by, "left").na.fill(0, ["own", "others", "more"])
    value = F.col("v") * F.abs(F.col("z1") - F.col("z2")) + F.col("own") + F.col("others") + F.col("more")
    return _ranked(rows.select("lang", F.col("source1").alias("source"), F.col("source2").alias("item"), value.cast("long").alias("value")), "pair")
