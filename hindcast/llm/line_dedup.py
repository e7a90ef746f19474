"""Line dedup by an exact set-similarity join; DataFrame functions only.

A line is the set of its words.  Lines of one set are one: the earliest, by
(doc_id, line number), stands for it.  Words are ordered by rarity over the whole
corpus (a table of 2^16 hashed counts, so its size is fixed), and the first
n - ceil(0.8 n) + 1 words of each set, its prefix, are joined: two sets of Jaccard
similarity 0.8 share a prefix word, which is among the first n - ceil(8 n / 9) + 1 of the
smaller.  It also meets only sets of up to 1.25 times its size, so the join's key holds a
class of sizes besides the word.  Length and position of the shared word and a
128-bit parity signature of the words bound the overlap from above inside the join
condition (64 bits in shorter sets); what passes is verified on the words themselves.  A line goes if an
earlier line of the corpus, kept or not, equals or resembles it.

Families of many variants would give all pairs.  So each set is first checked
against the earliest that shares a group of its commonest words and against earlier
ones picked by hash, a linear number of pairs; only sets that this leaves are joined
with all.  Hot groups are cut into parts.

A row is known by its id and a hash of its text (of a null id by 104 bits of such
hashes), a set by 128 bits: of its words where it has fewer than four, else of 56
bits a word.

Defined cases: null text is a document without lines; lines without words stay; a
null doc_id is last in order; rows of one id are told apart by their texts, and of
rows equal in both the first keeps the lines; the empty table gives an empty
result; other columns stay as they are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hindcast.llm._spark import ascii_words, bitmap_filter, filter_bits, materialise, might_contain, set_aside, set_back, single_blanks

RARITY_CELLS = 1 << 16  # as many groups as Spark's fast map of an aggregation holds
LAST = 2**63 - 1  # null ids are ordered below it
#: Cells in which groups of sets with common words are counted, and the parts that those
#: of a cell with over 1/512 of all sets are cut into, each with a first of its own.
GROUP_CELLS, HOT_SHARE, PARTS = 4096, 512, 64
#: Earlier sets of a group, besides its first, that each set is checked against: where variants
#: resemble each other more often than their first, one of these is likely near.
PICKS = 3
#: Words of a set from which on a second signature is worth its making: fewer than 21 words
#: may differ in shorter ones, where 64 bits tell strangers well.
LONG_SET = 96
#: A class of sizes spans at most this ratio: a set meets at most two classes.
SIZE_RATIO = 1.25**2
SOLID = r"[^\x20\x09-\x0D]"


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _keys(doc_id: str, text: str) -> list[Column]:
    """d, e: the order and identity of a row."""
    none = F.lit(LAST).cast("long") - F.xxhash64(F.lit("none"), F.col(text)).bitwiseAND(F.lit((1 << 40) - 1))
    return [F.coalesce(F.col(doc_id).cast("long"), none).alias("d"), F.xxhash64(F.col(text)).alias("e")]


def _word_hash(word: Column) -> Column:
    """56 bits, so that a class fits above them."""
    return F.shiftrightunsigned(F.xxhash64(word), 8)


def _cell(hashed: Column) -> Column:
    return hashed.bitwiseAND(F.lit(RARITY_CELLS - 1)).cast("int")


def _rarity(docs: DataFrame, text: str) -> Column:
    """array<byte>: a class (3 a doubling) for each of the hashed counts of all words.

    RARITY_CELLS numbers, whatever the corpus, which the driver holds as a constant of the next job.
    Spark prints it in every event of that job's plan, so it is kept short.
    """
    words = docs.select(F.explode(F.split(single_blanks(F.col(text)), " ")).alias("w")).where("w <> ''")
    counts = words.groupBy(_cell(_word_hash(F.col("w"))).alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    classes = ["0"] * RARITY_CELLS
    for r in counts.select("cell", F.least(F.floor(3 * F.log2(F.col("n") + 1)), F.lit(126)).cast("int").alias("c")).toLocalIterator():
        classes[r.cell] = str(r.c)
    return F.split(F.lit(",".join(classes)), ",").cast("array<tinyint>")


def _sets(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """One row a distinct set of words: d, e, l (its first line), n, two signatures, hashes of three groups of its commonest words, prefix."""
    rarity = _rarity(docs, text)
    # keyed before the lines part, or each line would hash the whole text again; an inner
    # explode, or a filter here, would have Spark compute what it tests twice
    lines = docs.select(*_keys(doc_id, text), lines_of(F.col(text)).alias("lines")).select("d", "e", F.posexplode_outer("lines").alias("l", "line"))
    # the line goes along and not its words: an array of them would be copied at each step
    words = lambda: ascii_words(F.col("line"), inside=True)
    hashed = lines.select("d", "e", "l", "line", F.array_distinct(F.transform(words(), _word_hash)).alias("h"))
    # no element is null, which Spark sorts as plain numbers once it is said
    rank = lambda h: F.coalesce(F.shiftleft(F.get(rarity, _cell(h)).cast("long"), 56).bitwiseOR(h), F.lit(0).cast("long"))
    few = F.when(F.size("h") < 4, F.array_join(F.array_sort(F.array_distinct(words())), " "))
    ranked = hashed.select("d", "e", "l", few.alias("few"), F.sort_array(F.transform("h", rank)).alias("t"))
    n = F.size("t")
    # a word flips the bit of sig that those from 34 on name (a shift takes six of them); those with bit 20, of long sets, also that of sig2
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    flip = lambda on: lambda a, h: a.bitwiseXOR(F.call_function("shiftleft", on(h), F.shiftright(h, 34).cast("int")))
    sig = F.aggregate("t", none, flip(lambda h: one))
    sig2 = F.when(n >= LONG_SET, F.aggregate("t", none, flip(lambda h: F.shiftright(h, 20).bitwiseAND(one)))).otherwise(none)
    some = ranked.select(
        *[F.when(F.col("few").isNotNull(), F.xxhash64(F.lit(i), "few")).otherwise(F.xxhash64(F.lit(i), "t")).alias(f"k{i}") for i in range(2)],
        "d", "e", "l", n.alias("n"), sig.alias("sig"), sig2.alias("sig2"),
        *[F.xxhash64(F.slice("t", F.greatest(n - 9 * (i + 1), F.lit(1)), F.lit(9)), F.lit(i)).alias(f"b{i}") for i in range(3)],
        F.transform(F.slice("t", 1, n - F.ceil(n * 4 / 5).cast("int") + 1), lambda t: t.bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")).alias("prefix"),
    )
    first = some.groupBy("k0", "k1").agg(F.min(F.struct("d", "e", "l", "n", "sig", "sig2", "b0", "b1", "b2", "prefix")).alias("s"))
    return first.select("s.*").where("n > 0")


def _may_resemble(nx: Column, ny: Column, x: str = "x", y: str = "y") -> Column:
    """Length and signature bounds of Jaccard >= 0.8 between two sides of a join."""
    total = nx + ny
    apart = total - 2 * F.floor((total * 4 + 8) / 9)  # words that one of the two alone may have
    near = (nx * 5 >= ny * 4) & (ny * 5 >= nx * 4)
    one, two = (F.col(f"{x}.{c}").bitwiseXOR(F.col(f"{y}.{c}")) for c in ("sig", "sig2"))
    # sig2 is a part of sig: with it, the bits that each part flips count apart
    flips = F.when((nx >= LONG_SET) & (ny >= LONG_SET), F.bit_count(two) + F.bit_count(one.bitwiseXOR(two))).otherwise(F.bit_count(one))
    return near & (apart > 0) & (flips <= apart)


LINE, OTHER = ["d", "e", "l"], ["d2", "e2", "l2"]


def _ends(x: str, y: str) -> list[Column]:
    return [F.col(f"{x}.{c}") for c in LINE] + [F.col(f"{y}.{c}").alias(o) for c, o in zip(LINE, OTHER)]


def _verified(pairs: DataFrame, docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(d, e, l) of the first lines of pairs that resemble, checked word by word.

    pairs is a line and an earlier one.  The documents are thinned where they stand
    by bounded filters, and only the lines of pairs move.
    """
    pairs = materialise(pairs.distinct(), "line-pairs")
    ends = pairs.select(*LINE).unionByName(pairs.select(*[F.col(o).alias(c) for c, o in zip(LINE, OTHER)])).distinct()
    ends = materialise(ends.withColumn("row", F.xxhash64("d", "e")).withColumn("key", F.xxhash64(*LINE)), "line-ends")
    bits = filter_bits(ends.count())
    some = docs.select(*_keys(doc_id, text), F.col(text).alias("text")).withColumn("row", F.xxhash64("d", "e"))
    some = might_contain(some, "row", bitmap_filter(ends, "row", bits), bits, "maybe").where("maybe").select("d", "e", "text")
    lines = some.select("d", "e", F.posexplode(lines_of(F.col("text"))).alias("l", "line")).withColumn("key", F.xxhash64(*LINE))
    lines = might_contain(lines, "key", bitmap_filter(ends, "key", bits), bits, "maybe").where("maybe")
    words = lines.join(ends.select(*LINE).hint("merge"), LINE, "left_semi").groupBy(*LINE).agg(F.first("line").alias("line"))
    words = words.select(*LINE, F.array_distinct(ascii_words(F.col("line"), inside=True)).alias("words"))
    other = words.select(*[F.col(c).alias(o) for c, o in zip(LINE, OTHER)], F.col("words").alias("others"))
    both = pairs.join(words.hint("merge"), LINE).join(other.hint("merge"), OTHER)
    shared = F.size(F.array_intersect("words", "others"))
    return both.where(shared * 9 >= (F.size("words") + F.size("others")) * 4).select(*LINE).distinct()


def _size_class(n: Column) -> Column:
    return F.floor(F.log(n) / math.log(SIZE_RATIO)).cast("int")


def _postings(flagged: DataFrame) -> DataFrame:
    """key, id, packed, sig, sig2: each set under its words and class of sizes, and, for
    larger sets to find it, under the first of its words and the next class (up).

    packed is n | position | out | up in one number, as these rows are most of what is
    shuffled; key is a hash of word and class.
    """
    n, own = F.col("n"), _size_class(F.col("n"))
    sets = flagged.select("id", "n", "sig", "sig2", "out", "prefix", F.explode(F.sequence(own, _size_class(F.floor(n * 5 / 4)))).alias("size"))
    up = F.col("size") > own
    prefix = F.when(up, F.slice("prefix", 1, n - F.floor((8 * n + 8) / 9).cast("int") + 1)).otherwise(F.col("prefix"))
    words = sets.select("id", "n", "sig", "sig2", "out", "size", up.cast("int").alias("up"), F.posexplode(prefix).alias("p", "token"))
    packed = ((n.cast("long") * (1 << 24) + F.col("p")) * 2 + F.col("out")) * 2 + F.col("up")
    return words.select(F.hash("token", "size").alias("key"), "id", packed.alias("packed"), "sig", "sig2")


def first_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(d, e, l): row and line number of every line with words that stays."""
    sets = _sets(docs, doc_id, text).withColumn("id", F.monotonically_increasing_id())
    sets = materialise(sets, "line-sets", hashes=True)
    able = sets.where("n >= 4")  # smaller sets resemble only themselves

    line = F.struct(*LINE, "n", "sig", "sig2")
    grouped = able.select(*LINE, "n", "sig", "sig2", F.explode(F.array("b0", "b1", "b2")).alias("b"))
    cell = F.pmod(F.col("b"), F.lit(GROUP_CELLS))
    held = {r.cell: r.n for r in grouped.groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("n")).collect()}
    hot = [c for c, n in held.items() if n * HOT_SHARE > sum(held.values())]
    grouped = grouped.withColumn("part", F.when(cell.isin(hot), F.pmod(F.xxhash64(*LINE), F.lit(PARTS))).otherwise(F.lit(0)))
    earlier = Window.partitionBy("b", "part").orderBy(*LINE).rowsBetween(Window.unboundedPreceding, -1)
    picked = [F.min_by(line, F.xxhash64(F.lit(i), *LINE)).over(earlier) for i in range(PICKS)]  # a running least hash falls on each earlier set alike
    led = grouped.select(line.alias("x"), F.array(F.first(line).over(earlier), *picked).alias("ys")).where("ys[0] is not null")
    near = led.select("x", F.explode(F.array_distinct("ys")).alias("y")).where(_may_resemble(F.col("x.n"), F.col("y.n")))
    gone = materialise(_verified(near.select(*_ends("x", "y")), docs, doc_id, text), "line-gone")

    flagged = able.join(gone.withColumn("out", F.lit(1)).hint("merge"), LINE, "left").withColumn("out", F.coalesce("out", F.lit(0)))
    postings = _postings(flagged)
    x, y = postings.alias("x"), postings.alias("y")  # the larger and the smaller set
    n = {c: F.shiftright(F.col(f"{c}.packed"), 26).cast("int") for c in "xy"}
    p = {c: F.shiftright(F.col(f"{c}.packed"), 2).bitwiseAND(F.lit((1 << 24) - 1)).cast("int") for c in "xy"}
    out = {c: F.shiftright(F.col(f"{c}.packed"), 1).bitwiseAND(F.lit(1)) for c in "xy"}
    # two-sided, so that both sides stay one exchange
    own = F.col("x.packed").bitwiseAND(F.lit(1)) * (n["y"] + 1) == 0
    larger = (n["x"] > n["y"]) | ((n["x"] == n["y"]) & (F.col("x.id") > F.col("y.id")))
    placed = F.least(n["x"] - p["x"], n["y"] - p["y"]) >= F.floor(((n["x"] + n["y"]) * 4 + 8) / 9)  # with the shared word
    open_ = out["x"] * out["y"] == 0
    joined = x.join(y, (F.col("x.key") == F.col("y.key")) & larger & own & placed & open_ & _may_resemble(n["x"], n["y"]))
    pairs = joined.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), out["x"].alias("out_a"), out["y"].alias("out_b")).distinct()
    ends = sets.select("id", F.struct(*LINE).alias("line")).hint("merge")
    for c in "ab":
        pairs = pairs.join(ends.select(F.col("id").alias(c), F.struct("line.*", F.lit(c).alias("side")).alias(f"line_{c}")), c)
    pairs = pairs.withColumn("x", F.greatest("line_a", "line_b")).withColumn("y", F.least("line_a", "line_b"))
    pairs = pairs.where(F.when(F.col("x.side") == "a", F.col("out_a")).otherwise(F.col("out_b")) == 0)  # the later is still in
    more = materialise(_verified(pairs.select(*_ends("x", "y")), docs, doc_id, text), "line-gone")
    return sets.select(*LINE).join(gone.unionByName(more).hint("merge"), LINE, "left_anti")


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with later lines taken out of the text; n_lines and n_removed added."""
    kept = first_lines(docs, doc_id, text).groupBy(F.col("d").alias("_kd"), F.col("e").alias("_ke")).agg(F.collect_list("l").alias("_kept"))
    # texts without words keep all their lines and meet nothing: they are spread
    d, e = _keys(doc_id, text)
    some = F.coalesce(F.col(text).rlike(SOLID), F.lit(False))
    keyed = docs.withColumn("_d", F.when(some, d).otherwise(F.monotonically_increasing_id())).withColumn("_e", F.when(some, e).otherwise(F.lit(0)))
    joined = keyed.join(kept.hint("merge"), (F.col("_d") == F.col("_kd")) & (F.col("_e") == F.col("_ke")), "left").withColumn("_lines", lines_of(F.col(text)))
    numbered = joined.withColumn("_copy", F.row_number().over(Window.partitionBy("_d", "_e").orderBy("_ke")))
    blank = F.filter(F.transform("_lines", lambda line, i: F.when(line.rlike(SOLID), -1).otherwise(i)), lambda i: i >= 0)
    own = F.when(F.col("_copy") == 1, F.coalesce("_kept", F.array().cast("array<int>"))).otherwise(F.array().cast("array<int>"))
    stay = F.transform(F.array_sort(F.concat(own, blank)), lambda i: F.get("_lines", i))
    return (
        numbered.withColumn("_stay", F.when(F.col("_lines").isNotNull(), stay))
        .withColumn("n_lines", F.coalesce(F.size("_lines"), F.lit(0)).cast("long"))
        .withColumn("n_removed", F.coalesce(F.size("_lines") - F.size("_stay"), F.lit(0)).cast("long"))
        .withColumn(text, F.array_join("_stay", "\n"))
        .drop("_d", "_e", "_kd", "_ke", "_kept", "_copy", "_lines", "_stay")
    )


def deduped_documents(docs: DataFrame) -> DataFrame:
    """``docs`` after line dedup, with its own columns, whatever their names; n_chars is set anew."""
    cleaned = dedup_lines(set_aside(docs))
    if "n_chars" in docs.columns:
        cleaned = cleaned.withColumn("n_chars", F.char_length("text").cast("long"))
    return set_back(cleaned, docs.columns)
