"""Spark helpers shared by the operators: shared scratch tables, bounded
bitmap filters and gapless numbering without one task per group."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bits of one bitmap row, as Spark's bitmap_* functions fix it.
BITMAP_BITS = 32768
#: A filter never exceeds this many bits (16 MB), whatever the input size.
MAX_FILTER_BITS = 1 << 27

_own_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder for cut lineage; an own one only if unset."""
    global _own_dir
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if _own_dir is None:
        _own_dir = "file://" + tempfile.mkdtemp(prefix="spark-hindcast-")
    return _own_dir


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, label: str, hashes: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, cutting lineage.

    Shuffle files of the write go as soon as it is done: nothing reads them again.
    ``hashes`` says that most columns hold hashes, for which no dictionary is tried.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("parquet.enable.dictionary", str(not hashes).lower()).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


OTHERS = "_others"


def set_aside(docs: DataFrame, used: tuple[str, ...] = ("doc_id", "text", "source", "n_chars")) -> DataFrame:
    """``docs`` with all columns but the used ones in one struct, where no name that an
    operator gives to a column of its own can meet them."""
    names = lambda inside: [F.col(f"`{c}`") for c in docs.columns if (c in used) == inside]
    others = names(False)
    return docs.select(*names(True), *([F.struct(*others).alias(OTHERS)] if others else []))


def set_back(out: DataFrame, columns: list[str], used: tuple[str, ...] = ("doc_id", "text", "source", "n_chars")) -> DataFrame:
    """The columns that :func:`set_aside` was given, in their order."""
    return out.select(*[F.col(f"`{c}`") if c in used else F.col(OTHERS).getField(c).alias(c) for c in columns])


def single_blanks(text: Column, inside: bool = False) -> Column:
    """A text with other ASCII white space as blanks.

    Few texts have any but line feeds, and to look for a character is cheaper than
    to replace it.  ``inside`` says that the text is a line, without line feeds.
    """
    rare = "\t\x0b\x0c\r"
    held = reduce(lambda a, b: a | b, [F.contains(text, F.lit(c)) for c in rare])
    plain = text if inside else F.replace(text, F.lit("\n"), F.lit(" "))
    return F.when(held, F.translate(text, rare + "\n", " " * (len(rare) + 1))).otherwise(plain)


def ascii_words(text: Column, inside: bool = False) -> Column:
    """The words of a text: maximal runs of characters other than ASCII white space."""
    return F.array_remove(F.split(single_blanks(text, inside), " "), "")  # a plain separator needs no regular expression


def filter_bits(rows: int) -> int:
    """Power of two of at least 16 bits a row, between one bitmap and the bound."""
    bits = BITMAP_BITS
    while bits < 16 * rows and bits < MAX_FILTER_BITS:
        bits *= 2
    return bits


def _cells(key: Column, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(bits)) for seed in (11, 29)]


def bitmap_filter(keys: DataFrame, key: str, bits: int, at_least: int = 1) -> DataFrame:
    """Bloom filter over ``key`` as rows (bucket, bitmap) of 4 KB, ``bits``/8 bytes in all.

    A cell is set when at least ``at_least`` rows fall on it: 1 gives a plain
    membership filter, 2 one for keys that may be repeated.  Cells are counted
    with map-side combining, so a hot key moves one row per task.
    """
    cell = keys.select(F.explode(F.array(*_cells(F.col(key), bits))).alias("cell"))
    hit = cell.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= at_least)
    return hit.groupBy((F.col("cell") / BITMAP_BITS).cast("int").alias("bucket")).agg(
        F.expr(f"bitmap_construct_agg(cell % {BITMAP_BITS})").alias("bitmap")
    )


def might_contain(df: DataFrame, key: str, bitmaps: DataFrame, bits: int, out: str) -> DataFrame:
    """Add boolean ``out``: whether ``key`` may be in the filter (no false negatives).

    The filter is broadcast; :data:`MAX_FILTER_BITS` bounds its size.
    """
    tests = []
    for i, cell in enumerate(_cells(F.col(key), bits)):
        side = F.broadcast(bitmaps.select(F.col("bucket").alias(f"_b{i}"), F.col("bitmap").alias(f"_m{i}")))
        df = df.withColumn(f"_c{i}", cell)
        df = df.join(side, (F.col(f"_c{i}") / BITMAP_BITS).cast("int") == F.col(f"_b{i}"), "left")
        byte = F.expr(f"cast(conv(hex(substring(_m{i}, cast((_c{i} % {BITMAP_BITS}) div 8 as int) + 1, 1)), 16, 10) as int)")
        tests.append(F.coalesce(F.expr("true") & (byte.bitwiseAND(F.expr(f"shiftleft(1, cast(_c{i} % 8 as int))")) != 0), F.lit(False)))
    hit = reduce(lambda a, b: a & b, tests)
    drop = [f"_{x}{i}" for i in range(len(tests)) for x in "bcm"]
    return df.withColumn(out, hit).drop(*drop)


def semi_by_filter(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """Rows of ``df`` whose ``key`` is in ``keys``: a bounded broadcast filter
    thins ``df`` where it stands, and only what passes is shuffled for the exact
    semi join."""
    bits = filter_bits(keys.count())
    thin = might_contain(df, key, bitmap_filter(keys.select(key), key, bits), bits, "_maybe")
    return thin.where("_maybe").drop("_maybe").join(keys.select(key).distinct(), key, "left_semi")


def join_by_key(left: DataFrame, right: DataFrame, key: str, size: str, rows: int) -> DataFrame:
    """Inner join of ``left`` with one row a key, whose column ``size`` counts the key's rows in ``left``.

    Keys with over a thousandth of all ``rows`` number under 1,000: their side is
    broadcast, so that no key lands in one task; all others are shuffled.
    """
    hot = right.where(F.col(size) * 1000 > rows)
    cold = left.join(F.broadcast(hot.select(key)), key, "left_anti").join(right.hint("merge"), key)
    return left.join(F.broadcast(hot), key).unionByName(cold)


def spread(rows: int, per: int = 50_000, least: int = 512) -> int:
    """How many sub-buckets keep about ``per`` rows of the largest group together."""
    return max(least, -(-rows // per))


def running_start(df: DataFrame, group: list[str], order: list[str], amount: Column, out: str, buckets: int) -> DataFrame:
    """Add ``out``: the sum of ``amount`` over earlier rows of the same group.

    Rows of a group are dealt over ``buckets`` hash buckets of ``order``; a
    small table of bucket sums gives each bucket's offset and a window inside
    (group, bucket) the rest, so no group has to fit into one task.
    """
    df = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets))).withColumn("_amount", amount)
    inner = Window.partitionBy(*group, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(*group, "_bucket").agg(F.sum("_amount").alias("_sum"))
    outer = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)],
        F.col("_bucket").alias("_gb"),
        F.coalesce(F.sum("_sum").over(outer), F.lit(0)).alias("_offset"),
    )
    df = df.withColumn("_within", F.coalesce(F.sum("_amount").over(inner), F.lit(0)))
    on = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(group)], F.col("_bucket") == F.col("_gb"))
    return (
        df.join(offsets, on)
        .withColumn(out, F.col("_offset") + F.col("_within"))
        .drop("_bucket", "_amount", "_within", "_gb", "_offset", *[f"_g{i}" for i in range(len(group))])
    )
