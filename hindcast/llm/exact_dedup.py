"""Exact dedup by two-pass Bloom filtering; DataFrame functions only.

Pass one counts, with map-side combining, how many rows fall on each cell of a
bounded bitmap; cells met at least twice make the filter of *possibly repeated*
hashes.  Pass two tests every row against the broadcast filter: rows that miss
it are unique and pass straight through, only the others shuffle and are
resolved exactly.

Defined cases: null text counts as empty; empty and white-space-only texts equal
each other; a null id loses every tie; rows repeated with one id form one group
and one of them stays; an empty table gives an empty result; columns other than
the id and the text are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hindcast.llm._spark import bitmap_filter, filter_bits, join_by_key, materialise, might_contain

#: ASCII white space that does not count when texts are compared.
IGNORED = [" ", "\t", "\n", "\x0b", "\x0c", "\r"]


def normalised(text):
    for c in IGNORED:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_chars, text_sha256) of every row: code points and normalised hash."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        F.col(doc_id).alias("doc_id"),
        F.char_length(whole).cast("long").alias("n_chars"),
        F.sha2(normalised(whole).cast("binary"), 256).alias("text_sha256"),
    )


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = materialise(digests(docs, doc_id, text), "exact-digests")
    n = rows.count()
    bits = filter_bits(n)
    repeated = bitmap_filter(rows, "text_sha256", bits, at_least=2)
    tested = might_contain(rows, "text_sha256", repeated, bits, "maybe")

    unique = tested.where(~F.col("maybe")).select(
        "doc_id",
        F.col("doc_id").alias("keep_id"),
        F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"),
        "text_sha256",
    )
    # Rows of one id are numbered, so that one of them stays if a row was repeated.
    same = Window.partitionBy("text_sha256", "doc_id").orderBy(F.col("n_chars").desc())
    maybe = tested.where("maybe").withColumn("nth", F.row_number().over(same))
    best = maybe.groupBy("text_sha256").agg(
        F.max(F.struct("n_chars", F.bitwise_not("doc_id").alias("least"))).alias("best"), F.count(F.lit(1)).alias("group_size")
    ).select("text_sha256", "group_size", F.bitwise_not("best.least").alias("keep_id"))
    resolved = join_by_key(maybe, best, "text_sha256", "group_size", n).select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)).alias("kept"),
        "text_sha256",
    )
    return unique.unionByName(resolved)
