"""The corpus pipeline: five operators of :mod:`hindcast.llm` in a row.

Each stage takes the documents its predecessor kept and returns documents with the
same columns; the last returns them encoded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hindcast.llm import line_dedup, mixing, near_join, quality, sentencepiece_fst
from hindcast.llm._spark import materialise


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.good_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier line equals or resembles go from the texts."""
    return line_dedup.deduped_documents(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return near_join.one_of_each(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes, a document's once for each round of its source."""
    return mixing.mixed_documents(docs)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of each text, and whether they decode to it."""
    coded = sentencepiece_fst.encode(docs.select("doc_id", "text", "lang", "source", "n_chars"), checked="round_trip")
    return coded.select("doc_id", "lang", "source", "n_chars", "ids", "round_trip")


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("n-gram Jaccard join", near_stage),
    ("mixing sources to target weights", mix_stage),
    ("SentencePiece encoding and decoding", encode_stage),
]

#: SQL can't express the classifier, the mixture's draws or the encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{i}")
    return STAGES[-1][1](spark, docs, sf_dir)
