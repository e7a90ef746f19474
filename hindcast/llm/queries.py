"""The thin queries over the driver's tables: one opN_* for each operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hindcast.llm import chat, divergence, fingerprints, line_dedup, mixing, near_join, packing, quality, repair, sentencepiece_fst, sharding, url_filter
from hindcast.llm import exact_dedup as exact


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_formatting(spark, sf_dir):
    """The table's rows as they would land from three feeds, each with its own layout."""
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    feed = F.pmod(F.xxhash64("conv_id"), F.lit(3))
    turn = F.to_json(F.struct("role", "text"), {"ignoreNullFields": "false"})
    content = F.to_json(F.struct("role", F.col("text").alias("content")), {"ignoreNullFields": "false"})
    nested = F.to_json(F.struct(F.struct(F.struct("role").alias("author"), F.col("text").alias("content")).alias("message")), {"ignoreNullFields": "false"})
    landed = rows.select("conv_id", "turn", F.when(feed == 0, turn).when(feed == 1, content).otherwise(nested).alias("record"))
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), F.lit(0).alias("turn"), F.to_json(F.struct(F.lit(said).alias("prompt"), F.lit(said).alias("response"))).alias("record"))
    return chat.read_back(chat.format_turns(chat.to_turns(landed.unionByName(extra))))


def op2_document_fingerprints(spark, sf_dir):
    return fingerprints.edited_and_near(_table(spark, sf_dir, "documents"))


def op3_quality_classifier(spark, sf_dir):
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_exact_dedup(spark, sf_dir):
    return exact.exact_dedup(_table(spark, sf_dir, "documents"))


def op5_sentencepiece(spark, sf_dir):
    return sentencepiece_fst.digest(_table(spark, sf_dir, "documents"))


def op6_line_dedup(spark, sf_dir):
    cleaned = line_dedup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cleaned.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("clean_sha256"))


def op7_ngram_jaccard_join(spark, sf_dir):
    return near_join.near_groups(_table(spark, sf_dir, "documents"))


def op8_source_mixing(spark, sf_dir):
    documents, _ = mixing.mix(_table(spark, sf_dir, "documents"))
    return documents.drop("source")


def op9_sharding(spark, sf_dir):
    dealt = sharding.shard(_table(spark, sf_dir, "documents"))
    return dealt.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})


def url_list_entries(pages: DataFrame) -> DataFrame:
    """A dated block and allow list drawn from the hosts that the pages have.

    Every host's registrable name is blocked in turns by its hash, some hosts below
    are allowed again, and a part of the entries is removed later.
    """
    host = url_filter.host_of(F.col("url"))
    hosts = pages.select(host.alias("host")).where("host is not null").distinct()
    labels = F.split("host", r"\.")
    parent = F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".")
    named = hosts.select(F.lit("hosts").alias("list"), F.col("host").alias("name")).unionByName(hosts.select(F.lit("domains").alias("list"), parent.alias("name")).distinct())
    h = F.conv(F.substring(F.md5("name"), 1, 8), 16, 10).cast("long")
    made = named.select(
        "list", "name", h.alias("h"),
        F.when((F.col("list") == "hosts") & (h % 5 == 0), F.lit("allow")).otherwise(F.lit("block")).alias("action"),
    ).where((F.col("list") == "domains") & (F.col("h") % 2 == 0) | (F.col("list") == "hosts") & (F.col("h") % 3 == 0))
    added = F.timestamp_seconds(F.lit(1704067200) + (F.col("h") % 20) * 86400)
    first = made.select("list", "name", "action", F.lit("add").alias("op"), added.alias("at"))
    gone = made.where("h % 4 = 1").select("list", "name", "action", F.lit("remove").alias("op"), F.timestamp_seconds(F.lit(1704067200) + (F.col("h") % 20 + 5) * 86400).alias("at"))
    again = made.where("h % 8 = 1").select("list", "name", "action", F.lit("add").alias("op"), F.timestamp_seconds(F.lit(1704067200) + (F.col("h") % 20 + 9) * 86400).alias("at"))
    return first.unionByName(gone).unionByName(again)


def op10_url_filter(spark, sf_dir):
    """Every page, fetched an hour after the one before it within 30 days, by id."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched_at", F.timestamp_seconds(F.lit(1704067200) + F.pmod(F.col("page_id"), F.lit(720)) * 3600))
    return url_filter.evaluate(captures, url_list_entries(pages))


def damaged(conversations: DataFrame) -> DataFrame:
    """Conversations whose rows are dropped, emptied, cut, repeated or reroled by their checksum."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    hit = F.crc32(key.cast("binary")) % 20
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    text = F.when(hit == 1, F.lit("")).when(hit == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    rows = conversations.where(hit != 0).select("conv_id", "turn", F.when(hit == 4, F.lit("user")).otherwise(role).alias("role"), text.alias("text"), hit.alias("hit"))
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(F.col("hit") == 3, 2).otherwise(1)))).drop("hit", "copy")


def op11_conversation_repair(spark, sf_dir):
    conversations = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planned, turns = repair.repair(damaged(conversations))
    found = planned.join(repair.digests(turns).withColumnRenamed("conv_id", "_conv"), F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")
    every = conversations.select(F.col("conv_id").alias("_conv")).distinct()
    whole = every.join(found, F.col("_conv").eqNullSafe(F.col("conv_id")), "left")
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return whole.select(F.col("_conv").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def op12_source_divergence(spark, sf_dir):
    return divergence.audit(_table(spark, sf_dir, "documents"))


def op13_best_fit_packing(spark, sf_dir):
    pieces = packing.tokenized(_table(spark, sf_dir, "documents"))
    return packing.pack(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}
