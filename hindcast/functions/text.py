"""Headline, listing and lexicon functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Names and ticker endings of issues that are not common stock.
NON_COMMON = r"(?i)\b(warrant|warrants|right|rights|unit|units|preferred|depositary share|notes? due|debenture|subordinated|trust preferred|contingent value)\b"
SUFFIXES = ("W", "R", "U", "P")


def tokens(text: Column) -> Column:
    """Lower-case words, apostrophes inside kept."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[a-z]+(?:'[a-z]+)?"), F.lit(0))


def lexicon_scores(df: DataFrame, id_: str, text: str, lexicon: dict[str, float], negations: list[str], intensifiers: dict[str, float]) -> DataFrame:
    """(id, score, label, terms): lexicon hits, negated within three words, scaled by the word before.

    The lexicon is a literal map: it is a parameter of fixed size."""
    lex, inten = (F.create_map(*[x for k, v in d.items() for x in (F.lit(k), F.lit(float(v)))]) for d in (lexicon, intensifiers))
    neg = F.array(*[F.lit(n) for n in negations])
    df = df.select(F.col(id_).alias("id"), tokens(F.col(text)).alias("t"))

    def hit(w, i):
        before = F.slice("t", F.greatest(i - 2, F.lit(1)), F.least(i, F.lit(3)))
        sign = F.when((i > 0) & F.arrays_overlap(before, neg), -1.0).otherwise(1.0)
        scale = F.when(i > 0, F.coalesce(F.try_element_at(inten, F.get("t", i - 1)), F.lit(1.0))).otherwise(1.0)
        return F.struct(w.alias("w"), i.alias("i"), (F.try_element_at(lex, w) * sign * scale).alias("c"))

    hits = df.select("id", F.filter(F.transform("t", hit), lambda x: x["c"].isNotNull()).alias("h"))
    raw = F.aggregate("h", F.lit(0.0), lambda a, x: a + x["c"])
    ordered = F.transform(F.array_sort(F.transform("h", lambda x: F.struct((-F.abs(x["c"])).alias("a"), x["i"].alias("i"), x["w"].alias("w")))), lambda x: x["w"])
    out = hits.select("id", F.tanh(raw / 3).alias("score"), F.array_distinct(ordered).alias("terms"))
    return out.withColumn("label", F.when(F.round("score", 9) >= 0.18, "Positive").when(F.round("score", 9) <= -0.18, "Negative").otherwise("Neutral"))


def weighted_sentiment(df: DataFrame, by: list[str], score: str, hours: str) -> DataFrame:
    """Recency-weighted mean, e^(-h/120), denominator at least 1, 72 hours if undated; and polarity counts."""
    w = F.exp(-F.coalesce(F.col(hours), F.lit(72.0)) / 120)
    return df.groupBy(*by).agg(
        F.greatest(F.least(F.sum(F.col(score) * w) / F.greatest(F.sum(w), F.lit(1.0)), F.lit(1.0)), F.lit(-1.0)).alias("sentiment"),
        F.count_if(F.col("label") == "Positive").alias("positive"), F.count_if(F.col("label") == "Negative").alias("negative"), F.count_if(F.col("label") == "Neutral").alias("neutral"),
    )


def recent_headlines(df: DataFrame, by: list[str], age_days: str, most: int = 12, limit: float = 14.0) -> DataFrame:
    """Headlines of at most 14 days or undated, the newest twelve of each key."""
    w = Window.partitionBy(*by).orderBy(F.col(age_days).asc_nulls_last(), "id")
    return df.where(F.col(age_days).isNull() | (F.col(age_days) <= limit)).withColumn("n", F.row_number().over(w)).where(F.col("n") <= most)


def parsed_time(raw: Column) -> Column:
    """Epoch seconds, ISO with or without Z, or a plain date, as a UTC timestamp; NULL otherwise."""
    epoch = F.when(raw.rlike(r"^\d{9,11}$"), F.timestamp_seconds(raw.try_cast("long")))
    return F.coalesce(epoch, F.try_to_timestamp(F.regexp_replace(raw, "Z$", "+00:00")), F.try_to_timestamp(raw, F.lit("yyyy-MM-dd")))


def web_url(url: Column) -> Column:
    return F.when(url.rlike("^https?:"), url).otherwise("")


def normal_symbol(raw: Column) -> Column:
    """Upper case, trimmed, without a leading $; NULL if it is no symbol."""
    s = F.regexp_replace(F.upper(F.trim(raw)), r"^\$+", "")
    return F.when(s.rlike(r"^[A-Z0-9][A-Z0-9.\-]{0,14}$"), s)


def common_stock(symbol: Column, name: Column) -> Column:
    bad = symbol.rlike(r"[$^]") | name.rlike(NON_COMMON) | ((F.length(symbol) == 5) & F.substring(symbol, -1, 1).isin(*SUFFIXES))
    return F.coalesce((symbol != "") & (name != "") & ~bad, F.lit(False))


def listed(df: DataFrame) -> DataFrame:
    """A listing directory without its trailer, test issues, funds and troubled names; cleaned."""
    keep = ~F.col("symbol").startswith("File Creation Time") & (F.coalesce(F.col("test_issue"), F.lit("N")) != "Y") & (F.coalesce(F.col("etf"), F.lit("N")) != "Y") & F.coalesce(F.col("financial_status"), F.lit("")).isin("N", "")
    name = F.trim(F.split("name", " - ", 2)[0])
    return df.where(keep & common_stock(F.col("symbol"), F.col("name"))).select(F.replace("symbol", F.lit("."), F.lit("-")).alias("symbol"), F.when(name != "", name).otherwise(F.trim("name")).alias("name"))


def merge_universe(lists: list[DataFrame]) -> DataFrame:
    """Outer union of (symbol, name, sector, list): the first list wins, a blank sector is filled from the next."""
    tagged = reduce(lambda a, b: a.unionByName(b), [d.withColumn("o", F.lit(i)) for i, d in enumerate(lists)])
    sector = F.when(F.trim(F.coalesce("sector", F.lit(""))) != "", F.struct("o", F.col("sector").alias("v")))
    return tagged.groupBy("symbol").agg(F.min_by("name", "o").alias("name"), F.min(sector)["v"].alias("sector"), F.min_by("list", "o").alias("list"), F.count(F.lit(1)).alias("sources"))
