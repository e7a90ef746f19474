"""Readers and writers of landed files; every schema is explicit."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hindcast import schemas

PANEL_CSV = "symbol string, as_of date, signal string, side string, tier string, eligible int, score double, fwd_return double"
SHORT_JSON = "settlementDate string, currentShortPositionQuantity double, previousShortPositionQuantity double, averageDailyVolumeQuantity double, daysToCoverQuantity double, changePercent double"


def read_panel(spark: SparkSession, path: str) -> DataFrame:
    """Replay panel CSV; an empty signal is '(no signal)', empty side and tier stay empty text."""
    df = spark.read.schema(PANEL_CSV).option("header", True).csv(path)
    return df.withColumns({"signal": F.coalesce(F.nullif("signal", F.lit("")), F.lit("(no signal)")), "side": F.coalesce("side", F.lit("")), "tier": F.coalesce("tier", F.lit(""))})


def read_context(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.CONTEXT).option("header", True).csv(path)


def read_listing(spark: SparkSession, path: str, other: bool = False) -> DataFrame:
    """Pipe-delimited directory without header and trailer; the other-listed layout is mapped to the same columns."""
    raw = spark.read.schema(schemas.OTHER_LISTING if other else schemas.LISTING).option("sep", "|").option("header", True).csv(path)
    if other:
        raw = raw.select(F.col("act_symbol").alias("symbol"), "name", F.col("exchange").alias("market_category"), "test_issue", F.lit("").alias("financial_status"), "etf")
    return raw.where(F.col("symbol").isNotNull() & F.col("name").isNotNull() & ~F.col("symbol").startswith("File Creation Time"))


def read_short_interest(spark: SparkSession, path: str) -> DataFrame:
    """JSON records to typed rows; rows without a settlement date go."""
    j = spark.read.schema("symbol string, " + SHORT_JSON).json(path)
    return j.select(
        "symbol", F.col("settlementDate").try_cast("date").alias("settlement_date"), F.col("currentShortPositionQuantity").alias("short_shares"), F.col("previousShortPositionQuantity").alias("previous_short_shares"),
        F.col("averageDailyVolumeQuantity").alias("avg_daily_volume"), F.col("daysToCoverQuantity").alias("days_to_cover"), F.col("changePercent").alias("change_percent"),
    ).where("settlement_date is not null")


def write_bars(bars: DataFrame, path: str, buckets: int = 64) -> None:
    """Bars partitioned by a symbol bucket.  The symbols at hand are replaced; the other
    symbols of their buckets are written again as they are, other buckets are not touched."""
    numbered = bars.withColumn("bucket", F.pmod(F.xxhash64("symbol"), F.lit(buckets)).cast("int"))
    at_hand = numbered.select("symbol", "bucket").distinct()
    try:
        old = bars.sparkSession.read.parquet(path)
    except AnalysisException:  # nothing is there yet
        old = None
    if old is not None:
        touched = [r.bucket for r in at_hand.select("bucket").distinct().collect()]  # numbers below ``buckets``
        others = old.where(F.col("bucket").isin(touched)).join(at_hand.select("symbol"), "symbol", "left_anti")
        numbered = numbered.unionByName(others.select(*numbered.columns))
    dealt = numbered.repartition("bucket", "symbol").sortWithinPartitions("bucket", "symbol", "session_date")
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def read_bars(spark: SparkSession, path: str, symbol: str | None = None, buckets: int = 64) -> DataFrame:
    """Bars of all symbols, or of one: its bucket is the only partition that is read."""
    df = spark.read.parquet(path)
    if symbol is not None:
        number = spark.range(1).select(F.pmod(F.xxhash64(F.lit(symbol)), F.lit(buckets)).cast("int")).first()[0]
        df = df.where((F.col("bucket") == number) & (F.col("symbol") == symbol))
    return df.drop("bucket")


def write_results(rows: DataFrame, path: str) -> None:
    """Per-symbol results of runs, one partition a session; a repeated run replaces its own."""
    rows.repartition("session_date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("session_date").parquet(path)


def profiles(*sources: DataFrame) -> DataFrame:
    """(symbol, name, sector) by precedence of the sources, with the missing sources named."""
    out = None
    for i, s in enumerate(sources):
        part = s.groupBy("symbol").agg(F.first("name", ignorenulls=True).alias(f"n{i}"), F.first("sector", ignorenulls=True).alias(f"s{i}")).withColumn(f"h{i}", F.lit(True))
        out = part if out is None else out.join(part, "symbol", "full_outer")
    k = range(len(sources))
    missing = F.filter(F.array(*[F.when(F.col(f"h{i}").isNull(), f"source {i}") for i in k]), lambda x: x.isNotNull())
    return out.select("symbol", F.coalesce(*[F.nullif(f"n{i}", F.lit("")) for i in k]).alias("name"), F.coalesce(*[F.nullif(f"s{i}", F.lit("")) for i in k]).alias("sector"), missing.alias("missing"))


def newest(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """The newest row of each key."""
    w = Window.partitionBy(*key).orderBy(F.col(order).desc())
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
