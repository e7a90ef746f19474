"""Bars, context, ledger and panel tables derived from the star schema.

They stand in for market data: every row is computed from the given tables, so all
work grows with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

def by_symbol():
    return Window.partitionBy("symbol").orderBy("session_date")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hash_int(*parts: Column | str) -> Column:
    """A stable 32-bit integer from md5, the same in any SQL engine."""
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws("-", *[c.cast("string") for c in cols])), 1, 8), 16, 10).cast("long")


def _walk(sums: DataFrame) -> DataFrame:
    """Bounded random walk from (symbol, session_date, d, t, volume)."""
    ret = (F.col("d") - 0.05) * 0.4
    to_here = by_symbol().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = sums.withColumn("ret", ret).withColumn("close", 100 * F.exp(F.sum("ret").over(to_here)))
    return df.select(
        "symbol", "session_date",
        (F.col("close") * F.exp(-0.5 * F.col("ret"))).alias("open"),
        (F.col("close") * F.exp(F.abs("ret") + 0.1 * F.col("t"))).alias("high"),
        (F.col("close") * F.exp(-F.abs("ret") - 0.1 * F.col("t"))).alias("low"),
        "close", "volume",
    )


def positions(bars: DataFrame) -> DataFrame:
    """``bars`` with ``pos``, the 0-based session number of the symbol."""
    return bars.withColumn("pos", F.row_number().over(by_symbol()) - 1)


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, parts = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    return items.join(parts, items.l_partkey == parts.p_partkey)


def bars(spark: SparkSession, sf_dir: str, weekends: bool = False) -> DataFrame:
    """Daily bars by part type, weekdays only unless ``weekends``."""
    rows = _items(spark, sf_dir).withColumn("session_date", F.to_date("l_shipdate"))
    if not weekends:
        rows = rows.where(F.weekday("session_date") < 5)
    sums = rows.groupBy(F.col("p_type").alias("symbol"), "session_date").agg(
        F.avg("l_discount").alias("d"), F.avg("l_tax").alias("t"), F.sum("l_quantity").alias("volume")
    )
    return positions(_walk(sums))


def part_bars(spark: SparkSession, sf_dir: str, parts: int = 200) -> DataFrame:
    """Daily bars by groups of ``parts`` parts, so that symbols grow with the table; every
    seventh group also trades at weekends."""
    group = F.floor((F.col("l_partkey") - 1) / parts)
    rows = table(spark, sf_dir, "lineitem").withColumn("session_date", F.to_date("l_shipdate"))
    rows = rows.where((group % 7 == 0) | (F.weekday("session_date") < 5))
    sums = rows.groupBy(F.concat(F.lit("P"), F.lpad(group.cast("string"), 7, "0")).alias("symbol"), "session_date").agg(
        F.avg("l_discount").alias("d"), F.avg("l_tax").alias("t"), F.sum("l_quantity").alias("volume")
    )
    return positions(_walk(sums))


def raw_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Noisy unit prices by part type and weekday; moves are wild on purpose."""
    rows = _items(spark, sf_dir).withColumn("session_date", F.to_date("l_shipdate")).where(F.weekday("session_date") < 5)
    px = F.col("l_extendedprice") / F.col("l_quantity")
    o = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    out = rows.groupBy(F.col("p_type").alias("symbol"), "session_date").agg(
        F.min_by(px, o).alias("open"), F.max(px).alias("high"), F.min(px).alias("low"), F.max_by(px, o).alias("close"), F.sum("l_quantity").alias("volume")
    )
    return positions(out)


def wide_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly bars by brand and return flag: a cross-section of names."""
    rows = _items(spark, sf_dir).withColumn("session_date", F.to_date(F.date_trunc("week", "l_shipdate")))
    sums = rows.groupBy(F.concat_ws("-", "p_brand", "l_returnflag").alias("symbol"), "session_date").agg(
        F.avg("l_discount").alias("d"), F.avg("l_tax").alias("t"), F.sum("l_quantity").alias("volume")
    )
    return positions(_walk(sums))


def context(bars_: DataFrame) -> DataFrame:
    """Market level and volatility index by session."""
    return bars_.groupBy("session_date").agg(F.avg("close").alias("market"), (100 * F.avg(F.col("high") / F.col("low") - 1)).alias("vix"))


def ledger(bars_: DataFrame, horizon: int = 21, every: int = 5) -> DataFrame:
    """Recorded forecasts at every fifth bar, all fields from a hash of the key."""
    m = F.col("m")
    edge = F.col("probability_up") - F.col("baseline_up_rate")
    return (
        bars_.where(F.col("pos") % every == 0)
        .select("symbol", F.col("session_date").alias("as_of_date"), F.col("pos").alias("signal_pos"), hash_int("symbol", "session_date").alias("m"))
        .withColumn("id", F.col("m"))
        .withColumn("horizon_days", F.lit(horizon))
        .withColumn("horizon_date", F.date_add("as_of_date", 30))
        .withColumn("probability_up", (35 + m % 31).cast("double"))
        .withColumn("baseline_up_rate", (47 + m % 7).cast("double"))
        .withColumn("side", F.when(edge >= 4, "long").when(edge <= -4, "short"))
        .withColumn("tier", F.element_at(F.array(F.lit("strong"), F.lit("moderate"), F.lit("speculative")), (m % 3 + 1).cast("int")))
        .withColumn("eligible", F.when(m % 10 == 0, F.lit(None)).otherwise(m % 10 >= 3).cast("boolean"))
        .withColumn("calibrated_probability_up", F.when(m % 4 != 0, F.col("probability_up") * 0.5 + 25))
        .withColumn("model_version", F.when(m % 11 != 0, F.concat(F.lit("v"), (m % 2).cast("string"))))
        .withColumn("universe_id", F.lit(1))
        .withColumn("created_at", F.to_timestamp("as_of_date") + F.expr("interval 17 hours"))
        .drop("m")
    )


def panel(wide: DataFrame, every: int = 4, horizon: int = 4) -> DataFrame:
    """A replay panel: at every fourth week each name's signal (from a hash of the key)
    and what followed from the next open to the close of session +horizon."""
    w = Window.partitionBy("symbol").orderBy("pos")
    ahead = w.rowsBetween(1, horizon)
    m = F.col("m")
    grid = wide.select("session_date").distinct().withColumn("n", F.row_number().over(Window.orderBy("session_date")) - 1).where(F.col("n") % every == 0).select("session_date")
    df = wide.withColumns({
        "entry_price": F.lead("open", 1).over(w), "exit": F.lead("close", horizon).over(w), "lo": F.min("low").over(ahead), "hi": F.max("high").over(ahead),
    }).where("exit is not null").join(grid, "session_date", "left_semi")
    pct = lambda c: (F.col(c) / F.col("entry_price") - 1) * 100
    df = df.select(
        "symbol", F.col("session_date").alias("as_of"), "entry_price", pct("exit").alias("fwd_return"), ((F.col("exit") / F.col("close") - 1) * 100).alias("fwd_close_to_close"),
        pct("lo").alias("min_low_pct"), pct("hi").alias("max_high_pct"), hash_int("symbol", "session_date").alias("m"),
    )
    return df.withColumns({
        "score": (m % 101).cast("double"), "side": F.when(m % 3 == 0, "long").when(m % 3 == 1, "short"), "eligible": (m % 5 != 0).cast("int"), "available": (m % 9 != 0).cast("int"),
        "tier": F.when(m % 7 < 2, "strong").when(m % 7 < 4, "moderate").otherwise("speculative"), "signal": F.when(m % 3 == 0, "bullish").when(m % 3 == 1, "bearish").otherwise("(no signal)"),
        "probability_up": (35 + m % 41).cast("double"), "expected_move": 0.5 + (m % 40) / 10, "adverse_move": (m % 7 - 2) / 2, "reward_risk": (m % 25) / 10,
        "stop_pct": (-1 - m % 3).cast("double"), "target_pct": (1 + m % 4).cast("double"), "plan_action": F.when(m % 2 == 0, "consider_buying").otherwise("wait"),
        "error": F.when(m % 9 == 0, F.concat(F.lit("reason "), (m % 6).cast("string"))), "runtime_s": (m % 50) / 10,
    })
