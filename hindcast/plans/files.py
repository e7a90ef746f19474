"""Queries that go through landed files: written by Spark, read back with explicit schemas."""

from __future__ import annotations

from pyspark.sql import functions as F

from hindcast.plans import ctes as C
from hindcast.plans.panels import _P, panel
from hindcast.plans.bars import _READINGS, readings
from hindcast.plans.registry import query, rounded
from hindcast.sources import adapters as A
from hindcast.sources import files
from hindcast.streaming.jobs import scratch


@query(_P + "SELECT symbol, as_of, signal, coalesce(side, '') AS side, tier, eligible, round(fwd_return, 5) AS fwd_return FROM panel")
def s3_panel_csv(spark, sf_dir):
    path = scratch(spark, "panel-csv")
    rows = panel(spark, sf_dir).select("symbol", "as_of", F.when(F.col("signal") != "(no signal)", F.col("signal")).alias("signal"), "side", "tier", "eligible", "score", "fwd_return")
    rows.write.option("header", True).csv(path)
    return files.read_panel(spark, path).select("symbol", "as_of", "signal", "side", "tier", "eligible", *rounded("fwd_return", places=5))


@query(C.with_(C.BARS, C.CONTEXT) + "SELECT session_date, round(market, 5) AS market, round(vix, 5) AS vix FROM context")
def s4_context_csv(spark, sf_dir):
    path = scratch(spark, "context-csv")
    A.context(A.bars(spark, sf_dir)).write.option("header", True).csv(path)
    return files.read_context(spark, path).select("session_date", *rounded("market", "vix", places=5))


@query(C.with_(_READINGS) + "SELECT symbol, settlement_date, round(days_to_cover, 5) AS days_to_cover, round(change_percent, 5) AS change_percent FROM readings")
def s8_short_interest_json(spark, sf_dir):
    path = scratch(spark, "short-json")
    rows = readings(spark, sf_dir)
    out = rows.select("symbol", F.col("settlement_date").cast("string").alias("settlementDate"), F.col("days_to_cover").alias("daysToCoverQuantity"), F.col("change_percent").alias("changePercent"))
    out.unionByName(out.limit(3).withColumn("settlementDate", F.lit(None).cast("string"))).write.json(path)
    return files.read_short_interest(spark, path).select("symbol", "settlement_date", *rounded("days_to_cover", "change_percent", places=5))


@query(C.with_(C.BARS) + "SELECT symbol, session_date, round(close, 6) AS close FROM bars WHERE symbol = 'PROMO'")
def s1_k1_partitioned_bars(spark, sf_dir):
    """Bars written by bucket, one bucket replaced, one symbol read by its partition."""
    path = scratch(spark, "bars-bucketed")
    bars = A.bars(spark, sf_dir)
    files.write_bars(bars, path)
    files.write_bars(bars.where("symbol = 'ECONOMY'"), path)
    return files.read_bars(spark, path, "PROMO").select("symbol", "session_date", *rounded("close"))


@query(C.with_(C.BARS, C.LEDGER) + "SELECT as_of_date AS session_date, symbol, CASE WHEN eligible THEN 'ranked' WHEN eligible IS NULL THEN 'unknown' ELSE 'refused' END AS status, probability_up AS score FROM ledger")
def k8_scan_results(spark, sf_dir):
    path = scratch(spark, "scan-results")
    rows = A.ledger(A.bars(spark, sf_dir))
    status = F.when(F.col("eligible"), "ranked").when(F.col("eligible").isNull(), "unknown").otherwise("refused")
    files.write_results(rows.select(F.col("as_of_date").alias("session_date"), "symbol", status.alias("status"), F.col("probability_up").alias("score")), path)
    return spark.read.schema("symbol string, status string, score double, session_date date").parquet(path).select("session_date", "symbol", "status", "score")


@query("""WITH a AS (SELECT p_type AS symbol, 'a ' || p_type AS name, CASE WHEN p_type < 'M' THEN NULL ELSE 'core' END AS sector FROM part GROUP BY 1), b AS (SELECT DISTINCT p_type AS symbol, 'b' AS name, 'types' AS sector FROM part WHERE p_type > 'E' UNION ALL SELECT DISTINCT p_brand, 'b', 'brands' FROM part)
SELECT coalesce(a.symbol, b.symbol) AS symbol, coalesce(a.name, b.name) AS name, coalesce(a.sector, b.sector) AS sector, CAST(a.symbol IS NULL AS INT) + CAST(b.symbol IS NULL AS INT) AS missing FROM a FULL JOIN b ON a.symbol = b.symbol""")
def s11_profile_precedence(spark, sf_dir):
    p = A.table(spark, sf_dir, "part")
    types, brands = p.select(F.col("p_type").alias("symbol")).distinct(), p.select(F.col("p_brand").alias("symbol")).distinct()
    a = types.select("symbol", F.concat(F.lit("a "), "symbol").alias("name"), F.when(F.col("symbol") >= "M", "core").alias("sector"))
    b = types.where("symbol > 'E'").withColumn("sector", F.lit("types")).unionByName(brands.withColumn("sector", F.lit("brands"))).select("symbol", F.lit("b").alias("name"), "sector")
    return files.profiles(a, b).select("symbol", "name", "sector", F.size("missing").alias("missing"))
