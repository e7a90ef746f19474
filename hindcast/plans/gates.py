"""Queries over session gates, forecast labels, the universe cap and factor p-values."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from hindcast.functions.numeric import beta_cdf
from hindcast.operators import panels as N
from hindcast.plans import ctes as C
from hindcast.plans.forecasts import _ANALYSIS, analyses
from hindcast.plans.panels import _MERGED, _merged
from hindcast.plans.registry import query
from hindcast.sources import adapters as A

UNIVERSE_CAP = 40


@query(C.with_(C.BARS) + """, s AS (SELECT DISTINCT session_date FROM bars), d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders)
SELECT date, s.session_date AS session FROM d ASOF LEFT JOIN s ON d.date >= s.session_date""")
def j5_latest_session(spark, sf_dir):
    """The latest session at or before each order date: one union and one window, a row a date."""
    sessions = A.bars(spark, sf_dir).select("session_date").distinct().select(F.col("session_date").alias("date"), F.col("session_date").alias("session"), F.lit(False).alias("asked"))
    dates = A.table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("date")).distinct().select("date", F.lit(None).cast("date").alias("session"), F.lit(True).alias("asked"))
    w = Window.orderBy("date", "asked").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return sessions.unionByName(dates).withColumn("session", F.last("session", ignorenulls=True).over(w)).where("asked").select("date", "session")


@query(C.with_(C.BARS, C.LEDGER, C.GRADED) + """SELECT symbol, as_of_date, outcome_date,
 coalesce(CASE id % 3 WHEN 0 THEN outcome_date < DATE '1999-05-31' WHEN 1 THEN outcome_date < DATE '1999-06-01' END, false) AS complete FROM graded""")
def p17_outcome_session_complete(spark, sf_dir):
    """Whether the outcome's session is before the local date of the clock; never without a zone or an outcome."""
    from hindcast.plans.records import graded

    now = F.to_timestamp(F.lit("1999-06-01 03:00:00"))  # UTC: still the evening before in New York
    zone = F.when(F.col("id") % 3 == 0, "America/New_York").when(F.col("id") % 3 == 1, "Asia/Tokyo")
    local = F.to_date(F.from_utc_timestamp(now, zone))
    return graded(spark, sf_dir).select("symbol", "as_of_date", "outcome_date", F.coalesce(F.col("outcome_date") < local, F.lit(False)).alias("complete"))


@query(C.with_(C.BARS) + """SELECT symbol, session_date, CASE WHEN pos % 9 = 0 THEN 'future' WHEN pos % 9 = 1 AND pos % 2 = 0 THEN 'unconfirmed' WHEN pos % 9 > 5 THEN 'stale' ELSE 'confirmed' END AS gate FROM bars""")
def p18_scan_session_gate(spark, sf_dir):
    """The latest session of every history against a clock of pos % 9 - 1 days on, at 16:00 or 18:00:
    not in the future, not before the scan time of 17:15, not over four days old."""
    days = (F.col("pos") % 9 - 1).cast("int")
    today = F.date_add("session_date", days)
    early = F.col("pos") % 2 == 0
    age = F.datediff(today, "session_date")
    clock = F.when(early, "16:00").otherwise("18:00")
    gate = F.when(age < 0, "future").when((age == 0) & (clock < "17:15"), "unconfirmed").when(age > 4, "stale").otherwise("confirmed")
    return A.bars(spark, sf_dir).select("symbol", "session_date", gate.alias("gate"))


@query(_ANALYSIS + """SELECT symbol, as_of_date, round(edge, 1) AS edge_points, CASE WHEN edge >= 4 AND typical > 0.25 THEN 'bullish' WHEN edge <= -4 AND typical < -0.25 THEN 'bearish' ELSE 'neutral' END AS horizon_direction,
 CASE WHEN edge >= 4 AND typical > 0.5 THEN 'bullish' WHEN edge <= -4 AND typical < -0.5 THEN 'bearish' ELSE 'neutral' END AS historical_signal FROM an""")
def f19_f32_horizon_direction_and_signal(spark, sf_dir):
    """A horizon's direction asks for a quarter point of median return, the signal of past cases for a half."""

    def label(edge, least: float, median: float):
        return F.when((edge >= least) & (F.col("typical") > median), "bullish").when((edge <= -least) & (F.col("typical") < -median), "bearish").otherwise("neutral")

    share = F.round(F.col("edge") / 100, 9)  # the signal's edge is a share
    return analyses(spark, sf_dir).select("symbol", "as_of_date", F.round("edge", 1).alias("edge_points"), label(F.col("edge"), 4, 0.25).alias("horizon_direction"), label(share, 0.04, 0.5).alias("historical_signal"))


@query(f"SELECT DISTINCT p_name AS symbol FROM part ORDER BY 1 LIMIT {UNIVERSE_CAP}")
def t8_universe_cap(spark, sf_dir):
    """The first names of the universe, in order: the cap is the feature."""
    return A.table(spark, sf_dir, "part").select(F.col("p_name").alias("symbol")).distinct().orderBy("symbol").limit(UNIVERSE_CAP)


@query(_ANALYSIS + """, watch AS (SELECT DISTINCT p_type AS symbol FROM part WHERE p_type < 'P'), l AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY as_of_date DESC) AS k FROM an WHERE symbol IN (SELECT symbol FROM watch))
SELECT symbol, as_of_date, probability_up, baseline, edge, typical, grade FROM l WHERE k = 1""")
def p23_watchlist(spark, sf_dir):
    """The newest analysis of each watched symbol, as a compact row."""
    watch = A.table(spark, sf_dir, "part").where("p_type < 'P'").select(F.col("p_type").alias("symbol")).distinct()
    rows = analyses(spark, sf_dir).select("symbol", "as_of_date", "probability_up", "baseline", "edge", "typical", "grade").join(watch, "symbol", "left_semi")
    newest = F.max_by(F.struct("as_of_date", "probability_up", "baseline", "edge", "typical", "grade"), "as_of_date").alias("r")
    return rows.groupBy("symbol").agg(newest).select("symbol", "r.*")


def two_sided(rho: pd.Series, n: pd.Series) -> pd.Series:
    """P-value of a rank correlation by the t distribution; null under three pairs, 0 for |rho| = 1."""
    able = (n > 2) & rho.notna()
    x, half = (1 - rho[able].to_numpy(float) ** 2).clip(0, 1), (n[able].to_numpy(float) - 2) / 2
    out = pd.Series(np.full(len(rho), np.nan), index=rho.index)
    if able.any():
        out[able] = beta_cdf(x, half, np.full(len(half), 0.5))
    return out


@query(_MERGED + """, t AS (SELECT *, CASE WHEN row_number() OVER (ORDER BY as_of) - 1 < floor(count(*) OVER () / 2) THEN 'train' ELSE 'test' END AS part FROM mg), u AS (SELECT 'whole' AS part, factor, excess FROM t UNION ALL SELECT part, factor, excess FROM t),
rk AS (SELECT part, rank() OVER (PARTITION BY part ORDER BY factor) + (count(*) OVER (PARTITION BY part, factor) - 1) / 2 AS rx, rank() OVER (PARTITION BY part ORDER BY excess) + (count(*) OVER (PARTITION BY part, excess) - 1) / 2 AS ry FROM u),
r AS (SELECT part, count(*) AS n, abs(corr(rx, ry)) AS rho FROM rk GROUP BY 1)
SELECT part, n, round((1 - rho) * sum(pow(1 - pow(rho + (1 - rho) * (i + 0.5) / 20000, 2), n / 2 - 2)) / sum(pow(1 - pow((i + 0.5) / 20000, 2), n / 2 - 2)), 6) AS p_value FROM r CROSS JOIN range(20000) g(i) GROUP BY part, n, rho""")
def f13_spearman_p_value(spark, sf_dir):
    """Of the breadth factor against the board's excess, whole and by halves; the SQL adds up the density of rho."""
    rows = N.half_at_middle_date(_merged(spark, sf_dir))
    both = rows.unionByName(rows.withColumn("part", F.lit("whole")))
    ranked = both.withColumns({"rx": N.average_rank("pct_above", ["part"]), "ry": N.average_rank("excess", ["part"])})
    found = ranked.groupBy("part").agg(F.count(F.lit(1)).alias("n"), N.correlation("rx", "ry").alias("rho"))
    p_value = F.pandas_udf(two_sided, "double")  # made here, as it asks for a session
    return found.select("part", "n", F.round(p_value("rho", "n"), 6).alias("p_value"))
