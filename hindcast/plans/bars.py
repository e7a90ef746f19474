"""Queries over bars: sources, hygiene, features, outcomes."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from hindcast.operators import bars as B
from hindcast.operators import features as X
from hindcast.plans import ctes as C
from hindcast.plans.registry import query, rounded
from hindcast.sources import adapters as A

P = "PARTITION BY symbol ORDER BY pos"
_BASE = C.with_(C.BARS)


def _r(*exprs: str) -> str:
    return ", ".join(f"round({e.split(' AS ')[0]}, 6) AS {e.split(' AS ')[-1]}" for e in exprs)


@query(_BASE + f"SELECT symbol, session_date, {_r('open', 'high', 'low', 'close', 'volume')}, pos FROM bars WHERE symbol = 'ECONOMY'")
def s1_bars_of_symbol(spark, sf_dir):
    return A.bars(spark, sf_dir).where("symbol = 'ECONOMY'").select("symbol", "session_date", *rounded("open", "high", "low", "close", "volume"), F.col("pos").cast("long").alias("pos"))


@query(_BASE + "SELECT symbol, session_date, round(close, 6) AS close FROM bars WHERE symbol IN ('ECONOMY', 'PROMO') AND session_date >= DATE '2000-01-01'")
def s2_bars_of_symbols_since(spark, sf_dir):
    some = spark.createDataFrame([("ECONOMY",), ("PROMO",)], "symbol string")
    return B.for_symbols(A.bars(spark, sf_dir), some, "2000-01-01").select("symbol", "session_date", *rounded("close"))


@query(C.with_(C.BARS, C.CONTEXT) + f"SELECT session_date, {_r('market', 'vix')} FROM context")
def s9_context_wide(spark, sf_dir):
    ctx = A.context(A.bars(spark, sf_dir))
    long_ = ctx.select("session_date", F.explode(F.array(F.struct(F.lit("market").alias("ticker"), F.col("market").alias("close")), F.struct(F.lit("vix").alias("ticker"), F.col("vix").alias("close")))).alias("x")).select("session_date", "x.*")
    wide = long_.groupBy("session_date").pivot("ticker", ["market", "vix"]).agg(F.first("close")).na.drop("all", subset=["market", "vix"])
    return wide.select("session_date", *rounded("market", "vix"))


@query(_BASE + "SELECT symbol, count(*) AS bars, max(session_date) AS last FROM bars GROUP BY 1 HAVING count(*) >= 500 AND max(session_date) >= DATE '2001-01-01'")
def p19_universe_by_history(spark, sf_dir):
    return B.liquid_universe(A.bars(spark, sf_dir), 500, "2001-01-01")


_TWO_BATCHES = """raw_rows AS (
  SELECT symbol, session_date, CASE WHEN pos % 7 = 0 THEN NULL ELSE open END AS open, high, low, CASE WHEN pos % 11 = 0 THEN -close ELSE close END AS close, volume, 1 AS v FROM bars
  UNION ALL SELECT symbol, session_date, open, high, low, close * 1.01, volume, 2 FROM bars WHERE pos % 3 = 0),
latest AS (SELECT * FROM (SELECT symbol, session_date, coalesce(open, close) AS open, coalesce(high, close) AS high, coalesce(low, close) AS low, close, volume,
  row_number() OVER (PARTITION BY symbol, session_date ORDER BY v DESC) AS n FROM raw_rows WHERE close > 0) WHERE n = 1)"""


def _two_batches(spark, sf_dir):
    bars = A.bars(spark, sf_dir)
    first = bars.select("symbol", "session_date", F.when(F.col("pos") % 7 != 0, F.col("open")).otherwise(F.lit(float("nan"))).alias("open"), "high", "low", F.when(F.col("pos") % 11 == 0, -F.col("close")).otherwise(F.col("close")).alias("close"), "volume", F.timestamp_seconds(F.lit(1)).alias("updated_at"))
    second = bars.where("pos % 3 = 0").select("symbol", "session_date", "open", "high", "low", (F.col("close") * 1.01).alias("close"), "volume", F.timestamp_seconds(F.lit(2)).alias("updated_at"))
    return first, second


@query(C.with_(C.BARS, _TWO_BATCHES) + f"SELECT symbol, session_date, {_r('open', 'high', 'low', 'close')} FROM latest")
def p1_normalize_history(spark, sf_dir):
    first, second = _two_batches(spark, sf_dir)
    return B.normalize(first.unionByName(second)).select("symbol", "session_date", *rounded("open", "high", "low", "close"))


@query(C.with_(C.BARS) + """, m AS (SELECT *, max(session_date) OVER (PARTITION BY symbol) AS last, row_number() OVER (PARTITION BY symbol ORDER BY session_date DESC) AS n FROM bars)
SELECT symbol, session_date, round(close, 6) AS close FROM m WHERE session_date >= last - INTERVAL 60 MONTH AND n <= 900""")
def p2_trailing_history(spark, sf_dir):
    return B.trailing_history(A.bars(spark, sf_dir), 60, 900).select("symbol", "session_date", *rounded("close"))


@query(_BASE + "SELECT symbol, session_date, round(close, 6) AS close FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY session_date DESC) AS n FROM bars) WHERE n <= 190")
def p21_chart_tail(spark, sf_dir):
    return B.tail(A.bars(spark, sf_dir), 190).select("symbol", "session_date", *rounded("close"))


@query(_BASE + "SELECT symbol, session_date, round(close, 6) AS close FROM bars WHERE session_date <= DATE '1999-06-30'")
def p20_frame_through_date(spark, sf_dir):
    return A.bars(spark, sf_dir).where("session_date <= date'1999-06-30'").select("symbol", "session_date", *rounded("close"))


@query(C.with_(C.BARS) + """SELECT symbol, session_date, session_date < DATE '2000-03-01' OR (session_date = DATE '2000-03-01' AND pos % 2 = 0) AS complete FROM bars""")
def p16_session_complete(spark, sf_dir):
    now = F.when(F.col("pos") % 2 == 0, F.to_timestamp(F.lit("2000-03-01 22:30:00"))).otherwise(F.to_timestamp(F.lit("2000-03-01 20:30:00")))
    return A.bars(spark, sf_dir).select("symbol", "session_date", B.session_complete(F.col("session_date"), now).alias("complete"))


@query(C.with_(C.BARS) + """, i AS (SELECT symbol, session_date, CASE WHEN symbol < 'P' THEN close * 1.02 ELSE close END AS new FROM bars WHERE pos % 2 = 0)
SELECT symbol, count(*) AS overlap, bool_or(abs(new / close - 1) > 0.005) AS drift FROM bars JOIN i USING (symbol, session_date) GROUP BY 1""")
def j16_overlap_drift(spark, sf_dir):
    bars = A.bars(spark, sf_dir)
    new = bars.where("pos % 2 = 0").withColumn("close", F.when(F.col("symbol") < "P", F.col("close") * 1.02).otherwise(F.col("close")))
    return B.drifted(bars, new)


@query(C.with_(C.BARS) + """SELECT symbol, session_date, round(CASE WHEN pos % 3 = 0 THEN close * 1.01 ELSE close END, 6) AS close FROM bars""")
def k1_upsert_bars(spark, sf_dir):
    bars = A.bars(spark, sf_dir).drop("pos").withColumn("updated_at", F.timestamp_seconds(F.lit(1)))
    _, second = _two_batches(spark, sf_dir)
    return B.upsert(bars, second).select("symbol", "session_date", *rounded("close"))


@query(C.with_(C.BARS) + """SELECT symbol, session_date, round(CASE WHEN pos % 3 = 0 THEN close * 1.01 ELSE close END, 6) AS close FROM bars WHERE symbol <> 'PROMO' OR pos % 3 = 0""")
def k2_full_refresh(spark, sf_dir):
    bars = A.bars(spark, sf_dir).drop("pos").withColumn("updated_at", F.timestamp_seconds(F.lit(1)))
    _, second = _two_batches(spark, sf_dir)
    return B.replace_series(bars, second, spark.createDataFrame([("PROMO",)], "symbol string")).select("symbol", "session_date", *rounded("close"))


@query(_BASE + """, w AS (SELECT *, (close / lag(close) OVER (PARTITION BY symbol ORDER BY pos) - 1) * 100 AS day_change, (close / lag(close, 21) OVER (PARTITION BY symbol ORDER BY pos) - 1) * 100 AS month_change,
  max(high) OVER (PARTITION BY symbol ORDER BY pos ROWS 251 PRECEDING) AS year_high, min(low) OVER (PARTITION BY symbol ORDER BY pos ROWS 251 PRECEDING) AS year_low,
  row_number() OVER (PARTITION BY symbol ORDER BY pos DESC) AS n, min(session_date) OVER (PARTITION BY symbol) AS first FROM bars)
SELECT symbol, """ + _r("close", "day_change", "month_change", "year_high", "year_low", "(session_date - first) / 365.25 AS years") + " FROM w WHERE n = 1")
def a52_quote_summary(spark, sf_dir):
    return B.quote_summary(A.bars(spark, sf_dir)).select("symbol", *rounded("close", "day_change", "month_change", "year_high", "year_low", "years"))


_DATE = "CAST(l_shipdate AS DATE)"


@query(f"""SELECT p_type AS symbol, count(*) AS bars, round(avg(CASE WHEN dayofweek(d) IN (0, 6) THEN 1.0 ELSE 0.0 END), 6) AS weekend_share,
  CASE WHEN avg(CASE WHEN dayofweek(d) IN (0, 6) THEN 1.0 ELSE 0.0 END) >= 0.15 AND count(*) >= 60 THEN 'calendar_daily' ELSE 'trading_sessions' END AS sampling
  FROM (SELECT DISTINCT p_type, {_DATE} AS d FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY 1""")
def w13_sampling_detection(spark, sf_dir):
    return X.sampling_of(A.bars(spark, sf_dir, weekends=True)).select("symbol", "bars", *rounded("weekend_share"), "sampling")


def _gate(agg: str, col: str, n: int) -> str:
    w = f"OVER ({P} ROWS {n - 1} PRECEDING)"
    return f"CASE WHEN count({col}) {w} >= {n} THEN {agg}({col}) {w} END"


_FEATURES = C.with_(C.BARS) + f""", f0 AS (SELECT *, lag(close) OVER ({P}) AS prev, ln(close / lag(close) OVER ({P})) AS log_ret FROM bars),
f1 AS (SELECT *, greatest(high - low, abs(high - prev), abs(low - prev)) AS tr, (close - open) / nullif(high - low, 0) AS body, CASE WHEN volume > 0 THEN volume END AS vol FROM f0),
f2 AS (SELECT *, {_gate('avg', 'close', 20)} AS s20, {_gate('avg', 'close', 50)} AS s50, {_gate('avg', 'close', 200)} AS s200,
  {_gate('stddev_samp', 'log_ret', 21)} * sqrt(252) * 100 AS vol21, {_gate('stddev_samp', 'log_ret', 63)} * sqrt(252) * 100 AS vol63,
  CASE WHEN count(close) OVER ({P} ROWS 251 PRECEDING) >= 63 THEN max(close) OVER ({P} ROWS 251 PRECEDING) END AS peak,
  {_gate('avg', 'tr', 14)} AS tr14, {_gate('avg', 'body', 5)} AS body5, {_gate('avg', 'vol', 5)} AS v5, {_gate('avg', 'vol', 20)} AS v20,
  (close / lag(close, 21) OVER ({P}) - 1) * 100 AS r21, (close / lag(close, 63) OVER ({P}) - 1) * 100 AS r63 FROM f1)
"""


@query(_FEATURES + "SELECT symbol, pos, " + _r("r21", "r63", "(close / s20 - 1) * 100 AS trend_short", "(s20 / s50 - 1) * 100 AS trend_medium", "(s50 / s200 - 1) * 100 AS trend_long", "vol21", "(vol21 / vol63 - 1) * 100 AS vol_ratio",
       "(close / peak - 1) * 100 AS drawdown", "tr14 / close * 100 AS atr", "body5 * 100 AS candle_pressure", "(v5 / v20 - 1) * 100 AS volume_ratio") + " FROM f2")
def w1_w8_price_features(spark, sf_dir):
    df = X.price_features(A.bars(spark, sf_dir))
    return df.select("symbol", F.col("pos").cast("long").alias("pos"), *rounded("r21", "r63", "trend_short", "trend_medium", "trend_long", "vol21", "vol_ratio", "drawdown", "atr", "candle_pressure", "volume_ratio"))


@query(C.with_(C.BARS).replace("WITH ", "WITH RECURSIVE ", 1) + f""", d AS (SELECT symbol, pos, close - lag(close) OVER ({P}) AS d FROM bars),
e AS (SELECT symbol, pos, CAST(0.0 AS DOUBLE) AS g, CAST(0.0 AS DOUBLE) AS l FROM d WHERE pos = 0
  UNION ALL SELECT d.symbol, d.pos, CASE WHEN d.pos = 1 THEN greatest(d.d, 0) ELSE e.g * (13.0 / 14) + greatest(d.d, 0) / 14 END, CASE WHEN d.pos = 1 THEN greatest(-d.d, 0) ELSE e.l * (13.0 / 14) + greatest(-d.d, 0) / 14 END
  FROM e JOIN d ON d.symbol = e.symbol AND d.pos = e.pos + 1)
SELECT symbol, pos, round(CASE WHEN pos < 14 THEN NULL WHEN g = 0 AND l = 0 THEN 50 WHEN l = 0 THEN 100 ELSE 100 - 100 / (1 + g / l) END, 6) AS rsi FROM e""")
def w4_wilder_rsi(spark, sf_dir):
    return X.wilder_rsi(A.bars(spark, sf_dir)).select("symbol", F.col("pos").cast("long").alias("pos"), *rounded("rsi"))


_ALIGNED = C.with_(C.BARS, C.CONTEXT) + """, lagged AS (SELECT session_date, lag(market) OVER (ORDER BY session_date) AS market, lag(vix) OVER (ORDER BY session_date) AS vix FROM context),
al AS (SELECT b.symbol, b.pos, b.session_date, l.market, l.vix FROM bars b ASOF LEFT JOIN lagged l ON b.session_date >= l.session_date)
"""


@query(_ALIGNED + "SELECT symbol, pos, round(market, 6) AS market, round(vix, 6) AS vix FROM al")
def j2_context_as_of(spark, sf_dir):
    bars = A.bars(spark, sf_dir)
    return X.align_context(bars, A.context(bars)).select("symbol", F.col("pos").cast("long").alias("pos"), *rounded("market", "vix"))


@query(_ALIGNED + f"""SELECT symbol, pos, round((market / lag(market, 21) OVER ({P}) - 1) * 100, 6) AS market_r21,
  round((market / CASE WHEN count(market) OVER ({P} ROWS 199 PRECEDING) >= 200 THEN avg(market) OVER ({P} ROWS 199 PRECEDING) END - 1) * 100, 6) AS market_trend FROM al""")
def w10_market_features(spark, sf_dir):
    bars = A.bars(spark, sf_dir)
    df = X.context_features(X.align_context(bars, A.context(bars)))
    return df.select("symbol", F.col("pos").cast("long").alias("pos"), *rounded("market_r21", "market_trend"))


@query(_ALIGNED + f""", l AS (SELECT symbol, pos, vix, list(vix) OVER ({P} ROWS 251 PRECEDING) AS xs, count(vix) OVER ({P} ROWS 251 PRECEDING) AS n FROM al)
SELECT symbol, pos, round(CASE WHEN vix IS NOT NULL AND n >= 60 THEN (len(list_filter(xs, lambda x: x < vix)) + (len(list_filter(xs, lambda x: x = vix)) + 1) / 2.0) / n * 100 END, 6) AS vix_percentile FROM l""")
def w9_vix_percentile(spark, sf_dir):
    bars = A.bars(spark, sf_dir)
    df = X.context_features(X.align_context(bars, A.context(bars)))
    return df.select("symbol", F.col("pos").cast("long").alias("pos"), *rounded("vix_percentile"))


@query(C.with_(C.BARS) + f""", o AS (SELECT *, coalesce(lead(open) OVER ({P}), lead(close) OVER ({P})) AS entry, count(close) OVER ({P} ROWS BETWEEN 1 FOLLOWING AND 21 FOLLOWING) AS n,
  max(high) OVER ({P} ROWS BETWEEN 1 FOLLOWING AND 21 FOLLOWING) AS hi, min(low) OVER ({P} ROWS BETWEEN 1 FOLLOWING AND 21 FOLLOWING) AS lo,
  lead(close, 5) OVER ({P}) AS c5, lead(close, 10) OVER ({P}) AS c10, lead(close, 21) OVER ({P}) AS c21 FROM bars)
SELECT symbol, pos, round((c5 / entry - 1) * 100, 6) AS fwd_5, round((c10 / entry - 1) * 100, 6) AS fwd_10, round((c21 / entry - 1) * 100, 6) AS fwd_21,
  round(CASE WHEN n = 21 THEN (hi / entry - 1) * 100 END, 6) AS max_upside, round(CASE WHEN n = 21 THEN (lo / entry - 1) * 100 END, 6) AS max_drawdown FROM o""")
def w11_forward_outcomes(spark, sf_dir):
    return X.outcomes(A.bars(spark, sf_dir)).select("symbol", F.col("pos").cast("long").alias("pos"), *rounded("fwd_5", "fwd_10", "fwd_21", "max_upside", "max_drawdown"))


@query(C.with_(C.BARS) + f""", s AS (SELECT symbol, pos, list(ln(close)) OVER ({P} ROWS 21 PRECEDING) AS ls FROM bars),
t AS (SELECT symbol, pos, list_transform(ls, lambda x: x - ls[1]) AS xs FROM s WHERE len(ls) = 22)
SELECT symbol, pos, unnest(range(22)) AS step, round(unnest(list_transform(xs, lambda x: (x - list_avg(xs)) / list_stddev_pop(xs))), 6) AS z FROM t""")
def w12_shape_vector(spark, sf_dir):
    return X.shapes(A.bars(spark, sf_dir)).select("symbol", F.col("pos").cast("long").alias("pos"), F.posexplode("shape").alias("step", "z")).select("symbol", "pos", F.col("step").cast("long").alias("step"), *rounded("z"))


@query(C.with_(C.WIDE) + """SELECT symbol, session_date, round(greatest(least(ret, hi), lo), 6) AS ret FROM (SELECT *, quantile_cont(ret, 0.02) OVER (PARTITION BY session_date) AS lo, quantile_cont(ret, 0.98) OVER (PARTITION BY session_date) AS hi
  FROM (SELECT symbol, session_date, (close / open - 1) * 100 AS ret FROM wide))""")
def p22_winsorize_by_date(spark, sf_dir):
    df = A.wide_bars(spark, sf_dir).withColumn("ret", (F.col("close") / F.col("open") - 1) * 100)
    return df.select("symbol", "session_date", *rounded(("ret", B.winsorized("ret", "session_date"))))


_READINGS = """items AS (SELECT p_brand || '-' || l_returnflag AS symbol, CAST(o_orderdate AS DATE) AS d, l_quantity, l_orderkey FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey),
half AS (SELECT symbol, CASE WHEN day(d) <= 15 THEN CAST(date_trunc('month', d) AS DATE) + 14 ELSE last_day(d) END AS settlement_date, l_quantity, l_orderkey FROM items),
readings AS (SELECT *, (days_to_cover / lag(days_to_cover) OVER (PARTITION BY symbol ORDER BY settlement_date) - 1) * 100 AS change_percent FROM (
  SELECT symbol, settlement_date, sum(l_quantity) / count(DISTINCT l_orderkey) AS days_to_cover FROM half GROUP BY 1, 2))"""


def readings(spark, sf_dir):
    """Half-monthly readings by name, for the lagged as-of join."""
    items, parts, orders = (A.table(spark, sf_dir, t) for t in ("lineitem", "part", "orders"))
    rows = items.join(parts, items.l_partkey == parts.p_partkey).join(orders, items.l_orderkey == orders.o_orderkey).withColumn("d", F.to_date("o_orderdate"))
    half = F.when(F.dayofmonth("d") <= 15, F.date_add(F.to_date(F.date_trunc("month", "d")), 14)).otherwise(F.last_day("d"))
    out = rows.groupBy(F.concat_ws("-", "p_brand", "l_returnflag").alias("symbol"), half.alias("settlement_date")).agg((F.sum("l_quantity") / F.count_distinct("l_orderkey")).alias("days_to_cover"))
    w = Window.partitionBy("symbol").orderBy("settlement_date")
    return out.withColumn("change_percent", (F.col("days_to_cover") / F.lag("days_to_cover").over(w) - 1) * 100)


@query(C.with_(C.WIDE, _READINGS) + """SELECT w.symbol, w.session_date, round(r.days_to_cover, 6) AS days_to_cover, round(r.change_percent, 6) AS change_percent
  FROM wide w ASOF LEFT JOIN (SELECT *, settlement_date + 14 AS available_from FROM readings) r ON w.symbol = r.symbol AND w.session_date >= r.available_from""")
def j3_readings_as_of_with_lag(spark, sf_dir):
    left = A.wide_bars(spark, sf_dir).select("symbol", "session_date")
    right = readings(spark, sf_dir).withColumn("session_date", F.date_add("settlement_date", 14))
    return B.as_of(left, right, "session_date", ["symbol"], ["days_to_cover", "change_percent"]).select("symbol", "session_date", *rounded("days_to_cover", "change_percent"))
