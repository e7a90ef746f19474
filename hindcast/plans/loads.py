"""Queries over loads, stored payloads, scan gates, provenance, projections and the longer search features."""

from __future__ import annotations

from pyspark.sql import functions as F

from hindcast.operators import features as X
from hindcast.operators import loads as L
from hindcast.operators import panels as N
from hindcast.plans import ctes as C
from hindcast.plans.panels import _GRID, _P, grid, panel
from hindcast.plans.records import _GRADED, graded
from hindcast.plans.registry import query, rounded
from hindcast.sources import adapters as A

_LEDGER = C.with_(C.BARS, C.LEDGER)


@query(C.with_(C.WIDE) + """SELECT symbol, session_date, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, volume FROM wide WHERE session_date >= DATE '1994-01-01'
 AND symbol IN (SELECT symbol FROM wide GROUP BY 1 HAVING count(*) >= 250 AND max(session_date) >= DATE '1995-01-01')""")
def s12_wide_load(spark, sf_dir):
    """Bars since 1994 of names with a history long and fresh enough."""
    rows = L.wide_load(A.wide_bars(spark, sf_dir), least=250, newest="1995-01-01", start="1994-01-01")
    return rows.select("symbol", "session_date", *rounded("open", "high", "low", "close"), "volume")


@query(_P + "SELECT symbol, session_date, round(close, 6) AS close FROM wide WHERE symbol IN (SELECT symbol FROM panel WHERE score >= 99 AND side = 'long')")
def s13_closes_of_panel(spark, sf_dir):
    """Closes of the names that ever led the long side of the replay panel."""
    led = panel(spark, sf_dir).where("score >= 99 and side = 'long'")
    return L.closes_of(A.wide_bars(spark, sf_dir), led).select("symbol", "session_date", *rounded("close"))


@query(_LEDGER + """, st AS (SELECT l.*, round(close, 6) AS c, id % 29 <> 0 AS whole, model_version IS NOT NULL AS told FROM ledger l JOIN bars b ON b.symbol = l.symbol AND b.session_date = l.as_of_date)
SELECT id, symbol, as_of_date, CASE WHEN whole THEN probability_up END AS probability_up, CASE WHEN whole THEN tier END AS tier, CASE WHEN whole AND told THEN 1 + id % 2 ELSE 1 END AS session_offset, 'Open' AS price_field, CASE WHEN whole THEN c END AS signal_close FROM st""")
def s14_flattened_payloads(spark, sf_dir):
    """The ledger stored with a JSON payload and read back: records of before the entry was stored
    take its default, and a broken payload gives nulls."""
    bars = A.bars(spark, sf_dir)
    rows = A.ledger(bars).join(bars.select("symbol", F.col("session_date").alias("as_of_date"), F.round("close", 6).alias("close")), ["symbol", "as_of_date"])
    told = F.col("model_version").isNotNull()
    entry = F.when(told, F.struct((F.col("id") % 2 + 1).cast("int").alias("session_offset"), F.lit("Open").alias("price_field")))
    stored = F.to_json(F.struct("probability_up", "tier", F.when(~told, F.col("close")).alias("entry_price"), entry.alias("entry_reference"), F.when(told, F.col("close")).alias("signal_close")))
    broken = F.when(F.col("id") % 29 == 0, F.substring(stored, 1, 9)).otherwise(stored)
    read = L.forecast_records(rows.select("id", "symbol", "as_of_date", broken.alias("payload")))
    return read.select("id", "symbol", "as_of_date", "probability_up", "tier", F.col("entry_reference.session_offset").cast("long").alias("session_offset"), "entry_reference.price_field", "signal_close")


@query(C.with_(C.BARS) + """, r AS (SELECT o_orderkey AS run, CAST(o_orderdate AS DATE) - CAST(o_orderkey % 7 - 1 AS INT) AS upto, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) + to_hours(CAST(o_orderkey % 24 AS INT)) + to_minutes(CAST(o_orderkey % 4 * 15 AS INT)) AS now FROM orders),
s AS (SELECT DISTINCT session_date FROM bars), j AS (SELECT run, session_date AS session, (now AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS local FROM r ASOF LEFT JOIN s ON r.upto >= s.session_date)
SELECT run, session, CASE WHEN session IS NULL THEN 'unavailable' WHEN session > CAST(local AS DATE) THEN 'future' WHEN session = CAST(local AS DATE) AND CAST(local AS TIME) < TIME '17:15:00' THEN 'unconfirmed'
 WHEN date_diff('day', session, CAST(local AS DATE)) > 4 THEN 'stale' ELSE 'confirmed' END AS gate FROM j""")
def p18_benchmark_session_gate(spark, sf_dir):
    """A scan at each order's time, whose benchmark reaches one day ahead to five days back: the
    latest session that the feed holds against the clock in New York."""
    key = F.col("o_orderkey")
    day = F.col("o_orderdate").cast("date")
    now = day.cast("timestamp_ntz") + F.make_dt_interval(hours=(key % 24).cast("int"), mins=(key % 4 * 15).cast("int"))
    runs = A.table(spark, sf_dir, "orders").select(key.alias("run"), F.date_sub(day, (key % 7 - 1).cast("int")).alias("upto"), now.alias("now"))
    return L.session_gate(runs, A.bars(spark, sf_dir).select("session_date")).select("run", "session", "gate")


@query(_LEDGER + """SELECT id, coalesce(model_version, 'analog-v1') AS model_version, 'unknown' AS git_commit, CAST(as_of_date AS VARCHAR) AS data_vintage,
 'sha256:' || sha256('{"entry_reference":"next-session-open","model_version":"' || coalesce(model_version, 'analog-v1') || '","validation_path":"walk-forward-audit"}') AS config_hash FROM ledger""")
def f15_provenance_columns(spark, sf_dir):
    """Who made each forecast: version, commit, hash of the configuration and newest data."""
    rows = A.ledger(A.bars(spark, sf_dir)).select("id", "as_of_date", "model_version")
    return L.with_provenance(rows, "analog-v1", vintage=F.col("as_of_date").cast("string")).drop("as_of_date")


@query(_LEDGER + """, r AS (SELECT as_of_date AS session_date, count(*) AS total_count, count(*) FILTER (eligible) AS completed_count, count(*) FILTER (NOT eligible) AS failed_count FROM ledger GROUP BY 1)
SELECT *, completed_count + failed_count AS processed_count, CAST(round_even((completed_count + failed_count) / total_count * 100, 0) AS BIGINT) AS progress_percent FROM r""")
def p13_public_runs(spark, sf_dir):
    """One shown row a scan: what is done, refused and still open."""
    runs = A.ledger(A.bars(spark, sf_dir)).groupBy(F.col("as_of_date").alias("session_date")).agg(
        F.count(F.lit(1)).alias("total_count"), F.count_if("eligible").alias("completed_count"), F.count_if(~F.col("eligible")).alias("failed_count")
    )
    return L.public_runs(runs).select("session_date", "total_count", "completed_count", "failed_count", "processed_count", "progress_percent")


@query(_GRADED + """, e AS (SELECT id, probability_up / 100 AS p, baseline_up_rate / 100 AS b, round((probability_up - baseline_up_rate) / 100, 9) AS edge, (id % 21 - 8) / 2 AS median, round(realized_return, 9) AS actual FROM graded WHERE status = 'graded'),
s AS (SELECT *, CASE WHEN edge >= 0.04 AND median > 0.5 THEN 'bullish' WHEN edge <= -0.04 AND median < -0.5 THEN 'bearish' ELSE 'neutral' END AS signal FROM e)
SELECT id, round(p * 100, 1) AS probability_up, round(b * 100, 1) AS baseline_up_rate, round(edge * 100, 1) AS edge_points, round(median, 2) AS median_return, round(actual, 2) AS actual_return, actual > 0 AS actual_up, (p >= 0.5) = (actual > 0) AS probability_correct, signal,
 CASE signal WHEN 'bullish' THEN actual > 0 WHEN 'bearish' THEN actual < 0 END AS signal_correct FROM s""")
def p13_public_evaluations(spark, sf_dir):
    """Every graded forecast as it is shown."""
    share = lambda c: F.col(c) / 100
    rows = graded(spark, sf_dir).where("status = 'graded'").select(
        "id", share("probability_up").alias("probability_up"), share("baseline_up_rate").alias("baseline_up_rate"), F.round((F.col("probability_up") - F.col("baseline_up_rate")) / 100, 9).alias("edge"),
        ((F.col("id") % 21 - 8) / 2).alias("median_return"), F.round("realized_return", 9).alias("actual_return"),
    )
    return L.public_evaluations(rows)


def _long_sql() -> str:
    full = lambda agg, c, n: f"CASE WHEN count({c}) OVER (PARTITION BY symbol ORDER BY g ROWS {n - 1} PRECEDING) >= {n} THEN {agg}({c}) OVER (PARTITION BY symbol ORDER BY g ROWS {n - 1} PRECEDING) END"
    shown = ", ".join(f"round({f}, 6) AS {f}" for f in N.LONG_SEARCHED)
    rsi = lambda n: f"round(100 - 100 / (1 + g{n} / nullif(l{n}, 0)), 6) AS rsi_{n}"
    step = lambda n, c, v: f"CASE WHEN d.pos = 1 THEN greatest({v}, 0) ELSE e.{c}{n} * ({n - 1}.0 / {n}) + greatest({v}, 0) / {n} END"
    steps = ", ".join(step(n, c, v) for n in (5, 14) for c, v in (("g", "d.d"), ("l", "-d.d")))
    zero = ", ".join(f"CAST(0 AS DOUBLE) AS {c}{n}" for n in (5, 14) for c in "gl")
    return _GRID.replace("WITH ", "WITH RECURSIVE ", 1) + f""", g1 AS (SELECT *, close / lag(close) OVER w - 1 AS ret, close / lag(close, 63) OVER w - 1 AS mom_63, close / lag(close, 126) OVER w - 1 AS mom_126 FROM gr WINDOW w AS (PARTITION BY symbol ORDER BY g)),
g2 AS (SELECT *, -mom_63 AS reversal_63, -mom_126 AS reversal_126, {full('stddev_samp', 'ret', 63)} AS vol_63, close / {full('avg', 'close', 63)} - 1 AS sma_dist_63, close / {full('avg', 'close', 200)} - 1 AS sma_dist_200,
 {full('stddev_samp', 'ret', 5)} / nullif({full('stddev_samp', 'ret', 21)}, 0) - 1 AS vol_ratio, close / {full('max', 'close', 252)} - 1 AS drawdown_252, ln(1 + close * nullif({full('avg', 'volume', 20)}, 0)) AS dollar_volume FROM g1),
d AS (SELECT symbol, session_date, pos, close - lag(close) OVER (PARTITION BY symbol ORDER BY pos) AS d FROM wide),
e AS (SELECT symbol, session_date, pos, {zero} FROM d WHERE pos = 0 UNION ALL SELECT d.symbol, d.session_date, d.pos, {steps} FROM e JOIN d ON d.symbol = e.symbol AND d.pos = e.pos + 1)
SELECT symbol, session_date, {shown}, {rsi(5)}, {rsi(14)} FROM g2 JOIN e USING (symbol, session_date) WHERE close IS NOT NULL"""


@query(_long_sql())
def w24_long_windows_and_rsi(spark, sf_dir):
    """The search's longer windows over the grid; its two strength indexes over a name's own bars."""
    bars = A.wide_bars(spark, sf_dir).select("symbol", "session_date", "pos", "close")
    both = X.wilder_rsi(X.wilder_rsi(bars, 5, warm=False).withColumnRenamed("rsi", "rsi_5"), 14, warm=False).withColumnRenamed("rsi", "rsi_14")
    rows = N.long_search_features(grid(spark, sf_dir)).where("close is not null").select("symbol", "session_date", *N.LONG_SEARCHED)
    return rows.join(both.select("symbol", "session_date", "rsi_5", "rsi_14"), ["symbol", "session_date"]).select("symbol", "session_date", *rounded(*N.LONG_SEARCHED, "rsi_5", "rsi_14"))
