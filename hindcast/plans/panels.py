"""Queries over a replay panel and the factor screens."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from hindcast.operators import bars as B
from hindcast.operators import features as X
from hindcast.operators import panels as N
from hindcast.plans import ctes as C
from hindcast.plans.registry import query, rounded
from hindcast.sources import adapters as A

_PANEL = C.WIDE + """,
grid AS (SELECT session_date FROM (SELECT session_date, row_number() OVER (ORDER BY session_date) - 1 AS n FROM (SELECT DISTINCT session_date FROM wide)) WHERE n % 4 = 0),
p0 AS (SELECT *, lead(open) OVER w AS entry_price, lead(close, 4) OVER w AS ex, min(low) OVER (PARTITION BY symbol ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING) AS lo,
  max(high) OVER (PARTITION BY symbol ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING) AS hi, ('0x' || substr(md5(symbol || '-' || CAST(session_date AS VARCHAR)), 1, 8))::BIGINT AS m FROM wide WINDOW w AS (PARTITION BY symbol ORDER BY pos)),
p1 AS (SELECT symbol, session_date AS as_of, entry_price, (ex / entry_price - 1) * 100 AS fwd_return, (ex / close - 1) * 100 AS fwd_close_to_close, (lo / entry_price - 1) * 100 AS min_low_pct, (hi / entry_price - 1) * 100 AS max_high_pct,
  CAST(m % 101 AS DOUBLE) AS score, CASE m % 3 WHEN 0 THEN 'long' WHEN 1 THEN 'short' END AS side, CAST(m % 5 <> 0 AS INT) AS eligible, CAST(m % 9 <> 0 AS INT) AS available,
  CASE WHEN m % 7 < 2 THEN 'strong' WHEN m % 7 < 4 THEN 'moderate' ELSE 'speculative' END AS tier, CASE m % 3 WHEN 0 THEN 'bullish' WHEN 1 THEN 'bearish' ELSE '(no signal)' END AS signal,
  CAST(35 + m % 41 AS DOUBLE) AS probability_up, 0.5 + (m % 40) / 10 AS expected_move, (m % 7 - 2) / 2 AS adverse_move, (m % 25) / 10 AS reward_risk, CAST(-1 - m % 3 AS DOUBLE) AS stop_pct, CAST(1 + m % 4 AS DOUBLE) AS target_pct,
  CASE WHEN m % 2 = 0 THEN 'consider_buying' ELSE 'wait' END AS plan_action, CASE WHEN m % 9 = 0 THEN 'reason ' || (m % 6) END AS error, (m % 50) / 10 AS runtime_s
  FROM p0 JOIN grid USING (session_date) WHERE ex IS NOT NULL),
panel AS (SELECT *, CASE WHEN side = 'short' THEN -fwd_return ELSE fwd_return END AS strategy_return, CASE WHEN side = 'short' THEN universe_return - fwd_return ELSE fwd_return - universe_return END AS excess
  FROM (SELECT *, avg(fwd_return) OVER (PARTITION BY as_of) AS universe_return FROM p1))"""
_P = C.with_(_PANEL)


def panel(spark, sf_dir):
    return N.enrich(A.panel(A.wide_bars(spark, sf_dir)))


def _cohort_sql(keys: str, source: str = "panel", where: str = "true", stdev: bool = False) -> str:
    on = " AND ".join(f"a.{k} IS NOT DISTINCT FROM b.{k}" for k in keys.split(", "))
    picked = ", ".join(f"a.{k}" for k in keys.split(", "))
    sd = "round(a.stdev, 6) AS stdev, " if stdev else ""
    return f"""SELECT {picked}, a.n, a.dates, round(a.mean_return, 6) AS mean_return, round(a.median_return, 6) AS median_return, round(a.win, 6) AS win, {sd}round(b.mean_excess, 6) AS mean_excess, round(b.t_excess, 6) AS t_excess FROM
 (SELECT {keys}, count(*) AS n, count(DISTINCT as_of) AS dates, avg(strategy_return) AS mean_return, median(strategy_return) AS median_return, avg(CAST(round(strategy_return, 9) > 0 AS DOUBLE)) * 100 AS win, stddev_samp(strategy_return) AS stdev FROM {source} WHERE {where} GROUP BY {keys}) a
 JOIN (SELECT {keys}, CASE WHEN count(*) >= 3 THEN avg(x) END AS mean_excess, CASE WHEN count(*) >= 3 THEN avg(x) / nullif(stddev_samp(x) / sqrt(count(*)), 0) END AS t_excess FROM (SELECT {keys}, as_of, avg(excess) AS x FROM {source} WHERE {where} GROUP BY {keys}, as_of) GROUP BY {keys}) b ON {on}"""


_COHORT = ("mean_return", "median_return", "win", "mean_excess", "t_excess")


@query(_P + "SELECT symbol, as_of, round(fwd_return, 6) AS fwd_return, round(min_low_pct, 6) AS min_low_pct, round(max_high_pct, 6) AS max_high_pct, round(fwd_close_to_close, 6) AS fwd_close_to_close FROM panel")
def j8_panel_outcomes(spark, sf_dir):
    return panel(spark, sf_dir).select("symbol", "as_of", *rounded("fwd_return", "min_low_pct", "max_high_pct", "fwd_close_to_close"))


@query(_P + "SELECT symbol, as_of, round(universe_return, 6) AS universe_return, round(strategy_return, 6) AS strategy_return, round(excess, 6) AS excess FROM panel")
def j10_universe_excess(spark, sf_dir):
    return panel(spark, sf_dir).select("symbol", "as_of", *rounded("universe_return", "strategy_return", "excess"))


@query(_P + ", bench AS (SELECT as_of, median(fwd_return) AS spy FROM panel GROUP BY 1) SELECT p.symbol, p.as_of, round(CASE WHEN side = 'short' THEN spy - fwd_return ELSE fwd_return - spy END, 6) AS excess_vs_benchmark FROM panel p JOIN bench USING (as_of)")
def j9_benchmark_excess(spark, sf_dir):
    rows = panel(spark, sf_dir)
    bench = rows.groupBy("as_of").agg(F.median("fwd_return").alias("spy"))
    sign = F.when(F.col("side") == "short", -1.0).otherwise(1.0)
    return rows.join(bench, "as_of").select("symbol", "as_of", *rounded(("excess_vs_benchmark", sign * (F.col("fwd_return") - F.col("spy")))))


@query(_P + "SELECT count(*) AS cells, count(DISTINCT symbol) AS symbols, count(DISTINCT as_of) AS dates, count(error) AS errors, round(avg(eligible) * 100, 6) AS eligible_share, round(sum(runtime_s) / 3600, 6) AS cpu_hours FROM panel")
def a17_panel_coverage(spark, sf_dir):
    return N.coverage(panel(spark, sf_dir)).select("cells", "symbols", "dates", "errors", *rounded("eligible_share", "cpu_hours"))


@query(_P + "SELECT error AS reason, count(*) AS n FROM panel WHERE error IS NOT NULL GROUP BY 1 ORDER BY n DESC, reason LIMIT 5")
def a17_declined_reasons(spark, sf_dir):
    return panel(spark, sf_dir).where("error is not null").groupBy(F.col("error").alias("reason")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "reason").limit(5)


@query(_P + _cohort_sql("signal"))
def a18_a19_a20_return_by_verdict(spark, sf_dir):
    return N.cohorts(panel(spark, sf_dir), ["signal"]).select("signal", "n", "dates", *rounded(*_COHORT))


@query(_P + _cohort_sql("side, tier", where="eligible = 1 AND side IS NOT NULL") + " UNION ALL " + _cohort_sql("side", where="eligible = 1 AND side IS NOT NULL").replace("SELECT a.side,", "SELECT a.side, 'ALL',", 1))
def a20_return_by_side_and_tier(spark, sf_dir):
    rows = panel(spark, sf_dir).where("eligible = 1 and side is not null")
    both = rows.unionByName(rows.withColumn("tier", F.lit("ALL")))
    return N.cohorts(both, ["side", "tier"]).select("side", "tier", "n", "dates", *rounded(*_COHORT))


def _compound_sql(source: str, value: str = "ret", keys: str = "", per_year: float = 12.0) -> str:
    k, part, group = (f"{keys}, ", f"PARTITION BY {keys}", f"GROUP BY {keys}") if keys else ("", "", "")
    return f"""SELECT {k}count(*) AS periods, round(avg({value}), 6) AS mean, round((exp(sum(lg)) - 1) * 100, 6) AS total, round((exp(sum(lg) / (count(*) / {per_year})) - 1) * 100, 6) AS cagr, round(min(dd), 6) AS max_drawdown FROM (
 SELECT *, (c / max(c) OVER ({part} ORDER BY as_of) - 1) * 100 AS dd FROM (SELECT *, exp(sum(lg) OVER ({part} ORDER BY as_of)) AS c FROM (SELECT *, ln(greatest(1 + {value} / 100, 1e-12)) AS lg FROM {source} WHERE {value} IS NOT NULL))) {group}"""


_CURVE = ("mean", "total", "cagr", "max_drawdown")


@query(_P + ", u AS (SELECT as_of, avg(fwd_return) AS ret FROM panel GROUP BY 1) " + _compound_sql("u"))
def a21_w17_benchmark_curve(spark, sf_dir):
    u = panel(spark, sf_dir).groupBy("as_of").agg(F.avg("fwd_return").alias("ret"))
    return N.compounded(u).select("periods", *rounded(*_CURVE))


_BOARD = """, picks AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY as_of, side ORDER BY score DESC, symbol) AS nth FROM panel WHERE eligible = 1 AND side IS NOT NULL) WHERE nth <= 10),
periods AS (SELECT as_of, avg(strategy_return) AS ret, avg(excess) AS excess, count(*) AS n FROM picks GROUP BY 1)"""


@query(_P + _BOARD + " SELECT as_of, round(ret, 6) AS ret, round(excess, 6) AS excess, n FROM periods")
def a35_board_periods(spark, sf_dir):
    return N.periods(N.board(panel(spark, sf_dir), 10)).select("as_of", *rounded("ret", "excess"), "n")


@query(_P + _BOARD + """, cost AS (SELECT unnest([0, 10, 25, 50]) AS bps), net AS (SELECT bps, as_of, ret - bps / 100 AS ret FROM periods, cost) """ + _compound_sql("net", keys="bps"))
def a29_cost_sensitivity(spark, sf_dir):
    p = N.periods(N.board(panel(spark, sf_dir), 10)).withColumn("bps", F.explode(F.array(*[F.lit(b) for b in (0, 10, 25, 50)])))
    return N.compounded(p.withColumn("ret", F.col("ret") - F.col("bps") / 100), keys=["bps"]).select("bps", "periods", *rounded(*_CURVE))


@query(_P + """SELECT bucket, count(*) AS n, round(avg(probability_up), 6) AS predicted_up, round(avg(CAST(fwd_close_to_close > 0 AS DOUBLE)) * 100, 6) AS realized_up, round(avg(fwd_close_to_close), 6) AS mean_return FROM (
 SELECT *, CASE WHEN probability_up <= 45 THEN '<45' WHEN probability_up <= 50 THEN '45-50' WHEN probability_up <= 55 THEN '50-55' WHEN probability_up <= 60 THEN '55-60' WHEN probability_up <= 65 THEN '60-65' WHEN probability_up <= 70 THEN '65-70' ELSE '>70' END AS bucket FROM panel WHERE available = 1) GROUP BY 1""")
def a22_panel_calibration(spark, sf_dir):
    label = N.right_closed(F.col("probability_up"), [0, 45, 50, 55, 60, 65, 70, 100], ["<45", "45-50", "50-55", "55-60", "60-65", "65-70", ">70"])
    rows = panel(spark, sf_dir).where("available = 1").withColumn("bucket", label).where("bucket is not null")
    return rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("probability_up"), 6).alias("predicted_up"), F.round(F.avg((F.col("fwd_close_to_close") > 0).cast("double")) * 100, 6).alias("realized_up"), F.round(F.avg("fwd_close_to_close"), 6).alias("mean_return"))


@query(_P + """, e AS (SELECT *, CASE WHEN side = 'short' THEN -fwd_close_to_close ELSE fwd_close_to_close END AS realized FROM panel WHERE eligible = 1), q AS (SELECT quantile_cont(expected_move, [0.2, 0.4, 0.6, 0.8]) AS qs FROM e)
SELECT 1 + CAST(expected_move > qs[1] AS INT) + CAST(expected_move > qs[2] AS INT) + CAST(expected_move > qs[3] AS INT) + CAST(expected_move > qs[4] AS INT) AS q, count(*) AS n, round(avg(expected_move), 6) AS predicted, round(avg(realized), 6) AS realized, round(avg(excess), 6) AS excess FROM e, q GROUP BY 1""")
def a23_predicted_against_realized(spark, sf_dir):
    rows = panel(spark, sf_dir).where("eligible = 1").withColumn("realized", F.when(F.col("side") == "short", -F.col("fwd_close_to_close")).otherwise(F.col("fwd_close_to_close")))
    out = N.quantile_label(rows, "expected_move")
    return out.groupBy("q").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("expected_move"), 6).alias("predicted"), F.round(F.avg("realized"), 6).alias("realized"), F.round(F.avg("excess"), 6).alias("excess"))


@query(_P + _BOARD + """, u AS (SELECT as_of, avg(fwd_return) AS uni FROM panel GROUP BY 1)
SELECT CAST(year(as_of) AS INT) AS year, count(*) AS periods, round(avg(ret), 6) AS board_mean, round(avg(uni), 6) AS universe_mean, round((exp(sum(ln(1 + ret / 100))) - 1) * 100, 6) AS board_total, round((exp(sum(ln(1 + uni / 100))) - 1) * 100, 6) AS universe_total FROM periods JOIN u USING (as_of) GROUP BY 1""")
def a24_year_by_year(spark, sf_dir):
    rows = panel(spark, sf_dir)
    u = rows.groupBy("as_of").agg(F.avg("fwd_return").alias("uni"))
    both = N.periods(N.board(rows, 10)).join(u, "as_of")
    total = lambda c: F.round((F.exp(F.sum(F.log1p(F.col(c) / 100))) - 1) * 100, 6)
    return both.groupBy(F.year("as_of").alias("year")).agg(F.count(F.lit(1)).alias("periods"), F.round(F.avg("ret"), 6).alias("board_mean"), F.round(F.avg("uni"), 6).alias("universe_mean"), total("ret").alias("board_total"), total("uni").alias("universe_total"))


@query(_P + """SELECT count(*) AS n, round(avg(CAST(min_low_pct <= stop_pct AS DOUBLE)) * 100, 6) AS stop_hit, round(avg(CAST(max_high_pct >= target_pct AS DOUBLE)) * 100, 6) AS target_hit, round(avg(fwd_return), 6) AS held,
 round(avg(CASE WHEN min_low_pct <= stop_pct THEN stop_pct WHEN max_high_pct >= target_pct THEN target_pct ELSE fwd_return END), 6) AS managed FROM panel WHERE eligible = 1 AND side = 'long' AND plan_action = 'consider_buying'""")
def a25_stop_target_managed(spark, sf_dir):
    rows = panel(spark, sf_dir).where("eligible = 1 and side = 'long' and plan_action = 'consider_buying'")
    stop, target = F.col("min_low_pct") <= F.col("stop_pct"), F.col("max_high_pct") >= F.col("target_pct")
    managed = F.when(stop, F.col("stop_pct")).when(target, F.col("target_pct")).otherwise(F.col("fwd_return"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(stop.cast("double")) * 100, 6).alias("stop_hit"), F.round(F.avg(target.cast("double")) * 100, 6).alias("target_hit"), F.round(F.avg("fwd_return"), 6).alias("held"), F.round(F.avg(managed), 6).alias("managed"))


@query(_P + _BOARD + """, r AS (SELECT *, row_number() OVER (ORDER BY ret, as_of) AS lo, row_number() OVER (ORDER BY ret DESC, as_of DESC) AS hi, ntile(2) OVER (ORDER BY as_of) AS half FROM periods)
SELECT round(avg(ret), 6) AS full_mean, round(avg(CASE WHEN lo > 1 AND hi > 1 THEN ret END), 6) AS trimmed_mean, round(avg(CASE WHEN half = 1 THEN ret END), 6) AS first_half, round(avg(CASE WHEN half = 2 THEN ret END), 6) AS second_half FROM r""")
def a26_robustness(spark, sf_dir):
    p = N.periods(N.board(panel(spark, sf_dir), 10))
    r = p.withColumns({"lo": F.row_number().over(Window.orderBy("ret", "as_of")), "hi": F.row_number().over(Window.orderBy(F.col("ret").desc(), F.col("as_of").desc())), "half": F.ntile(2).over(Window.orderBy("as_of"))})
    mean = lambda c: F.round(F.avg(F.when(c, F.col("ret"))), 6)
    return r.agg(F.round(F.avg("ret"), 6).alias("full_mean"), mean((F.col("lo") > 1) & (F.col("hi") > 1)).alias("trimmed_mean"), mean(F.col("half") == 1).alias("first_half"), mean(F.col("half") == 2).alias("second_half"))


@query(_P + _BOARD + " SELECT symbol, round(count(*) * 100.0 / (SELECT count(*) FROM picks), 6) AS share FROM picks GROUP BY 1 ORDER BY count(*) DESC, symbol LIMIT 8")
def a26_pick_concentration(spark, sf_dir):
    picks = N.board(panel(spark, sf_dir), 10).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))
    return picks.withColumn("total", F.sum("n").over(Window.partitionBy())).orderBy(F.col("n").desc(), "symbol").limit(8).select("symbol", F.round(F.col("n") * 100.0 / F.col("total"), 6).alias("share"))


@query(_P + """, f AS (SELECT *, adverse_move <= 0 AS floored FROM panel WHERE eligible = 1) """ + _cohort_sql("floored", "f"))
def a27_reward_risk_floor(spark, sf_dir):
    rows = panel(spark, sf_dir).where("eligible = 1").withColumn("floored", F.col("adverse_move") <= 0)
    return N.cohorts(rows, ["floored"]).select("floored", "n", "dates", *rounded(*_COHORT))


@query(_P + """, f AS (SELECT *, CASE WHEN entry_price <= 95 THEN '<95' WHEN entry_price <= 100 THEN '95-100' WHEN entry_price <= 105 THEN '100-105' ELSE '>105' END AS price FROM panel WHERE eligible = 1) """ + _cohort_sql("price", "f", stdev=True))
def a28_by_share_price(spark, sf_dir):
    label = N.right_closed(F.col("entry_price"), [0, 95, 100, 105, 1e9], ["<95", "95-100", "100-105", ">105"])
    rows = panel(spark, sf_dir).where("eligible = 1").withColumn("price", label)
    return N.cohorts(rows, ["price"]).select("price", "n", "dates", *rounded(*_COHORT, "stdev"))


_BLOCKS = """, num AS (SELECT *, row_number() OVER (ORDER BY as_of) - 1 AS i, count(*) OVER () AS k FROM periods),
st AS (SELECT draw, slot, k, ('0x' || substr(md5('k-' || draw || '-' || slot), 1, 8))::BIGINT % (k - {b} + 1) AS start FROM (SELECT CAST(i / {b} AS BIGINT) AS slot, k FROM num WHERE i % {b} = 0) CROSS JOIN range({draws}) t(draw)),
m AS (SELECT draw, avg({v}) AS m FROM (SELECT draw, start + o AS i FROM st CROSS JOIN range({b}) u(o) WHERE slot * {b} + o < k) JOIN num USING (i) GROUP BY 1)
SELECT round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high, round(avg(CAST(m <= 0 AS DOUBLE)), 6) AS p_not_positive FROM m"""


@query(_P + _BOARD + _BLOCKS.format(b=4, v="ret", draws=4000))
def a30_block_bootstrap(spark, sf_dir):
    return N.block_bootstrap(N.periods(N.board(panel(spark, sf_dir), 10)), "ret").select(*rounded("low", "high", "p_not_positive"))


@query(_P + _BOARD + _BLOCKS.format(b=1, v="excess", draws=1500))
def a31_iid_bootstrap(spark, sf_dir):
    return N.block_bootstrap(N.periods(N.board(panel(spark, sf_dir), 10)), "excess", block=1, draws=1_500).select(*rounded("low", "high", "p_not_positive"))


_REGIME = C.with_(C.BARS, C.CONTEXT, _PANEL) + """, rg AS (SELECT session_date, market > CASE WHEN count(market) OVER (ORDER BY session_date ROWS 199 PRECEDING) >= 200 THEN avg(market) OVER (ORDER BY session_date ROWS 199 PRECEDING) END AS up,
  list(vix) OVER (ORDER BY session_date ROWS 251 PRECEDING) AS xs, vix FROM context),
rl AS (SELECT session_date, CASE WHEN up THEN 'up' ELSE 'down' END AS trend, CASE WHEN len(xs) >= 60 THEN (len(list_filter(xs, lambda x: x < vix)) + (len(list_filter(xs, lambda x: x = vix)) + 1) / 2.0) / len(xs) * 100 END AS pct FROM rg),
dates AS (SELECT DISTINCT as_of FROM panel), lab AS (SELECT d.as_of, l.trend, CASE WHEN pct <= 33 THEN 'calm' WHEN pct <= 67 THEN 'mid' WHEN pct <= 100 THEN 'stressed' END AS vol FROM dates d ASOF LEFT JOIN rl l ON d.as_of >= l.session_date),
tagged AS (SELECT p.*, trend, vol FROM panel p JOIN lab USING (as_of) WHERE eligible = 1 AND side IS NOT NULL) """


@query(_REGIME + "SELECT * FROM (" + _cohort_sql("trend, vol, side", "tagged") + ") WHERE n >= 20")
def j4_a34_w29_regime_breakdown(spark, sf_dir):
    ctx = A.context(A.bars(spark, sf_dir)).withColumns({"symbol": F.lit("m"), "pos": F.row_number().over(Window.orderBy("session_date")) - 1})
    pct = X.percentile_rank("vix", 252, 60)
    state = ctx.withColumns({"up": F.col("market") > X.sma(F.col("market"), 200), "pct": pct})
    vol = N.right_closed(F.col("pct"), [0, 33, 67, 100], ["calm", "mid", "stressed"])
    state = state.select("session_date", F.when(F.col("up"), "up").otherwise("down").alias("trend"), vol.alias("vol"))
    rows = panel(spark, sf_dir)
    dates = rows.select(F.col("as_of").alias("session_date")).distinct()
    labels = B.as_of(dates, state, "session_date", [], ["trend", "vol"]).withColumnRenamed("session_date", "as_of")
    tagged = rows.where("eligible = 1 and side is not null").join(labels, "as_of")
    return N.cohorts(tagged, ["trend", "vol", "side"]).where("n >= 20").select("trend", "vol", "side", "n", "dates", *rounded(*_COHORT))


_GRID = C.with_(C.WIDE) + """, days AS (SELECT session_date, row_number() OVER (ORDER BY session_date) - 1 AS g FROM (SELECT DISTINCT session_date FROM wide)), names AS (SELECT DISTINCT symbol FROM wide),
gr AS (SELECT n.symbol, d.session_date, d.g, w.open, w.high, w.low, w.close, w.volume FROM names n CROSS JOIN days d LEFT JOIN wide w ON w.symbol = n.symbol AND w.session_date = d.session_date)"""


def grid(spark, sf_dir):
    return N.densify(A.wide_bars(spark, sf_dir), ["open", "high", "low", "close", "volume"])


_BREADTH = """, bf AS (SELECT session_date, coalesce(round(close - CASE WHEN count(close) OVER (w ROWS 49 PRECEDING) >= 30 THEN avg(close) OVER (w ROWS 49 PRECEDING) END, 9) > 0, false) AS above, close / lag(close, 21) OVER w - 1 AS m, close / lag(close, 5) OVER w - 1 AS f FROM gr WINDOW w AS (PARTITION BY symbol ORDER BY g)),
breadth AS (SELECT session_date, 100 * avg(CAST(above AS DOUBLE)) AS pct_above, 100 * stddev_samp(m) AS dispersion_21d, 100 * median(m) AS median_21d_return, 100 * avg(CAST(coalesce(round(f, 9) > 0, false) AS DOUBLE)) AS advance_share_5d FROM bf GROUP BY 1)"""
_BREADTH = _BREADTH.replace("(w ROWS 49 PRECEDING)", "(PARTITION BY symbol ORDER BY g ROWS 49 PRECEDING)")


@query(_GRID + _BREADTH + " SELECT session_date, round(pct_above, 6) AS pct_above, round(dispersion_21d, 6) AS dispersion_21d, round(median_21d_return, 6) AS median_21d_return, round(advance_share_5d, 6) AS advance_share_5d FROM breadth")
def a36_market_breadth(spark, sf_dir):
    return N.breadth(grid(spark, sf_dir)).select("session_date", *rounded("pct_above", "dispersion_21d", "median_21d_return", "advance_share_5d"))


_MERGED = _GRID + _BREADTH + "," + _PANEL.replace(C.WIDE + ",", "").strip() + _BOARD + ", mg AS (SELECT p.as_of, p.excess, b.pct_above AS factor FROM periods p JOIN breadth b ON b.session_date = p.as_of)"


def _merged(spark, sf_dir):
    p = N.periods(N.board(panel(spark, sf_dir), 10))
    return p.join(N.breadth(grid(spark, sf_dir)).withColumnRenamed("session_date", "as_of"), "as_of")


@query(_MERGED + """, t AS (SELECT *, CASE WHEN row_number() OVER (ORDER BY as_of) - 1 < floor(count(*) OVER () / 2) THEN 'train' ELSE 'test' END AS part FROM mg), u AS (SELECT 'whole' AS part, factor, excess FROM t UNION ALL SELECT part, factor, excess FROM t),
rk AS (SELECT part, rank() OVER (PARTITION BY part ORDER BY factor) + (count(*) OVER (PARTITION BY part, factor) - 1) / 2 AS rx, rank() OVER (PARTITION BY part ORDER BY excess) + (count(*) OVER (PARTITION BY part, excess) - 1) / 2 AS ry FROM u)
SELECT part, count(*) AS n, round(corr(rx, ry), 6) AS rho FROM rk GROUP BY 1""")
def a37_factor_spearman(spark, sf_dir):
    rows = N.half_at_middle_date(_merged(spark, sf_dir))
    both = rows.unionByName(rows.withColumn("part", F.lit("whole")))
    ranked = both.withColumns({"rx": N.average_rank("pct_above", ["part"]), "ry": N.average_rank("excess", ["part"])})
    return ranked.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.round(N.correlation("rx", "ry"), 6).alias("rho"))


@query(_MERGED + """, md AS (SELECT median(factor) AS med FROM mg) SELECT count_if(factor <= med) AS n_low, count_if(factor > med) AS n_high, round(avg(excess) FILTER (factor <= med), 6) AS low_mean, round(avg(excess) FILTER (factor > med), 6) AS high_mean,
 round((avg(excess) FILTER (factor <= med) - avg(excess) FILTER (factor > med)) / sqrt(var_samp(excess) FILTER (factor <= med) / count_if(factor <= med) + var_samp(excess) FILTER (factor > med) / count_if(factor > med)), 6) AS t FROM mg, md""")
def a37_factor_halves_welch_t(spark, sf_dir):
    return N.halves_welch(_merged(spark, sf_dir), "pct_above", "excess").select("n_low", "n_high", *rounded("low_mean", "high_mean", "t"))


@query(_P + """, q AS (SELECT quantile_cont(reward_risk, [0.2, 0.4, 0.6, 0.8]) AS qs FROM panel), dd AS (SELECT as_of, CASE WHEN row_number() OVER (ORDER BY as_of) - 1 < floor(count(*) OVER () / 2) THEN 'train' ELSE 'test' END AS part FROM (SELECT DISTINCT as_of FROM panel)),
f AS (SELECT p.*, part, 1 + CAST(reward_risk > qs[1] AS INT) + CAST(reward_risk > qs[2] AS INT) + CAST(reward_risk > qs[3] AS INT) + CAST(reward_risk > qs[4] AS INT) AS q FROM panel p JOIN dd USING (as_of), q) SELECT * FROM (""" + _cohort_sql("q, part", "f") + ") WHERE n >= 30")
def a38_w28_factor_quintiles(spark, sf_dir):
    rows = N.half_at_middle_date(N.quantile_label(panel(spark, sf_dir), "reward_risk"))
    return N.cohorts(rows, ["q", "part"]).where("n >= 30").select("q", "part", "n", "dates", *rounded(*_COHORT))


def _features_sql() -> str:
    full = lambda agg, c, n: f"CASE WHEN count({c}) OVER (PARTITION BY symbol ORDER BY g ROWS {n - 1} PRECEDING) >= {n} THEN {agg}({c}) OVER (PARTITION BY symbol ORDER BY g ROWS {n - 1} PRECEDING) END"
    mom = ", ".join(f"close / lag(close, {n}) OVER w - 1 AS mom_{n}" for n in (1, 2, 3, 5, 10, 21))
    rev = ", ".join(f"-mom_{n} AS reversal_{n}" for n in (1, 2, 3, 5, 10, 21))
    return f""", g1 AS (SELECT *, close / lag(close) OVER w - 1 AS ret, nullif(high - low, 0) AS span, {mom}, open / lag(close) OVER w - 1 AS gap, close / open - 1 AS intraday_move, lead(close / open - 1) OVER w AS forward FROM gr WINDOW w AS (PARTITION BY symbol ORDER BY g)),
g2 AS (SELECT *, {rev}, {full('stddev_samp', 'ret', 5)} AS vol_5, {full('stddev_samp', 'ret', 21)} AS vol_21, close / {full('avg', 'close', 5)} - 1 AS sma_dist_5, close / {full('avg', 'close', 21)} - 1 AS sma_dist_21, close / {full('avg', 'close', 50)} - 1 AS sma_dist_50,
 (close - low) / span AS intraday_position, span / close AS true_range, close / {full('max', 'close', 21)} - 1 AS high_21, close / {full('min', 'close', 21)} - 1 AS low_21, {full('avg', 'volume', 5)} / nullif({full('avg', 'volume', 20)}, 0) - 1 AS volume_ratio, ln(close) AS price_level FROM g1)"""


@query(_GRID + _features_sql() + " SELECT symbol, session_date, " + ", ".join(f"round({f}, 6) AS {f}" for f in N.SEARCHED) + ", round(forward, 6) AS forward FROM g2 WHERE close IS NOT NULL")
def w24_w26_search_features(spark, sf_dir):
    df = N.search_features(grid(spark, sf_dir))
    w = Window.partitionBy("symbol").orderBy("g")
    df = df.withColumn("forward", F.lead(F.col("close") / F.col("open") - 1, 1).over(w)).where("close is not null")
    return df.select("symbol", "session_date", *rounded(*N.SEARCHED, "forward"))


_LONG = " UNION ALL ".join(f"SELECT session_date, symbol, '{f}' AS feature, round({f}, 9) AS value, round(forward, 9) AS forward FROM g2" for f in N.SEARCHED)
_IC = _GRID + _features_sql() + f""", lg AS (SELECT * FROM ({_LONG}) WHERE value IS NOT NULL AND forward IS NOT NULL),
rk AS (SELECT feature, session_date, rank() OVER (PARTITION BY feature, session_date ORDER BY value) + (count(*) OVER (PARTITION BY feature, session_date, value) - 1) / 2 AS rv, rank() OVER (PARTITION BY feature, session_date ORDER BY forward) + (count(*) OVER (PARTITION BY feature, session_date, forward) - 1) / 2 AS rf FROM lg),
ic AS (SELECT feature, session_date, count(*) AS names, corr(rv, rf) AS ic FROM rk GROUP BY 1, 2 HAVING count(*) >= 30)"""


def ic(spark, sf_dir):
    df = N.search_features(grid(spark, sf_dir))
    w = Window.partitionBy("symbol").orderBy("g")
    rows = N.melt(df.withColumns({f: F.round(f, 9) for f in N.SEARCHED}), N.SEARCHED, F.round(F.lead(F.col("close") / F.col("open") - 1, 1).over(w), 9))
    return N.rank_ic(rows)


@query(_IC + " SELECT feature, session_date, names, round(ic, 6) AS ic FROM ic WHERE ic IS NOT NULL AND NOT isnan(ic)")
def a39_daily_rank_ic(spark, sf_dir):
    return ic(spark, sf_dir).select("feature", "session_date", "names", *rounded("ic"))


@query(_IC + """, s AS (SELECT feature, count(*) AS days, avg(ic) AS ic, avg(ic) / nullif(stddev_samp(ic) / sqrt(count(*)), 0) AS t FROM ic WHERE ic IS NOT NULL AND NOT isnan(ic) GROUP BY 1)
SELECT feature, days, round(ic, 6) AS ic, round(t, 6) AS t, abs(t) > sqrt(2 * ln((SELECT count(*) FROM s))) AS beyond_noise FROM s""")
def a40_ic_summary(spark, sf_dir):
    s = N.ic_summary(ic(spark, sf_dir)).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy()))
    return s.select("feature", "days", *rounded("ic", "t"), (F.abs("t") > F.sqrt(2 * F.ln("n"))).alias("beyond_noise"))


_IC_BOTH = _IC + ", lg2 AS (SELECT * FROM (" + " UNION ALL ".join(f"SELECT session_date, symbol, '{f}' AS feature, round({f}, 9) AS value, round(next_ret, 9) AS forward FROM g3" for f in N.SEARCHED) + """) WHERE value IS NOT NULL AND forward IS NOT NULL),
rk2 AS (SELECT feature, session_date, rank() OVER (PARTITION BY feature, session_date ORDER BY value) + (count(*) OVER (PARTITION BY feature, session_date, value) - 1) / 2 AS rv, rank() OVER (PARTITION BY feature, session_date ORDER BY forward) + (count(*) OVER (PARTITION BY feature, session_date, forward) - 1) / 2 AS rf FROM lg2),
ic2 AS (SELECT feature, session_date, count(*) AS names, corr(rv, rf) AS ic FROM rk2 GROUP BY 1, 2 HAVING count(*) >= 30)"""
_HALF = "SELECT feature, count(*) AS days, avg(ic) AS ic, avg(ic) / nullif(stddev_samp(ic) / sqrt(count(*)), 0) AS t FROM {ic} WHERE ic IS NOT NULL AND NOT isnan(ic) {where} GROUP BY 1 HAVING count(*) >= 20"


@query(_IC_BOTH.replace(", lg AS (", ", g3 AS (SELECT *, lead(ret) OVER (PARTITION BY symbol ORDER BY g) AS next_ret FROM g2), lg AS (", 1) + """, ct AS (SELECT session_date AS cut FROM (SELECT DISTINCT session_date, g FROM gr) WHERE g = (SELECT (max(g) + 1) // 2 FROM gr)),
a AS (""" + _HALF.format(ic="ic, ct", where="AND session_date < cut") + "), b AS (" + _HALF.format(ic="ic, ct", where="AND session_date >= cut") + "), c AS (" + _HALF.format(ic="ic2", where="") + """),
j AS (SELECT a.feature, a.ic AS train_ic, a.t AS train_t, b.ic AS test_ic, b.t AS test_t, c.ic AS other_ic, a.days + b.days AS days, sqrt(2 * ln(count(*) OVER ())) AS noise FROM a JOIN b USING (feature) JOIN c USING (feature))
SELECT feature, days, round(train_ic, 6) AS train_ic, round(train_t, 6) AS train_t, round(test_ic, 6) AS test_ic, round(test_t, 6) AS test_t, round(other_ic, 6) AS other_ic, round(noise, 6) AS noise, coalesce(abs(train_t) > noise AND sign(train_ic) = sign(test_ic) AND abs(test_t) > 2, false) AS survives FROM j""")
def a40_replicated_factors(spark, sf_dir):
    """Factors chosen on the first half of the sessions, held against noise and the second half."""
    df = N.search_features(grid(spark, sf_dir))
    w = Window.partitionBy("symbol").orderBy("g")
    plain = df.withColumns({f: F.round(f, 9) for f in N.SEARCHED})
    targets = [F.round(F.lead(F.col("close") / F.col("open") - 1, 1).over(w), 9), F.round(F.lead("ret", 1).over(w), 9)]
    both = [N.rank_ic(N.melt(plain, N.SEARCHED, t)) for t in targets]
    days = df.select("session_date", "g").distinct()
    cut = days.where(F.col("g") == F.floor((days.agg(F.max("g")).first()[0] + 1) / F.lit(2))).first()[0]  # one date
    out = N.replicated(both[0], both[1], F.lit(cut), 20)
    return out.select("feature", (F.col("train_days") + F.col("test_days")).alias("days"), *rounded("train_ic", "train_t", "test_ic", "test_t", "other_ic", "noise"), "survives")


@query(_IC + """, s AS (SELECT feature, count(*) AS days, avg(ic) / nullif(stddev_samp(ic) / sqrt(count(*)), 0) AS t FROM ic WHERE ic IS NOT NULL AND NOT isnan(ic) GROUP BY 1) SELECT feature, days, round(abs(t), 6) AS t FROM s ORDER BY round(abs(s.t), 6) DESC, feature LIMIT 15""")
def t7_top_factors(spark, sf_dir):
    return N.ic_summary(ic(spark, sf_dir)).select("feature", "days", F.round(F.abs("t"), 6).alias("t")).orderBy(F.col("t").desc(), "feature").limit(15)


@query(_GRID + """, u AS (SELECT session_date, avg(r) AS mkt FROM (SELECT session_date, close / lag(close) OVER (PARTITION BY symbol ORDER BY g) - 1 AS r FROM gr) GROUP BY 1), mk AS (SELECT session_date, mkt AS mkt_1, CASE WHEN count(mkt) OVER (ORDER BY session_date ROWS 4 PRECEDING) >= 5 THEN avg(mkt) OVER (ORDER BY session_date ROWS 4 PRECEDING) END AS mkt_5 FROM u)
SELECT symbol, session_date, round(mom * mkt_1, 9) AS beta_x_mkt_1, round(mom * mkt_5, 9) AS beta_x_mkt_5 FROM (SELECT symbol, session_date, close / lag(close, 21) OVER (PARTITION BY symbol ORDER BY g) - 1 AS mom FROM gr) JOIN mk USING (session_date) WHERE mom IS NOT NULL""")
def w25_market_interactions(spark, sf_dir):
    df = N.search_features(grid(spark, sf_dir))
    by = Window.orderBy("session_date").rowsBetween(-4, 0)
    mkt = df.groupBy("session_date").agg(F.avg("ret").alias("mkt_1"))
    mkt = mkt.withColumn("mkt_5", F.when(F.count("mkt_1").over(by) >= 5, F.avg("mkt_1").over(by)))
    out = df.where("mom_21 is not null").join(mkt, "session_date")
    return out.select("symbol", "session_date", F.round(F.col("mom_21") * F.col("mkt_1"), 9).alias("beta_x_mkt_1"), F.round(F.col("mom_21") * F.col("mkt_5"), 9).alias("beta_x_mkt_5"))


@query(C.with_(C.WIDE) + "SELECT session_date AS as_of FROM (SELECT session_date, row_number() OVER (ORDER BY session_date) - 1 AS n FROM (SELECT DISTINCT session_date FROM wide)) WHERE n % 21 = 0")
def w27_as_of_grid(spark, sf_dir):
    dates = A.wide_bars(spark, sf_dir).select(F.col("session_date").alias("as_of")).distinct()
    return dates.withColumn("n", F.row_number().over(Window.orderBy("as_of")) - 1).where("n % 21 = 0").select("as_of")


@query(C.with_(C.WIDE) + "SELECT symbol, max(pos) + 1 AS bars, count_if(pos >= 100) AS cells FROM wide GROUP BY 1")
def a53_replay_cells(spark, sf_dir):
    return A.wide_bars(spark, sf_dir).groupBy("symbol").agg((F.max("pos") + 1).cast("long").alias("bars"), F.count_if(F.col("pos") >= 100).alias("cells"))
