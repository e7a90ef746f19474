"""The audited forecast, the board made of it, forecasts as of a date, and the replay."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from hindcast.operators import analysis as Y
from hindcast.operators import episodes as N
from hindcast.operators import evidence as E
from hindcast.operators import features as X
from hindcast.operators import replay as P
from hindcast.plans import ctes as C
from hindcast.plans import bars as _bars  # noqa: F401  its SQL is used below
from hindcast.plans.registry import ORACLES, query, rounded
from hindcast.sources import adapters as A
from hindcast.streaming.jobs import scratch


def keeper(spark):
    """A writer of tables that several plans read, in the shared folder."""

    def keep(df, label):
        path = scratch(spark, label)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return keep


def whole(spark, sf_dir, gaps=False):
    """The analysis of every symbol as of its last session."""
    keep = keeper(spark)
    bars = keep(A.part_bars(spark, sf_dir), "bars")
    p = N.prepare(bars, A.context(bars), keep)
    return Y.Analysis(p, Y.latest(p), keep, gaps=gaps)


@query()
def c2_audited_forecast(spark, sf_dir):
    """Profile, audit and forecast of every symbol, from its own tuning, calibration and evaluation anchors."""
    a = whole(spark, sf_dir)
    told = a.forecasts.drop("n", "grade", "skill")
    df = told.join(a.audits, Y.CELL, "left")
    numbers = ("analog", "baseline", "combined", "calibrated", "edge", "typical", "range_low", "range_high", "probability_low", "probability_high", "accuracy", "base_accuracy", "brier", "base_brier", "skill", "adjustment", "raw_coverage", "adjusted_coverage")
    return df.select("symbol", "as_of", "sampling", "profile", "tuning", "calibration", "n", "matches", "years", "lean", "direction", "grade", "independent", "actionable", *rounded(*numbers), "evidence", "agreement", "headline", "explanation")


@query()
def c2_audit_strata(spark, sf_dir):
    """Evaluation forecasts of every symbol by size of edge, trend and stated probability (A48, A49)."""
    a = whole(spark, sf_dir)
    return Y.strata(a.records).select("symbol", "family", "stratum", "n", *rounded("accuracy", "brier", "edge", "stated", "observed", "mean_return"))


@query()
def c2_strategy(spark, sf_dir):
    """Long or cash after the audit's own non-overlapping signals, against holding (W20, W21)."""
    a = whole(spark, sf_dir)
    return Y.strategy(a.p, a.records).select("symbol", "periods", "trades", *rounded("win_rate", "exposure", "strategy_return", "hold_return", "max_drawdown", "hold_max_drawdown"))


@query()
def t6_f33_match_reasons(spark, sf_dir):
    """What made each episode of the current forecasts near: six features at most."""
    rows = whole(spark, sf_dir, gaps=True).matched.select("symbol", "anchor", "rank", "pos", "date", "quality", *rounded("distance", "weight"), F.posexplode("reasons").alias("place", "r"))
    return rows.select("symbol", "anchor", "rank", "pos", "date", "quality", "distance", "weight", "place", "r.label", "r.closeness", "r.share")


@query()
def c2_plan_and_projection(spark, sf_dir):
    """Trade plan and projection bands of the audited forecasts, widened by each one's own audit (F23, W23)."""
    a = whole(spark, sf_dir)
    told = a.forecasts.select("symbol", F.col("cell").alias("anchor"), "price", "direction")
    rows = a.followed
    bands = E.projection(rows, a.audits.select("symbol", "adjustment", "cell").withColumnRenamed("cell", "anchor"), by_anchor=True, horizons=a.p.rules)
    plans = E.trade_plan(rows, told)
    days = bands.groupBy("symbol", "anchor").agg(F.array_sort(F.collect_list(F.struct("day", *rounded("low", "median", "high")))).alias("bands"))  # at most a horizon of days
    return plans.join(days, E.BY, "left").select("symbol", "anchor", "action", *rounded("entry", "stop", "target", "stop_pct", "target_pct", "risk_reward", "hit_rate", "expectancy"), F.size("bands").alias("days"), F.to_json("bands").alias("bands"))


@query()
def c4_board(spark, sf_dir):
    """The board of the last sessions' audited forecasts, published as a run and read back."""
    a = whole(spark, sf_dir)
    base = scratch(spark, "board")
    P.publish(a.board, base, "latest")
    rows = P.published(spark, base)
    return rows.select("symbol", "as_of", "side", "tier", "eligible", "rank", F.array_join("blockers", "; ").alias("blockers"), *rounded("score", "expected_move", "adverse_move", "reward_risk", "win_probability", "edge"), "evidence", "agreement", "grade", "conflict")


@query()
def c3_as_of_forecast(spark, sf_dir):
    """What was forecast for every symbol at a date in the past, from nothing later, and what came of it."""
    keep = keeper(spark)
    bars = keep(A.part_bars(spark, sf_dir), "bars")
    out = P.as_of_forecast(bars, A.context(bars), "2000-06-30", keep)
    return out.select("symbol", "requested", "as_of", "direction", *rounded("combined", "baseline", "typical", "range_low", "range_high"), "evidence", "grade", "outcome_date", *rounded("realized_return"), "probability_correct", "direction_correct")


@query()
def c8_replay_panel(spark, sf_dir):
    """The replay of every 21st session, in two buckets of symbols, with what followed."""
    keep = keeper(spark)
    bars = keep(A.part_bars(spark, sf_dir), "replay-bars")
    dates = P.date_grid(P.sessions(bars.where("weekday(session_date) < 5")), 21)
    out = P.resume(bars, keep(A.context(bars), "replay-context"), keep(dates, "replay-dates"), scratch(spark, "replay"), keep)
    numbers = ("entry_price", "fwd_return", "min_low_pct", "max_high_pct", "combined", "edge", "typical", "range_low", "range_high", "skill", "score", "expected_move", "adverse_move", "reward_risk", "stop_pct", "target_pct")
    return out.select("symbol", "as_of", "cell", "available", "eligible", "side", "tier", "lean", "direction", "evidence", "agreement", "grade", "profile", "plan_action", *rounded(*numbers))


@query(C.with_(C.PART_BARS) + """, s AS (SELECT session_date, row_number() OVER (ORDER BY session_date) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT session_date FROM part_bars WHERE isodow(session_date) < 6)), u AS (SELECT * FROM s WHERE i < n - 21),
r AS (SELECT min(i) AS f FROM u WHERE session_date >= DATE '1999-01-01'), o AS (SELECT session_date FROM u WHERE i >= 21 AND i % 21 <> 0 ORDER BY md5('7-' || CAST(session_date AS VARCHAR)), session_date LIMIT 12)
SELECT 'grid' AS kind, session_date AS as_of FROM u WHERE i % 21 = 0 UNION ALL SELECT 'run', session_date FROM u, r WHERE i BETWEEN f AND f + 4 UNION ALL SELECT 'sample', session_date FROM o""")
def w27_date_grids(spark, sf_dir):
    """The three grids of a replay: every 21st session, a run of five, and twelve off the grid."""
    days = P.sessions(A.part_bars(spark, sf_dir).where("weekday(session_date) < 5"))
    grids = {"grid": P.date_grid(days, 21), "run": P.date_grid(days, 21, runs=[("1999-01-01", 5)]), "sample": P.date_grid(days, 21, sample=12)}
    rows = [g.select(F.lit(k).alias("kind"), "as_of") for k, g in grids.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


_REGIME = """r AS (SELECT *, CASE WHEN coalesce(trend_short, 0) > 1 AND coalesce(trend_long, 0) > 0 THEN 'Uptrend' WHEN coalesce(trend_short, 0) < -1 AND coalesce(trend_long, 0) < 0 THEN 'Downtrend' ELSE 'Transition' END AS trend,
 CASE WHEN coalesce(vol_ratio, 0) >= 25 THEN 'Expanding' WHEN coalesce(vol_ratio, 0) <= -20 THEN 'Calm' ELSE 'Normal' END AS volatility, CASE WHEN coalesce(drawdown, 0) <= -20 THEN 'Deep drawdown' WHEN coalesce(drawdown, 0) <= -8 THEN 'Below highs' ELSE 'Near highs' END AS fall FROM f)"""


@query(f"""WITH f AS (SELECT * REPLACE (CASE WHEN drawdown = 0 THEN 0.0 ELSE drawdown END AS drawdown), round(median(vol21) OVER (PARTITION BY symbol), 6) AS usual FROM ({ORACLES['w1_w8_price_features']})), {_REGIME}
SELECT symbol, pos, trend || ' · ' || volatility || ' volatility · ' || fall AS regime, CASE WHEN r21 IS NOT NULL AND drawdown IS NOT NULL THEN printf('Today is a %s with %s volatility, %+.1f%% one-month momentum, and price %.1f%% below its one-year high.', lower(trend), lower(volatility), r21, abs(drawdown)) END AS setup,
 concat_ws('; ', CASE WHEN r21 IS NOT NULL THEN 'Price path: ' || CASE WHEN r21 >= 8 THEN 'Strong advance' WHEN r21 >= 2 THEN 'Rising' WHEN r21 <= -8 THEN 'Sharp decline' WHEN r21 <= -2 THEN 'Falling' ELSE 'Sideways' END || printf(' (%+.1f%% over 21 trading days)', r21) END,
  CASE WHEN trend_short + trend_long IS NOT NULL THEN 'Trend regime: ' || trend || printf(' (Short %+.1f%% · Long %+.1f%%)', trend_short, trend_long) END,
  CASE WHEN vol21 IS NOT NULL THEN 'Volatility: ' || volatility || printf(' (%.1f%% annualized', vol21) || CASE WHEN coalesce(usual, 0) <> 0 THEN printf(' vs %.1f%% typical', usual) ELSE '' END || ')' END,
  CASE WHEN drawdown IS NOT NULL THEN 'Drawdown: ' || fall || printf(' (%.1f%% from the one-year high)', drawdown) END,
  CASE WHEN volume_ratio IS NOT NULL THEN 'Participation: ' || CASE WHEN volume_ratio >= 40 THEN 'Heavy volume' WHEN volume_ratio <= -30 THEN 'Quiet volume' ELSE 'Normal volume' END || printf(' (%+.0f%% vs 20-day volume)', volume_ratio) END) AS cards FROM r""")
def f30_f5_fingerprint_cards(spark, sf_dir):
    """Where every session stands: regime, setup sentence and the cards of its price features."""
    df = X.price_features(A.bars(spark, sf_dir))
    names = ("r21", "trend_short", "trend_long", "vol21", "vol_ratio", "drawdown", "volume_ratio")
    df = df.withColumns({c: F.round(c, 6) for c in names}).withColumn("usual", F.round(F.median("vol21").over(Window.partitionBy("symbol")), 6))
    regime = Y.regime(F.col("trend_short"), F.col("trend_long"), F.col("vol_ratio"), F.col("drawdown"))
    none = F.lit(None).cast("double")
    shown = E.cards({c: F.col(c) for c in names} | {"rsi": none, "market_trend": none}, regime, F.col("usual"))
    text = F.array_join(F.transform(shown, lambda c: F.concat(c["label"], F.lit(": "), c["value"], F.lit(" ("), c["detail"], F.lit(")"))), "; ")
    return df.select("symbol", F.col("pos").cast("long").alias("pos"), regime[3].alias("regime"), E.setup(regime, F.col("r21"), F.col("drawdown")).alias("setup"), text.alias("cards"))
