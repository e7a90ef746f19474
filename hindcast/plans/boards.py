"""Queries over boards, runs, snapshots and sinks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from hindcast.operators import features as X
from hindcast.operators import records as R
from hindcast.plans import ctes as C
from hindcast.plans.forecasts import _ANALYSIS, analyses
from hindcast.plans.registry import query, rounded
from hindcast.sources import adapters as A

_LEDGER = C.with_(C.BARS, C.LEDGER)
_RANKED = _LEDGER + """, rk AS (SELECT as_of_date, symbol, side, tier, probability_up AS score, row_number() OVER (PARTITION BY as_of_date, side ORDER BY probability_up DESC, symbol) AS rank FROM ledger WHERE side IS NOT NULL)"""


def ranked(spark, sf_dir):
    w = Window.partitionBy("as_of_date", "side").orderBy(F.col("probability_up").desc(), "symbol")
    rows = A.ledger(A.bars(spark, sf_dir)).where("side is not null")
    return rows.select("as_of_date", "symbol", "side", "tier", F.col("probability_up").alias("score"), F.row_number().over(w).cast("long").alias("rank"))


@query(_RANKED + " SELECT as_of_date, symbol, row_number() OVER (PARTITION BY as_of_date ORDER BY CASE side WHEN 'long' THEN 0 ELSE 1 END, rank, symbol) AS place FROM rk")
def t3_board_ordering(spark, sf_dir):
    w = Window.partitionBy("as_of_date").orderBy(F.when(F.col("side") == "long", 0).otherwise(1), "rank", "symbol")
    return ranked(spark, sf_dir).select("as_of_date", "symbol", F.row_number().over(w).cast("long").alias("place"))


@query(_RANKED + " SELECT as_of_date, symbol, rank FROM rk WHERE side = 'long' AND rank <= 3 AND tier IN ('strong', 'moderate')")
def p14_p15_board_side_and_tier_floor(spark, sf_dir):
    return ranked(spark, sf_dir).where("side = 'long' and rank <= 3 and tier in ('strong', 'moderate')").select("as_of_date", "symbol", "rank")


@query(_LEDGER + """SELECT symbol, max(as_of_date) AS latest, arg_max(id, as_of_date) AS id FROM ledger WHERE eligible GROUP BY 1""")
def t5_k7_latest_good(spark, sf_dir):
    rows = A.ledger(A.bars(spark, sf_dir)).where("eligible")
    return rows.groupBy("symbol").agg(F.max("as_of_date").alias("latest"), F.max_by("id", "as_of_date").alias("id"))


@query(_LEDGER + "SELECT DISTINCT symbol, as_of_date FROM ledger WHERE id % 3 <> 1")
def k9_u4_resume(spark, sf_dir):
    """Cells that a resumed run still has to do: all but those already written."""
    rows = A.ledger(A.bars(spark, sf_dir))
    return R.append_absent(rows.where("id % 3 = 1"), rows, ["symbol", "as_of_date"]).select("symbol", "as_of_date").distinct()


@query(_LEDGER + "SELECT symbol, as_of_date, id FROM ledger WHERE NOT (id % 4 = 0 AND symbol < 'M')")
def k11_delete_pending(spark, sf_dir):
    rows = A.ledger(A.bars(spark, sf_dir))
    gone = rows.where("id % 4 = 0 and symbol < 'M'").select(*R.KEY)
    return rows.join(gone, R.KEY, "left_anti").select("symbol", "as_of_date", "id")


@query(_LEDGER + "SELECT as_of_date, count(*) AS forecasts, count_if(eligible) AS eligible FROM ledger WHERE as_of_date NOT IN (SELECT as_of_date FROM ledger WHERE id % 5 = 0) GROUP BY 1")
def k6_snapshot_per_run(spark, sf_dir):
    """One report a run, appended only where the run has none yet."""
    rows = A.ledger(A.bars(spark, sf_dir))
    reports = rows.groupBy("as_of_date").agg(F.count(F.lit(1)).alias("forecasts"), F.count_if("eligible").alias("eligible"))
    return R.append_absent(rows.where("id % 5 = 0"), reports, ["as_of_date"])


@query(_LEDGER + "SELECT as_of_date, count(*) AS symbols, CASE WHEN count_if(eligible IS NULL) > 0 THEN 'partial' ELSE 'completed' END AS status, count(*) FILTER (eligible) AS eligible, count(*) FILTER (NOT eligible) AS refused FROM ledger GROUP BY 1")
def a15_scan_status(spark, sf_dir):
    rows = A.ledger(A.bars(spark, sf_dir))
    return rows.groupBy("as_of_date").agg(F.count(F.lit(1)).alias("symbols"), F.when(F.count_if(F.col("eligible").isNull()) > 0, "partial").otherwise("completed").alias("status"), F.count_if("eligible").alias("eligible"), F.count_if(~F.col("eligible")).alias("refused"))


@query(_LEDGER + """, u AS (SELECT 1 AS universe_id, 'types' AS universe, count(DISTINCT symbol) AS members FROM bars) SELECT l.symbol, l.as_of_date, u.universe, u.members FROM ledger l JOIN u USING (universe_id)""")
def j15_run_with_universe(spark, sf_dir):
    bars = A.bars(spark, sf_dir)
    u = bars.agg(F.count_distinct("symbol").alias("members")).select(F.lit(1).alias("universe_id"), F.lit("types").alias("universe"), "members")
    return A.ledger(bars).join(u, "universe_id").select("symbol", "as_of_date", "universe", "members")


@query(_LEDGER + """SELECT symbol, as_of_date, coalesce(side, CASE WHEN probability_up > 50 THEN 'long' WHEN probability_up < 50 THEN 'short' END) AS side, coalesce(CASE WHEN id % 3 <> 2 THEN tier END, 'unclassified') AS tier, eligible FROM ledger""")
def p8_p24_observation_fallbacks(spark, sf_dir):
    rows = A.ledger(A.bars(spark, sf_dir))
    lean = F.when(F.col("probability_up") > 50, "long").when(F.col("probability_up") < 50, "short")
    return rows.select("symbol", "as_of_date", F.coalesce("side", lean).alias("side"), F.coalesce(F.when(F.col("id") % 3 != 2, F.col("tier")), F.lit("unclassified")).alias("tier"), "eligible")


@query(C.with_(C.BARS) + """, e AS (SELECT symbol, pos, coalesce(lead(open) OVER w, lead(close) OVER w) AS entry, count(*) OVER (PARTITION BY symbol ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND 21 FOLLOWING) AS n FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY pos)),
t AS (SELECT e.symbol, e.pos, min(b.pos - e.pos) FILTER (round((b.low / entry - 1) * 100, 9) <= -1.5) AS stop_at, min(b.pos - e.pos) FILTER (round((b.high / entry - 1) * 100, 9) >= 1.5) AS target_at FROM e JOIN bars b ON b.symbol = e.symbol AND b.pos BETWEEN e.pos + 1 AND e.pos + 21 WHERE n = 21 GROUP BY 1, 2)
SELECT symbol, pos, CASE WHEN stop_at IS NULL AND target_at IS NULL THEN 'neither' WHEN target_at IS NULL OR stop_at <= target_at THEN 'stop' ELSE 'target' END AS touched FROM t""")
def f24_first_touch(spark, sf_dir):
    """Which of a stop and a target the path meets first; the stop wins ties."""
    out = X.outcomes(A.bars(spark, sf_dir), (21,), paths=True).where("low_path is not null")
    at = lambda c, hit: F.nullif(F.array_position(F.transform(c, hit), True), F.lit(0).cast("long"))
    rows = out.select("symbol", F.col("pos").cast("long").alias("pos"), at("low_path", lambda x: F.round(x, 9) <= -1.5).alias("s"), at("high_path", lambda x: F.round(x, 9) >= 1.5).alias("t"))
    return rows.select("symbol", "pos", F.when(F.col("s").isNull() & F.col("t").isNull(), "neither").when(F.col("t").isNull() | (F.col("s") <= F.col("t")), "stop").otherwise("target").alias("touched"))


@query(C.with_(C.BARS) + """, m AS (SELECT symbol, max(pos) AS last FROM bars GROUP BY 1) SELECT DISTINCT b.symbol, b.pos, round(b.close, 6) AS close FROM m, LATERAL (SELECT unnest(range(120)) AS i) r JOIN bars b ON b.symbol = m.symbol AND b.pos = CAST(floor(r.i * m.last / 119) AS BIGINT)""")
def w22_curve_downsample(spark, sf_dir):
    bars = A.bars(spark, sf_dir)
    last = bars.groupBy("symbol").agg(F.max("pos").alias("last"))
    points = last.select("symbol", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(119)), lambda i: F.floor(i * F.col("last") / 119).cast("int")))).alias("pos"))
    return bars.join(points, ["symbol", "pos"]).select("symbol", F.col("pos").cast("long").alias("pos"), *rounded("close"))


@query(_ANALYSIS + """SELECT symbol, as_of_date, CASE WHEN news > 0.15 AND edge >= 4 OR news < -0.15 AND edge <= -4 THEN 'confirms' WHEN news > 0.15 AND edge <= -4 OR news < -0.15 AND edge >= 4 THEN 'conflicts' ELSE 'silent' END AS story,
 round(greatest(-5, least(5, news * sqrt(least(1, (evidence % 7) / 5)) * 5)), 6) AS adjustment, as_of_date + CAST(floor(evidence % 12) AS INT) - 2 BETWEEN as_of_date - 1 AND as_of_date + 7 AS catalyst FROM (SELECT *, (agreement - 48) / 100 AS news FROM an)""")
def f17_f28_f29_news_rules(spark, sf_dir):
    news, n = (F.col("agreement") - 48) / 100, F.col("evidence") % 7
    up, down = F.col("edge") >= 4, F.col("edge") <= -4
    story = F.when(((news > 0.15) & up) | ((news < -0.15) & down), "confirms").when(((news > 0.15) & down) | ((news < -0.15) & up), "conflicts").otherwise("silent")
    adjusted = F.greatest(F.least(news * F.sqrt(F.least(F.lit(1.0), n / 5)) * 5, F.lit(5.0)), F.lit(-5.0))
    days = F.floor(F.col("evidence") % 12) - 2
    return analyses(spark, sf_dir).select("symbol", "as_of_date", story.alias("story"), *rounded(("adjustment", adjusted)), days.between(-1, 7).alias("catalyst"))


@query(C.with_(C.BARS) + """, days AS (SELECT CAST(d AS DATE) AS d, row_number() OVER (ORDER BY d) AS k FROM (SELECT unnest(generate_series(min(session_date), max(session_date) + 40, INTERVAL 1 DAY)) AS d FROM bars) WHERE dayofweek(d) BETWEEN 1 AND 5)
SELECT symbol, session_date, later.d AS horizon_date FROM bars JOIN days ON days.d = session_date JOIN days later ON later.k = days.k + 21""")
def f26_business_horizon(spark, sf_dir):
    """Twenty-one business days on: whole weeks, then days with the weekend stepped over."""
    n = 21
    day = F.weekday("session_date")
    over = (day + n % 5 > 4).cast("int") * 2
    return A.bars(spark, sf_dir).select("symbol", "session_date", F.date_add("session_date", F.lit(n // 5 * 7 + n % 5) + over).alias("horizon_date"))
