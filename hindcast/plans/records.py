"""Queries over the forecast ledger: recording, grading, marking, scoring."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from hindcast.operators import records as R
from hindcast.plans import ctes as C
from hindcast.plans.registry import query, rounded
from hindcast.sources import adapters as A

_LEDGER = C.with_(C.BARS, C.LEDGER)
_GRADED = C.with_(C.BARS, C.LEDGER, C.GRADED)
_BENCH = C.GRADED + """,
bench AS (SELECT w.entry_date, w.outcome_date, avg((o.close / e.open - 1) * 100) AS benchmark, count(*) AS constituents FROM (SELECT DISTINCT entry_date, outcome_date FROM graded WHERE status = 'graded') w
  JOIN bars e ON e.session_date = w.entry_date JOIN bars o ON o.symbol = e.symbol AND o.session_date = w.outcome_date WHERE e.open > 0 GROUP BY 1, 2),
scored AS (SELECT g.*, b.benchmark, CASE side WHEN 'long' THEN realized_return ELSE -realized_return END AS signed_return, CASE side WHEN 'long' THEN benchmark ELSE -benchmark END AS b,
  CASE WHEN probability_up = baseline_up_rate THEN NULL ELSE CAST((probability_up > baseline_up_rate) = (realized_return > 0) AS DOUBLE) END AS hit
  FROM graded g LEFT JOIN bench b USING (entry_date, outcome_date) WHERE status = 'graded' AND side IS NOT NULL AND (eligible IS NULL OR eligible))"""
_SCORED = C.with_(C.BARS, C.LEDGER, _BENCH)


def ledger(spark, sf_dir):
    return A.ledger(A.bars(spark, sf_dir))


def graded(spark, sf_dir):
    bars = A.bars(spark, sf_dir)
    return R.grade(A.ledger(bars), bars)


def scored(spark, sf_dir):
    bars = A.bars(spark, sf_dir)
    rows = R.scored(R.grade(A.ledger(bars), bars)).withColumn("mark_date", F.col("outcome_date"))
    return rows.join(R.benchmark_windows(rows, bars), ["entry_date", "mark_date"], "left")


@query(_GRADED + """SELECT side, count(*) AS n, round(avg(r), 6) AS mean_return, round(median(r), 6) AS median_return, round(avg(CAST(r > 0 AS DOUBLE)) * 100, 6) AS positive_share
FROM (SELECT side, CASE side WHEN 'long' THEN realized_return ELSE -realized_return END AS r FROM graded WHERE status = 'graded' AND side IS NOT NULL) GROUP BY 1""")
def grading_by_side(spark, sf_dir):
    """The flagship slice: bars, forward positions, grading, headline by side."""
    rows = R.scored(graded(spark, sf_dir).withColumn("eligible", F.lit(True)))
    return rows.groupBy("side").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("signed_return"), 6).alias("mean_return"), F.round(F.median("signed_return"), 6).alias("median_return"), F.round(F.avg((F.col("signed_return") > 0).cast("double")) * 100, 6).alias("positive_share"))


@query(_GRADED + "SELECT symbol, as_of_date, status, entry_date, outcome_date, round(realized_return, 6) AS realized_return FROM graded")
def j6_grade_by_position(spark, sf_dir):
    return graded(spark, sf_dir).select("symbol", "as_of_date", "status", "entry_date", "outcome_date", *rounded("realized_return"))


@query(_LEDGER + "SELECT symbol, as_of_date, horizon_days, id FROM ledger WHERE id % 3 <> 0")
def k3_append_absent(spark, sf_dir):
    rows = ledger(spark, sf_dir)
    return R.append_absent(rows.where("id % 3 = 0"), rows).select("symbol", "as_of_date", "horizon_days", "id")


@query(_LEDGER + """, f AS (SELECT *, CASE WHEN id % 4 = 0 THEN 'graded' ELSE 'pending' END AS st, CASE WHEN id % 5 = 0 THEN 9 END AS run FROM ledger)
SELECT symbol, as_of_date, CASE WHEN id % 7 <> 0 AND id % 2 = 0 AND (id % 3 = 0 OR (st = 'pending' AND run IS NULL)) THEN 77 WHEN id % 3 = 0 THEN NULL ELSE run END AS scan_run_id,
 CASE WHEN id % 3 = 0 THEN 'pending' WHEN id % 7 <> 0 AND id % 2 = 0 AND st = 'pending' AND run IS NULL THEN 'pending' ELSE st END AS status
FROM f WHERE id % 3 <> 0 OR id % 2 = 0 AND id % 7 <> 0""")
def k4_conditional_claim(spark, sf_dir):
    rows = ledger(spark, sf_dir).select("symbol", "as_of_date", "horizon_days", "id")
    old = rows.where("id % 3 <> 0").withColumns({"status": F.when(F.col("id") % 4 == 0, "graded").otherwise("pending"), "scan_run_id": F.when(F.col("id") % 5 == 0, F.lit(9)).cast("long")})
    new = rows.where("id % 2 = 0 and id % 7 <> 0").withColumns({"status": F.lit("pending"), "scan_run_id": F.lit(77).cast("long")})
    return R.claim(old, new).select("symbol", "as_of_date", F.col("scan_run_id").cast("int").alias("scan_run_id"), "status")


@query(_LEDGER + """SELECT symbol, as_of_date, round(CASE side WHEN 'long' THEN 1.5 WHEN 'short' THEN -1.5 END, 6) AS signed_return, eligible IS NULL OR eligible AS published,
 CASE WHEN probability_up = baseline_up_rate THEN NULL ELSE CAST((probability_up > baseline_up_rate) AS DOUBLE) END AS hit FROM ledger""")
def p7_p9_f25_signed_published_hit(spark, sf_dir):
    return ledger(spark, sf_dir).select("symbol", "as_of_date", R.signed(F.col("side"), F.lit(1.5)).alias("signed_return"), R.published(F.col("eligible")).alias("published"), R.decision_hit(F.col("probability_up"), F.col("baseline_up_rate"), F.lit(1.0)).alias("hit"))


@query(_GRADED + """SELECT symbol, as_of_date, CASE WHEN outcome_date IS NULL OR outcome_date > DATE '1999-06-30' THEN 'pending' ELSE status END AS status,
 CASE WHEN outcome_date <= DATE '1999-06-30' THEN round(realized_return, 6) END AS realized_return FROM graded WHERE CAST(created_at AS DATE) <= DATE '1999-06-30'""")
def p10_point_in_time_ledger(spark, sf_dir):
    return R.point_in_time(graded(spark, sf_dir), "1999-06-30").select("symbol", "as_of_date", "status", *rounded("realized_return"))


@query(_GRADED + """SELECT count(*) AS total, count_if(status = 'pending' AND horizon_date >= DATE '2001-11-01') AS pending, count_if(status = 'graded') AS matured, count_if(status = 'pending' AND horizon_date < DATE '2001-11-01') AS expired_ungraded,
 count_if(status = 'graded' AND (eligible IS NULL OR eligible) AND side IS NOT NULL) AS scored_matured, count_if(status = 'graded' AND NOT eligible) AS board_rejected, count_if(status = 'graded' AND eligible IS NULL) AS eligibility_unrecorded FROM graded""")
def a8_scorecard_accounting(spark, sf_dir):
    return R.accounting(graded(spark, sf_dir), "2001-11-01")


_METRICS = """count(*) AS sample_size, count(b) AS benchmark_sample_size, CASE WHEN count(*) >= 30 THEN round(avg(signed_return), 6) END AS mean_signal_return, CASE WHEN count(*) >= 30 THEN round(median(signed_return), 6) END AS median_signal_return,
 CASE WHEN count(*) >= 30 THEN round(coalesce(stddev_samp(signed_return), 0), 6) END AS standard_deviation, CASE WHEN count(*) >= 30 THEN round(avg(hit) * 100, 6) END AS hit_rate,
 CASE WHEN count(*) >= 30 THEN round(avg(b), 6) END AS mean_benchmark_return, CASE WHEN count(*) >= 30 THEN round(avg(signed_return - b), 6) END AS mean_excess_return"""


@query(_SCORED + f""", k AS (SELECT *, '21 sessions' AS horizon, strftime(as_of_date, '%Y-%m') AS cohort, coalesce(model_version, 'pre-provenance') AS mv FROM scored)
SELECT CASE WHEN grouping(side) = 0 THEN 'side' WHEN grouping(tier) = 0 THEN 'tier' WHEN grouping(horizon) = 0 THEN 'horizon' WHEN grouping(cohort) = 0 THEN 'cohort' WHEN grouping(mv) = 0 THEN 'model_version' ELSE 'all' END AS family,
 coalesce(side, tier, horizon, cohort, mv, 'all') AS label, {_METRICS} FROM k GROUP BY GROUPING SETS ((side), (tier), (horizon), (cohort), (mv), ())""")
def a6_a7_scorecard_breakdowns(spark, sf_dir):
    out = R.breakdowns(scored(spark, sf_dir))
    return out.select("family", "label", "sample_size", "benchmark_sample_size", *rounded(*R.METRICS))


@query(_GRADED + """, m AS (SELECT *, CAST(realized_return > 0 AS DOUBLE) AS y, coalesce(calibrated_probability_up, probability_up) AS p FROM graded WHERE status = 'graded'),
a AS (SELECT count(*) AS sample, count(calibrated_probability_up) AS calibrated_sample, avg(y) AS base, avg(pow(probability_up / 100 - y, 2)) AS raw, avg(pow(p / 100 - y, 2)) AS pub FROM m)
SELECT sample, calibrated_sample, round(base * 100, 6) AS realized_up_rate, round(raw, 6) AS brier_raw, round(pub, 6) AS brier_published, round(base * (1 - base), 6) AS brier_base_rate,
 round(100 * (1 - raw / (base * (1 - base))), 6) AS skill_raw_points, round(100 * (1 - pub / (base * (1 - base))), 6) AS skill_published_points FROM a""")
def a10_calibration_summary(spark, sf_dir):
    return R.calibration(graded(spark, sf_dir)).select("sample", "calibrated_sample", *rounded("realized_up_rate", "brier_raw", "brier_published", "brier_base_rate", "skill_raw_points", "skill_published_points"))


@query(_GRADED + """, m AS (SELECT CAST(realized_return > 0 AS DOUBLE) AS y, coalesce(calibrated_probability_up, probability_up) AS p FROM graded WHERE status = 'graded')
SELECT CASE WHEN p < 45 THEN '0-45' WHEN p < 50 THEN '45-50' WHEN p < 55 THEN '50-55' WHEN p < 60 THEN '55-60' WHEN p < 65 THEN '60-65' WHEN p < 70 THEN '65-70' ELSE '70-100' END AS bucket,
 count(*) AS "count", round(avg(p), 6) AS predicted_up, round(avg(y) * 100, 6) AS realized_up, round(avg(y) * 100 - avg(p), 6) AS gap_points FROM m WHERE p >= 0 AND p < 100 GROUP BY 1""")
def a11_calibration_buckets(spark, sf_dir):
    return R.calibration_buckets(graded(spark, sf_dir)).select("bucket", "count", *rounded("predicted_up", "realized_up", "gap_points"))


@query(_GRADED + """SELECT min(as_of_date) AS cohort_start, max(as_of_date) AS cohort_end, sha256(array_to_string(list_sort(list(DISTINCT model_version) FILTER (model_version IS NOT NULL)), ',')) AS vintages FROM graded""")
def a9_cohort_bounds_and_vintages(spark, sf_dir):
    return graded(spark, sf_dir).agg(F.min("as_of_date").alias("cohort_start"), F.max("as_of_date").alias("cohort_end"), F.sha2(F.array_join(F.array_sort(F.collect_set("model_version")), ","), 256).alias("vintages"))


@query(_GRADED + """, m AS (SELECT *, status = 'graded' AS done, CASE side WHEN 'long' THEN realized_return WHEN 'short' THEN -realized_return END AS s FROM graded)
SELECT symbol, count(*) AS total, count_if(done) AS graded, round(avg(CASE WHEN done AND probability_up <> baseline_up_rate THEN CAST((probability_up > baseline_up_rate) = (realized_return > 0) AS DOUBLE) END) * 100, 6) AS probability_accuracy,
 round(avg(CASE WHEN done AND s IS NOT NULL THEN CAST(s > 0 AS DOUBLE) END) * 100, 6) AS directional_accuracy, round(avg(CASE WHEN done THEN pow(probability_up / 100 - CAST(realized_return > 0 AS DOUBLE), 2) END), 6) AS brier_score FROM m GROUP BY 1""")
def a12_track_record(spark, sf_dir):
    return R.track_record(graded(spark, sf_dir)).select("symbol", "total", "graded", *rounded("probability_accuracy", "directional_accuracy", "brier_score"))


@query(_GRADED + """, w AS (SELECT DISTINCT entry_date, outcome_date FROM graded WHERE status = 'graded'), mem AS (SELECT DISTINCT symbol FROM bars WHERE symbol <> 'PROMO')
SELECT 1 AS universe_id, w.entry_date, w.outcome_date, round(avg((o.close / e.open - 1) * 100), 6) AS "return", count(*) AS constituent_count, (SELECT count(*) FROM mem) AS universe_count
FROM w JOIN bars e ON e.session_date = w.entry_date JOIN mem USING (symbol) JOIN bars o ON o.symbol = e.symbol AND o.session_date = w.outcome_date GROUP BY 1, 2, 3""")
def j1_a13_universe_return(spark, sf_dir):
    bars = A.bars(spark, sf_dir)
    windows = R.grade(A.ledger(bars), bars).where("status = 'graded'").select("entry_date", "outcome_date").distinct()
    members = bars.where("symbol <> 'PROMO'").select("symbol").distinct().withColumn("universe_id", F.lit(1))
    return R.universe_return(members, bars, windows).select("universe_id", "entry_date", "outcome_date", *rounded("return"), "constituent_count", "universe_count")


@query(_LEDGER + """SELECT count(*) AS rows, max(id) AS max_id, max(created_at) AS newest, CAST(sum(id % 1000) AS BIGINT) AS checksum FROM ledger""")
def a14_ledger_fingerprint(spark, sf_dir):
    return ledger(spark, sf_dir).agg(F.count(F.lit(1)).alias("rows"), F.max("id").alias("max_id"), F.max("created_at").alias("newest"), F.sum(F.col("id") % 1000).alias("checksum"))


@query(_LEDGER + """SELECT as_of_date, CASE WHEN count(DISTINCT model_version) > 1 THEN 'mixed:' || sha256(string_agg(DISTINCT model_version, ',' ORDER BY model_version)) ELSE min(model_version) END AS provenance FROM ledger GROUP BY 1""")
def a16_provenance_per_run(spark, sf_dir):
    v = F.array_sort(F.collect_set("model_version"))
    out = ledger(spark, sf_dir).groupBy("as_of_date").agg(v.alias("v"))
    return out.select("as_of_date", F.when(F.size("v") > 1, F.concat(F.lit("mixed:"), F.sha2(F.array_join("v", ","), 256))).when(F.size("v") == 1, F.col("v")[0]).alias("provenance"))


_MARKED = """, lastpos AS (SELECT symbol, max(pos) AS last FROM raw WHERE session_date <= DATE '2000-06-30' GROUP BY 1),
br AS (SELECT *, sum(CASE WHEN m > 300 OR m < -75 THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY pos) AS breaks FROM (SELECT *, (close / lag(close) OVER (PARTITION BY symbol ORDER BY pos) - 1) * 100 AS m FROM raw)),
mk AS (SELECT l.*, e.session_date AS e_date, e.open AS e_open, e.breaks AS e_breaks, m.session_date AS m_date, m.close AS m_close, m.breaks AS m_breaks, least(lp.last, l.signal_pos + 21) AS mpos
  FROM ledger l JOIN lastpos lp USING (symbol) LEFT JOIN br e ON e.symbol = l.symbol AND e.pos = l.signal_pos + 1 LEFT JOIN br m ON m.symbol = l.symbol AND m.pos = least(lp.last, l.signal_pos + 21)),
st AS (SELECT *, CASE WHEN e_date IS NULL OR mpos < signal_pos + 1 THEN 'awaiting_entry' WHEN e_open IS NULL OR e_open <= 0 OR m_close IS NULL THEN 'unpriced' WHEN m_breaks > e_breaks THEN 'suspect' WHEN mpos >= signal_pos + 21 THEN 'matured' ELSE 'open' END AS state FROM mk),
marked AS (SELECT symbol, as_of_date, side, horizon_days, state, CASE WHEN state IN ('open', 'matured', 'suspect') THEN e_date END AS entry_date, CASE WHEN state IN ('open', 'matured', 'suspect') THEN m_date END AS mark_date,
  CASE WHEN state IN ('open', 'matured', 'suspect') THEN mpos - signal_pos ELSE 0 END AS sessions_elapsed, CASE WHEN state IN ('open', 'matured', 'suspect') THEN (m_close / e_open - 1) * 100 END AS price_return,
  CASE WHEN state IN ('open', 'matured') THEN (m_close / e_open - 1) * 100 * CASE side WHEN 'long' THEN 1 WHEN 'short' THEN -1 END END AS signed_return FROM st)"""
_MARK = C.with_(C.RAW, C.LEDGER.replace("FROM bars", "FROM raw")) + _MARKED


def marked(spark, sf_dir):
    bars = A.raw_bars(spark, sf_dir)
    rows = A.ledger(bars).withColumns({"status": F.lit("pending"), "realized_return": F.lit(None).cast("double"), "entry_date": F.lit(None).cast("date"), "outcome_date": F.lit(None).cast("date")})
    return R.mark(rows, bars, "2000-06-30")


@query(_MARK + " SELECT symbol, as_of_date, state, entry_date, mark_date, sessions_elapsed, round(price_return, 6) AS price_return, round(signed_return, 6) AS signed_return FROM marked")
def j7_w15_mark_to_market(spark, sf_dir):
    return marked(spark, sf_dir).select("symbol", "as_of_date", "state", "entry_date", "mark_date", "sessions_elapsed", *rounded("price_return", "signed_return"))


@query(_GRADED + "SELECT symbol, as_of_date, 'matured' AS state, entry_date, outcome_date AS mark_date, round(realized_return, 6) AS price_return FROM graded WHERE status = 'graded'")
def j19_settled_positions(spark, sf_dir):
    bars = A.bars(spark, sf_dir)
    rows = R.grade(A.ledger(bars), bars).where("status = 'graded'")
    return R.mark(rows, bars, "2000-06-30").select("symbol", "as_of_date", "state", "entry_date", "mark_date", *rounded("price_return"))


@query(_MARK + """ SELECT count(*) AS total, count_if(state = 'open') AS open, count_if(state = 'matured') AS matured, count_if(state = 'awaiting_entry') AS awaiting_entry, count_if(state = 'unpriced') AS unpriced,
 count_if(state = 'suspect') AS suspect, count(signed_return) AS scored FROM marked""")
def a2_live_counts(spark, sf_dir):
    return R.live_counts(marked(spark, sf_dir))


_LIVE_BENCH = """, wins AS (SELECT DISTINCT entry_date, mark_date FROM marked WHERE entry_date IS NOT NULL), bench AS (SELECT w.*, avg((m.close / e.open - 1) * 100) AS benchmark, count(*) AS constituents FROM wins w JOIN raw e ON e.session_date = w.entry_date
  JOIN raw m ON m.symbol = e.symbol AND m.session_date = w.mark_date WHERE e.open > 0 GROUP BY 1, 2)"""


@query(_MARK + _LIVE_BENCH + " SELECT entry_date, mark_date, round(benchmark, 6) AS benchmark, constituents FROM bench")
def j12_benchmark_windows(spark, sf_dir):
    return R.benchmark_windows(marked(spark, sf_dir), A.raw_bars(spark, sf_dir)).select("entry_date", "mark_date", *rounded("benchmark"), "constituents")


_HEAD = """count(*) AS sample_size, round(avg(signed_return), 6) AS average_return, round(median(signed_return), 6) AS median_return, round(coalesce(stddev_samp(signed_return), 0), 6) AS standard_deviation,
 round(avg(CAST(signed_return > 0 AS DOUBLE)) * 100, 6) AS positive_share, round(max(signed_return), 6) AS best_return, round(min(signed_return), 6) AS worst_return, count(b) AS benchmark_sample_size, round(avg(b), 6) AS average_benchmark_return,
 round(avg(signed_return - b), 6) AS average_excess_return FROM (SELECT m.*, CASE side WHEN 'long' THEN benchmark ELSE -benchmark END AS b FROM marked m LEFT JOIN bench USING (entry_date, mark_date) WHERE signed_return IS NOT NULL)"""
_HEAD_COLS = ("average_return", "median_return", "standard_deviation", "positive_share", "best_return", "worst_return", "average_benchmark_return", "average_excess_return")


def _with_benchmark(spark, sf_dir):
    rows = marked(spark, sf_dir)
    return rows.join(R.benchmark_windows(rows, A.raw_bars(spark, sf_dir)), ["entry_date", "mark_date"], "left")


@query(_MARK + _LIVE_BENCH + " SELECT " + _HEAD)
def a1_j13_live_headline(spark, sf_dir):
    return R.headline(_with_benchmark(spark, sf_dir)).select("sample_size", "benchmark_sample_size", *rounded(*_HEAD_COLS))


@query(_MARK + _LIVE_BENCH + " SELECT side, " + _HEAD + " GROUP BY side")
def a3_live_side_breakdown(spark, sf_dir):
    return R.headline(_with_benchmark(spark, sf_dir), ["side"]).select("side", "sample_size", "benchmark_sample_size", *rounded(*_HEAD_COLS))


@query(_MARK + " SELECT max(sessions_elapsed) AS sessions_elapsed, CAST(max(horizon_days) AS BIGINT) AS sessions_total, round(least(100.0, max(sessions_elapsed) / max(horizon_days) * 100), 6) AS percent_complete FROM marked WHERE state IN ('open', 'matured')")
def a4_progress(spark, sf_dir):
    return R.progress(marked(spark, sf_dir)).select("sessions_elapsed", "sessions_total", *rounded("percent_complete"))


@query(C.with_(C.BARS) + "SELECT max(session_date) AS session_date FROM (SELECT session_date, count(DISTINCT symbol) AS n FROM bars GROUP BY 1) WHERE n >= greatest(1, floor(0.2 * (SELECT count(DISTINCT symbol) FROM bars)))")
def a5_latest_market_session(spark, sf_dir):
    return R.latest_session(A.bars(spark, sf_dir))


@query(_MARK + """ SELECT * FROM (SELECT side || '_' || CASE WHEN signed_return > 0 THEN 'winners' ELSE 'losers' END AS board, symbol, as_of_date, round(signed_return, 6) AS signed_return,
 row_number() OVER (PARTITION BY side, signed_return > 0 ORDER BY abs(signed_return) DESC, symbol, as_of_date) AS rank, count(*) OVER (PARTITION BY side, signed_return > 0) AS total FROM marked WHERE state IN ('open', 'matured') AND side IS NOT NULL AND signed_return <> 0) WHERE rank <= 50""")
def t1_leaderboards(spark, sf_dir):
    return R.leaderboards(marked(spark, sf_dir)).select("board", "symbol", "as_of_date", *rounded("signed_return"), "rank", "total")


@query(_MARK + " SELECT symbol, as_of_date, round(price_return, 6) AS price_return FROM marked WHERE state = 'suspect' ORDER BY abs(price_return) DESC, symbol, as_of_date LIMIT 100")
def t2_withheld_positions(spark, sf_dir):
    return marked(spark, sf_dir).where("state = 'suspect'").orderBy(F.abs("price_return").desc(), "symbol", "as_of_date").limit(100).select("symbol", "as_of_date", *rounded("price_return"))


@query(_LEDGER + "SELECT symbol, as_of_date, id FROM ledger ORDER BY as_of_date DESC, id DESC LIMIT 100")
def t4_forecast_listing(spark, sf_dir):
    return ledger(spark, sf_dir).orderBy(F.col("as_of_date").desc(), F.col("id").desc()).limit(100).select("symbol", "as_of_date", "id")


_PICK = "('0x' || substr(md5('{seed}-' || draw || '-' || slot), 1, 8))::BIGINT % k"


@query(_SCORED + f""", cl AS (SELECT as_of_date AS c, sum(signed_return) AS s, count(*) AS n FROM scored GROUP BY 1), num AS (SELECT *, row_number() OVER (ORDER BY c) - 1 AS i, count(*) OVER () AS k FROM cl),
dr AS (SELECT draw, {_PICK.format(seed='b')} AS i FROM (SELECT i AS slot, k FROM num) CROSS JOIN range(2000) t(draw)), m AS (SELECT draw, sum(s) / sum(n) AS m FROM dr JOIN num USING (i) GROUP BY 1)
SELECT round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high, round(avg(CAST(m <= 0 AS DOUBLE)), 6) AS p_not_positive FROM m""")
def a32_a33_cluster_bootstrap(spark, sf_dir):
    return R.bootstrap(scored(spark, sf_dir), "as_of_date", "signed_return").select(*rounded("low", "high", "p_not_positive"))


@query(_LEDGER + """, runs AS (SELECT as_of_date, dense_rank() OVER (ORDER BY as_of_date DESC) AS n FROM (SELECT DISTINCT as_of_date FROM ledger))
SELECT symbol, as_of_date, id FROM ledger JOIN runs USING (as_of_date) WHERE n <= 20""")
def k10_retention(spark, sf_dir):
    rows = ledger(spark, sf_dir)
    runs = rows.select("as_of_date").distinct().orderBy(F.col("as_of_date").desc()).limit(20)
    return rows.join(runs, "as_of_date", "left_semi").select("symbol", "as_of_date", "id")


@query(_GRADED + "SELECT DISTINCT symbol FROM graded WHERE status = 'pending'")
def u5_j18_symbols_with_open_forecasts(spark, sf_dir):
    return graded(spark, sf_dir).where("status = 'pending'").select("symbol").distinct()


@query(_LEDGER + """SELECT as_of_date, side, symbol, round(probability_up, 6) AS score, row_number() OVER (PARTITION BY as_of_date, side ORDER BY probability_up DESC, symbol) AS rank FROM ledger WHERE eligible AND side IS NOT NULL""")
def w14_rank_per_side(spark, sf_dir):
    w = Window.partitionBy("as_of_date", "side").orderBy(F.col("probability_up").desc(), "symbol")
    return ledger(spark, sf_dir).where("eligible and side is not null").select("as_of_date", "side", "symbol", F.col("probability_up").alias("score"), F.row_number().over(w).cast("long").alias("rank"))
