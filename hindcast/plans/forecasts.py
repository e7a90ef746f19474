"""Queries of the forecasting core: matching, summaries, board scores."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from hindcast.functions import scalars as S
from hindcast.operators import features as X
from hindcast.operators import matching as M
from hindcast.plans import ctes as C
from hindcast.plans.registry import query, rounded
from hindcast.sources import adapters as A


def prepared(spark, sf_dir):
    """Features, shapes and outcomes of every bar, once for all anchors."""
    bars = A.bars(spark, sf_dir)
    feats = X.context_features(X.align_context(X.price_features(bars), A.context(bars)))
    # read by scales, targets and distances alike
    return feats.join(X.shapes(bars), ["symbol", "pos"], "left").persist(), X.outcomes(bars), bars


def anchors_of(bars):
    """Three anchors a symbol: today, a month and three months ago."""
    last = bars.groupBy("symbol").agg(F.max("pos").alias("last"))
    return last.select("symbol", F.explode(F.array(*[F.col("last") - k for k in (0, 21, 63)])).alias("anchor"))


@query()
def j11_distances(spark, sf_dir):
    feats, _, bars = prepared(spark, sf_dir)
    return M.distances(feats, anchors_of(bars)).select("symbol", "anchor", "pos", *rounded("distance"))


_SCALES = C.with_(C.BARS) + """, f AS (SELECT symbol, pos, (close / lag(close, 21) OVER w - 1) * 100 AS r21, (close / lag(close, 63) OVER w - 1) * 100 AS r63 FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY pos)),
an AS (SELECT symbol, max(pos) - k AS anchor FROM bars CROSS JOIN (SELECT unnest([0, 21, 63]) AS k) GROUP BY symbol, k), pr AS (SELECT an.symbol, anchor, pos, r21, r63 FROM an JOIN f ON f.symbol = an.symbol AND pos BETWEEN 260 AND anchor - 42),
lg AS (SELECT symbol, anchor, 'r21' AS feature, r21 AS v FROM pr UNION ALL SELECT symbol, anchor, 'r63', r63 FROM pr), md AS (SELECT symbol, anchor, feature, median(v) AS med, stddev_pop(v) AS sd, count(v) / count(*) AS coverage FROM lg GROUP BY 1, 2, 3),
ma AS (SELECT symbol, anchor, feature, median(abs(v - med)) * 1.4826 AS mad FROM lg JOIN md USING (symbol, anchor, feature) GROUP BY 1, 2, 3)
SELECT symbol, anchor, feature, round(coverage, 6) AS coverage, round(med, 6) AS med, round(CASE WHEN mad > 1e-9 THEN mad WHEN sd > 1e-9 THEN sd ELSE 1 END, 6) AS scale FROM md JOIN ma USING (symbol, anchor, feature)"""


@query(_SCALES)
def a44_a45_robust_scales(spark, sf_dir):
    bars = A.bars(spark, sf_dir)
    pairs = M.candidates(X.price_features(bars).withColumns({f: F.lit(None).cast("double") for f in X.FEATURES[-3:]}).withColumn("shape", F.lit(None)), anchors_of(bars))
    return M.robust_scales(pairs, ("r21", "r63")).select("symbol", "anchor", "feature", *rounded("coverage", "med", "scale"))


@query()
def w19_f7_f8_spaced_matches(spark, sf_dir):
    feats, _, bars = prepared(spark, sf_dir)
    return M.matches(feats, anchors_of(bars)).select("symbol", "anchor", "rank", "pos", *rounded("distance", "weight"), "quality")


@query(C.with_(C.BARS) + """, o AS (SELECT symbol, pos, lead(close, 21) OVER w / coalesce(lead(open) OVER w, lead(close) OVER w) - 1 AS fwd FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY pos)),
an AS (SELECT symbol, max(pos) - k AS anchor FROM bars CROSS JOIN (SELECT unnest([0, 21, 63]) AS k) GROUP BY symbol, k)
SELECT an.symbol, anchor, round(coalesce((count_if(fwd > 0) + 0.5) / (count(fwd) + 1), 0.5), 6) AS base FROM an LEFT JOIN o ON o.symbol = an.symbol AND pos BETWEEN 260 AND anchor - 42 AND (pos - 260) % 21 = 0 AND pos + 21 < anchor AND fwd IS NOT NULL GROUP BY 1, 2""")
def w16_base_rates(spark, sf_dir):
    bars = A.bars(spark, sf_dir)
    return M.base_rates(X.outcomes(bars), anchors_of(bars), 21).select("symbol", "anchor", *rounded("base"))


@query()
def c1_a43_a46_f9_forecast(spark, sf_dir):
    """The preliminary forecast of three anchors a symbol."""
    feats, outs, bars = prepared(spark, sf_dir)
    anchors = anchors_of(bars)
    out = M.direct(M.summarize(M.matches(feats, anchors), outs, M.base_rates(outs, anchors, 21)))
    return out.select("symbol", "anchor", "matches", "years", "direction", *rounded("effective_n", "probability", "low10", "high90", "baseline", "edge", "p20", "median", "p80", "best", "worst"))


@query(C.with_(C.BARS) + """, last AS (SELECT symbol, max(pos) + 1 AS n FROM bars GROUP BY 1), b AS (SELECT symbol, 260 + 42 + 8 * 42 AS first, n - 21 - 1 AS last FROM last),
s AS (SELECT *, least(first + greatest(5 * 42, CAST(round(0.4 * (last - first)) AS BIGINT)), last - 81) AS split FROM b WHERE last - 81 > first AND last > first)
SELECT symbol, 'tuning' AS kind, anchor FROM (SELECT symbol, a.anchor, row_number() OVER (PARTITION BY symbol ORDER BY a.anchor DESC) AS k FROM s, LATERAL (SELECT unnest(range(first, split + 1, 42)) AS anchor) a) WHERE k <= 30
UNION ALL SELECT symbol, 'evaluation', anchor FROM (SELECT symbol, a.anchor, row_number() OVER (PARTITION BY symbol ORDER BY a.anchor DESC) AS k FROM s, LATERAL (SELECT unnest(range(split + 21, last + 1, 5)) AS anchor) a) WHERE k <= 260""")
def w18_audit_anchors(spark, sf_dir):
    n = A.bars(spark, sf_dir).groupBy("symbol").agg((F.max("pos") + 1).alias("n"))
    return S.audit_anchors(n).select("symbol", "kind", F.col("anchor").cast("long").alias("anchor"))


_PRED = C.with_(C.BARS, C.LEDGER, C.GRADED) + """, pr AS (SELECT symbol, signal_pos AS pos, probability_up / 100 AS p, baseline_up_rate / 100 AS base, realized_return AS actual, CAST(realized_return > 0 AS DOUBLE) AS y, (id % 9 - 4) / 2 AS med, (id % 9 - 4) / 2 - 3 AS lo, (id % 9 - 4) / 2 + 3 AS hi,
 id % 2 = 0 AS cal FROM graded WHERE status = 'graded')"""


def predictions(spark, sf_dir):
    from hindcast.plans.records import graded

    rows = graded(spark, sf_dir).where("status = 'graded'")
    med = (F.col("id") % 9 - 4) / 2
    return rows.select("symbol", F.col("signal_pos").alias("pos"), (F.col("probability_up") / 100).alias("p"), (F.col("baseline_up_rate") / 100).alias("base"), F.col("realized_return").alias("actual"), (F.col("realized_return") > 0).cast("double").alias("y"), med.alias("med"), (med - 3).alias("lo"), (med + 3).alias("hi"), (F.col("id") % 2 == 0).alias("cal"))


@query(_PRED + """, a AS (SELECT symbol, count(*) AS n, avg(CAST((p >= 0.5) = (y > 0) AS DOUBLE)) * 100 AS accuracy, avg(CAST((base >= 0.5) = (y > 0) AS DOUBLE)) * 100 AS base_accuracy, avg(pow(p - y, 2)) AS brier, avg(pow(base - y, 2)) AS base_brier, count_if(round(abs(p - base), 9) >= 0.04 AND abs(med) >= 0.5) AS actionable FROM pr GROUP BY 1)
SELECT symbol, n, actionable, round(accuracy, 6) AS accuracy, round(base_accuracy, 6) AS base_accuracy, round(brier, 6) AS brier, round(base_brier, 6) AS base_brier, round((1 - brier / base_brier) * 100, 6) AS skill,
 CASE WHEN n < 5 THEN 'unavailable' WHEN n < 12 THEN 'limited' WHEN brier < 0.95 * base_brier AND accuracy > base_accuracy THEN 'positive' WHEN brier <= 1.05 * base_brier THEN 'mixed' ELSE 'weak' END AS grade FROM a""")
def a47_audit_metrics(spark, sf_dir):
    return S.audit_metrics(predictions(spark, sf_dir)).select("symbol", "n", "actionable", *rounded("accuracy", "base_accuracy", "brier", "base_brier", "skill"), "grade")


@query(_PRED + """SELECT CASE WHEN round(p - base, 9) >= 0.04 THEN 'bullish edge' WHEN round(p - base, 9) <= -0.04 THEN 'bearish edge' ELSE 'no edge' END AS stratum, count(*) AS n, round(avg(p) * 100, 6) AS predicted, round(avg(y) * 100, 6) AS realized, round(avg(actual), 6) AS mean_return FROM pr GROUP BY 1""")
def a48_a49_audit_strata(spark, sf_dir):
    edge = F.round(F.col("p") - F.col("base"), 9)
    label = F.when(edge >= 0.04, "bullish edge").when(edge <= -0.04, "bearish edge").otherwise("no edge")
    return predictions(spark, sf_dir).groupBy(label.alias("stratum")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("p") * 100, 6).alias("predicted"), F.round(F.avg("y") * 100, 6).alias("realized"), F.round(F.avg("actual"), 6).alias("mean_return"))


@query(_PRED + """, sc AS (SELECT symbol, greatest(lo - actual, actual - hi, 0) AS s, row_number() OVER (PARTITION BY symbol ORDER BY greatest(lo - actual, actual - hi, 0)) AS k, count(*) OVER (PARTITION BY symbol) AS n FROM pr WHERE cal),
ad AS (SELECT symbol, ceil(min(s) FILTER (k >= least(n, ceil((n + 1) * 0.8))) * 100) / 100 AS adjustment FROM sc WHERE n >= 5 GROUP BY 1)
SELECT symbol, round(adjustment, 6) AS adjustment, round(avg(CAST(actual BETWEEN lo AND hi AS DOUBLE)) * 100, 6) AS raw_coverage, round(avg(CAST(actual BETWEEN lo - adjustment AND hi + adjustment AS DOUBLE)) * 100, 6) AS adjusted_coverage FROM pr JOIN ad USING (symbol) WHERE NOT cal GROUP BY symbol, adjustment""")
def a50_split_conformal(spark, sf_dir):
    return S.conformal(predictions(spark, sf_dir)).select("symbol", *rounded("adjustment", "raw_coverage", "adjusted_coverage"))


@query(C.with_(C.BARS, C.LEDGER, C.GRADED) + """SELECT symbol, CASE min((brier_r, ord))[2] WHEN 0 THEN 'balanced' WHEN 1 THEN 'price_structure' WHEN 2 THEN 'regime' ELSE 'flow' END AS profile FROM (
 SELECT symbol, id % 4 AS ord, round(avg(pow(probability_up / 100 - CAST(realized_return > 0 AS DOUBLE), 2)), 9) AS brier_r FROM graded WHERE status = 'graded' GROUP BY 1, 2) GROUP BY 1""")
def a51_profile_selection(spark, sf_dir):
    from hindcast.plans.records import graded

    rows = graded(spark, sf_dir).where("status = 'graded'").withColumn("ord", (F.col("id") % 4).cast("int"))
    brier = rows.groupBy("symbol", "ord").agg(F.round(F.avg(F.pow(F.col("probability_up") / 100 - (F.col("realized_return") > 0).cast("double"), 2)), 9).alias("brier"))
    return S.best_profile(brier, list(M.PROFILES))


@query()
def w20_w21_long_or_cash(spark, sf_dir):
    """Greedy non-overlapping bullish checkpoints and the equity they make against holding."""
    return S.long_or_cash(predictions(spark, sf_dir).withColumn("bullish", (F.col("p") - F.col("base") >= 0.04) & (F.col("med") >= 0.5)), A.bars(spark, sf_dir), 21).select("symbol", "trades", *rounded("strategy_total", "hold_total", "exposure", "strategy_drawdown"))


_ANALYSIS = C.with_(C.BARS, C.LEDGER) + """, an AS (SELECT symbol, as_of_date, probability_up, baseline_up_rate AS baseline, probability_up - baseline_up_rate AS edge, (id % 21 - 8) / 2 AS typical, (id % 21 - 8) / 2 - (id % 13) / 2 AS low, (id % 21 - 8) / 2 + (id % 17) / 2 AS high, CAST(id % 101 AS DOUBLE) AS evidence, CAST(id % 97 AS DOUBLE) AS agreement,
 CASE id % 4 WHEN 0 THEN 'positive' WHEN 1 THEN 'mixed' WHEN 2 THEN 'limited' ELSE 'weak' END AS grade, (id % 60 - 20) / 2 AS skill, CAST(id % 23 AS DOUBLE) AS price, id % 8 <> 0 AS audited, id % 6 = 0 AS conflict FROM ledger)"""


def analyses(spark, sf_dir):
    i, typical = F.col("id"), (F.col("id") % 21 - 8) / 2
    rows = A.ledger(A.bars(spark, sf_dir))
    return rows.select(
        "symbol", "as_of_date", "probability_up", F.col("baseline_up_rate").alias("baseline"), (F.col("probability_up") - F.col("baseline_up_rate")).alias("edge"), typical.alias("typical"), (typical - (i % 13) / 2).alias("low"), (typical + (i % 17) / 2).alias("high"),
        (i % 101).cast("double").alias("evidence"), (i % 97).cast("double").alias("agreement"), F.when(i % 4 == 0, "positive").when(i % 4 == 1, "mixed").when(i % 4 == 2, "limited").otherwise("weak").alias("grade"),
        ((i % 60 - 20) / 2).alias("skill"), (i % 23).cast("double").alias("price"), (i % 8 != 0).alias("audited"), (i % 6 == 0).alias("conflict"),
    )


@query(_ANALYSIS + """, s AS (SELECT *, CASE WHEN edge >= 0 THEN 'long' ELSE 'short' END AS side, high - low AS width, CASE WHEN edge >= 0 THEN typical ELSE -typical END AS mv, CASE WHEN edge >= 0 THEN greatest(0, -low) ELSE greatest(0, high) END AS adverse FROM an),
r AS (SELECT *, mv / greatest(adverse, greatest(0.5, 0.25 * width)) AS rr, greatest(0, least(100, greatest(0, least(30, mv / 12 * 30)) + least(22, abs(edge) / 15 * 22) + least(16, evidence / 100 * 16) + least(10, agreement / 100 * 10)
 + CASE grade WHEN 'positive' THEN 14 WHEN 'mixed' THEN 9 WHEN 'limited' THEN 5 ELSE 2 END + least(8, greatest(0, skill) / 25 * 8) - least(14, adverse / 15 * 14) - least(6, width / 45 * 6) - CASE WHEN conflict THEN 8 ELSE 0 END)) AS score FROM s),
b AS (SELECT *, CAST(NOT audited AS INT) + CAST(mv < 1.5 AS INT) + CAST(price > 0 AND price < 5 AS INT) + CAST(round(score, 9) < 18 AS INT) AS blockers FROM r)
SELECT symbol, as_of_date, side, round(score, 6) AS score, round(rr, 6) AS reward_risk, blockers, blockers = 0 AS eligible, CASE WHEN blockers = 0 AND NOT conflict AND grade = 'positive' AND abs(edge) >= 6 AND evidence >= 55 AND agreement >= 55 AND round(score, 9) >= 62 AND round(rr, 9) >= 1 THEN 'strong'
 WHEN blockers = 0 AND grade IN ('positive', 'mixed') AND abs(edge) >= 4 AND round(score, 9) >= 40 AND round(rr, 9) >= 1 THEN 'moderate' ELSE 'speculative' END AS tier FROM b""")
def f2_f3_f4_p11_board_score(spark, sf_dir):
    return S.board_score(analyses(spark, sf_dir)).select("symbol", "as_of_date", "side", *rounded("score", "reward_risk"), F.size("blockers").alias("blockers"), "eligible", "tier")


@query(_ANALYSIS + """SELECT symbol, as_of_date, round(least(99, greatest(1, 100 / (1 + exp(-(ln(b / (1 - b)) + 0.132 * (ln(r / (1 - r)) - ln(b / (1 - b)))))))), 6) AS calibrated, round((pp + z2 / (2 * n)) / (1 + z2 / n), 6) AS wilson_mid,
 round(1.96 * sqrt(pp * (1 - pp) / n + z2 / (4 * n * n)) / (1 + z2 / n), 6) AS wilson_half FROM (SELECT *, least(0.99, greatest(0.01, probability_up / 100)) AS r, least(0.99, greatest(0.01, baseline / 100)) AS b, probability_up / 100 AS pp, evidence + 1 AS n, 3.8416 AS z2 FROM an)""")
def f1_f10_calibrated_probability_and_wilson(spark, sf_dir):
    rows = analyses(spark, sf_dir)
    mid, half = S.wilson(F.col("probability_up") / 100, F.col("evidence") + 1)
    return rows.select("symbol", "as_of_date", *rounded(("calibrated", S.calibrated(F.col("probability_up"), F.col("baseline"))), ("wilson_mid", mid), ("wilson_half", half)))


@query(_ANALYSIS + """SELECT symbol, as_of_date, CASE WHEN edge >= 4 AND typical > 0.5 THEN 'bullish' WHEN edge <= -4 AND typical < -0.5 THEN 'bearish' ELSE 'neutral' END AS direction,
 round(greatest(10, least(95, round(least(1, evidence / 18) * 35 + least(1, abs(edge) / 12) * 35 + least(1, agreement / 8) * 15 + CASE grade WHEN 'positive' THEN 1 WHEN 'mixed' THEN 0.75 WHEN 'limited' THEN 0.55 ELSE 0.4 END * 15))), 6) AS evidence_score,
 as_of_date + 21 AS horizon_date, round(1000 / nullif(price, 0), 6) AS units, round(1000 * low / 100, 6) AS loss, round(1000 * high / 100, 6) AS gain FROM an""")
def f16_f18_f26_f31_direction_evidence_sizing(spark, sf_dir):
    rows = analyses(spark, sf_dir)
    return rows.select("symbol", "as_of_date", S.direction(F.col("edge"), F.col("typical")).alias("direction"), *rounded(("evidence_score", S.evidence_score(F.col("evidence"), F.col("edge"), F.col("agreement"), F.col("grade")))), F.date_add("as_of_date", 21).alias("horizon_date"),
                       *rounded(("units", F.try_divide(F.lit(1000.0), F.nullif("price", F.lit(0.0)))), ("loss", 1000 * F.col("low") / 100), ("gain", 1000 * F.col("high") / 100)))


@query(C.with_(C.BARS) + """, f AS (SELECT symbol, pos, round((close / lag(close, 21) OVER w - 1) * 100, 9) AS r, round((close / max(close) OVER (PARTITION BY symbol ORDER BY pos ROWS 251 PRECEDING) - 1) * 100, 9) AS dd FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY pos))
SELECT symbol, pos, CASE WHEN r >= 3 THEN 'up' WHEN r <= -3 THEN 'down' WHEN r IS NULL THEN NULL ELSE 'flat' END AS momentum, CASE WHEN dd <= -10 THEN 'deep' WHEN dd <= -3 THEN 'pullback' ELSE 'near high' END AS drawdown FROM f""")
def f5_f6_regime_bands(spark, sf_dir):
    w = Window.partitionBy("symbol").orderBy("pos")
    rows = A.bars(spark, sf_dir).withColumns({"r": F.round((F.col("close") / F.lag("close", 21).over(w) - 1) * 100, 9), "dd": F.round((F.col("close") / F.max("close").over(w.rowsBetween(-251, 0)) - 1) * 100, 9)})
    return rows.select("symbol", F.col("pos").cast("long").alias("pos"), S.banded(F.col("r"), [(3, "up")], [(-3, "down")], "flat").alias("momentum"), F.when(F.col("dd") <= -10, "deep").when(F.col("dd") <= -3, "pullback").otherwise("near high").alias("drawdown"))
