"""Queries over what a forecast is read with."""

from __future__ import annotations

from pyspark.sql import functions as F

from hindcast.functions import scalars as S
from hindcast.operators import evidence as E
from hindcast.operators import features as X
from hindcast.operators import matching as M
from hindcast.plans.forecasts import _ANALYSIS, _PRED, analyses, anchors_of, predictions, prepared
from hindcast.plans.registry import ORACLES, query, rounded
from hindcast.sources import adapters as A
from hindcast.streaming.jobs import scratch


def _kept(spark):
    """A writer of small tables into the shared folder."""

    def keep(df, label):
        path = scratch(spark, label)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return keep


def _episodes(spark, sf_dir):
    """Three anchors a symbol with their episodes' paths, and the forecasts made of them."""
    feats, _, bars = prepared(spark, sf_dir)
    outs, anchors = X.outcomes(bars, paths=True), anchors_of(bars)
    chosen = _kept(spark)(M.matches(feats, anchors), "matches")
    told = M.direct(M.summarize(chosen, outs, M.base_rates(outs, anchors, 21)))
    price = bars.select("symbol", F.col("pos").alias("anchor"), F.col("close").alias("price"))
    return E.episodes(chosen, outs), told.join(price, E.BY)


@query(f"SELECT symbol, anchor, kind FROM (SELECT g.*, n, row_number() OVER (PARTITION BY symbol, kind0 ORDER BY anchor DESC) AS k, CASE WHEN kind0 = 'evaluation' THEN 'evaluation' WHEN n < 10 OR k <= greatest(5, n // 3) THEN 'calibration' ELSE 'tuning' END AS kind FROM (SELECT symbol, kind AS kind0, anchor FROM ({ORACLES['w18_audit_anchors']})) g JOIN (SELECT symbol, count(*) AS n FROM ({ORACLES['w18_audit_anchors']}) WHERE kind = 'tuning' GROUP BY 1) USING (symbol))")
def c2_audit_split(spark, sf_dir):
    """The part of the audited forecast that sets its anchors: for profiles, for the interval, for evaluation."""
    n = A.bars(spark, sf_dir).groupBy("symbol").agg((F.max("pos") + 1).alias("n"))
    return E.tuning_split(S.audit_anchors(n)).select("symbol", F.col("anchor").cast("long").alias("anchor"), "kind")


@query()
def f23_trade_plan(spark, sf_dir):
    rows, told = _episodes(spark, sf_dir)
    return E.trade_plan(rows, told).select("symbol", "anchor", "action", *rounded("entry", "stop", "target", "stop_pct", "target_pct", "risk_reward", "hit_rate", "expectancy"))


@query()
def w23_projection_bands(spark, sf_dir):
    rows, _ = _episodes(spark, sf_dir)
    return E.projection(rows, S.conformal(predictions(spark, sf_dir))).select("symbol", "anchor", "day", *rounded("low", "median", "high"))


@query()
def t9_nearest_traces(spark, sf_dir):
    """Paths of the nearest episodes of each forecast; their number is the feature."""
    rows, _ = _episodes(spark, sf_dir)
    near = rows.where(F.col("rank") < E.TRACES)
    return near.select("symbol", "anchor", "rank", "pos", "quality", F.transform("path", lambda x: F.round(x, 3)).alias("offsets"))


@query(_PRED + """, b AS (SELECT *, CASE WHEN p < 0.4 THEN 'Under 40%' WHEN p < 0.5 THEN '40-50%' WHEN p < 0.6 THEN '50-60%' ELSE '60%+' END AS bucket FROM pr)
SELECT symbol, bucket, count(*) AS n, round(avg(p) * 100, 6) AS predicted, round(avg(y) * 100, 6) AS observed, round((avg(p) - avg(y)) * 100, 6) AS gap FROM b GROUP BY 1, 2""")
def a48_audit_buckets(spark, sf_dir):
    bucket = F.when(F.col("p") < 0.4, "Under 40%").when(F.col("p") < 0.5, "40-50%").when(F.col("p") < 0.6, "50-60%").otherwise("60%+")
    p, y = F.avg("p"), F.avg("y")
    rows = predictions(spark, sf_dir).groupBy("symbol", bucket.alias("bucket"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.round(p * 100, 6).alias("predicted"), F.round(y * 100, 6).alias("observed"), F.round((p - y) * 100, 6).alias("gap"))


_READ = _ANALYSIS + """, rd AS (SELECT *, (agreement - 48) / 100 AS news, CAST(evidence AS BIGINT) % 7 AS articles, CASE WHEN edge >= 4 AND typical > 0.5 THEN 'bullish' WHEN edge <= -4 AND typical < -0.5 THEN 'bearish' ELSE 'neutral' END AS lean FROM an)"""


def _read(spark, sf_dir):
    return analyses(spark, sf_dir).withColumns({"news": (F.col("agreement") - 48) / 100, "articles": F.col("evidence").cast("long") % 7, "lean": S.direction(F.col("edge"), F.col("typical"))})


@query(_READ + """, v AS (SELECT *, CASE WHEN probability_up >= 54 THEN 1 WHEN probability_up <= 46 THEN -1 ELSE 0 END AS a, CASE WHEN typical >= 0.5 THEN 1 WHEN typical <= -0.5 THEN -1 ELSE 0 END AS b, CASE WHEN articles = 0 THEN NULL WHEN news >= 0.15 THEN 1 WHEN news <= -0.15 THEN -1 ELSE 0 END AS c FROM rd),
r AS (SELECT *, CASE lean WHEN 'bullish' THEN 1 WHEN 'bearish' THEN -1 ELSE sign(a + b + coalesce(c, 0)) END AS r FROM v),
s AS (SELECT *, round_even((2 * CASE WHEN a = r THEN 1 WHEN a = 0 THEN 0.5 ELSE 0 END + 1.5 * CASE WHEN b = r THEN 1 WHEN b = 0 THEN 0.5 ELSE 0 END + CASE WHEN c IS NULL THEN 0 WHEN c = r THEN 0.5 WHEN c = 0 THEN 0.25 ELSE 0 END)::DOUBLE / CASE WHEN c IS NULL THEN 3.5 ELSE 4 END * 100, 0) AS score FROM r)
SELECT symbol, as_of_date, score, CASE WHEN score >= 75 THEN 'Broad agreement' WHEN score >= 50 THEN 'Partial agreement' ELSE 'Conflicting evidence' END AS label, CASE WHEN r > 0 THEN 'bullish' WHEN r < 0 THEN 'bearish' ELSE 'neutral' END AS reference FROM s""")
def f20_agreement(spark, sf_dir):
    score, label, reference = E.agreement(F.col("probability_up"), F.col("typical"), F.col("news"), F.col("articles"), F.col("lean"))
    return _read(spark, sf_dir).select("symbol", "as_of_date", score.alias("score"), label.alias("label"), reference.alias("reference"))


STEPS = {"Asset base rate": "baseline", "Raw matched paths": "probability_up", "Base-rate shrinkage": "shrunk", "Current news": "combined", "Measured calibration": "calibrated"}


@query(_READ + """, st AS (SELECT *, (probability_up * evidence + baseline * 6) / (evidence + 6) AS shrunk FROM rd), co AS (SELECT *, shrunk + news * 5 AS combined FROM st),
w AS (SELECT symbol, as_of_date, unnest([0, 1, 2, 3, 4]) AS step, unnest(['Asset base rate', 'Raw matched paths', 'Base-rate shrinkage', 'Current news', 'Measured calibration']) AS label, unnest([baseline, probability_up, shrunk, combined, CASE WHEN audited THEN combined * 0.9 + 5 END]) AS value FROM co)
SELECT symbol, as_of_date, step, label, round(value, 6) AS value, round(coalesce(value - lag(value) OVER (PARTITION BY symbol, as_of_date ORDER BY step), 0), 6) AS delta FROM w WHERE value IS NOT NULL""")
def f21_probability_waterfall(spark, sf_dir):
    shrunk = (F.col("probability_up") * F.col("evidence") + F.col("baseline") * 6) / (F.col("evidence") + 6)
    rows = _read(spark, sf_dir).withColumn("shrunk", shrunk).withColumn("combined", F.col("shrunk") + F.col("news") * 5)
    rows = rows.withColumn("calibrated", F.when(F.col("audited"), F.col("combined") * 0.9 + 5)).select("symbol", "as_of_date", *STEPS.values())
    return E.waterfall(rows, STEPS).select("symbol", "as_of_date", "step", "label", *rounded("value", "delta"))


@query(_READ + """SELECT symbol, as_of_date, CASE WHEN conflict AND lean <> 'neutral' THEN 'History leans, but today adds doubt' WHEN lean = 'bullish' THEN 'The closest setups lean UP' WHEN lean = 'bearish' THEN 'The closest setups lean DOWN' ELSE 'No meaningful analog edge right now' END AS headline FROM rd""")
def f22_verdict_headline(spark, sf_dir):
    """Where headlines conflict with the lean, the direction is neutral."""
    direction = F.when(F.col("conflict"), "neutral").otherwise(F.col("lean"))
    return _read(spark, sf_dir).select("symbol", "as_of_date", E.headline(direction, F.col("lean")).alias("headline"))
