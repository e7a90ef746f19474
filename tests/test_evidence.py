"""Plans, bands, votes and the audit's split against loops."""

from __future__ import annotations

import math
import random

from pyspark.sql import functions as F

from hindcast.operators import analysis as Y
from hindcast.operators import evidence as E
from hindcast.operators import panels as N


def quantile(pairs, q):
    """The first value, in order, at which the weights so far reach q of all."""
    pairs, total, so_far = sorted(pairs), sum(w for _, w in pairs), 0.0
    for v, w in pairs:
        so_far += w
        if so_far >= q * total:
            return v
    return pairs[-1][0]


def made(spark, n=4, h=6):
    """Random episodes of four symbols; those of later symbols rise less."""
    draw, rows = random.Random(5), []
    for s in range(n):
        for pos in range(12):
            close = [0.0] + [draw.gauss(1.5 - s, 2.0) for _ in range(h)]
            low, high = [x - draw.random() * 2 for x in close[1:]], [x + draw.random() * 2 for x in close[1:]]
            rows.append((f"s{s}", 100, pos, 1 / 12, close, low, high, max(high), min(low)))
    names = "symbol string, anchor int, pos int, weight double, path array<double>, low_path array<double>, high_path array<double>, max_upside double, max_drawdown double"
    return rows, spark.createDataFrame(rows, names)


def test_trade_plans_match_a_loop(spark):
    rows, df = made(spark)
    told = [(f"s{i}", 100, 50.0, d) for i, d in enumerate(("bullish", "bullish", "bearish", "neutral"))] + [("alone", 100, 50.0, "bullish")]
    forecasts = spark.createDataFrame(told, "symbol string, anchor int, price double, direction string")
    got = {r.symbol: r for r in E.trade_plan(df, forecasts).collect()}
    seen = set()
    for symbol, _, price, direction in told:
        own = [r for r in rows if r[0] == symbol]
        want = {"bearish": "avoid_or_exit"}.get(direction, "wait")
        if own and direction == "bullish":
            stop, target = quantile([(r[8], r[3]) for r in own], 0.25), quantile([(r[7], r[3]) for r in own], 0.60)
            hit = expect = 0.0
            for r in own:
                end = r[4][-1]
                for low, high in zip(r[5], r[6]):
                    if low <= stop or high >= target:
                        end = stop if low <= stop else target
                        hit += r[3] * (low > stop)
                        break
                expect += r[3] * end
            if stop < -0.25 and target > 0.25 and target / -stop >= 1.1 and expect > 0:
                want = "consider_buying"
                assert math.isclose(got[symbol].hit_rate, hit, abs_tol=1e-9) and math.isclose(got[symbol].expectancy, expect, abs_tol=1e-9)
                assert math.isclose(got[symbol].stop, price * (1 + stop / 100)) and math.isclose(got[symbol].target, price * (1 + target / 100))
        assert got[symbol].action == want
        assert want == "consider_buying" or got[symbol].stop is None
        seen.add(want)
    assert seen == {"consider_buying", "avoid_or_exit", "wait"}


def test_bands_match_a_loop_and_widen(spark):
    rows, df = made(spark)
    wide = spark.createDataFrame([("s0", 2.0)], "symbol string, adjustment double")
    got = {(r.symbol, r.day): r for r in E.projection(df, wide, horizon=6).collect()}
    assert len(got) == 4 * 7
    for (symbol, day), r in got.items():
        pairs = [(x[4][day], x[3]) for x in rows if x[0] == symbol]
        more = 2.0 * math.sqrt(day / 6) if symbol == "s0" else 0.0
        for name, q, by in (("low", 0.2, -more), ("median", 0.5, 0.0), ("high", 0.8, more)):
            assert math.isclose(r[name], quantile(pairs, q) + by, abs_tol=1e-9)


def test_agreement_worked_examples(spark):
    cases = [(60.0, 1.0, 0.3, 2, "bullish"), (60.0, -1.0, 0.3, 0, "bullish"), (50.0, 0.0, -0.3, 4, "neutral"), (40.0, 0.6, 0.0, 1, "neutral")]
    df = spark.createDataFrame(cases, "raw double, typical double, news double, n int, lean string")
    score, label, reference = E.agreement(*[F.col(c) for c in df.columns])
    got = [tuple(r) for r in df.select(score.alias("s"), label.alias("l"), reference.alias("r")).collect()]
    assert got[0] == (100.0, "Broad agreement", "bullish")
    assert got[1] == (57.0, "Partial agreement", "bullish")
    assert got[2] == (56.0, "Partial agreement", "bearish")
    assert got[3] == (12.0, "Conflicting evidence", "neutral")


def test_waterfall_leaves_out_what_is_missing(spark):
    df = spark.createDataFrame([(1, 50.0, 60.0, None), (2, 40.0, None, 45.0)], "id int, a double, b double, c double")
    got = sorted(tuple(r) for r in E.waterfall(df, {"A": "a", "B": "b", "C": "c"}).collect())
    assert got == [(1, 0, "A", 50.0, 0.0), (1, 1, "B", 60.0, 10.0), (2, 0, "A", 40.0, 0.0), (2, 1, "C", 45.0, 5.0)]


def test_tuning_split(spark):
    grid = [("a", "tuning", i) for i in range(21)] + [("a", "evaluation", 50)] + [("b", "tuning", i) for i in range(9)]
    got = E.tuning_split(spark.createDataFrame(grid, "symbol string, kind string, anchor int")).collect()
    kinds = {(r.symbol, r.anchor): r.kind for r in got}
    assert [kinds["a", i] for i in range(21)] == ["tuning"] * 14 + ["calibration"] * 7 and kinds["a", 50] == "evaluation"
    assert {kinds["b", i] for i in range(9)} == {"calibration"}


def test_cards_and_sentences(spark):
    names = ("r21", "trend_short", "trend_long", "vol21", "vol_ratio", "drawdown", "rsi", "volume_ratio", "market_trend")
    rows = [(9.0, 2.0, 1.0, 20.0, 30.0, -25.0, 71.0, 41.0, 3.5), (-2.5, -2.0, -1.0, 10.0, -20.0, -8.0, 45.0, -12.5, -3.0), (0.0, None, None, None, None, 0.0, 50.0, None, None)]
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names)).coalesce(1)
    regime = Y.regime(*[F.col(c) for c in ("trend_short", "trend_long", "vol_ratio", "drawdown")])
    got = df.select(E.cards({n: F.col(n) for n in names}, regime, F.lit(15.0)).alias("cards"), E.setup(regime, F.col("r21"), F.col("drawdown")).alias("setup"), regime[3].alias("label")).collect()
    first = {c.label: (c.value, c.detail) for c in got[0].cards}
    assert first["Price path"] == ("Strong advance", "+9.0% over 21 trading days") and first["Volatility"] == ("Expanding", "20.0% annualized vs 15.0% typical")
    assert first["RSI pressure"] == ("Overbought", "RSI 71") and first["Broad market"][0] == "Market tailwind" and first["Participation"][0] == "Heavy volume"
    second = {c.label: (c.value, c.detail) for c in got[1].cards}
    assert second["RSI pressure"][0] == "Sellers in control" and second["Participation"] == ("Normal volume", "-12% vs 20-day volume") and second["Drawdown"][0] == "Below highs"
    assert [c.label for c in got[2].cards] == ["Price path", "Drawdown", "RSI pressure"] and got[2].cards[2].value == "Balanced"
    assert got[0].label == "Uptrend · Expanding volatility · Deep drawdown" and got[2].label == "Transition · Normal volatility · Near highs"
    assert got[1].setup == "Today is a downtrend with calm volatility, -2.5% one-month momentum, and price 8.0% below its one-year high."


def test_explanations(spark):
    rows = [("bullish", "bullish", 8.25, 1.5, 40.0), ("bearish", "bearish", -6.0, -2.0, 55.0), ("neutral", "bullish", 8.0, 1.0, 50.0), ("neutral", "neutral", 1.0, 0.0, 48.5)]
    df = spark.createDataFrame(rows, "direction string, lean string, edge double, typical double, baseline double").coalesce(1)
    got = [r[0] for r in df.select(E.explanation(*[F.col(c) for c in df.columns])).collect()]
    assert got[0].startswith("The analogs show a +8.3-point edge over") and got[0].endswith("was +1.5%.") and "-6.0-point edge versus" in got[1]
    assert "waiting is the honest call" in got[2] and "normal 48% up-rate" in got[3]


def test_a_factor_must_replicate(spark):
    draw, rows = random.Random(2), []
    for feature, first, second in (("steady", 0.1, 0.1), ("turned", 0.1, -0.1), ("noise", 0.0, 0.0), ("short", 0.1, 0.1)):
        for d in range(60 if feature != "short" else 15):
            rows.append((feature, d, (first if d < 30 else second) + draw.gauss(0, 0.05)))
    ic = spark.createDataFrame(rows, "feature string, session_date int, ic double")
    got = {r.feature: r for r in N.replicated(ic, ic, F.lit(30), 20).collect()}
    assert set(got) == {"steady", "turned", "noise"} and [got[f].survives for f in ("steady", "turned", "noise")] == [True, False, False]
    assert math.isclose(got["noise"].noise, math.sqrt(2 * math.log(3)))
