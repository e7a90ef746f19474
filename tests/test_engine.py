"""The engine's operators against independent loops and hand-worked values."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hindcast.functions import numeric, scalars, text
from hindcast.operators import bars as B
from hindcast.operators import features as X
from hindcast.operators import matching as M
from hindcast.operators import panels as N
from hindcast.operators import records as R
from hindcast.sources.html import html_items
from hindcast.streaming import jobs as J

DAY0 = dt.date(2020, 1, 6)


def make_bars(spark, n=400, symbols=("A", "B"), seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for s in symbols:
        close = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, n)))
        for i, c in enumerate(close):
            rows.append((s, DAY0 + dt.timedelta(days=i), float(c * 0.999), float(c * 1.01), float(c * 0.99), float(c), float(rng.integers(1, 90)), i))
    return spark.createDataFrame(rows, "symbol string, session_date date, open double, high double, low double, close double, volume double, pos int")


@pytest.fixture(scope="module")
def bars(spark):
    return make_bars(spark).cache()


def test_rsi_matches_the_recurrence(spark, bars):
    got = X.wilder_rsi(bars, block=64).orderBy("symbol", "pos").toPandas()
    for _, g in got.groupby("symbol"):
        gain = loss = None
        for p, (c, r) in enumerate(zip(g["close"], g["rsi"])):
            if p:
                d = c - last
                up, down = max(d, 0), max(-d, 0)
                gain = up if gain is None else gain * 13 / 14 + up / 14
                loss = down if loss is None else loss * 13 / 14 + down / 14
            last = c
            assert (math.isnan(r) if p < 14 else abs(r - (100 - 100 / (1 + gain / loss))) < 1e-9)


def test_features_follow_the_full_window_rule_and_ignore_the_future(spark, bars):
    whole = X.price_features(bars).orderBy("symbol", "pos").toPandas()
    part = X.price_features(bars.where("pos < 300")).orderBy("symbol", "pos").toPandas()
    both = whole[whole.pos < 300].reset_index(drop=True)
    for c in ("r21", "rsi", "trend_long", "vol_ratio", "drawdown", "atr", "volume_ratio"):
        assert np.allclose(both[c], part[c], equal_nan=True)
    a = whole[whole.symbol == "A"].set_index("pos")
    assert a.trend_long.first_valid_index() == 199 and a.vol21.first_valid_index() == 21 and a.drawdown.first_valid_index() == 62
    ref = a["close"].rolling(20).mean()
    assert np.allclose((a["close"] / ref - 1) * 100, a["trend_short"], equal_nan=True)


def test_shapes_match_a_loop(spark, bars):
    got = {(r.symbol, r.pos): r.shape for r in X.shapes(bars, 21).collect()}
    close = bars.where("symbol = 'A'").orderBy("pos").toPandas()["close"].to_numpy()
    for p in (21, 100, 399):
        path = np.log(close[p - 21 : p + 1] / close[p - 21])
        assert np.allclose(got["A", p], (path - path.mean()) / path.std())
    assert ("A", 20) not in got
    flat = bars.withColumn("close", F.lit(5.0))
    assert set(X.shapes(flat, 5).first()["shape"]) == {0.0}


def test_context_is_one_session_late(spark, bars):
    ctx = bars.where("symbol = 'A'").select("session_date", F.col("pos").cast("double").alias("market"), F.lit(1.0).alias("vix"))
    got = {r.pos: r.market for r in X.align_context(bars, ctx).where("symbol = 'B'").collect()}
    assert got[0] is None and got[5] == 4.0


def test_outcomes_enter_at_the_next_open(spark):
    rows = [("A", DAY0 + dt.timedelta(days=i), o, h, l, c, 1.0, i) for i, (o, h, l, c) in enumerate([(10.0, 11.0, 9.0, 10.0), (None, 13.0, 10.0, 12.0), (11.0, 12.0, 8.0, 9.0), (9.0, 10.0, 9.0, 9.5)])]
    b = spark.createDataFrame(rows, "symbol string, session_date date, open double, high double, low double, close double, volume double, pos int")
    r = {x.pos: x for x in X.outcomes(b, (1, 2), paths=True).collect()}
    assert r[0].fwd_1 == pytest.approx(0.0) and r[0].fwd_2 == pytest.approx(-25.0)  # the missing open falls back to the close
    assert r[1].fwd_2 == pytest.approx((9.5 / 11 - 1) * 100) and r[0].max_drawdown == pytest.approx((8 / 12 - 1) * 100)
    assert r[3].fwd_1 is None and r[0].path[0] == 0.0 and len(r[0].path) == 3


def test_greedy_folds(spark):
    rng = np.random.default_rng(0)
    d = rng.random(300)
    ranked = sorted((float(x), i) for i, x in enumerate(d))
    want: list[int] = []
    for _, p in ranked:
        if len(want) < 30 and all(abs(p - q) >= 7 for q in want):
            want.append(p)
    df = spark.createDataFrame([(ranked, sorted(range(0, 300, 4)))], "r array<struct<distance:double,pos:int>>, p array<int>")
    row = df.select(M.spaced(F.col("r"), 7).alias("m"), M.non_overlapping(F.col("p"), 10).alias("n")).first()
    assert [x.pos for x in row.m] == want
    assert row.n == list(range(0, 300, 12))


def test_kernel_weights_reach_the_effective_size(spark):
    d = np.sort(np.random.default_rng(2).random(25))
    cases = [d.tolist(), [0.5], [1.0, 2.0], [0.1, 0.2, 4.0], [0.3] * 6, [0.0] * 9 + [5.0], [0.2, 0.21, 0.5, 0.9], []]
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, d array<double>").select("i", M.kernel_weights(F.col("d")).alias("w")).collect()
    got = {r.i: np.array(r.w) for r in rows}
    for i, c in enumerate(cases):
        w, n = got[i], len(c)
        assert len(w) == n and (not n or abs(w.sum() - 1) < 1e-9) and (np.diff(w) <= 1e-15).all()
        if n > 3 and len(set(c)) > 2:
            assert abs(1 / (w**2).sum() - max(3.0, 0.72 * n)) < 1e-6
    assert np.allclose(got[2], np.exp([0, -0.1]) / np.exp([0, -0.1]).sum()) and np.allclose(got[4], 1 / 6)


def test_beta_quantiles():
    a, b = np.array([2.0, 5.0, 0.7, 30.0]), np.array([3.0, 1.5, 0.9, 12.0])
    q = numeric.beta_quantile(0.1, a, b)
    assert np.allclose(numeric.beta_cdf(q, a, b), 0.1)
    assert np.allclose(numeric.beta_cdf(np.array([0.3]), np.array([1.0]), np.array([1.0])), 0.3)
    x = np.linspace(0, 1, 200_001)
    density = x**1 * (1 - x) ** 2 * 12
    assert abs(np.trapezoid(density[:60_001], x[:60_001]) - numeric.beta_cdf(np.array([0.3]), np.array([2.0]), np.array([3.0]))[0]) < 1e-6


def test_writing_one_symbol_keeps_the_others(spark, tmp_path):
    from hindcast.sources import files

    path = str(tmp_path / "bars")
    bars = spark.range(300).select(F.concat(F.lit("s"), "id").alias("symbol"), F.lit("2024-01-02").cast("date").alias("session_date"), F.lit(1.0).alias("close"))
    files.write_bars(bars, path, 4)
    files.write_bars(bars.where("symbol in ('s7', 's8')").withColumn("close", F.lit(2.0)), path, 4)
    got = files.read_bars(spark, path).groupBy("close").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("symbol").alias("s")).collect()
    assert {(r.close, r.n, r.s) for r in got} == {(1.0, 298, 298), (2.0, 2, 2)}
    assert files.read_bars(spark, path, "s7", 4).first().close == 2.0


def test_matches_in_a_batch_are_those_of_one_anchor(spark):
    b = make_bars(spark, 700)
    feats = X.context_features(X.align_context(X.price_features(b), b.groupBy("session_date").agg(F.avg("close").alias("market"), F.avg("high").alias("vix"))))
    feats = feats.join(X.shapes(b), ["symbol", "pos"], "left").persist()
    two = spark.createDataFrame([("A", 650), ("A", 699)], "symbol string, anchor int")
    batch = M.matches(feats, two).where("anchor = 650").orderBy("rank").toPandas()
    alone = M.matches(feats.where("pos <= 650"), two.where("anchor = 650")).orderBy("rank").toPandas()
    assert len(batch) >= 5 and list(batch.pos) == list(alone.pos) and np.allclose(batch.distance, alone.distance)
    assert (batch.pos <= 650 - 42).all() and (np.abs(np.subtract.outer(batch.pos.to_numpy(), batch.pos.to_numpy()))[~np.eye(len(batch), dtype=bool)] >= 42).all()
    assert abs(batch.weight.sum() - 1) < 1e-9


LEDGER = "id long, symbol string, as_of_date date, horizon_days int, side string, tier string, status string, realized_return double, eligible boolean, probability_up double, baseline_up_rate double, calibrated_probability_up double, model_version string, benchmark double"


def test_scorecard_worked_example(spark):
    rows = [(i, "A", DAY0, 21, s, "strong", "graded", r, None, 60.0, 50.0, None, None, b) for i, (s, r, b) in enumerate([("long", 10.0, 8.0), ("short", -5.0, -3.0), ("long", -2.0, 1.0), ("short", 4.0, 2.0)])]
    rows.append((9, "A", DAY0, 21, "long", "strong", "graded", 50.0, False, 60.0, 50.0, None, None, 1.0))  # refused by the board
    out = R.breakdowns(R.scored(spark.createDataFrame(rows, LEDGER)), least=1).where("family = 'all'").first()
    assert out.sample_size == 4 and out.mean_signal_return == pytest.approx(2.25) and out.median_signal_return == pytest.approx(1.5)
    assert out.standard_deviation == pytest.approx(math.sqrt(124.75 / 3))
    signed_bench = (8.0 + 3.0 + 1.0 - 2.0) / 4
    assert out.mean_excess_return == pytest.approx(2.25 - signed_bench) and out.hit_rate == pytest.approx(50.0)
    hidden = R.breakdowns(R.scored(spark.createDataFrame(rows, LEDGER))).where("family = 'all'").first()
    assert hidden.sample_size == 4 and hidden.mean_signal_return is None


def test_marking_states(spark):
    days = [DAY0 + dt.timedelta(days=i) for i in range(6)]
    b = [("A", days[i], o, o, o, c, 1.0, i) for i, (o, c) in enumerate([(10.0, 10.0), (10.0, 11.0), (11.0, 12.0), (12.0, 9.0), (9.0, 60.0), (60.0, 61.0)])]
    bars = spark.createDataFrame(b, "symbol string, session_date date, open double, high double, low double, close double, volume double, pos int")
    led = [(i, s, d, 2, "short", "strong", "pending", None, None, None, None, None, None, None) for i, (s, d) in enumerate([("A", days[0]), ("A", days[2]), ("A", days[3]), ("A", days[5]), ("Z", days[0]), ("A", dt.date(2019, 1, 1))])]
    t = spark.createDataFrame(led, LEDGER).withColumns({c: F.lit(None).cast("date") for c in ("entry_date", "outcome_date")})
    got = {r.id: r for r in R.mark(t, bars, str(days[3])).collect()}
    assert (got[0].state, got[1].state, got[2].state) == ("matured", "open", "awaiting_entry")
    assert got[0].signed_return == pytest.approx(-20.0) and got[1].price_return == pytest.approx(-25.0)
    assert got[4].state == got[5].state == "unpriced"
    late = {r.id: r for r in R.mark(t, bars, str(days[5])).collect()}
    assert late[1].state == "suspect"
    assert late[2].state == "matured" and late[3].state == "awaiting_entry"


def test_ledger_claims(spark):
    schema = "symbol string, as_of_date date, horizon_days int, status string, scan_run_id long, p double"
    old = spark.createDataFrame([("A", DAY0, 5, "pending", None, 1.0), ("B", DAY0, 5, "graded", None, 1.0), ("C", DAY0, 5, "pending", 4, 1.0)], schema)
    new = spark.createDataFrame([(s, DAY0, 5, "pending", 7, 2.0) for s in "ABCD"], schema)
    assert {r.symbol: r.p for r in R.claim(old, new).collect()} == {"A": 2.0, "B": 1.0, "C": 1.0, "D": 2.0}
    assert [r.symbol for r in R.append_absent(old, new).collect()] == ["D"]


def test_normalize(spark):
    rows = [("A", DAY0, None, 2.0, 1.0, 1.5, 1.0, 1), ("A", DAY0, 1.0, float("nan"), 1.0, 1.6, 1.0, 2), ("A", DAY0 + dt.timedelta(1), 1.0, 1.0, 1.0, -1.0, 1.0, 1), ("A", DAY0 + dt.timedelta(2), 1.0, 1.0, 1.0, None, 1.0, 1)]
    out = B.normalize(spark.createDataFrame(rows, "symbol string, session_date date, open double, high double, low double, close double, volume double, updated_at int")).collect()
    assert len(out) == 1 and out[0].close == 1.6 and out[0].high == 1.6


def test_as_of_is_backward_and_inclusive(spark):
    left = spark.createDataFrame([("A", 1), ("A", 5), ("A", 9), ("B", 5)], "k string, t int")
    right = spark.createDataFrame([("A", 5, "x", 1.0), ("A", 7, None, 2.0)], "k string, t int, v string, w double")
    got = {(r.k, r.t): (r.v, r.w) for r in B.as_of(left, right, "t", ["k"], ["v", "w"]).collect()}
    assert got == {("A", 1): (None, None), ("A", 5): ("x", 1.0), ("A", 9): (None, 2.0), ("B", 5): (None, None)}


def test_calibrated_probability(spark):
    cases = [("80", 53.0), ("53", 53.0), ("99.9", 99.9), ("0", 0.0), ("high", 50.0), (None, 50.0)]
    df = spark.createDataFrame(cases, "p string, b double")
    got = [r[0] for r in df.select(scalars.calibrated(F.col("p"), F.col("b"))).collect()]
    z = lambda p: math.log(p / (1 - p))
    assert got[0] == pytest.approx(100 / (1 + math.exp(-(z(0.53) + 0.132 * (z(0.8) - z(0.53)))))) and got[1] == pytest.approx(53)
    assert got[2] == pytest.approx(99) and got[3] == pytest.approx(1) and got[4] is None and got[5] is None


def test_lexicon(spark):
    rows = [(1, "Shares not strong today"), (2, "very STRONG"), (3, "weak, strong"), (4, None), (5, "no no no a strong")]
    out = {r.id: r for r in text.lexicon_scores(spark.createDataFrame(rows, "id int, t string"), "id", "t", {"strong": 1.5, "weak": -1.3}, ["not", "no"], {"very": 1.3}).collect()}
    assert out[1].score == pytest.approx(math.tanh(-0.5)) and out[1].label == "Negative"
    assert out[2].score == pytest.approx(math.tanh(1.95 / 3)) and out[3].terms == ["strong", "weak"] and out[3].label == "Neutral"
    assert out[4].score == 0.0 and out[5].score < 0


def test_listings_and_universe(spark):
    rows = [("ABC", "Abc Inc - Common Stock", "N", "N", "N"), ("BRK.B", "Berk", "N", None, ""), ("ABCDW", "X Warrant", "N", "N", "N"), ("T", "Test", "Y", "N", "N"), ("E", "Fund", "N", "Y", "N"), ("File Creation Time: 1", None, None, None, None)]
    out = {r.symbol: r.name for r in text.listed(spark.createDataFrame(rows, "symbol string, name string, test_issue string, etf string, financial_status string")).collect()}
    assert out == {"ABC": "Abc Inc", "BRK-B": "Berk"}
    a = spark.createDataFrame([("A", "a1", "", "x"), ("B", "b1", "s", "x")], "symbol string, name string, sector string, list string")
    b = spark.createDataFrame([("A", "a2", "t", "y"), ("C", "c2", None, "y")], "symbol string, name string, sector string, list string")
    got = {r.symbol: (r.name, r.sector, r.list) for r in text.merge_universe([a, b]).collect()}
    assert got == {"A": ("a1", "t", "x"), "B": ("b1", "s", "x"), "C": ("c2", None, "y")}


def test_html_items(spark):
    pages = spark.createDataFrame([(1, "<ul><li><a href='/x'>X &amp; Y</a></li><li>plain</li></ul><table><tr><td>a</td><td>b</td></tr></table>"), (2, None)], "id int, html string")
    got = [(r.id, r.href, r.label) for r in html_items(spark, pages, "id", "html").orderBy("id", "item").collect()]
    assert got == [(1, "/x", "X & Y"), (1, "", "plain"), (1, "", "ab")]


def test_quantile_labels_and_average_ranks(spark):
    x = [1.0, 2.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0, 100.0]
    df = spark.createDataFrame([("k", v) for v in x], "k string, v double")
    got = N.quantile_label(df, "v").orderBy("v").toPandas()
    assert list(got.q) == list(pd.qcut(pd.Series(x), 5, labels=False) + 1)
    ranks = df.select("v", N.average_rank("v", ["k"]).alias("r")).orderBy("v").toPandas()
    assert list(ranks.r) == list(pd.Series(x).rank())


def test_throttle_counts_admitted_events_only(spark, tmp_path):
    rng = np.random.default_rng(4)
    base = dt.datetime(2024, 1, 1)
    rows = [(i, base + dt.timedelta(seconds=int(s)), 1, "k" + str(i % 2), 1.0, "") for i, s in enumerate(np.sort(rng.integers(0, 40_000, 300)))]
    spark.createDataFrame(rows, J.EVENTS).write.parquet(str(tmp_path / "events.parquet"))
    out = {r.event_id: r.admitted for r in J.to_table(spark, J.throttled(spark.readStream.schema(J.EVENTS).parquet(str(tmp_path / "events.parquet")).withColumn("ts", F.col("ts").cast("timestamp"))), "t").collect()}
    held: dict[str, list] = {"k0": [], "k1": []}
    for i, ts, _, k, _, _ in rows:
        held[k] = [h for h in held[k] if h > ts - dt.timedelta(hours=1)]
        ok = len(held[k]) < 3
        if ok:
            held[k].append(ts)
        assert out[i] == ok
