"""Audited forecasts, boards and replays against loops that follow one anchor at a time."""

from __future__ import annotations

import datetime
import math
import random
import uuid
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from hindcast.operators import analysis as Y
from hindcast.operators import episodes as N
from hindcast.operators import features as X
from hindcast.operators import matching as M
from hindcast.operators import replay as P

FIRST = datetime.date(2015, 1, 5)
BARS = "symbol string, session_date date, open double, high double, low double, close double, volume double"


def series(symbol, n, seed, weekends=False):
    draw, day, close, rows = random.Random(seed), FIRST, 50.0, []
    while len(rows) < n:
        if weekends or day.weekday() < 5:
            opened = close * math.exp(draw.gauss(0, 0.004))
            close = opened * math.exp(draw.gauss(0.0004, 0.015))
            rows.append((symbol, day, opened, max(opened, close) * (1 + draw.random() * 0.01), min(opened, close) * (1 - draw.random() * 0.01), close, draw.choice([0.0, 1e3, 2e3, 5e3]) + draw.random()))
        day += datetime.timedelta(days=1)
    return rows


def context_of(days):
    draw, level, out = random.Random(99), 100.0, []
    for d in days:
        level *= math.exp(draw.gauss(0.0002, 0.01))
        out.append((d, level, 12 + 8 * draw.random()))
    return out


ROWS = [*series("AA", 1700, 1), *series("BB", 1180, 2), *series("CC", 1500, 3, weekends=True), *series("DD", 200, 4)]
DAYS = sorted({r[1] for r in ROWS})


@pytest.fixture(scope="module")
def keep(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("kept")

    def write(df, label):
        path = f"{base}/{label}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return write


@pytest.fixture(scope="module")
def bars(spark):
    return spark.createDataFrame(ROWS, BARS)


@pytest.fixture(scope="module")
def context(spark):
    return spark.createDataFrame(context_of(DAYS), "session_date date, market double, vix double")


@pytest.fixture(scope="module")
def prepared(bars, context, keep):
    return N.prepare(bars, context, keep)


@pytest.fixture(scope="module")
def analysis(prepared, keep):
    return Y.Analysis(prepared, Y.latest(prepared), keep)


def rule(symbol):
    return X.CALENDAR if symbol == "CC" else X.TRADING


def grid(n, s):
    first, last = s.warmup + s.exclusion + 8 * s.spacing, n - s.horizon - 1
    latest = last - s.horizon - 60
    if last <= first or latest <= first:
        return [], []
    split = min(first + max(5 * s.spacing, round((last - first) * 0.4)), latest)
    return list(range(first, split + 1, s.spacing))[-30:], list(range(split + s.horizon, last + 1, 5))[-260:]


def test_grids_match_a_loop(spark, prepared):
    cells = [(sym, c) for sym in ("AA", "CC", "DD") for c in (150, 638, 720, 760, 1000, 1100, 1249, 1699)]
    got = defaultdict(list)
    for r in Y.grid(spark.createDataFrame(cells, "symbol string, cell int"), prepared.rules).collect():
        got[r.symbol, r.cell, r.kind].append(r.anchor)
    for sym, cell in cells:
        tuning, tested = grid(cell + 1, rule(sym))
        held = max(5, len(tuning) // 3)
        a, b = (tuning[:-held], tuning[-held:]) if len(tuning) >= 10 else ([], [])
        want = {"tuning": a, "calibration": b, "evaluation": tested, "today": [cell]}
        for kind, anchors in want.items():
            assert sorted(got[sym, cell, kind]) == anchors, (sym, cell, kind)


def test_batch_matches_equal_the_single_anchor_matcher(spark, prepared, analysis):
    anchors = spark.createDataFrame([("AA", 1699), ("AA", 722), ("BB", 1179)], "symbol string, anchor int")
    feats = prepared.features.where("symbol in ('AA', 'BB')").cache()
    batch = defaultdict(list)
    for r in analysis.episodes.join(anchors, ["symbol", "anchor"], "left_semi").orderBy("rank").collect():
        batch[r.symbol, r.anchor, r.profile].append(r)
    assert batch
    for k, profile in enumerate(M.PROFILES):
        single = defaultdict(list)
        for r in M.matches(feats, anchors, profile).orderBy("rank").collect():
            single[r.symbol, r.anchor, k].append(r)
        for key, want in single.items():
            if key not in batch:
                continue  # not an anchor of the grid
            got = batch[key]
            assert [r.pos for r in got] == [r.pos for r in want]
            for x, y in zip(got, want):
                assert math.isclose(x.distance, y.distance, rel_tol=1e-9) and math.isclose(x.weight, y.weight, rel_tol=1e-6) and x.quality == y.quality


def test_kernel_weights_have_their_effective_number():
    draw = random.Random(4)
    sets = [sorted(draw.random() * 3 for _ in range(n)) for n in (1, 2, 3, 4, 8, 30, 30)] + [[1.0] * 9]
    w, at = N.kernel_weights(sets), 0
    for d in sets:
        own = w[at : at + len(d)]
        at += len(d)
        assert math.isclose(own.sum(), 1) and all(a >= b - 1e-15 for a, b in zip(own, own[1:]))
        if len(d) > 4 and d[0] != d[-1]:
            assert math.isclose(1 / (own**2).sum(), max(3, 0.72 * len(d)), rel_tol=1e-6)
    assert len(N.kernel_weights([])) == 0


def quantile(pairs, q):
    pairs, so_far = sorted(pairs), 0.0
    total = sum(w for _, w in pairs)
    for v, w in pairs:
        so_far += w
        if so_far >= q * total:
            return v
    return pairs[-1][0]


def closes(symbol):
    rows = [r for r in ROWS if r[0] == symbol]
    return [r[2] for r in rows], [r[5] for r in rows], [r[1] for r in rows]


def said(symbol, anchor, rows, s):
    """One prediction from an anchor's episodes."""
    opens, close, dates = closes(symbol)
    after = lambda i: (close[i + s.horizon] / opens[i + 1] - 1) * 100
    if len(rows) < 8:
        return None
    fwd = [(after(r.pos), r.weight) for r in rows]
    years = len({dates[r.pos].year for r in rows})
    spots = [i for i in range(s.warmup, anchor - s.exclusion + 1, s.horizon) if i + s.horizon < anchor]
    base = (sum(after(i) > 0 for i in spots) + 0.5) / (len(spots) + 1) if spots else 0.5
    n = max(1.0, min(1 / sum(w * w for _, w in fwd), max(4.0, years * 1.5), len(rows)))
    rate = sum(w for v, w in fwd if v > 0)
    p = (base * 6 + rate * n) / (6 + n)
    actual = after(anchor) if anchor + s.horizon < len(close) else None
    return {"p": p, "base": base, "med": round(quantile(fwd, 0.5), 2), "lo": round(quantile(fwd, 0.2), 2), "hi": round(quantile(fwd, 0.8), 2), "actual": actual, "n": n, "years": years, "anchor": anchor}


@pytest.fixture(scope="module")
def followed(analysis):
    """(symbol -> profile, predictions by kind) as a loop has them."""
    episodes = defaultdict(list)
    for r in analysis.episodes.orderBy("rank").collect():
        episodes[r.symbol, r.anchor, r.profile].append(r)
    out = {}
    for symbol, n in (("AA", 1700), ("BB", 1180), ("CC", 1500)):
        s = rule(symbol)
        tuning, tested = grid(n, s)
        held = max(5, len(tuning) // 3)
        told = lambda anchors, k: [x for a in anchors if (x := said(symbol, a, episodes[symbol, a, k], s))]  # noqa: E731, B023
        profile, calibration = 0, []
        if len(tuning) >= 10:
            briers = [np.mean([(x["p"] - (x["actual"] > 0)) ** 2 for x in told(tuning[:-held], k)] or [9]) for k in range(4)]
            profile = int(np.argmin(briers))
            calibration = told(tuning[-held:], profile)
        out[symbol] = (profile, calibration, told(tested, profile), said(symbol, n - 1, episodes[symbol, n - 1, profile], s))
    return out


def test_profiles_and_audits_match_a_loop(analysis, followed):
    profiles = {r.symbol: r.profile for r in analysis.profiles.collect()}
    got = {r.symbol: r for r in analysis.audits.collect()}
    assert any(c for _, c, *_ in followed.values())
    for symbol, (profile, calibration, tested, _) in followed.items():
        assert profiles[symbol] == profile
        r, s = got[symbol], rule(symbol)
        y = [x["actual"] > 0 for x in tested]
        hits = [(x["p"] >= 0.5) == u for x, u in zip(tested, y)]
        brier, base = np.mean([(x["p"] - u) ** 2 for x, u in zip(tested, y)]), np.mean([(x["base"] - u) ** 2 for x, u in zip(tested, y)])
        assert r.n == len(tested) and math.isclose(r.brier, brier, rel_tol=1e-9) and math.isclose(r.base_brier, base, rel_tol=1e-9)
        assert math.isclose(r.accuracy, np.mean(hits)) and math.isclose(r.skill, (1 - brier / base) * 100, rel_tol=1e-6)
        apart, last = [], -(10**9)
        for x, h in zip(tested, hits):
            if x["anchor"] >= last + s.horizon:
                apart.append(h)
                last = x["anchor"]
        assert r.independent == len(apart)
        better = brier < base * 0.95 and np.mean(hits) > r.base_accuracy
        assert r.grade == ("limited" if len(tested) < 12 else "positive" if better else "mixed" if brier <= base * 1.05 else "weak")
        if len(calibration) >= 5:
            scores = sorted(max(x["lo"] - x["actual"], x["actual"] - x["hi"], 0.0) for x in calibration)
            k = min(len(scores), max(1, math.ceil((len(scores) + 1) * 0.8 - 1e-9)))
            adjustment = math.ceil(round(scores[k - 1] * 100, 9)) / 100
            assert math.isclose(r.adjustment, adjustment)
            inside = [x["lo"] - adjustment <= x["actual"] <= x["hi"] + adjustment for x in tested]
            assert math.isclose(r.adjusted_coverage, np.mean(inside))
        else:
            assert r.adjustment is None
    assert "DD" not in got


def test_forecasts_match_a_loop(analysis, followed):
    got = {r.symbol: r for r in analysis.forecasts.collect()}
    assert set(got) == set(followed)
    for symbol, (profile, _, _, x) in followed.items():
        r = got[symbol]
        assert math.isclose(r.analog, min(99, max(1, x["p"] * 100))) and math.isclose(r.baseline, x["base"] * 100) and r.typical == x["med"]
        edge = r.analog - r.baseline
        lean = "bullish" if edge >= 4 and x["med"] > 0.5 else "bearish" if edge <= -4 and x["med"] < -0.5 else "neutral"
        assert (r.profile, r.lean, r.direction) == (profile, lean, lean)
        assert r.probability_low < r.analog < r.probability_high and r.years == x["years"]
        assert r.horizon == rule(symbol).horizon


def test_news_can_only_take_a_direction_away(spark, analysis):
    a = Y.Analysis.__new__(Y.Analysis)
    a.__dict__.update(analysis.__dict__, news=spark.createDataFrame([("AA", -1.0, 9), ("BB", 1.0, 5), ("CC", 0.4, 2)], "symbol string, score double, articles int"))
    plain = {r.symbol: r for r in analysis.forecasts.collect()}
    for r in a.forecasts.collect():
        moved = {"AA": -5.0, "BB": 5.0, "CC": 0.4 * (2 / 5) ** 0.5 * 5}[r.symbol]
        assert math.isclose(r.combined, min(99, max(1, r.analog + moved)), rel_tol=1e-9)
        lean = plain[r.symbol].lean
        doubt = lean == "bullish" and r.combined < r.baseline + 2 or lean == "bearish" and r.combined > r.baseline - 2
        assert r.lean == lean and r.direction == ("neutral" if doubt else lean)


def test_reasons_match_a_loop(prepared, analysis):
    rows = analysis.matched.where("symbol = 'AA'").orderBy("rank").collect()
    feats = {r.pos: r for r in prepared.features.where("symbol = 'AA'").collect()}
    s, anchor = X.TRADING, 1699
    near = [feats[i] for i in range(s.warmup, anchor - s.exclusion + 1)]
    shape_weight, weights = list(M.PROFILES.values())[rows[0].profile]
    scales = {}
    for f in X.FEATURES:
        v = np.array([r[f] for r in near if r[f] is not None])
        if feats[anchor][f] is not None and len(v) >= 0.75 * len(near):
            mad = np.median(np.abs(v - np.median(v))) * 1.4826
            scales[f] = (np.median(v), mad if mad > 1e-9 else v.std())
    for r in rows:
        clip = lambda f, i: min(4, max(-4, (feats[i][f] - scales[f][0]) / scales[f][1]))
        found = [(N.LABELS[f], math.exp(-0.5 * abs(clip(f, r.pos) - clip(f, anchor))), w) for f, w in zip(X.FEATURES, weights) if f in scales and feats[r.pos][f] is not None]
        apart = math.sqrt(np.mean((np.array(feats[r.pos].shape) - np.array(feats[anchor].shape)) ** 2))
        found.append(("21-day chart shape", math.exp(-0.5 * apart), shape_weight))
        total = sum(c * w for _, c, w in found)
        want = sorted(found, key=lambda x: -x[1] * x[2])[:6]
        assert [x.label for x in r.reasons] == [x[0] for x in want]
        for x, (_, c, w) in zip(r.reasons, want):
            assert abs(x.closeness - c * 100) <= 0.5 + 1e-6 and abs(x.share - c * w / total * 100) <= 0.5 + 1e-6


def test_strategy_matches_a_loop(prepared, analysis):
    got = {r.symbol: r for r in Y.strategy(prepared, analysis.records).collect()}
    records = defaultdict(list)
    for r in analysis.records.orderBy("anchor").collect():
        records[r.symbol].append(r)
    for symbol, rows in records.items():
        h, (opens, close, _) = rule(symbol).horizon, closes(symbol)
        periods = []
        for r in rows:
            if not periods or r.anchor >= periods[-1].anchor + h:
                periods.append(r)
        equity, curve, start, end = 100.0, [100.0], periods[0].anchor, periods[-1].anchor + h
        longs = [r.anchor for r in periods if r.signal == "bullish"]
        held = 0
        for i in range(start + 1, end + 1):
            own = next((a for a in longs if a < i <= a + h), None)
            if own is not None:
                held += 1
                equity *= close[i] / (opens[i] if i == own + 1 else close[i - 1])
            curve.append(round(equity, 2))
        peak, worst = 100.0, 0.0
        for v in curve:
            peak = max(peak, v)
            worst = min(worst, (v / peak - 1) * 100)
        r = got[symbol]
        assert (r.periods, r.trades) == (len(periods), len(longs)) and math.isclose(r.exposure, held / (end - start))
        assert math.isclose(r.strategy_return, equity - 100, abs_tol=1e-6) and math.isclose(r.hold_return, close[end] / close[start] * 100 - 100, abs_tol=1e-6)
        assert abs(r.max_drawdown - worst) < 0.02


def test_strata_hold_every_record(analysis):
    n = {r.symbol: r.n for r in analysis.audits.collect()}
    sums = defaultdict(int)
    for r in Y.strata(analysis.records).collect():
        sums[r.symbol, r.family] += r.n
    assert sums == {(s, f): n[s] for s in n for f in ("edge", "regime", "probability")}


def test_mixed_calendars_equal_separate_runs(analysis, bars, context, keep):
    p = N.prepare(bars.where("symbol = 'CC'"), context, keep)
    alone = Y.Analysis(p, Y.latest(p), keep).forecasts.collect()[0].asDict()
    both = analysis.forecasts.where("symbol = 'CC'").collect()[0].asDict()
    assert alone["sampling"] == "calendar_daily" and set(alone) == set(both)
    for k, v in alone.items():
        assert v == both[k] or isinstance(v, float) and math.isclose(v, both[k], rel_tol=1e-9), k


def test_board_leaves_neutral_leans_out(spark):
    row = dict(cell=1, as_of=FIRST, price=50.0, range_low=-1.0, range_high=9.0, evidence=80.0, agreement=100.0, grade="positive", skill=10.0, calibrated=60.4, combined=70.0)
    made = [("a", "bullish", "bullish", 5.0, 10.0), ("b", "bullish", "neutral", 5.0, 10.0), ("c", "neutral", "neutral", 5.0, 1.0), ("d", "bearish", "bearish", -5.0, -10.0), ("e", "bullish", "bullish", 1.0, 10.0)]
    rows = [dict(row, symbol=s, lean=lean, direction=d, typical=t, edge=e) for s, lean, d, t, e in made]
    got = {r.symbol: r for r in Y.board(spark.createDataFrame(rows)).collect()}
    assert set(got) == {"a", "b", "d", "e"}
    assert got["a"].rank == 1 and got["b"].rank == 2 and got["b"].conflict and got["d"].side == "short" and got["d"].win_probability == 40
    assert not got["e"].eligible and got["e"].rank is None and got["e"].blockers == ["small move"]
    strict = {r.symbol: r for r in Y.board(spark.createDataFrame([dict(rows[0], range_low=-20.0)]), require_reward_risk=True).collect()}
    assert "low reward" in strict["a"].blockers


def test_as_of_reads_nothing_later(spark, bars, context, keep):
    date = ROWS[1000][1]
    cut = [r for r in ROWS if r[1] <= date]
    early = P.as_of_forecast(spark.createDataFrame(cut, BARS), context.where(F.col("session_date") <= F.lit(date)), str(date), keep)
    later = P.as_of_forecast(bars, context, str(date), keep)
    a, b = ({r.symbol: r.asDict() for r in df.collect()} for df in (early, later))
    assert set(a) == set(b) and {"AA", "BB"} <= set(a)
    opened = ("outcome_date", "realized_return", "probability_correct", "direction_correct")
    for s in a:
        assert a[s]["realized_return"] is None and b[s]["realized_return"] is not None
        for k in set(a[s]) - set(opened):
            assert a[s][k] == b[s][k] or isinstance(a[s][k], float) and math.isclose(a[s][k], b[s][k], rel_tol=1e-9), k
    close = closes("AA")[1]
    assert math.isclose(b["AA"]["realized_return"], (close[1021] / close[1000] - 1) * 100)


def test_cells_as_of_dates(prepared):
    got = {(r.symbol, str(r.as_of)): r.cell for r in Y.as_of(prepared, ["2015-01-04", "2015-01-10", "2016-01-01", "2030-01-01"]).collect()}
    for symbol in ("AA", "CC", "DD"):
        days = closes(symbol)[2]
        for d in ("2015-01-04", "2015-01-10", "2016-01-01", "2030-01-01"):
            n = sum(str(x) <= d for x in days)
            assert got.get((symbol, d)) == (n - 1 if n else None)


def test_known_at_takes_the_last_version(spark):
    t = lambda h: datetime.datetime(2020, 1, 1, h)
    rows = [("a", 1, 1.0, t(1)), ("a", 1, 2.0, t(3)), ("a", 2, 5.0, t(4)), ("b", 1, 7.0, t(2))]
    df = spark.createDataFrame(rows, "symbol string, pos int, close double, updated_at timestamp")
    got = {(r.symbol, r.pos): r.close for r in P.known_at(df, ["symbol", "pos"], F.lit(t(3))).collect()}
    assert got == {("a", 1): 2.0, ("b", 1): 7.0}


def test_interrupted_replay_goes_on(bars, context, keep, spark, tmp_path):
    dates = P.date_grid(P.sessions(bars.where("symbol = 'AA'")), 21, 100)
    small = keep(bars.where("symbol in ('AA', 'BB')"), "bars")
    buckets = {r.b for r in small.select(P.bucket_of(F.col("symbol"), 2).alias("b")).distinct().collect()}
    out = str(tmp_path / "lost")
    assert P.resume(small, context, dates, out, keep, min_prior=900, most=1) is None
    small.limit(1).write.parquet(out + "/cells/1-left-behind")  # a folder that no manifest row names
    first = P.finished(spark, out)
    resumed = P.resume(small, context, dates, out, keep, min_prior=900)
    assert len(first) == 1 and P.finished(spark, out).items() >= first.items()
    p = N.prepare(small, context, keep)
    whole = P.panel(p, P.cells(p, dates, 900), keep)
    key = lambda df: sorted((r.symbol, str(r.as_of), r.available, r.lean, r.plan_action, round(r.fwd_return, 9), r.combined and round(r.combined, 6)) for r in df.collect())
    assert key(resumed) == key(whole) and key(whole) and buckets <= {0, 1}


def test_boards_are_seen_whole_or_not(spark, tmp_path):
    base, df = str(tmp_path), spark.range(3)
    assert P.published(spark, base) is None
    P.publish(df, base, "one")
    df.write.parquet(f"{base}/runs/two-lost")
    assert P.published(spark, base).count() == 3 and P.published(spark, base, "two") is None
    P.publish(spark.range(5), base, "two")
    assert P.published(spark, base).count() == 5 and P.published(spark, base, "one").count() == 3


def test_date_grids(spark):
    days = [FIRST + datetime.timedelta(days=i) for i in range(120)]
    numbered = P.sessions(spark.createDataFrame([(d,) for d in days], "session_date date"))
    at = lambda df: sorted(days.index(r.as_of) for r in df.collect())
    assert at(P.date_grid(numbered, 20, 21)) == [0, 21, 42, 63, 84]
    assert at(P.date_grid(numbered, 20, runs=[(str(days[10]), 3), (str(days[98]), 9), ("2030-01-01", 2)])) == [10, 11, 12, 98, 99]
    some = at(P.date_grid(numbered, 20, 21, sample=15))
    assert len(some) == 15 and all(20 <= i < 100 and i % 21 for i in some) and some == at(P.date_grid(numbered, 20, 21, sample=15))
    assert some != at(P.date_grid(numbered, 20, 21, sample=15, seed=8))


def test_nothing_wide_is_stored(bars, context, keep):
    stored = {}

    def watched(df, label):
        stored[label] = keep(df, label)
        return stored[label]

    p = N.prepare(bars, context, watched)
    a = Y.Analysis(p, Y.latest(p), watched)
    arrays = {(label, f.name) for label, df in stored.items() for f in df.schema if f.dataType.typeName() == "array"}
    assert arrays == {("found", "picks"), ("found", "gaps")}
    asked = a.anchors.select("symbol", "anchor").distinct().count()
    assert a.found.count() <= asked * len(M.PROFILES)
    assert {r.anchor for r in a.found.where("size(picks) > 0").collect()} == {1699, 1179, 1499}
    assert max(df.count() for label, df in stored.items() if label not in ("found", "anchors", "context")) <= 16  # a row a symbol and profile at most


def test_features_move_bars_once(spark, bars):
    lying = X.align_context(bars, spark.createDataFrame([(FIRST, 1.0, 2.0)], "session_date date, market double, vix double")).repartition(4, "symbol")
    numbered = lying.withColumn("pos", F.row_number().over(X.Window.partitionBy("symbol").orderBy("session_date")) - 1)
    plan = X.outcomes(X.with_shape(X.context_features(X.price_features(numbered))), paths=True)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("SortMergeJoin") == plan.count("ShuffledHashJoin") == 0
    assert X.context_features(X.price_features(numbered))._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(symbol") == 1


def test_paths_of_episodes_equal_the_outcomes(spark, prepared):
    rows = [(s, 1179, pos, 0.5) for s in ("AA", "CC") for pos in (0, 400, 1200, 1468, 1469, 1470, 1678, 1679) if pos < (1700 if s == "AA" else 1500)]
    got = {(r.symbol, r.pos): r for r in N.followed(prepared, spark.createDataFrame(rows, "symbol string, anchor int, pos int, weight double")).collect()}
    want = {(r.symbol, r.pos): r for r in prepared.outcomes.where("path is not null").collect()}
    assert set(got) == {(s, pos) for s, _, pos, _ in rows if (s, pos) in want} and len(got) == 12
    for k, r in got.items():
        for c in ("path", "low_path", "high_path"):
            assert np.allclose(r[c], want[k][c], rtol=1e-12, atol=1e-9) and len(r[c]) == len(want[k][c])
        assert math.isclose(r.max_upside, want[k].max_upside, rel_tol=1e-9) and math.isclose(r.max_drawdown, want[k].max_drawdown, rel_tol=1e-9)


def test_scales_choice_and_ranks_equal_plain_ones():
    draw = np.random.default_rng(5)
    for n in (9, 10, 31):
        x = np.sort(np.round(draw.normal(size=(3, n)), 1), axis=1)
        middle, away = N._scales(x)
        assert np.array_equal(middle, np.median(x, axis=1)) and np.array_equal(away, np.median(np.abs(x - middle[:, None]), axis=1))
    distance = np.round(draw.random((6, 80)), 2)
    distance[5] = np.inf
    distance[4, 3:] = np.inf
    chosen, far = N._spaced(distance.copy(), 7, 9)
    for row, got, d in zip(distance, chosen, far):
        taken = []
        for i in np.argsort(row, kind="stable"):
            if np.isfinite(row[i]) and len(taken) < 9 and all(abs(i - j) >= 7 for j in taken):
                taken.append(int(i))
        assert [i for i in got if i >= 0] == taken and np.array_equal(d[: len(taken)], row[taken])
    x = np.round(draw.random(150), 1)
    x[[3, 90]] = np.nan
    for i, rank in enumerate(N._percentiles(x, 70, 60)):
        near = [v for v in x[max(0, i - 69) : i + 1] if np.isfinite(v)]
        want = (sum(v < x[i] for v in near) + (sum(v == x[i] for v in near) + 1) / 2) / len(near) * 100 if np.isfinite(x[i]) and len(near) >= 60 else None
        assert np.isnan(rank) if want is None else rank == want


def test_a_block_of_anchors_with_missing_values_equals_each_alone():
    import pyarrow as pa

    draw, n = np.random.default_rng(6), 520
    values = {f: draw.normal(size=n) for f in X.FEATURES}
    for f, share in (("volume_ratio", 0.1), ("atr", 0.5), ("rsi", 0.02)):
        values[f][draw.random(n) < share] = np.nan
    values["candle_pressure"][260:] = 3.0  # no spread
    close = 50 * np.exp(np.cumsum(draw.normal(0, 0.01, n)))
    fwd = np.where(np.arange(n) < n - 21, draw.normal(size=n), np.nan)
    days = np.datetime64("2015-01-05") + np.arange(n)
    hide = lambda v: pa.array(v, mask=np.isnan(v))
    table = pa.table({"session_date": days, "close": close, "vix": draw.random(n), "entry": close, "fwd_5": hide(fwd), "fwd_10": hide(fwd), "fwd_h": hide(fwd), **{f: hide(v) for f, v in values.items()}})
    own = N._Series(table, {"warmup": 260, "exclusion": 42, "spacing": 10, "horizon": 21, "shape_days": 21, "year": 252})
    weights, shaped = np.array([w for _, w in M.PROFILES.values()]), np.array([s for s, _ in M.PROFILES.values()])
    anchors = np.arange(303, n, 7)
    together = own.block(anchors, np.ones(len(anchors), bool), weights, shaped, 30)
    rows = {(a, k): (list(c[c >= 0]), list(d[c >= 0]), g) for a, k, c, d, g in zip(*together)}
    assert rows
    for a in anchors:
        near, target = own.values[:, 260 : a - 41].T, own.values[:, a]
        usable = np.isfinite(target) & (np.isfinite(near).mean(axis=0) >= 0.75)
        near, target = near[:, usable], target[usable]
        middle = np.nanmedian(near, axis=0)
        spread, sd = np.nanmedian(np.abs(near - middle), axis=0) * 1.4826, np.nanstd(near, axis=0)
        scale = np.where(spread > 1e-9, spread, np.where(sd > 1e-9, sd, 1.0))
        gap = np.clip((near - middle) / scale, -4, 4) - np.clip((target - middle) / scale, -4, 4)
        apart = ((own.shape[260 : a - 41] - own.shape[a]) ** 2).mean(axis=1)
        for k in range(4):
            w = weights[k, usable]
            covered = np.isfinite(gap) @ w + shaped[k]
            far = np.sqrt((np.nansum(gap * gap * w, axis=1) + apart * shaped[k]) / covered)
            far[covered < 0.75 * (w.sum() + shaped[k])] = np.inf
            taken = []
            for i in np.argsort(far, kind="stable"):
                if np.isfinite(far[i]) and len(taken) < 30 and all(abs(i - j) >= 10 for j in taken):
                    taken.append(int(i))
            got = rows.get((a, k), ([], [], None))
            assert got[0] == taken and np.allclose(got[1], far[taken], rtol=1e-9), (a, k)
