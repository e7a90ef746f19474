"""Loads, payloads, the session gate, provenance, projections and longer search windows on small tables."""

import datetime as dt
import hashlib
import json
import math

import pytest
from pyspark.sql import functions as F

from hindcast.operators import features as X
from hindcast.operators import loads as L
from hindcast.operators import panels as N

DAY = dt.date(1998, 1, 5)


def bars(spark, sizes, first=DAY):
    rows = [(s, first + dt.timedelta(days=i), float(10 + i)) for s, n in sizes.items() for i in range(n)]
    return spark.createDataFrame(rows, "symbol string, session_date date, close double")


def test_wide_load_keeps_long_and_fresh_histories(spark):
    rows = bars(spark, {"A": 5, "B": 4, "C": 2}).unionByName(bars(spark, {"OLD": 9}, dt.date(1990, 1, 1)))
    got = L.wide_load(rows, 4, "1998-01-08", "1998-01-06").collect()
    assert sorted((r.symbol, r.session_date.day) for r in got) == [("A", d) for d in range(6, 10)] + [("B", d) for d in range(6, 9)]
    assert {r.symbol for r in L.wide_load(rows, 2, "1998-01-01", "1990-01-01", most=1).collect()} == {"A"}
    assert L.wide_load(rows.limit(0), 1, "1998-01-01", "1990-01-01").count() == 0


def test_closes_of_a_panel_take_the_whole_history(spark):
    panel = spark.createDataFrame([("A",), ("A",), (None,), ("Z",)], "symbol string")
    assert sorted(r.session_date for r in L.closes_of(bars(spark, {"A": 3, "B": 3}), panel).collect()) == [DAY + dt.timedelta(days=i) for i in range(3)]


def test_payloads_that_are_broken_missing_or_clash(spark):
    rows = [(1, '{"p": 1.5, "entry": "open"}'), (2, '{"p": 2.5}'), (3, '{"p": 2.'), (4, None), (5, ""), (6, '{"id": 9, "p": null, "more": 1}')]
    got = L.flattened(spark.createDataFrame(rows, "id long, payload string"), "payload", "id long, p double, entry string", {"entry": F.lit("close")})
    assert got.columns == ["id", "p", "entry"]
    assert sorted(map(tuple, got.collect())) == [(1, 1.5, "open"), (2, 2.5, "close"), (3, None, "close"), (4, None, "close"), (5, None, "close"), (6, None, "close")]


def test_records_without_an_entry_take_the_legacy_one(spark):
    rows = [
        (1, 7.0, '{"entry_price": 3.5, "tier": "x"}'), (2, None, '{"entry_price": 3.5, "entry_reference": {"session_offset": 2, "price_field": "Close"}}'),
        (3, None, '{"entry_price": 3.5, "signal_close": 4.5}'), (4, None, "{"),
    ]
    df = L.forecast_records(spark.createDataFrame(rows, "id int, entry_price double, payload string"))
    got = {r.id: (r.entry_price, tuple(r.entry_reference), r.signal_close) for r in df.collect()}
    assert got == {1: (7.0, (1, "Open"), 3.5), 2: (None, (2, "Close"), None), 3: (None, (1, "Open"), 4.5), 4: (None, (1, "Open"), None)}


def test_session_gate_by_the_local_clock(spark):
    sessions = bars(spark, {"A": 5, "B": 5}).select("session_date")  # Monday 5 to Friday 9
    at = lambda *a: dt.datetime(1998, 1, *a)
    runs = [
        (1, dt.date(1998, 1, 4), at(5, 12), "unavailable"), (2, dt.date(1998, 1, 9), at(9, 22, 14), "unconfirmed"), (3, dt.date(1998, 1, 9), at(9, 22, 15), "confirmed"),
        (4, dt.date(1998, 1, 9), at(9, 4, 59), "future"), (5, dt.date(1998, 1, 20), at(14, 4, 59), "confirmed"), (6, dt.date(1998, 1, 20), at(14, 5, 0), "stale"), (7, None, at(9, 12), "unavailable"),
    ]
    df = spark.createDataFrame(runs, "run int, upto date, now timestamp_ntz, want string")
    got = L.session_gate(df, sessions).collect()
    assert len(got) == len(runs) and all(r.gate == r.want for r in got)
    assert {r.gate for r in L.session_gate(df, sessions.limit(0)).collect()} == {"unavailable"}


def test_provenance_fills_what_is_not_given(spark):
    want = lambda v: "sha256:" + hashlib.sha256(json.dumps({"validation_path": "walk-forward-audit", "model_version": v, "entry_reference": "next-session-open"}, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    rows = spark.createDataFrame([(1, "v1", None), (2, None, "mine")], "id int, model_version string, config_hash string")
    got = {r.id: r for r in L.with_provenance(rows, "v0", "abc", vintage=F.lit("1998-01-05")).collect()}
    assert (got[1].model_version, got[1].config_hash, got[1].git_commit, got[1].data_vintage) == ("v1", want("v1"), "abc", "1998-01-05")
    assert (got[2].model_version, got[2].config_hash) == ("v0", "mine")
    assert L.content_hash({"model_version": "v1", **L.MADE}) == want("v1")
    assert L.with_provenance(rows.drop("config_hash"), "v0", config={"b": 1, "a": 2}).first().config_hash == L.content_hash({"a": 2, "b": 1})
    with pytest.raises(ValueError):
        L.content_hash({"a": math.nan})


def test_public_runs_round_halves_to_even(spark):
    rows = spark.createDataFrame([(1, 200, 1, None, 0), (2, 200, 3, 0, 0), (3, 0, 0, 0, 0), (4, None, 5, 0, 0), (5, 3, 1, 1, 1)], "id long, total_count int, completed_count int, failed_count int, skipped_count int")
    got = {r.id: (r.processed_count, r.progress_percent) for r in L.public_runs(rows.withColumn("secret", F.lit("x"))).collect()}
    assert got == {1: (1, 0), 2: (3, 2), 3: (0, 0), 4: (5, 0), 5: (3, 100)}
    assert L.public_runs(rows).columns == [*L.RUN, "processed_count", "progress_percent"]


def test_public_evaluations(spark):
    rows = [("bull", 0.6, 0.5, 0.1, 1.0, 2.0), ("bear", 0.4, 0.5, -0.1, -1.0, 2.0), ("flat", 0.5, 0.5, 0.0, 1.0, 0.0)]
    df = spark.createDataFrame(rows, "id string, probability_up double, baseline_up_rate double, edge double, median_return double, actual_return double")
    got = {r.id: (r.signal, r.signal_correct, r.probability_correct, r.edge_points) for r in L.public_evaluations(df).collect()}
    assert got == {"bull": ("bullish", True, True, 10.0), "bear": ("bearish", False, False, -10.0), "flat": ("neutral", None, False, 0.0)}


def test_longer_windows_and_strength_by_loops(spark):
    close = [100 + 10 * math.sin(i / 7) + i / 9 for i in range(300)]
    rows = [("A", i, c, 1000.0 + i) for i, c in enumerate(close)] + [("UP", i, 1.0 + i, 1.0) for i in range(4)]
    df = spark.createDataFrame(rows, "symbol string, g int, close double, volume double")
    last = N.long_search_features(df).where("symbol = 'A' and g = 299").first()
    mean = lambda x: sum(x) / len(x)
    dev = lambda x: math.sqrt(sum((v - mean(x)) ** 2 for v in x) / (len(x) - 1))
    ret = [b / a - 1 for a, b in zip(close, close[1:])]
    want = {
        "mom_63": close[299] / close[236] - 1, "mom_126": close[299] / close[173] - 1, "reversal_63": 1 - close[299] / close[236], "reversal_126": 1 - close[299] / close[173], "vol_63": dev(ret[-63:]),
        "sma_dist_63": close[299] / mean(close[-63:]) - 1, "sma_dist_200": close[299] / mean(close[-200:]) - 1, "vol_ratio": dev(ret[-5:]) / dev(ret[-21:]) - 1,
        "drawdown_252": close[299] / max(close[-252:]) - 1, "dollar_volume": math.log1p(close[299] * mean([1000.0 + i for i in range(280, 300)])),
    }
    assert set(want) == set(N.LONG_SEARCHED) and all(last[k] == pytest.approx(v, rel=1e-9) for k, v in want.items())
    gain = loss = None
    for a, b in zip(close, close[1:]):
        up, down = max(b - a, 0), max(a - b, 0)
        gain, loss = (up, down) if gain is None else (gain * 0.8 + up * 0.2, loss * 0.8 + down * 0.2)
    got = {(r.symbol, r.pos): r.rsi for r in X.wilder_rsi(df.withColumnRenamed("g", "pos"), 5, warm=False).collect()}
    assert got["A", 299] == pytest.approx(100 - 100 / (1 + gain / loss), rel=1e-9)
    assert all(got["UP", i] is None for i in range(4))


def test_strength_of_a_change_that_is_only_rounding(spark):
    less, more = math.nextafter(100.0, 0.0), math.nextafter(100.0, 200.0)
    rows = [("FLAT", 0, 100.0), ("FLAT", 1, less), ("FLAT", 2, 101.0), ("FALL", 0, 100.0), ("FALL", 1, more), ("FALL", 2, 99.0)]
    got = {(r.symbol, r.pos): r.rsi for r in X.wilder_rsi(spark.createDataFrame(rows, "symbol string, pos int, close double"), 5, warm=False).collect()}
    assert [got["FLAT", i] for i in range(3)] == [None, None, None]
    assert [got["FALL", i] for i in range(3)] == [None, None, 0.0]
