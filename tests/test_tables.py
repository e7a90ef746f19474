"""Committed tables, keyed reports, refresh rules, universes and retention."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from hindcast.operators import universe as U
from hindcast.streaming import jobs as J
from hindcast.streaming import tables as S

SCHEMA = "symbol string, n int"


def land(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def add(before, batch):
    return before.unionByName(batch).groupBy("symbol").agg(F.sum("n").cast("int").alias("n"))


def rows_of(df):
    return sorted((r.symbol, r.n) for r in df.collect())


def test_a_batch_lost_before_its_commit_is_done_once(spark, tmp_path):
    folder, base = str(tmp_path / "in"), str(tmp_path / "table")
    symbols = [f"s{i}" for i in range(40)]
    first = spark.createDataFrame([(s, 1) for s in symbols], SCHEMA)
    stream = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    table = S.CommittedTable(spark, base, first.schema)
    table.start(first)
    before = table.paths()
    land(spark, folder, [("s1", 10), ("s2", 20)])

    def killed(number):
        raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        table.fold(stream(), add, killed)
    assert table.paths() == before and rows_of(table.read()) == sorted((s, 1) for s in symbols)
    want = dict.fromkeys(symbols, 1) | {"s1": 11, "s2": 21}
    again = S.CommittedTable(spark, base, first.schema)  # a restart
    again.start(first)
    assert dict(rows_of(again.fold(stream(), add))) == want
    touched = {b for b, p in again.paths().items() if p != before[b]}
    assert 1 <= len(touched) <= 2  # the other buckets stay where they are
    assert dict(rows_of(again.fold(stream(), add))) == want  # nothing new
    land(spark, folder, [("s1", 5), ("new", 7)])
    want |= {"s1": 16, "new": 7}
    assert dict(rows_of(again.fold(stream(), add))) == want and again.committed() == 1


def test_a_committed_batch_is_not_folded_twice(spark, tmp_path):
    first = spark.createDataFrame([("a", 1)], SCHEMA)
    table = S.CommittedTable(spark, str(tmp_path / "t"), first.schema)
    table.start(first)
    table.commit(first, 0, [0, 1, 2, 3, 4, 5, 6, 7])  # batch 0 as a run left it that died after its commit
    land(spark, str(tmp_path / "in"), [("a", 100)])
    assert rows_of(table.fold(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), add)) == [("a", 1)]


def test_a_bucket_may_become_empty(spark, tmp_path):
    first = spark.createDataFrame([("a", 1), ("b", 2)], SCHEMA)
    table = S.CommittedTable(spark, str(tmp_path / "t"), first.schema, buckets=1)
    table.start(first)
    land(spark, str(tmp_path / "in"), [("a", 0)])
    gone = table.fold(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), lambda before, batch: before.where("false"))
    assert gone.count() == 0


def test_refresh_stream_uses_the_committed_table(spark, tmp_path):
    row = lambda s, d, c, at: (s, datetime.date(2020, 1, d), c, datetime.datetime(2020, 1, at))
    schema = "symbol string, session_date date, close double, updated_at timestamp"
    stored = spark.createDataFrame([row("a", 1, 10.0, 1), row("a", 2, 11.0, 1), row("b", 1, 5.0, 1), row("c", 1, 3.0, 1)], schema)
    batch = spark.createDataFrame([row("a", 2, 11.01, 2), row("a", 3, 12.0, 2), row("b", 1, 50.0, 2)], schema)
    batch.coalesce(1).write.parquet(str(tmp_path / "in"))
    got = sorted((r.symbol, r.session_date.day, r.close) for r in J.refresh_stream(spark, str(tmp_path / "in"), stored).collect())
    assert got == [("a", 1, 10.0), ("a", 2, 11.01), ("a", 3, 12.0), ("b", 1, 50.0), ("c", 1, 3.0)]


def test_reports_are_made_once_a_fingerprint(spark, tmp_path):
    ledger = spark.createDataFrame([(1, "a", None), (2, "b", 0.5)], "id long, symbol string, realized_return double")
    bars = spark.createDataFrame([("a", datetime.date(2020, 1, 1), 10.0)], "symbol string, session_date date, close double")
    one = S.fingerprint(ledger, bars)
    assert one == S.fingerprint(ledger.repartition(3), bars)
    changed = [S.fingerprint(ledger.withColumn("realized_return", F.lit(0.1)), bars), S.fingerprint(ledger.where("id = 1"), bars), S.fingerprint(ledger, bars.withColumn("close", F.lit(10.1)))]
    assert len({one, *changed}) == 4
    report = S.KeyedReport(spark, str(tmp_path))
    calls = []
    make = lambda: calls.append(1) or ledger.groupBy().count()
    assert report.current(one, make).first()[0] == 2 and report.current(one, make).first()[0] == 2 and calls == [1]
    report.current(changed[0], make)
    assert len(calls) == 2 and report.computed == 2
    assert S.KeyedReport(spark, str(tmp_path)).current(one, make).first()[0] == 2 and len(calls) == 2  # after a restart


def test_refresh_modes_by_age(spark):
    t = lambda d: datetime.datetime(2020, 3, d)
    stored = spark.createDataFrame([(s, datetime.date(2020, 2, 20 + i)) for i, s in enumerate("abd")], "symbol string, session_date date")
    full = spark.createDataFrame([("a", t(1)), ("a", t(5)), ("b", t(3)), ("c", t(9))], "symbol string, refreshed_at timestamp")
    symbols = spark.createDataFrame([(s,) for s in "abcd"], "symbol string")
    got = {r.symbol: (r.mode, r.since) for r in S.refresh_modes(stored, symbols, full, F.lit(t(10))).collect()}
    assert got == {"a": ("overlap", datetime.date(2020, 2, 10)), "b": ("full", None), "c": ("full", None), "d": ("full", None)}


def test_full_series_replace_and_overlaps_merge(spark):
    d = lambda n: datetime.date(2020, 1, n)
    schema = "symbol string, session_date date, close double"
    stored = spark.createDataFrame([("a", d(1), 1.0), ("a", d(20), 2.0), ("b", d(1), 1.0), ("b", d(2), 2.0), ("c", d(1), 9.0)], schema)
    batch = spark.createDataFrame([("a", d(5), 7.0), ("a", d(20), 2.5), ("b", d(2), 4.0)], schema)
    modes = spark.createDataFrame([("a", "overlap", d(10)), ("b", "full", None), ("c", "full", None)], "symbol string, mode string, since date")
    step = lambda old, new: old.join(new.select("symbol", "session_date"), ["symbol", "session_date"], "left_anti").unionByName(new)
    got = sorted((r.symbol, r.session_date.day, r.close) for r in S.refreshed(stored, batch, modes, step).collect())
    assert got == [("a", 1, 1.0), ("a", 20, 2.5), ("b", 2, 4.0), ("c", 1, 9.0)]  # c has nothing new, so it stays


LISTED = "symbol string, name string, sector string, list string"


def test_a_broken_listing_keeps_the_old_universe(spark):
    a = spark.createDataFrame([("A", "first", "", "x"), ("B", "two", "s", "x")], LISTED)
    b = spark.createDataFrame([("A", "other", "tech", "y"), ("C", "three", "t", "y")], LISTED)
    none = spark.createDataFrame([], "id long, source string, constituents " + U.MEMBER)
    made = U.universe([(a, 2, True), (b, 1, False)], none, "both").collect()
    assert len(made) == 1 and (made[0].id, made[0].stale, made[0].constituent_count, made[0].missing) == (1, False, 3, [])
    assert [(c.symbol, c.name, c.sector) for c in made[0].constituents] == [("A", "first", "tech"), ("B", "two", "s"), ("C", "three", "t")]
    held = spark.createDataFrame([(4, "old", [("Z", "z", "", "x")]), (3, "older", [])], none.schema)
    soft = U.universe([(a, 2, True), (b, 9, False)], held, "part").collect()[0]
    assert (soft.id, soft.stale, soft.constituent_count, soft.missing) == (5, False, 2, [1])
    broken = U.universe([(a, 3, True), (b, 1, False)], held, "both").collect()[0]
    assert (broken.id, broken.source, broken.stale) == (4, "old", True) and broken.constituents[0].symbol == "Z"
    assert U.universe([(a, 3, True)], none, "both").count() == 0


def test_retention_counts_references(spark):
    runs = spark.createDataFrame([(i, datetime.date(2020, 1, 1 + i // 2), i % 3) for i in range(9)], "id int, session_date date, universe_id int")
    kept = U.retained_runs(runs, 4)
    assert sorted(r.id for r in kept.collect()) == [5, 6, 7, 8]
    universes = spark.createDataFrame([(i,) for i in range(8)], "id int")
    forecasts = spark.createDataFrame([(5,), (None,), (5,)], "universe_id int")
    reports = spark.createDataFrame([(7,)], "universe_id int")
    assert sorted(r.id for r in U.retained_universes(universes, kept, forecasts, reports).collect()) == [0, 1, 2, 5, 7]
