"""Queries over whole tables, against loops over every row."""

from __future__ import annotations

import datetime as dt

import pytest

from hindcast.plans import bars as PB
from hindcast.plans import boards as PO
from hindcast.plans import files as PF
from hindcast.plans import texts as PT
from hindcast.sources import adapters as A

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    return A.bars(spark, SF).select("symbol", "session_date", "pos").collect()


def test_business_horizon_of_every_bar(spark, rows):
    got = {(r.symbol, r.session_date): r.horizon_date for r in PO.f26_business_horizon(spark, SF).collect()}
    assert len(got) == len(rows)
    for r in rows:
        day, left = r.session_date, 21
        while left:
            day += dt.timedelta(days=1)
            left -= day.weekday() < 5
        assert got[r.symbol, r.session_date] == day


def test_session_complete_of_every_bar(spark, rows):
    got = {(r.symbol, r.session_date): r.complete for r in PB.p16_session_complete(spark, SF).collect()}
    day = dt.date(2000, 3, 1)
    assert got == {(r.symbol, r.session_date): r.session_date < day or (r.session_date == day and r.pos % 2 == 0) for r in rows}


def test_scan_results_of_the_whole_ledger(spark):
    got = {(r.symbol, r.session_date): (r.status, r.score) for r in PF.k8_scan_results(spark, SF).collect()}
    name = {True: "ranked", False: "refused", None: "unknown"}
    assert got == {(r.symbol, r.as_of_date): (name[r.eligible], r.probability_up) for r in A.ledger(A.bars(spark, SF)).collect()}


def test_content_hash_reads_the_content(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    base = [(1, "abc", "en", "s", 3), (2, None, "en", "s", 0), (3, "x", "de", None, 1)]

    def vintages(rows, name):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / name / "documents.parquet"))
        return {r.lang: r.vintage for r in PT.f14_content_hash(spark, str(tmp_path / name)).collect()}

    first = vintages(base, "base")
    assert vintages(base[::-1], "turned") == first
    for i, changed in enumerate([(1, "abd", "en", "s", 3), (1, "abc", "en", "t", 3), (1, "abc", "en", None, 3)]):
        got = vintages([changed, *base[1:]], f"changed{i}")
        assert got["en"] != first["en"] and got["de"] == first["de"]
    assert vintages([base[0], (2, "", "en", "s", 0), base[2]], "empty")["en"] != first["en"]
