"""Loads that keep whole histories of chosen symbols, stored payloads as columns, the gate of a
scan's session, provenance, and the projections that are shown to others."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How a forecast is made, and the entry of records from before it was stored.
MADE = {"entry_reference": "next-session-open", "validation_path": "walk-forward-audit"}
LEGACY_OFFSET, LEGACY_FIELD = 1, "Open"


def wide_load(bars: DataFrame, least: int, newest: str, start: str, most: int | None = None) -> DataFrame:
    """Bars since ``start`` of symbols with ``least`` sessions in all, the last at ``newest`` or later.

    ``most`` keeps the symbols of the longest histories only, ties by name.  Symbols are
    counted with map-side sums; bars meet them in a semi join and are never gathered.
    """
    able = bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.max("session_date").alias("last"))
    able = able.where((F.col("n") >= least) & (F.col("last") >= F.lit(newest).cast("date")))
    if most is not None:
        able = able.orderBy(F.col("n").desc(), "symbol").limit(most)
    return bars.where(F.col("session_date") >= F.lit(start).cast("date")).join(able, "symbol", "left_semi")


def closes_of(bars: DataFrame, panel: DataFrame) -> DataFrame:
    """Closes of every symbol of a panel, over all its history."""
    return bars.select("symbol", "session_date", "close").join(panel.select("symbol").distinct(), "symbol", "left_semi")


def flattened(records: DataFrame, payload: str, schema: str, defaults: dict[str, Column] | None = None) -> DataFrame:
    """``records`` with the fields of a JSON payload as columns instead of it.

    A null field takes its default, a column that may use the payload's own fields
    (``payload.field``); text that is not JSON gives null fields and never stops the
    load; a field named like a column of the record yields to that column.
    """
    parsed = records.withColumn(payload, F.from_json(payload, schema))
    made = [f for f in parsed.schema[payload].dataType.names if f not in records.columns]
    shown = [F.coalesce(F.col(payload)[f], *([defaults[f]] if f in (defaults or {}) else [])).alias(f) for f in made]
    return parsed.select(*[F.col(c) for c in records.columns if c != payload], *shown)


FORECAST = "probability_up double, tier string, entry_price double, entry_reference struct<session_offset:int,price_field:string>, signal_close double"


def forecast_records(records: DataFrame, payload: str = "payload", schema: str = FORECAST) -> DataFrame:
    """Stored forecasts as columns; one without an entry reference enters at the next open, and
    what it has as its entry price was the close of its signal."""
    told = F.struct(F.lit(LEGACY_OFFSET).alias("session_offset"), F.lit(LEGACY_FIELD).alias("price_field"))
    legacy = F.when(F.col(payload)["entry_reference"].isNull(), F.col(payload)["entry_price"])
    return flattened(records, payload, schema, {"entry_reference": told, "signal_close": legacy})


def session_gate(runs: DataFrame, sessions: DataFrame, scan_time: str = "17:15:00", zone: str = "America/New_York", stale_days: int = 4) -> DataFrame:
    """``runs`` with ``session``, the benchmark's latest one at or before the run's ``upto``, and ``gate``.

    ``now`` is the run's clock in UTC (a timestamp without zone).  gate: 'unavailable'
    without a session, 'future' if it is after the local date, 'unconfirmed' on its own
    date before ``scan_time``, 'stale' over ``stale_days`` days later, else
    'confirmed'.  Only distinct dates meet in one window, a row a date.
    """
    known = sessions.select(F.col("session_date").alias("date"), F.col("session_date").alias("session")).distinct()
    asked = runs.select(F.col("upto").alias("date"), F.lit(None).cast("date").alias("session")).distinct()
    held = known.unionByName(asked).groupBy("date").agg(F.max("session").alias("session"))
    to_here = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    latest = held.withColumn("session", F.last("session", ignorenulls=True).over(to_here)).withColumnRenamed("date", "upto")
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), "now")
    today, clock = F.to_date(local), F.date_format(local, "HH:mm:ss")
    gate = (
        F.when(F.col("session").isNull(), "unavailable").when(F.col("session") > today, "future")
        .when((F.col("session") == today) & (clock < scan_time), "unconfirmed").when(F.datediff(today, "session") > stale_days, "stale").otherwise("confirmed")
    )
    return runs.join(latest, "upto", "left").withColumn("gate", gate)


def content_hash(value: dict) -> str:
    """sha256 of a configuration as JSON with sorted keys and no blanks; a number that is not finite is refused."""
    told = json.dumps(value, sort_keys=True, separators=(",", ":"), allow_nan=False)
    return "sha256:" + hashlib.sha256(told.encode()).hexdigest()


def with_provenance(records: DataFrame, version: str, commit: str = "unknown", config: dict | None = None, vintage: Column | None = None) -> DataFrame:
    """``records`` with model_version, git_commit, config_hash and data_vintage, each kept where it is given.

    Without a ``config`` a row's hash is of its own model version and of how forecasts are
    made; :func:`content_hash` gives the same for plain names.
    """
    given = lambda c: [F.col(c)] if c in records.columns else []
    model = F.coalesce(*given("model_version"), F.lit(version))
    own = F.to_json(F.struct(F.lit(MADE["entry_reference"]).alias("entry_reference"), model.alias("model_version"), F.lit(MADE["validation_path"]).alias("validation_path")))
    hashed = F.lit(content_hash(config)) if config is not None else F.concat(F.lit("sha256:"), F.sha2(own, 256))
    return records.withColumns({
        "model_version": model, "git_commit": F.coalesce(*given("git_commit"), F.lit(commit)), "config_hash": F.coalesce(*given("config_hash"), hashed),
        "data_vintage": F.coalesce(*given("data_vintage"), vintage if vintage is not None else F.lit(None).cast("string")),
    })


RUN = ("id", "session_date", "algorithm_version", "status", "total_count", "completed_count", "failed_count", "skipped_count", "started_at", "updated_at", "completed_at", "runtime_seconds", "universe_source", "universe_source_timestamp", "universe_fetched_at", "warnings")


def public_runs(runs: DataFrame) -> DataFrame:
    """The shown columns of runs, null where a run has none, with how many are processed and percent done.

    Halves of a percent round to even; an empty run is at 0.
    """
    shown = [F.col(c) if c in runs.columns else F.lit(None).alias(c) for c in RUN]
    count = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long") if c in runs.columns else F.lit(0).cast("long")
    done, total = count("completed_count") + count("failed_count") + count("skipped_count"), count("total_count")
    percent = F.when(total == 0, F.lit(0)).otherwise(F.bround(done / F.nullif(total, F.lit(0)) * 100))
    return runs.select(*shown, done.alias("processed_count"), percent.cast("long").alias("progress_percent"))


def public_evaluations(records: DataFrame) -> DataFrame:
    """Evaluated forecasts as shown: percents, the signal of past cases, and whether each was right.

    Takes shares ``probability_up``, ``baseline_up_rate``, ``edge`` and percents
    ``median_return``, ``actual_return``.  No signal is neither right nor wrong.
    """
    p, edge, median, actual = (F.col(c) for c in ("probability_up", "edge", "median_return", "actual_return"))
    signal = F.when((edge >= 0.04) & (median > 0.5), "bullish").when((edge <= -0.04) & (median < -0.5), "bearish").otherwise("neutral")
    right = F.when(signal == "bullish", actual > 0).when(signal == "bearish", actual < 0)
    told = {
        "probability_up": F.round(p * 100, 1), "baseline_up_rate": F.round(F.col("baseline_up_rate") * 100, 1), "edge_points": F.round(edge * 100, 1), "median_return": F.round(median, 2),
        "actual_return": F.round(actual, 2), "actual_up": actual > 0, "probability_correct": (p >= 0.5) == (actual > 0), "signal": signal, "signal_correct": right,
    }
    kept = [F.col(c) for c in records.columns if c not in told and c != "edge"]
    return records.select(*kept, *[v.alias(k) for k, v in told.items()])
