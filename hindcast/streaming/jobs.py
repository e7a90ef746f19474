"""Structured Streaming jobs: session bars, incremental refresh, grading, throttling.

Files land in a folder; each job runs with ``availableNow`` and is exactly-once by
its checkpoint.  ``foreachBatch`` sinks write new versions of the buckets that a batch
touches and then commit them by a log (:mod:`hindcast.streaming.tables`), so a batch that
is tried again gives the same table.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hindcast.operators.bars import drifted, replace_series
from hindcast.operators.records import grade
from hindcast.streaming.tables import CommittedTable

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
_own: list[str] = []


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder in the shared place that the cluster names, an own one only if unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not _own:
            _own.append("file://" + tempfile.mkdtemp(prefix="spark-hindcast-"))
        base = _own[0]
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def run(query) -> None:
    q = query.trigger(availableNow=True).start()
    q.awaitTermination()


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = spark.readStream.schema(EVENTS).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def session_bars(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Daily bars by type, emitted once the watermark has closed the day."""
    late = events.withWatermark("ts", delay)
    order = F.struct("ts", "event_id")
    bars = late.groupBy(F.window("ts", "1 day"), F.col("event_type").alias("symbol")).agg(
        F.min_by("value", order).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", order).alias("close"), F.count(F.lit(1)).alias("volume")
    )
    return bars.select("symbol", F.to_date("window.start").alias("session_date"), "open", "high", "low", "close", "volume")


def to_table(spark: SparkSession, stream: DataFrame, label: str) -> DataFrame:
    """Append a stream to a Parquet table and read the table."""
    out = scratch(spark, label)
    run(stream.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", scratch(spark, label + "-state")))
    return spark.read.schema(stream.schema).parquet(out)


def versioned(spark: SparkSession, stream: DataFrame, label: str, first: DataFrame, step: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """Fold micro-batches of symbols into a committed table and read it to the end of the stream."""
    table = CommittedTable(spark, scratch(spark, label), first.schema)
    table.start(first)
    return table.fold(stream, step)


def refresh(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """Upsert a batch; where its overlap has drifted the whole series of the symbol is
    replaced: late corrections are not patched into an old adjustment."""
    moved = drifted(stored, batch).where("drift").select("symbol")
    return replace_series(stored, batch, moved)


def refresh_stream(spark: SparkSession, folder: str, stored: DataFrame) -> DataFrame:
    stream = spark.readStream.schema(stored.schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(folder)
    return versioned(spark, stream, "bars", stored, refresh)


def grading_stream(spark: SparkSession, folder: str, pending: DataFrame, bars: DataFrame) -> DataFrame:
    """Bars arrive; each batch grades what is pending against the bars there are by then."""
    stream = spark.readStream.schema(bars.schema).option("maxFilesPerTrigger", 1).parquet(folder)

    def step(ledger: DataFrame, batch: DataFrame) -> DataFrame:
        known = spark.read.schema(bars.schema).parquet(folder)
        until = batch.groupBy("symbol").agg(F.max("session_date").alias("_until"))
        visible = known.join(until, "symbol").where(F.col("session_date") <= F.col("_until")).drop("_until")
        names = [c for c in ledger.columns if c not in ("status", "realized_return", "entry_date", "outcome_date", "entry_price", "outcome_price")]
        done = ledger.where("status = 'graded'")
        return done.unionByName(grade(ledger.where("status <> 'graded'").select(*names), visible).select(*ledger.columns))

    return versioned(spark, stream, "ledger", pending, step)


ADMITTED = "event_id long, event_type string, admitted boolean"


def throttled(events: DataFrame, limit: int = 3, seconds: int = 3600) -> DataFrame:
    """At most ``limit`` admitted events a key in any trailing window; refused ones don't
    count.  The state of a key is the times of its last ``limit`` admitted events."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values(["at", "event_id"])  # one micro-batch of one key
        out = []
        for at in rows["at"]:
            held = [h for h in held if h > at - seconds]
            out.append(len(held) < limit)
            if out[-1]:
                held.append(at)
        state.update((held,))
        yield pd.DataFrame({"event_id": rows["event_id"], "event_type": key[0], "admitted": out})

    timed = events.select("event_id", "event_type", (F.unix_micros("ts") / 1e6).alias("at"))
    return timed.groupBy("event_type").applyInPandasWithState(step, ADMITTED, "held array<double>", "append", "NoTimeout")


def evicted(snapshots: DataFrame, key: str, at: str, now, ttl_days: float, most: int) -> DataFrame:
    """Keyed snapshots that a time-to-live and a bound on entries leave: newest first."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(F.col(at).desc(), "event_id")
    fresh = snapshots.where(F.col(at) >= now - F.expr(f"interval {int(ttl_days * 86400)} seconds"))
    return fresh.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).drop("n")
