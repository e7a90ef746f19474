"""Queries that run the streaming jobs to the end of their input."""

from __future__ import annotations

from pyspark.sql import functions as F

from hindcast.operators import records as R
from hindcast.plans import ctes as C
from hindcast.plans.registry import query, rounded
from hindcast.sources import adapters as A
from hindcast.streaming import jobs as J


@query("""WITH d AS (SELECT CAST(date_trunc('day', ts) AS DATE) AS session_date, * FROM events) SELECT event_type AS symbol, session_date, round(arg_min(value, (ts, event_id)), 6) AS open, max(value) AS high, min(value) AS low, round(arg_max(value, (ts, event_id)), 6) AS close, count(*) AS volume
FROM d WHERE session_date + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR GROUP BY 1, 2""")
def r3_session_bars_stream(spark, sf_dir):
    out = J.to_table(spark, J.session_bars(J.event_stream(spark, sf_dir)), "session-bars")
    return out.select("symbol", "session_date", *rounded("open"), "high", "low", *rounded("close"), "volume")


@query(C.with_(C.BARS) + """SELECT symbol, session_date, round(CASE WHEN symbol = 'PROMO' THEN close * 2 WHEN pos % 3 = 0 THEN close * 1.001 ELSE close END, 6) AS close FROM bars""")
def r1_r2_refresh_stream(spark, sf_dir):
    """Two landed batches: small revisions are upserted, a re-adjusted series is replaced."""
    bars = A.bars(spark, sf_dir)
    row = lambda df, close, at: df.select("symbol", "session_date", close.alias("close"), F.timestamp_seconds(F.lit(at)).alias("updated_at"))
    folder = J.scratch(spark, "landed")
    row(bars.where("symbol <> 'PROMO' and pos % 3 = 0"), F.col("close") * 1.001, 2).coalesce(1).write.parquet(folder)
    row(bars.where("symbol = 'PROMO'"), F.col("close") * 2, 3).coalesce(1).write.mode("append").parquet(folder)
    return J.refresh_stream(spark, folder, row(bars, F.col("close"), 1)).select("symbol", "session_date", *rounded("close"))


@query(C.with_(C.BARS, C.LEDGER, C.GRADED) + "SELECT symbol, as_of_date, status, round(realized_return, 6) AS realized_return FROM graded")
def r4_grading_stream(spark, sf_dir):
    bars = A.bars(spark, sf_dir)
    rows = A.ledger(bars)
    empty = {"status": F.lit("pending"), "realized_return": F.lit(None).cast("double"), "entry_date": F.lit(None).cast("date"), "outcome_date": F.lit(None).cast("date"), "entry_price": F.lit(None).cast("double"), "outcome_price": F.lit(None).cast("double")}
    folder = J.scratch(spark, "bars-landed")
    bars.where("session_date < date'1999-01-01'").coalesce(1).write.parquet(folder)
    bars.where("session_date >= date'1999-01-01'").coalesce(1).write.mode("append").parquet(folder)
    out = J.grading_stream(spark, folder, rows.withColumns(empty), spark.read.parquet(folder))
    return out.select("symbol", "as_of_date", "status", *rounded("realized_return"))


@query()
def r5_throttle_stream(spark, sf_dir):
    return J.to_table(spark, J.throttled(J.event_stream(spark, sf_dir)), "throttled")


@query("""SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 20 DAY) WHERE n <= 5""")
def r6_snapshot_eviction(spark, sf_dir):
    rows = A.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return J.evicted(rows, "user_id", "ts", F.to_timestamp(F.lit("2024-01-31 00:00:00")), 20, 5).select("user_id", "event_id")


@query(C.with_(C.BARS, C.LEDGER, C.GRADED) + """SELECT symbol, count(*) AS rows, count_if(status = 'graded') AS graded, round(avg(CASE side WHEN 'long' THEN realized_return WHEN 'short' THEN -realized_return END), 6) AS mean_signed FROM graded GROUP BY 1""")
def r7_running_mark(spark, sf_dir):
    """The running mark as a recomputation keyed by symbol, what a refreshed ledger triggers."""
    bars = A.bars(spark, sf_dir)
    rows = R.grade(A.ledger(bars), bars).withColumn("s", R.signed(F.col("side"), F.col("realized_return")))
    return rows.groupBy("symbol").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("status") == "graded").alias("graded"), F.round(F.avg("s"), 6).alias("mean_signed"))
