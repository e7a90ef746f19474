"""Replays of many as-of dates: date grids, the panel of cells, and a run that can be taken up again.

A replay is the analysis of the cells (symbol, date).  The resumable run deals symbols into
buckets by hash; each bucket's panel is written to a folder of its own, and only then does
one row in the manifest name it.  A run that is lost goes on with the buckets that the
manifest lacks, and a folder without a manifest row is not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hindcast.operators import analysis as Y
from hindcast.operators import episodes as N
from hindcast.operators import evidence as E
from hindcast.operators.episodes import Keep, Prepared

STEP, MIN_PRIOR = 21, 1000


def sessions(bars: DataFrame) -> DataFrame:
    """(session_date, i, n): the market's sessions, numbered; one row a session whatever the symbols."""
    days = bars.select("session_date").distinct()
    return days.withColumns({"i": F.row_number().over(Window.orderBy("session_date")) - 1, "n": F.count(F.lit(1)).over(Window.partitionBy())})


def date_grid(days: DataFrame, horizon: int, step: int = STEP, runs: Iterable[tuple[str, int]] = (), sample: int = 0, seed: int = 7) -> DataFrame:
    """(as_of): the dates of a replay among numbered sessions whose whole horizon is there.

    Every ``step``-th session; or, with ``runs`` of (date, length), consecutive sessions from
    the first one at or after each date; or, with ``sample``, so many sessions off the grid
    and a horizon after the start, the first in order of a seeded hash.
    """
    usable = days.where(F.col("i") < F.col("n") - horizon)
    runs = list(runs)
    if runs:
        starts = [usable.agg(F.min(F.when(F.col("session_date") >= F.lit(d).cast("date"), F.col("i")))).alias("s") for d, _ in runs]
        firsts = [s.first()[0] for s in starts]  # one number a run
        inside = [F.col("i").between(f, f + length - 1) for f, (_, length) in zip(firsts, runs) if f is not None]
        hit = inside[0] if inside else F.lit(False)
        for more in inside[1:]:
            hit = hit | more
        return usable.where(hit).select(F.col("session_date").alias("as_of"))
    if sample:
        off = usable.where((F.col("i") >= horizon) & (F.col("i") % step != 0))
        return off.orderBy(F.md5(F.concat_ws("-", F.lit(str(seed)), F.col("session_date").cast("string"))), "session_date").limit(sample).select(F.col("session_date").alias("as_of"))
    return usable.where(F.col("i") % step == 0).select(F.col("session_date").alias("as_of"))


def cells(p: Prepared, dates: DataFrame, min_prior: int = MIN_PRIOR) -> DataFrame:
    """The cells of a replay: symbols that traded on a date, with enough sessions before and the
    whole outcome after it."""
    at = p.bars.select("symbol", F.col("pos").alias("cell"), F.col("session_date").alias("as_of")).join(dates, "as_of", "left_semi")
    return at.join(p.rules.select("symbol", "n", "horizon"), "symbol").where((F.col("cell") >= min_prior) & (F.col("cell") + F.col("horizon") < F.col("n"))).select("symbol", "cell", "as_of")


def panel(p: Prepared, which: DataFrame, keep: Keep) -> DataFrame:
    """One row a cell: what was forecast then, its place on the board, its plan, and what followed.

    A cell without a forecast is there with available = 0.
    """
    a = Y.Analysis(p, which, keep, gaps=False)
    told = keep(a.forecasts, "replay-forecasts")
    placed = Y.board(told).select(*Y.CELL, "side", "tier", "eligible", F.round("score", 6).alias("score"), "expected_move", "adverse_move", "reward_risk")
    plans = E.trade_plan(keep(a.followed, "replay-paths"), told.select("symbol", F.col("cell").alias("anchor"), "price", "direction"))
    plans = plans.select("symbol", F.col("anchor").alias("cell"), F.col("action").alias("plan_action"), "stop_pct", "target_pct")
    after = p.outcomes.select("symbol", F.col("pos").alias("cell"), F.col("entry").alias("entry_price"), F.col("fwd_h").alias("fwd_return"), F.col("max_drawdown").alias("min_low_pct"), F.col("max_upside").alias("max_high_pct"))
    short = told.select(*Y.CELL, "lean", "direction", "combined", "edge", "evidence", "agreement", "grade", "skill", "typical", "range_low", "range_high", "profile", F.lit(1).alias("available"))
    rows = which.join(after, Y.CELL).join(short, Y.CELL, "left").join(placed, Y.CELL, "left").join(plans, Y.CELL, "left")
    return rows.withColumns({"available": F.coalesce("available", F.lit(0)), "eligible": F.coalesce("eligible", F.lit(False))})


def bucket_of(symbol: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(symbol), F.lit(buckets)).cast("int")


def finished(spark: SparkSession, out: str) -> dict[int, str]:
    """Bucket -> folder of what the manifest of ``out`` names; the first row of a bucket counts."""
    try:
        rows = spark.read.schema("bucket int, path string").parquet(f"{out}/manifest")
        return {r.bucket: r.path for r in rows.groupBy("bucket").agg(F.min("path").alias("path")).collect()}  # one row a bucket
    except AnalysisException:  # nothing is finished yet
        return {}


def resume(bars: DataFrame, context: DataFrame, dates: DataFrame, out: str, keep: Keep, buckets: int = 2, min_prior: int = MIN_PRIOR, most: int | None = None) -> DataFrame | None:
    """Replay what ``out`` lacks, a bucket of symbols after the other; the panel once all is there.

    ``most`` stops after so many buckets, as a lost run would.
    """
    spark = bars.sparkSession
    done = finished(spark, out)
    for bucket in [b for b in range(buckets) if b not in done][:most]:
        own = N.prepare(bars.where(bucket_of(F.col("symbol"), buckets) == bucket), context, keep)
        path = f"{out}/cells/{bucket}-{uuid.uuid4().hex}"
        panel(own, cells(own, dates, min_prior), keep).write.parquet(path)
        spark.createDataFrame([(bucket, path)], "bucket int, path string").write.mode("append").parquet(f"{out}/manifest")
    done = finished(spark, out)
    return spark.read.parquet(*done.values()) if len(done) == buckets else None


def publish(table: DataFrame, base: str, run: str) -> None:
    """Write a run's table, then make it visible by one pointer row: readers see whole runs only."""
    spark = table.sparkSession
    path = f"{base}/runs/{run}-{uuid.uuid4().hex}"
    table.write.parquet(path)
    pointer = spark.range(1).select(F.lit(run).alias("run"), F.lit(path).alias("path"), F.current_timestamp().alias("published_at"))
    pointer.write.mode("append").parquet(f"{base}/pointer")


def published(spark: SparkSession, base: str, run: str | None = None) -> DataFrame | None:
    """The table of the latest published run, or of the given one; None if there is none."""
    try:
        rows = spark.read.schema("run string, path string, published_at timestamp").parquet(f"{base}/pointer")
    except AnalysisException:
        return None
    found = (rows.where(F.col("run") == run) if run else rows).agg(F.max_by("path", F.struct("published_at", "path"))).first()[0]
    return spark.read.parquet(found) if found else None


def known_at(versions: DataFrame, keys: list[str], at: Column, known: str = "updated_at") -> DataFrame:
    """A table as it was known at a time: of each key's versions until then, the last."""
    last = Window.partitionBy(*keys).orderBy(F.col(known).desc())
    return versions.where(F.col(known) <= at).withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")


def as_of_forecast(bars: DataFrame, context: DataFrame, date: str, keep: Keep, ahead: DataFrame | None = None) -> DataFrame:
    """The audited forecast of every symbol with nothing later than ``date``, and its outcome.

    Bars and context are cut before anything is computed.  The outcome, from the close of the
    symbol's last session to that of its horizon, reads ``ahead`` (all bars) alone and is NULL
    while the horizon is not over.
    """
    until = F.col("session_date") <= F.lit(date).cast("date")
    p = N.prepare(bars.where(until), context.where(until), keep)
    told = keep(Y.Analysis(p, Y.latest(p), keep, gaps=False).forecasts, "as-of-forecasts")
    after = (bars if ahead is None else ahead).join(p.rules.select("symbol", "horizon"), "symbol")
    w = Window.partitionBy("symbol").orderBy("session_date")
    n = F.row_number().over(w)
    numbered = after.select("symbol", "session_date", "close", "horizon", n.alias("i"))
    starts = numbered.join(told.select("symbol", F.col("as_of").alias("session_date")), ["symbol", "session_date"]).select("symbol", (F.col("i") + F.col("horizon")).alias("i"), F.col("close").alias("then"))
    ends = starts.join(numbered.select("symbol", "i", F.col("session_date").alias("outcome_date"), "close"), ["symbol", "i"]).select("symbol", "outcome_date", ((F.col("close") / F.col("then") - 1) * 100).alias("realized_return"))
    df = told.join(ends, "symbol", "left")
    up = F.col("realized_return") > 0
    right = F.when(F.col("direction") == "bullish", up).when(F.col("direction") == "bearish", F.col("realized_return") < 0)
    return df.withColumns({"requested": F.lit(date).cast("date"), "probability_correct": (F.rint("combined") >= 50) == up, "direction_correct": right})
