"""Bar hygiene: normalizing, merging, selecting, summarizing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def by_date():
    return Window.partitionBy("symbol").orderBy("session_date")


def normalize(raw: DataFrame, order: str = "updated_at") -> DataFrame:
    """Numbers coerced (never NaN), missing O/H/L taken from the close, rows without a
    positive close dropped, the latest row of a (symbol, session) kept."""
    number = lambda c: F.nullif(F.expr(f"try_cast({c} as double)"), F.lit(float("nan")))
    df = raw.withColumns({c: number(c) for c in ("open", "high", "low", "close", "volume")}).where("close > 0")
    df = df.withColumns({c: F.coalesce(c, "close") for c in ("open", "high", "low")})
    latest = Window.partitionBy("symbol", "session_date").orderBy(F.col(order).desc())
    return df.withColumn("_n", F.row_number().over(latest)).where("_n = 1").drop("_n")


def trailing_history(bars: DataFrame, months: int = 240, rows: int = 7320) -> DataFrame:
    """The last ``months`` of each symbol, at most ``rows`` sessions."""
    newest = Window.partitionBy("symbol")
    back = Window.partitionBy("symbol").orderBy(F.col("session_date").desc())
    df = bars.withColumns({"_last": F.max("session_date").over(newest), "_n": F.row_number().over(back)})
    return df.where((F.col("session_date") >= F.add_months("_last", -months)) & (F.col("_n") <= rows)).drop("_last", "_n")


def tail(bars: DataFrame, n: int) -> DataFrame:
    """The last n sessions of each symbol."""
    back = Window.partitionBy("symbol").orderBy(F.col("session_date").desc())
    return bars.withColumn("_n", F.row_number().over(back)).where(F.col("_n") <= n).drop("_n")


def for_symbols(bars: DataFrame, symbols: DataFrame, start: str | None = None) -> DataFrame:
    """Bars of the given symbols, from a date on (both predicates reach the scan)."""
    df = bars.join(symbols.select("symbol").distinct(), "symbol", "left_semi")
    return df.where(F.col("session_date") >= F.lit(start).cast("date")) if start else df


def upsert(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Union of two bar tables, the later ``updated_at`` of a key winning."""
    both = stored.unionByName(incoming)
    latest = Window.partitionBy("symbol", "session_date").orderBy(F.col("updated_at").desc())
    return both.withColumn("_n", F.row_number().over(latest)).where("_n = 1").drop("_n")


def drifted(stored: DataFrame, incoming: DataFrame, tolerance: float = 0.005) -> DataFrame:
    """(symbol, overlap, drift): whether closes of common sessions moved by more than the tolerance."""
    a, b = stored.select("symbol", "session_date", F.col("close").alias("old")), incoming.select("symbol", "session_date", F.col("close").alias("new"))
    moved = F.when(F.col("old") == 0, F.col("new") != 0).otherwise(F.abs(F.try_divide(F.col("new"), F.col("old")) - 1) > tolerance)
    return a.join(b, ["symbol", "session_date"]).groupBy("symbol").agg(F.count(F.lit(1)).alias("overlap"), F.bool_or(moved).alias("drift"))


def replace_series(stored: DataFrame, incoming: DataFrame, symbols: DataFrame) -> DataFrame:
    """Full refresh of some symbols; the others are upserted."""
    kept = stored.join(symbols.select("symbol").distinct(), "symbol", "left_anti")
    return upsert(kept, incoming)


def quote_summary(bars: DataFrame, year: int = 252, month: int = 21) -> DataFrame:
    """Per symbol: last close, 1-session and month change, year high and low, years of history."""
    w = by_date().rowsBetween(-(year - 1), 0)
    df = bars.withColumns({
        "day_change": (F.col("close") / F.lag("close", 1).over(by_date()) - 1) * 100, "month_change": (F.col("close") / F.lag("close", month).over(by_date()) - 1) * 100,
        "year_high": F.max("high").over(w), "year_low": F.min("low").over(w),
    })
    last = F.struct("close", "day_change", "month_change", "year_high", "year_low")
    out = df.groupBy("symbol").agg(F.max_by(last, "session_date").alias("q"), F.min("session_date").alias("first"), F.max("session_date").alias("last"))
    return out.select("symbol", "q.*", (F.datediff("last", "first") / 365.25).alias("years"))


def liquid_universe(bars: DataFrame, least: int, since: str, sample: int | None = None, seed: str = "u") -> DataFrame:
    """Symbols of enough history that still trade; a sample is the first by hash."""
    out = bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("bars"), F.max("session_date").alias("last")).where((F.col("bars") >= least) & (F.col("last") >= F.lit(since).cast("date")))
    return out.orderBy(F.md5(F.concat(F.lit(seed), F.col("symbol"))), "symbol").limit(sample) if sample else out


def session_complete(session_date: Column, now_utc: Column, zone: str = "America/New_York", close_hour: int = 16) -> Column:
    """Whether a session was over at a UTC moment: an earlier local date, or today after the close."""
    local = F.from_utc_timestamp(now_utc, zone)
    return (session_date < F.to_date(local)) | ((session_date == F.to_date(local)) & (F.hour(local) >= close_hour))


def winsorized(column: str, by: str, low: float = 0.02, high: float = 0.98) -> Column:
    """The value clipped to its date's interpolated percentiles."""
    w = Window.partitionBy(by)
    lo, hi = F.percentile(column, F.lit(low)).over(w), F.percentile(column, F.lit(high)).over(w)
    return F.greatest(F.least(F.col(column), hi), lo)


def as_of(left: DataFrame, right: DataFrame, on: str, keys: list[str], fields: list[str]) -> DataFrame:
    """Backward as-of join, equal times matching: one union and one window."""
    value = F.struct(*fields)
    tagged = left.withColumns({"_tag": F.lit(1), "_v": F.lit(None)}).select(*left.columns, "_tag", F.lit(None).cast(right.select(value.alias("s")).schema["s"].dataType).alias("_v"))
    other = right.select(*[F.col(c) if c in (on, *keys) else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns], F.lit(0).alias("_tag"), value.alias("_v"))
    w = Window.partitionBy(*keys).orderBy(on, "_tag").rowsBetween(Window.unboundedPreceding, 0)
    out = tagged.unionByName(other).withColumn("_v", F.last("_v", ignorenulls=True).over(w)).where("_tag = 1")
    return out.select(*left.columns, *[F.col(f"_v.{f}").alias(f) for f in fields])
