"""Trailing features, path shapes and context alignment of bars.

Windows follow the full-window rule: a value is NULL until its whole window of
non-null inputs is there.  All results are percentages unless they are ratios.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_pos():
    return Window.partitionBy("symbol").orderBy("pos")


@dataclass(frozen=True)
class Sampling:
    """Window lengths of one bar calendar."""

    name: str
    horizon: int
    month: int
    shape_days: int
    quarter: int
    year: int
    trend: tuple[int, int, int]
    vol: tuple[int, int]
    annual: int
    candle: int
    volume: tuple[int, int]
    warmup: int
    exclusion: int
    spacing: int


# Fixed values of the two calendars.
TRADING = Sampling("trading_sessions", 21, 21, 21, 63, 252, (20, 50, 200), (21, 63), 252, 5, (5, 20), 260, 42, 42)
CALENDAR = Sampling("calendar_daily", 30, 30, 30, 90, 365, (30, 75, 300), (30, 90), 365, 7, (7, 30), 380, 60, 60)

FEATURES = (
    "r21", "r63", "rsi", "trend_short", "trend_medium", "trend_long", "vol21", "vol_ratio", "drawdown", "atr", "candle_pressure", "volume_ratio",
    "market_r21", "market_trend", "vix_percentile",
)


def trailing(n: int):
    return by_pos().rowsBetween(-(n - 1), 0)


def full(agg: Column, over: Column, n: int, least: int | None = None, window=None) -> Column:
    """``agg`` over n rows, NULL unless ``least`` (n) of them are non-null."""
    w = window or trailing(n)
    return F.when(F.count(over).over(w) >= (least or n), agg.over(w))


def sma(c: Column, n: int) -> Column:
    return full(F.avg(c), c, n)


def change(c: Column, n: int) -> Column:
    """n-session change in percent."""
    return F.try_divide(c, F.lag(c, n).over(by_pos())) * 100 - 100


def realized_vol(n: int, annual: int) -> Column:
    """Annualized deviation of log returns, in percent; needs ``ret`` precomputed."""
    return full(F.stddev_samp("log_ret"), F.col("log_ret"), n) * F.sqrt(F.lit(float(annual))) * 100


def wilder_rsi(bars: DataFrame, n: int = 14, block: int = 512, price: str = "close", warm: bool = True) -> DataFrame:
    """``bars`` with ``rsi``: Wilder's index by an exact blocked linear recurrence.

    Without ``warm`` it starts at the second bar and is null where nothing has been lost.
    A change within the rounding of the sums that made the prices is none.

    Inside a block of positions the decayed sum is a windowed sum of u*q^-k times
    q^k; the block ends, one in 512 rows, are carried by a fold over a short array.
    All of it are windows of the symbol, so bars that lie by symbol aren't moved.
    """
    q, a = 1 - 1 / n, 1 / n
    delta = F.col(price) - F.lag(price).over(by_pos())
    df = bars.withColumn("_d", delta).withColumn("_d", F.when(F.abs("_d") <= F.abs(price) * 1e-12, 0.0).otherwise(F.col("_d")))
    weight = F.when(F.col("pos") == 1, 1.0).otherwise(a)
    df = df.withColumns({
        "_g": F.when(F.col("_d").isNotNull(), F.greatest(F.col("_d"), F.lit(0.0)) * weight).otherwise(0.0),
        "_l": F.when(F.col("_d").isNotNull(), F.greatest(-F.col("_d"), F.lit(0.0)) * weight).otherwise(0.0),
        "_block": F.floor(F.col("pos") / block), "_k": F.col("pos") % block,
    })
    inner = Window.partitionBy("symbol", "_block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    local = lambda c: F.sum(F.col(c) * F.pow(F.lit(q), -F.col("_k"))).over(inner) * F.pow(F.lit(q), F.col("_k"))
    df = df.withColumns({"_lg": local("_g"), "_ll": local("_l")})
    # a block's last row carries it over; rows of earlier blocks are a range of block numbers
    last = F.coalesce(F.lead("_block").over(by_pos()) != F.col("_block"), F.lit(False))
    df = df.withColumn("_e", F.when(last, F.struct("_lg", "_ll", "_k")))
    before = Window.partitionBy("symbol").orderBy("_block").rangeBetween(Window.unboundedPreceding, -1)
    step = lambda acc, e: F.struct((acc["g"] * F.pow(F.lit(q), e["_k"] + 1) + e["_lg"]).alias("g"), (acc["l"] * F.pow(F.lit(q), e["_k"] + 1) + e["_ll"]).alias("l"))
    df = df.withColumn("_ends", F.collect_list("_e").over(before))
    df = df.withColumn("_carry", F.aggregate("_ends", F.struct(F.lit(0.0).alias("g"), F.lit(0.0).alias("l")), step))
    decay = F.pow(F.lit(q), F.col("_k") + 1)
    gain, loss = F.col("_lg") + F.col("_carry.g") * decay, F.col("_ll") + F.col("_carry.l") * decay
    cold = 100 - 100 / (1 + F.try_divide(gain, F.nullif(loss, F.lit(0.0))))
    rsi = cold if not warm else F.when(F.col("pos") < n, F.lit(None)).when((loss == 0) & (gain == 0), 50.0).when(loss == 0, 100.0).otherwise(100 - 100 / (1 + F.try_divide(gain, loss)))
    return df.withColumn("rsi", rsi).drop("_d", "_g", "_l", "_block", "_k", "_lg", "_ll", "_e", "_ends", "_carry")


def price_features(bars: DataFrame, s: Sampling = TRADING) -> DataFrame:
    """The twelve price features, one row a bar."""
    df = bars.withColumn("log_ret", F.ln(F.try_divide(F.col("close"), F.lag("close").over(by_pos()))))
    prev = F.lag("close").over(by_pos())
    df = df.withColumns({
        "_tr": F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev)),
        "_body": F.try_divide(F.col("close") - F.col("open"), F.nullif(F.col("high") - F.col("low"), F.lit(0.0))),
        "_vol": F.when(F.col("volume") > 0, F.col("volume")),
    })
    short, medium, long_ = (sma(F.col("close"), n) for n in s.trend)
    year = trailing(s.year)
    peak = F.when(F.count("close").over(year) >= max(60, s.year // 4), F.max("close").over(year))
    v0, v1 = (realized_vol(n, s.annual) for n in s.vol)
    ratio = lambda a, b: (F.try_divide(a, b) - 1) * 100
    df = df.withColumns({
        "r21": change(F.col("close"), s.month), "r63": change(F.col("close"), s.quarter),
        "trend_short": ratio(F.col("close"), short), "trend_medium": ratio(short, medium), "trend_long": ratio(medium, long_),
        "vol21": v0, "vol_ratio": ratio(v0, v1), "drawdown": ratio(F.col("close"), peak),
        "atr": F.try_divide(full(F.avg("_tr"), F.col("_tr"), 14), F.col("close")) * 100,
        "candle_pressure": full(F.avg("_body"), F.col("_body"), s.candle) * 100,
        "volume_ratio": ratio(sma(F.col("_vol"), s.volume[0]), sma(F.col("_vol"), s.volume[1])),
    })
    return wilder_rsi(df.drop("_tr", "_body", "_vol"))


def align_context(bars: DataFrame, context: DataFrame) -> DataFrame:
    """Each bar with the last context session strictly before its own.

    Context rows are lagged by one session and carried forward to the sessions that
    bars have.  Both sides are one row a session whatever the number of symbols, so
    the ordering window stays small; bars then join it by session, by broadcast.
    """
    by_date = Window.orderBy("session_date")
    lagged = context.groupBy("session_date").agg(F.first("market").alias("market"), F.first("vix").alias("vix"))
    lagged = lagged.withColumns({"market": F.lag("market").over(by_date), "vix": F.lag("vix").over(by_date)})
    dates = bars.select("session_date").distinct()
    tagged = dates.select("session_date", F.lit(1).alias("tag"), F.lit(None).cast("struct<market:double,vix:double>").alias("c")).unionByName(
        lagged.select("session_date", F.lit(0).alias("tag"), F.struct("market", "vix").alias("c"))
    )
    w = Window.orderBy("session_date", "tag").rowsBetween(Window.unboundedPreceding, 0)
    known = tagged.withColumn("c", F.last("c", ignorenulls=True).over(w)).where("tag = 1").select("session_date", "c.market", "c.vix")
    return bars.join(F.broadcast(known), "session_date", "left")


def percentile_rank(column: str, n: int, least: int | None = None) -> Column:
    """Average-tie percentile rank (0-100) of the current value in its trailing window."""
    w = trailing(n)
    inside = F.collect_list(column).over(w)
    less = F.size(F.filter(inside, lambda x: x < F.col(column)))
    same = F.size(F.filter(inside, lambda x: x == F.col(column)))
    enough = F.col(column).isNotNull() & (F.count(column).over(w) >= (least or n))
    return F.when(enough, (less + (same + 1) / 2) / F.size(inside) * 100)


def context_features(aligned: DataFrame, s: Sampling = TRADING) -> DataFrame:
    """Market momentum and trend and the volatility percentile of aligned bars."""
    m = F.col("market")
    return aligned.withColumns({
        "market_r21": change(m, s.month),
        "market_trend": (F.try_divide(m, sma(m, s.trend[2])) - 1) * 100,
        "vix_percentile": percentile_rank("vix", s.year, 60),
    })


def with_shape(bars: DataFrame, days: int = 21) -> DataFrame:
    """``bars`` with ``shape``: z-scored log path of the last days+1 closes; a flat path gives
    zeros, a shorter one NULL.

    Mean and deviation are window aggregates (a shift of the path leaves its z-scores
    as they are), so each element of the path costs one subtraction and one division.
    """
    w = trailing(days + 1)
    df = bars.withColumn("_log", F.ln("close"))
    df = df.withColumns({"_logs": F.collect_list("_log").over(w), "_mean": F.avg("_log").over(w), "_sd": F.stddev_pop("_log").over(w)})
    z = F.transform("_logs", lambda x: F.when(F.col("_sd") > 1e-12, (x - F.col("_mean")) / F.col("_sd")).otherwise(0.0))
    return df.withColumn("shape", F.when(F.size("_logs") == days + 1, z)).drop("_log", "_logs", "_mean", "_sd")


def shapes(bars: DataFrame, days: int = 21) -> DataFrame:
    """(symbol, pos, shape) of the bars that have one."""
    return with_shape(bars.select("symbol", "pos", "close"), days).where("shape is not null").select("symbol", "pos", "shape")


def outcomes(bars: DataFrame, horizons: tuple[int, ...] = (5, 10, 21), paths: bool = False) -> DataFrame:
    """What a position entered at the next open did: fwd_<h>, max_upside and
    max_drawdown over the last horizon, in percent; optionally daily paths."""
    h = max(horizons)
    entry = F.coalesce(F.lead("open", 1).over(by_pos()), F.lead("close", 1).over(by_pos()))
    ahead = by_pos().rowsBetween(1, h)
    df = bars.withColumn("entry", F.when(entry > 0, entry))
    df = df.withColumns({f"fwd_{n}": (F.try_divide(F.lead("close", n).over(by_pos()), F.col("entry")) - 1) * 100 for n in horizons})
    whole = F.count("close").over(ahead) == h
    df = df.withColumns({
        "max_upside": F.when(whole, (F.max("high").over(ahead) / F.col("entry") - 1) * 100),
        "max_drawdown": F.when(whole, (F.min("low").over(ahead) / F.col("entry") - 1) * 100),
    })
    if paths:
        pct = lambda c: F.when(whole, F.transform(F.collect_list(c).over(ahead), lambda x: (x / F.col("entry") - 1) * 100))
        df = df.withColumns({"path": F.concat(F.array(F.lit(0.0)), pct("close")), "high_path": pct("high"), "low_path": pct("low")})
    return df


def weekend_share() -> Column:
    return F.avg((F.weekday("session_date") >= 5).cast("double"))


def kept_calendar(weekend_share: Column, bars: Column) -> Column:
    return F.when((weekend_share >= 0.15) & (bars >= 60), CALENDAR.name).otherwise(TRADING.name)


def sampling_of(bars: DataFrame) -> DataFrame:
    """(symbol, bars, weekend_share, sampling): which calendar each symbol keeps."""
    out = bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("bars"), weekend_share().alias("weekend_share"))
    return out.withColumn("sampling", kept_calendar(F.col("weekend_share"), F.col("bars")))
