"""Statistics of a replay panel and cross-sectional factor screens."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def enrich(panel: DataFrame) -> DataFrame:
    """Strategy return and excess over the same-date universe, signed by side."""
    by_date = Window.partitionBy("as_of")
    sign = F.when(F.col("side") == "short", -1.0).otherwise(1.0)
    df = panel.withColumn("universe_return", F.avg("fwd_return").over(by_date))
    return df.withColumns({"strategy_return": sign * F.col("fwd_return"), "excess": sign * (F.col("fwd_return") - F.col("universe_return"))})


def clustered(df: DataFrame, keys: list[str], value: str = "excess", date: str = "as_of") -> DataFrame:
    """Mean of date means and its t, NULL below three dates: two aggregations, no rows moved."""
    means = df.groupBy(*keys, date).agg(F.avg(value).alias("_m"))
    out = means.groupBy(*keys).agg(F.avg("_m").alias("mean"), F.stddev_samp("_m").alias("_sd"), F.count("_m").alias("periods"))
    enough = F.col("periods") >= 3
    t = F.try_divide(F.col("mean"), F.nullif(F.col("_sd") / F.sqrt("periods"), F.lit(0.0)))
    return out.select(*keys, F.when(enough, F.col("mean")).alias("mean"), F.when(enough, t).alias("t"), "periods")


def cohorts(df: DataFrame, keys: list[str]) -> DataFrame:
    """n, dates, mean, median, win share and clustered excess of each cohort."""
    flat = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("as_of").alias("dates"), F.avg("strategy_return").alias("mean_return"), F.median("strategy_return").alias("median_return"),
        (F.avg((F.round("strategy_return", 9) > 0).cast("double")) * 100).alias("win"), F.stddev_samp("strategy_return").alias("stdev"),
    )
    t = clustered(df, keys).withColumnsRenamed({"mean": "mean_excess", "t": "t_excess"})
    on = reduce(lambda a, b: a & b, [flat[k].eqNullSafe(t[k]) for k in keys])
    return flat.join(t, on).select(*[flat[k] for k in keys], "n", "dates", "mean_return", "median_return", "win", "stdev", "mean_excess", "t_excess")


def coverage(panel: DataFrame) -> DataFrame:
    return panel.agg(
        F.count(F.lit(1)).alias("cells"), F.count_distinct("symbol").alias("symbols"), F.count_distinct("as_of").alias("dates"), F.count("error").alias("errors"),
        (F.avg("eligible") * 100).alias("eligible_share"), (F.sum("runtime_s") / 3600).alias("cpu_hours"),
    )


def board(df: DataFrame, k: int, sides: tuple[str, ...] = ("long", "short")) -> DataFrame:
    """The k best-scored eligible rows of each date and side."""
    w = Window.partitionBy("as_of", "side").orderBy(F.col("score").desc(), "symbol")
    rows = df.where((F.col("eligible") == 1) & F.col("side").isin(*sides))
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).drop("_n")


def periods(picks: DataFrame) -> DataFrame:
    """Equal-weight return and excess of each date's picks."""
    return picks.groupBy("as_of").agg(F.avg("strategy_return").alias("ret"), F.avg("excess").alias("excess"), F.count(F.lit(1)).alias("n"))


def compounded(series: DataFrame, value: str = "ret", date: str = "as_of", per_year: float = 12.0, keys: list[str] | None = None) -> DataFrame:
    """Total, annual growth and greatest drawdown of compounded period returns.

    A loss of everything ends the curve: growth is taken of max(1 + r, 1e-12)."""
    keys = keys or []
    w = Window.partitionBy(*keys).orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    log = F.ln(F.greatest(1 + F.col(value) / 100, F.lit(1e-12)))
    curve = series.where(F.col(value).isNotNull()).withColumn("_log", log).withColumn("_c", F.exp(F.sum("_log").over(w)))
    curve = curve.withColumn("_dd", (F.col("_c") / F.max("_c").over(w) - 1) * 100)
    out = curve.groupBy(*keys).agg(F.count(F.lit(1)).alias("periods"), F.avg(value).alias("mean"), F.sum("_log").alias("_l"), F.min("_dd").alias("max_drawdown"))
    return out.select(*keys, "periods", "mean", ((F.exp("_l") - 1) * 100).alias("total"), ((F.exp(F.col("_l") / (F.col("periods") / per_year)) - 1) * 100).alias("cagr"), "max_drawdown")


def right_closed(value: Column, edges: list[float], labels: list[str]) -> Column:
    """Label of the (lo, hi] interval of a value, NULL outside."""
    cases = [(lo, hi, label) for lo, hi, label in zip(edges, edges[1:], labels)]
    return reduce(lambda c, x: c.when((value > x[0]) & (value <= x[1]), x[2]), cases[1:], F.when((value > cases[0][0]) & (value <= cases[0][1]), cases[0][2]))


def quantile_label(df: DataFrame, value: str, n: int = 5, out: str = "q", by: list[str] | None = None) -> DataFrame:
    """Bucket 1..n by interpolated quantile edges, right-closed, the lowest inclusive."""
    points = [i / n for i in range(1, n)]
    edges = F.percentile(value, F.array(*[F.lit(p) for p in points])).over(Window.partitionBy(*(by or [])))
    if not by:  # one row of edges instead of a window over everything
        e = df.agg(F.percentile(value, F.array(*[F.lit(p) for p in points])).alias("_e")).withColumn("_one", F.lit(1))
        df = df.withColumn("_one", F.lit(1)).join(F.broadcast(e), "_one").drop("_one")
    else:
        df = df.withColumn("_e", edges)
    bucket = F.when(F.col(value).isNotNull(), F.size(F.filter("_e", lambda x: x < F.col(value))) + 1)
    return df.withColumn(out, bucket).drop("_e")


def half_at_middle_date(df: DataFrame, date: str = "as_of") -> DataFrame:
    """``part`` train or test: distinct dates before and from the middle one on."""
    dates = df.select(date).distinct()
    n = dates.withColumns({"_i": F.row_number().over(Window.orderBy(date)) - 1, "_n": F.count(F.lit(1)).over(Window.partitionBy())})
    split = n.select(date, F.when(F.col("_i") < F.floor(F.col("_n") / 2), "train").otherwise("test").alias("part"))
    return df.join(split, date)


def average_rank(column: str, by: list[str]) -> Column:
    """Rank with ties averaged."""
    w = Window.partitionBy(*by)
    return F.rank().over(w.orderBy(column)) + (F.count(F.lit(1)).over(Window.partitionBy(*by, column)) - 1) / 2


def correlation(x: str, y: str) -> Column:
    """Pearson correlation, NULL where a side is constant."""
    return F.try_divide(F.covar_pop(x, y), F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0)))


def rank_ic(rows: DataFrame, least: int = 30) -> DataFrame:
    """Spearman correlation of value and forward per (feature, session_date) of at least ``least`` names.

    rows is long: (session_date, symbol, feature, value, forward)."""
    by = ["feature", "session_date"]
    valid = rows.where("value is not null and forward is not null")
    ranked = valid.withColumns({"rv": average_rank("value", by), "rf": average_rank("forward", by)})
    out = ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("names"), correlation("rv", "rf").alias("ic"))
    return out.where((F.col("names") >= least) & F.col("ic").isNotNull() & ~F.isnan("ic"))


def ic_summary(ic: DataFrame) -> DataFrame:
    """Days, mean and t of each feature's daily correlations."""
    out = ic.groupBy("feature").agg(F.count(F.lit(1)).alias("days"), F.avg("ic").alias("ic"), F.stddev_samp("ic").alias("_sd"))
    return out.select("feature", "days", "ic", F.try_divide(F.col("ic"), F.nullif(F.col("_sd") / F.sqrt("days"), F.lit(0.0))).alias("t"))


def replicated(ic: DataFrame, other: DataFrame, cut: Column, least_days: int, least_t: float = 2.0) -> DataFrame:
    """Each feature's correlations before and from the date ``cut``, and whether it holds.

    ``other`` has the correlations with a second target.  A feature counts as tested with
    enough days in both halves and there; of N tested ones it survives if its earlier t is beyond
    sqrt(2 ln N), what noise alone would reach, its sign is the same later, and its later t
    beyond ``least_t``.
    """
    half = lambda df, name: ic_summary(df).where(F.col("days") >= least_days).select("feature", *[F.col(c).alias(f"{name}_{c}") for c in ("days", "ic", "t")])
    parts = half(ic.where(F.col("session_date") < cut), "train").join(half(ic.where(F.col("session_date") >= cut), "test"), "feature").join(half(other, "other"), "feature")
    parts = parts.withColumn("tested", F.count(F.lit(1)).over(Window.partitionBy()))  # one row a feature
    noise = F.when(F.col("tested") > 1, F.sqrt(2 * F.ln("tested")))
    holds = (F.abs("train_t") > noise) & (F.signum("train_ic") == F.signum("test_ic")) & (F.abs("test_t") > least_t)
    return parts.withColumns({"noise": noise, "survives": F.coalesce(holds, F.lit(False))})


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """n, rho of a (small, per-date) series."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("_k", F.lit(1))
    ranked = rows.withColumns({"_rx": average_rank(x, ["_k"]), "_ry": average_rank(y, ["_k"])})
    return ranked.agg(F.count(F.lit(1)).alias("n"), correlation("_rx", "_ry").alias("rho"))


def halves_welch(df: DataFrame, factor: str, target: str) -> DataFrame:
    """Means of the target below and above the factor's median, and Welch's t of them."""
    rows = df.where(F.col(factor).isNotNull() & F.col(target).isNotNull()).withColumn("_one", F.lit(1))
    med = rows.agg(F.median(factor).alias("_med")).withColumn("_one", F.lit(1))
    low = F.col(factor) <= F.col("_med")
    out = rows.join(F.broadcast(med), "_one").agg(
        F.avg(F.when(low, F.col(target))).alias("low_mean"), F.avg(F.when(~low, F.col(target))).alias("high_mean"), F.var_samp(F.when(low, F.col(target))).alias("_vl"),
        F.var_samp(F.when(~low, F.col(target))).alias("_vh"), F.count_if(low).alias("n_low"), F.count_if(~low).alias("n_high"),
    )
    t = F.try_divide(F.col("low_mean") - F.col("high_mean"), F.sqrt(F.col("_vl") / F.col("n_low") + F.col("_vh") / F.col("n_high")))
    return out.select("n_low", "n_high", "low_mean", "high_mean", F.when((F.col("n_low") > 2) & (F.col("n_high") > 2), t).alias("t"))


def densify(bars: DataFrame, fields: list[str]) -> DataFrame:
    """Every (session, symbol) of the union grid, absent bars NULL, with the grid position."""
    grid = bars.select("session_date").distinct().withColumn("g", F.row_number().over(Window.orderBy("session_date")) - 1)
    names = bars.select("symbol").distinct()
    spine = names.select("symbol", F.lit(1).alias("_k")).join(grid.withColumn("_k", F.lit(1)), "_k").drop("_k")
    means = bars.groupBy("symbol", "session_date").agg(*[F.avg(f).alias(f) for f in fields])
    return spine.join(means, ["symbol", "session_date"], "left")


def search_features(grid: DataFrame) -> DataFrame:
    """Wide next-session search features over the densified grid (windows count grid sessions)."""
    w = Window.partitionBy("symbol").orderBy("g")

    def full(agg, c, n):
        win = w.rowsBetween(-(n - 1), 0)
        return F.when(F.count(c).over(win) >= n, agg(c).over(win))

    close = F.col("close")
    pct = lambda n: F.try_divide(close, F.lag("close", n).over(w)) - 1
    df = grid.withColumn("ret", pct(1)).withColumn("span", F.nullif(F.col("high") - F.col("low"), F.lit(0.0)))
    mom = {f"mom_{n}": pct(n) for n in (1, 2, 3, 5, 10, 21)}
    df = df.withColumns(mom).withColumns({f"reversal_{n}": -F.col(f"mom_{n}") for n in (1, 2, 3, 5, 10, 21)})
    df = df.withColumns({
        **{f"vol_{n}": full(F.stddev_samp, "ret", n) for n in (5, 21)}, **{f"sma_dist_{n}": close / full(F.avg, "close", n) - 1 for n in (5, 21, 50)},
        "gap": F.try_divide(F.col("open"), F.lag("close", 1).over(w)) - 1, "intraday_position": (close - F.col("low")) / F.col("span"), "intraday_move": close / F.col("open") - 1,
        "true_range": F.col("span") / close, "high_21": close / full(F.max, "close", 21) - 1, "low_21": close / full(F.min, "close", 21) - 1,
        "volume_ratio": F.try_divide(full(F.avg, "volume", 5), F.nullif(full(F.avg, "volume", 20), F.lit(0.0))) - 1, "price_level": F.ln("close"),
    })
    return df


LONG_SEARCHED = (
    "mom_63", "mom_126", "reversal_63", "reversal_126", "vol_63", "sma_dist_63", "sma_dist_200", "vol_ratio", "drawdown_252", "dollar_volume",
)


def long_search_features(grid: DataFrame) -> DataFrame:
    """The search features of longer windows, over the densified grid like :func:`search_features`."""
    w = Window.partitionBy("symbol").orderBy("g")

    def full(agg, c, n):
        win = w.rowsBetween(-(n - 1), 0)
        return F.when(F.count(c).over(win) >= n, agg(c).over(win))

    close = F.col("close")
    change = lambda n: F.try_divide(close, F.lag("close", n).over(w)) - 1
    df = grid.withColumn("ret", change(1)).withColumns({f"mom_{n}": change(n) for n in (63, 126)})
    return df.withColumns({
        **{f"reversal_{n}": -F.col(f"mom_{n}") for n in (63, 126)}, "vol_63": full(F.stddev_samp, "ret", 63), **{f"sma_dist_{n}": close / full(F.avg, "close", n) - 1 for n in (63, 200)},
        "vol_ratio": F.try_divide(full(F.stddev_samp, "ret", 5), F.nullif(full(F.stddev_samp, "ret", 21), F.lit(0.0))) - 1,
        "drawdown_252": close / full(F.max, "close", 252) - 1, "dollar_volume": F.log1p(close * F.nullif(full(F.avg, "volume", 20), F.lit(0.0))),
    })


SEARCHED = (
    *(f"{k}_{n}" for k in ("mom", "reversal") for n in (1, 2, 3, 5, 10, 21)), "vol_5", "vol_21", "sma_dist_5", "sma_dist_21", "sma_dist_50", "gap", "intraday_position",
    "intraday_move", "true_range", "high_21", "low_21", "volume_ratio", "price_level",
)


def melt(df: DataFrame, features: tuple[str, ...], forward: Column) -> DataFrame:
    """Long rows (session_date, symbol, feature, value, forward); one pass, no join."""
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("value")) for f in features])
    return df.withColumn("forward", forward).select("session_date", "symbol", "forward", F.explode(pairs).alias("x")).select("session_date", "symbol", "x.feature", "x.value", "forward")


def breadth(grid: DataFrame, sma: int = 50, least: int = 30) -> DataFrame:
    """Per session: share above the average (no average counts as not above), dispersion and
    median of 21-session changes, share that advanced over five."""
    w = Window.partitionBy("symbol").orderBy("g")
    win = w.rowsBetween(-(sma - 1), 0)
    avg = F.when(F.count("close").over(win) >= least, F.avg("close").over(win))
    df = grid.withColumns({"above": F.coalesce(F.round(F.col("close") - avg, 9) > 0, F.lit(False)).cast("double"), "m": F.try_divide(F.col("close"), F.lag("close", 21).over(w)) - 1, "f": F.try_divide(F.col("close"), F.lag("close", 5).over(w)) - 1})
    return df.groupBy("session_date").agg(
        (100 * F.avg("above")).alias("pct_above"), (100 * F.stddev_samp("m")).alias("dispersion_21d"), (100 * F.median("m")).alias("median_21d_return"),
        (100 * F.avg(F.coalesce(F.round("f", 9) > 0, F.lit(False)).cast("double"))).alias("advance_share_5d"),
    )


def block_bootstrap(series: DataFrame, value: str, date: str = "as_of", block: int = 4, draws: int = 4_000, seed: str = "k") -> DataFrame:
    """Moving-block bootstrap interval of a period mean; blocks are drawn by hash."""
    n = series.where(F.col(value).isNotNull()).withColumns({"i": F.row_number().over(Window.orderBy(date)) - 1, "k": F.count(F.lit(1)).over(Window.partitionBy())})
    slots = n.where(F.col("i") % block == 0).select((F.col("i") / block).cast("long").alias("slot"), "k", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    start = F.conv(F.substring(F.md5(F.concat_ws("-", F.lit(seed), F.col("draw").cast("string"), F.col("slot").cast("string"))), 1, 8), 16, 10).cast("long") % (F.col("k") - block + 1)
    at = slots.withColumn("start", start).select("draw", "slot", "k", "start", F.explode(F.sequence(F.lit(0), F.lit(block - 1))).alias("o"))
    at = at.where(F.col("slot") * block + F.col("o") < F.col("k")).select("draw", (F.col("start") + F.col("o")).alias("i"))
    means = at.join(n.select("i", value), "i").groupBy("draw").agg(F.avg(value).alias("m"))
    return means.agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"), F.avg((F.col("m") <= 0).cast("double")).alias("p_not_positive"))
