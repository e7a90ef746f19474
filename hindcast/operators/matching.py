"""Analog matching: the nearest earlier episodes of every (symbol, anchor), and what
followed them.  All anchors go through one plan; an anchor sees only trailing data.

An anchor's candidates are positions of its own symbol up to a fixed history, so a
group is bounded by that history (7,320 sessions), not by the corpus.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hindcast.functions.numeric import beta_quantile
from hindcast.operators.features import FEATURES, TRADING, Sampling

MAX_MATCHES, MIN_MATCHES, PRIOR = 30, 8, 6.0
# Weights of the shape and of each feature in the balanced profile and three others.
PROFILES = {
    "balanced": (1.25, (1.1, 0.8, 0.55, 0.75, 0.85, 1.0, 0.7, 0.8, 0.85, 0.45, 0.35, 0.35, 0.8, 0.9, 0.65)),
    "price_structure": (1.7, (1.35, 1.0, 0.55, 1.1, 1.2, 1.25, 0.45, 0.45, 0.7, 0.3, 0.25, 0.2, 0.45, 0.55, 0.35)),
    "regime": (0.8, (0.65, 0.75, 0.35, 0.55, 0.75, 1.35, 1.15, 1.2, 1.1, 0.7, 0.2, 0.3, 1.15, 1.35, 1.2)),
    "flow": (1.1, (0.9, 0.6, 0.75, 0.9, 0.8, 0.7, 0.55, 0.7, 0.6, 0.8, 1.25, 1.3, 0.45, 0.5, 0.4)),
}


def candidates(features: DataFrame, anchors: DataFrame, s: Sampling = TRADING) -> DataFrame:
    """Every (symbol, anchor) with each of its candidate positions: an equi-join on the
    symbol with a range condition."""
    c = features.alias("c")
    a = anchors.select("symbol", "anchor").alias("a")
    near = (F.col("c.pos") >= s.warmup) & (F.col("c.pos") <= F.col("a.anchor") - s.exclusion)
    return a.join(c, (F.col("a.symbol") == F.col("c.symbol")) & near).select("a.symbol", "a.anchor", "c.pos", *[F.col(f"c.{f}") for f in FEATURES], "c.shape")


def robust_scales(pairs: DataFrame, features: tuple[str, ...] = FEATURES) -> DataFrame:
    """Long (symbol, anchor, feature, coverage, med, scale): median and 1.4826 MAD of the
    candidates, the population deviation where the MAD vanishes, then 1."""
    by = ["symbol", "anchor"]
    first = pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[x for f in features for x in (F.median(f).alias(f"med_{f}"), F.stddev_pop(f).alias(f"sd_{f}"), F.count(f).alias(f"n_{f}"))])
    dev = pairs.join(first, by).groupBy(*by).agg(*[F.median(F.abs(F.col(f) - F.col(f"med_{f}"))).alias(f"mad_{f}") for f in features])
    both = first.join(dev, by)
    mad = lambda f: F.col(f"mad_{f}") * 1.4826
    scale = lambda f: F.when(mad(f) > 1e-9, mad(f)).when(F.col(f"sd_{f}") > 1e-9, F.col(f"sd_{f}")).otherwise(1.0)
    rows = F.array(*[F.struct(F.lit(f).alias("feature"), (F.col(f"n_{f}") / F.col("n")).alias("coverage"), F.col(f"med_{f}").alias("med"), scale(f).alias("scale")) for f in features])
    return both.select(*by, F.explode(rows).alias("x")).select(*by, "x.*")


def distances(features: DataFrame, anchors: DataFrame, profile: str = "balanced", s: Sampling = TRADING) -> DataFrame:
    """(symbol, anchor, pos, distance) of all eligible candidates."""
    shape_weight, weights = PROFILES[profile]
    by = ["symbol", "anchor"]
    pairs = candidates(features, anchors, s)
    scales = robust_scales(pairs).groupBy(*by).pivot("feature", list(FEATURES)).agg(F.first(F.struct("coverage", "med", "scale")))
    scales = scales.select(*by, *[F.col(f).alias(f"_s_{f}") for f in FEATURES])
    target = features.select("symbol", F.col("pos").alias("anchor"), *[F.col(f).alias(f"_t_{f}") for f in FEATURES], F.col("shape").alias("_t_shape"))
    target = scales.join(target, by)
    usable = {f: F.col(f"_t_{f}").isNotNull() & (F.col(f"_s_{f}.coverage") >= 0.75) for f in FEATURES}
    total = lambda xs: sum(xs[1:], xs[0])
    target = target.withColumns({f"_w_{f}": F.when(usable[f], F.lit(w)).otherwise(0.0) for f, w in zip(FEATURES, weights)})
    target = target.withColumns({"_usable": total([(F.col(f"_w_{f}") > 0).cast("int") for f in FEATURES]), "_total": total([F.col(f"_w_{f}") for f in FEATURES])}).where(F.col("_usable") >= 6)
    df = pairs.join(target, by)
    clip = lambda v, f: F.least(F.greatest((v - F.col(f"_s_{f}.med")) / F.col(f"_s_{f}.scale"), F.lit(-4.0)), F.lit(4.0))
    ok = {f: (F.col(f"_w_{f}") > 0) & F.col(f).isNotNull() for f in FEATURES}
    square = {f: F.when(ok[f], F.pow(clip(F.col(f), f) - clip(F.col(f"_t_{f}"), f), 2) * F.col(f"_w_{f}")).otherwise(0.0) for f in FEATURES}
    shaped = F.col("_t_shape").isNotNull() & F.col("shape").isNotNull()
    gap = F.aggregate(F.zip_with("shape", "_t_shape", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda t, x: t + x) / F.size("shape")
    df = df.withColumns({
        "_num": total([square[f] for f in FEATURES]), "_cov": total([F.when(ok[f], F.col(f"_w_{f}")).otherwise(0.0) for f in FEATURES]),
        "_gap": F.when(shaped, gap * shape_weight).otherwise(0.0), "_gc": F.when(shaped, F.lit(shape_weight)).otherwise(0.0),
    })
    least = F.col("_total") * 0.75 + F.when(F.col("_t_shape").isNotNull(), shape_weight * 0.75).otherwise(0.0)
    covered = F.col("_cov") + F.col("_gc")
    return df.where(covered >= least).select(*by, "pos", F.sqrt((F.col("_num") + F.col("_gap")) / F.greatest(covered, F.lit(1e-9))).alias("distance"))


def spaced(ranked: Column, spacing: int, most: int = MAX_MATCHES) -> Column:
    """Greedy choice from an array of (distance, pos), nearest first: skip what lies within
    ``spacing`` of a chosen one, stop at ``most``."""
    empty = F.slice(ranked, 1, 0)
    free = lambda acc, x: ~F.exists(acc, lambda y: F.abs(y["pos"] - x["pos"]) < spacing)
    return F.aggregate(ranked, empty, lambda acc, x: F.when((F.size(acc) < most) & free(acc, x), F.concat(acc, F.array(x))).otherwise(acc))


def non_overlapping(positions: Column, horizon: int) -> Column:
    """Greedy fold over sorted positions: one is taken if it is ``horizon`` after the last."""
    start = F.array().cast("array<int>")
    return F.aggregate(positions, start, lambda acc, p: F.when((F.size(acc) == 0) | (p >= F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + horizon), F.concat(acc, F.array(p))).otherwise(acc))


def kernel_weights(distances: Column) -> Column:
    """Weights exp(-(d - min d) / h) of sorted distances, their sum 1.

    h gives them an effective number of max(3, 0.72 n), or is ten times the spread
    where n is too small for that.  Newton steps on ln h, halving the bracket where a
    step would leave it; the fold stays in the JVM.
    """
    first = F.get(distances, F.lit(0))
    spread = F.transform(distances, lambda d: d - first)
    n, top = F.size(distances), F.ln(F.greatest((F.try_element_at(distances, F.lit(-1)) - first) * 10, F.lit(1.0)))
    want = F.greatest(F.lit(3.0), 0.72 * n)

    def add(acc: Column, w: Column, u: Column) -> Column:
        return F.struct((acc["a"] + w).alias("a"), (acc["b"] + w * w).alias("b"), (acc["p"] + w * u).alias("p"), (acc["q"] + w * w * u).alias("q"))

    def sums(x: Column) -> Column:
        zero = F.struct(*[F.lit(0.0).alias(c) for c in "abpq"])
        scaled = F.transform(spread, lambda d: d * F.exp(-x))
        return F.aggregate(scaled, zero, lambda acc, u: add(acc, F.exp(-u), u))

    def moved(x: Column, low: Column, high: Column, z: Column) -> Column:
        over = 2 * F.ln(z["a"]) - F.ln(z["b"]) - F.ln(want)
        low, high = F.when(over < 0, x).otherwise(low), F.when(over < 0, high).otherwise(x)
        to = x - F.try_divide(over, 2 * z["p"] / z["a"] - 2 * z["q"] / z["b"])
        return F.struct(F.when((to > low) & (to < high), to).otherwise((low + high) / 2).alias("x"), low.alias("low"), high.alias("high"))

    start = F.struct((top / 2).alias("x"), F.lit(math.log(1e-4)).alias("low"), top.alias("high"))
    step = lambda s, _: F.transform(F.array(sums(s["x"])), lambda z: moved(s["x"], s["low"], s["high"], z))[0]
    found = F.aggregate(F.sequence(F.lit(1), F.lit(44)), start, step, lambda s: s["x"])
    h = F.exp(F.when(want >= n, top).otherwise(found))
    raw = F.transform(F.arrays_zip(spread.alias("s"), F.array_repeat(h, n).alias("h")), lambda v: F.exp(-v["s"] / v["h"]))
    total = F.aggregate(raw, F.lit(0.0), lambda acc, w: acc + w)
    return F.transform(F.arrays_zip(raw.alias("w"), F.array_repeat(total, n).alias("t")), lambda v: v["w"] / v["t"])


def matches(features: DataFrame, anchors: DataFrame, profile: str = "balanced", s: Sampling = TRADING) -> DataFrame:
    """One row a chosen episode: symbol, anchor, rank, pos, distance, weight, quality."""
    by = ["symbol", "anchor"]
    ranked = distances(features, anchors, profile, s).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("distance", "pos"))).alias("ranked"))
    chosen = ranked.select(*by, spaced(F.col("ranked"), s.spacing).alias("m"))
    named = chosen.select(*by, "m", F.transform("m", lambda x: x["distance"]).alias("d"))
    weighed = named.select(*by, F.arrays_zip("m", kernel_weights(F.col("d")).alias("w")).alias("z"))
    # an inner explode would have Spark test, and so work out, the weights twice
    rows = weighed.select(*by, F.posexplode_outer("z").alias("rank", "x")).where("rank is not null").select(*by, "rank", "x.m.pos", "x.m.distance", F.col("x.w").alias("weight"))
    return rows.withColumn("quality", F.greatest(F.lit(1), F.least(F.lit(99), F.rint(100 * F.exp(-0.5 * F.col("distance"))).cast("int"))))


def weighted_quantile(rows: DataFrame, by: list[str], value: str, weight: str, q: float, out: str) -> DataFrame:
    """First value, in order, whose cumulative weight reaches q of the total."""
    part = Window.partitionBy(*by)
    cum = F.sum(weight).over(part.orderBy(value, "pos").rowsBetween(Window.unboundedPreceding, 0))
    df = rows.withColumns({"_cum": cum, "_all": F.sum(weight).over(part)})
    return df.groupBy(*by).agg(F.coalesce(F.min(F.when(F.col("_cum") >= F.col("_all") * q, F.col(value))), F.max(value)).alias(out))


def base_rates(outcomes: DataFrame, anchors: DataFrame, horizon: int, s: Sampling = TRADING) -> DataFrame:
    """(symbol, anchor, base): share of risen closes at every ``horizon``-th candidate, smoothed."""
    near = (F.col("pos") >= s.warmup) & (F.col("pos") <= F.col("anchor") - s.exclusion) & ((F.col("pos") - s.warmup) % horizon == 0) & (F.col("pos") + horizon < F.col("anchor"))
    rows = anchors.select("symbol", "anchor").join(outcomes.select("symbol", "pos", F.col(f"fwd_{horizon}").alias("_f")), "symbol").where(near & F.col("_f").isNotNull())
    out = rows.groupBy("symbol", "anchor").agg(((F.count_if(F.col("_f") > 0) + 0.5) / (F.count(F.lit(1)) + 1)).alias("base"))
    return anchors.select("symbol", "anchor").join(out, ["symbol", "anchor"], "left").withColumn("base", F.coalesce("base", F.lit(0.5)))


def with_beta_interval(df: DataFrame, alpha: str, beta: str) -> DataFrame:
    """Add low10 and high90, the posterior interval, in Arrow batches (Spark has no lgamma)."""
    out = T.StructType([*df.schema.fields, T.StructField("low10", T.DoubleType()), T.StructField("high90", T.DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x, y = b[alpha].to_numpy(float), b[beta].to_numpy(float)
            yield b.assign(low10=beta_quantile(0.1, x, y) if len(b) else [], high90=beta_quantile(0.9, x, y) if len(b) else [])

    return df.mapInPandas(run, out)


def summarize(chosen: DataFrame, outcomes: DataFrame, base: DataFrame, horizon: int = 21) -> DataFrame:
    """One forecast a (symbol, anchor) of at least MIN_MATCHES episodes: shrunk probability,
    its interval, effective sample size and weighted quantiles of what followed."""
    by = ["symbol", "anchor"]
    rows = chosen.join(outcomes.select("symbol", "pos", F.col(f"fwd_{horizon}").alias("fwd"), F.year("session_date").alias("year")), ["symbol", "pos"]).where("fwd is not null")
    flat = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("matches"), F.sum("weight").alias("_w"), F.sum(F.col("weight") * F.col("weight")).alias("_w2"), F.sum(F.when(F.col("fwd") > 0, F.col("weight")).otherwise(0.0)).alias("rate"),
        F.count_distinct("year").alias("years"), F.max("fwd").alias("best"), F.min("fwd").alias("worst"),
    ).where(F.col("matches") >= MIN_MATCHES)
    eff = F.greatest(F.lit(1.0), F.least(1 / F.col("_w2"), F.greatest(F.lit(4.0), F.col("years") * 1.5), F.col("matches").cast("double")))
    flat = flat.join(base, by).withColumn("effective_n", eff)
    flat = flat.withColumns({"alpha": F.col("base") * PRIOR + F.col("rate") * F.col("effective_n"), "beta": (1 - F.col("base")) * PRIOR + (1 - F.col("rate")) * F.col("effective_n")})
    for name, q in (("p20", 0.2), ("median", 0.5), ("p80", 0.8)):
        flat = flat.join(weighted_quantile(rows, by, "fwd", "weight", q, name), by)
    out = with_beta_interval(flat.drop("_w", "_w2"), "alpha", "beta")
    return out.withColumns({"probability": F.col("alpha") / (F.col("alpha") + F.col("beta")) * 100, "low10": F.col("low10") * 100, "high90": F.col("high90") * 100, "baseline": F.col("base") * 100})


def direct(forecasts: DataFrame) -> DataFrame:
    """edge, direction (edge of 4 and median of 0.5 in agreement) of summarized forecasts."""
    p, b = (F.least(F.greatest(F.col(c), F.lit(1.0)), F.lit(99.0)) for c in ("probability", "baseline"))
    df = forecasts.withColumn("edge", p - b)
    med = F.round("median", 2)
    return df.withColumn("direction", F.when((F.col("edge") >= 4) & (med > 0.5), "bullish").when((F.col("edge") <= -4) & (med < -0.5), "bearish").otherwise("neutral"))
