"""What a forecast is read with: agreement, waterfall, headline, trade plan, projection
bands and the split of the audit's grid."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hindcast.operators import matching as M

BY = ["symbol", "anchor"]
# Weights and thresholds of the votes, and the headlines.
VOTES = {"paths": (2.0, 4.0), "typical": (1.5, 0.5), "news": (0.5, 0.15)}
HEADLINES = {
    "bullish": "The closest setups lean UP",
    "bearish": "The closest setups lean DOWN",
    "doubt": "History leans, but today adds doubt",
    "none": "No meaningful analog edge right now",
}
STOP_AT, TARGET_AT, LEAST_LEVEL, LEAST_REWARD = 0.25, 0.60, 0.25, 1.1
TRACES = 12


def agreement(raw: Column, typical: Column, news: Column, articles: Column, lean: Column) -> tuple[Column, Column, Column]:
    """score (0 to 100), label and reference of three weighted votes.

    A vote with the reference counts whole, a neutral one half; news without articles
    has no vote.  The reference is the forecast's lean or, of a neutral one, the majority.
    """
    seen = articles > 0
    sign = lambda x, t: F.when(x >= t, 1).when(x <= -t, -1).otherwise(0)
    votes = [(sign(x, VOTES[k][1]), F.when(there, VOTES[k][0]).otherwise(0.0)) for k, x, there in (("paths", raw - 50, F.lit(True)), ("typical", typical, F.lit(True)), ("news", news, seen))]
    majority = F.signum(reduce(lambda a, b: a + b, [v * (w > 0).cast("int") for v, w in votes])).cast("int")
    leaned = F.when(lean == "bullish", 1).when(lean == "bearish", -1).otherwise(majority)
    aligned = reduce(lambda a, b: a + b, [w * F.when(v == leaned, 1.0).when(v == 0, 0.5).otherwise(0.0) for v, w in votes])
    score = F.rint(aligned / reduce(lambda a, b: a + b, [w for _, w in votes]) * 100)
    label = F.when(score >= 75, "Broad agreement").when(score >= 50, "Partial agreement").otherwise("Conflicting evidence")
    return score, label, F.when(leaned > 0, "bullish").when(leaned < 0, "bearish").otherwise("neutral")


def waterfall(df: DataFrame, steps: dict[str, str]) -> DataFrame:
    """One row a step (label -> column): its value and the change from the step before; NULL steps are left out."""
    named = [F.struct(F.lit(label).alias("label"), F.col(c).alias("value")) for label, c in steps.items()]
    kept = F.filter(F.array(*named), lambda s: s["value"].isNotNull())
    other = [c for c in df.columns if c not in steps.values()]
    rows = df.withColumn("_s", kept).select(*other, "_s", F.posexplode("_s").alias("step", "x"))
    before = F.try_element_at("_s", F.when(F.col("step") > 0, F.col("step")).otherwise(F.lit(1)))["value"]
    return rows.select(*other, "step", "x.label", "x.value", (F.col("x.value") - before).alias("delta"))


def headline(direction: Column, lean: Column) -> Column:
    """The verdict's headline: a lean of history that the direction has lost is doubt."""
    return F.when(direction.isin("bullish", "bearish"), F.when(direction == "bullish", HEADLINES["bullish"]).otherwise(HEADLINES["bearish"])).when(lean != "neutral", HEADLINES["doubt"]).otherwise(HEADLINES["none"])


def explanation(direction: Column, lean: Column, edge: Column, typical: Column, baseline: Column) -> Column:
    """The sentence under the verdict's headline; edge in points, typical and baseline in percent."""
    edge, typical = F.round(edge, 1), F.round(typical, 2)
    told = lambda word: F.format_string(f"The analogs show a %+.1f-point edge {word} this asset's normal up-rate. Their typical one-month move was %+.1f%%.", edge, typical)
    doubt = F.lit("The historical analogs had a directional edge, but current headlines weaken it enough that waiting is the honest call.")
    none = F.format_string("The closest setups do not beat this asset's normal %d%% up-rate by enough to justify a directional prediction.", F.rint(baseline).cast("int"))
    return F.when(direction == "bullish", told("over")).when(direction == "bearish", told("versus")).when(lean != "neutral", doubt).otherwise(none)


# Bands of a setup's cards, upper ones first, then lower ones, then what is between.
CARDS = {
    "momentum": ([(8, "Strong advance"), (2, "Rising")], [(-8, "Sharp decline"), (-2, "Falling")], "Sideways"),
    "rsi": ([(70, "Overbought")], [(30, "Oversold")], "Balanced"),
    "volume": ([(40, "Heavy volume")], [(-30, "Quiet volume")], "Normal volume"),
    "market": ([(3, "Market tailwind")], [(-3, "Market headwind")], "Neutral market"),
}


def _band(x: Column, kind: str) -> Column:
    above, below, between = CARDS[kind]
    out = F.when(x.isNull(), F.lit(None))
    for t, label in above:
        out = out.when(x >= t, label)
    for t, label in below:
        out = out.when(x <= t, label)
    if kind == "rsi":
        out = out.when(x >= 55, "Buyers in control").when(x <= 45, "Sellers in control")
    return out.otherwise(between)


def cards(f: dict[str, Column], regime: tuple[Column, Column, Column, Column], usual_vol: Column) -> Column:
    """The cards of a setup (label, value, detail) from its features; a card whose feature is NULL is left out."""
    trend, volatility, fall, _ = regime
    r = {k: F.round(c, 6) for k, c in f.items()}
    usual = F.when(F.coalesce(usual_vol, F.lit(0.0)) != 0, F.format_string(" vs %.1f%% typical", F.round(usual_vol, 6))).otherwise("")
    made = [
        ("Price path", _band(r["r21"], "momentum"), F.format_string("%+.1f%% over 21 trading days", r["r21"]), r["r21"]),
        ("Trend regime", trend, F.format_string("Short %+.1f%% · Long %+.1f%%", r["trend_short"], r["trend_long"]), r["trend_short"] + r["trend_long"]),
        ("Volatility", volatility, F.concat(F.format_string("%.1f%% annualized", r["vol21"]), usual), r["vol21"]),
        ("Drawdown", fall, F.format_string("%.1f%% from the one-year high", r["drawdown"]), r["drawdown"]),
        ("RSI pressure", _band(r["rsi"], "rsi"), F.format_string("RSI %.0f", F.rint(r["rsi"])), r["rsi"]),
        ("Participation", _band(r["volume_ratio"], "volume"), F.format_string("%+.0f%% vs 20-day volume", F.rint(r["volume_ratio"])), r["volume_ratio"]),
        ("Broad market", _band(r["market_trend"], "market"), F.format_string("Market %+.1f%% vs its 200-day trend", r["market_trend"]), r["market_trend"]),
    ]
    each = [F.when(seen.isNotNull(), F.struct(F.lit(label).alias("label"), value.alias("value"), detail.alias("detail"))) for label, value, detail, seen in made]
    return F.filter(F.array(*each), lambda c: c.isNotNull())


def setup(regime: tuple[Column, Column, Column, Column], momentum: Column, drawdown: Column) -> Column:
    """One sentence on where a series stands; NULL without momentum or drawdown."""
    trend, volatility, _, _ = regime
    text = F.format_string("Today is a %s with %s volatility, %+.1f%% one-month momentum, and price %.1f%% below its one-year high.", F.lower(trend), F.lower(volatility), F.round(momentum, 6), F.abs(F.round(drawdown, 6)))
    return F.when(momentum.isNotNull() & drawdown.isNotNull(), text)


def episodes(chosen: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Chosen episodes with the paths that followed them (``outcomes`` made with paths)."""
    return chosen.join(outcomes.select("symbol", "pos", "path", "low_path", "high_path", "max_upside", "max_drawdown"), ["symbol", "pos"]).where("path is not null")


def trade_plan(rows: DataFrame, forecasts: DataFrame) -> DataFrame:
    """action, stop and target percent, hit rate, expectancy and risk_reward of each forecast.

    ``forecasts`` holds symbol, anchor, price and direction.  The stop is the lower
    quartile of what the episodes lost on the way, the target the 60 % quantile of what
    they gained; a bar that touches both counts as stopped.  Only a bullish forecast with
    usable levels, a reward of 1.1 times the risk and a positive expectancy is a plan;
    otherwise levels are NULL.
    """
    levels = M.weighted_quantile(rows, BY, "max_drawdown", "weight", STOP_AT, "stop_pct").join(M.weighted_quantile(rows, BY, "max_upside", "weight", TARGET_AT, "target_pct"), BY)
    at = lambda hit, c: F.array_position(F.transform(c, hit), True)  # 0: never
    met = rows.join(levels, BY).withColumns({"_s": at(lambda x: x <= F.col("stop_pct"), "low_path"), "_t": at(lambda x: x >= F.col("target_pct"), "high_path")})
    won = (F.col("_t") > 0) & ((F.col("_s") == 0) | (F.col("_t") < F.col("_s")))
    made = F.when(won, F.col("target_pct")).when(F.col("_s") > 0, F.col("stop_pct")).otherwise(F.element_at("path", -1))
    sums = met.groupBy(*BY, "stop_pct", "target_pct").agg(F.sum(F.when(won, F.col("weight")).otherwise(0.0)).alias("hit_rate"), F.sum(F.col("weight") * made).alias("expectancy"))
    df = forecasts.join(sums.withColumn("risk_reward", F.try_divide("target_pct", F.abs("stop_pct"))), BY, "left")
    sound = (F.col("stop_pct") < -LEAST_LEVEL) & (F.col("target_pct") > LEAST_LEVEL)
    good = (F.col("direction") == "bullish") & sound & (F.col("risk_reward") >= LEAST_REWARD) & (F.col("expectancy") > 0)
    action = F.when(F.coalesce(good, F.lit(False)), "consider_buying").when(F.col("direction") == "bearish", "avoid_or_exit").otherwise("wait")
    df = df.withColumn("action", action)
    planned = lambda c: F.when(F.col("action") == "consider_buying", c)
    out = {"stop": F.col("price") * (1 + F.col("stop_pct") / 100), "target": F.col("price") * (1 + F.col("target_pct") / 100), **{c: F.col(c) for c in ("stop_pct", "target_pct", "risk_reward", "hit_rate", "expectancy")}}
    return df.select(*BY, "action", F.col("price").alias("entry"), *[planned(c).alias(n) for n, c in out.items()])


def projection(rows: DataFrame, widening: DataFrame | None = None, horizon: int = 21, by_anchor: bool = False, horizons: DataFrame | None = None) -> DataFrame:
    """(symbol, anchor, day, low, median, high): weighted 20, 50 and 80 % of the paths day by
    day, the band widened by the conformal ``adjustment`` of a symbol (or, ``by_anchor``, of each
    forecast) times sqrt(day / horizon); ``horizons`` has a symbol's own."""
    days = rows.select(*BY, "pos", "weight", F.posexplode("path").alias("day", "value"))
    by = [*BY, "day"]
    bands = reduce(lambda a, b: a.join(b, by), [M.weighted_quantile(days, by, "value", "weight", q, n) for n, q in (("low", 0.2), ("median", 0.5), ("high", 0.8))])
    key = BY if by_anchor else ["symbol"]
    bands = bands.join(widening.select(*key, "adjustment"), key, "left") if widening is not None else bands.withColumn("adjustment", F.lit(0.0))
    bands = bands.join(horizons.select("symbol", "horizon"), "symbol") if horizons is not None else bands.withColumn("horizon", F.lit(horizon))
    wide = F.coalesce("adjustment", F.lit(0.0)) * F.sqrt(F.col("day") / F.col("horizon"))
    return bands.select(*by, (F.col("low") - wide).alias("low"), "median", (F.col("high") + wide).alias("high"))


def tuning_split(anchors: DataFrame) -> DataFrame:
    """(symbol, anchor, kind) of the audit grid: the latest third of the tuning anchors (five at
    least) calibrates the interval; of under ten all do, and no profile is chosen."""
    n = anchors.where("kind = 'tuning'").groupBy("symbol").agg(F.count(F.lit(1)).alias("_n"))
    numbered = anchors.join(n, "symbol").withColumn("_k", F.row_number().over(Window.partitionBy("symbol", "kind").orderBy(F.col("anchor").desc())))
    calibrates = (F.col("_n") < 10) | (F.col("_k") <= F.greatest(F.lit(5), F.floor(F.col("_n") / 3)))
    kind = F.when(F.col("kind") == "evaluation", "evaluation").when(calibrates, "calibration").otherwise("tuning")
    return numbered.select("symbol", "anchor", kind.alias("kind"))
