"""Column functions and small aggregations of forecasts, audits and boards."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHRINK = 0.132
# Points of an audit grade on the board.
GRADE_POINTS = {"positive": 14.0, "mixed": 9.0, "limited": 5.0, "weak": 2.0}
MIN_MOVE, MIN_PRICE, MIN_SCORE, MIN_REWARD_RISK = 1.5, 5.0, 18.0, 1.0


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high)))


def logit(percent: Column) -> Column:
    r = clamp(percent / 100, 0.01, 0.99)
    return F.ln(r / (1 - r))


def calibrated(raw: Column, base: Column, shrink: float = SHRINK) -> Column:
    """A stated probability pulled toward its base rate on the logit scale; NULL in, NULL out."""
    raw, base = (F.nullif(x.try_cast("double"), F.lit(float("nan"))) for x in (raw, base))
    z = logit(base) + min(1.0, max(0.0, shrink)) * (logit(raw) - logit(base))
    return F.when(raw.isNotNull() & base.isNotNull(), clamp(100 / (1 + F.exp(-z)), 1, 99))


def wilson(p: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Centre and half width of the Wilson interval."""
    d = 1 + z * z / n
    return (p + z * z / (2 * n)) / d, z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d


def direction(edge: Column, median: Column, least_edge: float = 4.0, least_median: float = 0.5) -> Column:
    return F.when((edge >= least_edge) & (median > least_median), "bullish").when((edge <= -least_edge) & (median < -least_median), "bearish").otherwise("neutral")


def evidence_score(effective: Column, edge: Column, years: Column, grade: Column) -> Column:
    factor = F.when(grade == "positive", 1.0).when(grade == "mixed", 0.75).when(grade == "limited", 0.55).when(grade == "weak", 0.4).otherwise(0.5)
    one = F.lit(1.0)
    return clamp(F.round(F.least(one, effective / 18) * 35 + F.least(one, F.abs(edge) / 12) * 35 + F.least(one, years / 8) * 15 + factor * 15), 10, 95)


def banded(x: Column, above: list[tuple[float, str]], below: list[tuple[float, str]], otherwise: str) -> Column:
    """Label by thresholds; NULL stays NULL."""
    out = F.when(x.isNull(), F.lit(None))
    for t, label in above:
        out = out.when(x >= t, label)
    for t, label in below:
        out = out.when(x <= t, label)
    return out.otherwise(otherwise)


def board_score(a: DataFrame, require_reward_risk: bool = False) -> DataFrame:
    """side, expected and adverse move, reward_risk, score, blockers, eligible and tier of analyses;
    a reward under the risk blocks only if ``require_reward_risk``."""
    long_ = F.col("edge") >= 0
    df = a.withColumns({"side": F.when(long_, "long").otherwise("short"), "width": F.col("high") - F.col("low"), "expected_move": F.when(long_, F.col("typical")).otherwise(-F.col("typical")), "adverse_move": F.greatest(F.lit(0.0), F.when(long_, -F.col("low")).otherwise(F.col("high")))})
    floor = F.greatest(F.lit(0.5), 0.25 * F.col("width"))
    grade = reduce(lambda c, g: c.when(F.col("grade") == g, GRADE_POINTS[g]), list(GRADE_POINTS)[1:], F.when(F.col("grade") == "positive", GRADE_POINTS["positive"])).otherwise(0.0)
    points = (
        clamp(F.col("expected_move") / 12 * 30, 0, 30) + clamp(F.abs("edge") / 15 * 22, 0, 22) + clamp(F.col("evidence") / 100 * 16, 0, 16) + clamp(F.col("agreement") / 100 * 10, 0, 10) + grade
        + clamp(F.greatest(F.lit(0.0), F.col("skill")) / 25 * 8, 0, 8) - clamp(F.col("adverse_move") / 15 * 14, 0, 14) - clamp(F.col("width") / 45 * 6, 0, 6) - F.when(F.col("conflict"), 8.0).otherwise(0.0)
    )
    df = df.withColumns({"reward_risk": F.col("expected_move") / F.greatest(F.col("adverse_move"), floor), "score": clamp(points, 0, 100)})
    sc, rr = F.round("score", 9), F.round("reward_risk", 9)  # thresholds don't depend on the last bits
    why = F.array(
        F.when(~F.col("audited"), "no audit"), F.when(F.col("expected_move") < MIN_MOVE, "small move"), F.when((F.col("price") > 0) & (F.col("price") < MIN_PRICE), "low price"), F.when(F.lit(require_reward_risk) & (rr < MIN_REWARD_RISK), "low reward"), F.when(sc < MIN_SCORE, "low score"),
    )
    df = df.withColumn("blockers", F.filter(why, lambda x: x.isNotNull())).withColumn("eligible", F.size("blockers") == 0)
    ok = F.col("eligible") & (rr >= MIN_REWARD_RISK)
    strong = ok & ~F.col("conflict") & (F.col("grade") == "positive") & (F.abs("edge") >= 6) & (F.col("evidence") >= 55) & (F.col("agreement") >= 55) & (sc >= 62)
    moderate = ok & F.col("grade").isin("positive", "mixed") & (F.abs("edge") >= 4) & (sc >= 40)
    return df.withColumn("tier", F.when(strong, "strong").when(moderate, "moderate").otherwise("speculative"))


def audit_anchors(lengths: DataFrame, warmup: int = 260, exclusion: int = 42, spacing: int = 42, horizon: int = 21) -> DataFrame:
    """(symbol, kind, anchor): the tuning and evaluation grid of each series length."""
    first = F.lit(warmup + exclusion + 8 * spacing)
    df = lengths.withColumns({"first": first, "last": F.col("n") - horizon - 1}).where((F.col("last") - horizon - 60 > F.col("first")) & (F.col("last") > F.col("first")))
    df = df.withColumn("split", F.least(F.col("first") + F.greatest(F.lit(5 * spacing), F.round(0.4 * (F.col("last") - F.col("first"))).cast("int")), F.col("last") - horizon - 60))
    back = Window.partitionBy("symbol", "kind").orderBy(F.col("anchor").desc())
    grids = F.array(F.struct(F.lit("tuning").alias("kind"), F.lit(30).alias("most"), F.sequence("first", "split", F.lit(spacing)).alias("a")), F.struct(F.lit("evaluation").alias("kind"), F.lit(260).alias("most"), F.sequence(F.col("split") + horizon, F.col("last"), F.lit(5)).alias("a")))
    rows = df.select("symbol", F.explode(grids).alias("g")).select("symbol", "g.kind", "g.most", F.explode("g.a").alias("anchor"))
    return rows.withColumn("k", F.row_number().over(back)).where("k <= most").select("symbol", "kind", "anchor")


def audit_metrics(p: DataFrame) -> DataFrame:
    """Accuracy, Brier score, skill and grade per symbol of walk-forward predictions."""
    hit = lambda c: (F.avg(((F.col(c) >= 0.5) == (F.col("y") > 0)).cast("double")) * 100)
    act = (F.round(F.abs(F.col("p") - F.col("base")), 9) >= 0.04) & (F.abs("med") >= 0.5)
    out = p.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.count_if(act).alias("actionable"), hit("p").alias("accuracy"), hit("base").alias("base_accuracy"), F.avg(F.pow(F.col("p") - F.col("y"), 2)).alias("brier"), F.avg(F.pow(F.col("base") - F.col("y"), 2)).alias("base_brier"))
    grade = F.when(F.col("n") < 5, "unavailable").when(F.col("n") < 12, "limited").when((F.col("brier") < 0.95 * F.col("base_brier")) & (F.col("accuracy") > F.col("base_accuracy")), "positive").when(F.col("brier") <= 1.05 * F.col("base_brier"), "mixed").otherwise("weak")
    return out.withColumns({"skill": F.try_divide(F.col("base_brier") - F.col("brier"), F.nullif("base_brier", F.lit(0.0))) * 100, "grade": grade})


def conformal(p: DataFrame, level: float = 0.8, least: int = 5) -> DataFrame:
    """Split-conformal widening per symbol from calibration rows, rounded up to 0.01, and coverage on the rest."""
    score = F.greatest(F.col("lo") - F.col("actual"), F.col("actual") - F.col("hi"), F.lit(0.0))
    w = Window.partitionBy("symbol")
    cal = p.where("cal").withColumn("s", score).withColumns({"k": F.row_number().over(w.orderBy("s")), "n": F.count(F.lit(1)).over(w)}).where(F.col("n") >= least)
    rank = F.least(F.col("n"), F.ceil((F.col("n") + 1) * level))
    adj = cal.where(F.col("k") == rank).groupBy("symbol").agg((F.ceil(F.min("s") * 100) / 100).alias("adjustment"))
    inside = lambda a: F.avg(F.col("actual").between(F.col("lo") - a, F.col("hi") + a).cast("double")) * 100
    return p.where("not cal").join(adj, "symbol").groupBy("symbol").agg(F.first("adjustment").alias("adjustment"), inside(F.lit(0.0)).alias("raw_coverage"), inside(F.col("adjustment")).alias("adjusted_coverage"))


def best_profile(brier: DataFrame, names: list[str]) -> DataFrame:
    """Lowest Brier score per symbol; earlier profiles win ties, NULL comes last."""
    name = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("ord") + 1)
    return brier.groupBy("symbol").agg(F.min_by(name, F.struct(F.coalesce("brier", F.lit(float("inf"))), "ord")).alias("profile"))


def long_or_cash(p: DataFrame, bars: DataFrame, horizon: int) -> DataFrame:
    """Totals of holding only after non-overlapping bullish checkpoints, marked daily, and of holding throughout."""
    from hindcast.operators.matching import non_overlapping

    picks = p.where("bullish").groupBy("symbol").agg(F.array_sort(F.collect_list(F.col("pos").cast("int"))).alias("a"))
    picks = picks.select("symbol", F.explode(non_overlapping(F.col("a"), horizon)).alias("checkpoint"))
    days = picks.select("symbol", "checkpoint", F.explode(F.sequence(F.col("checkpoint") + 1, F.col("checkpoint") + horizon)).alias("pos"))
    w = Window.partitionBy("symbol").orderBy("pos")
    span = p.groupBy("symbol").agg((F.min("pos") + 1).alias("from_pos"))
    day = bars.join(span, "symbol").where("pos >= from_pos").select("symbol", "pos", "open", "close").withColumn("prev", F.lag("close").over(w))
    held = day.join(days, ["symbol", "pos"], "left")
    entry = F.col("pos") == F.col("checkpoint") + 1
    factor = F.when(F.col("checkpoint").isNull(), 1.0).when(entry, F.col("close") / F.col("open")).otherwise(F.col("close") / F.coalesce("prev", "open"))
    held = held.withColumns({"f": factor, "h": F.col("close") / F.coalesce("prev", "open")})
    cum = w.rowsBetween(Window.unboundedPreceding, 0)
    curve = held.withColumn("c", F.exp(F.sum(F.ln("f")).over(cum))).withColumn("dd", (F.col("c") / F.greatest(F.max("c").over(cum), F.lit(1.0)) - 1) * 100)
    return curve.groupBy("symbol").agg(F.count_if(entry).alias("trades"), ((F.exp(F.sum(F.ln("f"))) - 1) * 100).alias("strategy_total"), ((F.exp(F.sum(F.ln("h"))) - 1) * 100).alias("hold_total"), (F.avg(F.col("checkpoint").isNotNull().cast("double")) * 100).alias("exposure"), F.min("dd").alias("strategy_drawdown"))
