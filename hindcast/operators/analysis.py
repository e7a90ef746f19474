"""Audited forecasts of many (symbol, as-of session) cells in one plan.

A cell is a symbol and the position of its newest known session.  Its audit is a grid of
earlier anchors: older ones tune the weight profile, newer tuning ones calibrate the
interval, the newest evaluate, and the cell's own position is the forecast.  Episodes of an
anchor don't depend on the cell that asks, so the anchors of all cells are matched once, each
to a row a profile (:mod:`hindcast.operators.episodes`), and cells read them by equi-joins.  The board, the
replay of many dates and a forecast as of one date are the same plan over other cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hindcast.functions import scalars as S
from hindcast.operators import episodes as N
from hindcast.operators import evidence as E
from hindcast.operators import matching as M
from hindcast.operators.episodes import Keep, Prepared

CELL, ANCHOR = ["symbol", "cell"], ["symbol", "anchor", "profile"]
STEP, EVALUATED, TUNED, LEAST_TUNED, LEAST_EVALUATED = 5, 260, 30, 10, 5
EDGE, MOVE = 0.04, 0.5
# Grades and their labels, edge strata in points, buckets of the stated probability.
GRADES = {"positive": "Historically useful", "mixed": "Mixed evidence", "weak": "No proven edge", "limited": "Early evidence"}


def _latest(a: Column, n: Column | int) -> Column:
    size = F.least(F.size(a), F.lit(n) if isinstance(n, int) else n)
    return F.when(size > 0, F.slice(a, F.size(a) - size + 1, size)).otherwise(F.slice(a, 1, 0))


def grid(cells: DataFrame, rules: DataFrame) -> DataFrame:
    """(symbol, cell, kind, anchor) of every cell: tuning, calibration, evaluation and today.

    Under ten tuning anchors neither choose a profile nor calibrate.
    """
    df = cells.select(*CELL).distinct().join(rules, "symbol")
    df = df.withColumns({"first": F.col("warmup") + F.col("exclusion") + M.MIN_MATCHES * F.col("spacing"), "last": F.col("cell") - F.col("horizon")})
    df = df.withColumn("latest", F.col("last") - F.col("horizon") - STEP * 12)
    df = df.withColumn("split", F.least(F.col("first") + F.greatest(F.col("spacing") * 5, F.rint(0.4 * (F.col("last") - F.col("first"))).cast("int")), F.col("latest")))
    sound = F.col("latest") > F.col("first")
    none = F.array().cast("array<int>")
    tuning = F.when(sound, _latest(F.sequence("first", "split", "spacing"), TUNED)).otherwise(none)
    start = F.col("split") + F.col("horizon")
    tested = F.when(sound & (start <= F.col("last")), _latest(F.sequence(start, F.col("last"), F.lit(STEP)), EVALUATED)).otherwise(none)
    df = df.select(*CELL, tuning.alias("t"), tested.alias("evaluation"))
    held = F.greatest(F.lit(5), F.floor(F.size("t") / 3).cast("int"))
    enough = F.size("t") >= LEAST_TUNED
    kinds = {
        "tuning": F.when(enough, F.slice("t", 1, F.size("t") - held)), "calibration": F.when(enough, F.slice("t", F.size("t") - held + 1, held)),
        "evaluation": F.col("evaluation"), "today": F.array(F.col("cell").cast("int")),
    }
    lists = F.array(*[F.struct(F.lit(k).alias("kind"), F.coalesce(a, none).alias("a")) for k, a in kinds.items()])
    return df.select(*CELL, F.explode(lists).alias("g")).select(*CELL, "g.kind", F.explode("g.a").alias("anchor"))


def wanted(anchors: DataFrame) -> DataFrame:
    """The anchors of all cells once; today's are wanted with their episodes."""
    return anchors.groupBy("symbol", "anchor").agg(F.bool_or(F.col("kind") == "today").alias("detail"))


def _shrunk(horizon: str) -> tuple[Column, Column, Column, Column]:
    """Effective sample size, Beta parameters and shrunk probability over a horizon."""
    c = lambda name: F.col(f"{name}_{horizon}")
    ceiling = F.greatest(F.lit(4.0), c("years") * 1.5)
    effective = F.greatest(F.lit(1.0), F.least(F.try_divide(F.lit(1.0), c("squares")), ceiling, c("matches").cast("double")))
    alpha, beta = c("base") * M.PRIOR + c("rate") * effective, (1 - c("base")) * M.PRIOR + (1 - c("rate")) * effective
    return effective, alpha, beta, alpha / (alpha + beta)


def summaries(found: DataFrame, horizon: str, *more: Column) -> DataFrame:
    """Per (symbol, anchor, profile) of at least MIN_MATCHES episodes: shrunk probability, its Beta
    parameters, effective sample size, and weighted quantiles of what followed over a horizon."""
    rest = [c for c in found.columns if c not in {f"{s}_{h}" for s in N.SUMMARY for h in N.HORIZONS}]
    names = [s for s in N.SUMMARY if s != "squares"]
    told = [c.alias(n) for n, c in zip(("effective_n", "alpha", "beta", "p"), _shrunk(horizon))]
    return found.where(F.col(f"matches_{horizon}") >= M.MIN_MATCHES).select(*rest, *[F.col(f"{s}_{horizon}").alias(s) for s in names], *told, *more)


def regime(short: Column, long_: Column, vol_ratio: Column, drawdown: Column) -> tuple[Column, Column, Column, Column]:
    """Trend, volatility and drawdown classes and their joined label; NULL counts as 0."""
    short, long_, vol_ratio, drawdown = (F.coalesce(c, F.lit(0.0)) for c in (short, long_, vol_ratio, drawdown))
    trend = F.when((short > 1) & (long_ > 0), "Uptrend").when((short < -1) & (long_ < 0), "Downtrend").otherwise("Transition")
    volatility = F.when(vol_ratio >= 25, "Expanding").when(vol_ratio <= -20, "Calm").otherwise("Normal")
    fall = F.when(drawdown <= -20, "Deep drawdown").when(drawdown <= -8, "Below highs").otherwise("Near highs")
    return trend, volatility, fall, F.concat_ws(" · ", trend, F.concat(volatility, F.lit(" volatility")), fall)


def predictions(found: DataFrame) -> DataFrame:
    """What the matcher said at each anchor under each profile, and what followed."""
    none = F.lit(None).cast("double")
    trend, *_ = regime(F.col("trend_short"), F.col("trend_long"), none, none)
    df = summaries(found, "h")
    return df.select(*ANCHOR, "p", "base", (F.col("p") - F.col("base")).alias("edge"), F.round("median", 2).alias("med"), F.round("low", 2).alias("lo"), F.round("high", 2).alias("hi"),
                     "actual", (F.col("actual") > 0).alias("up"), "matches", "effective_n", trend.alias("trend"), "entry")


def chosen_profiles(anchors: DataFrame, said: DataFrame) -> DataFrame:
    """(symbol, cell, profile, tuning, brier by profile): the lowest Brier score of the tuning anchors;
    the first profile wins ties and where there is nothing to choose by."""
    rows = anchors.where("kind = 'tuning'").join(said, ["symbol", "anchor"]).groupBy(*CELL, "profile")
    score = rows.agg(F.avg(F.pow(F.col("p") - F.col("up").cast("double"), 2)).alias("brier"))
    best = score.groupBy(*CELL).agg(F.min_by("profile", F.struct(F.round("brier", 12), "profile")).alias("profile"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("profile", "brier")))).alias("profile_brier"))
    grids = anchors.groupBy(*CELL).agg(*[F.count_if(F.col("kind") == k).cast("int").alias(k) for k in ("tuning", "calibration", "evaluation")])
    return grids.join(best, CELL, "left").withColumn("profile", F.coalesce("profile", F.lit(0)))


def _hit(c: str) -> Column:
    return (F.round(F.col(c), 12) >= 0.5) == F.col("up")


def audits(anchors: DataFrame, said: DataFrame, profiles: DataFrame, rules: DataFrame) -> DataFrame:
    """One row a cell: accuracy, Brier scores, grade, interval calibration and its coverage.

    A cell of under five evaluation forecasts has no audit and a NULL grade.
    """
    rows = anchors.join(profiles.select(*CELL, "profile"), CELL).join(said, ["symbol", "anchor", "profile"])
    away = F.greatest(F.col("lo") - F.col("actual"), F.col("actual") - F.col("hi"), F.lit(0.0))
    scores = rows.where("kind = 'calibration'").groupBy(*CELL).agg(F.array_sort(F.collect_list(away)).alias("s"))  # at most ten a cell
    n = F.size("s")
    rank = F.greatest(F.lit(1), F.least(n, F.ceil(F.round((n + 1) * 0.8, 9)).cast("int")))
    widened = scores.where(n >= LEAST_EVALUATED).select(*CELL, (F.ceil(F.round(F.element_at("s", rank) * 100, 9)) / 100).alias("adjustment"))
    tested = rows.where("kind = 'evaluation'").join(widened, CELL, "left").join(rules.select("symbol", "horizon"), "symbol")
    wide = F.coalesce("adjustment", F.lit(0.0))
    acts = (F.round(F.abs("edge"), 12) >= EDGE) & (F.abs("med") >= MOVE)
    mean = lambda c: F.avg(c.cast("double"))
    y = F.col("up").cast("double")
    out = tested.groupBy(*CELL).agg(
        F.count(F.lit(1)).cast("int").alias("n"), mean(_hit("p")).alias("accuracy"), mean(_hit("base")).alias("base_accuracy"), F.avg(F.pow(F.col("p") - y, 2)).alias("brier"), F.avg(F.pow(F.col("base") - y, 2)).alias("base_brier"),
        F.count_if(acts).cast("int").alias("actionable"), F.avg(F.when(acts, _hit("p").cast("double"))).alias("actionable_accuracy"), F.first("adjustment").alias("adjustment"), F.first("horizon").alias("horizon"),
        mean(F.col("actual").between(F.col("lo"), F.col("hi"))).alias("raw_coverage"), mean(F.col("actual").between(F.col("lo") - wide, F.col("hi") + wide)).alias("adjusted_coverage"), F.avg(F.col("hi") - F.col("lo")).alias("width"),
        F.array_sort(F.collect_list(F.struct(F.col("anchor").alias("anchor"), _hit("p").alias("hit")))).alias("rows"),  # at most 260 a cell
    ).where(F.col("n") >= LEAST_EVALUATED)
    apart = M.non_overlapping(F.transform("rows", lambda r: r["anchor"]), F.col("horizon"))
    out = out.withColumn("_a", apart)
    right = F.size(F.filter("rows", lambda r: r["hit"] & F.array_contains("_a", r["anchor"])))
    out = out.withColumns({"independent": F.size("_a"), "_p": right / F.size("_a")})
    mid, half = S.wilson(F.col("_p"), F.col("independent"))
    better = (F.col("brier") < F.col("base_brier") * 0.95) & (F.col("accuracy") > F.col("base_accuracy"))
    grade = F.when(F.col("n") < 12, "limited").when(better, "positive").when(F.col("brier") <= F.col("base_brier") * 1.05, "mixed").otherwise("weak")
    skill = F.when(F.col("base_brier") > 1e-12, (1 - F.col("brier") / F.col("base_brier")) * 100).otherwise(0.0)
    return out.withColumns({"grade": grade, "skill": skill, "accuracy_low": mid - half, "accuracy_high": mid + half}).drop("rows", "_a", "_p", "horizon")


def evaluated(anchors: DataFrame, said: DataFrame, profiles: DataFrame) -> DataFrame:
    """Evaluation forecasts under each cell's own profile, with signal and whether it was right."""
    rows = anchors.where("kind = 'evaluation'").join(profiles.select(*CELL, "profile"), CELL).join(said, ["symbol", "anchor", "profile"])
    edge = F.round("edge", 12)
    signal = F.when((edge >= EDGE) & (F.col("med") > MOVE), "bullish").when((edge <= -EDGE) & (F.col("med") < -MOVE), "bearish").otherwise("neutral")
    rows = rows.withColumn("signal", signal)
    return rows.withColumn("signal_correct", F.when(F.col("signal") == "bullish", F.col("actual") > 0).when(F.col("signal") == "bearish", F.col("actual") < 0))


def strata(records: DataFrame) -> DataFrame:
    """Per cell: evaluation forecasts by size of edge, by trend, and by stated probability."""
    size, p = F.round(F.abs("edge"), 12), F.round("p", 12)
    edge = F.when(size < 0.04, "Under 4 pts").when(size < 0.08, "4-8 pts").otherwise("8+ pts")
    stated = F.when(p < 0.4, "Under 40%").when(p < 0.5, "40-50%").when(p < 0.6, "50-60%").otherwise("60%+")
    kinds = {"edge": edge, "regime": F.col("trend"), "probability": stated}
    rows = records.withColumn("k", F.explode(F.array(*[F.struct(F.lit(k).alias("family"), c.alias("stratum")) for k, c in kinds.items()])))
    y = F.col("up").cast("double")
    return rows.groupBy(*CELL, "k.family", "k.stratum").agg(
        F.count(F.lit(1)).cast("int").alias("n"), F.avg(_hit("p").cast("double")).alias("accuracy"), F.avg(F.pow(F.col("p") - y, 2)).alias("brier"), F.avg(F.abs("edge")).alias("edge"),
        F.avg("p").alias("stated"), F.avg(y).alias("observed"), F.avg("actual").alias("mean_return"),
    )


def strategy(p: Prepared, records: DataFrame) -> DataFrame:
    """Per cell: long after each bullish one of the non-overlapping checkpoints and else in cash,
    marked daily from the open it was entered at, against holding throughout."""
    rows = records.join(p.rules.select("symbol", "horizon"), "symbol")
    lists = rows.groupBy(*CELL, "horizon").agg(F.array_sort(F.collect_list("anchor")).alias("a"))
    picks = lists.select(*CELL, "horizon", F.explode(M.non_overlapping(F.col("a"), F.col("horizon"))).alias("anchor")).join(rows.select(*CELL, "anchor", "signal", "actual", "entry"), [*CELL, "anchor"])
    picks = picks.withColumn("trade", (F.col("signal") == "bullish") & F.col("entry").isNotNull())
    span = picks.groupBy(*CELL).agg(F.count(F.lit(1)).cast("int").alias("periods"), F.count_if("trade").cast("int").alias("trades"), F.avg(F.when(F.col("trade"), (F.col("actual") > 0).cast("double"))).alias("win_rate"), F.min("anchor").alias("start"), F.max(F.col("anchor") + F.col("horizon")).alias("end"))
    held = picks.where("trade").select(*CELL, "anchor", "entry", F.explode(F.sequence(F.col("anchor") + 1, F.col("anchor") + F.col("horizon"))).alias("pos"))
    days = span.select(*CELL, "start", F.explode(F.sequence(F.col("start"), F.col("end"))).alias("pos")).join(p.bars.select("symbol", "pos", "close"), ["symbol", "pos"]).join(held, [*CELL, "pos"], "left")
    w = Window.partitionBy(*CELL).orderBy("pos")
    basis = F.when(F.col("pos") == F.col("anchor") + 1, F.col("entry")).otherwise(F.lag("close").over(w))
    factor = F.when(F.col("anchor").isNotNull() & (F.col("pos") > F.col("start")), F.col("close") / basis).otherwise(1.0)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    first = F.first("close").over(so_far)
    curve = days.withColumn("f", factor).withColumns({"equity": 100 * F.exp(F.sum(F.ln("f")).over(so_far)), "hold": F.col("close") / first * 100})
    low = lambda c: (F.round(c, 2) / F.greatest(F.max(F.round(c, 2)).over(so_far), F.lit(100.0)) - 1) * 100
    curve = curve.withColumns({"d1": low("equity"), "d2": low("hold")})
    ends = curve.groupBy(*CELL).agg(
        F.avg(F.when(F.col("pos") > F.col("start"), F.col("anchor").isNotNull().cast("double"))).alias("exposure"), (F.max_by("equity", "pos") - 100).alias("strategy_return"), (F.max_by("hold", "pos") - 100).alias("hold_return"),
        F.least(F.min("d1"), F.lit(0.0)).alias("max_drawdown"), F.least(F.min("d2"), F.lit(0.0)).alias("hold_max_drawdown"),
    )
    return span.drop("start", "end").join(ends, CELL)


SHORTER = ("5", "10")


def forecasts(p: Prepared, anchors: DataFrame, found: DataFrame, profiles: DataFrame, audited: DataFrame, news: DataFrame | None = None) -> DataFrame:
    """One forecast a cell, under its own profile, with the audit's interval.

    ``news`` (symbol, score, articles) moves the stated probability by at most five points and
    can only take a direction away.
    """
    today = anchors.where("kind = 'today'").select(*CELL, "anchor").join(profiles, CELL)
    mine = found.where("detail").drop("detail", "picks", "gaps", "actual", "entry", "trend_short", "trend_long").join(today.select(*ANCHOR).distinct(), ANCHOR, "left_semi")
    told = M.with_beta_interval(summaries(mine, "h", *[c for h in SHORTER for c in _told_over(h)]), "alpha", "beta")
    df = today.join(told, ANCHOR).join(audited.select(*CELL, "n", "grade", "skill", "adjustment"), CELL, "left").join(p.rules.select("symbol", "horizon", "sampling", "shape_days"), "symbol")
    df = df.join(news.select("symbol", F.col("score").alias("news"), "articles"), "symbol", "left") if news is not None else df.withColumns({"news": F.lit(0.0), "articles": F.lit(0)})
    df = df.na.fill({"news": 0.0, "articles": 0})
    points = lambda c: S.clamp(c * 100, 1, 99)
    df = df.withColumns({"analog": points(F.col("p")), "baseline": points(F.col("base")), "raw": points(F.col("rate"))})
    asked = S.clamp(F.col("news") * F.sqrt(F.least(F.lit(1.0), F.col("articles") / 5)) * 5, -5, 5)
    df = df.withColumn("combined", S.clamp(F.col("analog") + asked, 1, 99)).withColumns({"edge": F.col("analog") - F.col("baseline"), "typical": F.round("median", 2)})
    edge = F.round("edge", 10)
    df = df.withColumn("lean", S.direction(edge, F.col("typical")))
    doubt = ((F.col("lean") == "bullish") & (F.round("combined", 10) < F.round(F.col("baseline") + 2, 10))) | ((F.col("lean") == "bearish") & (F.round("combined", 10) > F.round(F.col("baseline") - 2, 10)))
    wide = F.coalesce("adjustment", F.lit(0.0))
    df = df.withColumns({
        "direction": F.when(doubt, "neutral").otherwise(F.col("lean")), "calibrated": S.calibrated(F.col("combined"), F.col("baseline")), "evidence": S.evidence_score(F.round("effective_n", 1), F.col("edge"), F.col("years"), F.col("grade")),
        "range_low": F.round(F.round("low", 2) - wide, 2), "range_high": F.round(F.round("high", 2) + wide, 2), "probability_low": F.col("low10") * 100, "probability_high": F.col("high90") * 100,
    })
    score, label, reference = E.agreement(F.col("raw"), F.col("typical"), F.col("news"), F.col("articles"), F.col("lean"))
    df = df.withColumns({"agreement": score, "agreement_label": label, "agreement_reference": reference, "headline": E.headline(F.col("direction"), F.col("lean"))})
    df = df.withColumn("explanation", E.explanation(F.col("direction"), F.col("lean"), F.col("edge"), F.col("typical"), F.col("baseline")))
    kept = ["as_of", "price", "sampling", "horizon", "shape_days", "profile", "matches", "effective_n", "years", "wins", "analog", "baseline", "raw", "combined", "calibrated", "edge", "lean", "direction", "typical", "low", "high", "range_low", "range_high",
            "best", "worst", "probability_low", "probability_high", "evidence", "agreement", "agreement_label", "agreement_reference", "headline", "explanation", "grade", "skill", "n", "news", "articles", "profile_brier", "tuning", "calibration", "evaluation"]
    return df.select(*CELL, *kept, *[c for k in SHORTER for c in (f"probability_{k}", f"median_{k}", f"direction_{k}")])


def _told_over(horizon: str) -> list[Column]:
    """What is said over a shorter horizon, NULL of too few episodes."""
    *_, p = _shrunk(horizon)
    enough = F.col(f"matches_{horizon}") >= M.MIN_MATCHES
    chance, base, median = F.rint(p * 100), F.rint(F.col(f"base_{horizon}") * 100), F.round(f"median_{horizon}", 2)
    out = {"probability": p * 100, "median": median, "direction": S.direction(chance - base, median, 4, 0.25)}
    return [F.when(enough, c).alias(f"{name}_{horizon}") for name, c in out.items()]


class Analysis:
    """Every table of an analysis of cells; all read the episodes that were matched once."""

    def __init__(self, p: Prepared, cells: DataFrame, keep: Keep, news: DataFrame | None = None, gaps: bool = True):
        """``gaps``: whether today's episodes carry what made them near, which ``matched`` tells."""
        self.p, self.anchors = p, keep(grid(cells, p.rules), "anchors")
        self.found = keep(N.nearest(p, wanted(self.anchors), gaps=gaps), "found")
        self.profiles = keep(chosen_profiles(self.anchors, self.said), "profiles")
        self.audits = keep(audits(self.anchors, self.said, self.profiles, p.rules), "audits")
        self.news = news

    @property
    def said(self) -> DataFrame:
        return predictions(self.found)

    @property
    def episodes(self) -> DataFrame:
        """The episodes of every anchor; matched anew, as only today's are stored."""
        return N.weighed(N.nearest(self.p, wanted(self.anchors).withColumn("detail", F.lit(True)), gaps=False))

    @property
    def records(self) -> DataFrame:
        return evaluated(self.anchors, self.said, self.profiles)

    @property
    def forecasts(self) -> DataFrame:
        return forecasts(self.p, self.anchors, self.found, self.profiles, self.audits, self.news)

    @property
    def matched(self) -> DataFrame:
        """Each cell's own episodes, with what made them near."""
        today = self.anchors.where("kind = 'today'").select(*CELL, "anchor").join(self.profiles.select(*CELL, "profile"), CELL)
        rows = N.weighed(today.select(*ANCHOR).join(self.found.where("detail"), ANCHOR)).join(self.p.rules.select("symbol", "shape_days", "horizon"), "symbol")
        return rows.withColumns({"cell": F.col("anchor"), "reasons": N.reasons(rows, F.col("shape_days"))}).drop("gaps")

    @property
    def followed(self) -> DataFrame:
        """Each cell's own episodes with the paths that followed them."""
        return N.followed(self.p, self.matched)

    @property
    def board(self) -> DataFrame:
        return board(self.forecasts)


def latest(p: Prepared) -> DataFrame:
    """The cells of all symbols as they stand."""
    return p.rules.select("symbol", (F.col("n") - 1).alias("cell"))


def as_of(p: Prepared, dates: list) -> DataFrame:
    """(symbol, cell, as_of): the last session of each symbol until each date of a short list.

    A session answers for the dates until the symbol's next one, so nothing is joined.
    """
    after = F.lead("session_date").over(Window.partitionBy("symbol").orderBy("session_date"))
    asked = F.array(*[F.lit(d).cast("date") for d in dates])
    rows = p.bars.select("symbol", F.col("pos").alias("cell"), "session_date", after.alias("after"))
    own = F.filter(asked, lambda d: (d >= F.col("session_date")) & (F.col("after").isNull() | (d < F.col("after"))))
    return rows.select("symbol", "cell", F.explode(own).alias("as_of"))


def board(told: DataFrame, require_reward_risk: bool = False) -> DataFrame:
    """Scores, gates, tier and rank per side of forecasts; a neutral lean is not on the board."""
    rows = told.where("lean <> 'neutral'").select(
        *CELL, "as_of", "price", "lean", "direction", "typical", F.col("range_low").alias("low"), F.col("range_high").alias("high"), F.round("edge", 1).alias("edge"), "evidence", "agreement", "grade",
        F.coalesce(F.round("skill", 1), F.lit(-100.0)).alias("skill"), F.col("grade").isNotNull().alias("audited"), (F.col("direction") != F.col("lean")).alias("conflict"), F.coalesce("calibrated", "combined").alias("chance"),
    )
    df = S.board_score(rows, require_reward_risk).withColumn("win_probability", F.when(F.col("side") == "long", F.rint("chance")).otherwise(100 - F.rint("chance")))
    by_side = Window.partitionBy("as_of", "side").orderBy(F.round("score", 1).desc(), "symbol")
    placed = df.where("eligible").withColumn("rank", F.row_number().over(by_side)).select(*CELL, "rank")
    return df.join(placed, CELL, "left").drop("chance")
