"""The forecast ledger: recording, grading, marking to market, scoring."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["symbol", "as_of_date", "horizon_days"]
# Left-closed probability buckets, and the moves that break a series.
BUCKETS = [(0, 45), (45, 50), (50, 55), (55, 60), (60, 65), (65, 70), (70, 100)]
MAX_GAIN, MAX_LOSS = 300.0, -75.0
MIN_SAMPLE = 30


def signed(side: Column, value: Column) -> Column:
    """Direction-adjusted return: as it is for long, negated for short, else NULL."""
    return F.when(side == "long", value).when(side == "short", -value)


def published(eligible: Column) -> Column:
    """Every record that was not refused; unknown eligibility counts as published."""
    return ~eligible.eqNullSafe(F.lit(False))


def decision_hit(p: Column, base: Column, realized: Column) -> Column:
    """1 if the call against its own base rate came true, NULL on a tie or a gap."""
    return F.when(p.isNull() | base.isNull() | realized.isNull() | (p == base), F.lit(None)).otherwise(((p > base) == (realized > 0)).cast("double"))


def append_absent(ledger: DataFrame, new: DataFrame, key: list[str] = KEY) -> DataFrame:
    """Rows of ``new`` whose key the ledger lacks: what an append-once sink writes."""
    return new.join(ledger.select(*key), key, "left_anti")


def claim(ledger: DataFrame, new: DataFrame, key: list[str] = KEY) -> DataFrame:
    """The ledger after attributed rows replaced pending rows of no run, and new keys
    were added; graded rows and rows of a run never change."""
    columns = ledger.columns
    old = ledger.select(*key, F.struct(*columns).alias("_old"))
    fresh = new.select(*key, F.struct(*columns).alias("_new"))
    open_ = (F.col("_old.status") == "pending") & F.col("_old.scan_run_id").isNull() & F.col("_new.scan_run_id").isNotNull()
    pick = F.when(F.col("_old").isNull(), F.col("_new")).when(F.col("_new").isNotNull() & open_, F.col("_new")).otherwise(F.col("_old"))
    return old.join(fresh, key, "full_outer").select(pick.alias("r")).select("r.*")


def grade(ledger: DataFrame, bars: DataFrame) -> DataFrame:
    """Pending forecasts with entry at the next open and outcome at the close of session
    +horizon; rows whose outcome session is not there stay pending."""
    b = bars.select("symbol", "pos", "session_date", "open", "close")
    signal = b.select("symbol", F.col("session_date").alias("as_of_date"), F.col("pos").alias("_signal"))
    entry = b.select("symbol", F.col("pos").alias("_e"), F.col("session_date").alias("entry_date"), F.col("open").alias("entry_price"))
    outcome = b.select("symbol", F.col("pos").alias("_o"), F.col("session_date").alias("outcome_date"), F.col("close").alias("outcome_price"))
    df = ledger.join(signal, ["symbol", "as_of_date"], "left").withColumns({"_e": F.col("_signal") + 1, "_o": F.col("_signal") + F.col("horizon_days")})
    df = df.join(entry, ["symbol", "_e"], "left").join(outcome, ["symbol", "_o"], "left")
    realized = F.when(F.col("entry_price") > 0, (F.col("outcome_price") / F.col("entry_price") - 1) * 100)
    done = F.col("outcome_price").isNotNull()
    return df.withColumns({"realized_return": realized, "status": F.when(done, "graded").otherwise("pending")}).drop("_e", "_o", "_signal")


def mark(ledger: DataFrame, bars: DataFrame, evaluation: str) -> DataFrame:
    """Each forecast's state on an evaluation session.

    Settled rows are read back from the ledger.  Others enter at the next open and are
    marked at the close of the outcome session or of the last one there is, whichever
    comes first; series with an impossible move in between are set apart.
    """
    at = F.lit(evaluation).cast("date")
    w = Window.partitionBy("symbol").orderBy("pos")
    prev = F.lag("close").over(w)
    move = F.when((prev > 0) & F.col("close").isNotNull(), (F.col("close") / prev - 1) * 100)
    broken = F.when((move > MAX_GAIN) | (move < MAX_LOSS), 1).otherwise(0)
    b = bars.withColumn("_broken", broken).withColumn("breaks", F.sum("_broken").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    last = bars.where(F.col("session_date") <= at).groupBy("symbol").agg(F.max("pos").alias("_last"))
    side = b.select("symbol", "pos", "session_date", "open", "close", "breaks")
    settled = ledger.where((F.col("status") == "graded") & F.col("realized_return").isNotNull())
    open_ = ledger.where(~((F.col("status") == "graded") & F.col("realized_return").isNotNull()) | F.col("status").isNull())
    df = open_.drop("entry_date", "entry_price", "outcome_date", "outcome_price", "realized_return")
    df = df.join(side.select("symbol", F.col("session_date").alias("as_of_date"), F.col("pos").alias("_signal")), ["symbol", "as_of_date"], "left").join(last, "symbol", "left")
    df = df.withColumns({"_e": F.col("_signal") + 1, "_m": F.least(F.col("_last"), F.col("_signal") + F.col("horizon_days"))})
    df = df.join(side.select("symbol", F.col("pos").alias("_e"), F.col("session_date").alias("entry_date"), F.col("open").alias("entry_price"), F.col("breaks").alias("_be")), ["symbol", "_e"], "left")
    df = df.join(side.select("symbol", F.col("pos").alias("_m"), F.col("session_date").alias("mark_date"), F.col("close").alias("mark_price"), F.col("breaks").alias("_bm")), ["symbol", "_m"], "left")
    state = (
        F.when(F.col("_signal").isNull() | F.col("_last").isNull(), "unpriced")
        .when(F.col("entry_date").isNull() | (F.col("_m") < F.col("_e")), "awaiting_entry")
        .when(F.col("entry_price").isNull() | (F.col("entry_price") <= 0) | F.col("mark_price").isNull(), "unpriced")
        .when(F.col("_bm") > F.col("_be"), "suspect")
        .when(F.col("_m") >= F.col("_signal") + F.col("horizon_days"), "matured")
        .otherwise("open")
    )
    df = df.withColumn("state", state)
    priced = F.col("state").isin("open", "matured", "suspect")
    ret = F.when(priced, (F.col("mark_price") / F.col("entry_price") - 1) * 100)
    keep = ["symbol", "as_of_date", "horizon_days", "side", "tier", "id"]
    live = df.select(
        *keep, "state", F.when(priced, F.col("entry_date")).alias("entry_date"), F.when(priced, F.col("mark_date")).alias("mark_date"),
        F.when(priced, F.col("_m") - F.col("_signal")).otherwise(0).cast("long").alias("sessions_elapsed"), ret.alias("price_return"),
        F.when(F.col("state") != "suspect", signed(F.col("side"), ret)).alias("signed_return"),
    )
    done = settled.select(
        *keep, F.lit("matured").alias("state"), "entry_date", F.col("outcome_date").alias("mark_date"), F.col("horizon_days").cast("long").alias("sessions_elapsed"),
        F.col("realized_return").alias("price_return"), signed(F.col("side"), F.col("realized_return")).alias("signed_return"),
    )
    return live.unionByName(done)


def latest_session(bars: DataFrame, share: float = 0.2) -> DataFrame:
    """The newest date on which at least a fifth of the symbols traded."""
    total = bars.agg(F.greatest(F.lit(1), F.floor(F.count_distinct("symbol") * share)).alias("least"))
    dates = bars.groupBy("session_date").agg(F.count_distinct("symbol").alias("n"))
    return dates.join(F.broadcast(total), F.col("n") >= F.col("least")).agg(F.max("session_date").alias("session_date"))


def benchmark_windows(marked: DataFrame, bars: DataFrame) -> DataFrame:
    """(entry_date, mark_date, benchmark, constituents): the equal-weight return of all
    symbols over each distinct window."""
    windows = marked.where("entry_date is not null and mark_date is not null").select("entry_date", "mark_date").distinct()
    e = bars.select("symbol", F.col("session_date").alias("entry_date"), F.col("open").alias("_o"))
    m = bars.select("symbol", F.col("session_date").alias("mark_date"), F.col("close").alias("_c"))
    both = windows.join(e, "entry_date").join(m, ["symbol", "mark_date"]).where("_o > 0")
    return both.groupBy("entry_date", "mark_date").agg(F.avg((F.col("_c") / F.col("_o") - 1) * 100).alias("benchmark"), F.count(F.lit(1)).alias("constituents"))


def headline(scored: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Sample statistics of signed_return and, on paired rows, of its benchmark (signed)."""
    paired = F.col("signed_return").isNotNull() & F.col("benchmark").isNotNull()
    b = signed(F.col("side"), F.col("benchmark"))
    return scored.where("signed_return is not null").groupBy(*(by or [])).agg(
        F.count("signed_return").alias("sample_size"), F.avg("signed_return").alias("average_return"), F.median("signed_return").alias("median_return"),
        F.coalesce(F.stddev_samp("signed_return"), F.lit(0.0)).alias("standard_deviation"), (F.avg((F.col("signed_return") > 0).cast("double")) * 100).alias("positive_share"),
        F.max("signed_return").alias("best_return"), F.min("signed_return").alias("worst_return"), F.count(F.when(paired, 1)).alias("benchmark_sample_size"),
        F.avg(F.when(paired, b)).alias("average_benchmark_return"), F.avg(F.when(paired, F.col("signed_return") - b)).alias("average_excess_return"),
    )


def live_counts(marked: DataFrame) -> DataFrame:
    """Rows by state, in one pass."""
    states = ("open", "matured", "awaiting_entry", "unpriced", "suspect")
    return marked.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("state") == s).alias(s) for s in states], F.count_if(F.col("signed_return").isNotNull()).alias("scored"))


def progress(marked: DataFrame) -> DataFrame:
    live = marked.where("state in ('open', 'matured')")
    out = live.agg(F.coalesce(F.max("sessions_elapsed"), F.lit(0)).alias("sessions_elapsed"), F.max("horizon_days").cast("long").alias("sessions_total"))
    return out.withColumn("percent_complete", F.coalesce(F.least(F.lit(100.0), F.try_divide(F.col("sessions_elapsed"), F.col("sessions_total")) * 100), F.lit(0.0)))


def leaderboards(marked: DataFrame, limit: int = 50) -> DataFrame:
    """Best and worst rows of each side, never padded with the wrong sign."""
    r = F.col("signed_return")
    board = F.concat_ws("_", "side", F.when(r > 0, "winners").otherwise("losers"))
    rows = marked.where("state in ('open', 'matured') and side is not null and signed_return <> 0").withColumn("board", board)
    best = F.row_number().over(Window.partitionBy("board").orderBy(F.abs(r).desc(), "symbol", "as_of_date"))
    # the rank stands alone, so that each task keeps its own first ``limit``; totals are counted apart
    totals = rows.groupBy("board").agg(F.count(F.lit(1)).alias("total"))
    return rows.withColumn("rank", best).where(F.col("rank") <= limit).join(F.broadcast(totals), "board")


def accounting(ledger: DataFrame, as_of: str) -> DataFrame:
    """Counts of the scorecard: pending, matured, expired ungraded and so on."""
    matured = (F.col("status") == "graded") & F.col("realized_return").isNotNull()
    expired = (F.col("status") == "pending") & (F.col("horizon_date") < F.lit(as_of).cast("date"))
    return ledger.agg(
        F.count(F.lit(1)).alias("total"), F.count_if((F.col("status") == "pending") & ~F.coalesce(expired, F.lit(False))).alias("pending"), F.count_if(matured).alias("matured"),
        F.count_if(expired).alias("expired_ungraded"), F.count_if(matured & published(F.col("eligible")) & F.col("side").isNotNull()).alias("scored_matured"),
        F.count_if(matured & (F.col("eligible") == False)).alias("board_rejected"), F.count_if(matured & F.col("eligible").isNull()).alias("eligibility_unrecorded"),  # noqa: E712
    )


def scored(ledger: DataFrame) -> DataFrame:
    """Matured, published, long or short rows with signed_return and hit."""
    rows = ledger.where((F.col("status") == "graded") & F.col("realized_return").isNotNull() & published(F.col("eligible")))
    rows = rows.withColumn("signed_return", signed(F.col("side"), F.col("realized_return"))).where("signed_return is not null")
    return rows.withColumn("hit", decision_hit(F.col("probability_up"), F.col("baseline_up_rate"), F.col("realized_return")))


METRICS = ("mean_signal_return", "median_signal_return", "standard_deviation", "hit_rate", "mean_benchmark_return", "mean_excess_return")


def breakdowns(rows: DataFrame, least: int = MIN_SAMPLE) -> DataFrame:
    """The scorecard's metrics by side, tier, horizon, cohort month and model version, and in
    all, by grouping sets in one pass; families below ``least`` rows give NULL metrics."""
    df = rows.select(
        "signed_return", "hit", "benchmark", signed(F.col("side"), F.col("benchmark")).alias("b"), F.coalesce("side", F.lit("unclassified")).alias("side"), "tier",
        F.concat(F.col("horizon_days").cast("string"), F.lit(" sessions")).alias("horizon"), F.date_format("as_of_date", "yyyy-MM").alias("cohort"),
        F.coalesce("model_version", F.lit("pre-provenance")).alias("model_version"),
    )
    keys = ["side", "tier", "horizon", "cohort", "model_version"]
    sets = [[F.col(k)] for k in keys] + [[]]
    out = df.groupingSets(sets, *[F.col(k) for k in keys]).agg(
        F.grouping_id().alias("_g"), F.count(F.lit(1)).alias("sample_size"), F.avg("signed_return").alias("mean_signal_return"), F.median("signed_return").alias("median_signal_return"),
        F.coalesce(F.stddev_samp("signed_return"), F.lit(0.0)).alias("standard_deviation"), (F.avg("hit") * 100).alias("hit_rate"), F.count("b").alias("benchmark_sample_size"),
        F.avg("b").alias("mean_benchmark_return"), F.avg(F.col("signed_return") - F.col("b")).alias("mean_excess_return"),
    )
    family = reduce(lambda c, i: c.when(F.col("_g") == 31 - (16 >> i), keys[i]), range(5), F.when(F.col("_g") == 31, "all"))
    return out.select(
        family.alias("family"), F.coalesce(*keys, F.lit("all")).alias("label"), "sample_size", "benchmark_sample_size",
        *[F.when(F.col("sample_size") >= least, F.col(m)).alias(m) for m in METRICS],
    )


def calibration(ledger: DataFrame) -> DataFrame:
    """Brier scores raw, published and of the base rate over all matured rows."""
    rows = ledger.where("status = 'graded' and realized_return is not null and probability_up is not null")
    y = (F.col("realized_return") > 0).cast("double")
    brier = lambda p: F.avg(F.pow(p / 100 - y, 2))
    shown = F.coalesce("calibrated_probability_up", "probability_up")
    out = rows.agg(F.count(F.lit(1)).alias("sample"), F.count("calibrated_probability_up").alias("calibrated_sample"), F.avg(y).alias("base"), brier(F.col("probability_up")).alias("brier_raw"), brier(shown).alias("brier_published"))
    out = out.withColumn("brier_base_rate", F.col("base") * (1 - F.col("base")))
    skill = lambda c: F.try_divide(F.col("brier_base_rate") - F.col(c), F.nullif("brier_base_rate", F.lit(0.0))) * 100
    return out.select("sample", "calibrated_sample", (F.col("base") * 100).alias("realized_up_rate"), "brier_raw", "brier_published", "brier_base_rate", skill("brier_raw").alias("skill_raw_points"), skill("brier_published").alias("skill_published_points"))


def calibration_buckets(ledger: DataFrame) -> DataFrame:
    """Predicted against realized up rate by left-closed probability bucket."""
    shown = F.coalesce("calibrated_probability_up", "probability_up")
    rows = ledger.where("status = 'graded' and realized_return is not null and probability_up is not null").withColumn("p", shown)
    label = reduce(lambda c, b: c.when((F.col("p") >= b[0]) & (F.col("p") < b[1]), f"{b[0]}-{b[1]}"), BUCKETS[1:], F.when((F.col("p") >= BUCKETS[0][0]) & (F.col("p") < BUCKETS[0][1]), f"{BUCKETS[0][0]}-{BUCKETS[0][1]}"))
    out = rows.withColumn("bucket", label).where("bucket is not null").groupBy("bucket").agg(F.count(F.lit(1)).alias("count"), F.avg("p").alias("predicted_up"), (F.avg((F.col("realized_return") > 0).cast("double")) * 100).alias("realized_up"))
    return out.withColumn("gap_points", F.col("realized_up") - F.col("predicted_up"))


def point_in_time(ledger: DataFrame, cutoff: str) -> DataFrame:
    """The ledger as it was known at a cutoff: later rows gone, later outcomes unknown."""
    at = F.lit(cutoff).cast("date")
    unknown = F.col("outcome_date").isNull() | (F.col("outcome_date") > at)
    rows = ledger.where(F.to_date("created_at") <= at)
    hide = {c: F.when(~unknown, F.col(c)) for c in ("realized_return", "outcome_date", "entry_date")}
    return rows.withColumn("_unknown", unknown).withColumns({"status": F.when(unknown, "pending").otherwise(F.col("status")), **hide}).drop("_unknown")


def track_record(ledger: DataFrame) -> DataFrame:
    """Per symbol: totals, probability accuracy against the base rate, directional accuracy, Brier score."""
    done = (F.col("status") == "graded") & F.col("realized_return").isNotNull()
    up = (F.col("realized_return") > 0).cast("double")
    s = signed(F.col("side"), F.col("realized_return"))
    return ledger.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(done).alias("graded"), (F.avg(F.when(done, decision_hit(F.col("probability_up"), F.col("baseline_up_rate"), F.col("realized_return")))) * 100).alias("probability_accuracy"),
        (F.avg(F.when(done & s.isNotNull(), (s > 0).cast("double"))) * 100).alias("directional_accuracy"), F.avg(F.when(done, F.pow(F.col("probability_up") / 100 - up, 2))).alias("brier_score"),
    )


def universe_return(members: DataFrame, bars: DataFrame, windows: DataFrame) -> DataFrame:
    """Equal-weight return and coverage of a universe over (entry_date, outcome_date) windows."""
    e = bars.select("symbol", F.col("session_date").alias("entry_date"), F.col("open").alias("_o"))
    o = bars.select("symbol", F.col("session_date").alias("outcome_date"), F.col("close").alias("_c"))
    total = members.groupBy("universe_id").agg(F.count_distinct("symbol").alias("universe_count"))
    rows = members.select("universe_id", "symbol").distinct().join(e, "symbol").join(windows, "entry_date").join(o, ["symbol", "outcome_date"]).where("_o > 0")
    out = rows.groupBy("universe_id", "entry_date", "outcome_date").agg(F.avg((F.col("_c") / F.col("_o") - 1) * 100).alias("return"), F.count(F.lit(1)).alias("constituent_count"))
    return out.join(total, "universe_id")


def bootstrap(rows: DataFrame, cluster: str, value: str, draws: int = 2_000, seed: str = "b", level: float = 0.95) -> DataFrame:
    """Cluster bootstrap interval of a mean; clusters are drawn by hash, so any engine
    draws the same.  Clusters are reduced to (sum, n) before anything is drawn."""
    sums = rows.groupBy(F.col(cluster).alias("c")).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    # one row a cluster from here on: dates, not records
    numbered = sums.withColumns({"i": F.row_number().over(Window.orderBy("c")) - 1, "k": F.count(F.lit(1)).over(Window.partitionBy())})
    drawn = numbered.select(F.col("i").alias("slot"), "k", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    pick = F.conv(F.substring(F.md5(F.concat_ws("-", F.lit(seed), F.col("draw").cast("string"), F.col("slot").cast("string"))), 1, 8), 16, 10).cast("long") % F.col("k")
    means = drawn.withColumn("i", pick).join(numbered.drop("k"), "i").groupBy("draw").agg((F.sum("s") / F.sum("n")).alias("m"))
    tail = (1 - level) / 2
    return means.agg(F.percentile("m", F.lit(tail)).alias("low"), F.percentile("m", F.lit(1 - tail)).alias("high"), F.avg((F.col("m") <= 0).cast("double")).alias("p_not_positive"))
