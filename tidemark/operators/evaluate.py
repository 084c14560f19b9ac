"""Outcomes of frozen selections: execution, cohorts, summaries, curves.

Cohort tables hold a handful of rows per session, so windows over sessions here
are bounded by the calendar.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import positive
from tidemark.operators.ranks import medians, tail_mean

ROUND_TRIP_COST, STRESS_COST = 0.002, 0.005
INITIAL_CAPITAL = 10000.0


def execute(signals: DataFrame, calendar: DataFrame, closes: DataFrame, horizon: str = "horizon", delay: int = 1) -> DataFrame:
    """Entry ``delay`` sessions after the signal, exit ``horizon`` sessions later, at exact closes.

    A missing close stays missing.  ``closes``: entity, session_no, close.
    """
    last = calendar.agg(F.max("session_no")).scalar()
    px = closes.select("entity_id", F.col("session_no").alias("_no"), positive("close").alias("_px"))
    s = signals.withColumn("entry_no", F.col("session_no") + delay).withColumn("exit_no", F.col("session_no") + delay + F.col(horizon))
    for side in ("entry", "exit"):
        p = px.withColumnRenamed("_px", f"{side}_price").withColumnRenamed("_no", f"{side}_no")
        s = s.join(p, ["entity_id", f"{side}_no"], "left")
    status = (
        F.when(F.col("exit_no") > last, "pending").when(F.col("entry_price").isNull() | F.col("exit_price").isNull(), "missing").otherwise("complete")
    )
    return s.withColumn("status", status).withColumn("gross_return", F.col("exit_price") / F.col("entry_price") - 1)


def mature(executed: DataFrame, benchmark_closes: DataFrame, cost: float = ROUND_TRIP_COST) -> DataFrame:
    """Net return, benchmark return over the same sessions, excess and direction."""
    b = benchmark_closes.select(F.col("session_no").alias("_no"), F.col("close").alias("_px"))
    df = executed
    for side in ("entry", "exit"):
        p = b.withColumnRenamed("_px", f"_b_{side}").withColumnRenamed("_no", f"{side}_no")
        # One benchmark row per session.
        df = df.join(F.broadcast(p), f"{side}_no", "left")
    net = F.col("gross_return") - cost
    return (
        df.withColumn("actual_return", net)
        .withColumn("benchmark_return", F.col("_b_exit") / F.col("_b_entry") - 1)
        .withColumn("excess_return", net - F.col("benchmark_return"))
        .withColumn("correct_direction", net > 0)
        .drop("_b_entry", "_b_exit")
    )


def timelines(signals: DataFrame, calendar: DataFrame, closes: DataFrame, horizons: tuple[int, ...] = (5, 10, 20)) -> DataFrame:
    """Price some exact sessions after each signal: complete, missing or pending."""
    last = calendar.agg(F.max("session_no")).scalar()
    px = closes.select("entity_id", F.col("session_no").alias("target_no"), positive("close").alias("price"))
    long = signals.withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in horizons]))).withColumn("target_no", F.col("session_no") + F.col("horizon"))
    out = long.join(px, ["entity_id", "target_no"], "left")
    status = F.when(F.col("price").isNotNull(), "complete").when(F.col("target_no") <= last, "missing").otherwise("pending")
    return out.withColumn("status", status).drop("target_no")


def cohort_outcomes(cohorts: DataFrame, matured: DataFrame, benchmark_by_horizon: DataFrame) -> DataFrame:
    """Equal-weight outcome of each complete cohort; a cohort without picks is cash against the benchmark.

    A cohort counts only if every expected pick has an outcome.
    ``benchmark_by_horizon``: session_no, horizon, benchmark_return.
    """
    key = ["model_version", "session_no", "horizon"]
    agg = matured.groupBy(*key).agg(
        F.count("*").alias("picks"), F.count("excess_return").alias("known"), F.avg("actual_return").alias("ret"), F.avg("excess_return").alias("excess")
    )
    df = cohorts.join(agg, key, "left").join(F.broadcast(benchmark_by_horizon), ["session_no", "horizon"], "left")
    cash = F.col("expected_picks") == 0
    whole = (F.col("picks") == F.col("expected_picks")) & (F.col("known") == F.col("expected_picks"))
    ok = F.when(cash, F.col("benchmark_return").isNotNull()).otherwise(F.coalesce(whole, F.lit(False)))
    return df.where(ok).select(
        *key, "expected_picks", cash.alias("cash"), F.when(cash, 0.0).otherwise(F.col("ret")).alias("cohort_return"),
        F.when(cash, -F.col("benchmark_return")).otherwise(F.col("excess")).alias("cohort_excess"),
    )


def scorecard(evaluated: DataFrame) -> DataFrame:
    """Win rate, mean, median and excess overall, by horizon, by model and by both, in one pass of grouping sets."""
    m, h = F.col("model_version"), F.col("horizon")
    sets = [[], [h], [m], [m, h]]
    level = F.grouping_id().alias("level")
    base = evaluated.groupingSets(sets, m, h).agg(
        level,
        F.count("*").alias("evaluated"),
        F.avg(F.col("correct_direction").cast("double")).alias("win_rate"),
        F.avg("actual_return").alias("avg_return"),
        F.avg("excess_return").alias("avg_excess_return"),
        F.avg((F.col("excess_return") > 0).cast("double")).alias("beat_rate"),
    )
    # Each row votes once per grouping set for the exact medians.
    kinds = F.array(*[F.struct(F.lit(lv).alias("level"), (m if lv in (0, 1) else F.lit(None).cast("string")).alias("mv"), (h if lv in (0, 2) else F.lit(None).cast("int")).alias("hz")) for lv in (0, 1, 2, 3)])
    long = evaluated.select("actual_return", F.inline(kinds)).select("actual_return", "level", F.coalesce("mv", F.lit("")).alias("mv"), F.coalesce("hz", F.lit(-1)).alias("hz"))
    med = medians(long, ["level", "mv", "hz"], "actual_return", "median_return")
    keyed = base.withColumns({"mv": F.coalesce(m, F.lit("")), "hz": F.coalesce(h, F.lit(-1))})
    return keyed.join(med, ["level", "mv", "hz"]).drop("level", "mv", "hz")


def summarize_cohorts(c: DataFrame, by: list[str]) -> DataFrame:
    """Per group of weekly cohorts: net, excess, stress, loss rate, worst week and worst-fifth mean.

    ``c``: picks, model_return, screen_return, benchmark_return.  Weeks without
    picks are cash at no cost; they are kept.
    """
    paid = lambda cost: F.when(F.col("picks") > 0, F.lit(cost)).otherwise(0.0)
    d = c.withColumns(
        {
            "_net": F.col("model_return") - paid(ROUND_TRIP_COST),
            "_stress": F.col("model_return") - paid(STRESS_COST) - F.col("benchmark_return"),
            "_screen": F.col("screen_return") - ROUND_TRIP_COST,
        }
    )
    d = d.withColumns({"_vs_b": F.col("_net") - F.col("benchmark_return"), "_vs_s": F.col("_net") - F.col("_screen")})
    out = d.groupBy(*by).agg(
        F.count("*").alias("cohorts"),
        F.sum("picks").alias("picks"),
        F.avg("_net").alias("mean_net_return"),
        F.avg("_vs_b").alias("mean_excess"),
        F.avg("_vs_s").alias("mean_improvement_vs_screen"),
        F.avg("_stress").alias("stress_mean_excess"),
        F.avg((F.col("_vs_b") > 0).cast("double")).alias("beat_rate"),
        F.avg((F.col("_net") < 0).cast("double")).alias("loss_rate"),
        F.min("_net").alias("worst"),
    )
    return out.join(tail_mean(d, by, "_net", "worst_fifth_mean"), by).join(tail_mean(d, by, "_screen", "screen_worst_fifth_mean"), by)


def period_passes(min_weeks: int = 26) -> Column:
    """Gate over the summary of a period: every required figure present and good enough."""
    above = ("mean_net_return", "mean_excess", "mean_improvement_vs_screen", "stress_mean_excess", "lower_bound_vs_benchmark", "lower_bound_vs_screen")
    ok = (F.col("cohorts") >= min_weeks) & (F.col("evaluation_coverage") >= 0.95)
    for c in above:
        ok = ok & (F.col(c) > 0)
    ok = ok & (F.col("worst_fifth_mean") >= F.col("screen_worst_fifth_mean")) & F.col("breach_rate").between(0.05, 0.20)
    return F.coalesce(ok, F.lit(False))


def lower_bounds(values: DataFrame, by: list[str], columns: dict[str, str], position: str, block: int = 4, repeats: int = 1000, level: float = 0.05) -> DataFrame:
    """Lower bounds of the means of several columns in every group, by circular block resampling; neighbouring weeks stay together.

    ``columns``: result name and column; ``position`` numbers a group's values
    0 … n-1.  Block starts come from a hash of (repeat, block number), so any
    engine can repeat the draw, and groups of equal length and all columns share
    every draw: differences between them are paired.  One job does all groups;
    its work is ``repeats`` times the number of weeks, spread by repeat.  A null
    takes no part in its column's means.
    """
    n = values.groupBy(*by).agg(F.count("*").alias("_n"))
    draws = n.withColumn("_rep", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))).repartition("_rep")
    draws = draws.withColumn("_k", F.explode(F.sequence(F.lit(0), F.ceil(F.col("_n") / block).cast("int") - 1)))
    start = F.conv(F.substring(F.md5(F.concat_ws("|", F.col("_rep").cast("string"), F.col("_k").cast("string")).cast("binary")), 1, 8), 16, 10).cast("long") % F.col("_n")
    steps = draws.withColumn("_s", start).withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(block - 1)))).where(F.col("_k") * block + F.col("_i") < F.col("_n"))
    steps = steps.select(*by, "_rep", ((F.col("_s") + F.col("_i")) % F.col("_n")).alias(position))
    means = steps.join(values.select(*by, position, *[F.col(c).alias(f"_v_{name}") for name, c in columns.items()]), [*by, position])
    means = means.groupBy(*by, "_rep").agg(*[F.avg(f"_v_{name}").alias(name) for name in columns])
    # One mean per repeat: a short, fixed-length list.
    return means.groupBy(*by).agg(*[F.get(F.sort_array(F.collect_list(name)), F.lit(int(level * repeats))).alias(name) for name in columns])


def period_report(cohorts: DataFrame, attempted: DataFrame, breaches: DataFrame, by: list[str], order: str = "session_no", min_weeks: int = 26) -> DataFrame:
    """Everything that the gate of a period asks for, and ``passes``, per group of weekly cohorts.

    ``attempted``: the groups' numbers of cohorts that were tried, ``breaches``:
    the share of picks that fell below their forecast of the worst tenth.  A
    figure that is missing fails the gate.
    """
    paid = F.when(F.col("picks") > 0, F.lit(ROUND_TRIP_COST)).otherwise(0.0)
    net = F.col("model_return") - paid
    numbered = cohorts.select(
        *by, (F.row_number().over(Window.partitionBy(*by).orderBy(order)) - 1).cast("long").alias("_pos"),
        (net - F.col("benchmark_return")).alias("_b"), (net - (F.col("screen_return") - ROUND_TRIP_COST)).alias("_s"),
    )
    bounds = lower_bounds(numbered, by, {"lower_bound_vs_benchmark": "_b", "lower_bound_vs_screen": "_s"}, "_pos")
    out = summarize_cohorts(cohorts, by).join(bounds, by, "left").join(attempted, by, "left").join(breaches, by, "left")
    out = out.withColumn("evaluation_coverage", F.col("cohorts") / F.col("attempted"))
    return out.withColumn("passes", period_passes(min_weeks))


def selected_variant(report: DataFrame, variant: str = "model_version", period: str = "period") -> DataFrame:
    """The variant chosen on the selection period alone, and whether it passes there and on the holdout: one row.

    First come variants that pass, then the larger improvement on the screen,
    unknown last, then the name.
    """
    better = F.struct(F.col("passes"), F.coalesce("mean_improvement_vs_screen", F.lit(float("-inf"))))
    best = report.where(F.col(period) == "selection").orderBy(better.desc(), variant).limit(1).select(variant, F.col("passes").alias("selection_passes"))
    held = report.where(F.col(period) == "holdout").select(variant, F.col("passes").alias("_held"), F.col("mean_improvement_vs_screen").alias("holdout_improvement"))
    out = best.join(held, variant, "left")
    return out.select(variant, "selection_passes", F.coalesce("_held", F.lit(False)).alias("holdout_passes"), (F.col("selection_passes") & F.coalesce("_held", F.lit(False))).alias("validated"), "holdout_improvement")


def curve_metrics(curve: DataFrame, by: list[str], order: str, equity: str, benchmark: str, day: str, initial: float = INITIAL_CAPITAL) -> DataFrame:
    """Drawdown from the starting capital, excess, tracking error, information ratio, annual return.

    A curve has one row per session, so its window is bounded by the calendar.
    """
    w = Window.partitionBy(*by).orderBy(order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)

    def fall(c: str) -> Column:
        return F.col(c) / F.greatest(F.lit(initial), F.max(c).over(upto)) - 1

    d = curve.withColumns({"_dd": fall(equity), "_bdd": fall(benchmark), "_x": (F.col(equity) / F.lag(equity).over(w)) - (F.col(benchmark) / F.lag(benchmark).over(w))})
    last = lambda c: F.max_by(c, order)
    out = d.groupBy(*by).agg(
        F.count("*").alias("sessions"),
        F.min(day).alias("start_date"),
        F.max(day).alias("as_of_date"),
        last(equity).alias("portfolio_value"),
        last(benchmark).alias("benchmark_value"),
        F.least(F.lit(0.0), F.min("_dd")).alias("max_drawdown"),
        F.least(F.lit(0.0), F.min("_bdd")).alias("benchmark_max_drawdown"),
        F.when(F.count("_x") >= 60, F.stddev_samp("_x") * math.sqrt(252)).alias("tracking_error"),
        F.avg("_x").alias("_mean_x"),
    )
    days = F.datediff("as_of_date", "start_date")
    return out.withColumns(
        {
            "cumulative_return": F.col("portfolio_value") / initial - 1,
            "excess_return": (F.col("portfolio_value") - F.col("benchmark_value")) / initial,
            "information_ratio": F.when(F.col("tracking_error") > 0, F.col("_mean_x") * 252 / F.col("tracking_error")),
            "annualized_return": F.when(days >= 365, F.pow(F.col("portfolio_value") / initial, F.lit(365.25) / days) - 1),
        }
    ).drop("_mean_x")


def non_overlapping(curve: DataFrame, by: list[str], order: str, n: int = 5) -> DataFrame:
    """Rows 1, 1+n, 1+2n, … of each curve and its last row."""
    w = Window.partitionBy(*by).orderBy(order)
    d = curve.withColumn("_n", F.row_number().over(w)).withColumn("_last", F.lead(order).over(w).isNull())
    return d.where((F.col("_n") % n == 1 % n) | F.col("_last")).drop("_n", "_last")


def cohort_paths(picks: DataFrame, calendar: DataFrame, closes: DataFrame, benchmark: DataFrame, scenarios: dict[str, float], by: list[str], bases: tuple[str, ...] = ()) -> DataFrame:
    """Mark-to-market value of each cohort bought at entry and sold at exit, under each cost scenario.

    ``picks``: keys, entity, weight, entry_no, exit_no.  Half of the round-trip
    cost is paid on each side, uninvested weight stays cash, and the curve ends
    before the first session on which a held price is missing.  With ``bases``,
    the values of the column ``basis`` of closes and benchmark, each cohort is
    valued on every basis by itself: a price missing on one is never taken from another.
    """
    also = ["basis"] if bases else []
    if bases:
        picks = picks.withColumn("basis", F.explode(F.array(*[F.lit(b) for b in bases])))
    by = [*by, *also]
    days = calendar.select(F.col("session_no").alias("_no"), "session_date")
    entry = closes.select("entity_id", *also, F.col("session_no").alias("entry_no"), positive("close").alias("_entry"))
    held = picks.join(entry, ["entity_id", *also, "entry_no"], "left").withColumn("_no", F.explode(F.sequence("entry_no", "exit_no")))
    marks = held.join(closes.select("entity_id", *also, F.col("session_no").alias("_no"), positive("close").alias("_px")), ["entity_id", *also, "_no"], "left")
    by_day = marks.groupBy(*by, "entry_no", "exit_no", "_no").agg(
        F.sum(F.col("weight") * F.col("_px") / F.col("_entry")).alias("_gross"), F.sum("weight").alias("_invested"), F.count_if(F.col("_px").isNull() | F.col("_entry").isNull()).alias("_missing")
    )
    stop = Window.partitionBy(*by).orderBy("_no").rowsBetween(Window.unboundedPreceding, 0)
    live = by_day.withColumn("_bad", F.sum("_missing").over(stop)).where("_bad = 0").join(F.broadcast(days), "_no")
    b = benchmark.select(*also, F.col("session_no").alias("_no"), F.col("close").alias("_b"))
    b0 = b.select(*also, F.col("_no").alias("entry_no"), F.col("_b").alias("_b0"))
    live = live.join(F.broadcast(b), ["_no", *also]).join(F.broadcast(b0), ["entry_no", *also])
    listed = [F.struct(F.lit(k).alias("scenario"), F.lit(c).alias("cost")) for k, c in scenarios.items()]
    each = live.withColumn("_sc", F.explode(F.array(*listed))).select("*", "_sc.*")
    half = F.col("cost") / 2
    value = F.col("_gross") / (half + 1) * F.when(F.col("_no") == F.col("exit_no"), F.lit(1.0) - half).otherwise(1.0)
    return each.select(
        *by, "scenario", F.col("_no").alias("session_no"), "session_date",
        ((value + 1 - F.col("_invested")) * INITIAL_CAPITAL).alias("equity"), (F.col("_b") / F.col("_b0") / (half + 1) * INITIAL_CAPITAL).alias("benchmark_equity"),
    )


def capped_weights(picks: DataFrame, by: list[str], method: str, sector_cap: float = 0.4, sector: str = "sector", vol: str = "volatility_20") -> DataFrame:
    """Equal or inverse-volatility weights, each sector scaled down to its cap; the rest stays cash.

    Cohorts are a few rows each.  A cohort with an unknown volatility gets no
    inverse-volatility weights at all.
    """
    raw = F.lit(1.0) if method == "equal" else F.lit(1.0) / positive(vol)
    w, ws = Window.partitionBy(*by), Window.partitionBy(*by, sector)
    d = picks.withColumn("_raw", raw).withColumn("_known", F.count("_raw").over(w) == F.count(F.lit(1)).over(w))
    d = d.withColumn("_w", F.when(F.col("_known"), F.col("_raw") / F.sum("_raw").over(w)))
    scale = F.least(F.lit(1.0), F.lit(sector_cap) / F.sum("_w").over(ws))
    return d.withColumn("weight", F.col("_w") * scale).drop("_raw", "_known", "_w")


def entry_after_publication(cohorts: DataFrame, calendar: DataFrame, close: str, day: str) -> DataFrame:
    """First session after the signal day whose close lies after the publication time.

    Cohorts and sessions are both a few rows per week, hence the single group.
    """
    from tidemark.operators.asof import asof_best

    c = calendar.select(F.lit(1).alias("_k"), F.col(close).alias("_close"), F.col(day).alias("entry_date"))
    ask = F.greatest(F.col("published_at"), F.date_add("signal_date", 1).cast("timestamp_ntz"))
    d = cohorts.withColumn("_k", F.lit(1)).withColumn("_ask", ask)
    return asof_best(d, c, ["_k"], "_ask", "_close", ["entry_date"], strict=True, forward=True).drop("_k", "_ask")


def position_marks(positions: DataFrame, prices: DataFrame, by: list[str], max_position: float, max_sector: float) -> DataFrame:
    """Value, weight and sector weight of held positions with concentration alerts."""
    d = positions.join(prices, "entity_id", "left").withColumn("value", F.col("shares") * F.col("close"))
    w, ws = Window.partitionBy(*by), Window.partitionBy(*by, "sector")
    d = d.withColumn("weight", F.col("value") / F.sum("value").over(w)).withColumn("sector_weight", F.sum("value").over(ws) / F.sum("value").over(w))
    alert = (
        F.when(F.col("close").isNull(), "price_missing")
        .when(F.col("weight") > max_position, "position_concentration")
        .when(F.col("sector_weight") > max_sector, "sector_concentration")
    )
    return d.withColumn("alert", alert)


def complete_sessions(prices: DataFrame, basket: DataFrame, n: int) -> DataFrame:
    """Sessions on which every one of the ``n`` basket members is priced."""
    p = prices.join(basket.select("entity_id"), "entity_id", "left_semi").where(positive("close").isNotNull())
    return p.groupBy("session_date").agg(F.countDistinct("entity_id").alias("priced")).where(F.col("priced") == n).select("session_date")
