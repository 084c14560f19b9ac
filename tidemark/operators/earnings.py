"""Report events: latest known version, reactions, streaks, upcoming dates, studies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import simple_return
from tidemark.operators.asof import asof_best, interval_join, live_streak
from tidemark.operators.latest import latest_row
from tidemark.operators.ranks import medians

ENTITY = "entity_id"


def before_open(event_time: str) -> Column:
    return F.coalesce(F.col(event_time) < "09:30", F.lit(False))


def after_close(event_time: str) -> Column:
    return F.coalesce(F.col(event_time) >= "16:00", F.lit(False))


def reactions(events: DataFrame, bars: DataFrame) -> DataFrame:
    """Return from the last price before a report was known to the first one after.

    Reports before the open compare the previous close with that day's, or the
    next session's where that day has none; all others compare the last close
    at or before the day with the next session.
    """
    on = [ENTITY]
    prices = bars.select(*on, F.col("session_date").alias("_day"), F.col("close").alias("_close"))
    early = before_open("event_time")
    df = events.withColumn("_base_day", F.when(early, F.date_sub("reported_date", 1)).otherwise(F.col("reported_date")))
    df = df.withColumn("_from_day", F.when(early, F.col("reported_date")).otherwise(F.date_add("reported_date", 1)))
    df = asof_best(df, prices, on, "_base_day", "_day", ["_day", "_close"], prefix="_b")
    df = asof_best(df, prices, on, "_from_day", "_day", ["_day", "_close"], forward=True, prefix="_r")
    return df.select(
        *events.columns, F.col("_r_day").alias("reaction_date"), simple_return("_b_close", "_r_close").alias("reaction")
    )


def reaction_against_benchmark(events: DataFrame, bars: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Own reaction and its excess over the benchmark between the same two closes."""
    own = reactions(events, bars)
    base_day = F.when(before_open("event_time"), F.date_sub("reported_date", 1)).otherwise(F.col("reported_date"))
    # The benchmark is one row per session, so a broadcast map of its closes is bounded.
    b = benchmark.select(F.col("session_date").alias("_bd"), F.col("close").alias("_bc"))
    spans = b.withColumn("_until", F.coalesce(F.date_sub(F.lead("_bd").over(Window.orderBy("_bd")), 1), F.date_add("_bd", 6)))
    every_day = spans.select(F.explode(F.sequence("_bd", "_until")).alias("_any"), F.col("_bc").alias("_base_close"))
    out = (
        own.withColumn("_base_day", base_day)
        .join(F.broadcast(every_day), F.col("_base_day") == F.col("_any"), "left")
        .join(F.broadcast(b), F.col("reaction_date") == F.col("_bd"), "left")
    )
    market = simple_return("_base_close", "_bc")
    return out.withColumn("reaction_vs_benchmark", F.col("reaction") - market).select(*own.columns, "reaction_vs_benchmark")


def known_reports(versions: DataFrame) -> DataFrame:
    """Append-only history of what was the newest version per report at each arrival.

    Each arriving version carries the streak of beats among the reports known
    at that moment, so an as-of lookup on the arrival needs no second pass.
    The reports of one entity are bounded by its reporting dates.
    """
    reported = versions.where(F.col("reported_eps").isNotNull())
    w = Window.partitionBy(ENTITY).orderBy("observed_at", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    seen = F.collect_list(F.struct(F.col("reported_date").alias("d"), F.col("observed_at").alias("o"), F.col("event_id").alias("e"), F.coalesce(F.col("surprise_percent") > 0, F.lit(False)).alias("hit"))).over(w)
    ordered = F.reverse(F.array_sort("_seen"))
    # Newest report first and only its newest version; then count until the first miss.
    state = F.aggregate(
        ordered,
        F.struct(F.lit(None).cast("date").alias("last"), F.lit(0).alias("n"), F.lit(True).alias("alive")),
        lambda acc, x: F.when(acc["last"].eqNullSafe(x["d"]), acc).otherwise(
            F.struct(x["d"].alias("last"), F.when(acc["alive"] & x["hit"], acc["n"] + 1).otherwise(acc["n"]).alias("n"), (acc["alive"] & x["hit"]).alias("alive"))
        ),
    )
    return reported.withColumn("_seen", seen).withColumn("beat_streak", state["n"]).drop("_seen")


def earnings_asof(decisions: DataFrame, versions: DataFrame, cutoff: str, values: list[str]) -> DataFrame:
    """The newest report known by each decision, in its newest version, with the live streak."""
    hist = known_reports(versions)
    out = asof_best(decisions, hist, [ENTITY], cutoff, "observed_at", ["reported_date", *values], best=["reported_date", "observed_at", "event_id"])
    streaks = hist.select(ENTITY, "observed_at", F.col("event_id"), "beat_streak")
    out = asof_best(out, streaks, [ENTITY], cutoff, "observed_at", ["beat_streak"], best=["observed_at", "event_id"])
    return out.withColumn("days_since", F.datediff(F.to_date(cutoff), "reported_date"))


def recent_report(rows: DataFrame, reports: DataFrame, cutoff: str, values: list[str], max_age: int = 30) -> DataFrame:
    """The latest report from before the cutoff's day, at most ``max_age`` days old, as known at the cutoff.

    A version is usable once its report day is over and it was observed.  Values
    of one report stay together: they all come from its newest usable version.
    """
    usable = F.greatest(F.date_add("reported_date", 1).cast("timestamp_ntz"), F.col("observed_at"))
    known = reports.where(F.col("reported_date").isNotNull() & F.col("observed_at").isNotNull()).withColumn("_usable", usable)
    out = asof_best(rows, known, [ENTITY], cutoff, "_usable", ["reported_date", *values], best=["reported_date", "observed_at", "event_id"])
    fresh = F.coalesce(F.datediff(F.to_date(cutoff), "reported_date") <= max_age, F.lit(False))
    return out.withColumns({c: F.when(fresh, F.col(c)) for c in ["reported_date", *values]})


def scheduled(expected: DataFrame, reports: DataFrame) -> DataFrame:
    """Calendar observations with the span in which each holds: until the event's next one, or until the event is seen reported."""
    w = Window.partitionBy(ENTITY, "event_id").orderBy("observed_at", "expected_date")
    seen = reports.groupBy(ENTITY, "event_id").agg(F.min("observed_at").alias("_seen"))
    spans = expected.where(F.col("observed_at").isNotNull()).withColumn("_next", F.lead("observed_at").over(w)).join(seen, [ENTITY, "event_id"], "left")
    return spans.withColumn("until", F.least("_next", "_seen")).where(F.col("until").isNull() | (F.col("observed_at") < F.col("until"))).drop("_next", "_seen")


def next_expected(rows: DataFrame, expected: DataFrame, reports: DataFrame, cutoff: str) -> DataFrame:
    """Adds reported_date: the first date on or after the cutoff's day that the calendar, as known at the cutoff, gives for an event not yet reported."""
    asks = rows.select(ENTITY, F.col(cutoff).alias("_at"), F.to_date(cutoff).alias("_day")).distinct()
    spans = scheduled(expected, reports).select(ENTITY, "expected_date", F.col("observed_at").alias("_from"), F.col("until").alias("_gone"), F.to_date("observed_at").alias("_first"), F.date_add(F.to_date("until"), 1).alias("_last"))
    met = interval_join(asks, spans, [ENTITY], "_day", "_first", "_last")
    holds = (F.col("_from") <= F.col("_at")) & (F.col("_gone").isNull() | (F.col("_at") < F.col("_gone"))) & (F.col("expected_date") >= F.col("_day"))
    first = met.where(holds).groupBy(ENTITY, "_at").agg(F.min("expected_date").alias("reported_date"))
    return rows.join(first.withColumnRenamed("_at", cutoff), [ENTITY, cutoff], "left").select(*rows.columns, "reported_date")


def upcoming_report(rows: DataFrame, expected: DataFrame, reports: DataFrame, calendar: DataFrame, cutoff: str, horizons: tuple[int, ...] = (5, 10, 20)) -> DataFrame:
    """The next report expected at the cutoff and the horizons it falls into.

    ``expected`` holds calendar observations (event_id, expected_date,
    observed_at); what was observed later, or is already reported, plays no
    part.  ``within`` counts sessions after the cutoff's day; ``within_execution``
    starts one session later, when a decision can first be executed.
    """
    from tidemark.operators.calendar import day_ordinals

    day = "_day"
    nxt = next_expected(rows, expected, reports, cutoff).withColumn(day, F.to_date(cutoff))
    # First session at or after a day = sessions up to the day before it, plus one.
    ords = day_ordinals(calendar)
    last_no, last_day = calendar.agg(F.max("session_no")).scalar(), calendar.agg(F.max("session_date")).scalar()
    at = ords.select(F.col("any_day").alias("_d1"), F.col("sessions_passed").alias("_now"))
    to = ords.select(F.col("any_day").alias("_d2"), F.col("sessions_passed").alias("_then"))
    df = nxt.withColumn("_eve", F.date_sub("reported_date", 1))
    df = df.join(F.broadcast(at), F.col(day) == F.col("_d1"), "left").join(F.broadcast(to), F.col("_eve") == F.col("_d2"), "left")
    then = F.when(F.col("_eve") > last_day, last_no).otherwise(F.greatest(F.col("_then"), F.col("_now")))
    # An event after the calendar's end cannot be placed, so it falls into no horizon.
    sessions = F.when(F.col("reported_date") <= last_day, then + 1 - F.col("_now"))
    df = df.withColumn("sessions_until", F.when(F.col("reported_date") == F.col(day), F.lit(0)).otherwise(sessions))
    hs = F.array(*[F.lit(h) for h in horizons])
    known = F.col("sessions_until").isNotNull()
    df = df.withColumn("within", F.when(known, F.filter(hs, lambda h: F.col("sessions_until") <= h)).otherwise(F.array().cast("array<int>")))
    df = df.withColumn("within_execution", F.when(known, F.filter(hs, lambda h: F.col("sessions_until") <= h + 1)).otherwise(F.array().cast("array<int>")))
    return df.select(*rows.columns, "reported_date", "sessions_until", "within", "within_execution")


def without_reports(entities: DataFrame, events: DataFrame) -> DataFrame:
    return entities.join(events.select(ENTITY).distinct(), ENTITY, "left_anti")


def first_session_after(events: DataFrame, bars: DataFrame, values: list[str]) -> DataFrame:
    """The entity's first bar strictly after the report day."""
    b = bars.select(ENTITY, F.col("session_date").alias("entry_date"), *values)
    return asof_best(events, b, [ENTITY], "reported_date", "entry_date", ["entry_date", *values], strict=True, forward=True)


def event_study(obs: DataFrame, groups: list[tuple[str, Column]], outcome: str, by: list[str] | None = None, min_n: int = 1) -> DataFrame:
    """Count, share up, mean and median of an outcome for overlapping groups.

    Every event visits the groups it belongs to once; groups below ``min_n``
    are left out.
    """
    by = by or []
    labels = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in groups]))
    long = obs.where(F.col(outcome).isNotNull()).withColumn("study_group", F.explode(labels))
    keys = [*by, "study_group"]
    base = long.groupBy(*keys).agg(F.count("*").alias("n"), F.avg((F.col(outcome) > 0).cast("double")).alias("up_rate"), F.avg(outcome).alias("mean_outcome"))
    return base.join(medians(long, keys, outcome, "median_outcome"), keys).where(F.col("n") >= min_n)


def beat_streaks(reports: DataFrame) -> DataFrame:
    """Running streak of beats over distinct report dates, newest version of each date."""
    one = latest_row(reports, [ENTITY, "reported_date"], "observed_at", "event_id")
    return live_streak(one, [ENTITY], ["reported_date"], F.col("surprise_percent") > 0)
