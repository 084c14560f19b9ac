"""Point-in-time lookups without range joins.

Every lookup is one running maximum over the union of the asking side and the
answering side, ordered by the time a row becomes usable.  A running maximum is
associative, so ``block`` splits a key's history into time blocks that are
worked on separately: one aggregate per (key, block) is carried forward, and a
key with a third of all rows is spread over as many tasks as it has blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Names = list[str]


def availability(observed: str, published: str | None = None, *others: str) -> Column:
    """When a fact may first be used: the later of publication and observation.

    A missing publication time counts as the observation time; a missing
    observation time makes the fact unusable.
    """
    later = [F.coalesce(F.col(c), F.col(observed)) for c in ((published,) if published else ()) + others]
    at = F.greatest(F.col(observed), *later) if later else F.col(observed)
    return F.when(F.col(observed).isNotNull(), at)


def available(cutoff: Column, observed: str, published: str | None = None) -> Column:
    return F.coalesce(availability(observed, published) <= cutoff, F.lit(False))


def asof_best(
    left: DataFrame,
    right: DataFrame,
    on: Names,
    left_ts: str,
    right_ts: str,
    payload: Names,
    best: Names | None = None,
    strict: bool = False,
    forward: bool = False,
    block: str | None = None,
    prefix: str = "",
) -> DataFrame:
    """For each left row, the best right row usable at its time.

    ``best`` names the right columns that decide (default: the usable time, so
    the newest row backward and the first one forward).  ``strict`` leaves out
    equal times.  Left rows without an answer keep null payload columns.
    ``block`` is a ``date_trunc`` unit; leave it out only where the rows of one
    key are bounded, e.g. one per session.
    """
    best = best or [right_ts]
    keep = left.columns
    answer = F.struct(*[F.col(c).alias(f"b{i}") for i, c in enumerate(best)], *[F.col(c).alias(f"p_{c}") for c in payload])
    asks = left.select(*on, F.col(left_ts).alias("_ts"), F.lit(0 if strict else 1).alias("_side"), F.struct(*[F.col(c) for c in keep]).alias("_left"))
    answers = right.where(F.col(right_ts).isNotNull()).select(*on, F.col(right_ts).alias("_ts"), F.lit(1 if strict else 0).alias("_side"), answer.alias("_answer"))
    rows = asks.unionByName(answers, allowMissingColumns=True)

    pick = F.min if forward else F.max
    time = F.col("_ts").desc() if forward else F.col("_ts").asc()
    running = (Window.unboundedPreceding, Window.currentRow)
    if block is None:
        w = Window.partitionBy(*on).orderBy(time, "_side").rowsBetween(*running)
        found = rows.withColumn("_found", pick("_answer").over(w))
    else:
        rows = rows.withColumn("_block", F.date_trunc(block, "_ts"))
        w = Window.partitionBy(*on, "_block").orderBy(time, "_side").rowsBetween(*running)
        blocks = Window.partitionBy(*on).orderBy(F.col("_block").desc() if forward else F.col("_block").asc())
        carried = (
            rows.groupBy(*on, "_block")
            .agg(pick("_answer").alias("_best"))
            .withColumn("_carry", pick("_best").over(blocks.rowsBetween(Window.unboundedPreceding, -1)))
            .drop("_best")
        )
        inside = rows.withColumn("_inside", pick("_answer").over(w)).where(F.col("_left").isNotNull())
        joined = inside.join(carried, [*on, "_block"], "left")
        fold = F.least("_inside", "_carry") if forward else F.greatest("_inside", "_carry")
        found = joined.withColumn("_found", fold)
    return found.where(F.col("_left").isNotNull()).select("_left.*", *[F.col(f"_found.p_{c}").alias(prefix + c) for c in payload])


def latest_known(
    left: DataFrame, right: DataFrame, on: Names, left_ts: str, usable_at: str, period: str, payload: Names, tie: Names, block: str | None = None
) -> DataFrame:
    """The newest *period* among the versions usable by then, in its latest version.

    A late amendment of an older period never displaces a newer period.
    """
    return asof_best(left, right, on, left_ts, usable_at, payload, best=[period, *tie], block=block)


def stale_to_null(df: DataFrame, age: Column, max_age: int, columns: Names) -> DataFrame:
    """Null the looked-up columns where their age is unknown, negative or above the limit."""
    fresh = F.coalesce((age >= 0) & (age <= max_age), F.lit(False))
    return df.withColumns({c: F.when(fresh, F.col(c)) for c in columns})


def member_asof(left: DataFrame, members: DataFrame, on: Names, cutoff: str, day: str, start: str, end: str, captured: str | None = None) -> DataFrame:
    """Add ``is_member``: some half-open interval [start, end) known by the cutoff covers the day.

    Without a capture time, among the intervals begun by the day one covers it
    exactly if the furthest end lies after it, so a running maximum answers what
    would otherwise be an interval join.  With one, begin and capture are held
    against two different times: the few intervals that cover the day are met in
    buckets, and those captured by the cutoff count.
    """
    if captured is None:
        spans = members.select(*on, F.col(start).alias("_from"), F.coalesce(F.col(end), F.lit("9999-12-31").cast("date")).alias("_until"))
        out = asof_best(left, spans, on, day, "_from", ["_until"], best=["_until"])
        return out.withColumn("is_member", F.coalesce(F.col("_until") > F.col(day), F.lit(False))).drop("_until")
    asks = left.select(*on, day, cutoff).distinct()
    spans = members.select(*on, F.col(start).alias("_begins"), F.col(end).alias("_ends"), F.col(captured).alias("_seen"))
    met = interval_join(asks, spans, on, day, "_begins", "_ends").where(F.coalesce(F.col("_seen") <= F.col(cutoff), F.lit(True)))
    found = met.select(*on, day, cutoff).distinct().withColumn("_found", F.lit(True))
    return left.join(found, [*on, day, cutoff], "left").select(*left.columns, F.coalesce("_found", F.lit(False)).alias("is_member"))


def interval_join(left: DataFrame, right: DataFrame, on: Names, day: str, start: str, end: str, width_days: int = 92) -> DataFrame:
    """All (row, interval) pairs with ``start <= day < end``; a null end is open.

    Intervals are cut into buckets of ``width_days`` and meet the rows by an
    equi join on key and bucket.
    """
    epoch = F.lit("1970-01-01").cast("date")
    bucket = lambda d: F.floor(F.datediff(d, epoch) / width_days)
    last = left.agg(F.max(day)).scalar()
    until = F.least(F.coalesce(F.date_sub(end, 1), last), last)
    spans = right.withColumn("_until", until).where(F.col("_until") >= F.col(start))
    spans = spans.withColumn("_bucket", F.explode(F.sequence(bucket(F.col(start)), bucket(F.col("_until"))))).drop("_until")
    rows = left.withColumn("_bucket", bucket(F.col(day)))
    inside = (F.col(start) <= F.col(day)) & (F.col(end).isNull() | (F.col(day) < F.col(end)))
    return rows.join(spans, [*on, "_bucket"]).where(inside).drop("_bucket")


def active_by_month(members: DataFrame, by: Names, months: DataFrame, month: str, start: str, end: str) -> DataFrame:
    """(*by, month, active): how many intervals ``start <= first of the month < end`` each group has; a null end is open.

    An interval counts one up on the first month that it covers and one down on
    the first that it does not, and a running sum over a group's months does the
    rest: members and months are never paired.  ``months``: a column of firsts
    of months, bounded by the calendar.  Empty intervals count nothing.
    """
    first = lambda d: F.when(F.trunc(d, "month") == F.col(d), F.col(d)).otherwise(F.add_months(F.trunc(d, "month"), 1))
    held = members.where(F.col(start).isNotNull() & (F.col(end).isNull() | (F.col(start) < F.col(end))))
    steps = F.array(F.struct(first(start).alias("d"), F.lit(1).alias("n")), F.struct(first(end).alias("d"), F.lit(-1).alias("n")))
    changes = held.select(*by, F.inline(steps)).where("d IS NOT NULL").groupBy(*by, "d").agg(F.sum("n").alias("n"))
    every = months.agg(F.collect_set(month).alias("m")).scalar()
    asked = held.select(*by).distinct().select(*by, F.explode(every).alias("d")).withColumns({"n": F.lit(0).cast("long"), "_asked": F.lit(True)})
    rows = asked.unionByName(changes.withColumn("_asked", F.lit(False)))
    upto = Window.partitionBy(*by).orderBy("d").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("active", F.sum("n").over(upto)).where("_asked").select(*by, F.col("d").alias(month), "active")


def window_join(left: DataFrame, right: DataFrame, on: Names, left_day: str, right_day: str, lo: int, hi: int) -> DataFrame:
    """Pairs with ``left_day + lo <= right_day <= left_day + hi`` in days.

    The left row visits the few buckets its window touches and meets the right
    side by an equi join, so no nested loop is planned.
    """
    epoch = F.lit("1970-01-01").cast("date")
    width = hi - lo + 1
    bucket = lambda d: F.floor(F.datediff(d, epoch) / width)
    first, last = F.date_add(left_day, lo), F.date_add(left_day, hi)
    asks = left.withColumn("_bucket", F.explode(F.sequence(bucket(first), bucket(last))))
    answers = right.withColumn("_bucket", bucket(F.col(right_day)))
    diff = F.datediff(right_day, left_day)
    return asks.join(answers, [*on, "_bucket"]).where((diff >= lo) & (diff <= hi)).drop("_bucket")


def nearest(left: DataFrame, right: DataFrame, on: Names, target: str, right_day: str, payload: Names, tolerance: int, tie: Names | None = None) -> DataFrame:
    """The right row closest to a target day, earlier one on equal distance, null beyond the tolerance.

    The closest row is either the last at or before the target or the first
    after it, so two as-of lookups replace a range join.
    """
    order = [right_day, *(tie or [])]
    data = right.select(*on, F.col(right_day).alias("_day"), F.struct(*payload).alias("_data"), *[F.col(c).alias(f"_t{i}") for i, c in enumerate(order)])
    best = [f"_t{i}" for i in range(len(order))]
    back = asof_best(left, data, on, target, "_day", ["_day", "_data"], best=best, prefix="_b")
    fore = asof_best(back, data, on, target, "_day", ["_day", "_data"], best=best, strict=True, forward=True, prefix="_f")
    b, f = F.datediff(target, "_b_day"), F.datediff("_f_day", target)
    use_back = F.coalesce(b <= f, f.isNull())
    dist = F.when(use_back, b).otherwise(f)
    chosen = F.when(dist <= tolerance, F.when(use_back, F.col("_b_data")).otherwise(F.col("_f_data")))
    out = fore.withColumn("_chosen", chosen)
    return out.select(*left.columns, *[F.col(f"_chosen.{c}").alias(c) for c in payload], F.when(dist <= tolerance, dist).alias("distance"))


def change_points(df: DataFrame, keys: Names, order: Names, state: Column, block: str = "day") -> DataFrame:
    """Rows whose state differs from the one before them (A, B, A keeps all three).

    ``order[0]`` is the event time.  Rows are compared inside time blocks; only
    the last state of each block travels to the next one.
    """
    tagged = df.withColumn("_state", state).withColumn("_block", F.date_trunc(block, order[0]))
    last = tagged.groupBy(*keys, "_block").agg(F.max_by("_state", F.struct(*order)).alias("_last"))
    before = last.withColumn("_carry", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_block"))).drop("_last")
    w = Window.partitionBy(*keys, "_block").orderBy(*order)
    out = tagged.withColumn("_prev", F.lag("_state").over(w)).withColumn("_first", F.row_number().over(w) == 1)
    out = out.join(before, [*keys, "_block"], "left")
    prev = F.when(F.col("_first"), F.col("_carry")).otherwise(F.col("_prev"))
    return out.where(~F.col("_state").eqNullSafe(prev)).drop("_state", "_block", "_prev", "_first", "_carry")


def live_streak(df: DataFrame, keys: Names, order: Names, hit: Column) -> DataFrame:
    """Add ``streak``: consecutive hits ending at each row, for histories of bounded length."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    miss = F.when(~F.coalesce(hit, F.lit(False)), F.col("_n"))
    return (
        df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
        .withColumn("_miss", F.coalesce(F.max(miss).over(w), F.lit(0)))
        .withColumn("streak", F.col("_n") - F.col("_miss"))
        .drop("_n", "_miss")
    )


def trailing_stats(decisions: DataFrame, facts: DataFrame, on: Names, cutoff: str, published: str, observed: str, days: int, aggs: list[Column]) -> DataFrame:
    """Aggregate the facts published in the last ``days`` before each cutoff and seen by then.

    Each distinct cutoff asks for the ``days`` + 1 days it looks back on, and
    facts meet them on their own day: a raw fact is shuffled once, and what it
    counts for is summed in the task that met it.
    """
    span = F.sequence(F.date_sub(F.to_date(cutoff), days), F.to_date(cutoff))
    d = decisions.select(*on, cutoff).distinct().withColumn("_day", F.explode(span))
    f = facts.withColumn("_day", F.to_date(published))
    hits = f.join(d, [*on, "_day"]).where(available(F.col(cutoff), observed, published) & (F.col(published) >= F.col(cutoff) - F.expr(f"interval {days} days")))
    return decisions.join(hits.groupBy(*on, cutoff).agg(*aggs), [*on, cutoff], "left")
