"""Macro series as known on a day: dated vintages the day after, plain captures once observed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.asof import asof_best, nearest

# Greatest age in days of the newest observation of a series.
MAX_AGES = {"DFF": 7, "DGS2": 7, "DGS10": 7, "CPIAUCSL": 75, "UNRATE": 75, "PAYEMS": 75, "GDPC1": 240, "DTWEXBGS": 10, "DCOILWTICO": 10}
# Series, lag in days, tolerance, kind of change.
CHANGES = (("CPIAUCSL", 365, 40, "ratio"), ("PAYEMS", 31, 10, "difference"), ("GDPC1", 91, 15, "ratio"), ("DTWEXBGS", 28, 10, "ratio"), ("DCOILWTICO", 28, 10, "ratio"))


def usable_from(vintage: str = "vintage_date", observed: str = "observed_at"):
    """A dated vintage counts from the following day, a capture from its own time."""
    return F.when(F.col(vintage).isNotNull(), F.date_add(vintage, 1).cast("timestamp_ntz")).otherwise(F.col(observed))


def latest_observation(decisions: DataFrame, observations: DataFrame, cutoff: str, max_age: int | None = None) -> DataFrame:
    """Per decision and series: the newest period known by then, in its newest version.

    ``decisions`` carry ``series_id``.  The newest period is a running maximum
    over arrivals, so one sorted pass answers all decisions.
    """
    o = observations.where(F.col("value").isNotNull()).withColumn("_usable", usable_from())
    out = asof_best(decisions, o, ["series_id"], cutoff, "_usable", ["observation_date", "value", "units"], best=["observation_date", "_usable", "observed_at"])
    if max_age is None:
        return out
    fresh = F.coalesce(F.datediff(F.to_date(cutoff), "observation_date") <= max_age, F.lit(False))
    return out.withColumns({c: F.when(fresh, F.col(c)) for c in ("observation_date", "value", "units")})


def change_against(latest: DataFrame, observations: DataFrame, lag_days: int, tolerance: int, kind: str) -> DataFrame:
    """Change of the latest value against the observation closest to ``lag_days`` earlier."""
    d = latest.withColumn("_target", F.date_sub("observation_date", lag_days))
    o = observations.select("series_id", F.col("observation_date").alias("_day"), F.col("value").alias("prior_value"), F.col("units").alias("prior_units"))
    n = nearest(d, o, ["series_id"], "_target", "_day", ["prior_value", "prior_units"], tolerance).drop("_target")
    ok = (F.col("prior_units") == F.col("units")) & (F.col("prior_value") != 0)
    change = F.col("value") - F.col("prior_value") if kind == "difference" else F.col("value") / F.col("prior_value") - 1
    return n.withColumn("change", F.when(ok, change))


def macro_vector(asks: DataFrame, observations: DataFrame, cutoff: str, ages: dict[str, int] = MAX_AGES, changes: tuple = CHANGES) -> DataFrame:
    """Per ask (series_id, cutoff and more): observation_date, age_days, value, units and change of the newest observation known by then.

    Observations older than the series' greatest age, and series without one,
    have no row.  The change follows the series' own rule, null without one,
    against the observation closest to its lag in the newest version of each day.
    """
    allowed = F.create_map(*[F.lit(x) for kv in ages.items() for x in kv])
    latest = latest_observation(asks, observations, cutoff).withColumn("age_days", F.datediff(F.to_date(cutoff), "observation_date"))
    latest = latest.where(F.col("age_days") <= F.element_at(allowed, F.col("series_id")))
    parts = [latest.where(~F.col("series_id").isin([c[0] for c in changes])).withColumn("change", F.lit(None).cast("double"))]
    for series, lag, tolerance, kind in changes:
        own = latest.where(F.col("series_id") == series)
        parts.append(change_against(own, observations.where(F.col("series_id") == series), lag, tolerance, kind).drop("prior_value", "prior_units", "distance"))
    return reduce(lambda a, b: a.unionByName(b), parts)
