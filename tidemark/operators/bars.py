"""Canonical price bars: provider priority, validity, gaps, corroborated fills.

Input bars hold at most one row per (entity, session, source).  Everything that
reduces raw rows does so with plain aggregates, which combine before the
shuffle, so a single hot entity or session costs no more than any other.
After that there is one row per (entity, session) and a window per entity is
bounded by the number of sessions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import finite, positive
from tidemark.operators.latest import best_row

ENTITY, SESSION = "entity_id", "session_date"


def source_priority(preferred: str | None, source: str = "source") -> list[Column]:
    """Sort key: the preferred provider first, the others by name."""
    rank = F.when(F.col(source) == preferred, F.lit(0)).otherwise(F.lit(1))
    return [rank, F.coalesce(F.col(source), F.lit(""))]


def canonical_bars(bars: DataFrame, preferred: str | None) -> DataFrame:
    """One bar per (entity, session), chosen by provider priority."""
    return best_row(bars, [ENTITY, SESSION], source_priority(preferred), pick="min")


def trailing_sessions(bars: DataFrame, limit: int) -> DataFrame:
    """The newest ``limit`` distinct sessions of each entity."""
    w = Window.partitionBy(ENTITY).orderBy(F.col(SESSION).desc())
    return bars.withColumn("recency", F.dense_rank().over(w)).where(F.col("recency") <= limit)


def valid_bar(open_: str = "open", high: str = "high", low: str = "low", close: str = "close", volume: str = "volume") -> Column:
    """Positive finite prices, high above and low below both open and close, volume not negative.

    Optional fields that are absent are not checked; fields that are present
    but unusable make the bar invalid.
    """
    c, o, h, l, v = (F.col(x) for x in (close, open_, high, low, volume))
    usable = lambda x: x.isNull() | positive(x).isNotNull()
    return (
        positive(c).isNotNull()
        & usable(o)
        & usable(h)
        & usable(l)
        & F.coalesce(h >= F.greatest(c, o), F.lit(True))
        & F.coalesce(l <= F.least(c, o), F.lit(True))
        & (v.isNull() | F.coalesce(finite(v) >= 0, F.lit(False)))
    )


def missing_sessions(bars: DataFrame, calendar: DataFrame) -> DataFrame:
    """Every session an entity lacks between its own first and last bar.

    The holes come from the jump to the entity's next session ordinal, so the
    work follows the holes and not entities times sessions.
    """
    numbered = bars.select(ENTITY, SESSION).distinct().join(F.broadcast(calendar), SESSION)
    nxt = F.lead("session_no").over(Window.partitionBy(ENTITY).orderBy("session_no"))
    holes = (
        numbered.withColumn("_next", nxt)
        .where(F.col("_next") > F.col("session_no") + 1)
        .select(ENTITY, F.explode(F.sequence(F.col("session_no") + 1, F.col("_next") - 1)).alias("session_no"))
    )
    return holes.join(F.broadcast(calendar), "session_no").select(ENTITY, SESSION, "session_no")


def gap_audit(bars: DataFrame, calendar: DataFrame) -> DataFrame:
    """Per entity with holes: first and last missing session and their number."""
    return missing_sessions(bars, calendar).groupBy(ENTITY).agg(
        F.min(SESSION).alias("first_missing"), F.max(SESSION).alias("last_missing"), F.count("*").alias("missing_sessions")
    )


def fetch_plan(bars: DataFrame, calendar: DataFrame) -> DataFrame:
    """Where to resume collection: the first hole, else the day after the newest bar."""
    newest = bars.groupBy(ENTITY).agg(F.max(SESSION).alias("last_date"))
    holes = gap_audit(bars, calendar).select(ENTITY, "first_missing")
    return newest.join(holes, ENTITY, "left").select(
        ENTITY, "last_date", "first_missing", F.least("first_missing", F.date_add("last_date", 1)).alias("fetch_from")
    )


def overlap_check(reference: DataFrame, fallback: DataFrame, tolerance: float) -> DataFrame:
    """Sessions both sources hold, with whether the closes agree within ``tolerance``."""
    ref = reference.select(ENTITY, SESSION, F.col("close").alias("reference_close"))
    fb = fallback.select(ENTITY, SESSION, F.col("close").alias("fallback_close"))
    return ref.join(fb, [ENTITY, SESSION]).withColumn(
        "agrees", F.abs(F.col("fallback_close") / F.col("reference_close") - 1) <= tolerance
    )


def corroborated_fill(
    reference: DataFrame, fallback: DataFrame, calendar: DataFrame, tolerance: float = 0.001, anchor_days: int = 7
) -> DataFrame:
    """Fallback bars that may fill a hole of the reference.

    An entity is eligible only if every overlapping close agrees, and a hole is
    filled only between agreeing closes at most ``anchor_days`` away on both
    sides.  The nearest anchors come from one pass over the entity's sessions.
    """
    overlap = overlap_check(reference, fallback, tolerance)
    trusted = overlap.groupBy(ENTITY).agg(F.bool_and("agrees").alias("ok")).where("ok").select(ENTITY)
    holes = (
        fallback.where(valid_bar())
        .join(F.broadcast(calendar.select(SESSION)), SESSION, "left_semi")
        .join(reference.select(ENTITY, SESSION), [ENTITY, SESSION], "left_anti")
        .join(trusted, ENTITY, "left_semi")
        .select(ENTITY, SESSION, "source", "close")
    )
    anchors = overlap.join(trusted, ENTITY, "left_semi").select(
        ENTITY, SESSION, F.lit(None).cast("string").alias("source"), F.lit(None).cast("double").alias("close"), F.col(SESSION).alias("_anchor")
    )
    w = Window.partitionBy(ENTITY).orderBy(SESSION)
    before = F.last("_anchor", True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    # Descending order keeps the look-ahead a running frame too.
    back = Window.partitionBy(ENTITY).orderBy(F.col(SESSION).desc())
    after = F.last("_anchor", True).over(back.rowsBetween(Window.unboundedPreceding, -1))
    return (
        anchors.unionByName(holes.withColumn("_anchor", F.lit(None).cast("date")))
        .withColumn("anchor_before", before)
        .withColumn("anchor_after", after)
        .where(
            F.col("_anchor").isNull()
            & (F.datediff(SESSION, "anchor_before") <= anchor_days)
            & (F.datediff("anchor_after", SESSION) <= anchor_days)
        )
        .drop("_anchor")
    )
