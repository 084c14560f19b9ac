"""Row scores and status machines; unknown inputs drop out or are named, never guessed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import clip, midpoint, relative_change, round_half_up, weighted_available
from tidemark.operators.fundamentals import anomalies

# Weights of the composite score.
COMPOSITE_WEIGHTS = {"fundamentals": 0.25, "valuation": 0.15, "earnings": 0.20, "momentum": 0.10, "news": 0.15, "catalysts": 0.15}


def mean_score(parts: list[Column]) -> tuple[Column, Column]:
    """Mean of the known parts clipped to 0-100, and the share known in percent."""
    clipped = [clip(p, 0.0, 100.0) for p in parts]
    value, weight = weighted_available([(p, 1.0) for p in clipped])
    return round_half_up(value, 1), round_half_up(weight / len(parts) * 100, 1)


def fundamentals_score(growth: Column, margin: Column, margin_change: Column, fcf_margin: Column, leverage: Column) -> tuple[Column, Column]:
    return mean_score([growth * 250 + 50, margin * 150 + 40, margin_change * 500 + 50, fcf_margin * 200 + 40, F.lit(75.0) - leverage * 10])


def revision_score(revenue: Column, eps: Column) -> tuple[Column, Column]:
    return mean_score([revenue * 1000 + 50, eps * 750 + 50])


def composite(scores: dict[str, Column]) -> Column:
    return round_half_up(reduce(lambda a, b: a + b, [scores[k] * w for k, w in COMPOSITE_WEIGHTS.items()]), 1)


def research_priority(fundamentals: Column, earnings: Column, pe: Column, prev_pe: Column, pfcf: Column, prev_pfcf: Column) -> tuple[Column, Column]:
    """How much changed, over the components that can be compared."""
    moved = lambda now, old: F.when((old != 0) & now.isNotNull(), F.least(F.lit(100.0), F.abs(now / old - 1) * 500))
    parts = [(F.abs(fundamentals - 50) * 2, 0.25), (F.abs(earnings - 50) * 2, 0.40), (moved(pe, prev_pe), 0.20), (moved(pfcf, prev_pfcf), 0.15)]
    value, weight = weighted_available(parts)
    return round_half_up(value, 1), round_half_up(weight * 100, 1)


def event_signals(prefix: str = "") -> dict[str, Column]:
    """Guidance against consensus and against the previous guidance, by metric."""
    out = {}
    for m in ("eps", "revenue"):
        now = midpoint(f"{prefix}{m}_guidance_low", f"{prefix}{m}_guidance_high")
        old = midpoint(f"{prefix}previous_{m}_guidance_low", f"{prefix}previous_{m}_guidance_high")
        out[f"guidance_{m}_vs_consensus"] = relative_change(now, F.col(f"{prefix}consensus_{m}_at_event"))
        out[f"{m}_guidance_change"] = relative_change(now, old)
    return out


def fair_value(eps: Column, *peer_multiples: Column) -> list[Column]:
    """Low, base and high value from peer multiples; all inputs known and earnings above zero."""
    known = reduce(lambda a, b: a & b, [m.isNotNull() for m in peer_multiples]) & (eps > 0)
    return [F.when(known, round_half_up(eps * m, 2)) for m in peer_multiples]


def quality_status(asof: Column, max_age: int = 180) -> Column:
    """Where an entity's statements stand against its latest filing, first problem first.

    Columns: expected_period, expected_filed (the filing list), parsed_period,
    ttm_period, ttm_filed and the statement values.
    """
    age = F.datediff(asof, "ttm_period")
    return (
        F.when(F.col("expected_period").isNull(), "filing_check_unavailable")
        .when(F.col("parsed_period").isNull() | (F.col("parsed_period") < F.col("expected_period")), "extraction_behind_latest_filing")
        .when(F.col("ttm_period").isNull(), "insufficient_ttm_history")
        .when((F.col("ttm_period") < F.col("expected_period")) | F.coalesce(F.col("ttm_filed") < F.col("expected_filed"), F.lit(False)), "ttm_behind_latest_filing")
        .when(~age.between(0, max_age), "ttm_period_old")
        .when(F.size(anomalies()) > 0, "financial_values_require_review")
        .otherwise("current")
    )


def calendar_status(rows: DataFrame, entities: DataFrame, clock: Column, today: Column, hours: int = 48) -> DataFrame:
    """current where a fresh observation names a date that has not passed, else unknown."""
    fresh = rows.where((F.col("observed_at") <= clock) & (F.col("observed_at") >= clock - F.expr(f"interval {hours} hours")))
    ahead = fresh.withColumn("_today", today).withColumn("_next", F.array_min(F.filter("dates", lambda d: d >= F.col("_today")))).where(F.col("_next").isNotNull())
    best = ahead.groupBy("entity_id").agg(F.min("_next").alias("reported_date"), F.max("observed_at").alias("calendar_observed_at"))
    return entities.select("entity_id").join(best, "entity_id", "left").withColumn(
        "calendar_status", F.when(F.col("reported_date").isNotNull(), "current").otherwise("unknown")
    )


def reusable(rows: DataFrame, clock: Column, last_close: Column, today: Column, hours: int = 4) -> DataFrame:
    """Cached observations young enough, taken after the last close, with a date still ahead."""
    young = (F.col("observed_at") >= clock - F.expr(f"interval {hours} hours")) & (F.col("observed_at") <= clock)
    seen = rows.withColumn("_today", today).where(young & (F.col("observed_at") > last_close))
    return seen.where(F.exists("dates", lambda d: d >= F.col("_today"))).drop("_today")


def newest_whole_groups(df: DataFrame, group: str, order: list[Column], limit: int) -> DataFrame:
    """The newest rows up to a limit, with the oldest group shown completed."""
    oldest = df.orderBy(F.col(group).desc(), *order).limit(limit).agg(F.min(group)).scalar()
    return df.where(F.col(group) >= oldest)


def provider_month(today: Column, label: Column) -> Column:
    """First of the month a relative label (0m … -3m) names; other labels name none."""
    back = F.when(label.isin("0m", "-1m", "-2m", "-3m"), F.regexp_extract(label, r"(\d)", 1).cast("int"))
    return F.add_months(F.trunc(today, "month"), -back)


def projected_date(dates: Column, today: Column, horizon_days: int = 400) -> Column:
    """The one projected date of a list, if it lies ahead within the horizon."""
    only = F.when(F.size(dates) == 1, F.element_at(dates, 1))
    return F.when((only >= today) & (only <= F.date_add(today, horizon_days)), only)


def evidence(lines: list[tuple[Column, Column]]) -> Column:
    """Sentences whose condition holds."""
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), text) for c, text in lines]))


def valid_horizons(horizons: Column, allowed: tuple[int, ...]) -> Column:
    """Every horizon is an allowed one and none is there twice."""
    return F.forall(horizons, lambda h: h.isin(*allowed)) & (F.size(F.array_distinct(horizons)) == F.size(horizons))
