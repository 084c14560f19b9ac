"""Analyst consensus, estimates and guidance as of a decision."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import finite, r4, revision
from tidemark.operators.asof import asof_best, window_join

COUNTS = ("strong_buy", "buy", "hold", "sell", "strong_sell")
# Points per opinion and limits.
POINTS = (100, 75, 50, 25, 0)
MAX_CAPTURE_AGE_DAYS, MAX_PERIOD_AGE_DAYS, MIN_ANALYSTS, SHRINKAGE = 7, 45, 3, 5


def valid_counts() -> Column:
    """All five opinions present, whole and not negative."""
    return reduce(lambda a, b: a & b, [F.coalesce((F.col(c) >= 0) & (F.floor(c) == F.col(c)), F.lit(False)) for c in COUNTS])


def consensus_asof(decisions: DataFrame, snapshots: DataFrame, cutoff: str, prefix: str = "") -> DataFrame:
    """Consensus score of the newest snapshot captured by the cutoff.

    The newest capture stands even when it is unusable: an older, better one is
    never revived.  The mean is shrunk to neutral by n / (n + 5), and anything
    but a current score is neutral 50 with its status.
    """
    seen = snapshots.where(F.col("period_date") <= F.to_date("observed_at"))
    df = asof_best(decisions, seen, ["entity_id"], cutoff, "observed_at", ["observed_at", "period_date", "source", *COUNTS], best=["observed_at", "period_date", "source"])
    total = reduce(lambda a, b: a + b, [F.col(c) for c in COUNTS])
    raw = reduce(lambda a, b: a + b, [F.col(c) * p for c, p in zip(COUNTS, POINTS)]) / total
    status = (
        F.when(F.col("observed_at").isNull(), "missing")
        .when(F.col("observed_at") < F.col(cutoff) - F.expr(f"interval {MAX_CAPTURE_AGE_DAYS} days"), "stale_capture")
        .when(F.datediff(F.to_date(cutoff), "period_date") > MAX_PERIOD_AGE_DAYS, "stale_provider_period")
        .when(~valid_counts(), "invalid_counts")
        .when(total < MIN_ANALYSTS, "insufficient_analysts")
        .otherwise("current")
    )
    df = df.withColumns({"_status": status, "_total": total})
    current = F.col("_status") == "current"
    score = F.when(current, r4(F.lit(50.0) + (raw - 50) * F.col("_total") / (F.col("_total") + SHRINKAGE))).otherwise(50.0)
    return df.select(
        *decisions.columns,
        score.alias(f"{prefix}analyst_score"),
        F.col("_status").alias(f"{prefix}analyst_status"),
        F.when(current, F.col("_total")).alias(f"{prefix}analyst_count"),
        F.when(current, (F.col("strong_buy") + F.col("buy")) / F.col("_total")).alias(f"{prefix}buy_share"),
    )


def consensus_change(decisions: DataFrame, snapshots: DataFrame, cutoff: str, days: int = 30) -> DataFrame:
    """Current consensus and its change against the one known ``days`` earlier, if both are current."""
    now = consensus_asof(decisions, snapshots, cutoff).withColumn("_earlier", F.col(cutoff) - F.expr(f"interval {days} days"))
    both = consensus_asof(now, snapshots, "_earlier", prefix="prior_")
    ok = (F.col("analyst_status") == "current") & (F.col("prior_analyst_status") == "current")
    change = F.when(ok, F.col("analyst_score") - F.col("prior_analyst_score"))
    return both.withColumn(f"analyst_score_change_{days}d", change).drop("_earlier")


def estimate_revisions(decisions: DataFrame, estimates: DataFrame, cutoff: str, lags: tuple[int, ...] = (7, 30), max_age: int = 7) -> DataFrame:
    """Change of the estimate of one fiscal target against the same target's estimate some days before.

    The target is picked among the captures of the newest capture day (nearest
    quarter first), so a target that vanished from it is not revived.  A
    revision needs the same source, target, type and currency, and a prior
    capture no more than a week older than the lag.
    """
    e = estimates.withColumn("_day", F.to_date("captured_at"))
    pick = F.struct(
        F.when(F.col("relative_period") == "0q", 0).otherwise(1).alias("a"),
        F.when(F.col("period_type") == "quarter", 0).otherwise(1).alias("b"),
        F.col("fiscal_period_end"),
        F.col("source"),
        F.col("period_type"),
    )
    # The preferred target among the captures of the same day seen so far.
    so_far = Window.partitionBy("entity_id", "_day").orderBy("captured_at")
    days = e.select("entity_id", F.col("captured_at").alias("_newest"), F.min(pick).over(so_far).alias("target")).distinct()
    df = asof_best(decisions, days, ["entity_id"], cutoff, "_newest", ["target", "_newest"], best=["_newest"])
    df = df.select(*decisions.columns, "target.source", "target.fiscal_period_end", "target.period_type", "_newest")
    target = ["entity_id", "source", "fiscal_period_end", "period_type"]
    value = ["captured_at", "eps_consensus", "revenue_consensus", "eps_currency", "revenue_currency", "eps_basis", "issues"]
    hist = e.select(*target, *value)
    out = asof_best(df, hist, target, cutoff, "captured_at", value, prefix="now_")
    fresh = F.coalesce(F.col("now_captured_at") >= F.col(cutoff) - F.expr(f"interval {max_age} days"), F.lit(False))
    added = []
    for lag in lags:
        out = out.withColumn("_ask", F.col(cutoff) - F.expr(f"interval {lag} days"))
        out = asof_best(out, hist, target, "_ask", "captured_at", value, prefix=f"p{lag}_")
        recent = F.coalesce(F.col(f"p{lag}_captured_at") >= F.col(cutoff) - F.expr(f"interval {lag + 7} days"), F.lit(False))
        for metric in ("eps", "revenue"):
            cur, old = (lambda f: F.col(f"now_{f}")), (lambda f, n=lag: F.col(f"p{n}_{f}"))
            ok = fresh & recent & (cur(f"{metric}_currency") == old(f"{metric}_currency"))
            outside = f"{metric}_consensus_outside_interval"
            ok = ok & ~F.array_contains(cur("issues"), outside) & ~F.array_contains(old("issues"), outside)
            if metric == "eps":
                ok = ok & cur("eps_basis").isin("gaap", "adjusted", "non-gaap") & (cur("eps_basis") == old("eps_basis"))
            name = f"estimate_{metric}_revision_{lag}d"
            out = out.withColumn(name, F.when(ok, revision(finite(cur(f"{metric}_consensus")), finite(old(f"{metric}_consensus")))))
            added.append(name)
    return out.select(*decisions.columns, "fiscal_period_end", F.when(fresh, F.col("now_captured_at")).alias("captured_at"), *added)


def normalize_estimates(raw: DataFrame) -> DataFrame:
    """Explicit basis and currency, reversed intervals dropped, problems listed.

    ``raw``: eps/revenue consensus, low, high, analyst_count and currency plus
    ``basis_record`` and ``basis_eps``, the basis labels the provider states.
    """
    # Accepted spellings of an accounting basis.
    names = {"gaap": "gaap", "us-gaap": "gaap", "non-gaap": "adjusted", "non gaap": "adjusted", "adjusted": "adjusted", "normalized": "adjusted"}
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    label = lambda c: F.try_element_at(table, F.lower(F.trim(c)))
    stated = F.array_distinct(F.array_compact(F.array(label("basis_eps"), label("basis_record"))))
    basis = F.when(F.size(stated) == 1, F.element_at(stated, 1)).otherwise("unknown")
    cols: dict[str, Column] = {"eps_basis": basis}
    issues = []
    for m in ("eps", "revenue"):
        lo, hi, avg = finite(f"{m}_low"), finite(f"{m}_high"), finite(f"{m}_consensus")
        reversed_ = F.coalesce(lo > hi, F.lit(False))
        cur = F.upper(F.trim(f"{m}_currency"))
        count = finite(f"{m}_analyst_count")
        cols |= {
            f"{m}_consensus": avg,
            f"{m}_low": F.when(~reversed_, lo),
            f"{m}_high": F.when(~reversed_, hi),
            f"{m}_currency": F.when(cur.rlike("^[A-Z]{3}$"), cur),
            f"{m}_analyst_count": F.when((count >= 0) & (F.floor(count) == count), count.cast("long")),
        }
        low, high = F.col(f"{m}_low"), F.col(f"{m}_high")
        outside = F.coalesce(F.col(f"{m}_consensus") < low, F.lit(False)) | F.coalesce(F.col(f"{m}_consensus") > high, F.lit(False))
        issues += [F.when(outside, F.lit(f"{m}_consensus_outside_interval")), F.when(F.col(f"{m}_currency").isNull(), F.lit(f"{m}_currency_unknown"))]
    issues.append(F.when(F.col("eps_basis") == "unknown", F.lit("eps_basis_unknown")))
    return raw.withColumns(cols).where(F.col("eps_consensus").isNotNull() | F.col("revenue_consensus").isNotNull()).withColumn("issues", F.array_compact(F.array(*issues)))


def match_guidance(guidance: DataFrame, estimates: DataFrame, days: int = 7) -> DataFrame:
    """Guidance ranges against the last comparable estimate captured in the week before publication.

    Comparable: same entity, fiscal end, period type and currency, for earnings
    per share also the same stated basis, and no interval problem.
    """
    g, e = guidance, estimates.withColumn("_cap_day", F.to_date("captured_at"))
    basis = F.when(F.lower("eps_method") == "gaap", "gaap").when(F.lower("eps_method").isin("adjusted", "non-gaap"), "adjusted")
    sides = []
    for m in ("eps", "revenue"):
        one = g.where((F.col(f"{m}_guidance_low") <= F.col(f"{m}_guidance_high")) & F.col("currency").isNotNull()).select(
            "entity_id", "guidance_id", "published_at", F.to_date("published_at").alias("_pub_day"), "fiscal_period_end", "period_type",
            F.lit(m).alias("metric"), F.col("currency"), (basis if m == "eps" else F.lit("reported_revenue")).alias("accounting_basis"),
            ((F.col(f"{m}_guidance_low") + F.col(f"{m}_guidance_high")) / 2).alias("midpoint"),
        ).where(F.col("accounting_basis").isNotNull())
        sides.append(one)
    asks = sides[0].unionByName(sides[1])
    offers = None
    for m in ("eps", "revenue"):
        ok = ~F.array_contains("issues", f"{m}_consensus_outside_interval") & F.col(f"{m}_consensus").isNotNull()
        o = e.where(ok).select(
            "entity_id", "estimate_id", "captured_at", "_cap_day", "fiscal_period_end", "period_type", F.lit(m).alias("metric"), F.col(f"{m}_currency").alias("currency"),
            (F.col("eps_basis") if m == "eps" else F.lit("reported_revenue")).alias("accounting_basis"), F.col(f"{m}_consensus").alias("consensus"),
        )
        offers = o if offers is None else offers.unionByName(o)
    keys = ["entity_id", "fiscal_period_end", "period_type", "metric", "currency", "accounting_basis"]
    pairs = window_join(asks, offers, keys, "_pub_day", "_cap_day", -days, 0).where(
        (F.col("captured_at") < F.col("published_at")) & (F.col("captured_at") >= F.col("published_at") - F.expr(f"interval {days} days"))
    )
    newest = F.max_by(F.struct("estimate_id", "consensus", "captured_at"), F.struct("captured_at", "estimate_id"))
    out = pairs.groupBy(*keys, "guidance_id", "published_at", "midpoint").agg(newest.alias("e"))
    return out.select("guidance_id", *keys, "midpoint", "e.*")


def merge_guidance_asof(decisions: DataFrame, guidance: DataFrame, cutoff: str, values: list[str]) -> DataFrame:
    """Newest usable release, its fields filled from the other usable rows of the same release.

    Rows of one release share entity, event date and fiscal period; a field
    takes its latest captured known value.  The chain of rows of one release is
    folded before the lookup, so the lookup itself is a plain as-of.
    """
    release = ["entity_id", "event_date", "fiscal_year", "fiscal_period"]
    w = Window.partitionBy(*release).orderBy("usable_at", "guidance_id").rowsBetween(Window.unboundedPreceding, 0)
    folded = guidance.select(*release, "usable_at", "guidance_id", *[F.last(v, ignorenulls=True).over(w).alias(v) for v in values])
    out = asof_best(
        decisions, folded, ["entity_id"], cutoff, "usable_at", ["event_date", *values], best=["event_date", "usable_at", "guidance_id"]
    )
    return out.withColumn("guidance_days_since", F.datediff(F.to_date(cutoff), "event_date"))
