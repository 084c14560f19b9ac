"""Coverage, freshness, label-quality and readiness audits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import round_half_up
from tidemark.operators.latest import latest_row


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows per violated rule, all rules in one pass; a rule that is unknown for a row is not violated."""
    aggs = [F.count_if(~F.coalesce(ok, F.lit(True))).alias(name) for name, ok in rules.items()]
    one = df.agg(*aggs)
    pairs = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("violations")) for n in rules])
    return one.select(F.inline(pairs))


def field_coverage(df: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """Known values per field and rows complete in all of them, in one pass."""
    complete = reduce(lambda a, b: a & b, [F.col(f).isNotNull() for f in fields])
    one = df.agg(F.count("*").alias("_rows"), F.count_if(complete).alias("_complete"), *[F.count(f).alias(f) for f in fields])
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("known")) for f in fields], F.struct(F.lit("all_fields").alias("field"), F.col("_complete").alias("known")))
    return one.select(F.inline(pairs), F.col("_rows").alias("total"))


def label_mismatches(stored: DataFrame, expected: DataFrame, keys: list[str], tolerance: float = 1e-8) -> DataFrame:
    """Labels whose stored value or direction differs from the recomputed one; null differs from any value."""
    j = expected.join(stored, keys)
    e, s, d = F.col("expected"), F.col("stored"), F.col("direction")
    close = F.when(e.isNull() | s.isNull(), e.isNull() & s.isNull()).otherwise(F.abs(e - s) <= tolerance)
    return j.withColumn("mismatch", ~close | ~d.eqNullSafe(e > 0))


def repairs(checked: DataFrame, keys: list[str], horizons: tuple[int, ...]) -> DataFrame:
    """Rows with any mismatch and the labels they should hold, one column per horizon."""
    out = checked.groupBy(*keys).agg(
        F.bool_or("mismatch").alias("_bad"), *[F.max(F.when(F.col("horizon") == h, F.col("expected"))).alias(f"expected_{h}") for h in horizons]
    )
    return out.where("_bad").drop("_bad")


def freshness(universe: DataFrame, prices: DataFrame, features: DataFrame, expected: Column) -> DataFrame:
    """Each entity with whether a usable price and feature row exist on the expected session."""
    usable = lambda df: df.where((F.col("session_date") == expected) & (F.col("close") > 0)).select("entity_id").distinct()
    return (
        universe.join(usable(prices).withColumn("_p", F.lit(True)), "entity_id", "left")
        .join(usable(features).withColumn("_f", F.lit(True)), "entity_id", "left")
        .select("entity_id", "ticker", "sector", F.coalesce("_p", F.lit(False)).alias("price_ok"), F.coalesce("_f", F.lit(False)).alias("feature_ok"))
    )


def left_join_all(base: DataFrame, key: str, parts: list[DataFrame]) -> DataFrame:
    """One row per key with the columns of many per-key aggregates."""
    return reduce(lambda a, b: a.join(b, key, "left"), parts, base)


def status_matrix(long: DataFrame, statuses: list[str]) -> DataFrame:
    """Family by status counts with the share that is covered."""
    m = long.groupBy("family").pivot("status", statuses).count().na.fill(0)
    covered = F.col("current") + F.col("observed")
    return m.withColumn("covered", covered).withColumn("total", reduce(lambda a, b: a + b, [F.col(s) for s in statuses]))


def layer_percentages(counts: DataFrame, total: Column) -> DataFrame:
    pct = F.floor(F.lit(1000.0) * F.col("entities") / total + 0.5) / 10
    return counts.withColumn("coverage_pct", pct).withColumn("status", F.when(pct >= 95, "strong").otherwise("partial"))


def latest_runs(runs: DataFrame) -> DataFrame:
    return latest_row(runs, ["pipeline"], "started_at", "run_id")


def recent(ts: str, clock: Column, hours: int) -> Column:
    """Not in the future and at most ``hours`` old; an unknown time is not recent."""
    t = F.col(ts)
    return F.coalesce((t <= clock) & (t >= clock - F.expr(f"interval {hours} hours")), F.lit(False))


def execution_status(lease_hours: int, clock: Column) -> Column:
    """A run still open after its lease counts as interrupted."""
    late = F.col("started_at") < clock - F.expr(f"interval {lease_hours} hours")
    return F.when((F.col("status") == "running") & late, "interrupted").otherwise(F.col("status"))


def deadline_outcomes(runs: DataFrame, zone: str, hour: int) -> DataFrame:
    """Per local day: first start, first success by the deadline, and whether it was met."""
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), F.col("started_at"))
    done = F.convert_timezone(F.lit("UTC"), F.lit(zone), F.col("finished_at"))
    in_time = (F.col("status") == "success") & (done <= F.to_date(local).cast("timestamp_ntz") + F.expr(f"interval {hour} hours"))
    return (
        runs.withColumn("local_day", F.to_date(local))
        .groupBy("local_day")
        .agg(F.min("started_at").alias("first_started_at"), F.min(F.when(in_time, F.col("finished_at"))).alias("completed_by_deadline"))
        .withColumn("on_time", F.col("completed_by_deadline").isNotNull())
    )


def weekly_decision(signal: Column, publication: Column, previous: Column, latest_market: Column) -> Column:
    """Publish once per Sunday week and only from the newest market session of the last three days."""
    week = lambda d: F.date_sub(d, F.dayofweek(d) - 1)
    return (
        F.when(publication.isNull(), "market_session_unavailable")
        .when(F.dayofweek(publication) != 1, "not_due")
        .when(week(previous) >= week(publication), "not_due")
        .when(
            signal.isNull() | ~signal.eqNullSafe(latest_market) | (signal < F.date_sub(publication, 3)) | (signal >= publication),
            "market_session_unavailable",
        )
        .otherwise("due")
    )


def fingerprint(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Row count and two order-independent digests of the table or of each group."""
    h = F.xxhash64(*df.columns)
    # The low half is summed, so the total cannot overflow.
    aggs = [F.count("*").alias("rows"), F.bit_xor(h).alias("xor_digest"), F.sum(F.pmod(h, F.lit(2**31))).alias("sum_digest")]
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def portable_fingerprint(df: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """Row count and digests that any engine with MD5 can repeat: over the columns as text, joined, null as empty."""
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    h = F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long")
    return df.groupBy(*by).agg(F.count("*").alias("rows"), F.bit_xor(h).alias("xor_digest"), F.sum(F.pmod(h, F.lit(2**31))).alias("sum_digest"))


def archive_gaps(expiring: DataFrame, copies: list[DataFrame], keys: list[str]) -> DataFrame:
    """Expiring rows missing from, or different in, any of the archive copies."""
    digest = lambda d: d.select(*keys, F.md5(F.to_json(F.struct(*sorted(expiring.columns))).cast("binary")).alias("digest"))
    want = digest(expiring)
    missing = [want.join(digest(c), [*keys, "digest"], "left_anti").withColumn("copy", F.lit(i)) for i, c in enumerate(copies)]
    return reduce(lambda a, b: a.unionByName(b), missing)


def validated_horizons(metrics: DataFrame, keys: list[str], min_rows: int = 1000) -> DataFrame:
    """Horizons that beat their baseline in selection and holdout, kept only if at least two do."""
    ok = (
        (F.col("selection_brier") < F.col("selection_baseline_brier")) & (F.col("brier") < F.col("baseline_brier")) & (F.col("oof_rows") >= min_rows)
    )
    good = metrics.where(ok)
    enough = good.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") >= 2).select(*keys)
    return good.join(enough, keys, "left_semi")


def refresh_floor(total: Column, successful: Column, with_ttm: Column, with_fcf: Column) -> Column:
    """True when enough of the universe was refreshed (90 / 70 / 50 %)."""
    return F.coalesce((total > 0) & (successful / total >= 0.9) & (with_ttm / total >= 0.7) & (with_fcf / total >= 0.5), F.lit(False))


def usable_shares(rows: DataFrame, by: list[str], features: list[str]) -> DataFrame:
    """How many rows there are, and the share of them that states each feature."""
    share = lambda c: round_half_up(F.avg(F.col(c).isNotNull().cast("int")), 6).alias(f"usable_{c}")
    return rows.groupBy(*by).agg(F.count("*").alias("entities"), *[share(c) for c in features])


#: Source families and their order, the statuses an entity can have in one, and those that count as covered.
FAMILIES = ("market", "financials", "valuation", "earnings", "upcoming", "analyst", "estimates", "revisions", "disclosures", "news", "guidance", "actions", "calls", "ownership", "macro")
COVERAGE = ("current", "observed", "partial", "building", "pending", "stale", "unknown", "unavailable", "not_collected", "missing")
COVERED = ("current", "observed")


def entity_coverage(inventory: DataFrame, clock: Column, market_date: Column, entity: str = "entity_id") -> DataFrame:
    """(entity, family, status) for all fifteen families, from one inventory row per entity.

    The inventory states dates, counts and outcomes of collection checks; a
    column that it lacks is unknown or zero.  What was not found is ``missing``
    only where a complete source would have it; where sources are incomplete it
    is ``unknown``, and ``not_collected`` where nobody has looked.  Expressions
    on a row: no join, no shuffle.
    """
    has = lambda c: F.col(c) if c in inventory.columns else F.lit(None)
    n = lambda c: F.coalesce(has(c).cast("long"), F.lit(0))
    fresh = lambda c, hours: recent(c, clock, hours) if c in inventory.columns else F.lit(False)
    on_date = lambda c: F.coalesce(has(c).cast("date") == market_date, F.lit(False))
    audited = F.coalesce(has("audit_status") == "current", F.lit(False)) & fresh("audit_at", 30)
    rules = {
        "market": F.when(on_date("price_date") & on_date("feature_date"), "current").when(has("price_date").isNotNull(), "stale").otherwise("missing"),
        "financials": F.when(audited & (n("missing_fields") > 0), "partial").when(audited, "current").when(n("statements") > 0, "stale").otherwise("missing"),
        "valuation": F.when(on_date("valuation_date"), "current").when(has("valuation_date").isNotNull(), "stale").otherwise("missing"),
        "earnings": F.when(has("reported_date").isNotNull(), "observed").otherwise("missing"),
        "upcoming": F.when(has("calendar_status") == "current", "current").otherwise("unknown"),
        "analyst": F.when((n("analysts") >= 3) & fresh("analyst_at", 7 * 24), "current").when(n("analysts") > 0, "partial").otherwise("missing"),
        "estimates": F.when((n("eps_periods") > 0) & (n("revenue_periods") > 0) & (n("inconsistent_periods") == 0) & fresh("estimates_at", 48), "current")
        .when((n("eps_periods") > 0) | (n("revenue_periods") > 0), "partial").when(has("estimates_at").isNotNull(), "stale").otherwise("missing"),
        "revisions": F.when(n("estimate_days") >= 2, "partial").when(n("estimate_days") > 0, "building").otherwise("missing"),
        "disclosures": F.when(n("reports_90d") > 0, "observed").otherwise("unknown"),
        "news": F.when(n("articles_90d") > 0, "observed").otherwise("unknown"),
        "guidance": F.when(n("guidance_90d") > 0, "partial").when(n("releases_pending") + n("release_errors") > 0, "pending").otherwise("unknown"),
        "actions": F.when((n("actions") > 0) | has("total_return_date").isNotNull() | (n("action_checks_ok") > 0), "partial").when(n("action_checks") > 0, "unavailable").otherwise("missing"),
        "calls": F.when(n("call_documents") > 0, "partial").when(n("call_checks") > 0, "unknown").otherwise("not_collected"),
        "ownership": F.when(n("holdings") + n("insiders") > 0, "partial").when(n("insiders_pending") > 0, "pending").when(n("owner_checks") > 0, "unknown").otherwise("not_collected"),
        "macro": F.when(n("fresh_series") > 0, "partial").when(n("macro_checks") > 0, "unavailable").otherwise("not_collected"),
    }
    return inventory.select(entity, F.inline(F.array(*[F.struct(F.lit(f).alias("family"), rules[f].alias("status")) for f in FAMILIES])))


def coverage_summary(coverage: DataFrame) -> DataFrame:
    """Per family the entities of each status, those covered and all."""
    counts = [F.count_if(F.col("status") == s).alias(s) for s in COVERAGE]
    return coverage.groupBy("family").agg(*counts, F.count_if(F.col("status").isin(*COVERED)).alias("covered"), F.count("*").alias("total"))
