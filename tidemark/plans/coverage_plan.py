"""Coverage of all entities over fifteen source families, from one inventory of what the tables hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import audit as U
from tidemark.operators.latest import latest_row
from tidemark.plans.ctes import cte
from tidemark.plans.evaluation import actions, based_panel
from tidemark.plans.observations import estimates, guidance, macro_latest
from tidemark.plans.registry import query
from tidemark.plans.tables import Tables


def full_inventory(t: Tables) -> DataFrame:
    """One row per entity: dates and counts of all that the tables hold about it, seen from the last decision.

    Events stand for news and conversations for calls, dealt to entities by id;
    the age of a filing audit and of a report calendar follow the entity's number.
    """
    last = t.panel.agg(F.max("session_date")).scalar()
    clock = last.cast("timestamp_ntz") + F.expr("interval 21 hours")
    day = F.to_date(clock)
    n_entities = t.entities.agg(F.count("*")).scalar()
    per = lambda df, *aggs: df.groupBy("entity_id").agg(*aggs)
    dealt = lambda df, key: df.select((F.col(key) % n_entities).cast("long").alias("entity_id"))
    opinions = latest_row(t.analyst_snapshots, ["entity_id"], "observed_at")
    e = estimates(t).where(F.col("captured_at") <= clock)
    now = F.col("captured_at") >= clock - F.expr("interval 7 days")
    q = t.quarter_statements.where(F.col("filed_date") <= day)
    parts = [
        per(t.panel, F.max("session_date").alias("price_date")), per(t.features, F.max("session_date").alias("feature_date")),
        per(t.ttm, F.count("*").alias("statements"), F.max("period_end").alias("newest_period"), F.sum(F.col("eps_diluted").isNull().cast("int")).alias("missing_fields")),
        per(t.earnings_versions.where(F.col("reported_eps").isNotNull()), F.max("reported_date").alias("reported_date")),
        opinions.select("entity_id", F.col("observed_at").alias("analyst_at"), (F.col("strong_buy") + F.col("buy") + F.col("hold") + F.col("sell") + F.col("strong_sell")).alias("analysts")),
        per(e, F.max("captured_at").alias("estimates_at"), F.countDistinct(F.to_date("captured_at")).alias("estimate_days"), F.count_if(now & F.col("eps_consensus").isNotNull()).alias("eps_periods"), F.count_if(now & F.col("revenue_consensus").isNotNull()).alias("revenue_periods")),
        per(q, F.count_if(F.col("filed_date") > F.date_sub(day, 90)).alias("reports_90d"), F.max("filed_date").alias("_filed"), F.count_if((F.col("entity_id") % 3 != 0) & F.col("eps_diluted").isNotNull()).alias("insiders")),
        per(guidance(t).where(F.col("published_at") <= clock), F.count_if(F.col("published_at") > clock - F.expr("interval 90 days")).alias("guidance_90d")),
        per(actions(t).where(F.col("event_date") <= day), F.count("*").alias("actions")), per(based_panel(t).where("basis = 'total' AND close IS NOT NULL"), F.max("session_date").alias("total_return_date")),
        per(dealt(t.raw("events"), "user_id"), F.count("*").alias("articles_90d")), per(dealt(t.raw("conversations"), "conv_id"), F.count("*").alias("call_documents")),
    ]
    fresh = macro_latest(t).where((F.col("session_date") == last) & F.col("value").isNotNull()).agg(F.count("*")).scalar()
    d = U.left_join_all(t.entities.select("entity_id"), "entity_id", parts)
    d = d.withColumns({
        "audit_status": F.when(F.datediff(day, "newest_period") <= 180, "current").otherwise("stale"), "audit_at": clock - F.when(F.col("entity_id") % 7 == 3, F.expr("interval 40 hours")).otherwise(F.expr("interval 2 hours")),
        "valuation_date": F.when(F.col("statements") > 0, F.col("price_date")), "calendar_status": F.when(F.datediff(day, "_filed") <= 60, "current").otherwise("stale"),
        "insiders_pending": (F.col("entity_id") % 6 == 0).cast("int"), "owner_checks": F.lit(1), "fresh_series": fresh, "clock": clock, "last": last,
    })
    return t.shared("full_inventory", d.drop("_filed"))


cte(
    "full_inventory",
    """WITH k AS (SELECT max(session_date) AS last, CAST(max(session_date) AS TIMESTAMP) + INTERVAL 21 HOUR AS clock FROM panel), ne AS (SELECT count(*) AS n FROM entities)
SELECT e.entity_id, k.last, k.clock, p.price_date, f.feature_date, s.statements, s.newest_period, s.missing_fields, r.reported_date, o.analyst_at, o.analysts, x.estimates_at, x.estimate_days, x.eps_periods, x.revenue_periods, q.reports_90d, q.filed, q.insiders,
  g.guidance_90d, a.actions, b.total_return_date, w.articles_90d, c.call_documents, (SELECT count(*) FROM macro_last) AS fresh_series
FROM entities e CROSS JOIN k CROSS JOIN ne
LEFT JOIN (SELECT entity_id, max(session_date) AS price_date FROM panel GROUP BY 1) p USING (entity_id) LEFT JOIN (SELECT entity_id, max(session_date) AS feature_date FROM features GROUP BY 1) f USING (entity_id)
LEFT JOIN (SELECT entity_id, count(*) AS statements, max(period_end) AS newest_period, count(*) FILTER (WHERE eps_diluted IS NULL) AS missing_fields FROM ttm GROUP BY 1) s USING (entity_id)
LEFT JOIN (SELECT entity_id, max(reported_date) AS reported_date FROM earnings_versions WHERE reported_eps IS NOT NULL GROUP BY 1) r USING (entity_id)
LEFT JOIN (SELECT entity_id, max(observed_at) AS analyst_at, arg_max(strong_buy + buy + hold + sell + strong_sell, observed_at) AS analysts FROM analyst_snapshots GROUP BY 1) o USING (entity_id)
LEFT JOIN (SELECT entity_id, max(captured_at) AS estimates_at, count(DISTINCT CAST(captured_at AS DATE)) AS estimate_days, count(eps_consensus) FILTER (WHERE captured_at >= k.clock - INTERVAL 7 DAY) AS eps_periods, count(revenue_consensus) FILTER (WHERE captured_at >= k.clock - INTERVAL 7 DAY) AS revenue_periods FROM estimates, k WHERE captured_at <= k.clock GROUP BY 1) x USING (entity_id)
LEFT JOIN (SELECT entity_id, count(*) FILTER (WHERE filed_date > CAST(k.clock AS DATE) - 90) AS reports_90d, max(filed_date) AS filed, count(*) FILTER (WHERE entity_id % 3 <> 0 AND eps_diluted IS NOT NULL) AS insiders FROM quarter_statements, k WHERE filed_date <= CAST(k.clock AS DATE) GROUP BY 1) q USING (entity_id)
LEFT JOIN (SELECT entity_id, count(*) FILTER (WHERE published_at > k.clock - INTERVAL 90 DAY) AS guidance_90d FROM guidance, k WHERE published_at <= k.clock GROUP BY 1) g USING (entity_id)
LEFT JOIN (SELECT entity_id, count(*) AS actions FROM quarter_statements, k WHERE filed_date <= CAST(k.clock AS DATE) GROUP BY 1) a USING (entity_id)
LEFT JOIN (SELECT entity_id, max(session_date) AS total_return_date FROM based_panel WHERE basis = 'total' AND close IS NOT NULL GROUP BY 1) b USING (entity_id)
LEFT JOIN (SELECT user_id % (SELECT n FROM ne) AS entity_id, count(*) AS articles_90d FROM events GROUP BY 1) w USING (entity_id) LEFT JOIN (SELECT conv_id % (SELECT n FROM ne) AS entity_id, count(*) AS call_documents FROM conversations GROUP BY 1) c USING (entity_id)""",
)
cte(
    "macro_last",
    """SELECT s.series_id FROM (SELECT DISTINCT series_id FROM macro_obs) s, (SELECT max(session_date) AS last FROM panel) k WHERE k.last - (SELECT max(o.observation_date) FROM macro_obs o WHERE o.series_id = s.series_id
  AND CASE WHEN o.vintage_date IS NOT NULL THEN CAST(o.vintage_date + 1 AS TIMESTAMP) ELSE o.observed_at END <= CAST(k.last AS TIMESTAMP) + INTERVAL 21 HOUR) <= 75""",
)
_STATUS = {
    "market": "CASE WHEN price_date = last AND feature_date = last THEN 'current' WHEN price_date IS NOT NULL THEN 'stale' ELSE 'missing' END",
    "financials": "CASE WHEN CAST(clock AS DATE) - newest_period <= 180 AND entity_id % 7 <> 3 THEN CASE WHEN missing_fields > 0 THEN 'partial' ELSE 'current' END WHEN statements > 0 THEN 'stale' ELSE 'missing' END",
    "valuation": "CASE WHEN statements > 0 AND price_date = last THEN 'current' WHEN statements > 0 AND price_date IS NOT NULL THEN 'stale' ELSE 'missing' END",
    "earnings": "CASE WHEN reported_date IS NOT NULL THEN 'observed' ELSE 'missing' END",
    "upcoming": "CASE WHEN CAST(clock AS DATE) - filed <= 60 THEN 'current' ELSE 'unknown' END",
    "analyst": "CASE WHEN analysts >= 3 AND analyst_at <= clock AND analyst_at >= clock - INTERVAL 7 DAY THEN 'current' WHEN analysts > 0 THEN 'partial' ELSE 'missing' END",
    "estimates": "CASE WHEN eps_periods > 0 AND revenue_periods > 0 AND estimates_at >= clock - INTERVAL 48 HOUR THEN 'current' WHEN eps_periods > 0 OR revenue_periods > 0 THEN 'partial' WHEN estimates_at IS NOT NULL THEN 'stale' ELSE 'missing' END",
    "revisions": "CASE WHEN estimate_days >= 2 THEN 'partial' WHEN estimate_days > 0 THEN 'building' ELSE 'missing' END",
    "disclosures": "CASE WHEN reports_90d > 0 THEN 'observed' ELSE 'unknown' END", "news": "CASE WHEN articles_90d > 0 THEN 'observed' ELSE 'unknown' END", "guidance": "CASE WHEN guidance_90d > 0 THEN 'partial' ELSE 'unknown' END",
    "actions": "CASE WHEN actions > 0 OR total_return_date IS NOT NULL THEN 'partial' ELSE 'missing' END", "calls": "CASE WHEN call_documents > 0 THEN 'partial' ELSE 'not_collected' END",
    "ownership": "CASE WHEN insiders > 0 THEN 'partial' WHEN entity_id % 6 = 0 THEN 'pending' ELSE 'unknown' END", "macro": "CASE WHEN fresh_series > 0 THEN 'partial' ELSE 'not_collected' END",
}
cte("coverage", " UNION ALL ".join(f"SELECT entity_id, '{k}' AS family, {v} AS status FROM full_inventory" for k, v in _STATUS.items()))


def coverage(t: Tables) -> DataFrame:
    i = full_inventory(t)
    return U.entity_coverage(i, F.col("clock"), F.col("last"))


_SHOWN = ["price_date", "feature_date", "newest_period", "statements", "reported_date", "analyst_at", "analysts", "estimates_at", "estimate_days", "reports_90d", "guidance_90d", "actions", "total_return_date", "articles_90d", "call_documents", "insiders"]


@query("entity_inventory", "A32 A33 Q4 J2", f"SELECT entity_id, {', '.join(_SHOWN)} FROM full_inventory")
def entity_inventory(t: Tables) -> DataFrame:
    return full_inventory(t).select("entity_id", *_SHOWN)


@query("entity_coverage", "F23 A20", "SELECT * FROM coverage")
def entity_coverage(t: Tables) -> DataFrame:
    return coverage(t)


@query(
    "coverage_summary",
    "A20 A34 A36 A44 Q2",
    f"SELECT family, {', '.join(f'count(*) FILTER (WHERE status = {chr(39)}{s}{chr(39)}) AS {s}' for s in U.COVERAGE)}, count(*) FILTER (WHERE status IN ('current', 'observed')) AS covered, count(*) AS total FROM coverage GROUP BY 1",
)
def coverage_summary(t: Tables) -> DataFrame:
    return U.coverage_summary(coverage(t))
