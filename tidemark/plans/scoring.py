"""Scores, quality status and display lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import growth, ratio
from tidemark.operators import scores as C
from tidemark.plans.ctes import rnd
from tidemark.plans.evaluation import selections
from tidemark.plans.registry import query
from tidemark.plans.tables import Tables


def _clip(x: str) -> str:
    return f"CASE WHEN ({x}) IS NOT NULL THEN least(100, greatest(0, {x})) END"


_PARTS = [
    _clip("50 + growth * 250"), _clip("40 + margin * 150"), _clip("50 + (margin - prev_margin) * 500"), _clip("40 + fcf_margin * 200"), _clip("75 - leverage * 10"),
]
_SCORE_SQL = f"""WITH s AS (SELECT entity_id, period_end, CASE WHEN lag(revenue) OVER w > 0 THEN revenue / lag(revenue) OVER w - 1 END AS growth, CASE WHEN revenue > 0 THEN operating_income / revenue END AS margin,
  CASE WHEN lag(revenue) OVER w > 0 THEN lag(operating_income) OVER w / lag(revenue) OVER w END AS prev_margin, CASE WHEN revenue > 0 THEN free_cash_flow / revenue END AS fcf_margin, CASE WHEN free_cash_flow > 0 THEN (total_debt - cash) / free_cash_flow END AS leverage
  FROM annual_statements WINDOW w AS (PARTITION BY entity_id ORDER BY period_end)),
p AS (SELECT entity_id, period_end, {', '.join(f'{x} AS p{i}' for i, x in enumerate(_PARTS))} FROM s),
n AS (SELECT *, {' + '.join(f'CAST(p{i} IS NOT NULL AS INT)' for i in range(5))} AS k FROM p)
SELECT entity_id, period_end, {rnd('(' + ' + '.join(f'coalesce(p{i}, 0)' for i in range(5)) + ') / nullif(k, 0)', 1)} AS score, {rnd('k / 5.0 * 100', 1)} AS coverage FROM n"""


@query("fundamentals_score", "F15 W29", _SCORE_SQL)
def fundamentals_score(t: Tables) -> DataFrame:
    w = Window.partitionBy("entity_id").orderBy("period_end")
    a = t.annual_statements.withColumns({"prev_revenue": F.lag("revenue").over(w), "prev_income": F.lag("operating_income").over(w)})
    margin, old = ratio("operating_income", "revenue"), ratio("prev_income", "prev_revenue")
    leverage = F.when(F.col("free_cash_flow") > 0, (F.col("total_debt") - F.col("cash")) / F.col("free_cash_flow"))
    score, cover = C.fundamentals_score(growth("revenue", "prev_revenue"), margin, margin - old, ratio("free_cash_flow", "revenue"), leverage)
    return a.select("entity_id", "period_end", score.alias("score"), cover.alias("coverage"))


@query(
    "quality_status",
    "F22 A19",
    """WITH l AS (SELECT entity_id, max(period_end) AS expected_period, max(filed_date) AS expected_filed FROM quarter_statements GROUP BY 1), p AS (SELECT entity_id, max(period_end) AS parsed_period FROM reported_quarters GROUP BY 1),
t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY period_end DESC) AS rn FROM ttm) WHERE rn = 1)
SELECT l.entity_id, CASE WHEN parsed_period IS NULL OR parsed_period < expected_period THEN 'extraction_behind_latest_filing' WHEN t.period_end IS NULL THEN 'insufficient_ttm_history' WHEN t.period_end < expected_period OR t.filed_date < expected_filed THEN 'ttm_behind_latest_filing'
  WHEN NOT DATE '2001-12-01' - t.period_end BETWEEN 0 AND 180 THEN 'ttm_period_old' WHEN revenue > 0 AND (abs(net_income) > revenue OR abs(operating_income) > revenue) THEN 'financial_values_require_review' ELSE 'current' END AS status
FROM l LEFT JOIN p USING (entity_id) LEFT JOIN t USING (entity_id)""",
)
def quality_status(t: Tables) -> DataFrame:
    from tidemark.operators.latest import latest_row

    expected = t.quarter_statements.groupBy("entity_id").agg(F.max("period_end").alias("expected_period"), F.max("filed_date").alias("expected_filed"))
    parsed = t.reported_quarters.groupBy("entity_id").agg(F.max("period_end").alias("parsed_period"))
    ttm = latest_row(t.ttm, ["entity_id"], "period_end").withColumnsRenamed({"period_end": "ttm_period", "filed_date": "ttm_filed"})
    d = expected.join(parsed, "entity_id", "left").join(ttm, "entity_id", "left")
    return d.select("entity_id", C.quality_status(F.lit("2001-12-01").cast("date")).alias("status"))


@query(
    "newest_signals",
    "T5",
    "SELECT model_version, signal_date, entity_id, rank FROM selections WHERE signal_date >= (SELECT min(signal_date) FROM (SELECT signal_date FROM selections ORDER BY signal_date DESC LIMIT 33))",
)
def newest_signals(t: Tables) -> DataFrame:
    s = selections(t)
    return C.newest_whole_groups(s, "signal_date", [F.col("model_version"), F.col("rank")], 33).select("model_version", "signal_date", "entity_id", "rank")


@query(
    "calendar_status",
    "F24",
    """WITH c AS (SELECT max(ts) AS clock FROM events), r AS (SELECT user_id AS entity_id, ts AS observed_at, CAST(ts AS DATE) + CAST(event_id % 5 AS INTEGER) - 2 AS d FROM events)
SELECT u.entity_id, min(d) AS reported_date, CASE WHEN min(d) IS NULL THEN 'unknown' ELSE 'current' END AS calendar_status FROM (SELECT DISTINCT user_id AS entity_id FROM events) u LEFT JOIN (SELECT r.* FROM r, c WHERE observed_at >= clock - INTERVAL 48 HOUR AND d >= CAST(clock AS DATE)) x USING (entity_id) GROUP BY 1""",
)
def calendar_status(t: Tables) -> DataFrame:
    e = t.raw("events")
    clock = e.agg(F.max("ts")).scalar()
    day = F.expr("date_add(to_date(ts), cast(event_id % 5 as int) - 2)")
    r = e.select(F.col("user_id").alias("entity_id"), F.col("ts").alias("observed_at"), F.array(day).alias("dates"))
    users = e.select(F.col("user_id").alias("entity_id")).distinct()
    return C.calendar_status(r, users, clock, F.to_date(clock)).select("entity_id", "reported_date", "calendar_status")


@query(
    "research_priority",
    "A11",
    f"""WITH q AS (SELECT entity_id, period_end, 50 + 40 * net_income / nullif(revenue, 0) AS f, revenue / nullif(net_income, 0) AS pe, lag(revenue / nullif(net_income, 0)) OVER w AS prev_pe, revenue / nullif(free_cash_flow, 0) AS pf, lag(revenue / nullif(free_cash_flow, 0)) OVER w AS prev_pf FROM quarter_statements WINDOW w AS (PARTITION BY entity_id ORDER BY period_end)),
p AS (SELECT entity_id, period_end, abs(f - 50) * 2 AS a, CASE WHEN pe IS NOT NULL AND prev_pe <> 0 THEN least(100, abs(pe / prev_pe - 1) * 500) END AS b, CASE WHEN pf IS NOT NULL AND prev_pf <> 0 THEN least(100, abs(pf / prev_pf - 1) * 500) END AS c FROM q)
SELECT entity_id, period_end, {rnd('(coalesce(a * 0.25, 0) + coalesce(b * 0.2, 0) + coalesce(c * 0.15, 0)) / nullif(CASE WHEN a IS NOT NULL THEN 0.25 ELSE 0 END + CASE WHEN b IS NOT NULL THEN 0.2 ELSE 0 END + CASE WHEN c IS NOT NULL THEN 0.15 ELSE 0 END, 0)', 1)} AS priority FROM p""",
)
def research_priority(t: Tables) -> DataFrame:
    w = Window.partitionBy("entity_id").orderBy("period_end")
    over = lambda c: F.when(F.col(c) != 0, F.col("revenue") / F.col(c))
    q = t.quarter_statements.withColumns({"pe": over("net_income"), "pf": over("free_cash_flow")})
    q = q.withColumns({"prev_pe": F.lag("pe").over(w), "prev_pf": F.lag("pf").over(w), "f": F.lit(50.0) + F.when(F.col("revenue") != 0, F.col("net_income") * 40 / F.col("revenue"))})
    p, _ = C.research_priority(F.col("f"), F.lit(None).cast("double"), F.col("pe"), F.col("prev_pe"), F.col("pf"), F.col("prev_pf"))
    return q.select("entity_id", "period_end", p.alias("priority"))
