"""Statement queries: quarters, trailing twelve months, factors and quality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import r2, r4, r6
from tidemark.operators import asof as A
from tidemark.operators import fundamentals as S
from tidemark.plans.ctes import FLOW, STOCK, family, rnd
from tidemark.plans.registry import query
from tidemark.plans.tables import Tables

_MONEY = [*FLOW, *STOCK]


def _money(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, *[r4(c).alias(c) for c in _MONEY])


_SQL_MONEY = ", ".join(f"{rnd(c, 4)} AS {c}" for c in _MONEY)


@query("annual_statements", "", f"SELECT entity_id, period_end, filed_date, revenue_tag, {_SQL_MONEY} FROM annual_statements")
def annual_statements(t: Tables) -> DataFrame:
    return _money(t.annual_statements, "entity_id", "period_end", "filed_date", "revenue_tag")


@query("fourth_quarters", "W21 P8", f"SELECT entity_id, period_end, filed_date, revenue_tag, {_SQL_MONEY} FROM all_quarters")
def fourth_quarters(t: Tables) -> DataFrame:
    return _money(S.derive_fourth_quarters(t.annual_statements, t.reported_quarters), "entity_id", "period_end", "filed_date", "revenue_tag")


@query("ttm_rows", "W20 W22", f"SELECT entity_id, period_end, filed_date, revenue_tag, method, {_SQL_MONEY} FROM ttm")
def ttm_rows(t: Tables) -> DataFrame:
    return _money(t.ttm, "entity_id", "period_end", "filed_date", "revenue_tag", "method")


_ASOF_SQL = """fund AS (SELECT d.entity_id, d.session_date, d.decision_at, d.close, v.period_end, v.observed_at, v.filed_date, v.revenue, v.net_income, v.eps_diluted,
  v.free_cash_flow, v.operating_income, v.cash, v.total_debt, v.shares_outstanding, v.equity, v.revenue_tag, v.version FROM decisions d
  JOIN LATERAL (SELECT * FROM ttm_versions v WHERE v.entity_id = d.entity_id AND v.observed_at <= d.decision_at
    AND CAST(v.filed_date AS TIMESTAMP) <= d.decision_at ORDER BY v.period_end DESC, v.observed_at DESC LIMIT 1) v ON true)"""


def fundamentals_asof(t: Tables) -> DataFrame:
    payload = ["period_end", "observed_at", "filed_date", "revenue_tag", *S.FLOW_FIELDS, *S.STOCK_FIELDS, "version"]
    versions = t.ttm_versions.withColumn("usable_at", F.greatest("observed_at", F.col("filed_date").cast("timestamp_ntz")))
    return A.latest_known(t.decisions, versions, ["entity_id"], "decision_at", "usable_at", "period_end", payload, ["observed_at"])


@query(
    "fundamentals_asof",
    "J7 J8 P3 P4",
    f"""WITH {_ASOF_SQL} SELECT d.entity_id, d.session_date, f.period_end, f.version, CASE WHEN age BETWEEN 0 AND 180 THEN {rnd('f.revenue', 2)} END AS revenue,
  CASE WHEN age BETWEEN 0 AND 180 THEN {rnd('f.eps_diluted', 4)} END AS eps_diluted
FROM decisions d LEFT JOIN (SELECT *, session_date - period_end AS age FROM fund) f ON f.entity_id = d.entity_id AND f.session_date = d.session_date""",
)
def fundamentals_asof_q(t: Tables) -> DataFrame:
    df = A.stale_to_null(fundamentals_asof(t), F.datediff("session_date", "period_end"), S.MAX_STATEMENT_AGE, ["revenue", "eps_diluted"])
    return df.select("entity_id", "session_date", "period_end", "version", r2("revenue").alias("revenue"), r4("eps_diluted").alias("eps_diluted"))


_PREV_SQL = """paired AS (SELECT l.*, p.period_end AS prev_period, p.revenue AS prev_revenue, p.net_income AS prev_net_income, p.eps_diluted AS prev_eps, p.operating_income AS prev_operating_income,
    p.equity AS prev_equity, p.revenue_tag AS prev_tag FROM latest l
  LEFT JOIN LATERAL (SELECT * FROM ttm_versions v WHERE v.entity_id = l.entity_id AND greatest(v.observed_at, CAST(v.filed_date AS TIMESTAMP)) <= l.decision_at
    AND l.period_end - v.period_end BETWEEN 300 AND 450 ORDER BY abs(l.period_end - v.period_end - 365), v.observed_at DESC LIMIT 1) p ON true)"""


def factor_rows(t: Tables) -> DataFrame:
    """Latest and prior-year statement and the factor vector of each quarterly decision."""
    payload = ["period_end", "observed_at", "filed_date", "revenue_tag", *S.FLOW_FIELDS, *S.STOCK_FIELDS]
    versions = t.ttm_versions.withColumn("usable_at", F.greatest("observed_at", F.col("filed_date").cast("timestamp_ntz")))
    latest = A.latest_known(t.quarter_decisions, versions, ["entity_id"], "decision_at", "usable_at", "period_end", payload, ["observed_at"])
    data = ["revenue_tag", "revenue", "net_income", "operating_income", "eps_diluted", "equity"]
    both = S.prior_year(latest, versions, "decision_at", "usable_at", data, "observed_at")
    return S.with_factors(both, "close")


def _sound(p: str) -> str:
    return f"NOT coalesce({p}revenue > 0 AND (abs({p}net_income) > {p}revenue OR abs({p}operating_income) > {p}revenue), false)"


QUARTER_FACTORS_SQL = f"""{_ASOF_SQL.replace("FROM decisions d", "FROM quarter_decisions d").replace("fund AS", "latest AS")}, {_PREV_SQL},
cmp AS (SELECT *, coalesce(NOT (prev_revenue > 0 AND (abs(prev_net_income) > prev_revenue OR abs(prev_operating_income) > prev_revenue)), true)
    AND (prev_tag IS NULL OR {family('prev_tag')} = {family('revenue_tag')}) AS comparable, {_sound('')} AS sound FROM paired),
factors AS (SELECT *, CASE WHEN sound AND comparable AND prev_revenue > 0 THEN revenue / prev_revenue - 1 END AS revenue_growth,
  CASE WHEN sound AND comparable AND prev_eps <> 0 THEN (eps_diluted - prev_eps) / abs(prev_eps) END AS eps_growth,
  CASE WHEN sound AND revenue > 0 THEN operating_income / revenue END AS operating_margin,
  CASE WHEN sound AND revenue > 0 THEN net_income / revenue END AS net_margin,
  CASE WHEN sound AND revenue > 0 AND comparable AND prev_revenue > 0 THEN operating_income / revenue - prev_operating_income / prev_revenue END AS operating_margin_change,
  CASE WHEN sound AND revenue > 0 AND comparable AND prev_revenue > 0 THEN net_income / revenue - prev_net_income / prev_revenue END AS net_margin_change,
  CASE WHEN sound AND revenue > 0 THEN free_cash_flow / revenue END AS fcf_margin,
  CASE WHEN sound AND net_income > 0 THEN free_cash_flow / net_income END AS cash_conversion,
  CASE WHEN sound AND free_cash_flow > 0 THEN (total_debt - cash) / free_cash_flow END AS net_debt_to_fcf,
  CASE WHEN sound AND close > 0 THEN eps_diluted / close END AS earnings_yield,
  CASE WHEN sound AND close * shares_outstanding > 0 THEN free_cash_flow / (close * shares_outstanding) END AS fcf_yield,
  CASE WHEN sound AND comparable AND equity > 0 AND prev_equity > 0 THEN net_income / ((equity + prev_equity) / 2) END AS return_on_equity FROM cmp)"""
FACTORS = [
    "revenue_growth", "eps_growth", "operating_margin", "net_margin", "operating_margin_change", "net_margin_change", "fcf_margin",
    "cash_conversion", "net_debt_to_fcf", "earnings_yield", "fcf_yield", "return_on_equity",
]


@query(
    "prior_year_statement",
    "J14 F45",
    f"WITH {QUARTER_FACTORS_SQL} SELECT entity_id, session_date, period_end, prev_period, {rnd('return_on_equity')} AS return_on_equity FROM factors",
)
def prior_year_statement(t: Tables) -> DataFrame:
    f = factor_rows(t).where(F.col("period_end").isNotNull())
    return f.select("entity_id", "session_date", "period_end", F.col("prev.period_end").alias("prev_period"), r6("return_on_equity").alias("return_on_equity"))


@query("factor_vector", "F14 F4 P7", f"WITH {QUARTER_FACTORS_SQL} SELECT entity_id, session_date, {', '.join(f'{rnd(c)} AS {c}' for c in FACTORS)} FROM factors")
def factor_vector(t: Tables) -> DataFrame:
    f = factor_rows(t).where(F.col("period_end").isNotNull())
    return f.select("entity_id", "session_date", *[r6(c).alias(c) for c in FACTORS])


@query(
    "statement_anomalies",
    "P7",
    """SELECT entity_id, period_end, CASE WHEN abs(net_income) > revenue THEN 1 ELSE 0 END + CASE WHEN abs(operating_income) > revenue THEN 1 ELSE 0 END AS flags
FROM quarter_statements WHERE revenue > 0""",
)
def statement_anomalies(t: Tables) -> DataFrame:
    return t.quarter_statements.where(F.col("revenue") > 0).select("entity_id", "period_end", F.size(S.anomalies()).alias("flags"))
