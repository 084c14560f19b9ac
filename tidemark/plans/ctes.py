"""Shared SQL fragments for the checks.  ``with_clause`` adds those a query names."""

from __future__ import annotations

import re

CTES: dict[str, str] = {}


def cte(name: str, sql: str) -> None:
    CTES[name] = sql.strip()


def _names(sql: str) -> list[str]:
    words = set(re.findall(r"[A-Za-z_][A-Za-z_0-9]*", sql))
    return [n for n in CTES if n in words]


def with_clause(sql: str) -> str:
    """Prefix ``sql`` with every CTE it needs, dependencies first."""
    order: list[str] = []

    def need(text: str, own: str | None) -> None:
        for n in _names(text):
            if n != own and n not in order:
                need(CTES[n], n)
                if n not in order:
                    order.append(n)

    body = sql.strip()
    need(body, None)
    if not order:
        return body
    head = ",\n".join(f"{n} AS (\n{CTES[n]}\n)" for n in order)
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {head},\n{body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {head},\n{body[5:]}"
    return f"WITH {head}\n{body}"


def rnd(expr: str, digits: int = 6) -> str:
    """The SQL twin of ``functions.round_half_up``."""
    return f"floor(({expr}) * 1e{digits} + 0.5) / 1e{digits}"


cte(
    "entities",
    """SELECT CAST(n_nationkey AS BIGINT) AS entity_id, 'N' || n_nationkey AS ticker, n_name AS name, r_name AS sector
FROM nation JOIN region ON n_regionkey = r_regionkey""",
)

_BARS = """SELECT *, CAST(notional_cents AS DOUBLE) / 100.0 / CAST(volume AS DOUBLE) AS close FROM (
  SELECT CAST(s_nationkey AS BIGINT) AS entity_id, CAST({session} AS DATE) AS session_date, l_returnflag AS source,
    CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS notional_cents,
    CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS volume,
    max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2, 3)"""
cte("bars_by_source", _BARS.format(session="date_trunc('week', l_shipdate)"))
cte("daily_bars", _BARS.format(session="l_shipdate"))

_MARKET = """SELECT *, CAST(notional_cents AS DOUBLE) / 100.0 / CAST(volume AS DOUBLE) AS close FROM (
  SELECT CAST(-1 AS BIGINT) AS entity_id, session_date, 'ALL' AS source, CAST(sum(notional_cents) AS BIGINT) AS notional_cents,
    CAST(sum(volume) AS BIGINT) AS volume, max(high) AS high, min(low) AS low
  FROM {bars} GROUP BY session_date)"""
cte("benchmark_bars", _MARKET.format(bars="bars_by_source"))
cte("daily_benchmark", _MARKET.format(bars="daily_bars"))

cte(
    "canonical",
    """SELECT entity_id, session_date, source, notional_cents, volume, high, low, close FROM (
  SELECT *, row_number() OVER (PARTITION BY entity_id, session_date ORDER BY (source <> 'R'), source) AS rn FROM bars_by_source)
WHERE rn = 1""",
)
cte("calendar", "SELECT session_date, row_number() OVER (ORDER BY session_date) AS session_no FROM (SELECT DISTINCT session_date FROM benchmark_bars)")
cte("daily_calendar", "SELECT session_date, row_number() OVER (ORDER BY session_date) AS session_no FROM (SELECT DISTINCT session_date FROM daily_benchmark)")
cte(
    "panel",
    """SELECT b.entity_id, b.session_date, c.session_no, b.close, b.high, b.low, b.volume FROM (
  SELECT entity_id, session_date, close, high, low, volume FROM canonical
  UNION ALL SELECT entity_id, session_date, close, high, low, volume FROM benchmark_bars) b
JOIN calendar c USING (session_date)""",
)


def _exact(expr: str, back: int) -> str:
    return f"CASE WHEN count(*) OVER (PARTITION BY entity_id ORDER BY session_no RANGE BETWEEN {back} PRECEDING AND CURRENT ROW) = {back + 1} THEN {expr} END"


def _win(expr: str, lo: int, hi: int = 0) -> str:
    end = "CURRENT ROW" if hi == 0 else f"{hi} PRECEDING"
    return f"{expr} OVER (PARTITION BY entity_id ORDER BY session_no RANGE BETWEEN {lo} PRECEDING AND {end})"


def _mom(n: int) -> str:
    return f"close / nullif({_win('max(close)', n, n)}, 0) - 1"


def _fwd(n: int) -> str:
    return f"max(close) OVER (PARTITION BY entity_id ORDER BY session_no RANGE BETWEEN {n} FOLLOWING AND {n} FOLLOWING) / close - 1"


cte(
    "own_features",
    f"""SELECT entity_id, session_date, session_no, close,
  {_mom(1)} AS return_1, {_mom(5)} AS momentum_5, {_mom(20)} AS momentum_20,
  {_exact(_win("stddev_samp(ret)", 19) + " * sqrt(252)", 20)} AS volatility_20,
  {_exact("volume / nullif(" + _win("avg(volume)", 5, 1) + ", 0) - 1", 5)} AS volume_change_5,
  (high - low) / close AS range_pct,
  {_exact("close / " + _win("avg(close)", 19) + " - 1", 19)} AS close_vs_sma20,
  {_exact("volume / nullif(" + _win("avg(volume)", 19) + ", 0)", 19)} AS volume_ratio_20,
  {_exact("close / " + _win("max(close)", 19) + " - 1", 19)} AS drawdown_20,
  {_exact("close / " + _win("max(close)", 59) + " - 1", 59)} AS drawdown_60,
  {_exact("close / " + _win("min(close)", 59) + " - 1", 59)} AS distance_to_support_60,
  {_exact(_win("max(close)", 19) + " / close - 1", 19)} AS rebound_potential_20,
  {_exact(_win("max(close)", 59) + " / close - 1", 59)} AS rebound_potential_60,
  {_fwd(5)} AS forward_return_5, {_fwd(5)} > 0 AS forward_up_5,
  {_fwd(10)} AS forward_return_10, {_fwd(10)} > 0 AS forward_up_10,
  {_fwd(20)} AS forward_return_20, {_fwd(20)} > 0 AS forward_up_20
FROM (SELECT *, close / lag(close) OVER (PARTITION BY entity_id ORDER BY session_no) - 1 AS ret FROM panel)""",
)
cte(
    "features",
    """SELECT f.*, e.sector, m.momentum_5 AS market_momentum_5, m.momentum_20 AS market_momentum_20, m.volatility_20 AS market_volatility_20,
  f.momentum_5 - m.momentum_5 AS relative_momentum_5, f.momentum_20 - m.momentum_20 AS relative_momentum_20
FROM own_features f JOIN entities e USING (entity_id)
LEFT JOIN (SELECT * FROM own_features WHERE entity_id = -1) m ON m.session_date = f.session_date""",
)
cte(
    "context",
    """SELECT f.*, b.breadth_positive_20, b.breadth_above_sma20, s.sector_momentum_5, s.sector_momentum_20, s.sector_breadth_positive_20,
  f.momentum_5 - s.sector_momentum_5 AS relative_sector_momentum_5, f.momentum_20 - s.sector_momentum_20 AS relative_sector_momentum_20,
  (coalesce(CAST(market_momentum_5 > 0 AS INT), 0) + coalesce(CAST(market_momentum_20 > 0 AS INT), 0)
    + coalesce(CAST(breadth_positive_20 > 0.5 AS INT), 0) + coalesce(CAST(breadth_above_sma20 > 0.5 AS INT), 0))
  / nullif(CAST(market_momentum_5 IS NOT NULL AS INT) + CAST(market_momentum_20 IS NOT NULL AS INT)
    + CAST(breadth_positive_20 IS NOT NULL AS INT) + CAST(breadth_above_sma20 IS NOT NULL AS INT), 0) AS market_regime_score
FROM features f
LEFT JOIN (SELECT session_date, avg(CAST(momentum_20 > 0 AS DOUBLE)) AS breadth_positive_20, avg(CAST(close_vs_sma20 > 0 AS DOUBLE)) AS breadth_above_sma20
  FROM features GROUP BY 1) b USING (session_date)
LEFT JOIN (SELECT session_date, sector, avg(momentum_5) AS sector_momentum_5, avg(momentum_20) AS sector_momentum_20,
  avg(CAST(momentum_20 > 0 AS DOUBLE)) AS sector_breadth_positive_20 FROM features GROUP BY 1, 2) s USING (session_date, sector)""",
)
cte(
    "setups",
    """SELECT *, 100 * (0.50 * greatest(0, least(1, ((ups + 10.0) / (sample_size + 20.0) - 0.45) / 0.25))
  + 0.30 * greatest(0, least(1, (setup_median + 0.01) / 0.05))
  + 0.20 * greatest(0, least(1, coalesce(rebound_potential_60, 0) / 0.20))) * (0.65 + 0.35 * least(1, sample_size / 100.0)) AS setup_score,
  CAST(ups AS DOUBLE) / sample_size AS setup_up
FROM (
  SELECT c.*, n.sample_size, n.ups, n.setup_median FROM numbered_features c
  JOIN (SELECT c.entity_id, c.session_no, count(*) AS sample_size, count(*) FILTER (WHERE h.forward_return_5 > 0) AS ups, median(h.forward_return_5) AS setup_median
    FROM numbered_features c JOIN numbered_features h ON h.entity_id = c.entity_id AND h.rn BETWEEN c.rn - 749 AND c.rn - 5
      AND h.forward_return_5 IS NOT NULL AND abs(h.drawdown_60 - c.drawdown_60) <= 0.04
      AND abs(h.distance_to_support_60 - c.distance_to_support_60) <= 0.04
    GROUP BY 1, 2) n USING (entity_id, session_no))""",
)
cte("numbered_features", "SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY session_no) AS rn FROM features")

cte(
    "order_flows",
    """SELECT CAST(c_nationkey AS BIGINT) AS entity_id, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS quarter,
  sum(CASE WHEN o_orderstatus = 'F' THEN CAST(round(o_totalprice * 100) AS BIGINT) ELSE 0 END) AS f,
  sum(CASE WHEN o_orderstatus = 'O' THEN CAST(round(o_totalprice * 100) AS BIGINT) ELSE 0 END) AS o,
  sum(CASE WHEN o_orderstatus = 'P' THEN CAST(round(o_totalprice * 100) AS BIGINT) ELSE 0 END) AS p, count(*) AS n
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2""",
)


def _statement(flows: str, filing_days: int) -> str:
    return f"""SELECT entity_id, period_end, period_end + {filing_days} AS filed_date,
  CASE WHEN entity_id % 4 = 0 AND year(period_end) >= 1998 THEN 'RevenueFromContractWithCustomerExcludingAssessedTax' ELSE 'Revenues' END AS revenue_tag,
  (f + o + p) / 100.0 AS revenue, f / 200.0 AS operating_income, (f * 5 - p * 4) / 500.0 AS net_income,
  CASE WHEN n % 11 <> 0 THEN (f * 5 - p * 4) / 500.0 / (n * 1000.0) END AS eps_diluted,
  (f + o) / 400.0 - abs(CASE WHEN n % 7 <> 0 THEN o / 800.0 END) AS free_cash_flow,
  CASE WHEN n % 7 <> 0 THEN o / 800.0 END AS capex, p / 400.0 AS cash, o / 300.0 AS total_debt, n * 1000.0 AS shares_outstanding, (f + p) / 300.0 AS equity
FROM ({flows})"""


_D = "CAST(f AS DOUBLE) AS f, CAST(o AS DOUBLE) AS o, CAST(p AS DOUBLE) AS p, CAST(n AS DOUBLE) AS n"
cte("quarter_statements", _statement(f"SELECT entity_id, CAST(quarter + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS period_end, {_D} FROM order_flows", 40))
cte("reported_quarters", "SELECT * FROM quarter_statements WHERE month(period_end) <> 12 OR entity_id % 2 = 1")
cte(
    "annual_statements",
    _statement(
        f"""SELECT entity_id, make_date(y, 12, 31) AS period_end, {_D} FROM (
  SELECT entity_id, year(quarter) AS y, sum(f) AS f, sum(o) AS o, sum(p) AS p, sum(n) AS n FROM order_flows GROUP BY 1, 2 HAVING count(*) = 4)""",
        60,
    ),
)

FLOW = ("revenue", "operating_income", "net_income", "eps_diluted", "free_cash_flow", "capex")
STOCK = ("cash", "total_debt", "shares_outstanding", "equity")


def family(tag: str) -> str:
    return f"CASE WHEN {tag} LIKE 'RevenueFromContract%' THEN 'contract' WHEN {tag} = 'Revenues' THEN 'total' ELSE {tag} END"


def _lags(names, n: int) -> str:
    return ", ".join(f"lag({c}, {i}) OVER w AS {c}_{i}" for i in range(1, n + 1) for c in names)


cte(
    "fourth_quarters",
    f"""SELECT a.entity_id, a.period_end, a.filed_date, a.revenue_tag,
  {", ".join(
      (f"CASE WHEN {family('a.revenue_tag')} = {family('q.revenue_tag')} AND {family('q.revenue_tag')} = {family('q.revenue_tag_1')} AND {family('q.revenue_tag_1')} = {family('q.revenue_tag_2')} THEN " if c == "revenue" else "CASE WHEN true THEN ")
      + f"a.{c} - (q.{c}_2 + q.{c}_1 + q.{c}) END AS {c}" for c in FLOW)},
  {", ".join("a." + c for c in STOCK)}
FROM (SELECT *, lag(period_end) OVER (PARTITION BY entity_id ORDER BY period_end) AS prev_end FROM annual_statements) a
JOIN (SELECT *, {_lags(("period_end", "revenue_tag") + FLOW, 2)}, lead(period_end) OVER w AS next_end FROM reported_quarters WINDOW w AS (PARTITION BY entity_id ORDER BY period_end)) q
  ON q.entity_id = a.entity_id AND q.period_end < a.period_end AND (q.next_end IS NULL OR q.next_end >= a.period_end)
WHERE a.period_end - q.period_end BETWEEN 60 AND 120 AND q.period_end - q.period_end_1 BETWEEN 60 AND 120
  AND q.period_end_1 - q.period_end_2 BETWEEN 60 AND 120 AND a.period_end - q.period_end_2 <= 330 AND (a.prev_end IS NULL OR q.period_end_2 > a.prev_end)""",
)
cte(
    "all_quarters",
    f"""SELECT entity_id, period_end, greatest(q.filed_date, d.filed_date) AS filed_date,
  {", ".join(f"coalesce(q.{c}, d.{c}) AS {c}" for c in ("revenue_tag",) + FLOW + STOCK)}
FROM reported_quarters q FULL JOIN fourth_quarters d USING (entity_id, period_end)""",
)
cte(
    "rolled_ttm",
    f"""SELECT entity_id, period_end, filed, revenue_tag, {", ".join(FLOW + STOCK)} FROM (
  SELECT entity_id, period_end, max(filed_date) OVER w4 AS filed, revenue_tag,
    {", ".join(("CASE WHEN count(" + c + ") OVER w4 = 4" + (" AND min(fam) OVER w4 = max(fam) OVER w4" if c == "revenue" else "") + " THEN sum(" + c + ") OVER w4 END AS " + c) for c in FLOW)},
    {", ".join(STOCK)}, count(*) OVER w4 AS n4, min(gap) OVER w3 AS g1, max(gap) OVER w3 AS g2
  FROM (SELECT *, period_end - lag(period_end) OVER (PARTITION BY entity_id ORDER BY period_end) AS gap, {family('revenue_tag')} AS fam FROM all_quarters)
  WINDOW w4 AS (PARTITION BY entity_id ORDER BY period_end ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), w3 AS (PARTITION BY entity_id ORDER BY period_end ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))
WHERE n4 = 4 AND g1 >= 60 AND g2 <= 120
  AND CAST(revenue IS NOT NULL AS INT) + CAST(operating_income IS NOT NULL AS INT) + CAST(net_income IS NOT NULL AS INT) + CAST(eps_diluted IS NOT NULL AS INT) >= 2""",
)
cte(
    "ytd",
    f"""SELECT * FROM (
  SELECT entity_id, anchor, row_number() OVER w AS k, period_end, max(filed_date) OVER w AS filed, revenue_tag, {", ".join(STOCK)},
    period_end - anchor AS offset_days, min(CAST(gap BETWEEN 60 AND 120 AS INT)) OVER w AS gaps_ok, min(fam) OVER w AS fam_lo, max(fam) OVER w AS fam_hi,
    {", ".join(f"CASE WHEN count({c}) OVER w = row_number() OVER w THEN sum({c}) OVER w END AS {c}" for c in FLOW)}
  FROM (SELECT *, {family('revenue_tag')} AS fam, period_end - coalesce(lag(period_end) OVER (PARTITION BY entity_id, anchor ORDER BY period_end), anchor) AS gap
    FROM (SELECT q.*, (SELECT max(a.period_end) FROM annual_statements a WHERE a.entity_id = q.entity_id AND a.period_end < q.period_end) AS anchor FROM all_quarters q)
    WHERE anchor IS NOT NULL AND period_end - anchor <= 310)
  WINDOW w AS (PARTITION BY entity_id, anchor ORDER BY period_end ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
WHERE k <= 3 AND gaps_ok = 1""",
)
cte(
    "bridged_ttm",
    f"""SELECT * FROM (
  SELECT n.entity_id, n.period_end, greatest(a.filed_date, n.filed, b.filed) AS filed, n.revenue_tag,
    {", ".join((f"CASE WHEN {family('a.revenue_tag')} = n.fam_lo AND n.fam_lo = n.fam_hi AND n.fam_hi = b.fam_lo AND b.fam_lo = b.fam_hi THEN " if c == "revenue" else "CASE WHEN true THEN ") + f"a.{c} + n.{c} - b.{c} END AS {c}" for c in FLOW)},
    {", ".join("n." + c for c in STOCK)}, max(abs(n.offset_days - b.offset_days)) OVER (PARTITION BY a.entity_id, a.period_end ORDER BY n.k) AS drift
  FROM (SELECT *, lag(period_end) OVER (PARTITION BY entity_id ORDER BY period_end) AS prev_end FROM annual_statements) a
  JOIN ytd n ON n.entity_id = a.entity_id AND n.anchor = a.period_end
  JOIN ytd b ON b.entity_id = a.entity_id AND b.anchor = a.prev_end AND b.k = n.k
  WHERE a.period_end - a.prev_end BETWEEN 330 AND 400) WHERE drift <= 14""",
)
cte(
    "ttm",
    f"""SELECT * FROM (
  SELECT entity_id, period_end, CASE WHEN fills THEN greatest(b_filed, x_filed) ELSE b_filed END AS filed_date, revenue_tag, {", ".join(FLOW + STOCK)},
    CASE WHEN fills THEN 'bridged' ELSE method END AS method
  FROM (SELECT entity_id, period_end, b.filed AS b_filed, x.filed AS x_filed, method, {", ".join(f"coalesce(b.{c}, x.{c}) AS {c}" for c in ("revenue_tag",) + FLOW + STOCK)},
    coalesce({" OR ".join(f"(b.{c} IS NULL AND x.{c} IS NOT NULL)" for c in FLOW)}, false) AS fills
    FROM (SELECT entity_id, period_end, filed_date AS filed, revenue_tag, {", ".join(FLOW + STOCK)}, 'annual' AS method FROM annual_statements
      UNION ALL SELECT entity_id, period_end, filed, revenue_tag, {", ".join(FLOW + STOCK)}, 'four_quarter_sum' FROM rolled_ttm r
      WHERE NOT EXISTS (SELECT 1 FROM annual_statements a WHERE a.entity_id = r.entity_id AND a.period_end = r.period_end)) b
    FULL JOIN bridged_ttm x USING (entity_id, period_end)))
WHERE CAST(revenue IS NOT NULL AS INT) + CAST(operating_income IS NOT NULL AS INT) + CAST(net_income IS NOT NULL AS INT) + CAST(eps_diluted IS NOT NULL AS INT) >= 2""",
)
cte(
    "ttm_versions",
    """SELECT *, CAST(filed_date AS TIMESTAMP) + INTERVAL (entity_id % 5) DAY + INTERVAL 12 HOUR AS observed_at, 1 AS version FROM ttm
UNION ALL SELECT * REPLACE (revenue * 1.01 AS revenue, net_income * 0.98 AS net_income),
  CAST(filed_date AS TIMESTAMP) + INTERVAL (entity_id % 5) DAY + INTERVAL 12 HOUR + INTERVAL 120 DAY, 2 FROM ttm WHERE entity_id % 3 = 0""",
)
cte("decisions", "SELECT entity_id, session_date, session_no, close, CAST(session_date AS TIMESTAMP) + INTERVAL 21 HOUR AS decision_at FROM panel WHERE entity_id >= 0")

cte(
    "earnings_versions",
    """WITH q AS (SELECT entity_id, period_end, entity_id * 100000 + year(period_end) * 10 + quarter(period_end) AS event_id,
    CAST(period_end + CAST(25 + entity_id % 7 AS INTEGER) AS DATE) AS reported_date, CASE entity_id % 3 WHEN 0 THEN '07:30' WHEN 1 THEN '16:15' END AS event_time,
    eps_diluted AS reported_eps, lag(eps_diluted) OVER w AS estimated_eps, (eps_diluted - lag(eps_diluted) OVER w) / nullif(abs(lag(eps_diluted) OVER w), 0) * 100 AS surprise_percent,
    CASE WHEN lag(revenue) OVER w > 0 THEN (revenue / lag(revenue) OVER w - 1) * 100 END AS revenue_surprise_percent
  FROM quarter_statements WINDOW w AS (PARTITION BY entity_id ORDER BY period_end)),
first_seen AS (SELECT *, CAST(reported_date AS TIMESTAMP) + INTERVAL 25 HOUR AS observed_at FROM q)
SELECT * FROM first_seen UNION ALL
SELECT * REPLACE (surprise_percent + 1.0 AS surprise_percent, observed_at + INTERVAL 10 DAY AS observed_at) FROM first_seen WHERE (entity_id + quarter(period_end)) % 4 = 0""",
)
cte(
    "report_calendar",
    """WITH q AS (SELECT DISTINCT entity_id, event_id, period_end, reported_date FROM earnings_versions)
SELECT entity_id, event_id, CAST(CASE WHEN (entity_id + quarter(period_end)) % 5 = 0 THEN reported_date + 6 ELSE reported_date END AS DATE) AS expected_date, CAST(period_end AS TIMESTAMP) + INTERVAL 1 DAY AS observed_at FROM q
UNION ALL SELECT entity_id, event_id, reported_date, CAST(period_end AS TIMESTAMP) + INTERVAL 13 DAY FROM q WHERE (entity_id + quarter(period_end)) % 5 = 0""",
)
cte(
    "analyst_snapshots",
    """SELECT CAST(c_nationkey AS BIGINT) AS entity_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS period_date,
  count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS strong_buy, count(*) FILTER (WHERE o_orderpriority = '2-HIGH') AS buy,
  count(*) FILTER (WHERE o_orderpriority = '3-MEDIUM') AS hold, count(*) FILTER (WHERE o_orderpriority = '4-NOT SPECIFIED') AS sell,
  count(*) FILTER (WHERE o_orderpriority = '5-LOW') AS strong_sell, CAST(last_day(date_trunc('month', o_orderdate)) AS TIMESTAMP) + INTERVAL 20 HOUR AS observed_at, 'orders' AS source
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, last_day(date_trunc('month', o_orderdate))""",
)
cte("quarter_decisions", "SELECT * FROM decisions WHERE (entity_id, session_date) IN (SELECT entity_id, min(session_date) FROM decisions GROUP BY entity_id, date_trunc('quarter', session_date))")
