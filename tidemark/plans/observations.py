"""Versions, memberships, news, macro series, estimates and guidance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import midpoint, r4, r6, relative_change
from tidemark.operators import asof as A
from tidemark.operators import bars as B
from tidemark.operators import macro as M
from tidemark.operators import opinions as O
from tidemark.operators import sets as Z
from tidemark.plans.ctes import cte, rnd
from tidemark.plans.registry import query
from tidemark.plans.tables import Tables

cte("members", "SELECT l_suppkey AS supplier, CAST(min(l_shipdate) AS DATE) AS effective_from, CASE WHEN l_suppkey % 4 <> 0 THEN CAST(max(l_shipdate) AS DATE) - CAST(l_suppkey % 500 AS INTEGER) END AS effective_to FROM lineitem GROUP BY 1")


def members(t: Tables) -> DataFrame:
    g = t.raw("lineitem").groupBy(F.col("l_suppkey").alias("supplier")).agg(F.to_date(F.min("l_shipdate")).alias("effective_from"), F.to_date(F.max("l_shipdate")).alias("last"))
    to = F.when(F.col("supplier") % 4 != 0, F.expr("date_sub(last, cast(supplier % 500 as int))"))
    return g.select("supplier", "effective_from", to.alias("effective_to"))


@query(
    "membership_interval_join",
    "J9 X9",
    "SELECT s.s_nationkey, year(o.d) AS year, count(*) AS member_days FROM (SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS d FROM orders) o JOIN members m ON m.effective_from <= o.d AND (m.effective_to IS NULL OR o.d < m.effective_to) JOIN supplier s ON s.s_suppkey = m.supplier GROUP BY 1, 2",
)
def membership_interval_join(t: Tables) -> DataFrame:
    months = t.raw("orders").select(F.trunc("o_orderdate", "month").alias("d")).distinct()
    s = t.raw("supplier").select(F.col("s_suppkey").alias("supplier"), "s_nationkey")
    active = A.active_by_month(members(t).join(s, "supplier"), ["s_nationkey"], months, "d", "effective_from", "effective_to")
    return active.groupBy("s_nationkey", F.year("d").alias("year")).agg(F.sum("active").alias("member_days")).where("member_days > 0")


@query(
    "member_asof",
    "P5",
    """SELECT l_suppkey AS supplier, count(*) AS line_count, count(*) FILTER (WHERE is_member) AS member_lines FROM (SELECT l.l_suppkey, EXISTS (SELECT 1 FROM members m WHERE m.supplier = l.l_suppkey AND m.effective_from <= CAST(l.l_shipdate AS DATE)
  AND (m.effective_to IS NULL OR CAST(l.l_shipdate AS DATE) < m.effective_to)) AS is_member FROM lineitem l) GROUP BY 1""",
)
def member_asof(t: Tables) -> DataFrame:
    lines = t.raw("lineitem").select(F.col("l_suppkey").alias("supplier"), F.to_date("l_shipdate").alias("day"))
    # Lines of one supplier and day share the answer.
    days = lines.groupBy("supplier", "day").agg(F.count("*").alias("n")).withColumn("cutoff", F.col("day").cast("timestamp_ntz") + F.expr("interval 21 hours"))
    d = A.member_asof(days, members(t), ["supplier"], "cutoff", "day", "effective_from", "effective_to")
    return d.groupBy("supplier").agg(F.sum("n").alias("line_count"), F.sum(F.when(F.col("is_member"), F.col("n")).otherwise(0)).alias("member_lines"))


@query(
    "change_versions",
    "W14 X3",
    "SELECT event_id, user_id, event_type, ts FROM (SELECT *, CAST(floor(value / 25) AS BIGINT) AS state, lag(CAST(floor(value / 25) AS BIGINT)) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS prev FROM events) WHERE state IS DISTINCT FROM prev",
)
def change_versions(t: Tables) -> DataFrame:
    return A.change_points(t.raw("events"), ["user_id", "event_type"], ["ts", "event_id"], F.floor(F.col("value") / 25)).select("event_id", "user_id", "event_type", "ts")


@query(
    "event_asof",
    "J10 J18",
    """SELECT e.event_id, p.event_id AS last_view, p.ts AS view_ts FROM events e ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') p ON p.user_id = e.user_id AND p.ts <= e.ts WHERE e.event_type = 'purchase'""",
)
def event_asof(t: Tables) -> DataFrame:
    """Each purchase with the user's last view before it; a user's history is split by day."""
    e = t.raw("events")
    views = e.where(F.col("event_type") == "view").select("user_id", F.col("ts").alias("view_ts"), F.col("event_id").alias("last_view"))
    buys = e.where(F.col("event_type") == "purchase").select("event_id", "user_id", "ts")
    out = A.asof_best(buys, views, ["user_id"], "ts", "view_ts", ["last_view", "view_ts"], best=["view_ts", "last_view"], block="day")
    return out.select("event_id", "last_view", "view_ts")


@query(
    "trailing_news",
    "A21 X5",
    f"""WITH d AS (SELECT user_id, day, day + INTERVAL 21 HOUR AS cutoff FROM (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events)), n AS (SELECT user_id, ts AS published, ts + INTERVAL (event_id % 48) HOUR AS observed, CASE WHEN event_type <> 'error' THEN CAST(round(value * 100) AS BIGINT) END AS sentiment FROM events)
SELECT d.user_id, d.day, count(*) AS articles, count(sentiment) AS with_sentiment, {rnd('sum(sentiment) / CAST(nullif(count(sentiment), 0) AS DOUBLE) / 100', 4)} AS mean_sentiment FROM d JOIN n ON n.user_id = d.user_id AND n.published >= d.cutoff - INTERVAL 7 DAY AND greatest(n.published, n.observed) <= d.cutoff GROUP BY 1, 2""",
)
def trailing_news(t: Tables) -> DataFrame:
    e = t.raw("events")
    d = e.select("user_id", F.to_date("ts").alias("day")).distinct().withColumn("cutoff", F.col("day").cast("timestamp_ntz") + F.expr("interval 21 hours"))
    n = e.select("user_id", F.col("ts").alias("published"), (F.col("ts") + F.expr("make_dt_interval(0, cast(event_id % 48 as int))")).alias("observed"), F.when(F.col("event_type") != "error", F.round(F.col("value") * 100).cast("long")).alias("sentiment"))
    aggs = [F.count("*").alias("articles"), F.count("sentiment").alias("with_sentiment"), (F.sum("sentiment") / F.nullif(F.count("sentiment"), F.lit(0)) / 100).alias("m")]
    s = A.trailing_stats(d, n, ["user_id"], "cutoff", "published", "observed", 7, aggs)
    return s.where(F.col("articles").isNotNull()).select("user_id", "day", "articles", "with_sentiment", r4("m").alias("mean_sentiment"))


cte(
    "macro_obs",
    """SELECT o_orderpriority AS series_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS observation_date, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / 1e6 AS value, 'units' AS units,
  CASE WHEN o_orderpriority < '3' THEN CAST(last_day(date_trunc('month', o_orderdate)) AS DATE) + 12 END AS vintage_date, CAST(last_day(date_trunc('month', o_orderdate)) AS TIMESTAMP) + INTERVAL 20 DAY AS observed_at
FROM orders GROUP BY 1, 2, last_day(date_trunc('month', o_orderdate))""",
)


def macro_obs(t: Tables) -> DataFrame:
    from tidemark.plans.tables import cents

    o = t.raw("orders").groupBy(F.col("o_orderpriority").alias("series_id"), F.trunc("o_orderdate", "month").alias("observation_date")).agg((F.sum(cents("o_totalprice")).cast("double") / 1e6).alias("value"))
    end = F.last_day("observation_date")
    return t.shared("macro_obs", o.withColumns({"units": F.lit("units"), "vintage_date": F.when(F.col("series_id") < "3", F.date_add(end, 12)), "observed_at": end.cast("timestamp_ntz") + F.expr("interval 20 days")}))


_MACRO_SQL = """asks AS (SELECT s.series_id, c.session_date, CAST(c.session_date AS TIMESTAMP) + INTERVAL 21 HOUR AS cutoff FROM calendar c, (SELECT DISTINCT series_id FROM macro_obs) s),
usable AS (SELECT *, CASE WHEN vintage_date IS NOT NULL THEN CAST(vintage_date + 1 AS TIMESTAMP) ELSE observed_at END AS usable_at FROM macro_obs),
newest AS (SELECT a.*, m.observation_date, m.value FROM asks a LEFT JOIN LATERAL (SELECT * FROM usable u WHERE u.series_id = a.series_id AND u.usable_at <= a.cutoff ORDER BY observation_date DESC, usable_at DESC LIMIT 1) m ON true)"""


def macro_latest(t: Tables) -> DataFrame:
    o = macro_obs(t)
    # Sessions times the handful of series.
    series = o.groupBy().agg(F.collect_set("series_id").alias("s")).scalar()
    asks = t.calendar.select("session_date", F.explode(series).alias("series_id"))
    asks = asks.withColumn("cutoff", F.col("session_date").cast("timestamp_ntz") + F.expr("interval 21 hours"))
    return M.latest_observation(asks, o, "cutoff", 75)


@query(
    "macro_asof",
    "J12 Q12",
    f"WITH {_MACRO_SQL} SELECT series_id, session_date, CASE WHEN session_date - observation_date <= 75 THEN observation_date END AS observation_date, CASE WHEN session_date - observation_date <= 75 THEN {rnd('value', 4)} END AS value FROM newest",
)
def macro_asof(t: Tables) -> DataFrame:
    return macro_latest(t).select("series_id", "session_date", "observation_date", r4("value").alias("value"))


@query(
    "macro_change",
    "J13",
    f"""WITH {_MACRO_SQL}, l AS (SELECT * FROM newest WHERE session_date - observation_date <= 75)
SELECT l.series_id, l.session_date, p.observation_date AS prior_date, {rnd('l.value / p.value - 1')} AS change FROM l LEFT JOIN LATERAL (SELECT * FROM macro_obs o WHERE o.series_id = l.series_id AND abs(o.observation_date - (l.observation_date - 31)) <= 10
  ORDER BY abs(o.observation_date - (l.observation_date - 31)), o.observation_date LIMIT 1) p ON true""",
)
def macro_change(t: Tables) -> DataFrame:
    latest = macro_latest(t).where(F.col("observation_date").isNotNull())
    obs = macro_obs(t)
    d = M.change_against(latest, obs, 31, 10, "ratio")
    n = A.nearest(latest.withColumn("_t", F.date_sub("observation_date", 31)), obs.select("series_id", F.col("observation_date").alias("prior_date")), ["series_id"], "_t", "prior_date", ["prior_date"], 10)
    return d.join(n.select("series_id", "session_date", "prior_date"), ["series_id", "session_date"]).select("series_id", "session_date", "prior_date", r6("change").alias("change"))


#: The tables' series stand for those that have a greatest age and a change of their own.
_SERIES = {"1-URGENT": "CPIAUCSL", "2-HIGH": "PAYEMS", "3-MEDIUM": "GDPC1", "4-NOT SPECIFIED": "DTWEXBGS", "5-LOW": "DFF"}


def named_macro(t: Tables) -> DataFrame:
    names = F.create_map(*[F.lit(x) for kv in _SERIES.items() for x in kv])
    return macro_obs(t).withColumn("series_id", F.element_at(names, F.col("series_id")))


def _macro_vector_sql() -> str:
    ages = " ".join(f"WHEN '{_SERIES[k]}' THEN {M.MAX_AGES[_SERIES[k]]}" for k in _SERIES)
    rules = ", ".join(f"('{s}', {lag}, {tol}, '{kind}')" for s, lag, tol, kind in M.CHANGES)
    names = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _SERIES.items())
    return f"""WITH o AS (SELECT * REPLACE (CASE series_id {names} END AS series_id) FROM macro_obs), asks AS (SELECT s.series_id, c.session_date, CAST(c.session_date AS TIMESTAMP) + INTERVAL 21 HOUR AS cutoff FROM calendar c, (SELECT DISTINCT series_id FROM o) s),
usable AS (SELECT *, CASE WHEN vintage_date IS NOT NULL THEN CAST(vintage_date + 1 AS TIMESTAMP) ELSE observed_at END AS usable_at FROM o),
l AS (SELECT a.*, m.observation_date, m.value FROM asks a JOIN LATERAL (SELECT * FROM usable u WHERE u.series_id = a.series_id AND u.usable_at <= a.cutoff ORDER BY observation_date DESC, usable_at DESC LIMIT 1) m ON true
  WHERE a.session_date - m.observation_date <= CASE a.series_id {ages} END),
r AS (SELECT * FROM (VALUES {rules}) r(series_id, lag, tol, kind))
SELECT l.series_id, l.session_date, l.session_date - l.observation_date AS age_days, {rnd('l.value', 4)} AS value, CASE r.kind WHEN 'ratio' THEN {rnd('l.value / p.value - 1')} WHEN 'difference' THEN {rnd('l.value - p.value')} END AS change
FROM l LEFT JOIN r USING (series_id) LEFT JOIN LATERAL (SELECT * FROM usable u WHERE u.series_id = l.series_id AND abs(u.observation_date - (l.observation_date - r.lag)) <= r.tol ORDER BY abs(u.observation_date - (l.observation_date - r.lag)), u.observation_date LIMIT 1) p ON true"""


@query("macro_vector", "J12 J13 Q12", _macro_vector_sql())
def macro_vector(t: Tables) -> DataFrame:
    """Each session's newest value of every series no older than the series allows, and its change by the series' own rule."""
    o = named_macro(t)
    asks = t.calendar.select("session_date", F.explode(F.array(*[F.lit(s) for s in _SERIES.values()])).alias("series_id"))
    asks = asks.withColumn("cutoff", F.col("session_date").cast("timestamp_ntz") + F.expr("interval 21 hours"))
    v = M.macro_vector(asks, o, "cutoff")
    return v.select("series_id", "session_date", "age_days", r4("value").alias("value"), r6("change").alias("change"))


cte(
    "raw_estimates",
    """SELECT CAST(c_nationkey AS BIGINT) AS entity_id, CAST(date_trunc('week', o_orderdate) AS DATE) AS capture_day, avg(round(o_totalprice * 100)) / 1e6 AS eps_consensus, min(o_totalprice) / 1e4 + CASE WHEN c_nationkey % 5 = 0 THEN 20 ELSE 0 END AS eps_low, max(o_totalprice) / 1e4 AS eps_high,
  sum(CAST(round(o_totalprice * 100) AS BIGINT)) / 1e8 AS revenue_consensus, CAST(count(*) AS DOUBLE) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, c_nationkey""",
)
cte(
    "estimates",
    """SELECT entity_id, CAST(capture_day AS TIMESTAMP) + INTERVAL 18 HOUR AS captured_at, CAST(date_trunc('quarter', capture_day) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS fiscal_period_end, 'quarter' AS period_type, '0q' AS relative_period, 'orders' AS source,
  eps_consensus, revenue_consensus, CASE WHEN eps_low <= eps_high THEN eps_low END AS eps_low, CASE WHEN eps_low <= eps_high THEN eps_high END AS eps_high, CASE entity_id % 3 WHEN 0 THEN 'gaap' WHEN 1 THEN 'adjusted' ELSE 'unknown' END AS eps_basis,
  coalesce(eps_low <= eps_high AND (eps_consensus < eps_low OR eps_consensus > eps_high), false) AS eps_outside, n FROM raw_estimates""",
)


def estimates(t: Tables) -> DataFrame:
    """Weekly captures of one estimate per entity for the running quarter, normalised."""
    from tidemark.plans.tables import cents

    o, c = t.raw("orders"), t.raw("customer")
    j = o.join(c.select("c_custkey", F.col("c_nationkey").cast("long").alias("entity_id")), F.col("o_custkey") == F.col("c_custkey"))
    price = F.col("o_totalprice")
    g = j.groupBy("entity_id", F.trunc("o_orderdate", "week").alias("day")).agg(
        (F.avg(cents("o_totalprice")) / 1e6).alias("eps_consensus"), (F.min(price) / 1e4).alias("lo"), (F.max(price) / 1e4).alias("eps_high"),
        (F.sum(cents("o_totalprice")) / 1e8).alias("revenue_consensus"), F.count("*").cast("double").alias("eps_analyst_count"),
    )
    none = F.lit(None).cast("double")
    basis = F.when(F.col("entity_id") % 3 == 0, "US-GAAP").when(F.col("entity_id") % 3 == 1, "Normalized")
    raw = g.select(
        "entity_id", (F.col("day").cast("timestamp_ntz") + F.expr("interval 18 hours")).alias("captured_at"), F.date_sub(F.add_months(F.trunc("day", "quarter"), 3), 1).alias("fiscal_period_end"),
        F.lit("quarter").alias("period_type"), F.lit("0q").alias("relative_period"), F.lit("orders").alias("source"), "eps_consensus", (F.col("lo") + F.when(F.col("entity_id") % 5 == 0, 20).otherwise(0)).alias("eps_low"), "eps_high", "eps_analyst_count",
        "revenue_consensus", none.alias("revenue_low"), none.alias("revenue_high"), F.col("eps_analyst_count").alias("revenue_analyst_count"), F.lit("usd").alias("eps_currency"), F.lit("USD ").alias("revenue_currency"),
        basis.alias("basis_eps"), F.lit(None).cast("string").alias("basis_record"), F.concat_ws(":", "entity_id", "day").alias("estimate_id"),
    )
    return t.shared("estimates", O.normalize_estimates(raw))


@query(
    "normalized_estimates",
    "F27",
    f"SELECT entity_id, captured_at, fiscal_period_end, eps_basis, {rnd('eps_consensus')} AS eps_consensus, {rnd('eps_low')} AS eps_low, {rnd('eps_high')} AS eps_high, eps_outside, CAST(n AS BIGINT) AS analysts FROM estimates",
)
def normalized_estimates(t: Tables) -> DataFrame:
    e = estimates(t)
    return e.select("entity_id", "captured_at", "fiscal_period_end", "eps_basis", *[r6(c).alias(c) for c in ("eps_consensus", "eps_low", "eps_high")], F.array_contains("issues", "eps_consensus_outside_interval").alias("eps_outside"), F.col("eps_analyst_count").alias("analysts"))


LAGS = (7, 30, 90)


def _revision_sql(n: int) -> str:
    fresh = f"p.captured_at >= p.decision_at - INTERVAL 7 DAY AND at_{n} >= p.decision_at - INTERVAL {n + 7} DAY"
    change = lambda now, old: rnd(f"greatest(-2, least(2, ({now} - {old}) / nullif(abs({old}), 0)))")
    return f"""CASE WHEN {fresh} AND NOT eps_outside AND NOT out_{n} AND eps_basis <> 'unknown' THEN {change('eps_consensus', f'eps_{n}')} END AS eps_revision_{n}d,
  CASE WHEN {fresh} THEN {change('revenue_consensus', f'rev_{n}')} END AS revenue_revision_{n}d"""


def _prior_sql(n: int) -> str:
    return f"""LEFT JOIN LATERAL (SELECT captured_at AS at_{n}, eps_consensus AS eps_{n}, revenue_consensus AS rev_{n}, eps_outside AS out_{n} FROM estimates e WHERE e.entity_id = c.entity_id AND e.fiscal_period_end = c.fiscal_period_end
  AND e.captured_at <= c.decision_at - INTERVAL {n} DAY ORDER BY captured_at DESC LIMIT 1) o{n} ON true"""


@query(
    "estimate_revisions",
    "J15 W28 F6",
    f"""WITH d AS (SELECT * FROM decisions), cur AS (SELECT d.entity_id, d.session_date, d.decision_at, e.* EXCLUDE (entity_id) FROM d JOIN LATERAL (SELECT * FROM estimates e WHERE e.entity_id = d.entity_id AND e.captured_at <= d.decision_at ORDER BY captured_at DESC LIMIT 1) e ON true),
p AS (SELECT * FROM cur c {" ".join(_prior_sql(n) for n in LAGS)})
SELECT d.entity_id, d.session_date, p.fiscal_period_end, {", ".join(_revision_sql(n) for n in LAGS)} FROM d LEFT JOIN p USING (entity_id, session_date)""",
)
def estimate_revisions(t: Tables) -> DataFrame:
    d = O.estimate_revisions(t.decisions, estimates(t), "decision_at", LAGS)
    return d.select("entity_id", "session_date", "fiscal_period_end", *[r6(f"estimate_{m}_revision_{n}d").alias(f"{m}_revision_{n}d") for n in LAGS for m in ("eps", "revenue")])


cte(
    "guidance",
    """SELECT entity_id, entity_id * 1000 + row_number() OVER (PARTITION BY entity_id ORDER BY period_end) AS guidance_id, CAST(period_end - 30 AS TIMESTAMP) + INTERVAL 13 HOUR AS published_at, period_end AS fiscal_period_end, 'quarter' AS period_type, 'USD' AS currency,
  CASE entity_id % 3 WHEN 0 THEN 'gaap' WHEN 1 THEN 'non-gaap' ELSE 'pro forma' END AS eps_method, revenue * 0.95 / 1e6 AS revenue_guidance_low, revenue * 1.05 / 1e6 AS revenue_guidance_high, eps_diluted * 0.9 AS a, eps_diluted * 1.1 AS b FROM quarter_statements""",
)


def guidance(t: Tables) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("entity_id").orderBy("period_end"))
    method = F.when(F.col("entity_id") % 3 == 0, "gaap").when(F.col("entity_id") % 3 == 1, "non-gaap").otherwise("pro forma")
    return t.quarter_statements.select(
        "entity_id", (F.col("entity_id") * 1000 + n).alias("guidance_id"), (F.date_sub("period_end", 30).cast("timestamp_ntz") + F.expr("interval 13 hours")).alias("published_at"), F.col("period_end").alias("fiscal_period_end"),
        F.lit("quarter").alias("period_type"), F.lit("USD").alias("currency"), method.alias("eps_method"), (F.col("revenue") * 0.95 / 1e6).alias("revenue_guidance_low"), (F.col("revenue") * 1.05 / 1e6).alias("revenue_guidance_high"),
        (F.col("eps_diluted") * 0.9).alias("eps_guidance_low"), (F.col("eps_diluted") * 1.1).alias("eps_guidance_high"),
    )


@query(
    "guidance_matches",
    "J26 F8",
    f"""WITH g AS (SELECT *, 'eps' AS metric, CASE eps_method WHEN 'gaap' THEN 'gaap' WHEN 'non-gaap' THEN 'adjusted' END AS basis, (a + b) / 2 AS midpoint FROM guidance WHERE a <= b UNION ALL SELECT *, 'revenue', 'reported_revenue', (revenue_guidance_low + revenue_guidance_high) / 2 FROM guidance WHERE revenue_guidance_low <= revenue_guidance_high)
SELECT guidance_id, metric, e.captured_at, {rnd('midpoint')} AS midpoint, {rnd("CASE WHEN metric = 'eps' THEN eps_consensus ELSE revenue_consensus END")} AS consensus FROM g JOIN LATERAL (SELECT * FROM estimates e WHERE e.entity_id = g.entity_id AND e.fiscal_period_end = g.fiscal_period_end AND e.captured_at < g.published_at
  AND e.captured_at >= g.published_at - INTERVAL 7 DAY AND (metric = 'revenue' OR (e.eps_basis = g.basis AND NOT e.eps_outside)) ORDER BY captured_at DESC LIMIT 1) e ON true WHERE g.basis IS NOT NULL""",
)
def guidance_matches(t: Tables) -> DataFrame:
    m = O.match_guidance(guidance(t), estimates(t))
    return m.select("guidance_id", "metric", "captured_at", r6("midpoint").alias("midpoint"), r6("consensus").alias("consensus"))


@query(
    "guidance_asof",
    "J11 F44",
    f"""WITH g AS (SELECT *, CAST(published_at AS DATE) AS event_date, (revenue_guidance_low + revenue_guidance_high) / 2 AS mid, lag((revenue_guidance_low + revenue_guidance_high) / 2) OVER (PARTITION BY entity_id ORDER BY published_at) AS prev FROM guidance)
SELECT d.entity_id, d.session_date, g.event_date, {rnd('g.mid / nullif(g.prev, 0) - 1')} AS revenue_change, CAST(d.decision_at AS DATE) - g.event_date AS guidance_days_since FROM decisions d LEFT JOIN LATERAL (SELECT * FROM g WHERE g.entity_id = d.entity_id AND g.published_at + INTERVAL (g.guidance_id % 3) DAY <= d.decision_at ORDER BY event_date DESC LIMIT 1) g ON true""",
)
def guidance_asof(t: Tables) -> DataFrame:
    mid = midpoint("revenue_guidance_low", "revenue_guidance_high")
    g = guidance(t).withColumn("mid", mid).withColumn("prev", F.lag("mid").over(Window.partitionBy("entity_id").orderBy("published_at")))
    g = g.select(
        "entity_id", "guidance_id", F.to_date("published_at").alias("event_date"), F.year("fiscal_period_end").alias("fiscal_year"), F.concat(F.lit("Q"), F.quarter("fiscal_period_end")).alias("fiscal_period"),
        (F.col("published_at") + F.expr("make_dt_interval(cast(guidance_id % 3 as int))")).alias("usable_at"), relative_change("mid", "prev").alias("revenue_change"),
    )
    out = O.merge_guidance_asof(t.decisions, g, "decision_at", ["revenue_change"])
    return out.select("entity_id", "session_date", "event_date", r6("revenue_change").alias("revenue_change"), "guidance_days_since")


@query(
    "corroborated_fill",
    "J27",
    """WITH ref AS (SELECT * FROM daily_bars WHERE source = 'R'), fb AS (SELECT a.entity_id, a.session_date, 'fallback' AS source, CASE WHEN a.entity_id % 4 = 0 AND r.close IS NOT NULL THEN r.close * 1.05 WHEN r.close IS NOT NULL THEN r.close * 1.0005 ELSE a.close END AS close FROM (SELECT * FROM daily_bars WHERE source = 'A') a LEFT JOIN ref r USING (entity_id, session_date)),
ov AS (SELECT r.entity_id, r.session_date, abs(f.close / r.close - 1) <= 0.001 AS agrees FROM ref r JOIN fb f USING (entity_id, session_date)), ok AS (SELECT entity_id FROM ov GROUP BY 1 HAVING bool_and(agrees)),
holes AS (SELECT * FROM fb WHERE entity_id IN (SELECT entity_id FROM ok) AND NOT EXISTS (SELECT 1 FROM ref r WHERE r.entity_id = fb.entity_id AND r.session_date = fb.session_date))
SELECT entity_id, session_date, (SELECT max(o.session_date) FROM ov o WHERE o.entity_id = h.entity_id AND o.session_date < h.session_date) AS anchor_before, (SELECT min(o.session_date) FROM ov o WHERE o.entity_id = h.entity_id AND o.session_date > h.session_date) AS anchor_after FROM holes h
WHERE EXISTS (SELECT 1 FROM ov o WHERE o.entity_id = h.entity_id AND o.session_date < h.session_date AND h.session_date - o.session_date <= 7) AND EXISTS (SELECT 1 FROM ov o WHERE o.entity_id = h.entity_id AND o.session_date > h.session_date AND o.session_date - h.session_date <= 7)""",
)
def corroborated_fill(t: Tables) -> DataFrame:
    ref = t.daily_bars.where(F.col("source") == "R")
    r = ref.select("entity_id", "session_date", F.col("close").alias("rc"))
    a = t.daily_bars.where(F.col("source") == "A").select("entity_id", "session_date", "close").join(r, ["entity_id", "session_date"], "left")
    close = F.when(F.col("rc").isNull(), F.col("close")).when(F.col("entity_id") % 4 == 0, F.col("rc") * 1.05).otherwise(F.col("rc") * 1.0005)
    none = F.lit(None).cast("double")
    fb = a.select("entity_id", "session_date", F.lit("fallback").alias("source"), close.alias("close"), none.alias("open"), none.alias("high"), none.alias("low"), none.alias("volume"))
    out = B.corroborated_fill(ref, fb, t.daily_calendar)
    return out.select("entity_id", "session_date", "anchor_before", "anchor_after")


@query(
    "membership_sync",
    "U4 U3",
    "SELECT supplier, CASE WHEN a.s IS NULL THEN 'added' WHEN b.s IS NULL THEN 'removed' ELSE 'kept' END AS change FROM (SELECT DISTINCT l_suppkey AS supplier, 1 AS s FROM lineitem WHERE l_discount < 0.02 AND l_quantity < 5) a FULL JOIN (SELECT DISTINCT l_suppkey AS supplier, 1 AS s FROM lineitem WHERE l_discount > 0.08 AND l_quantity < 5) b USING (supplier)",
)
def membership_sync(t: Tables) -> DataFrame:
    li = t.raw("lineitem").where(F.col("l_quantity") < 5).withColumnRenamed("l_suppkey", "supplier")
    return Z.membership_changes(li.where(F.col("l_discount") < 0.02), li.where(F.col("l_discount") > 0.08), "supplier")


@query(
    "key_preserving_rename",
    "U8",
    "SELECT 'N' || n_nationkey AS old, n_name AS new, CAST(n_nationkey AS BIGINT) AS identity FROM nation WHERE n_nationkey % 2 = 0",
)
def key_preserving_rename(t: Tables) -> DataFrame:
    e = t.entities
    cur = e.select(F.col("ticker").alias("name"), F.col("entity_id").alias("identity"))
    new = e.select(F.col("name"), F.when(F.col("entity_id") % 2 == 0, F.col("entity_id")).otherwise(-F.col("entity_id") - 1).alias("identity"))
    return Z.renames(cur, new, e.select(F.col("ticker").alias("old"), F.col("name").alias("new")))


@query(
    "preserved_fields",
    "S14",
    f"SELECT entity_id, period_end, {rnd('coalesce(CASE WHEN entity_id % 2 = 0 THEN NULL ELSE cash END, CASE WHEN entity_id % 3 <> 0 THEN cash END)', 4)} AS cash, entity_id % 2 = 0 AND entity_id % 3 <> 0 AS retained FROM quarter_statements",
)
def preserved_fields(t: Tables) -> DataFrame:
    q = t.quarter_statements
    cur = q.withColumn("cash", F.when(F.col("entity_id") % 2 != 0, F.col("cash"))).select("entity_id", "period_end", "filed_date", "cash")
    prev = q.where(F.col("entity_id") % 3 != 0).select("entity_id", "period_end", "filed_date", "cash")
    out = Z.preserve_fields(cur, prev, ["entity_id", "period_end", "filed_date"], ["cash"])
    return out.select("entity_id", "period_end", r4("cash").alias("cash"), (F.size("retained_fields") > 0).alias("retained"))


@query(
    "valuation_on_price_date",
    "J28 Q15 F11",
    f"SELECT v.entity_id, v.session_date, {rnd('v.close / e.eps')} AS pe FROM decisions v JOIN (SELECT entity_id, session_date, last_eps AS eps FROM (SELECT d.entity_id, d.session_date, (SELECT arg_max(eps_diluted, period_end) FROM quarter_statements q WHERE q.entity_id = d.entity_id AND q.filed_date <= d.session_date AND eps_diluted IS NOT NULL) AS last_eps FROM decisions d)) e USING (entity_id, session_date) WHERE e.eps > 0",
)
def valuation_on_price_date(t: Tables) -> DataFrame:
    q = t.quarter_statements.where(F.col("eps_diluted").isNotNull()).select("entity_id", "period_end", F.col("filed_date"), "eps_diluted")
    v = A.latest_known(t.decisions, q, ["entity_id"], "session_date", "filed_date", "period_end", ["eps_diluted"], ["filed_date"])
    return v.where(F.col("eps_diluted") > 0).select("entity_id", "session_date", r6(F.col("close") / F.col("eps_diluted")).alias("pe"))
