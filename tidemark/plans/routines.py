"""Smaller operators, each bound to whole tables so that a query exercises it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import percent_to_decimal, r2, r4, r6
from tidemark.operators import audit as U
from tidemark.operators import calendar as C
from tidemark.operators import scores as S
from tidemark.operators import sets as Z
from tidemark.plans.ctes import rnd
from tidemark.plans.registry import query
from tidemark.plans.tables import Tables
from tidemark.session import new_folder
from tidemark.sources import payloads as P
from tidemark.sources import sinks as K


@query(
    "statement_upsert",
    "S13",
    f"SELECT entity_id, period_end, CASE WHEN entity_id % 3 = 0 THEN 2 ELSE 1 END AS version, {rnd('CASE WHEN entity_id % 3 = 0 THEN revenue * 1.01 ELSE revenue END', 2)} AS revenue FROM quarter_statements",
)
def statement_upsert(t: Tables) -> DataFrame:
    """Stored statements take the newer version of each period; older arrivals change nothing."""
    q = t.quarter_statements.select("entity_id", "period_end", "revenue", F.lit(1).alias("version"))
    newer = q.where(F.col("entity_id") % 3 == 0).select("entity_id", "period_end", (F.col("revenue") * 1.01).alias("revenue"), F.lit(2).alias("version"))
    older = q.where(F.col("entity_id") % 3 == 1).select("entity_id", "period_end", (F.col("revenue") * 0.5).alias("revenue"), F.lit(0).alias("version"))
    return Z.upsert(q, newer.unionByName(older), ["entity_id", "period_end"], ["version"]).select("entity_id", "period_end", "version", r2("revenue").alias("revenue"))


_GUIDED = """g AS (SELECT entity_id, period_end, CASE WHEN entity_id % 4 <> 0 THEN eps_diluted * 0.9 END AS a, eps_diluted * 1.1 AS b, lag(eps_diluted) OVER w * 0.9 AS pa, lag(eps_diluted) OVER w * 1.1 AS pb, eps_diluted * 1.05 AS c,
  revenue * 0.95 AS ra, CASE WHEN entity_id % 5 <> 0 THEN revenue * 1.05 END AS rb, lag(revenue) OVER w * 0.95 AS rpa, lag(revenue) OVER w * 1.05 AS rpb, revenue * 1.02 AS rc FROM quarter_statements WINDOW w AS (PARTITION BY entity_id ORDER BY period_end)),
m AS (SELECT entity_id, period_end, coalesce((a + b) / 2, a, b) AS e, coalesce((pa + pb) / 2, pa, pb) AS pe, c, coalesce((ra + rb) / 2, ra, rb) AS r, coalesce((rpa + rpb) / 2, rpa, rpb) AS pr, rc FROM g)"""


@query(
    "guidance_signals",
    "F9",
    f"WITH {_GUIDED} SELECT entity_id, period_end, "
    + ", ".join(f"{rnd(f'CASE WHEN {now} IS NOT NULL AND {old} <> 0 THEN ({now} - {old}) / abs({old}) END')} AS {name}" for name, now, old in (("guidance_eps_vs_consensus", "e", "c"), ("eps_guidance_change", "e", "pe"), ("guidance_revenue_vs_consensus", "r", "rc"), ("revenue_guidance_change", "r", "pr")))
    + " FROM m",
)
def guidance_signals(t: Tables) -> DataFrame:
    w = Window.partitionBy("entity_id").orderBy("period_end")
    eps, rev = F.col("eps_diluted"), F.col("revenue")
    q = t.quarter_statements.select(
        "entity_id", "period_end",
        F.when(F.col("entity_id") % 4 != 0, eps * 0.9).alias("eps_guidance_low"), (eps * 1.1).alias("eps_guidance_high"), (F.lag(eps).over(w) * 0.9).alias("previous_eps_guidance_low"), (F.lag(eps).over(w) * 1.1).alias("previous_eps_guidance_high"), (eps * 1.05).alias("consensus_eps_at_event"),
        (rev * 0.95).alias("revenue_guidance_low"), F.when(F.col("entity_id") % 5 != 0, rev * 1.05).alias("revenue_guidance_high"), (F.lag(rev).over(w) * 0.95).alias("previous_revenue_guidance_low"), (F.lag(rev).over(w) * 1.05).alias("previous_revenue_guidance_high"), (rev * 1.02).alias("consensus_revenue_at_event"),
    )
    return q.select("entity_id", "period_end", *[r6(c).alias(n) for n, c in S.event_signals().items()])


@query("provider_months", "F29", "SELECT event_id, CASE WHEN event_id % 6 < 4 THEN CAST(date_trunc('month', ts) - to_months(CAST(event_id % 6 AS INTEGER)) AS DATE) END AS month FROM events")
def provider_months(t: Tables) -> DataFrame:
    k = F.col("event_id") % 6
    label = F.when(k == 0, "0m").when(k < 4, F.concat(F.lit("-"), k, F.lit("m"))).otherwise(F.concat(F.lit("+"), k, F.lit("m")))
    return t.raw("events").select("event_id", S.provider_month(F.to_date("ts"), label).alias("month"))


@query(
    "projected_dates",
    "F41",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 AND o_custkey % 500 - 50 BETWEEN 0 AND 400 THEN CAST(o_orderdate AS DATE) + CAST(o_custkey % 500 - 50 AS INTEGER) END AS projected FROM orders",
)
def projected_dates(t: Tables) -> DataFrame:
    o = t.raw("orders").select("o_orderkey", F.to_date("o_orderdate").alias("today"), F.expr("date_add(to_date(o_orderdate), cast(o_custkey % 500 - 50 as int))").alias("d"))
    dates = F.when(F.col("o_orderkey") % 3 == 0, F.array("d", F.date_add("d", 90))).otherwise(F.array("d"))
    return o.select("o_orderkey", S.projected_date(dates, F.col("today")).alias("projected"))


@query(
    "reusable_observations",
    "P22",
    """WITH c AS (SELECT max(ts) AS clock FROM events) SELECT event_id FROM events, c
WHERE ts >= clock - INTERVAL 400 HOUR AND ts <= clock AND ts > clock - INTERVAL 300 HOUR AND CAST(ts AS DATE) + CAST(event_id % 40 AS INTEGER) >= CAST(clock AS DATE)""",
)
def reusable_observations(t: Tables) -> DataFrame:
    e = t.raw("events")
    clock = e.agg(F.max("ts")).scalar()
    rows = e.select("event_id", F.col("ts").alias("observed_at"), F.array(F.expr("date_add(to_date(ts), cast(event_id % 40 as int))")).alias("dates"))
    return S.reusable(rows, clock, clock - F.expr("interval 300 hours"), F.to_date(clock), hours=400).select("event_id")


_CLIP = "CASE WHEN {0} IS NOT NULL THEN least(100, greatest(0, {0})) END"
_A, _B = _CLIP.format("(revenue / prev_revenue - 1) * 1000 + 50"), _CLIP.format("(eps_diluted / prev_eps - 1) * 750 + 50")


@query(
    "revision_composites",
    "F16 F17",
    f"""WITH q AS (SELECT *, nullif(lag(revenue) OVER w, 0) AS prev_revenue, nullif(lag(eps_diluted) OVER w, 0) AS prev_eps FROM quarter_statements WINDOW w AS (PARTITION BY entity_id ORDER BY period_end)),
s AS (SELECT entity_id, period_end, {_A} AS a, {_B} AS b FROM q),
v AS (SELECT entity_id, period_end, {rnd('(coalesce(a, 0) + coalesce(b, 0)) / nullif(CAST(a IS NOT NULL AS INT) + CAST(b IS NOT NULL AS INT), 0)', 1)} AS score, {rnd('(CAST(a IS NOT NULL AS INT) + CAST(b IS NOT NULL AS INT)) / 2.0 * 100', 1)} AS coverage FROM s)
SELECT *, {rnd('score * 0.25 + 50 * 0.15 + score * 0.2 + 40 * 0.1 + 60 * 0.15 + score * 0.15', 1)} AS composite FROM v""",
)
def revision_composites(t: Tables) -> DataFrame:
    w = Window.partitionBy("entity_id").orderBy("period_end")
    change = lambda c: F.col(c) / F.when(F.lag(c).over(w) != 0, F.lag(c).over(w)) - 1
    q = t.quarter_statements.select("entity_id", "period_end", change("revenue").alias("x"), change("eps_diluted").alias("y"))
    score, coverage = S.revision_score(F.col("x"), F.col("y"))
    v = q.select("entity_id", "period_end", score.alias("score"), coverage.alias("coverage"))
    s = F.col("score")
    return v.withColumn("composite", S.composite({"fundamentals": s, "valuation": F.lit(50.0), "earnings": s, "momentum": F.lit(40.0), "news": F.lit(60.0), "catalysts": s}))


@query(
    "fair_values",
    "F20",
    f"SELECT entity_id, period_end, {', '.join(rnd(f'CASE WHEN eps_diluted > 0 AND entity_id % 7 <> 0 THEN eps_diluted * {m} END', 2) + f' AS {n}' for n, m in (('low', 12.0), ('base', 16.0), ('high', 20.0)))} FROM quarter_statements",
)
def fair_values(t: Tables) -> DataFrame:
    peer = F.when(F.col("entity_id") % 7 != 0, F.lit(16.0))
    low, base, high = S.fair_value(F.col("eps_diluted"), peer - 4.0, peer, peer + 4.0)
    return t.quarter_statements.select("entity_id", "period_end", low.alias("low"), base.alias("base"), high.alias("high"))


@query("routed_rows", "J31", "SELECT CAST(user_id % 30 AS BIGINT) AS entity_id, count(*) AS n FROM events WHERE user_id % 30 < 25 AND user_id % 30 NOT IN (0, 4, 8, 12, 16, 20, 24) GROUP BY 1")
def routed_rows(t: Tables) -> DataFrame:
    """Rows reach the one entity of their ticker; a ticker that several entities claim routes nothing."""
    twice = t.entities.where(F.col("entity_id") % 4 == 0).select(F.col("ticker"), (F.col("entity_id") + 1000).alias("entity_id"))
    directory = t.entities.select("ticker", "entity_id").unionByName(twice)
    rows = t.raw("events").select("event_id", F.concat(F.lit("N"), F.col("user_id") % 30).alias("ticker"))
    return Z.unique_target(rows, directory, "ticker").groupBy("entity_id").agg(F.count("*").alias("n"))


@query("archive_months", "S16", "SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS orders, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders WHERE CAST(o_orderdate AS DATE) < DATE '1997-06-15' GROUP BY 1")
def archive_months(t: Tables) -> DataFrame:
    """Rows before the cutoff go to a monthly archive, which is read back."""
    orders = t.raw("orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    _, cold = K.split_by_age(orders, "day", "1997-06-15")
    path = new_folder(t.spark, "archive")
    K.write_archive(cold, "day", path)
    back = t.spark.read.schema("o_orderkey long, day date, month string").parquet(path)
    return back.groupBy("month").agg(F.count("*").alias("orders"), F.sum("o_orderkey").cast("long").alias("keys"))


@query(
    "sessions_closed_by",
    "F2",
    "SELECT CAST(max(session_date) AS DATE) AS session_date FROM calendar, (SELECT max(o_orderdate) AS clock FROM orders) WHERE CAST(session_date AS TIMESTAMP) + INTERVAL 21 HOUR <= clock",
)
def sessions_closed_by(t: Tables) -> DataFrame:
    clock = t.raw("orders").agg(F.max(F.col("o_orderdate").cast("timestamp_ntz"))).scalar()
    c = t.calendar.select(F.col("session_date").alias("day"), (F.col("session_date").cast("timestamp_ntz") + F.expr("interval 21 hours")).alias("close_utc"))
    return C.latest_completed_session(c, clock).select("session_date")


@query("percent_fields", "F7", f"SELECT event_type, count(*) AS n, {rnd('avg(CASE WHEN value IS NOT NULL THEN least(2.0, greatest(-2.0, (value - 100) / 100.0)) END)')} AS mean_share FROM events GROUP BY 1")
def percent_fields(t: Tables) -> DataFrame:
    share = percent_to_decimal(F.col("value") - 100)
    return t.raw("events").groupBy("event_type").agg(F.count("*").alias("n"), r6(F.avg(share)).alias("mean_share"))


@query(
    "constituent_report",
    "S3",
    """WITH d AS (SELECT 'S' || s_nationkey || '-' || s_suppkey % 40 AS ticker FROM supplier), n AS (SELECT count(*) AS members, count(*) - count(DISTINCT ticker) AS duplicates FROM d)
SELECT members, duplicates, CAST(0 AS BIGINT) AS blank, (SELECT count(*) FROM d WHERE ticker NOT IN (SELECT 'S' || s_nationkey || '-' || s_suppkey % 40 FROM supplier WHERE s_suppkey % 9 <> 0)) AS added FROM n""",
)
def constituent_report(t: Tables) -> DataFrame:
    symbol = F.concat(F.lit(" s"), F.col("s_nationkey"), F.lit("."), F.col("s_suppkey") % 40)
    s = t.raw("supplier").select(symbol.alias("symbol"), "s_suppkey")
    current = s.where(F.col("s_suppkey") % 9 != 0).select(F.upper(F.replace(F.trim("symbol"), F.lit("."), F.lit("-"))).alias("ticker")).distinct()
    return P.constituents(s.select("symbol"), current).select("members", "duplicates", "blank", F.col("added").cast("long").alias("added"))


@query("symbol_report_dates", "S26", "SELECT 'N' || entity_id AS ticker, count(DISTINCT filed_date) AS n, min(filed_date) AS first, max(filed_date) AS last FROM quarter_statements GROUP BY 1")
def symbol_report_dates(t: Tables) -> DataFrame:
    q = t.quarter_statements.select(F.concat(F.lit("n"), F.col("entity_id")).alias("symbol"), F.col("filed_date").cast("string").alias("reportDate"))
    bad = q.withColumn("reportDate", F.lit("soon"))
    d = P.report_dates(q.unionByName(bad).unionByName(q), ["symbol", "reportDate"])
    return d.select("ticker", F.size("dates").cast("long").alias("n"), F.array_min("dates").alias("first"), F.array_max("dates").alias("last"))


@query(
    "portable_fingerprint",
    "S18 F39",
    """WITH h AS (SELECT o_orderstatus, ('0x' || substr(md5(o_orderkey || '|' || o_custkey || '|' || coalesce(o_orderpriority, '')), 1, 12))::BIGINT AS h FROM orders)
SELECT o_orderstatus, count(*) AS rows, bit_xor(h) AS xor_digest, CAST(sum(h % 2147483648) AS BIGINT) AS sum_digest FROM h GROUP BY 1""",
)
def portable_fingerprint(t: Tables) -> DataFrame:
    return U.portable_fingerprint(t.raw("orders"), ["o_orderkey", "o_custkey", "o_orderpriority"], ["o_orderstatus"])


@query("unchanged_scores", "U4", f"SELECT entity_id, period_end, {rnd('revenue', 4)} AS revenue, CASE WHEN entity_id % 3 = 0 THEN 'first' ELSE 'second' END AS origin FROM quarter_statements")
def unchanged_scores(t: Tables) -> DataFrame:
    """Two frames over the same periods: the first one's rows go before the second's."""
    q = t.quarter_statements.select("entity_id", "period_end", "revenue")
    first = q.where(F.col("entity_id") % 3 == 0).withColumn("origin", F.lit("first"))
    second = q.withColumn("origin", F.lit("second"))
    return Z.union_by_precedence(first, second, ["entity_id", "period_end"]).select("entity_id", "period_end", r4("revenue").alias("revenue"), "origin")


@query(
    "daily_series",
    "S4",
    " UNION ALL ".join(f"SELECT '{s}' AS series_id, CAST(ts AS DATE) AS observation_date, CAST(count(*) FILTER (WHERE event_type = '{k}') AS DOUBLE) AS value FROM events GROUP BY 2 HAVING day(CAST(ts AS DATE)) % 7 <> 0" for s, k in (("views", "view"), ("clicks", "click"))),
)
def daily_series(t: Tables) -> DataFrame:
    """Wide text columns, a mark instead of a number on every seventh day, to long observations."""
    day = F.to_date("ts")
    text = lambda k: F.when(F.dayofmonth("day") % 7 == 0, ".").otherwise(F.col(k).cast("string"))
    wide = t.raw("events").groupBy(day.alias("day")).agg(F.count_if(F.col("event_type") == "view").alias("v"), F.count_if(F.col("event_type") == "click").alias("c"))
    rows = wide.select(F.col("day").cast("string").alias("day"), text("v").alias("views"), text("c").alias("clicks"), F.lit("2100-01-01").cast("timestamp_ntz").alias("observed_at"))
    return P.series_csv(rows, ["views", "clicks"], "day", "observed_at").select("series_id", "observation_date", "value")


@query(
    "institutional_holdings",
    "S22",
    "SELECT o_orderkey AS holder, o_custkey AS entity_id, CAST(o_orderdate AS DATE) AS report_date, CAST(floor(o_totalprice) AS BIGINT) AS shares FROM orders WHERE o_orderkey % 5 <> 0 AND o_orderkey % 11 <> 3 AND floor(o_totalprice) > 0",
)
def institutional_holdings(t: Tables) -> DataFrame:
    o = t.raw("orders")
    shares = F.when(F.col("o_orderkey") % 11 == 3, "n/a").otherwise(F.floor("o_totalprice").cast("string"))
    rows = o.select(F.col("o_custkey").alias("entity_id"), F.col("o_orderkey").alias("holder"), shares.alias("shares"), F.to_date("o_orderdate").cast("string").alias("report_date"), F.expr("cast(to_date(o_orderdate) as timestamp_ntz) + make_dt_interval(cast(o_orderkey % 5 - 1 as int))").alias("observed_at"))
    return P.holding_rows(rows.withColumn("observed_at", F.when(F.col("holder") % 5 == 0, F.col("observed_at")).otherwise(F.col("observed_at") + F.expr("interval 1 day"))), ["holder", "entity_id"]).select("holder", "entity_id", "report_date", "shares")


@query(
    "timed_releases",
    "S25",
    "SELECT event_id, CAST(CAST(ts AS DATE) AS TIMESTAMP) + INTERVAL 13 HOUR + INTERVAL 30 MINUTE + CASE WHEN event_id % 2 = 0 THEN INTERVAL 5 HOUR ELSE INTERVAL 0 HOUR END AS event_at FROM events WHERE event_id % 9 <> 4",
)
def timed_releases(t: Tables) -> DataFrame:
    """Rows of a release table with a date and a clock time of the exchange's zone, to UTC; rows without a time are left out."""
    clock = F.when(F.col("event_id") % 9 == 4, "TBA").when(F.col("event_id") % 2 == 0, "1:30 PM").otherwise("08:30 AM")
    row = F.concat(F.lit("<table><tr><td>"), F.date_format("ts", "MMMM d, yyyy"), F.lit("</td><td>"), clock, F.lit("</td><td>Release</td></tr></table>"))
    pages = t.raw("events").select("event_id", row.alias("html"))
    return P.timed_rows(pages, ["event_id"], "html", "-05:00").select("event_id", "event_at")


@query(
    "exhibit_links",
    "S27",
    "SELECT page_id, 'ex99-' || i || '.htm' AS href FROM pages, range(1, 3) r(i) WHERE i <= 1 + page_id % 2",
)
def exhibit_links(t: Tables) -> DataFrame:
    """Rows of a filing's index whose type is an exhibit of releases, to their links; the other rows name other documents."""
    row = lambda kind, name: F.concat(F.lit("<tr><td>"), kind, F.lit("</td><td><a href=\""), name, F.lit("\">doc</a></td></tr>"))
    second = F.when(F.col("page_id") % 2 == 1, row(F.lit("EX-99.2"), F.lit("ex99-2.htm"))).otherwise(row(F.lit("EX-10.1"), F.lit("ex10.htm")))
    html = F.concat(F.lit("<table>"), row(F.lit("8-K"), F.lit("main.htm")), row(F.lit(" ex-99.1 "), F.lit("ex99-1.htm")), second, F.lit("</table>"))
    return P.exhibits(t.raw("pages").select("page_id", html.alias("html")), ["page_id"], "html").select("page_id", "href")


@query(
    "merged_statements",
    "S29",
    f"SELECT entity_id, period_end, {rnd('revenue', 2)} AS revenue, CASE WHEN entity_id % 3 <> 0 THEN {rnd('cash', 2)} END AS cash, CASE WHEN entity_id % 4 <> 0 THEN {rnd('free_cash_flow', 2)} END AS free_cash_flow FROM quarter_statements",
)
def merged_statements(t: Tables) -> DataFrame:
    """Income statements keep every row and take balance and cash flow of the same date where there is one."""
    q, key = t.quarter_statements, ["entity_id", "period_end"]
    balance = q.where(F.col("entity_id") % 3 != 0).select(*key, "cash")
    flow = q.where(F.col("entity_id") % 4 != 0).select(*key, "free_cash_flow")
    m = Z.merged_statements(q.select(*key, "revenue"), balance, flow, key)
    return m.select(*key, *[r2(c).alias(c) for c in ("revenue", "cash", "free_cash_flow")])


@query("allowed_horizons", "F35", "SELECT event_id, event_id % 4 <> 3 AND event_id % 5 <> 0 AS valid FROM events")
def allowed_horizons(t: Tables) -> DataFrame:
    third = F.when(F.col("event_id") % 4 == 3, 7).otherwise(20)
    second = F.when(F.col("event_id") % 5 == 0, 5).otherwise(10)
    return t.raw("events").select("event_id", S.valid_horizons(F.array(F.lit(5), second, third), (5, 10, 20)).alias("valid"))


@query(
    "narrative_evidence",
    "F38",
    """SELECT entity_id, period_end, concat_ws('; ', CASE WHEN net_income > 0 THEN 'Profit in the quarter' END, CASE WHEN free_cash_flow > 0 THEN 'Free cash flow above zero' END, CASE WHEN entity_id % 2 = 0 AND revenue > 0 THEN 'Entity ' || entity_id || ' reports revenue' END) AS evidence FROM quarter_statements""",
)
def narrative_evidence(t: Tables) -> DataFrame:
    lines = [
        (F.col("net_income") > 0, F.lit("Profit in the quarter")), (F.col("free_cash_flow") > 0, F.lit("Free cash flow above zero")),
        ((F.col("entity_id") % 2 == 0) & (F.col("revenue") > 0), F.format_string("Entity %d reports revenue", F.col("entity_id"))),
    ]
    return t.quarter_statements.select("entity_id", "period_end", F.array_join(S.evidence(lines), "; ").alias("evidence"))


@query(
    "feature_health",
    "M16",
    f"SELECT session_no, count(*) AS entities, {rnd('avg(CAST(momentum_20 IS NOT NULL AS INT))')} AS usable_momentum_20, {rnd('avg(CAST(volatility_20 IS NOT NULL AS INT))')} AS usable_volatility_20 FROM features GROUP BY 1",
)
def feature_health(t: Tables) -> DataFrame:
    """Share of entities with a usable value of each feature, by session."""
    return U.usable_shares(t.features, ["session_no"], ["momentum_20", "volatility_20"])
