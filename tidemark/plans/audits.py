"""Inventory, freshness, label quality and readiness over the bound tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import r4, r6
from tidemark.operators import audit as U
from tidemark.operators import bars as B
from tidemark.operators import calendar as C
from tidemark.operators import features as X
from tidemark.operators import fundamentals as S
from tidemark.operators import inventory as IV
from tidemark.operators.latest import latest_row
from tidemark.plans.ctes import cte, rnd
from tidemark.plans.registry import query
from tidemark.plans.tables import Tables

TYPES = ["click", "error", "purchase", "signup", "view"]

cte(
    "runs",
    """SELECT event_id AS run_id, event_type AS pipeline, ts AS started_at, ts + CAST(json_extract(props, '$.k') AS INTEGER) * INTERVAL 1 MINUTE AS finished_at,
  CASE WHEN value < 20 THEN 'error' WHEN value > 200 THEN 'running' ELSE 'success' END AS status FROM events""",
)


def runs(t: Tables) -> DataFrame:
    """Pipeline runs: an event with its minutes from the payload and a status from its value."""
    e = t.raw("events")
    minutes = F.get_json_object("props", "$.k").cast("int")
    return e.select(
        F.col("event_id").alias("run_id"), F.col("event_type").alias("pipeline"), F.col("ts").alias("started_at"),
        (F.col("ts") + F.make_dt_interval(mins=minutes)).alias("finished_at"),
        F.when(F.col("value") < 20, "error").when(F.col("value") > 200, "running").otherwise("success").alias("status"),
    )


@query("latest_runs", "W7 J6 F34", "SELECT pipeline, run_id, started_at, finished_at, status FROM (SELECT *, row_number() OVER (PARTITION BY pipeline ORDER BY started_at DESC, run_id DESC) AS rn FROM runs) WHERE rn = 1")
def latest_runs(t: Tables) -> DataFrame:
    return U.latest_runs(runs(t)).select("pipeline", "run_id", "started_at", "finished_at", "status")


@query(
    "run_timeliness",
    "F42 F46 F36",
    """SELECT CAST(timezone('Asia/Jerusalem', timezone('UTC', started_at)) AS DATE) AS local_day, min(started_at) AS first_started_at,
  min(finished_at) FILTER (WHERE status = 'success' AND timezone('Asia/Jerusalem', timezone('UTC', finished_at)) <= CAST(CAST(timezone('Asia/Jerusalem', timezone('UTC', started_at)) AS DATE) AS TIMESTAMP) + INTERVAL 12 HOUR) AS completed_by_deadline,
  count(*) FILTER (WHERE status = 'success' AND timezone('Asia/Jerusalem', timezone('UTC', finished_at)) <= CAST(CAST(timezone('Asia/Jerusalem', timezone('UTC', started_at)) AS DATE) AS TIMESTAMP) + INTERVAL 12 HOUR) > 0 AS on_time FROM runs GROUP BY 1""",
)
def run_timeliness(t: Tables) -> DataFrame:
    return U.deadline_outcomes(runs(t), "Asia/Jerusalem", 12)


@query(
    "run_status",
    "F42 P10 A34 Q10",
    "SELECT pipeline, CASE WHEN status = 'running' AND started_at < (SELECT max(started_at) FROM runs) - INTERVAL 6 HOUR THEN 'interrupted' ELSE status END AS status, count(*) AS runs, count(*) FILTER (WHERE started_at >= (SELECT max(started_at) FROM runs) - INTERVAL 48 HOUR) AS recent_runs FROM runs GROUP BY 1, 2",
)
def run_status(t: Tables) -> DataFrame:
    r = runs(t)
    clock = r.agg(F.max("started_at")).scalar()
    return r.groupBy("pipeline", U.execution_status(6, clock).alias("status")).agg(F.count("*").alias("runs"), F.count_if(U.recent("started_at", clock, 48)).alias("recent_runs"))


@query(
    "evidence_inventory",
    "A5 A7 A33",
    """SELECT user_id, count(*) FILTER (WHERE event_type = 'signup') AS insider_transactions, count(*) FILTER (WHERE event_type IN ('click', 'view')) AS documents, count(*) FILTER (WHERE event_type = 'error' AND value > 100) AS large_errors,
  max(ts) FILTER (WHERE event_type = 'purchase') AS last_purchase, min(ts) AS first_observed FROM events GROUP BY 1""",
)
def evidence_inventory(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    return t.raw("events").groupBy("user_id").agg(
        F.count_if(kind == "signup").alias("insider_transactions"), F.count_if(kind.isin("click", "view")).alias("documents"), F.count_if((kind == "error") & (F.col("value") > 100)).alias("large_errors"),
        F.max(F.when(kind == "purchase", F.col("ts"))).alias("last_purchase"), F.min("ts").alias("first_observed"),
    )


@query("observation_days", "A6", "SELECT event_type, count(DISTINCT CAST(ts AS DATE)) AS days, count(DISTINCT (user_id, CAST(ts AS DATE))) AS entity_days FROM events GROUP BY 1")
def observation_days(t: Tables) -> DataFrame:
    # Two distinct steps keep the hash state spread over (type, user, day).
    pairs = t.raw("events").select("event_type", "user_id", F.to_date("ts").alias("day")).distinct()
    by_day = pairs.groupBy("event_type", "day").agg(F.count("*").alias("n"))
    return by_day.groupBy("event_type").agg(F.count("*").alias("days"), F.sum("n").alias("entity_days"))


@query("event_profile_json", "A8", """SELECT user_id, '[' || string_agg('{"type":"' || event_type || '","n":' || n || '}', ',' ORDER BY event_type) || ']' AS profile FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1""")
def event_profile_json(t: Tables) -> DataFrame:
    n = t.raw("events").groupBy("user_id", F.col("event_type").alias("type")).agg(F.count("*").alias("n"))
    # At most one entry per event type.
    return n.groupBy("user_id").agg(F.to_json(F.sort_array(F.collect_list(F.struct("type", "n")))).alias("profile"))


def stored_labels(t: Tables) -> DataFrame:
    """The labels as a mutable table would hold them: some shifted, some lost."""
    k = F.col("entity_id") + F.col("session_no")
    pairs = F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"forward_return_{h}").alias("v")) for h in X.HORIZONS])
    long = t.features.select("entity_id", "session_date", "session_no", F.inline(pairs))
    stored = F.when(k % 19 == 0, F.lit(None).cast("double")).when(k % 17 == 0, F.col("v") + 0.01).otherwise(F.col("v"))
    return long.select("entity_id", "session_date", "horizon", stored.alias("stored"), F.when(k % 19 != 0, F.col("v") > 0).alias("direction"))


cte(
    "label_audit",
    """SELECT *, NOT (CASE WHEN expected IS NULL OR stored IS NULL THEN expected IS NULL AND stored IS NULL ELSE abs(expected - stored) <= 1e-8 END) OR direction IS DISTINCT FROM (expected > 0) AS mismatch FROM (
  SELECT entity_id, session_date, horizon, v AS expected, CASE WHEN (entity_id + session_no) % 19 = 0 THEN NULL WHEN (entity_id + session_no) % 17 = 0 THEN v + 0.01 ELSE v END AS stored,
    CASE WHEN (entity_id + session_no) % 19 <> 0 THEN v > 0 END AS direction
  FROM (SELECT entity_id, session_no, session_date, unnest([5, 10, 20]) AS horizon, unnest([forward_return_5, forward_return_10, forward_return_20]) AS v FROM features))""",
)


def label_audit(t: Tables) -> DataFrame:
    labels = X.session_labels(t.features, C.session_targets(t.calendar, X.HORIZONS), t.canonical)
    return U.label_mismatches(stored_labels(t), labels, ["entity_id", "session_date", "horizon"])


@query(
    "session_quality",
    "Q11 J37",
    "SELECT CAST(horizon AS INTEGER) AS horizon, count(*) AS checked, count(*) FILTER (WHERE mismatch) AS incorrect, count(*) FILTER (WHERE expected IS NULL) AS without_close FROM label_audit GROUP BY 1",
)
def session_quality(t: Tables) -> DataFrame:
    return label_audit(t).groupBy("horizon").agg(F.count("*").alias("checked"), F.count_if("mismatch").alias("incorrect"), F.count_if(F.col("expected").isNull()).alias("without_close"))


@query(
    "label_repairs",
    "A9 A10",
    f"SELECT entity_id, session_date, {', '.join(rnd(f'max(expected) FILTER (WHERE horizon = {h})') + f' AS expected_{h}' for h in X.HORIZONS)} FROM label_audit GROUP BY 1, 2 HAVING bool_or(mismatch)",
)
def label_repairs(t: Tables) -> DataFrame:
    return U.repairs(label_audit(t), ["entity_id", "session_date"], X.HORIZONS).select("entity_id", "session_date", *[r6(f"expected_{h}").alias(f"expected_{h}") for h in X.HORIZONS])


@query(
    "field_coverage",
    "A19",
    f"""SELECT unnest([{', '.join(f"'{f}'" for f in S.QUALITY_FIELDS)}, 'all_fields']) AS field, unnest([{', '.join(f'count({f})' for f in S.QUALITY_FIELDS)}, count(*) FILTER (WHERE {' AND '.join(f'{f} IS NOT NULL' for f in S.QUALITY_FIELDS)})]) AS known, count(*) AS total FROM ttm""",
)
def field_coverage(t: Tables) -> DataFrame:
    return U.field_coverage(t.ttm, S.QUALITY_FIELDS)


@query(
    "repair_targets",
    "T8",
    """SELECT entity_id, missing, rank FROM (SELECT *, row_number() OVER (ORDER BY missing DESC, CAST(entity_id AS VARCHAR)) AS rank FROM (
  SELECT entity_id, CAST(sum(CASE WHEN eps_diluted IS NULL THEN 1 ELSE 0 END + CASE WHEN free_cash_flow IS NULL THEN 1 ELSE 0 END + CASE WHEN capex IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS missing FROM quarter_statements GROUP BY 1)) WHERE rank <= 10""",
)
def repair_targets(t: Tables) -> DataFrame:
    from tidemark.operators.rank import top_n

    gaps = F.size(F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in ("eps_diluted", "free_cash_flow", "capex")])))
    m = t.quarter_statements.groupBy("entity_id").agg(F.sum(gaps).alias("missing"))
    return top_n(m, 10, "missing").select("entity_id", "missing", F.col("rank").cast("long").alias("rank"))


@query(
    "market_freshness",
    "J25 A34",
    """WITH last AS (SELECT max(session_date) AS d FROM daily_benchmark) SELECT sector, count(*) AS entities, count(p.entity_id) AS priced, count(*) - count(p.entity_id) AS missing
FROM entities e LEFT JOIN (SELECT DISTINCT entity_id FROM daily_bars, last WHERE session_date = d AND close > 0) p USING (entity_id) GROUP BY 1""",
)
def market_freshness(t: Tables) -> DataFrame:
    expected = t.daily_benchmark.agg(F.max("session_date")).scalar()
    f = U.freshness(t.entities, t.daily_bars, t.daily_bars, expected)
    return f.groupBy("sector").agg(F.count("*").alias("entities"), F.count_if("price_ok").alias("priced"), F.count_if(~F.col("price_ok")).alias("missing"))


@query(
    "missing_tickers",
    "J25",
    "WITH last AS (SELECT max(session_date) AS d FROM daily_benchmark) SELECT ticker FROM entities WHERE entity_id NOT IN (SELECT entity_id FROM daily_bars, last WHERE session_date = d AND close > 0)",
)
def missing_tickers(t: Tables) -> DataFrame:
    expected = t.daily_benchmark.agg(F.max("session_date")).scalar()
    return U.freshness(t.entities, t.daily_bars, t.daily_bars, expected).where(~F.col("price_ok")).select("ticker")


def family_status(t: Tables) -> DataFrame:
    """Status per entity and source family, judged at the last decision of the market."""
    clock = t.decisions.agg(F.max("decision_at").alias("clock")).select("clock").scalar()
    px = t.panel.groupBy("entity_id").agg(F.max("session_date").alias("d"))
    last = t.panel.agg(F.max("session_date")).scalar()
    fin = t.ttm_versions.groupBy("entity_id").agg(F.max("period_end").alias("d"))
    rep = t.earnings_versions.where(F.col("reported_eps").isNotNull()).groupBy("entity_id").agg(F.max("reported_date").alias("d"))
    an = latest_row(t.analyst_snapshots, ["entity_id"], "observed_at")
    total = F.col("strong_buy") + F.col("buy") + F.col("hold") + F.col("sell") + F.col("strong_sell")
    an = an.select("entity_id", F.col("observed_at").alias("d"), total.alias("n"))
    e = t.entities.select("entity_id")
    parts = [
        (px, "market", F.when(F.col("d") == last, "current").when(F.col("d").isNotNull(), "stale").otherwise("missing")),
        (fin, "financials", F.when(F.datediff(F.to_date(clock), "d") <= 180, "current").when(F.col("d").isNotNull(), "stale").otherwise("missing")),
        (rep, "earnings", F.when(F.col("d").isNotNull(), "observed").otherwise("missing")),
        (an, "analyst", F.when((F.col("n") >= 3) & (F.col("d") >= clock - F.expr("interval 7 days")), "current").when(F.col("n") > 0, "partial").otherwise("missing")),
    ]
    rows = [e.join(df, "entity_id", "left").select("entity_id", F.lit(name).alias("family"), status.alias("status")) for df, name, status in parts]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])


cte(
    "family_status",
    """WITH c AS (SELECT max(decision_at) AS clock, max(session_date) AS last FROM decisions)
SELECT entity_id, 'market' AS family, CASE WHEN d = last THEN 'current' WHEN d IS NOT NULL THEN 'stale' ELSE 'missing' END AS status FROM c, entities LEFT JOIN (SELECT entity_id, max(session_date) AS d FROM canonical GROUP BY 1) USING (entity_id)
UNION ALL SELECT entity_id, 'financials', CASE WHEN CAST(clock AS DATE) - d <= 180 THEN 'current' WHEN d IS NOT NULL THEN 'stale' ELSE 'missing' END FROM c, entities LEFT JOIN (SELECT entity_id, max(period_end) AS d FROM ttm GROUP BY 1) USING (entity_id)
UNION ALL SELECT entity_id, 'earnings', CASE WHEN d IS NOT NULL THEN 'observed' ELSE 'missing' END FROM entities LEFT JOIN (SELECT entity_id, max(reported_date) AS d FROM earnings_versions WHERE reported_eps IS NOT NULL GROUP BY 1) USING (entity_id)
UNION ALL SELECT entity_id, 'analyst', CASE WHEN n >= 3 AND d >= clock - INTERVAL 7 DAY THEN 'current' WHEN n > 0 THEN 'partial' ELSE 'missing' END
FROM c, entities LEFT JOIN (SELECT entity_id, max(observed_at) AS d, arg_max(strong_buy + buy + hold + sell + strong_sell, observed_at) AS n FROM analyst_snapshots GROUP BY 1) USING (entity_id)""",
)
STATUSES = ["current", "observed", "partial", "stale", "missing"]


@query("family_status", "F23", "SELECT * FROM family_status")
def family_status_q(t: Tables) -> DataFrame:
    return family_status(t)


@query(
    "status_matrix",
    "A20 Q2",
    f"SELECT family, {', '.join(f'count(*) FILTER (WHERE status = {chr(39)}{s}{chr(39)}) AS {chr(34)}{s}{chr(34)}' for s in STATUSES)}, count(*) FILTER (WHERE status IN ('current', 'observed')) AS covered, count(*) AS total FROM family_status GROUP BY 1",
)
def status_matrix(t: Tables) -> DataFrame:
    return U.status_matrix(family_status(t), STATUSES)


@query(
    "coverage_layers",
    "A36 A44",
    "SELECT family, count(*) FILTER (WHERE status <> 'missing') AS entities, floor(1000.0 * count(*) FILTER (WHERE status <> 'missing') / count(*) + 0.5) / 10 AS coverage_pct, CASE WHEN floor(1000.0 * count(*) FILTER (WHERE status <> 'missing') / count(*) + 0.5) / 10 >= 95 THEN 'strong' ELSE 'partial' END AS status FROM family_status GROUP BY 1",
)
def coverage_layers(t: Tables) -> DataFrame:
    n = family_status(t).groupBy("family").agg(F.count_if(F.col("status") != "missing").alias("entities"), F.count("*").alias("_n"))
    return U.layer_percentages(n, F.col("_n")).select("family", "entities", "coverage_pct", "status")


@query(
    "source_inventory",
    "A32 J2 Q4",
    """SELECT e.entity_id, p.price_date, p.bars, s.period_end, s.statements, r.reported_date, r.reports, a.observed_at, a.snapshots FROM entities e
LEFT JOIN (SELECT entity_id, max(session_date) AS price_date, count(*) AS bars FROM canonical GROUP BY 1) p USING (entity_id)
LEFT JOIN (SELECT entity_id, max(period_end) AS period_end, count(*) AS statements FROM ttm GROUP BY 1) s USING (entity_id)
LEFT JOIN (SELECT entity_id, max(reported_date) FILTER (WHERE reported_eps IS NOT NULL) AS reported_date, count(*) AS reports FROM earnings_versions GROUP BY 1) r USING (entity_id)
LEFT JOIN (SELECT entity_id, max(observed_at) AS observed_at, count(DISTINCT CAST(observed_at AS DATE)) AS snapshots FROM analyst_snapshots GROUP BY 1) a USING (entity_id)""",
)
def source_inventory(t: Tables) -> DataFrame:
    parts = [
        t.canonical.groupBy("entity_id").agg(F.max("session_date").alias("price_date"), F.count("*").alias("bars")),
        t.ttm.groupBy("entity_id").agg(F.max("period_end").alias("period_end"), F.count("*").alias("statements")),
        t.earnings_versions.groupBy("entity_id").agg(F.max(F.when(F.col("reported_eps").isNotNull(), F.col("reported_date"))).alias("reported_date"), F.count("*").alias("reports")),
        t.analyst_snapshots.groupBy("entity_id").agg(F.max("observed_at").alias("observed_at"), F.countDistinct(F.to_date("observed_at")).alias("snapshots")),
    ]
    return U.left_join_all(t.entities.select("entity_id"), "entity_id", parts)


@query(
    "readiness_metrics",
    "A35 A43 Q8",
    """SELECT 'statement_entities' AS metric, count(DISTINCT entity_id) AS n FROM ttm UNION ALL SELECT 'statement_days', count(DISTINCT CAST(observed_at AS DATE)) FROM ttm_versions
UNION ALL SELECT 'snapshot_days', count(DISTINCT CAST(observed_at AS DATE)) FROM analyst_snapshots UNION ALL SELECT 'known_eps_entities', count(DISTINCT entity_id) FROM ttm WHERE eps_diluted IS NOT NULL
UNION ALL SELECT 'labelled_rows', count(forward_return_5) FROM features UNION ALL SELECT 'labelled_sessions', count(DISTINCT session_date) FROM features WHERE forward_return_5 IS NOT NULL""",
)
def readiness_metrics(t: Tables) -> DataFrame:
    def one(name: str, df: DataFrame, agg) -> DataFrame:
        return df.agg(agg.alias("n")).select(F.lit(name).alias("metric"), "n")

    labelled = t.features.where(F.col("forward_return_5").isNotNull())
    rows = [
        one("statement_entities", t.ttm, F.countDistinct("entity_id")),
        one("statement_days", t.ttm_versions, F.countDistinct(F.to_date("observed_at"))),
        one("snapshot_days", t.analyst_snapshots, F.countDistinct(F.to_date("observed_at"))),
        one("known_eps_entities", t.ttm.where(F.col("eps_diluted").isNotNull()), F.countDistinct("entity_id")),
        one("labelled_rows", labelled, F.count("*")),
        one("labelled_sessions", labelled, F.countDistinct("session_date")),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


_SKETCHED = (["event_type"], ["user_id", "event_id"], ["value"])


@query(
    "inventory_by_day",
    "A6 A32 A35 A43",
    """WITH d AS (SELECT event_type, count(*) AS rows, count(DISTINCT CAST(ts AS DATE)) AS days, min(CAST(ts AS DATE)) AS first_day, max(CAST(ts AS DATE)) AS last_day, count(DISTINCT user_id) AS users, count(DISTINCT event_id) AS events, median(value) AS middle FROM events GROUP BY 1)
SELECT event_type, rows, days, first_day, last_day, users, events, true AS users_agree, true AS events_agree, true AS middle_agrees FROM d""",
)
def inventory_by_day(t: Tables) -> DataFrame:
    """Counts of observed days, entities and rows: exact, and whether the merged sketches of the days agree within four errors."""
    e = t.raw("events")
    merged = IV.estimates(IV.merged(IV.day_sketches(e, "ts", *_SKETCHED), *_SKETCHED), *_SKETCHED[1:])
    whole = IV.exact(e, "ts", *_SKETCHED)
    near = lambda c: F.abs(F.col(f"s.{c}_distinct") - F.col(f"x.{c}_distinct")) <= 4 * 1.04 / 2 ** (IV.LG_K / 2) * F.col(f"x.{c}_distinct") + 1
    # A quantile sketch errs by rank: its value lies where the exact share of smaller ones is near a half.
    rank = e.join(F.broadcast(merged.select("event_type", "value_quantile")), "event_type").groupBy("event_type").agg(F.avg((F.col("value") <= F.col("value_quantile")).cast("double")).alias("share"))
    both = whole.alias("x").join(merged.alias("s"), F.col("x.event_type") == F.col("s.event_type")).join(rank.alias("r"), F.col("x.event_type") == F.col("r.event_type"))
    shown = [F.col(f"x.{c}").alias(c) for c in ("event_type", "rows", "days", "first_day", "last_day")]
    return both.select(*shown, F.col("x.user_id_distinct").alias("users"), F.col("x.event_id_distinct").alias("events"), near("user_id").alias("users_agree"), near("event_id").alias("events_agree"), (F.abs(F.col("share") - 0.5) < 0.04).alias("middle_agrees"))


@query(
    "feature_correlation",
    "A24",
    f"""WITH f AS (SELECT entity_id, CASE WHEN session_date < DATE '1999-01-01' THEN 'train' ELSE 'test' END AS split, unnest([{', '.join(repr(n) for n in X.BASE_FEATURES)}]) AS feature, unnest([{', '.join(X.BASE_FEATURES)}]) AS x, forward_return_5 AS y FROM features)
SELECT entity_id, split, feature, count(*) AS n, {rnd('corr(x, y)')} AS correlation FROM f WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) >= 10""",
)
def feature_correlation(t: Tables) -> DataFrame:
    names = X.BASE_FEATURES
    split = F.when(F.col("session_date") < "1999-01-01", "train").otherwise("test")
    long = t.features.select("entity_id", split.alias("split"), F.col("forward_return_5").alias("y"), F.inline(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).alias("x")) for n in names])))
    g = long.where(F.col("x").isNotNull() & F.col("y").isNotNull()).groupBy("entity_id", "split", "feature")
    return g.agg(F.count("*").alias("n"), F.corr("x", "y").alias("c")).where("n >= 10").select("entity_id", "split", "feature", "n", r6("c").alias("correlation"))


@query(
    "feature_availability",
    "A31 M9",
    "SELECT CAST(count(DISTINCT session_date) FILTER (WHERE momentum_5 IS NOT NULL OR momentum_20 IS NOT NULL) AS BIGINT) AS momentum_sessions, count(DISTINCT session_date) FILTER (WHERE drawdown_60 IS NOT NULL OR distance_to_support_60 IS NOT NULL) AS range_sessions FROM features",
)
def feature_availability(t: Tables) -> DataFrame:
    any_of = lambda *c: F.countDistinct(F.when(F.coalesce(*c).isNotNull(), F.col("session_date")))
    return t.features.agg(any_of("momentum_5", "momentum_20").alias("momentum_sessions"), any_of("drawdown_60", "distance_to_support_60").alias("range_sessions"))


@query(
    "equal_date_weights",
    "A38",
    f"WITH f AS (SELECT * FROM features WHERE forward_return_5 IS NOT NULL), d AS (SELECT session_date, count(*) AS n FROM f GROUP BY 1) SELECT session_date, n, {rnd('(SELECT count(*) FROM f) / ((SELECT count(*) FROM d) * CAST(n AS DOUBLE))')} AS weight FROM d",
)
def equal_date_weights(t: Tables) -> DataFrame:
    d = t.features.where(F.col("forward_return_5").isNotNull()).groupBy("session_date").agg(F.count("*").alias("n"))
    rows, dates = d.agg(F.sum("n")).scalar(), d.agg(F.count("*")).scalar()
    return d.select("session_date", "n", r6(rows / (dates * F.col("n"))).alias("weight"))


_SCORED = "SELECT d.doc_id, least(1.0, d.n_chars / 4000.0) AS p, CAST(l.quality AS DOUBLE) AS y FROM documents d JOIN labels l USING (doc_id)"


def scored_labels(t: Tables) -> DataFrame:
    j = t.raw("documents").select("doc_id", "n_chars").join(t.raw("labels"), "doc_id")
    return j.select("doc_id", F.least(F.lit(1.0), F.col("n_chars") / 4000.0).alias("p"), F.col("quality").cast("double").alias("y"))


@query(
    "brier_and_mae",
    "A28 A30",
    f"WITH s AS ({_SCORED}), b AS (SELECT avg(y) AS base FROM s) SELECT count(*) AS n, {rnd('avg((p - y) * (p - y))')} AS brier, {rnd('avg((base - y) * (base - y))')} AS baseline_brier, {rnd('1 - avg((p - y) * (p - y)) / avg((base - y) * (base - y))')} AS skill, {rnd('avg(abs(y - p))')} AS mae, {rnd('avg(abs(y - base))')} AS baseline_mae FROM s, b",
)
def brier_and_mae(t: Tables) -> DataFrame:
    s = scored_labels(t)
    base = s.agg(F.avg("y")).scalar()
    p, y = F.col("p"), F.col("y")
    brier, bb = F.avg((p - y) * (p - y)), F.avg((F.col("base") - y) * (F.col("base") - y))
    return s.withColumn("base", base).agg(
        F.count("*").alias("n"), r6(brier).alias("brier"), r6(bb).alias("baseline_brier"), r6(1 - brier / bb).alias("skill"), r6(F.avg(F.abs(y - p))).alias("mae"), r6(F.avg(F.abs(y - F.col("base")))).alias("baseline_mae")
    )


@query("reliability_buckets", "A29", f"WITH s AS ({_SCORED}) SELECT CAST(least(9, floor(p * 10)) AS BIGINT) AS bucket, count(*) AS n, {rnd('avg(p)')} AS predicted, {rnd('avg(y)')} AS realised FROM s GROUP BY 1")
def reliability_buckets(t: Tables) -> DataFrame:
    return scored_labels(t).groupBy(F.least(F.lit(9), F.floor(F.col("p") * 10)).alias("bucket")).agg(F.count("*").alias("n"), r6(F.avg("p")).alias("predicted"), r6(F.avg("y")).alias("realised"))


@query(
    "constraint_violations",
    "P14",
    """SELECT unnest(['quantity_positive', 'discount_in_range', 'flag_known', 'ship_date_known', 'price_above_minimum']) AS rule, unnest([count(*) FILTER (WHERE NOT l_quantity > 0), count(*) FILTER (WHERE NOT l_discount BETWEEN 0 AND 0.09),
  count(*) FILTER (WHERE l_returnflag NOT IN ('A', 'N')), count(*) FILTER (WHERE l_shipdate IS NULL), count(*) FILTER (WHERE NOT l_extendedprice >= 2000)]) AS violations FROM lineitem""",
)
def constraint_violations(t: Tables) -> DataFrame:
    return U.violations(
        t.raw("lineitem"),
        {
            "quantity_positive": F.col("l_quantity") > 0, "discount_in_range": F.col("l_discount").between(0, 0.09), "flag_known": F.col("l_returnflag").isin("A", "N"),
            "ship_date_known": F.col("l_shipdate").isNotNull(), "price_above_minimum": F.col("l_extendedprice") >= 2000,
        },
    )


@query(
    "entity_search",
    "P18 Q3 U2",
    """SELECT ticker, name, sector FROM (SELECT *, row_number() OVER (ORDER BY p, CAST(entity_id AS VARCHAR)) AS rn FROM (SELECT entity_id, ticker, name, sector, min(p) AS p FROM (
  SELECT *, 0 AS p FROM entities WHERE ticker ILIKE '%n1%' UNION ALL SELECT *, 1 FROM entities WHERE name ILIKE '%n1%' OR name ILIKE '%_2%') GROUP BY ALL)) WHERE rn <= 8""".replace("'%n1%' OR name ILIKE '%_2%'", "'%on!_1%' ESCAPE '!'"),
)
def entity_search(t: Tables) -> DataFrame:
    """Ticker hits before name hits, each entity once, at most eight."""
    e = t.entities
    hit = F.when(F.col("ticker").ilike("%n1%"), 0).when(F.col("name").ilike("%on\\_1%"), 1)
    return e.withColumn("p", hit).where(F.col("p").isNotNull()).orderBy("p", F.col("entity_id").cast("string")).limit(8).select("ticker", "name", "sector")


@query("refresh_floor", "P19", "SELECT count(*) AS total, count(*) FILTER (WHERE n > 0) AS with_ttm, count(*) FILTER (WHERE f > 0) AS with_fcf, count(*) FILTER (WHERE q > 0) AS successful, count(*) FILTER (WHERE q > 0) / CAST(count(*) AS DOUBLE) >= 0.9 AND count(*) FILTER (WHERE n > 0) / CAST(count(*) AS DOUBLE) >= 0.7 AND count(*) FILTER (WHERE f > 0) / CAST(count(*) AS DOUBLE) >= 0.5 AS passed FROM entities LEFT JOIN (SELECT entity_id, count(*) AS n, count(free_cash_flow) AS f FROM ttm GROUP BY 1) USING (entity_id) LEFT JOIN (SELECT entity_id, count(*) AS q FROM quarter_statements GROUP BY 1) USING (entity_id)")
def refresh_floor(t: Tables) -> DataFrame:
    n = t.ttm.groupBy("entity_id").agg(F.count("*").alias("n"), F.count("free_cash_flow").alias("f"))
    q = t.quarter_statements.groupBy("entity_id").agg(F.count("*").alias("q"))
    one = t.entities.join(n, "entity_id", "left").join(q, "entity_id", "left").agg(F.count("*").alias("total"), F.count_if(F.col("q") > 0).alias("successful"), F.count_if(F.col("n") > 0).alias("with_ttm"), F.count_if(F.col("f") > 0).alias("with_fcf"))
    return one.withColumn("passed", U.refresh_floor(F.col("total"), F.col("successful"), F.col("with_ttm"), F.col("with_fcf")))


@query(
    "publication_cadence",
    "F37 F36",
    """WITH s AS (SELECT session_date, lag(session_date, 2) OVER (ORDER BY session_date) AS prev FROM daily_calendar), c AS (SELECT session_date AS signal_date, session_date + CAST(session_no % 5 AS INTEGER) AS publication_date, prev AS previous_date, session_date AS latest FROM s JOIN daily_calendar USING (session_date))
SELECT signal_date, CASE WHEN dayofweek(publication_date) <> 0 THEN 'not_due' WHEN previous_date - CAST(dayofweek(previous_date) AS INTEGER) >= publication_date - CAST(dayofweek(publication_date) AS INTEGER) THEN 'not_due'
  WHEN signal_date < publication_date - 3 OR signal_date >= publication_date THEN 'market_session_unavailable' ELSE 'due' END AS decision FROM c""",
)
def publication_cadence(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    # The calendar is one row per session.
    c = t.daily_calendar.withColumn("prev", F.lag("session_date", 2).over(Window.orderBy("session_date")))
    pub = F.expr("date_add(session_date, cast(session_no % 5 as int))")
    d = c.select(F.col("session_date").alias("signal_date"), pub.alias("publication_date"), "prev")
    return d.select("signal_date", U.weekly_decision(F.col("signal_date"), F.col("publication_date"), F.col("prev"), F.col("signal_date")).alias("decision"))


@query("table_fingerprint", "S18 F39", None)
def table_fingerprint(t: Tables) -> DataFrame:
    return U.fingerprint(t.raw("orders"), ["o_orderstatus"])


@query(
    "archive_verification",
    "S17",
    "SELECT l_orderkey, l_linenumber, l_partkey, CAST(0 AS INTEGER) AS copy FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-01-01' AND l_partkey % 97 = 0 UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, 1 FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-01-01' AND l_quantity = 13",
)
def archive_verification(t: Tables) -> DataFrame:
    """Expiring rows against two archive copies: one lost some rows, the other altered some."""
    old = t.raw("lineitem").where(F.col("l_shipdate") < F.lit("1998-01-01").cast("timestamp_ntz"))
    lost = old.where(F.col("l_partkey") % 97 != 0)
    altered = old.withColumn("l_tax", F.when(F.col("l_quantity") == 13, F.col("l_tax") + 0.01).otherwise(F.col("l_tax")))
    return U.archive_gaps(old, [lost, altered], ["l_orderkey", "l_linenumber", "l_partkey"]).drop("digest")
