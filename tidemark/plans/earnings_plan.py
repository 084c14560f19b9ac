"""Report, opinion and estimate queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import r4, r6
from tidemark.operators import earnings as R
from tidemark.operators import opinions as O
from tidemark.plans.ctes import rnd
from tidemark.plans.registry import query
from tidemark.plans.tables import Tables

@query("paired_surprise", "F25 F26", f"SELECT entity_id, event_id, reported_date, max(observed_at) AS observed_at, {rnd('arg_max(surprise_percent, observed_at)')} AS surprise_percent, {rnd('arg_max(revenue_surprise_percent, observed_at)')} AS revenue_surprise_percent FROM earnings_versions WHERE surprise_percent IS NOT NULL AND revenue_surprise_percent IS NOT NULL GROUP BY 1, 2, 3")
def paired_surprise(t: Tables) -> DataFrame:
    from tidemark.operators.latest import latest_row

    both = t.earnings_versions.where(F.col("surprise_percent").isNotNull() & F.col("revenue_surprise_percent").isNotNull())
    return latest_row(both, ["entity_id", "event_id"], "observed_at").select(
        "entity_id", "event_id", "reported_date", "observed_at", r6("surprise_percent").alias("surprise_percent"), r6("revenue_surprise_percent").alias("revenue_surprise_percent")
    )


_REACTION_SQL = """reacted AS (SELECT e.*, b.close AS base_close, r.session_date AS reaction_date, r.close AS reaction_close, mb.close AS market_base, mr.close AS market_reaction
  FROM earnings_versions e
  LEFT JOIN LATERAL (SELECT * FROM canonical c WHERE c.entity_id = e.entity_id AND c.session_date <= e.reported_date - CASE WHEN coalesce(event_time < '09:30', false) THEN 1 ELSE 0 END ORDER BY session_date DESC LIMIT 1) b ON true
  LEFT JOIN LATERAL (SELECT * FROM canonical c WHERE c.entity_id = e.entity_id AND c.session_date >= e.reported_date + CASE WHEN coalesce(event_time < '09:30', false) THEN 0 ELSE 1 END ORDER BY session_date LIMIT 1) r ON true
  LEFT JOIN LATERAL (SELECT * FROM benchmark_bars c WHERE c.session_date <= e.reported_date - CASE WHEN coalesce(event_time < '09:30', false) THEN 1 ELSE 0 END ORDER BY session_date DESC LIMIT 1) mb ON true
  LEFT JOIN benchmark_bars mr ON mr.session_date = r.session_date)"""


@query(
    "earnings_reactions",
    "J17 J18 J19 J20",
    f"WITH {_REACTION_SQL} SELECT entity_id, event_id, observed_at, reaction_date, {rnd('reaction_close / base_close - 1')} AS reaction, {rnd('(reaction_close / base_close - 1) - (market_reaction / market_base - 1)')} AS reaction_vs_benchmark FROM reacted",
)
def earnings_reactions(t: Tables) -> DataFrame:
    df = R.reaction_against_benchmark(t.earnings_versions, t.canonical, t.benchmark_bars)
    return df.select("entity_id", "event_id", "observed_at", "reaction_date", r6("reaction").alias("reaction"), r6("reaction_vs_benchmark").alias("reaction_vs_benchmark"))


@query(
    "beat_streak",
    "W13",
    """WITH one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, reported_date ORDER BY observed_at DESC, event_id DESC) AS rn FROM earnings_versions) WHERE rn = 1),
marked AS (SELECT *, row_number() OVER w AS n, max(CASE WHEN coalesce(surprise_percent > 0, false) THEN 0 ELSE 1 END * 1) OVER w AS any_miss FROM one WINDOW w AS (PARTITION BY entity_id ORDER BY reported_date))
SELECT entity_id, reported_date, n - coalesce(max(CASE WHEN coalesce(surprise_percent > 0, false) THEN NULL ELSE n END) OVER (PARTITION BY entity_id ORDER BY reported_date), 0) AS streak FROM marked""",
)
def beat_streak(t: Tables) -> DataFrame:
    return R.beat_streaks(t.earnings_versions).select("entity_id", "reported_date", F.col("streak").cast("long").alias("streak"))


_KNOWN_SQL = """known AS (SELECT d.entity_id, d.session_date, d.decision_at, e.event_id, e.reported_date, e.surprise_percent,
    row_number() OVER (PARTITION BY d.entity_id, d.session_date, e.reported_date ORDER BY e.observed_at DESC, e.event_id DESC) AS v
  FROM decisions d JOIN earnings_versions e ON e.entity_id = d.entity_id AND e.observed_at <= d.decision_at AND e.reported_eps IS NOT NULL),
ordered AS (SELECT *, row_number() OVER (PARTITION BY entity_id, session_date ORDER BY reported_date DESC) AS k FROM known WHERE v = 1),
streaks AS (SELECT entity_id, session_date, coalesce(min(CASE WHEN NOT coalesce(surprise_percent > 0, false) THEN k END) - 1, count(*)) AS beat_streak FROM ordered GROUP BY 1, 2)"""


@query(
    "earnings_asof",
    "J10 X4",
    f"""WITH {_KNOWN_SQL} SELECT d.entity_id, d.session_date, o.reported_date, {rnd('o.surprise_percent')} AS surprise_percent, CAST(s.beat_streak AS BIGINT) AS beat_streak, CAST(d.decision_at AS DATE) - o.reported_date AS days_since
FROM decisions d LEFT JOIN (SELECT * FROM ordered WHERE k = 1) o ON o.entity_id = d.entity_id AND o.session_date = d.session_date
LEFT JOIN streaks s ON s.entity_id = d.entity_id AND s.session_date = d.session_date""",
)
def earnings_asof(t: Tables) -> DataFrame:
    df = R.earnings_asof(t.decisions, t.earnings_versions, "decision_at", ["surprise_percent"])
    return df.select("entity_id", "session_date", "reported_date", r6("surprise_percent").alias("surprise_percent"), F.col("beat_streak").cast("long").alias("beat_streak"), "days_since")


RECENT_SQL = """recent AS (SELECT d.entity_id, d.session_date, e.reported_date, e.surprise_percent, e.revenue_surprise_percent FROM decisions d
  JOIN LATERAL (SELECT * FROM earnings_versions e WHERE e.entity_id = d.entity_id AND e.reported_date < d.session_date AND e.observed_at <= d.decision_at ORDER BY e.reported_date DESC, e.observed_at DESC, e.event_id DESC LIMIT 1) e ON true
  WHERE d.session_date - e.reported_date <= 30)"""


@query(
    "recent_report",
    "J29 F10",
    f"""WITH {RECENT_SQL} SELECT d.entity_id, d.session_date, r.reported_date,
  {rnd("least(8.0, greatest(-8.0, (CASE WHEN r.surprise_percent IS NULL THEN 0 ELSE least(20.0, greatest(-20.0, r.surprise_percent)) END + CASE WHEN r.revenue_surprise_percent IS NULL THEN 0 ELSE least(20.0, greatest(-20.0, r.revenue_surprise_percent)) END) / 5))")} AS adjustment
FROM decisions d LEFT JOIN recent r USING (entity_id, session_date)""",
)
def recent_report(t: Tables) -> DataFrame:
    from tidemark.operators.rank import catalyst_adjustment

    df = R.recent_report(t.decisions, t.earnings_versions, "decision_at", ["surprise_percent", "revenue_surprise_percent"])
    return df.select("entity_id", "session_date", "reported_date", r6(catalyst_adjustment("surprise_percent", "revenue_surprise_percent")).alias("adjustment"))


UPCOMING_SQL = """on_calendar AS (SELECT d.entity_id, d.session_date, d.decision_at, c.event_id, arg_max(c.expected_date, c.observed_at) AS expected_date
  FROM decisions d JOIN report_calendar c ON c.entity_id = d.entity_id AND c.observed_at <= d.decision_at GROUP BY 1, 2, 3, 4),
seen_reports AS (SELECT event_id, min(observed_at) AS seen FROM earnings_versions GROUP BY 1),
next_expected AS (SELECT entity_id, session_date, min(expected_date) AS reported_date FROM on_calendar LEFT JOIN seen_reports USING (event_id)
  WHERE expected_date >= session_date AND (seen IS NULL OR seen > decision_at) GROUP BY 1, 2),
upcoming AS (SELECT d.entity_id, d.session_date, d.session_no, e.reported_date,
    CASE WHEN e.reported_date = d.session_date THEN 0 WHEN e.reported_date <= (SELECT max(session_date) FROM calendar)
      THEN greatest((SELECT max(session_no) FROM calendar c WHERE c.session_date <= e.reported_date - 1), d.session_no) + 1 - d.session_no END AS sessions_until
  FROM decisions d LEFT JOIN next_expected e USING (entity_id, session_date))"""


@query(
    "upcoming_report",
    "J30 V6",
    f"""WITH {UPCOMING_SQL} SELECT entity_id, session_date, reported_date, CAST(sessions_until AS BIGINT) AS sessions_until,
  CAST(coalesce(CAST(sessions_until <= 5 AS INT), 0) + coalesce(CAST(sessions_until <= 10 AS INT), 0) + coalesce(CAST(sessions_until <= 20 AS INT), 0) AS INTEGER) AS horizons,
  coalesce(sessions_until <= 6, false) AS blocks_5 FROM upcoming""",
)
def upcoming_report(t: Tables) -> DataFrame:
    df = R.upcoming_report(t.decisions, t.report_calendar, t.earnings_versions, t.calendar, "decision_at")
    return df.select(
        "entity_id", "session_date", "reported_date", F.col("sessions_until").cast("long").alias("sessions_until"), F.size("within").alias("horizons"), F.array_contains("within_execution", 5).alias("blocks_5")
    )


@query("entities_without_reports", "J24", "SELECT s_suppkey FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_discount >= 0.1 AND l_quantity >= 50)")
def entities_without_reports(t: Tables) -> DataFrame:
    big = t.raw("lineitem").where((F.col("l_discount") >= 0.1) & (F.col("l_quantity") >= 50)).select(F.col("l_suppkey").alias("entity_id"))
    return R.without_reports(t.raw("supplier").select(F.col("s_suppkey").alias("entity_id")), big).select(F.col("entity_id").alias("s_suppkey"))


_STUDY_SQL = """obs AS (SELECT e.*, p.session_date AS entry_date, p.forward_return_5, p.forward_return_10, p.forward_return_20 FROM earnings_versions e
  JOIN LATERAL (SELECT * FROM features f WHERE f.entity_id = e.entity_id AND f.session_date > e.reported_date ORDER BY session_date LIMIT 1) p ON true),
grouped AS (SELECT 'all' AS study_group, * FROM obs UNION ALL SELECT 'eps_beat', * FROM obs WHERE surprise_percent > 0 UNION ALL SELECT 'eps_beat_5', * FROM obs WHERE surprise_percent >= 5
  UNION ALL SELECT 'eps_miss', * FROM obs WHERE surprise_percent < 0 UNION ALL SELECT 'both_beat', * FROM obs WHERE surprise_percent > 0 AND revenue_surprise_percent > 0)"""


def _groups():
    eps, rev = F.col("surprise_percent"), F.col("revenue_surprise_percent")
    return [("all", F.lit(True)), ("eps_beat", eps > 0), ("eps_beat_5", eps >= 5), ("eps_miss", eps < 0), ("both_beat", (eps > 0) & (rev > 0))]


@query(
    "event_study",
    "A22",
    f"""WITH {_STUDY_SQL} SELECT study_group, count(*) AS n, {rnd('avg(CAST(forward_return_5 > 0 AS DOUBLE))')} AS up_rate, {rnd('avg(forward_return_5)')} AS mean_outcome, {rnd('median(forward_return_5)')} AS median_outcome
FROM grouped WHERE forward_return_5 IS NOT NULL GROUP BY 1 HAVING count(*) >= 20""",
)
def event_study(t: Tables) -> DataFrame:
    obs = R.first_session_after(t.earnings_versions, t.features, ["forward_return_5"])
    out = R.event_study(obs, _groups(), "forward_return_5", min_n=20)
    return out.select("study_group", "n", *[r6(c).alias(c) for c in ("up_rate", "mean_outcome", "median_outcome")])


@query(
    "event_study_by_year",
    "A23",
    f"""WITH {_STUDY_SQL}, long AS (SELECT study_group, year(reported_date) AS year, unnest([5, 10, 20]) AS horizon, unnest([forward_return_5, forward_return_10, forward_return_20]) AS outcome FROM grouped)
SELECT study_group, CAST(year AS INTEGER) AS year, CAST(horizon AS INTEGER) AS horizon, count(*) AS n, {rnd('avg(outcome)')} AS mean_outcome, {rnd('avg(CAST(outcome > 0 AS DOUBLE))')} AS up_rate FROM long WHERE outcome IS NOT NULL
GROUP BY GROUPING SETS ((study_group, year, horizon), (study_group, horizon))""",
)
def event_study_by_year(t: Tables) -> DataFrame:
    obs = R.first_session_after(t.earnings_versions, t.features, ["forward_return_5", "forward_return_10", "forward_return_20"])
    labels = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in _groups()]))
    long = obs.withColumn("study_group", F.explode(labels)).withColumn("year", F.year("reported_date"))
    pairs = F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"forward_return_{h}").alias("outcome")) for h in (5, 10, 20)])
    long = long.select("study_group", "year", F.inline(pairs)).where(F.col("outcome").isNotNull())
    g = F.col("study_group"), F.col("year"), F.col("horizon")
    sets = long.groupingSets([list(g), [g[0], g[2]]], *g)
    return sets.agg(F.count("*").alias("n"), r6(F.avg("outcome")).alias("mean_outcome"), r6(F.avg((F.col("outcome") > 0).cast("double"))).alias("up_rate"))


CONSENSUS_SQL = """consensus AS (SELECT d.entity_id, d.session_date, d.decision_at, a.*EXCLUDE (entity_id),
    strong_buy + buy + hold + sell + strong_sell AS total, CASE WHEN a.observed_at IS NULL THEN 'missing' WHEN a.observed_at < d.decision_at - INTERVAL 7 DAY THEN 'stale_capture'
      WHEN CAST(d.decision_at AS DATE) - a.period_date > 45 THEN 'stale_provider_period' WHEN strong_buy + buy + hold + sell + strong_sell < 3 THEN 'insufficient_analysts' ELSE 'current' END AS status
  FROM decisions d LEFT JOIN LATERAL (SELECT * FROM analyst_snapshots a WHERE a.entity_id = d.entity_id AND a.observed_at <= d.decision_at ORDER BY observed_at DESC, period_date DESC, source DESC LIMIT 1) a ON true),
scored AS (SELECT *, CASE WHEN status = 'current' THEN floor((50 + ((100 * strong_buy + 75 * buy + 50 * hold + 25 * sell) / CAST(total AS DOUBLE) - 50) * total / (total + 5)) * 1e4 + 0.5) / 1e4 ELSE 50 END AS analyst_score FROM consensus)"""


@query(
    "analyst_consensus",
    "A37 J16",
    f"""WITH {CONSENSUS_SQL} SELECT entity_id, session_date, analyst_score, status AS analyst_status, CASE WHEN status = 'current' THEN CAST(total AS BIGINT) END AS analyst_count,
  CASE WHEN status = 'current' THEN {rnd('(strong_buy + buy) / CAST(total AS DOUBLE)')} END AS buy_share FROM scored""",
)
def analyst_consensus(t: Tables) -> DataFrame:
    df = O.consensus_asof(t.decisions, t.analyst_snapshots, "decision_at")
    return df.select("entity_id", "session_date", "analyst_score", "analyst_status", "analyst_count", r6("buy_share").alias("buy_share"))


@query(
    "analyst_score_change",
    "J16",
    f"""WITH asks AS (SELECT entity_id, session_date, decision_at, decision_at - INTERVAL 30 DAY AS earlier FROM decisions), two AS (
  SELECT d.entity_id, d.session_date, c.side, a.observed_at, a.period_date, strong_buy + buy + hold + sell + strong_sell AS total, 100 * strong_buy + 75 * buy + 50 * hold + 25 * sell AS pts, c.ask
  FROM asks d, LATERAL (SELECT 'now' AS side, d.decision_at AS ask UNION ALL SELECT 'old', d.earlier) c
  LEFT JOIN LATERAL (SELECT * FROM analyst_snapshots a WHERE a.entity_id = d.entity_id AND a.observed_at <= c.ask ORDER BY observed_at DESC, period_date DESC LIMIT 1) a ON true),
scores AS (SELECT entity_id, session_date, side, CASE WHEN observed_at >= ask - INTERVAL 7 DAY AND CAST(ask AS DATE) - period_date <= 45 AND total >= 3 THEN floor((50 + (pts / CAST(total AS DOUBLE) - 50) * total / (total + 5)) * 1e4 + 0.5) / 1e4 END AS s FROM two)
SELECT entity_id, session_date, {rnd("max(s) FILTER (WHERE side = 'now') - max(s) FILTER (WHERE side = 'old')", 4)} AS score_change FROM scores GROUP BY 1, 2""",
)
def analyst_score_change(t: Tables) -> DataFrame:
    df = O.consensus_change(t.decisions, t.analyst_snapshots, "decision_at")
    return df.select("entity_id", "session_date", r4("analyst_score_change_30d").alias("score_change"))
