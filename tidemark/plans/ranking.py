"""Peer scores, eligibility, priority ranking and the selections built on it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import r2, r4, r6
from tidemark.operators import earnings as R
from tidemark.operators import fundamentals as S
from tidemark.operators import opinions as O
from tidemark.operators import rank as K
from tidemark.operators import screen as SC
from tidemark.operators.ranks import medians
from tidemark.plans.ctes import cte, rnd
from tidemark.plans.earnings_plan import CONSENSUS_SQL, RECENT_SQL, UPCOMING_SQL
from tidemark.plans.registry import query
from tidemark.plans.statements import QUARTER_FACTORS_SQL, factor_rows
from tidemark.plans.tables import Tables

MIN_PEERS, MIN_SAMPLE, MIN_FINANCIAL, MIN_TOTAL, TOP = 3, 10, 40.0, 45.0, 5
KEY = ["entity_id", "session_date"]
GROUP = ["session_date", "sector", "profile"]


def profiled_factors(t: Tables) -> DataFrame:
    """Factor rows with sector and profile; every sixth entity reports as a bank."""
    f = factor_rows(t).where(F.col("period_end").isNotNull())
    e = t.entities.withColumn("industry", F.when(F.col("entity_id") % 6 == 0, "Regional Banks").otherwise("Other"))
    e = e.select("entity_id", "sector", "ticker", S.finance_profile(F.col("sector"), F.col("industry")).alias("profile"))
    df = f.join(e, "entity_id").withColumn("age_days", F.datediff("session_date", "period_end"))
    # One row per entity and quarter, read by every branch below.
    return t.shared("profiled_factors", df)


def _weights_values(profile: str, weights: dict[str, float]) -> str:
    return ", ".join(f"('{profile}', '{k}', CAST({w} AS DOUBLE))" for k, w in weights.items())


_FACTOR_COLS = ", ".join(
    f"('{c}', CAST({c if c != 'cet1_ratio' else 'NULL'} AS DOUBLE))"
    for c in sorted({*K.GENERAL_WEIGHTS, *K.FINANCIAL_WEIGHTS, *K.BANK_WEIGHTS})
)
PEER_SQL = f"""{QUARTER_FACTORS_SQL},
weights AS (SELECT * FROM (VALUES {", ".join(_weights_values(p, w) for p, w in K.PROFILE_WEIGHTS.items() if p != "financial")}) v(profile, factor, weight)),
profiled AS (SELECT f.*, e.sector, e.ticker, CASE WHEN f.entity_id % 6 = 0 THEN 'bank' ELSE 'general' END AS profile, f.session_date - f.period_end AS age_days FROM factors f JOIN entities e USING (entity_id)),
factor_long AS (SELECT p.entity_id, p.session_date, p.sector, p.profile, w.factor, w.weight, v.value FROM profiled p JOIN weights w ON w.profile = p.profile,
  LATERAL (SELECT * FROM (VALUES {_FACTOR_COLS}) x(factor, value)) v WHERE v.factor = w.factor),
eligible_long AS (SELECT * FROM factor_long WHERE (entity_id, session_date) IN (SELECT entity_id, session_date FROM factor_long WHERE value IS NOT NULL GROUP BY 1, 2 HAVING sum(weight) + 1e-9 >= 0.8)
  AND (entity_id, session_date) IN (SELECT entity_id, session_date FROM profiled WHERE age_days BETWEEN 0 AND 180)),
peers AS (SELECT *, CASE WHEN value IS NOT NULL THEN 100.0 * (rank() OVER (PARTITION BY session_date, sector, profile, factor, value IS NULL ORDER BY value) - 1
    + count(*) OVER (PARTITION BY session_date, sector, profile, factor, value) / 2.0) / count(value) OVER (PARTITION BY session_date, sector, profile, factor) END AS pct,
  count(value) OVER (PARTITION BY session_date, sector, profile, factor) AS n FROM eligible_long),
peer_scored AS (SELECT *, CASE WHEN value IS NOT NULL AND n >= {MIN_PEERS} THEN CASE WHEN factor = 'net_debt_to_fcf' THEN 100 - pct ELSE pct END END AS score FROM peers),
fin AS (SELECT entity_id, session_date, sum(coalesce(score * weight, 0)) AS financial_score, sum(CASE WHEN score IS NOT NULL THEN weight ELSE 0 END) AS peer_coverage FROM peer_scored GROUP BY 1, 2)"""


def eligible_factors(t: Tables) -> tuple[DataFrame, DataFrame]:
    """All candidates with their factor coverage, and the long factors of the eligible ones."""
    cand = profiled_factors(t)
    long = K.factor_long(cand, [*KEY, "sector", "age_days"])
    cover = K.value_coverage(long, KEY)
    ok = cover.where(F.col("value_coverage") + 1e-9 >= K.MIN_FACTOR_COVERAGE).select(*KEY)
    fresh = long.where(F.col("age_days").between(0, S.MAX_STATEMENT_AGE)).drop("age_days")
    return cand.join(cover, KEY, "left"), t.shared("eligible_long", fresh.join(ok, KEY, "left_semi"))


@query(
    "peer_percentiles",
    "W12",
    f"WITH {PEER_SQL} SELECT entity_id, session_date, factor, n AS peers, {rnd('score')} AS score, {rnd('coalesce(score * weight, 0)')} AS contribution FROM peer_scored WHERE value IS NOT NULL",
)
def peer_percentiles(t: Tables) -> DataFrame:
    _, long = eligible_factors(t)
    s = K.peer_scores(long, GROUP, MIN_PEERS).where(F.col("value").isNotNull())
    return s.select(*KEY, "factor", "peers", r6("score").alias("score"), r6("contribution").alias("contribution"))


def ranked_candidates(t: Tables) -> DataFrame:
    """Every quarterly candidate with its components, its total and its rejection reason."""
    cand, long = eligible_factors(t)
    scored = K.financial_score(K.peer_scores(long, GROUP, MIN_PEERS), KEY)
    setups = t.setups.select(*KEY, F.col("setup_score").alias("technical_score"), "sample_size")
    base = cand.select(*KEY, "sector", "decision_at", "session_no", "age_days", "value_coverage", "ticker")
    df = base.join(scored, KEY, "left").join(setups, KEY, "left")
    df = R.recent_report(df, t.earnings_versions, "decision_at", ["surprise_percent", "revenue_surprise_percent"]).withColumnRenamed("reported_date", "last_report")
    df = R.upcoming_report(df, t.report_calendar, t.earnings_versions, t.calendar, "decision_at")
    df = O.consensus_asof(df, t.analyst_snapshots, "decision_at")
    df = df.withColumn("earnings_score", F.lit(50.0) + K.catalyst_adjustment("surprise_percent", "revenue_surprise_percent") * 6.25)
    df = K.priority(df)
    reason = K.first_reason(
        (~F.col("age_days").between(0, S.MAX_STATEMENT_AGE), "old_ttm_period"),
        (F.coalesce("value_coverage", F.lit(0.0)) + 1e-9 < K.MIN_FACTOR_COVERAGE, "insufficient_financial_factor_coverage"),
        (F.coalesce("peer_coverage", F.lit(0.0)) + 1e-9 < K.MIN_FACTOR_COVERAGE, "insufficient_sector_peer_coverage"),
        (F.array_contains("within_execution", 5), "earnings_within_primary_horizon"),
        (F.col("technical_score").isNull() | (F.col("sample_size") < MIN_SAMPLE), "insufficient_price_setup_history"),
        (F.col("financial_score") < MIN_FINANCIAL, "financial_score_below_minimum"),
        (F.col("total_score") < MIN_TOTAL, "combined_score_below_minimum"),
    )
    return t.shared("ranked_candidates", df.withColumn("reject_reason", reason))


RANK_SQL = f"""{PEER_SQL}, {RECENT_SQL}, {UPCOMING_SQL}, {CONSENSUS_SQL},
cover AS (SELECT entity_id, session_date, sum(CASE WHEN value IS NOT NULL THEN weight ELSE 0 END) AS value_coverage FROM factor_long GROUP BY 1, 2),
joined AS (SELECT p.entity_id, p.session_date, p.sector, p.ticker, p.age_days, c.value_coverage, f.financial_score, f.peer_coverage, s.setup_score AS technical_score, s.sample_size, u.sessions_until, a.analyst_score,
    50 + 6.25 * least(8.0, greatest(-8.0, (CASE WHEN r.surprise_percent IS NULL THEN 0 ELSE least(20.0, greatest(-20.0, r.surprise_percent)) END + CASE WHEN r.revenue_surprise_percent IS NULL THEN 0 ELSE least(20.0, greatest(-20.0, r.revenue_surprise_percent)) END) / 5)) AS earnings_score
  FROM profiled p LEFT JOIN cover c USING (entity_id, session_date) LEFT JOIN fin f USING (entity_id, session_date) LEFT JOIN setups s USING (entity_id, session_date)
  LEFT JOIN recent r USING (entity_id, session_date) LEFT JOIN upcoming u USING (entity_id, session_date) LEFT JOIN scored a USING (entity_id, session_date)),
totals AS (SELECT *, 0.45 * financial_score + 0.35 * least(100, greatest(0, technical_score)) + 0.10 * earnings_score + 0.10 * analyst_score AS total_score FROM joined),
ranked AS (SELECT *, CASE WHEN age_days NOT BETWEEN 0 AND 180 THEN 'old_ttm_period' WHEN coalesce(value_coverage, 0) + 1e-9 < 0.8 THEN 'insufficient_financial_factor_coverage'
  WHEN coalesce(peer_coverage, 0) + 1e-9 < 0.8 THEN 'insufficient_sector_peer_coverage' WHEN coalesce(sessions_until <= 6, false) THEN 'earnings_within_primary_horizon'
  WHEN technical_score IS NULL OR sample_size < {MIN_SAMPLE} THEN 'insufficient_price_setup_history' WHEN financial_score < {MIN_FINANCIAL} THEN 'financial_score_below_minimum'
  WHEN total_score < {MIN_TOTAL} THEN 'combined_score_below_minimum' END AS reject_reason FROM totals)"""


@query(
    "ranked_candidates",
    "Q1 P9 P11 P12 F18 T2 T6",
    f"""WITH {RANK_SQL} SELECT entity_id, session_date, sector, reject_reason, {rnd('financial_score', 4)} AS financial_score, {rnd('technical_score', 2)} AS technical_score, {rnd('earnings_score', 4)} AS earnings_score, analyst_score,
  CASE WHEN reject_reason IS NULL THEN {rnd('total_score', 4)} END AS total_score,
  CASE WHEN reject_reason IS NULL AND rk <= {TOP} THEN rk END AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY session_date, reject_reason IS NULL ORDER BY floor(total_score * 1e4 + 0.5) DESC, CAST(entity_id AS VARCHAR)) AS rk FROM ranked)""",
)
def ranked_candidates_q(t: Tables) -> DataFrame:
    df = ranked_candidates(t).withColumn("_total", F.when(F.col("reject_reason").isNull(), r4("total_score")))
    picks = K.top_n(df, TOP, "_total", ["session_date"]).select(*KEY, "rank")
    cols = [r4("financial_score").alias("financial_score"), r2("technical_score").alias("technical_score"), r4("earnings_score").alias("earnings_score"), "analyst_score"]
    return df.join(picks, KEY, "left").select(*KEY, "sector", "reject_reason", *cols, F.col("_total").alias("total_score"), F.col("rank").cast("long").alias("rank"))


@query("rejection_histogram", "A18", f"WITH {RANK_SQL} SELECT coalesce(reject_reason, 'eligible') AS reason, count(*) AS candidates FROM ranked GROUP BY 1")
def rejection_histogram(t: Tables) -> DataFrame:
    return ranked_candidates(t).groupBy(F.coalesce("reject_reason", F.lit("eligible")).alias("reason")).agg(F.count("*").alias("candidates"))


@query(
    "sector_valuation",
    "A4 F11",
    f"""WITH {QUARTER_FACTORS_SQL}, v AS (SELECT f.entity_id, f.session_date, e.sector, CASE WHEN eps_diluted > 0 THEN least(250.0, close / eps_diluted) END AS pe FROM factors f JOIN entities e USING (entity_id)),
med AS (SELECT session_date, sector, median(pe) AS median_pe FROM v GROUP BY 1, 2)
SELECT entity_id, session_date, {rnd('pe')} AS pe, {rnd('median_pe')} AS median_pe, {rnd('pe / nullif(median_pe, 0) - 1')} AS pe_vs_sector FROM v JOIN med USING (session_date, sector)""",
)
def sector_valuation(t: Tables) -> DataFrame:
    f = profiled_factors(t)
    pe = F.when(F.col("eps_diluted") > 0, F.least(F.lit(250.0), F.col("close") / F.col("eps_diluted")))
    v = f.select(*KEY, "sector", pe.alias("pe"))
    out = v.join(medians(v, ["session_date", "sector"], "pe", "median_pe"), ["session_date", "sector"], "left")
    vs = F.when(F.col("median_pe") != 0, F.col("pe") / F.col("median_pe") - 1)
    return out.select(*KEY, r6("pe").alias("pe"), r6("median_pe").alias("median_pe"), r6(vs).alias("pe_vs_sector"))


_V2 = ["drawdown_60", "distance_to_support_60", "return_1", "momentum_5", "relative_momentum_5", "close_vs_sma20", "volume_ratio_20"]


def _v2(t: Tables) -> DataFrame:
    f = t.features.where(F.col("drawdown_60").isNotNull() & F.col("distance_to_support_60").isNotNull() & F.col("momentum_5").isNotNull() & F.col("relative_momentum_5").isNotNull())
    unit = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    down = -F.col("drawdown_60")
    depth = unit((down - 0.04) / 0.16) * unit((F.lit(0.35) - down) / 0.15)
    near = F.lit(1.0) - unit(F.col("distance_to_support_60") / 0.18)
    turn = unit((F.coalesce("return_1", F.lit(0.0)) + 0.02) / 0.04) * 0.5 + unit((F.col("momentum_5") + 0.04) / 0.08) * 0.5
    strength = (F.col("relative_momentum_5") + 0.04) / 0.08
    room = F.lit(1.0) - unit(F.abs(F.coalesce("close_vs_sma20", F.lit(0.0)) + 0.03) / 0.15)
    activity = (F.coalesce("volume_ratio_20", F.lit(1.0)) - 0.7) / 0.8
    score = K.setup_score_v2([(depth, 0.25), (near, 0.25), (turn, 0.20), (strength, 0.20), (room, 0.07), (activity, 0.03)])
    return f.withColumn("setup_v2", score)


def _u(x: str) -> str:
    return f"greatest(0, least(1, {x}))"


V2_SQL = f"""v2 AS (SELECT *, 100 * (0.25 * {_u('(-drawdown_60 - 0.04) / 0.16')} * {_u('(0.35 + drawdown_60) / 0.15')} + 0.25 * (1 - {_u('distance_to_support_60 / 0.18')})
  + 0.20 * (0.5 * {_u('(coalesce(return_1, 0) + 0.02) / 0.04')} + 0.5 * {_u('(momentum_5 + 0.04) / 0.08')}) + 0.20 * {_u('(relative_momentum_5 + 0.04) / 0.08')}
  + 0.07 * (1 - {_u('abs(coalesce(close_vs_sma20, 0) + 0.03) / 0.15')}) + 0.03 * {_u('(coalesce(volume_ratio_20, 1) - 0.7) / 0.8')}) AS setup_v2
  FROM features WHERE drawdown_60 IS NOT NULL AND distance_to_support_60 IS NOT NULL AND momentum_5 IS NOT NULL AND relative_momentum_5 IS NOT NULL)"""


@query("setup_score_v2", "F13 F5", f"WITH {V2_SQL} SELECT entity_id, session_date, {rnd('setup_v2', 4)} AS setup_v2 FROM v2")
def setup_score_v2(t: Tables) -> DataFrame:
    return _v2(t).select(*KEY, r4("setup_v2").alias("setup_v2"))


@query(
    "top_k_ladder",
    "T4",
    f"""WITH {V2_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY session_date ORDER BY setup_v2 DESC, CAST(entity_id AS VARCHAR)) AS rk FROM (SELECT * REPLACE ({rnd('setup_v2', 4)} AS setup_v2) FROM v2))
SELECT session_date, k, {rnd('avg(forward_return_5)')} AS mean_outcome, count(*) AS picks FROM r, (VALUES (5), (10), (20)) s(k) WHERE rk <= k GROUP BY 1, 2""",
)
def top_k_ladder(t: Tables) -> DataFrame:
    ranked = K.top_n(_v2(t).withColumn("setup_v2", r4("setup_v2")), 20, "setup_v2", ["session_date"])
    out = K.top_ladder(ranked, ["session_date"], (5, 10, 20), "forward_return_5")
    return out.select("session_date", "k", r6("mean_outcome").alias("mean_outcome"), "picks")


@query(
    "two_rankings",
    "T3 U5",
    f"""WITH {V2_SQL}, both_scores AS (SELECT v.entity_id, v.session_date, {rnd('v.setup_v2', 4)} AS a, {rnd('s.setup_score', 4)} AS b FROM v2 v JOIN setups s USING (entity_id, session_date)),
ra AS (SELECT session_date, entity_id FROM (SELECT *, row_number() OVER (PARTITION BY session_date ORDER BY a DESC, CAST(entity_id AS VARCHAR)) AS rk FROM both_scores) WHERE rk <= 5),
rb AS (SELECT session_date, entity_id FROM (SELECT *, row_number() OVER (PARTITION BY session_date ORDER BY b DESC, CAST(entity_id AS VARCHAR)) AS rk FROM both_scores) WHERE rk <= 5)
SELECT session_date, count(*) FILTER (WHERE x.entity_id IS NOT NULL AND y.entity_id IS NOT NULL) AS common, count(*) > count(*) FILTER (WHERE x.entity_id IS NOT NULL AND y.entity_id IS NOT NULL) AS changed
FROM ra x FULL JOIN rb y USING (session_date, entity_id) GROUP BY 1""".replace("x.entity_id IS NOT NULL AND y.entity_id IS NOT NULL", "ia AND ib").replace("FROM ra x FULL JOIN rb y", "FROM (SELECT *, true AS ia FROM ra) x FULL JOIN (SELECT *, true AS ib FROM rb) y"),
)
def two_rankings(t: Tables) -> DataFrame:
    both = _v2(t).select(*KEY, r4("setup_v2").alias("a")).join(t.setups.select(*KEY, r4("setup_score").alias("b")), KEY)
    a = K.top_n(both, 5, "a", ["session_date"]).select(*KEY, F.lit(1).alias("in_a"))
    b = K.top_n(both, 5, "b", ["session_date"]).select(*KEY, F.lit(1).alias("in_b"))
    common = F.count_if(F.col("in_a").isNotNull() & F.col("in_b").isNotNull())
    return a.join(b, KEY, "full").groupBy("session_date").agg(common.alias("common"), (F.count("*") > common).alias("changed"))


@query(
    "sector_capped_top",
    "T10",
    f"""WITH {V2_SQL}, s AS (SELECT *, row_number() OVER (PARTITION BY session_date, sector ORDER BY setup_v2 DESC, CAST(entity_id AS VARCHAR)) AS sector_rank FROM (SELECT * REPLACE ({rnd('setup_v2', 4)} AS setup_v2) FROM v2))
SELECT session_date, entity_id, sector, rank FROM (SELECT *, row_number() OVER (PARTITION BY session_date ORDER BY setup_v2 DESC, CAST(entity_id AS VARCHAR)) AS rank FROM s WHERE sector_rank <= 2) WHERE rank <= 8""",
)
def sector_capped_top(t: Tables) -> DataFrame:
    df = _v2(t).withColumn("setup_v2", r4("setup_v2"))
    return K.sector_capped(df, "setup_v2", 2, 8, ["session_date"]).select("session_date", "entity_id", "sector", "rank")


#: Decisions of the screened choice, and its limits; weekly averages of a nation's prices move less together than stocks, so the limit is lower.
_EVERY, _SCREEN = 20, {"limit": 0.3, "per_sector": 2, "most": 6}
cte(
    "pair_correlations",
    f"""WITH r AS (SELECT entity_id, session_no, return_1 FROM features WHERE return_1 IS NOT NULL), d AS (SELECT session_no AS as_of FROM calendar WHERE session_no % {_EVERY} = 0),
c AS (SELECT d.as_of, a.entity_id AS left_id, b.entity_id AS right_id, a.return_1 AS x, b.return_1 AS y, row_number() OVER (PARTITION BY d.as_of, a.entity_id, b.entity_id ORDER BY a.session_no DESC) AS k
  FROM d JOIN r a ON a.session_no <= d.as_of JOIN r b ON a.session_no = b.session_no AND a.entity_id < b.entity_id)
SELECT as_of, left_id, right_id, count(*) AS n, CASE WHEN count(*) >= 40 THEN corr(x, y) END AS correlation FROM c WHERE k <= 60 GROUP BY 1, 2, 3""",
)


def correlations(t: Tables) -> DataFrame:
    as_of = [r[0] for r in t.calendar.where(F.col("session_no") % _EVERY == 0).select("session_no").collect()]  # a few decision dates a year
    return t.shared("correlations", SC.pair_correlations(t.features, as_of))


@query("correlation_matrix", "J35 U6", f"SELECT as_of, left_id, right_id, n, {rnd('correlation')} AS correlation FROM pair_correlations")
def correlation_matrix(t: Tables) -> DataFrame:
    return correlations(t).select("as_of", "left_id", "right_id", "n", r6("correlation").alias("correlation"))


@query(
    "screened_choice",
    "T10 J35",
    f"""WITH RECURSIVE {V2_SQL}, k AS (SELECT session_no, entity_id, sector, row_number() OVER (PARTITION BY session_no ORDER BY {rnd('setup_v2', 4)} DESC, CAST(entity_id AS VARCHAR)) AS rk FROM v2 WHERE session_no % {_EVERY} = 0 AND setup_v2 IS NOT NULL),
no AS (SELECT as_of, left_id AS a, right_id AS b FROM pair_correlations WHERE correlation IS NULL OR floor(correlation * 1e6 + 0.5) / 1e6 >= {_SCREEN['limit']} UNION ALL SELECT as_of, right_id, left_id FROM pair_correlations WHERE correlation IS NULL OR floor(correlation * 1e6 + 0.5) / 1e6 >= {_SCREEN['limit']}),
c AS (SELECT k.*, coalesce((SELECT list(b) FROM no WHERE no.as_of = k.session_no AND no.a = k.entity_id), []) AS foes FROM k),
g AS (SELECT session_no, CAST(0 AS BIGINT) AS rk, CAST([] AS BIGINT[]) AS ids, CAST([] AS VARCHAR[]) AS sectors FROM c GROUP BY 1
  UNION ALL SELECT g.session_no, c.rk, CASE WHEN ok THEN list_append(g.ids, c.entity_id) ELSE g.ids END, CASE WHEN ok THEN list_append(g.sectors, c.sector) ELSE g.sectors END
  FROM g JOIN c ON c.session_no = g.session_no AND c.rk = g.rk + 1, LATERAL (SELECT len(g.ids) < {_SCREEN['most']} AND NOT list_has_any(g.ids, c.foes) AND len(list_filter(g.sectors, lambda s: s = c.sector)) < {_SCREEN['per_sector']} AS ok)),
done AS (SELECT session_no, arg_max(ids, rk) AS ids FROM g GROUP BY 1)
SELECT session_no, CAST(i AS INTEGER) AS rank, ids[i] AS entity_id FROM done, LATERAL (SELECT unnest(range(1, len(ids) + 1)) AS i)""",
)
def screened_choice(t: Tables) -> DataFrame:
    """At every twentieth session the best setups that are not alike, two of a sector and six in all at most."""
    df = _v2(t).where((F.col("session_no") % _EVERY == 0) & F.col("setup_v2").isNotNull()).select("session_no", "entity_id", "sector", r4("setup_v2").alias("setup_v2"))
    alike = SC.conflicts(correlations(t).withColumn("correlation", r6("correlation")), _SCREEN["limit"]).withColumnRenamed("as_of", "session_no")
    order = [F.col("setup_v2").desc(), F.col("entity_id").cast("string")]
    taken = SC.greedy_choice(df, alike, ["session_no"], order, per_sector=_SCREEN["per_sector"], most=_SCREEN["most"])
    return taken.select("session_no", "rank", "entity_id")


@query(
    "current_candidates",
    "P21 T9",
    f"""WITH {V2_SQL} SELECT * FROM (SELECT entity_id, session_date, {rnd('setup_v2', 4)} AS setup_v2, row_number() OVER (ORDER BY floor(setup_v2 * 1e4 + 0.5) DESC, CAST(entity_id AS VARCHAR)) AS rank FROM v2
WHERE session_date = (SELECT max(session_date) FROM v2)) WHERE rank <= 20""",
)
def current_candidates(t: Tables) -> DataFrame:
    df = _v2(t).withColumn("setup_v2", r4("setup_v2"))
    now = df.where(F.col("session_date") == df.agg(F.max("session_date")).scalar())
    return K.top_n(now, 20, "setup_v2").select(*KEY, "setup_v2", "rank")
