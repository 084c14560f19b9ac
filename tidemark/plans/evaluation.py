"""Selections, their execution, cohort evaluation and value curves."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import r4, r6
from tidemark.operators import evaluate as E
from tidemark.operators import models as M
from tidemark.operators import rank as K
from tidemark.operators import returns as R
from tidemark.operators.ranks import quantiles
from tidemark.plans.ctes import cte, rnd
from tidemark.plans.registry import query
from tidemark.plans.tables import Tables

HORIZONS = (5, 10, 20)
SIGNAL = ["model_version", "session_no"]

cte(
    "selections",
    """SELECT model_version, session_no, session_date AS signal_date, entity_id, sector, volatility_20, score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY model_version, session_no ORDER BY score DESC, CAST(entity_id AS VARCHAR)) AS rank FROM (
    SELECT 'momentum' AS model_version, *, momentum_20 AS score FROM features WHERE session_no % 4 = 1 AND momentum_20 > 0.02
    UNION ALL SELECT 'reversal', *, -momentum_20 FROM features WHERE session_no % 4 = 1 AND momentum_20 < -0.02)) WHERE rank <= 5""",
)
cte(
    "cohort_list",
    """SELECT m.model_version, c.session_no, c.session_date AS signal_date, coalesce(p.n, 0) AS expected_picks FROM calendar c, (VALUES ('momentum'), ('reversal')) m(model_version)
LEFT JOIN (SELECT model_version, session_no, count(*) AS n FROM selections GROUP BY 1, 2) p ON p.model_version = m.model_version AND p.session_no = c.session_no
WHERE c.session_no % 4 = 1 AND c.session_no > 20""",
)
cte(
    "matured",
    """SELECT *, gross_return - 0.002 AS actual_return, b_exit / b_entry - 1 AS benchmark_return, gross_return - 0.002 - (b_exit / b_entry - 1) AS excess_return, gross_return - 0.002 > 0 AS correct_direction FROM (
  SELECT s.*, e.close AS entry_price, x.close AS exit_price, x.close / e.close - 1 AS gross_return, eb.close AS b_entry, xb.close AS b_exit,
    CASE WHEN s.session_no + 1 + horizon > (SELECT max(session_no) FROM calendar) THEN 'pending' WHEN e.close IS NULL OR x.close IS NULL THEN 'missing' ELSE 'complete' END AS status
  FROM (SELECT *, unnest([5, 10, 20]) AS horizon FROM selections) s
  LEFT JOIN panel e ON e.entity_id = s.entity_id AND e.session_no = s.session_no + 1 LEFT JOIN panel x ON x.entity_id = s.entity_id AND x.session_no = s.session_no + 1 + horizon
  LEFT JOIN panel eb ON eb.entity_id = -1 AND eb.session_no = s.session_no + 1 LEFT JOIN panel xb ON xb.entity_id = -1 AND xb.session_no = s.session_no + 1 + horizon)""",
)
cte(
    "cohort_outcomes",
    """SELECT c.model_version, c.session_no, c.signal_date, h.horizon, c.expected_picks, c.expected_picks = 0 AS cash,
  CASE WHEN c.expected_picks = 0 THEN 0 ELSE m.ret END AS cohort_return, CASE WHEN c.expected_picks = 0 THEN -(x.close / e.close - 1) ELSE m.excess END AS cohort_excess
FROM cohort_list c, (VALUES (5), (10), (20)) h(horizon)
LEFT JOIN (SELECT model_version, session_no, horizon, count(*) AS n, count(excess_return) AS k, avg(actual_return) AS ret, avg(excess_return) AS excess FROM matured GROUP BY 1, 2, 3) m
  ON m.model_version = c.model_version AND m.session_no = c.session_no AND m.horizon = h.horizon
LEFT JOIN panel e ON e.entity_id = -1 AND e.session_no = c.session_no + 1 LEFT JOIN panel x ON x.entity_id = -1 AND x.session_no = c.session_no + 1 + h.horizon
WHERE CASE WHEN c.expected_picks = 0 THEN x.close IS NOT NULL ELSE m.n = c.expected_picks AND m.k = c.expected_picks END""",
)


def selections(t: Tables) -> DataFrame:
    f = t.features.where((F.col("session_no") % 4 == 1) & F.col("momentum_20").isNotNull())
    keep = ["session_no", F.col("session_date").alias("signal_date"), "entity_id", "sector", "volatility_20"]
    up = f.where(F.col("momentum_20") > 0.02).select(F.lit("momentum").alias("model_version"), *keep, F.col("momentum_20").alias("score"))
    down = f.where(F.col("momentum_20") < -0.02).select(F.lit("reversal").alias("model_version"), *keep, (-F.col("momentum_20")).alias("score"))
    return t.shared("selections", K.top_n(up.unionByName(down), 5, "score", SIGNAL))


def cohort_list(t: Tables) -> DataFrame:
    days = t.calendar.where((F.col("session_no") % 4 == 1) & (F.col("session_no") > 20)).withColumn("model_version", F.explode(F.array(F.lit("momentum"), F.lit("reversal"))))
    n = selections(t).groupBy(*SIGNAL).agg(F.count("*").alias("n"))
    return days.join(n, SIGNAL, "left").select(*SIGNAL, F.col("session_date").alias("signal_date"), F.coalesce("n", F.lit(0)).alias("expected_picks"))


def matured(t: Tables) -> DataFrame:
    s = selections(t).withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in HORIZONS])))
    return t.shared("matured", E.mature(E.execute(s, t.calendar, t.panel), t.benchmark_panel))


def outcomes(t: Tables) -> DataFrame:
    ask = cohort_list(t).withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in HORIZONS])))
    b = t.benchmark_panel
    entry = b.select((F.col("session_no") - 1).alias("session_no"), F.col("close").alias("b0"))
    spans = [b.select((F.col("session_no") - 1 - h).alias("session_no"), F.lit(h).alias("horizon"), F.col("close").alias("b1")) for h in HORIZONS]
    later = spans[0].unionByName(spans[1]).unionByName(spans[2])
    bench = later.join(entry, "session_no").select("session_no", "horizon", (F.col("b1") / F.col("b0") - 1).alias("benchmark_return"))
    out = E.cohort_outcomes(ask, matured(t), bench)
    return t.shared("cohort_outcomes", out.join(F.broadcast(t.calendar.select("session_no", F.col("session_date").alias("signal_date"))), "session_no"))


@query(
    "signal_execution",
    "J21 W32 Q14",
    f"SELECT model_version, signal_date, entity_id, CAST(horizon AS INTEGER) AS horizon, rank, status, {rnd('gross_return')} AS gross_return, {rnd('actual_return')} AS actual_return, {rnd('excess_return')} AS excess_return, correct_direction FROM matured",
)
def signal_execution(t: Tables) -> DataFrame:
    vals = [r6(c).alias(c) for c in ("gross_return", "actual_return", "excess_return")]
    return matured(t).select("model_version", "signal_date", "entity_id", "horizon", "rank", "status", *vals, "correct_direction")


@query(
    "signal_timelines",
    "W31 Q5",
    f"""SELECT s.model_version, s.signal_date, s.entity_id, CAST(s.horizon AS INTEGER) AS horizon, {rnd('p.close')} AS price,
  CASE WHEN p.close IS NOT NULL THEN 'complete' WHEN s.session_no + s.horizon <= (SELECT max(session_no) FROM calendar) THEN 'missing' ELSE 'pending' END AS status
FROM (SELECT *, unnest([5, 10, 20]) AS horizon FROM selections) s LEFT JOIN panel p ON p.entity_id = s.entity_id AND p.session_no = s.session_no + s.horizon""",
)
def signal_timelines(t: Tables) -> DataFrame:
    out = E.timelines(selections(t), t.calendar, t.panel)
    return out.select("model_version", "signal_date", "entity_id", "horizon", r6("price").alias("price"), "status")


@query("cohort_ledger", "Q6 Q13 A42", "SELECT model_version, signal_date, session_no, expected_picks FROM cohort_list")
def cohort_ledger(t: Tables) -> DataFrame:
    return cohort_list(t).select("model_version", "signal_date", "session_no", "expected_picks")


@query(
    "cohort_returns",
    "A12",
    f"SELECT model_version, signal_date, CAST(horizon AS INTEGER) AS horizon, cash, {rnd('cohort_return')} AS cohort_return, {rnd('cohort_excess')} AS cohort_excess FROM cohort_outcomes",
)
def cohort_returns(t: Tables) -> DataFrame:
    return outcomes(t).select("model_version", "signal_date", "horizon", "cash", r6("cohort_return").alias("cohort_return"), r6("cohort_excess").alias("cohort_excess"))


_CARD = ["win_rate", "avg_return", "median_return", "avg_excess_return", "beat_rate"]


@query(
    "scorecard",
    "A13 Q7",
    f"""SELECT model_version, CAST(horizon AS INTEGER) AS horizon, count(*) AS evaluated, {rnd('avg(CAST(correct_direction AS DOUBLE))')} AS win_rate, {rnd('avg(actual_return)')} AS avg_return,
  {rnd('median(actual_return)')} AS median_return, {rnd('avg(excess_return)')} AS avg_excess_return, {rnd('avg(CAST(excess_return > 0 AS DOUBLE))')} AS beat_rate
FROM matured WHERE actual_return IS NOT NULL GROUP BY GROUPING SETS ((), (horizon), (model_version), (model_version, horizon))""",
)
def scorecard(t: Tables) -> DataFrame:
    c = E.scorecard(matured(t).where(F.col("actual_return").isNotNull()))
    return c.select("model_version", "horizon", "evaluated", *[r6(x).alias(x) for x in _CARD])


def weekly(t: Tables) -> DataFrame:
    """Weekly cohorts of both variants at the 5-session horizon against the equal-weight screen of all entities."""
    o = outcomes(t).where("horizon = 5").select("model_version", "session_no", "signal_date", F.col("expected_picks").alias("picks"), F.when(F.col("cash"), 0.0).otherwise(F.col("cohort_return") + E.ROUND_TRIP_COST).alias("model_return"))
    every = t.panel.select("entity_id", "session_no").withColumn("horizon", F.lit(5)).where(F.col("session_no") % 4 == 1)
    m = E.mature(E.execute(every, t.calendar, t.panel), t.benchmark_panel)
    screen = m.groupBy("session_no").agg(F.avg("gross_return").alias("screen_return"), F.max("benchmark_return").alias("benchmark_return"))
    return t.shared("weekly_cohorts", o.join(screen, "session_no").where(F.col("screen_return").isNotNull() & F.col("benchmark_return").isNotNull()))


cte(
    "weekly_cohorts",
    """SELECT o.model_version, o.session_no, o.signal_date, o.expected_picks AS picks, CASE WHEN o.cash THEN 0 ELSE o.cohort_return + 0.002 END AS model_return, s.screen_return, s.benchmark_return
FROM cohort_outcomes o JOIN (SELECT e.session_no - 1 AS session_no, avg(x.close / e.close - 1) AS screen_return, max(xb.close / eb.close - 1) AS benchmark_return
  FROM panel a JOIN panel e ON e.entity_id = a.entity_id AND e.session_no = a.session_no + 1 AND a.entity_id >= 0 JOIN panel x ON x.entity_id = e.entity_id AND x.session_no = e.session_no + 5
  JOIN panel eb ON eb.entity_id = -1 AND eb.session_no = e.session_no JOIN panel xb ON xb.entity_id = -1 AND xb.session_no = x.session_no GROUP BY 1) s USING (session_no)
WHERE horizon = 5""",
)
_NET = "model_return - CASE WHEN picks > 0 THEN 0.002 ELSE 0 END"
_SUMMARY = ["mean_net_return", "mean_excess", "mean_improvement_vs_screen", "stress_mean_excess", "beat_rate", "loss_rate", "worst", "worst_fifth_mean", "screen_worst_fifth_mean"]


@query(
    "weekly_summary",
    "A14 A15 A17",
    f"""WITH w AS (SELECT *, {_NET} AS net, row_number() OVER (PARTITION BY model_version ORDER BY {_NET}) AS rn, row_number() OVER (PARTITION BY model_version ORDER BY screen_return) AS rs, count(*) OVER (PARTITION BY model_version) AS n FROM weekly_cohorts)
SELECT model_version, count(*) AS cohorts, CAST(sum(picks) AS BIGINT) AS picks, {rnd('avg(net)')} AS mean_net_return, {rnd('avg(net - benchmark_return)')} AS mean_excess, {rnd('avg(net - (screen_return - 0.002))')} AS mean_improvement_vs_screen,
  {rnd('avg(model_return - CASE WHEN picks > 0 THEN 0.005 ELSE 0 END - benchmark_return)')} AS stress_mean_excess, {rnd('avg(CAST(net - benchmark_return > 0 AS DOUBLE))')} AS beat_rate, {rnd('avg(CAST(net < 0 AS DOUBLE))')} AS loss_rate,
  {rnd('min(net)')} AS worst, {rnd('avg(net) FILTER (WHERE rn <= greatest(1, (n + 4) // 5))')} AS worst_fifth_mean, {rnd('avg(screen_return - 0.002) FILTER (WHERE rs <= greatest(1, (n + 4) // 5))')} AS screen_worst_fifth_mean FROM w GROUP BY 1""",
)
def weekly_summary(t: Tables) -> DataFrame:
    return E.summarize_cohorts(weekly(t), ["model_version"]).select("model_version", "cohorts", "picks", *[r6(c).alias(c) for c in _SUMMARY])


@query(
    "block_bootstrap",
    "A16 D3",
    f"""WITH v AS (SELECT model_version, row_number() OVER (PARTITION BY model_version ORDER BY session_no) - 1 AS pos, {_NET} - benchmark_return AS x FROM weekly_cohorts), n AS (SELECT model_version, count(*) AS n FROM v GROUP BY 1),
d AS (SELECT model_version, rep, k, i, CAST('0x' || substr(md5(rep || '|' || k), 1, 8) AS BIGINT) % n AS s, n FROM n, range(1000) r(rep), LATERAL (SELECT unnest(range(0, CAST(ceil(n / 4.0) AS BIGINT))) AS k) b, range(4) j(i)),
m AS (SELECT d.model_version, rep, avg(x) AS m FROM d JOIN v ON v.model_version = d.model_version AND v.pos = (d.s + d.i) % d.n WHERE k * 4 + i < n GROUP BY 1, 2)
SELECT model_version, {rnd('m')} AS lower_bound FROM (SELECT model_version, m, row_number() OVER (PARTITION BY model_version ORDER BY m) AS r FROM m) WHERE r = 51""",
)
def block_bootstrap(t: Tables) -> DataFrame:
    w = weekly(t)
    x = F.col("model_return") - F.when(F.col("picks") > 0, E.ROUND_TRIP_COST).otherwise(0.0) - F.col("benchmark_return")
    pos = F.row_number().over(Window.partitionBy("model_version").orderBy("session_no")) - 1
    v = w.select("model_version", pos.cast("long").alias("pos"), x.alias("x"))
    return E.lower_bounds(v, ["model_version"], {"lower_bound": "x"}, "pos").select("model_version", r6("lower_bound").alias("lower_bound"))


#: The worst tenth of a pick's five sessions, as its volatility at the signal says; the normal law's tenth is a fixed value.
_P10 = 1.2815515655446004 * math.sqrt(5 / 252)
#: Weeks that the gate asks for are fewer here than its default of 26: a fifth of the tables' weeks has to do.
_GATE_WEEKS = 10


def validation_report(t: Tables) -> DataFrame:
    """The gate's figures of both variants on the middle and the last fifth of the weeks; weeks of the middle whose exit falls into the last are left out."""
    weeks = t.calendar.join(cohort_list(t).select("session_no").distinct(), "session_no").select("session_no")
    periods = M.period_of("session_no", M.sample_dates(weeks))
    held_from = periods.where("period = 'holdout'").agg(F.min("session_no")).scalar()
    use = periods.where((F.col("period") == "holdout") | ((F.col("period") == "selection") & (F.col("session_no") + 6 < held_from)))
    by = ["model_version", "period"]
    tried = cohort_list(t).join(F.broadcast(use), "session_no").groupBy(*by).agg(F.count("*").alias("attempted"))
    fell = (F.col("actual_return") < -_P10 * F.col("volatility_20")).cast("double")
    breach = matured(t).where("horizon = 5 AND actual_return IS NOT NULL").join(F.broadcast(use), "session_no").groupBy(*by).agg(F.avg(fell).alias("breach_rate"))
    return t.shared("validation_report", E.period_report(weekly(t).join(F.broadcast(use), "session_no"), tried, breach, by, min_weeks=_GATE_WEEKS))


_GATED = ["mean_net_return", "mean_excess", "mean_improvement_vs_screen", "stress_mean_excess", "lower_bound_vs_benchmark", "lower_bound_vs_screen", "worst_fifth_mean", "screen_worst_fifth_mean", "breach_rate", "evaluation_coverage"]
cte(
    "validation_report",
    f"""WITH wk AS (SELECT session_no, row_number() OVER (ORDER BY session_no) - 1 AS position, count(*) OVER () AS dates FROM (SELECT DISTINCT session_no FROM cohort_list)),
pd AS (SELECT session_no, CASE WHEN position < floor(dates * 0.6) THEN 'train' WHEN position < floor(dates * 0.8) THEN 'selection' ELSE 'holdout' END AS period FROM wk),
use AS (SELECT * FROM pd WHERE period = 'holdout' OR (period = 'selection' AND session_no + 6 < (SELECT min(session_no) FROM pd WHERE period = 'holdout'))),
w AS (SELECT *, row_number() OVER (PARTITION BY model_version, period ORDER BY net) AS rn, row_number() OVER (PARTITION BY model_version, period ORDER BY screen_return) AS rs, row_number() OVER (PARTITION BY model_version, period ORDER BY session_no) - 1 AS pos, count(*) OVER (PARTITION BY model_version, period) AS n
  FROM (SELECT *, {_NET} AS net FROM weekly_cohorts JOIN use USING (session_no))),
s AS (SELECT model_version, period, count(*) AS cohorts, avg(net) AS mean_net_return, avg(net - benchmark_return) AS mean_excess, avg(net - (screen_return - 0.002)) AS mean_improvement_vs_screen,
  avg(model_return - CASE WHEN picks > 0 THEN 0.005 ELSE 0 END - benchmark_return) AS stress_mean_excess, avg(net) FILTER (WHERE rn <= greatest(1, (n + 4) // 5)) AS worst_fifth_mean, avg(screen_return - 0.002) FILTER (WHERE rs <= greatest(1, (n + 4) // 5)) AS screen_worst_fifth_mean FROM w GROUP BY 1, 2),
d AS (SELECT model_version, period, rep, k, i, CAST('0x' || substr(md5(rep || '|' || k), 1, 8) AS BIGINT) % cohorts AS st, cohorts FROM s, range(1000) r(rep), LATERAL (SELECT unnest(range(0, CAST(ceil(cohorts / 4.0) AS BIGINT))) AS k) b, range(4) j(i)),
m AS (SELECT d.model_version, d.period, rep, avg(net - benchmark_return) AS mb, avg(net - (screen_return - 0.002)) AS ms FROM d JOIN w ON w.model_version = d.model_version AND w.period = d.period AND w.pos = (d.st + d.i) % d.cohorts WHERE k * 4 + i < d.cohorts GROUP BY 1, 2, 3),
b AS (SELECT model_version, period, list_sort(list(mb))[51] AS lower_bound_vs_benchmark, list_sort(list(ms))[51] AS lower_bound_vs_screen FROM m GROUP BY 1, 2),
t AS (SELECT model_version, period, count(*) AS attempted FROM cohort_list JOIN use USING (session_no) GROUP BY 1, 2),
f AS (SELECT model_version, period, avg(CAST(actual_return < -{_P10!r} * volatility_20 AS DOUBLE)) AS breach_rate FROM matured JOIN use USING (session_no) WHERE horizon = 5 AND actual_return IS NOT NULL GROUP BY 1, 2),
a AS (SELECT *, cohorts / CAST(attempted AS DOUBLE) AS evaluation_coverage FROM s JOIN b USING (model_version, period) LEFT JOIN t USING (model_version, period) LEFT JOIN f USING (model_version, period))
SELECT *, coalesce(cohorts >= {_GATE_WEEKS} AND evaluation_coverage >= 0.95 AND mean_net_return > 0 AND mean_excess > 0 AND mean_improvement_vs_screen > 0 AND stress_mean_excess > 0 AND lower_bound_vs_benchmark > 0 AND lower_bound_vs_screen > 0
  AND worst_fifth_mean >= screen_worst_fifth_mean AND breach_rate BETWEEN 0.05 AND 0.20, false) AS passes FROM a""",
)


@query("period_gate", "P16 M10 A16", f"SELECT model_version, period, cohorts, {', '.join(f'{rnd(c)} AS {c}' for c in _GATED)}, passes FROM validation_report")
def period_gate(t: Tables) -> DataFrame:
    return validation_report(t).select("model_version", "period", "cohorts", *[r6(c).alias(c) for c in _GATED], "passes")


@query(
    "variant_choice",
    "M10 P16",
    f"""WITH c AS (SELECT model_version, passes AS selection_passes FROM validation_report WHERE period = 'selection' ORDER BY passes DESC, mean_improvement_vs_screen DESC NULLS LAST, model_version LIMIT 1)
SELECT c.model_version, selection_passes, coalesce(h.passes, false) AS holdout_passes, selection_passes AND coalesce(h.passes, false) AS validated, {rnd('h.mean_improvement_vs_screen')} AS holdout_improvement
FROM c LEFT JOIN (SELECT * FROM validation_report WHERE period = 'holdout') h USING (model_version)""",
)
def variant_choice(t: Tables) -> DataFrame:
    return E.selected_variant(validation_report(t)).withColumn("holdout_improvement", r6("holdout_improvement"))


@query(
    "return_quantiles",
    "A25 D4",
    f"""WITH s AS (SELECT model_version, CAST(horizon AS INTEGER) AS horizon, actual_return AS x, row_number() OVER (PARTITION BY model_version, horizon ORDER BY actual_return) AS r, count(*) OVER (PARTITION BY model_version, horizon) AS n FROM matured WHERE actual_return IS NOT NULL),
p AS (SELECT *, greatest(1, least(n - 1, CAST(floor(0.1 * (n + 1)) AS BIGINT))) AS lo10, 0.1 * (n + 1) AS p10, greatest(1, least(n - 1, CAST(floor(0.9 * (n + 1)) AS BIGINT))) AS lo90, 0.9 * (n + 1) AS p90 FROM s)
SELECT model_version, horizon, max(n) AS n, {rnd('max(x) FILTER (WHERE r = lo10) + (max(x) FILTER (WHERE r = lo10 + 1) - max(x) FILTER (WHERE r = lo10)) * max(CAST(p10 - lo10 AS DOUBLE))')} AS p10,
  {rnd('max(x) FILTER (WHERE r = lo90) + (max(x) FILTER (WHERE r = lo90 + 1) - max(x) FILTER (WHERE r = lo90)) * max(CAST(p90 - lo90 AS DOUBLE))')} AS p90 FROM p GROUP BY 1, 2""",
)
def return_quantiles(t: Tables) -> DataFrame:
    q = quantiles(matured(t), ["model_version", "horizon"], "actual_return", {"p10": 0.1, "p90": 0.9}, exclusive=True)
    return q.select("model_version", "horizon", "n", r6("p10").alias("p10"), r6("p90").alias("p90"))


_PAIRS_SQL = f"""WITH pairs AS (SELECT session_no, max(cohort_return) FILTER (WHERE model_version = 'momentum') AS a, max(cohort_return) FILTER (WHERE model_version = 'reversal') AS b, horizon FROM cohort_outcomes WHERE NOT cash GROUP BY session_no, horizon)
SELECT CAST(horizon AS INTEGER) AS horizon, count(*) AS weeks, {rnd('avg(a)')} AS mean_a, {rnd('avg(b)')} AS mean_b, {rnd('avg(b - a)')} AS paired_difference FROM pairs WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1"""


@query("paired_variants", "A17", _PAIRS_SQL)
def paired_variants(t: Tables) -> DataFrame:
    o = outcomes(t).where("not cash")
    p = o.groupBy("session_no", "horizon").pivot("model_version", ["momentum", "reversal"]).agg(F.max("cohort_return"))
    p = p.where(F.col("momentum").isNotNull() & F.col("reversal").isNotNull())
    return p.groupBy("horizon").agg(
        F.count("*").alias("weeks"), r6(F.avg("momentum")).alias("mean_a"), r6(F.avg("reversal")).alias("mean_b"), r6(F.avg(F.col("reversal") - F.col("momentum"))).alias("paired_difference")
    )


@query(
    "earlier_and_holdout",
    "A40",
    f"""WITH d AS (SELECT *, row_number() OVER (ORDER BY session_no) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT session_no FROM cohort_outcomes)),
p AS (SELECT o.*, CASE WHEN r <= CAST(floor(n * 0.8) AS BIGINT) THEN 'earlier' ELSE 'holdout' END AS period FROM cohort_outcomes o JOIN d USING (session_no))
SELECT model_version, CAST(horizon AS INTEGER) AS horizon, period, count(*) AS cohorts, {rnd('avg(cohort_excess)')} AS mean_excess FROM p GROUP BY 1, 2, 3""",
)
def earlier_and_holdout(t: Tables) -> DataFrame:
    o = outcomes(t)
    # Distinct signal sessions: bounded by the calendar.
    d = o.select("session_no").distinct().withColumn("r", F.row_number().over(Window.orderBy("session_no")))
    n = d.agg(F.max("r")).scalar()
    period = F.when(F.col("r") <= F.floor(n * 0.8), "earlier").otherwise("holdout")
    p = o.join(F.broadcast(d.withColumn("period", period)), "session_no")
    return p.groupBy("model_version", "horizon", "period").agg(F.count("*").alias("cohorts"), r6(F.avg("cohort_excess")).alias("mean_excess"))


@query(
    "selection_coverage",
    "A39",
    f"""SELECT model_version, CAST(horizon AS INTEGER) AS horizon, count(*) AS attempted, count(*) FILTER (WHERE o.session_no IS NOT NULL) AS evaluated, count(*) FILTER (WHERE o.session_no IS NULL) AS excluded,
  {rnd('count(o.session_no) / CAST(count(*) AS DOUBLE)')} AS coverage FROM (SELECT *, unnest([5, 10, 20]) AS horizon FROM cohort_list) c LEFT JOIN cohort_outcomes o USING (model_version, session_no, horizon) GROUP BY 1, 2""",
)
def selection_coverage(t: Tables) -> DataFrame:
    asks = cohort_list(t).withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in HORIZONS])))
    done = outcomes(t).select(*SIGNAL, "horizon", F.lit(1).alias("ok"))
    j = asks.join(done, [*SIGNAL, "horizon"], "left")
    return j.groupBy("model_version", "horizon").agg(
        F.count("*").alias("attempted"), F.count("ok").alias("evaluated"), F.count_if(F.col("ok").isNull()).alias("excluded"), r6(F.count("ok") / F.count("*")).alias("coverage")
    )


SCENARIOS = {"base": 0.002, "stress": 0.005}


def picks(t: Tables) -> DataFrame:
    """Equal weights, held from the session after the signal for ten sessions; cohorts that end later are left out."""
    s = selections(t).withColumn("weight", F.lit(1.0) / F.count("*").over(Window.partitionBy(*SIGNAL)))
    last = t.calendar.agg(F.max("session_no")).scalar()
    return s.select("model_version", F.col("session_no").alias("signal_no"), "entity_id", "weight", (F.col("session_no") + 1).alias("entry_no"), (F.col("session_no") + 11).alias("exit_no")).where(F.col("exit_no") <= last)


def paths(t: Tables) -> DataFrame:
    return t.shared("paths", E.cohort_paths(picks(t), t.calendar, t.panel, t.benchmark_panel, SCENARIOS, ["model_version", "signal_no"]))


cte(
    "paths",
    """WITH p AS (SELECT model_version, session_no AS signal_no, entity_id, 1.0 / count(*) OVER (PARTITION BY model_version, session_no) AS weight FROM selections WHERE session_no + 11 <= (SELECT max(session_no) FROM calendar)),
held AS (SELECT p.*, c.session_no, c.session_date, m.close AS px, e.close AS entry FROM p JOIN calendar c ON c.session_no BETWEEN p.signal_no + 1 AND p.signal_no + 11
  LEFT JOIN panel m ON m.entity_id = p.entity_id AND m.session_no = c.session_no LEFT JOIN panel e ON e.entity_id = p.entity_id AND e.session_no = p.signal_no + 1),
daily AS (SELECT model_version, signal_no, session_no, session_date, sum(weight * px / entry) AS gross, sum(weight) AS invested, count(*) FILTER (WHERE px IS NULL OR entry IS NULL) AS missing FROM held GROUP BY 1, 2, 3, 4),
live AS (SELECT * FROM (SELECT *, sum(missing) OVER (PARTITION BY model_version, signal_no ORDER BY session_no) AS bad FROM daily) WHERE bad = 0)
SELECT l.model_version, l.signal_no, s.scenario, l.session_no, l.session_date, (gross / (1 + s.cost / 2) * CASE WHEN l.session_no = signal_no + 11 THEN 1 - s.cost / 2 ELSE 1 END + 1 - invested) * 10000 AS equity,
  b.close / b0.close / (1 + s.cost / 2) * 10000 AS benchmark_equity
FROM live l JOIN panel b ON b.entity_id = -1 AND b.session_no = l.session_no JOIN panel b0 ON b0.entity_id = -1 AND b0.session_no = signal_no + 1,
  (VALUES ('base', CAST(0.002 AS DOUBLE)), ('stress', CAST(0.005 AS DOUBLE))) s(scenario, cost)""",
)


@query(
    "cohort_value_paths",
    "V1 V2 V3 V4 J34",
    f"SELECT model_version, signal_no, scenario, session_date, {rnd('equity', 4)} AS equity, {rnd('benchmark_equity', 4)} AS benchmark_equity FROM paths",
)
def cohort_value_paths(t: Tables) -> DataFrame:
    return paths(t).select("model_version", "signal_no", "scenario", "session_date", r4("equity").alias("equity"), r4("benchmark_equity").alias("benchmark_equity"))


def actions(t: Tables) -> DataFrame:
    """A quarter of the earnings per share of each reported quarter is paid out when it is filed; a sixth of the entities split in two, and one dividend has no amount."""
    q = t.quarter_statements
    unknown = (F.col("entity_id") % 8 == 5) & (F.col("period_end") == F.lit("1996-06-30").cast("date"))
    paid = q.select("entity_id", F.lit("dividend").alias("kind"), F.col("filed_date").alias("event_date"), F.when(~unknown, F.floor(F.col("eps_diluted") * 25 + 0.5) / 100).alias("amount"))
    cut = q.where((F.col("entity_id") % 6 == 1) & (F.col("period_end") == F.lit("1994-09-30").cast("date")))
    return paid.unionByName(cut.select("entity_id", F.lit("split").alias("kind"), F.col("period_end").alias("event_date"), F.lit(2.0).alias("amount")))


def based_panel(t: Tables) -> DataFrame:
    return t.shared("based_panel", R.return_bases(t.panel, actions(t)))


def based_benchmark(t: Tables) -> DataFrame:
    """The benchmark pays nothing out, so its bases are alike."""
    return t.benchmark_panel.withColumn("basis", F.explode(F.array(*[F.lit(b) for b in R.BASES])))


cte(
    "based_panel",
    """WITH a AS (SELECT entity_id, 'dividend' AS kind, filed_date AS event_date, CASE WHEN entity_id % 8 <> 5 OR period_end <> DATE '1996-06-30' THEN floor(eps_diluted * 25 + 0.5) / 100 END AS amount FROM quarter_statements
  UNION ALL SELECT entity_id, 'split', period_end, 2.0 FROM quarter_statements WHERE entity_id % 6 = 1 AND period_end = DATE '1994-09-30'),
due AS (SELECT a.*, (SELECT min(p.session_no) FROM panel p WHERE p.entity_id = a.entity_id AND p.session_date >= a.event_date) AS session_no FROM a),
f AS (SELECT entity_id, session_no, coalesce(product(CASE WHEN kind = 'split' THEN amount END), 1) AS split, coalesce(sum(CASE WHEN kind = 'dividend' AND amount >= 0 THEN amount END), 0) AS cash,
  count(*) FILTER (WHERE NOT coalesce(amount >= 0, false)) AS unknown FROM due WHERE session_no IS NOT NULL GROUP BY 1, 2),
r AS (SELECT p.*, product(coalesce(split, 1)) OVER w AS split, product(coalesce(split, 1) * (1 + coalesce(cash, 0) / close)) OVER w AS total, sum(coalesce(unknown, 0)) OVER w AS unknown
  FROM panel p LEFT JOIN f USING (entity_id, session_no) WHERE p.entity_id >= 0 WINDOW w AS (PARTITION BY p.entity_id ORDER BY p.session_no))
SELECT entity_id, session_date, session_no, 'price' AS basis, close * split AS close FROM r UNION ALL SELECT entity_id, session_date, session_no, 'total', CASE WHEN unknown = 0 THEN close * total END FROM r""",
)


@query("return_bases", "V8 S21", f"SELECT entity_id, session_date, basis, {rnd('close', 4)} AS close FROM based_panel")
def return_bases(t: Tables) -> DataFrame:
    return based_panel(t).select("entity_id", "session_date", "basis", r4("close").alias("close"))


@query("series_gaps", "V8", "SELECT entity_id, basis, count(*) AS missing FROM based_panel WHERE close IS NULL GROUP BY 1, 2")
def series_gaps(t: Tables) -> DataFrame:
    return R.missing_required(based_panel(t), t.panel)


@query(
    "cohort_value_by_basis",
    "V8 V1",
    f"""WITH p AS (SELECT model_version, session_no AS signal_no, entity_id, 1.0 / count(*) OVER (PARTITION BY model_version, session_no) AS weight FROM selections WHERE session_no + 11 <= (SELECT max(session_no) FROM calendar)),
held AS (SELECT p.*, b.basis, c.session_no, c.session_date, m.close AS px, e.close AS entry FROM p JOIN calendar c ON c.session_no BETWEEN p.signal_no + 1 AND p.signal_no + 11 CROSS JOIN (VALUES ('price'), ('total')) b(basis)
  LEFT JOIN based_panel m ON m.entity_id = p.entity_id AND m.session_no = c.session_no AND m.basis = b.basis LEFT JOIN based_panel e ON e.entity_id = p.entity_id AND e.session_no = p.signal_no + 1 AND e.basis = b.basis),
daily AS (SELECT model_version, signal_no, basis, session_no, session_date, sum(weight * px / entry) AS gross, sum(weight) AS invested, count(*) FILTER (WHERE px IS NULL OR entry IS NULL) AS missing FROM held GROUP BY ALL),
live AS (SELECT * FROM (SELECT *, sum(missing) OVER (PARTITION BY model_version, signal_no, basis ORDER BY session_no) AS bad FROM daily) WHERE bad = 0)
SELECT model_version, signal_no, basis, s.scenario, session_date, {rnd("(gross / (1 + s.cost / 2) * CASE WHEN session_no = signal_no + 11 THEN 1 - s.cost / 2 ELSE 1 END + 1 - invested) * 10000", 4)} AS equity
FROM live, (VALUES ('base', CAST(0.002 AS DOUBLE)), ('stress', CAST(0.005 AS DOUBLE))) s(scenario, cost)""",
)
def cohort_value_by_basis(t: Tables) -> DataFrame:
    curves = E.cohort_paths(picks(t), t.calendar, based_panel(t), based_benchmark(t), SCENARIOS, ["model_version", "signal_no"], bases=R.BASES)
    return curves.select("model_version", "signal_no", "basis", "scenario", "session_date", r4("equity").alias("equity"))


@query(
    "curve_metrics",
    "A26 W15 W16 Q9",
    f"""WITH c AS (SELECT *, least(0, equity / greatest(10000, max(equity) OVER w) - 1) AS dd, equity / lag(equity) OVER w - benchmark_equity / lag(benchmark_equity) OVER w AS x FROM paths WINDOW w AS (PARTITION BY model_version, signal_no, scenario ORDER BY session_no))
SELECT model_version, signal_no, scenario, count(*) AS sessions, {rnd('arg_max(equity, session_no) / 10000 - 1')} AS cumulative_return, {rnd('(arg_max(equity, session_no) - arg_max(benchmark_equity, session_no)) / 10000')} AS excess_return, {rnd('min(dd)')} AS max_drawdown FROM c GROUP BY 1, 2, 3""",
)
def curve_metrics(t: Tables) -> DataFrame:
    m = E.curve_metrics(paths(t), ["model_version", "signal_no", "scenario"], "session_no", "equity", "benchmark_equity", "session_date")
    return m.select("model_version", "signal_no", "scenario", "sessions", *[r6(c).alias(c) for c in ("cumulative_return", "excess_return", "max_drawdown")])


@query(
    "benchmark_curve",
    "A26 W15",
    f"""WITH c AS (SELECT p.session_no, p.session_date, p.close / f.close * 10000 AS equity FROM panel p, (SELECT close FROM panel WHERE entity_id = -1 AND session_no = 1) f WHERE p.entity_id = -1),
d AS (SELECT *, equity / greatest(10000, max(equity) OVER w) - 1 AS dd, equity / lag(equity) OVER w - 1 AS ret FROM c WINDOW w AS (ORDER BY session_no))
SELECT {rnd('min(least(0, dd))')} AS max_drawdown, {rnd('stddev_samp(ret) * sqrt(252)', 4)} AS tracking_error, {rnd('pow(arg_max(equity, session_no) / 10000, 365.25 / (max(session_date) - min(session_date))) - 1')} AS annualized_return FROM d""",
)
def benchmark_curve(t: Tables) -> DataFrame:
    b = t.benchmark_panel
    first = b.where("session_no = 1").agg(F.max("close")).scalar()
    c = b.select(F.lit(1).alias("curve"), "session_no", "session_date", (F.col("close") / first * 10000).alias("equity"), F.lit(10000.0).alias("flat"))
    m = E.curve_metrics(c, ["curve"], "session_no", "equity", "flat", "session_date")
    return m.select(r6("max_drawdown").alias("max_drawdown"), r4("tracking_error").alias("tracking_error"), r6("annualized_return").alias("annualized_return"))


@query(
    "non_overlapping_marks",
    "W17",
    "WITH n AS (SELECT *, row_number() OVER w AS rn, lead(session_no) OVER w IS NULL AS fin FROM paths WINDOW w AS (PARTITION BY model_version, signal_no, scenario ORDER BY session_no)) SELECT model_version, signal_no, scenario, session_date FROM n WHERE rn % 5 = 1 OR fin",
)
def non_overlapping_marks(t: Tables) -> DataFrame:
    return E.non_overlapping(paths(t), ["model_version", "signal_no", "scenario"], "session_no").select("model_version", "signal_no", "scenario", "session_date")


@query(
    "capped_weights",
    "A27 V5 V7",
    f"""WITH r AS (SELECT *, 1.0 / CASE WHEN volatility_20 > 0 THEN volatility_20 END AS raw FROM selections), w AS (SELECT *, CASE WHEN count(raw) OVER c = count(*) OVER c THEN raw / sum(raw) OVER c END AS w FROM r WINDOW c AS (PARTITION BY model_version, session_no))
SELECT model_version, signal_date, entity_id, {rnd('w * least(1, 0.4 / sum(w) OVER (PARTITION BY model_version, session_no, sector))')} AS weight FROM w""",
)
def capped_weights(t: Tables) -> DataFrame:
    w = E.capped_weights(selections(t), SIGNAL, "inverse_volatility")
    return w.select("model_version", "signal_date", "entity_id", r6("weight").alias("weight"))


@query(
    "position_marks",
    "V5",
    f"""WITH h AS (SELECT model_version, s.entity_id, s.sector, count(*) * 10.0 AS shares FROM selections s GROUP BY 1, 2, 3), l AS (SELECT entity_id, arg_max(close, session_no) AS close FROM panel GROUP BY 1),
v AS (SELECT h.*, l.close, shares * close AS value FROM h LEFT JOIN l USING (entity_id)), w AS (SELECT *, value / sum(value) OVER (PARTITION BY model_version) AS weight, sum(value) OVER (PARTITION BY model_version, sector) / sum(value) OVER (PARTITION BY model_version) AS sector_weight FROM v)
SELECT model_version, entity_id, {rnd('weight')} AS weight, {rnd('sector_weight')} AS sector_weight, CASE WHEN close IS NULL THEN 'price_missing' WHEN weight > 0.06 THEN 'position_concentration' WHEN sector_weight > 0.25 THEN 'sector_concentration' END AS alert FROM w""",
)
def position_marks(t: Tables) -> DataFrame:
    held = selections(t).groupBy("model_version", "entity_id", "sector").agg((F.count("*") * 10.0).alias("shares"))
    last = t.panel.groupBy("entity_id").agg(F.max_by("close", "session_no").alias("close"))
    m = E.position_marks(held, last, ["model_version"], 0.06, 0.25)
    return m.select("model_version", "entity_id", r6("weight").alias("weight"), r6("sector_weight").alias("sector_weight"), "alert")


@query(
    "complete_sessions",
    "A41",
    "SELECT session_date FROM daily_bars WHERE entity_id IN (0, 1, 2) GROUP BY 1 HAVING count(DISTINCT entity_id) = 3" .replace("entity_id IN (0, 1, 2)", "entity_id IN (SELECT entity_id FROM daily_bars GROUP BY 1 ORDER BY count(DISTINCT session_date) DESC, entity_id LIMIT 3)"),
)
def complete_sessions(t: Tables) -> DataFrame:
    busiest = t.daily_bars.groupBy("entity_id").agg(F.countDistinct("session_date").alias("n")).orderBy(F.desc("n"), "entity_id").limit(3)
    return E.complete_sessions(t.daily_bars, busiest, 3)


@query(
    "entry_after_publication",
    "J22",
    """SELECT model_version, signal_date, (SELECT min(session_date) FROM calendar k WHERE k.session_date > c.signal_date AND CAST(k.session_date AS TIMESTAMP) + INTERVAL 21 HOUR > CAST(c.signal_date AS TIMESTAMP) + INTERVAL (c.session_no % 11) DAY) AS entry_date FROM cohort_list c""",
)
def entry_after_publication(t: Tables) -> DataFrame:
    c = cohort_list(t).withColumn("published_at", F.col("signal_date").cast("timestamp_ntz") + F.expr("make_dt_interval(cast(session_no % 11 as int))"))
    k = t.calendar.withColumn("close_at", F.col("session_date").cast("timestamp_ntz") + F.expr("interval 21 hours"))
    return E.entry_after_publication(c, k, "close_at", "session_date").select("model_version", "signal_date", "entry_date")


@query(
    "pair_correlation",
    "J35 U6",
    f"""WITH r AS (SELECT entity_id, session_no, return_1 FROM features WHERE return_1 IS NOT NULL), c AS (SELECT a.entity_id AS left_id, b.entity_id AS right_id, a.session_no, a.return_1 AS x, b.return_1 AS y,
  row_number() OVER (PARTITION BY a.entity_id, b.entity_id ORDER BY a.session_no DESC) AS k FROM r a JOIN r b ON a.session_no = b.session_no AND a.entity_id < b.entity_id
  WHERE a.entity_id IN (SELECT entity_id FROM selections WHERE session_no = (SELECT max(session_no) FROM selections)) AND b.entity_id IN (SELECT entity_id FROM selections WHERE session_no = (SELECT max(session_no) FROM selections)))
SELECT left_id, right_id, count(*) AS n, {rnd('corr(x, y)')} AS correlation FROM c WHERE k <= 60 GROUP BY 1, 2 HAVING count(*) >= 40""",
)
def pair_correlation(t: Tables) -> DataFrame:
    """Correlation among the newest picks; only their own pairs are formed, at most ten entities."""
    s = selections(t)
    newest = s.where(F.col("session_no") == s.agg(F.max("session_no")).scalar()).select("entity_id").distinct()
    r = t.features.where(F.col("return_1").isNotNull()).join(newest, "entity_id", "left_semi").select("entity_id", "session_no", "return_1")
    a = r.select(F.col("entity_id").alias("left_id"), "session_no", F.col("return_1").alias("x"))
    b = r.select(F.col("entity_id").alias("right_id"), "session_no", F.col("return_1").alias("y"))
    p = a.join(b, "session_no").where(F.col("left_id") < F.col("right_id"))
    p = p.withColumn("k", F.row_number().over(Window.partitionBy("left_id", "right_id").orderBy(F.col("session_no").desc()))).where("k <= 60")
    out = p.groupBy("left_id", "right_id").agg(F.count("*").alias("n"), F.corr("x", "y").alias("c")).where("n >= 40")
    return out.select("left_id", "right_id", "n", r6("c").alias("correlation"))
