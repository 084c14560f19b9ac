"""Small score and status helpers."""

import datetime as dt

from pyspark.sql import functions as F

from tidemark.operators import audit as U
from tidemark.operators import calendar as C
from tidemark.operators import scores as S

D, TS = dt.date, dt.datetime


def test_projection_and_provider_months(spark):
    df = spark.createDataFrame([([D(2024, 6, 1)], "0m"), ([D(2024, 6, 1), D(2024, 7, 1)], "-2m"), ([D(2026, 1, 1)], "+1m"), ([D(2023, 1, 1)], "-4m")], "ds array<date>, label string")
    today = F.lit("2024-03-15").cast("date")
    got = [tuple(r) for r in df.select(S.projected_date(F.col("ds"), today), S.provider_month(today, F.col("label"))).collect()]
    assert got == [(D(2024, 6, 1), D(2024, 3, 1)), (None, D(2024, 1, 1)), (None, None), (None, None)]


def test_event_signals_use_the_known_bound(spark):
    cols = [f"{p}{m}_guidance_{b}" for m in ("eps", "revenue") for p in ("", "previous_") for b in ("low", "high")] + ["consensus_eps_at_event", "consensus_revenue_at_event"]
    row = {c: None for c in cols} | {"eps_guidance_low": 2.0, "eps_guidance_high": 4.0, "previous_eps_guidance_low": -2.0, "consensus_eps_at_event": 2.0}
    df = spark.createDataFrame([tuple(row[c] for c in cols)], ", ".join(f"{c} double" for c in cols))
    out = df.select(*[v.alias(k) for k, v in S.event_signals().items()]).first()
    assert out["guidance_eps_vs_consensus"] == 0.5 and out["eps_guidance_change"] == 2.5 and out["revenue_guidance_change"] is None


def test_missing_change_is_no_change_score(spark):
    df = spark.createDataFrame([(None, 10.0, 60.0)], "now double, old double, f double")
    none = F.lit(None).cast("double")
    score, cover = S.research_priority(F.col("f"), none, F.col("now"), F.col("old"), none, none)
    assert df.select(score, cover).first() == (20.0, 25.0)


def test_latest_completed_session_waits_for_the_close(spark):
    cal = C.exchange_sessions(spark, "2024-07-01", "2024-07-10")
    at = lambda ts: C.latest_completed_session(cal, F.lit(ts).cast("timestamp_ntz")).first()["session_date"]
    assert at("2024-07-03 16:59:00") == D(2024, 7, 2) and at("2024-07-03 17:00:00") == D(2024, 7, 3) and at("2024-07-05 10:00:00") == D(2024, 7, 3)


def test_coverage_of_all_families_from_little_knowledge(spark):
    day, clock = D(2024, 5, 3), F.lit("2024-05-03 21:00:00").cast("timestamp_ntz")
    nothing = U.entity_coverage(spark.createDataFrame([(1,)], "entity_id int"), clock, F.lit(day))
    assert {r.family: r.status for r in nothing.collect()} == dict.fromkeys(U.FAMILIES, "missing") | dict.fromkeys(("upcoming", "disclosures", "news", "guidance"), "unknown") | dict.fromkeys(("calls", "ownership", "macro"), "not_collected")
    kind = "entity_id int, price_date date, feature_date date, audit_status string, audit_at timestamp_ntz, missing_fields int, statements int, analysts int, analyst_at timestamp_ntz, eps_periods int, revenue_periods int, inconsistent_periods int, estimates_at timestamp_ntz, estimate_days int, release_errors int, action_checks int, owner_checks int"
    ago = lambda h: TS(2024, 5, 3, 21) - dt.timedelta(hours=h)
    rows = [
        (1, day, day, "current", ago(30), 0, 1, 3, ago(168), 1, 1, 0, ago(48), 2, 0, 1, 1), (2, day, D(2024, 5, 2), "current", ago(31), 0, 1, 2, ago(1), 1, 1, 1, ago(1), 1, 1, 0, 0),
        (3, D(2024, 5, 2), None, "current", ago(-1), 0, 0, 0, None, 0, 0, 0, ago(99), 0, 0, 0, 0), (4, None, None, "current", ago(1), 2, 5, None, None, None, 1, None, None, None, None, None, None),
    ]
    got = {(r.entity_id, r.family): r.status for r in U.entity_coverage(spark.createDataFrame(rows, kind), clock, F.lit(day)).collect()}
    want = {"market": ("current", "stale", "stale", "missing"), "financials": ("current", "stale", "missing", "partial"), "analyst": ("current", "partial", "missing", "missing"), "estimates": ("current", "partial", "stale", "partial"),
            "revisions": ("partial", "building", "missing", "missing"), "guidance": ("unknown", "pending", "unknown", "unknown"), "actions": ("unavailable", "missing", "missing", "missing"), "ownership": ("unknown", "not_collected", "not_collected", "not_collected")}
    for family, statuses in want.items():
        assert tuple(got[i, family] for i in range(1, 5)) == statuses, family
    total = {r.family: (r.covered, r.total) for r in U.coverage_summary(U.entity_coverage(spark.createDataFrame(rows, kind), clock, F.lit(day))).collect()}
    assert total["market"] == (1, 4) and len(total) == 15
