"""Invariants of the operators on small frames, most of them against brute force."""

import datetime as dt
import hashlib
import random
import statistics

from pyspark.sql import functions as F

from tidemark.functions import text as X_text
from tidemark.functions import clip, finite, midpoint, relative_change, weighted_available
from tidemark.operators import asof as A
from tidemark.operators import bars as B
from tidemark.operators import calendar as C
from tidemark.operators import earnings as R
from tidemark.operators import evaluate as E
from tidemark.operators import features as X
from tidemark.operators import fundamentals as S
from tidemark.operators import macro as M
from tidemark.operators import rank as K
from tidemark.operators import ranks as G
from tidemark.operators import releases as L
from tidemark.operators import sets as Z

D = dt.date
TS = dt.datetime


def rows(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=repr)


def test_missing_is_neither_zero_nor_neutral(spark):
    df = spark.createDataFrame([("1.5",), ("x",), ("NaN",), ("Infinity",), (None,)], "v string")
    assert [r[0] for r in df.select(finite("v")).collect()] == [1.5, None, None, None, None]
    one = spark.createDataFrame([(None, 3.0, -2.0)], "a double, b double, c double")
    assert one.select(clip("a", -1, 1), midpoint("a", "b"), relative_change("b", "c")).first() == (None, 3.0, 2.5)
    value, weight = weighted_available([(F.col("a"), 0.5), (F.col("b"), 0.5)])
    assert one.select(value, weight).first() == (3.0, 0.5)


def test_exchange_calendar_rules(spark):
    cal = {r["day"]: r["close_utc"] for r in C.exchange_sessions(spark, "1995-01-01", "2030-12-31").collect()}
    # Published closures and early closes.
    for closed in (D(2024, 3, 29), D(2025, 1, 9), D(2025, 4, 18), D(2026, 4, 3), D(2024, 6, 19), D(2023, 1, 2), D(2021, 7, 5), D(2024, 11, 28), D(2024, 12, 25), D(2021, 12, 24)):
        assert closed not in cal, closed
    assert D(2021, 6, 18) in cal and D(2021, 12, 31) in cal and D(2027, 12, 31) in cal
    assert cal[D(2024, 7, 3)] == TS(2024, 7, 3, 17) and cal[D(2024, 11, 29)] == TS(2024, 11, 29, 18)
    assert cal[D(2024, 7, 5)] == TS(2024, 7, 5, 20) and cal[D(2024, 1, 5)] == TS(2024, 1, 5, 21)
    assert sum(d.year == 2024 for d in cal) == 252


def test_easter_matches_known_dates(spark):
    # Easter Sundays.
    known = {1999: (4, 4), 2000: (4, 23), 2008: (3, 23), 2011: (4, 24), 2019: (4, 21), 2024: (3, 31), 2025: (4, 20), 2038: (4, 25)}
    df = spark.createDataFrame([(y,) for y in known], "y int")
    assert {r[0]: (r[1].month, r[1].day) for r in df.select("y", C._easter(F.col("y"))).collect()} == known


def _panel(spark, closes, entity=1):
    day = D(2024, 1, 1)
    data = [(entity, day + dt.timedelta(days=i), i + 1, c, c * 1.01, c * 0.99, 100 + i) for i, c in enumerate(closes) if c is not None]
    return spark.createDataFrame(data, "entity_id long, session_date date, session_no int, close double, high double, low double, volume long")


def test_hole_nulls_only_the_frames_that_span_it(spark):
    closes = [100.0 + i for i in range(80)]
    full = {r["session_no"]: r for r in X.own_features(_panel(spark, closes)).collect()}
    closes[40] = None
    holed = {r["session_no"]: r for r in X.own_features(_panel(spark, closes)).collect()}
    assert holed[46]["momentum_5"] is None and holed[47]["momentum_5"] == full[47]["momentum_5"]
    assert holed[36]["forward_return_5"] is None and holed[35]["forward_return_5"] == full[35]["forward_return_5"]
    assert holed[60]["close_vs_sma20"] is None and holed[61]["close_vs_sma20"] == full[61]["close_vs_sma20"]
    assert holed[61]["volatility_20"] is None and holed[62]["volatility_20"] == full[62]["volatility_20"]
    assert all(holed[n]["drawdown_60"] is None for n in range(60, 81) if n in holed)


def test_setup_history_is_purged(spark):
    data = [(1, n, -0.1, 0.05, 0.2, -0.5 if n > 61 else 0.02) for n in range(1, 67)]
    df = spark.createDataFrame(data, "entity_id long, session_no int, drawdown_60 double, distance_to_support_60 double, rebound_potential_60 double, forward_return_5 double")
    last = X.setup_history(df).where("session_no = 66").first()
    assert (last["sample_size"], last["ups"], last["setup_median"]) == (61, 61, 0.02)


def test_gaps_and_canonical_priority(spark):
    bars = spark.createDataFrame([(1, D(2024, 1, 1), "b", 1.0), (1, D(2024, 1, 1), "p", 2.0), (1, D(2024, 1, 4), "c", 3.0), (1, D(2024, 1, 4), "a", 4.0)], "entity_id long, session_date date, source string, close double")
    assert rows(B.canonical_bars(bars, "p"), "session_date", "source") == [(D(2024, 1, 1), "p"), (D(2024, 1, 4), "a")]
    cal = spark.createDataFrame([(D(2024, 1, d), d) for d in (1, 2, 3, 4)], "session_date date, session_no int")
    assert rows(B.gap_audit(bars, cal)) == [(1, D(2024, 1, 2), D(2024, 1, 3), 2)]


def test_bar_validity(spark):
    df = spark.createDataFrame([(None, 5.0, 4.0, 4.5, 1), (None, 4.0, 4.0, 4.5, 1), (4.0, 5.0, 4.2, 4.5, 1), (None, None, None, -1.0, 1), (None, None, None, 1.0, -1)], "open double, high double, low double, close double, volume long")
    assert [r[0] for r in df.select(B.valid_bar()).collect()] == [True, False, False, False, False]


def test_asof_blocks_change_nothing_and_late_rows_never_leak(spark):
    rng = random.Random(3)
    base = TS(2024, 1, 1)
    at = lambda: base + dt.timedelta(minutes=rng.randrange(60 * 24 * 40))
    left = spark.createDataFrame([(i, 1 if rng.random() < 0.7 else 2, at()) for i in range(300)], "id int, k int, ts timestamp_ntz")
    facts = [(1 if rng.random() < 0.7 else 2, at(), float(i)) for i in range(200)]
    right = spark.createDataFrame(facts, "k int, seen timestamp_ntz, v double")
    plain = A.asof_best(left, right, ["k"], "ts", "seen", ["v"], best=["seen", "v"])
    blocked = A.asof_best(left, right, ["k"], "ts", "seen", ["v"], best=["seen", "v"], block="day")
    want = sorted((i, max(((s, v) for kk, s, v in facts if kk == k and s <= t), default=(None, None))[1]) for i, k, t in [tuple(r) for r in left.collect()])
    assert rows(plain, "id", "v") == rows(blocked, "id", "v") == sorted(want, key=repr)
    forward = A.asof_best(left, right, ["k"], "ts", "seen", ["v"], best=["seen", "v"], block="day", forward=True)
    want = [(i, min(((s, v) for kk, s, v in facts if kk == k and s >= t), default=(None, None))[1]) for i, k, t in [tuple(r) for r in left.collect()]]
    assert rows(forward, "id", "v") == sorted(want, key=repr)
    future = spark.createDataFrame([(1, TS(2030, 1, 1), -1.0)], right.schema)
    assert rows(A.asof_best(left, right.unionByName(future), ["k"], "ts", "seen", ["v"], best=["seen", "v"]), "id", "v") == rows(plain, "id", "v")


def test_versions_by_cutoff(spark):
    v = spark.createDataFrame([(1, D(2024, 3, 31), TS(2024, 5, 1), 2.0), (1, D(2024, 3, 31), TS(2024, 6, 1), 9.0), (1, D(2023, 12, 31), TS(2024, 7, 1), 5.0)], "entity_id long, period_end date, observed_at timestamp_ntz, x double")
    d = spark.createDataFrame([(1, TS(2024, m, 15)) for m in (4, 5, 6, 7)], "entity_id long, at timestamp_ntz")
    assert rows(A.latest_known(d, v, ["entity_id"], "at", "observed_at", "period_end", ["x"], ["observed_at"]), "at", "x") == [
        (TS(2024, 4, 15), None), (TS(2024, 5, 15), 2.0), (TS(2024, 6, 15), 9.0), (TS(2024, 7, 15), 9.0)
    ]


def test_half_open_membership_and_capture(spark):
    m = spark.createDataFrame([(1, D(2026, 9, 21), D(2026, 10, 5), None), (2, D(2026, 9, 1), None, TS(2026, 10, 3))], "entity_id long, f date, t date, seen timestamp_ntz")
    d = spark.createDataFrame([(e, day, TS(day.year, day.month, day.day, 21)) for e, day in ((1, D(2026, 10, 2)), (1, D(2026, 10, 5)), (2, D(2026, 10, 2)), (2, D(2026, 10, 5)))], "entity_id long, day date, at timestamp_ntz")
    out = A.member_asof(d, m, ["entity_id"], "at", "day", "f", "t", "seen")
    assert rows(out, "entity_id", "day", "is_member") == [(1, D(2026, 10, 2), True), (1, D(2026, 10, 5), False), (2, D(2026, 10, 2), False), (2, D(2026, 10, 5), True)]


def test_membership_starts_on_its_own_day(spark):
    m = spark.createDataFrame([(1, D(2024, 1, 5), None, TS(2024, 1, 1)), (2, D(2024, 1, 5), D(2024, 1, 20), None)], "entity_id long, f date, t date, seen timestamp_ntz")
    d = spark.createDataFrame([(e, D(2024, 1, day), TS(2024, 1, 10)) for e in (1, 2) for day in (1, 5, 9)], "entity_id long, day date, at timestamp_ntz")
    want = [(e, D(2024, 1, day), day >= 5) for e in (1, 2) for day in (1, 5, 9)]
    assert rows(A.member_asof(d, m, ["entity_id"], "at", "day", "f", "t", "seen"), "entity_id", "day", "is_member") == want
    assert rows(A.member_asof(d, m, ["entity_id"], "at", "day", "f", "t"), "entity_id", "day", "is_member") == want


def test_reports_observed_later_change_nothing(spark):
    asks = spark.createDataFrame([(1, TS(2024, 5, day, 21)) for day in (11, 12, 13, 20, 23)], "entity_id long, at timestamp_ntz")
    known = [(1, 7, D(2024, 5, 12), TS(2024, 5, 12, 18), 4.0)]
    later = [(1, 7, D(2024, 5, 12), TS(2024, 5, 22), 9.0)]
    kind = "entity_id long, event_id long, reported_date date, observed_at timestamp_ntz, surprise double"
    find = lambda data: rows(R.recent_report(asks, spark.createDataFrame(data, kind), "at", ["surprise"]), "at", "surprise")
    assert find(known) == [(TS(2024, 5, 11, 21), None), (TS(2024, 5, 12, 21), None), (TS(2024, 5, 13, 21), 4.0), (TS(2024, 5, 20, 21), 4.0), (TS(2024, 5, 23, 21), 4.0)]
    assert find(known + later) == find(known)[:4] + [(TS(2024, 5, 23, 21), 9.0)]


def test_expected_reports_as_the_calendar_was_known(spark):
    days = [(D(2024, 5, d), n) for n, d in enumerate((1, 2, 3, 6, 7, 8, 9, 10, 13, 14, 15, 16, 17))]
    calendar = spark.createDataFrame(days, "session_date date, session_no int")
    asks = spark.createDataFrame([(1, TS(2024, 5, d, 21)) for d in (1, 2, 7, 9)], "entity_id long, at timestamp_ntz")
    expected = [(1, 7, D(2024, 5, 15), TS(2024, 4, 1)), (1, 7, D(2024, 5, 8), TS(2024, 5, 2, 12)), (1, 8, D(2024, 5, 17), TS(2024, 5, 9, 22))]
    reports = [(1, 7, TS(2024, 5, 7, 20))]
    out = R.upcoming_report(asks, spark.createDataFrame(expected, "entity_id long, event_id long, expected_date date, observed_at timestamp_ntz"), spark.createDataFrame(reports, "entity_id long, event_id long, observed_at timestamp_ntz"), calendar, "at")
    # moved forward on the 2nd, reported early on the 7th, the next one not on the calendar yet on the 9th
    assert rows(out, "at", "reported_date", "sessions_until") == [(TS(2024, 5, 1, 21), D(2024, 5, 15), 10), (TS(2024, 5, 2, 21), D(2024, 5, 8), 4), (TS(2024, 5, 7, 21), None, None), (TS(2024, 5, 9, 21), None, None)]


def test_change_points_keep_a_b_a_across_blocks(spark):
    data = [(1, 1, TS(2024, 1, 1, 1), "a"), (2, 1, TS(2024, 1, 1, 2), "a"), (3, 1, TS(2024, 1, 2), "b"), (4, 1, TS(2024, 1, 5), "b"), (5, 1, TS(2024, 1, 6), "a"), (6, 1, TS(2024, 1, 7), None)]
    df = spark.createDataFrame(data, "id int, k int, ts timestamp_ntz, s string")
    assert [r[0] for r in rows(A.change_points(df, ["k"], ["ts", "id"], F.col("s")), "id")] == [1, 3, 5, 6]


def test_nearest_prefers_the_earlier_day(spark):
    left = spark.createDataFrame([(1, D(2024, 1, 10)), (1, D(2024, 1, 20)), (1, D(2024, 3, 1))], "k int, t date")
    right = spark.createDataFrame([(1, D(2024, 1, 8), "x"), (1, D(2024, 1, 12), "y"), (1, D(2024, 1, 21), "z")], "k int, d date, v string")
    assert rows(A.nearest(left, right, ["k"], "t", "d", ["v"], 5), "t", "v", "distance") == [(D(2024, 1, 10), "x", 2), (D(2024, 1, 20), "z", 1), (D(2024, 3, 1), None, None)]


def test_interval_and_window_joins_match_brute_force(spark):
    rng = random.Random(5)
    day = lambda: D(2020, 1, 1) + dt.timedelta(days=rng.randrange(900))
    points = [(i, rng.randrange(2), day()) for i in range(60)]
    spans = []
    for i in range(40):
        a = day()
        spans.append((i, rng.randrange(2), a, None if rng.random() < 0.2 else a + dt.timedelta(days=rng.randrange(1, 400))))
    p = spark.createDataFrame(points, "i int, k int, d date")
    s = spark.createDataFrame(spans, "j int, k int, f date, t date")
    want = sorted((i, j) for i, k, d in points for j, kk, f, t in spans if k == kk and f <= d and (t is None or d < t))
    assert sorted(rows(A.interval_join(p, s, ["k"], "d", "f", "t"), "i", "j")) == want
    q = spark.createDataFrame([(i, k, d) for i, k, d in points], "j int, k int, e date")
    want = sorted((i, j) for i, k, d in points for j, kk, e in points if k == kk and -40 <= (e - d).days <= -10)
    assert sorted(rows(A.window_join(p, q, ["k"], "d", "e", -40, -10), "i", "j")) == want


def test_ranks_and_quantiles_are_exact_on_a_hot_group(spark):
    rng = random.Random(1)
    data = [("hot", round(rng.gauss(0, 3), 2)) for _ in range(400)] + [("cold", float(i)) for i in range(7)] + [("cold", None)]
    df = spark.createDataFrame(data, "g string, v double")
    p = G.mid_rank_percentile(df, ["g"], "v")
    for g, v, pct, n in p.collect():
        xs = [b for a, b in data if a == g and b is not None]
        want = None if v is None else 100 * (sum(x < v for x in xs) + sum(x == v for x in xs) / 2) / len(xs)
        assert (pct is None) == (want is None) and (want is None or abs(pct - want) < 1e-9)
    q = {r["g"]: r for r in G.quantiles(df, ["g"], "v", {"a": 0.1, "m": 0.5, "z": 0.9}, exclusive=True).collect()}
    for g in ("hot", "cold"):
        xs = [b for a, b in data if a == g and b is not None]
        cuts = statistics.quantiles(xs, n=10)
        assert all(abs(q[g][k] - cuts[i]) < 1e-9 for k, i in (("a", 0), ("m", 4), ("z", 8)))
    t = {r["g"]: r["tail_mean"] for r in G.tail_mean(df, ["g"], "v").collect()}
    xs = sorted(b for a, b in data if a == "hot")
    assert abs(t["hot"] - statistics.mean(xs[:80])) < 1e-9 and t["cold"] == 0.5


def test_peer_scores_keep_the_weight_of_unknown_factors(spark):
    data = [(e, "s", "general", f, None if (e, f) == (1, "eps_growth") else float(e), 0.5) for e in range(1, 11) for f in ("eps_growth", "net_debt_to_fcf")]
    long = spark.createDataFrame(data, "entity_id long, sector string, profile string, factor string, value double, weight double")
    s = K.peer_scores(long, ["sector", "profile"])
    top = {(r["entity_id"], r["factor"]): r for r in s.collect()}
    assert top[(1, "eps_growth")]["contribution"] == 0.0 and top[(1, "net_debt_to_fcf")]["score"] == 95.0
    assert top[(10, "eps_growth")]["peers"] == 9 and top[(10, "net_debt_to_fcf")]["score"] == 5.0
    tot = {r["entity_id"]: r for r in K.financial_score(s, ["entity_id"]).collect()}
    assert tot[1]["peer_coverage"] == 0.5 and tot[1]["missing_factors"] == ["eps_growth"]


def test_string_tie_break(spark):
    df = spark.createDataFrame([(2, 1.0), (10, 1.0), (1, 0.5)], "entity_id long, s double")
    assert [r["entity_id"] for r in K.top_n(df, 2, "s").orderBy("rank").collect()] == [10, 2]


def test_execution_enters_next_session_and_never_shifts(spark):
    cal = spark.createDataFrame([(D(2026, 9, 24 + i), i + 1) for i in range(7)], "session_date date, session_no int")
    px = spark.createDataFrame([(1, n, 18.0 + n) for n in (1, 2, 3, 4, 5, 6, 7)] + [(2, n, 10.0) for n in (1, 2, 3, 4, 5, 6)], "entity_id long, session_no int, close double")
    sig = spark.createDataFrame([(1, 1, 5), (2, 1, 5), (1, 2, 5)], "entity_id long, session_no int, horizon int")
    out = {(r["entity_id"], r["session_no"]): r for r in E.execute(sig, cal, px).collect()}
    assert abs(out[(1, 1)]["gross_return"] - 0.25) < 1e-12 and out[(1, 1)]["status"] == "complete"
    assert out[(2, 1)]["gross_return"] is None and out[(2, 1)]["status"] == "missing" and out[(1, 2)]["status"] == "pending"


def test_interval_identity_and_conflict(spark):
    d = lambda m: D(2024, m, 1)
    e = spark.createDataFrame([(1, d(1), d(7), 60.0), (1, d(1), d(3), 20.0), (1, d(7), d(9), 25.0), (2, d(1), d(4), 5.0), (2, d(4), d(9), 5.0), (2, d(1), d(9), 12.0)], "entity_id long, left date, right date, value double")
    a = spark.createDataFrame([(1, d(3), d(9)), (2, d(1), d(9)), (3, d(1), d(9))], "entity_id long, start date, end date")
    assert rows(S.interval_totals(e, a), "entity_id", "total") == [(1, 65.0), (2, None), (3, None)]
    long = spark.createDataFrame([(1, D(2000, 1, 1) + dt.timedelta(days=30 * k), D(2000, 1, 1) + dt.timedelta(days=30 * k + 30), 1.0) for k in range(40)], "entity_id long, left date, right date, value double")
    far = spark.createDataFrame([(1, D(2000, 1, 1), D(2000, 1, 1) + dt.timedelta(days=1200)), (1, D(2000, 1, 31), D(2000, 1, 1)), (1, D(1999, 1, 1), D(2000, 1, 1)), (2, D(2000, 1, 1), D(2000, 1, 31))], "entity_id long, start date, end date")
    assert [r[1] for r in rows(S.interval_totals(long, far), "start", "total", "entity_id")] == [None, 40.0, None, -1.0]


def test_interval_totals_of_random_groups(spark):
    rng = random.Random(5)
    day = lambda i: D(2000, 1, 1) + dt.timedelta(days=i)
    edges, asks = [], []
    for e in range(6):
        at = [rng.randint(-50, 50) for _ in range(30)]
        for _ in range(26):
            a, b = rng.sample(range(30), 2)
            edges.append((e, a, b, float(at[b] - at[a])))
        if e % 2:  # one interval that says otherwise
            a, b = rng.sample(range(30), 2)
            edges.append((e, a, b, float(at[b] - at[a] + 7)))
        asks += [(e, *rng.sample(range(31), 2)) for _ in range(40)]
    frame = lambda rows, kind: spark.createDataFrame([(r[0], day(r[1]), day(r[2]), *r[3:]) for r in rows], kind)
    got = {(r.entity_id, r.start, r.end): r.total for r in S.interval_totals(frame(edges, "entity_id int, left date, right date, value double"), frame(asks, "entity_id int, start date, end date")).collect()}
    links = {}
    for e, a, b, w in edges:
        links.setdefault((e, a), []).append((b, w))
        links.setdefault((e, b), []).append((a, -w))
    for e, a, b in asks:
        total, todo, torn = {a: 0.0}, [a], False
        while todo:
            x = todo.pop()
            for y, w in links.get((e, x), []):
                if y not in total:
                    total[y] = total[x] + w
                    todo.append(y)
                torn = torn or total[y] != total[x] + w
        assert got[e, day(a), day(b)] == (None if torn or (e, a) not in links else total.get(b))


def test_macro_vintage_counts_from_the_next_day(spark):
    o = spark.createDataFrame([("X", D(2024, 1, 1), 1.0, "u", D(2024, 2, 10), TS(2024, 6, 1))], "series_id string, observation_date date, value double, units string, vintage_date date, observed_at timestamp_ntz")
    a = spark.createDataFrame([("X", TS(2024, 2, 10, 21)), ("X", TS(2024, 2, 11, 21))], "series_id string, at timestamp_ntz")
    assert rows(M.latest_observation(a, o, "at", 75), "at", "value") == [(TS(2024, 2, 10, 21), None), (TS(2024, 2, 11, 21), 1.0)]


def test_streak_uses_the_version_known_then(spark):
    data = [(1, 11, D(2024, 1, 5), TS(2024, 1, 6), 1.0, 1.0), (1, 12, D(2024, 4, 5), TS(2024, 4, 6), 1.0, 1.0), (1, 11, D(2024, 1, 5), TS(2024, 5, 1), 1.0, -1.0)]
    v = spark.createDataFrame(data, "entity_id long, event_id long, reported_date date, observed_at timestamp_ntz, reported_eps double, surprise_percent double")
    d = spark.createDataFrame([(1, TS(2024, m, 20)) for m in (1, 4, 5)], "entity_id long, at timestamp_ntz")
    assert rows(R.earnings_asof(d, v, "at", ["surprise_percent"]), "at", "beat_streak") == [(TS(2024, 1, 20), 1), (TS(2024, 4, 20), 2), (TS(2024, 5, 20), 1)]


def test_guidance_text(spark):
    pages = [
        (1, "<p>We expect fiscal year 2025 revenue of $1.5 billion to $1.7 billion and adjusted EPS of $2.10 to $2.30.</p>"),
        (2, "<p>We expect fiscal year 2025 revenue of 10 million to 12 million.</p><p>Outlook: full year 2025 sales between 20 million and 22 million</p>"),
        (3, "<p>We do not provide guidance. FY 2025 revenue of 1 million to 2 million</p><p>fiscal year 2025 guidance: revenue of 9 million to 7 million</p>"),
        (4, "<p>Guidance for Q2 fiscal 2025: revenue in the range of 5 million to 6 million</p>"),
    ]
    df = spark.createDataFrame([(i, D(2025, 1, 30), h) for i, h in pages], "id int, filing_date date, html string")
    got = rows(L.guidance_ranges(df, ["id", "filing_date"]), "id", "fiscal_period", "metric", "method", "low", "high")
    assert got == [(1, "FY", "eps", "adjusted", 2.1, 2.3), (1, "FY", "revenue", "reported", 1.5e9, 1.7e9), (4, "Q2", "revenue", "reported", 5e6, 6e6)]


def test_guidance_grammar(spark):
    lines = {
        1: "Our outlook: third quarter 2025 revenue is raised from $1.0 to $1.2 billion to $1.3 to $1.4 billion",
        2: "2025 full year guidance: net sales of $1,250 million &#8211; $1,300 million; GAAP EPS of ($0) no range",
        3: "We withdrew guidance for fiscal year 2025, revenue of 1 million to 2 million",
        4: "We expect fiscal 2025 revenue between 5 and 6 million, diluted earnings per share of $1.10 &mdash; $1.20",
        5: "We expect fiscal 2025 or fiscal 2026 revenue of 5 million to 6 million",
        6: "word " * 900 + "we anticipate fiscal year 2025 revenues of 7 million through 8 million",
        7: "For the first quarter and full year 2025 we expect revenue of 1 million to 2 million",
        8: "We expect fiscal 2031 revenue of 1 million to 2 million",
        9: "We expect fiscal 2025 revenue of 1 million to 2 billion",
    }
    df = spark.createDataFrame([(i, D(2025, 1, 30), f"<p>{h}</p>") for i, h in lines.items()], "id int, filing_date date, html string")
    got = rows(L.guidance_ranges(df, ["id", "filing_date"]), "id", "fiscal_period", "metric", "method", "low", "high")
    assert got == [
        (1, "Q3", "revenue", "reported", 1.3e9, 1.4e9), (2, "FY", "revenue", "reported", 1.25e9, 1.3e9), (4, "FY", "eps", "diluted", 1.1, 1.2),
        (4, "FY", "revenue", "reported", 5e6, 6e6), (6, "FY", "revenue", "reported", 7e6, 8e6),
    ]


def test_fiscal_targets(spark):
    texts = ["for the year ending December 31, 2025, in U.S. dollars", "the period ended 2025-06-30 (EUR)", "ends on 31 May", "USD or EUR by year end March 1 2026", "nothing"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    day, currency = L.explicit_target(F.col("t"))
    assert rows(df.select("id", day.alias("d"), currency.alias("c")), "id", "d", "c") == [(0, D(2025, 12, 31), "USD"), (1, D(2025, 6, 30), "EUR"), (2, None, None), (3, D(2026, 3, 1), None), (4, None, None)]


def test_character_references_are_resolved_once(spark):
    texts = ["a&amp;lt;b", "1&#8211;2 &mdash; &rsquo;s", "&#x1F600;&#128512;", "&bogus; & &amp &#0; &#xD800;", None, "&nbsp;x&#160;y", "no marks"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = [r[1] for r in rows(df.select("id", X_text.resolved_references(F.col("t")).alias("x")), "id", "x")]
    assert got == ["a&lt;b", "1\u20132 \u2014 \u2019s", "\U0001f600\U0001f600", "&bogus; & &amp &#0; &#xD800;", None, " x y", "no marks"]


def test_links_are_filtered_before_any_limit(spark):
    menu = "".join(f'<a href="/menu/{i}">Menu {i}</a>' for i in range(15))
    html = menu + '<a href="q1.pdf#page=2">Results</a><a href="//files.example.com/b.pdf">Slides</a><a href="q1.pdf">Again</a><a href="https://evil.test/example.com/c.pdf">x</a><a href="/news">Annual report</a>'
    df = spark.createDataFrame([(1, "https://ir.example.com/news/index.html?x=1", html)], "id int, url string, html string")
    got = rows(L.discovered_links(df, "id", "html", kinds=r"(?i)\.pdf$|report", hosts=("example.com",), url="url"), "position", "href")
    assert got == [(15, "https://ir.example.com/news/q1.pdf"), (16, "https://files.example.com/b.pdf"), (19, "https://ir.example.com/news")]
    assert L.discovered_links(df, "id", "html").count() == 20 and L.discovered_links(df, "id", "html", kinds="pdf", per_page=1).count() == 1


def test_document_kinds_read_the_whole_text(spark):
    texts = ["x" * 5000 + " transcript of the conference call", "a transcript of records", "quarterly results. slide 1. investor presentation", "hello"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    assert [r[1] for r in rows(df.select("id", X_text.document_kind(F.col("t")).alias("k")), "id", "k")] == ["transcript", "official_release", "presentation", "official_release"]


def test_renames_need_the_same_identity(spark):
    cur = spark.createDataFrame([("OLD", "7"), ("GONE", "8")], "name string, identity string")
    new = spark.createDataFrame([("NEW", "7"), ("OTHER", "9")], "name string, identity string")
    mapping = spark.createDataFrame([("OLD", "NEW"), ("GONE", "OTHER")], "old string, new string")
    assert rows(Z.renames(cur, new, mapping)) == [("OLD", "NEW", "7")]


def test_setup_history_against_all_pairs(spark):
    rng = random.Random(8)
    rows = []
    for e in range(3):
        for no in range(1, 130):
            d, s = rng.choice([None, *[-i / 50 for i in range(12)]]), rng.choice([None, *[i / 50 for i in range(9)]])
            if (no + e) % 11:  # holes: the window counts rows, not sessions
                rows.append((e, no, d, s, None if no > 120 else rng.choice([None, -0.02, 0.01, 0.03])))
    df = spark.createDataFrame(rows, "entity_id int, session_no int, drawdown_60 double, distance_to_support_60 double, forward_return_5 double")
    got = {(r.entity_id, r.session_no): (r.sample_size, r.ups, round(r.setup_median, 9)) for r in X.setup_history(df, 40, 5).collect()}
    want = {}
    for e in range(3):
        own = [r for r in rows if r[0] == e]
        for i, (_, no, d, s, _) in enumerate(own):
            past = [p for p in own[max(0, i - 40) : max(0, i - 4)] if None not in (d, s, *p[2:])]
            outcomes = [p[4] for p in past if abs(p[2] - d) <= 0.04 and abs(p[3] - s) <= 0.04]
            if outcomes:
                want[e, no] = (len(outcomes), sum(x > 0 for x in outcomes), round(statistics.median(outcomes), 9))
    assert got == want and len(want) > 150


def test_gate_needs_every_figure_and_choice_looks_at_the_middle_only(spark):
    good = {"cohorts": 30, "evaluation_coverage": 0.96, "worst_fifth_mean": -0.01, "screen_worst_fifth_mean": -0.02, "breach_rate": 0.1} | {
        c: 0.01 for c in ("mean_net_return", "mean_excess", "mean_improvement_vs_screen", "stress_mean_excess", "lower_bound_vs_benchmark", "lower_bound_vs_screen")
    }
    bad = [good | {c: v} for c in good for v in (None, -1.0 if c != "screen_worst_fifth_mean" else 0.5)] + [good | {"breach_rate": 0.21}, good | {"cohorts": 25}]
    kind = ", ".join(f"{c} double" for c in good)
    df = spark.createDataFrame([(i, *[None if r[c] is None else float(r[c]) for c in good]) for i, r in enumerate([good, *bad])], f"i int, {kind}")
    assert [r.i for r in df.where(E.period_passes()).collect()] == [0]
    report = spark.createDataFrame([("a", "selection", False, 0.9), ("a", "holdout", True, 0.9), ("b", "selection", True, 0.1), ("b", "holdout", False, 0.2), ("c", "selection", True, None), ("c", "holdout", True, 0.5)], "model_version string, period string, passes boolean, mean_improvement_vs_screen double")
    assert tuple(E.selected_variant(report).first()) == ("b", True, False, False, 0.2)
    assert tuple(E.selected_variant(report.where("model_version <> 'b'")).first()) == ("c", True, True, True, 0.5)


def test_bounds_of_groups_share_their_draws(spark):
    rng = random.Random(9)
    xs = {g: [rng.gauss(0.1 * i, 1) for _ in range(n)] for i, (g, n) in enumerate({"a": 30, "b": 30, "c": 7}.items())}
    df = spark.createDataFrame([(g, i, x, 2 * x) for g, v in xs.items() for i, x in enumerate(v)], "g string, pos long, x double, y double")
    got = {r.g: (r.low, r.twice) for r in E.lower_bounds(df, ["g"], {"low": "x", "twice": "y"}, "pos", repeats=200).collect()}
    for g, v in xs.items():
        means = []
        for rep in range(200):
            drawn = []
            for k in range(-(-len(v) // 4)):
                s = int(hashlib.md5(f"{rep}|{k}".encode()).hexdigest()[:8], 16) % len(v)
                drawn += [v[(s + i) % len(v)] for i in range(4) if k * 4 + i < len(v)]
            means.append(statistics.mean(drawn))
        assert abs(got[g][0] - sorted(means)[10]) < 1e-12 and abs(got[g][1] - 2 * got[g][0]) < 1e-12
