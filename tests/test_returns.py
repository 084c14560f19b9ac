"""Price and total return, side by side and never mixed."""

import datetime as dt

import pytest

from tidemark.operators import evaluate as E
from tidemark.operators import returns as R

DAYS = [dt.date(2024, 12, 30) + dt.timedelta(days=i) for i in range(8)]


def _bars(spark, closes):
    rows = [(e, DAYS[i], i + 1, c) for e, cs in closes.items() for i, c in enumerate(cs)]
    return spark.createDataFrame(rows, "entity_id int, session_date date, session_no int, close double")


def _series(df):
    out = {}
    for r in df.collect():
        out.setdefault((r.entity_id, r.basis), {})[r.session_no] = r.close
    return {k: [v[i] for i in sorted(v)] for k, v in out.items()}


def test_holdings_grow_as_a_ledger_says(spark):
    closes = {1: [10.0, 11.0, 5.6, 5.5, None, 6.0, 6.2, 6.0], 2: [7.0] * 8, 3: [4.0] * 8}
    actions = [
        (1, "split", DAYS[2], 2.0), (1, "dividend", DAYS[2], 0.5), (1, "dividend", DAYS[4], 0.3), (1, "dividend", DAYS[4], 0.1),  # the latter on a session without a price
        (1, "dividend", DAYS[7] + dt.timedelta(days=9), 5.0), (3, "dividend", DAYS[1], 1.0), (3, "dividend", DAYS[3], None), (3, "dividend", DAYS[5], -1.0),
    ]
    acts = spark.createDataFrame(actions, "entity_id int, kind string, event_date date, amount double")
    got = _series(R.return_bases(_bars(spark, closes), acts))
    shares, total = 1.0, []
    for i, c in enumerate(closes[1]):
        cash = {2: 0.5, 5: 0.4}.get(i, 0.0)
        shares *= 2 if i == 2 else 1
        shares += shares * cash / c if c else 0
        total.append(None if c is None else shares * c)
    assert got[1, "total"] == pytest.approx(total) and got[1, "price"] == pytest.approx([c if c is None or i < 2 else 2 * c for i, c in enumerate(closes[1])])
    assert got[2, "price"] == got[2, "total"] == closes[2]
    assert got[3, "total"][:3] == [4.0, 5.0, 5.0] and got[3, "total"][3:] == [None] * 5 and got[3, "price"] == closes[3]
    gaps = {(r.entity_id, r.basis): r.missing for r in R.missing_required(R.return_bases(_bars(spark, closes), acts), _bars(spark, closes)).collect()}
    assert gaps == {(1, "price"): 1, (1, "total"): 1, (3, "total"): 5}


def test_an_unknown_split_ends_both(spark):
    acts = spark.createDataFrame([(1, "split", DAYS[1], None), (2, "merger", DAYS[2], 1.0)], "entity_id int, kind string, event_date date, amount double")
    got = _series(R.return_bases(_bars(spark, {1: [3.0] * 3, 2: [3.0] * 3}), acts))
    assert got == {(1, b): [3.0, None, None] for b in R.BASES} | {(2, b): [3.0, 3.0, None] for b in R.BASES}


def test_products_in_blocks_equal_one_run(spark):
    import random

    from pyspark.sql import functions as F

    rng = random.Random(2)
    rows = [(e, i, 1 + rng.randint(-2, 3) / 10, rng.randint(0, 1)) for e in range(3) for i in range(200) if rng.random() > 0.2]
    df = spark.createDataFrame(rows, "k int, i int, f double, c int")
    got = {(r.k, r.i): (r.p, r.n) for r in R.running_product(df, ["k"], "i", F.floor(F.col("i") / 17), {"p": F.col("f")}, {"n": F.col("c")}).collect()}
    for e in range(3):
        p, n = 1.0, 0
        for _, i, f, c in [r for r in rows if r[0] == e]:
            p, n = p * f, n + c
            assert got[e, i] == (pytest.approx(p), n)


def test_a_basis_is_not_filled_from_the_other(spark):
    bars = _bars(spark, {1: [10.0] * 6, 2: [5.0] * 6})
    acts = spark.createDataFrame([(1, "dividend", DAYS[2], 1.0), (2, "dividend", DAYS[3], None)], "entity_id int, kind string, event_date date, amount double")
    picks = spark.createDataFrame([("a", 1, 1.0, 1, 6), ("b", 2, 1.0, 1, 6)], "cohort string, entity_id int, weight double, entry_no int, exit_no int")
    days = spark.createDataFrame([(i + 1, DAYS[i]) for i in range(6)], "session_no int, session_date date")
    bench = spark.createDataFrame([(i + 1, 1.0, b) for i in range(6) for b in R.BASES], "session_no int, close double, basis string")
    out = E.cohort_paths(picks, days, R.return_bases(bars, acts), bench, {"free": 0.0}, ["cohort"], bases=R.BASES).collect()
    curves = {}
    for r in sorted(out, key=lambda r: r.session_no):
        curves.setdefault((r.cohort, r.basis), []).append(round(r.equity, 6))
    assert curves == {("a", "price"): [10000.0] * 6, ("a", "total"): [10000.0] * 2 + [11000.0] * 4, ("b", "price"): [10000.0] * 6, ("b", "total"): [10000.0] * 3}
