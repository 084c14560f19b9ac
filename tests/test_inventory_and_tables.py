"""Sketches by day, and the table function of SQL."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import tables as T
from tidemark.operators import inventory as I

D = dt.date


def _rows(spark, n, days, seed):
    rng = random.Random(seed)
    data = [(D(2024, 1, 1) + dt.timedelta(days=rng.randrange(days)), rng.choice("ab"), rng.randrange(20_000), rng.choice([None, float("nan"), rng.random()])) for _ in range(n)]
    return spark.createDataFrame(data, "at date, kind string, entity long, x double")


def test_merged_days_stay_within_the_error(spark):
    rows = _rows(spark, 40_000, 20, 1)
    args = (["kind"], ["entity"], ["x"])
    got = {r.kind: r for r in I.estimates(I.merged(I.day_sketches(rows, "at", *args), *args), *args[1:]).collect()}
    whole = {r.kind: r for r in I.estimates(I.merged(I.day_sketches(rows.withColumn("at", F.lit("2024-01-01").cast("date")), "at", *args), *args), *args[1:]).collect()}
    want = {r.kind: r for r in I.exact(rows, "at", *args).collect()}
    for kind in "ab":
        g, w = got[kind], want[kind]
        assert (g.rows, g.days, g.first_day, g.last_day) == (w.rows, w.days, w.first_day, w.last_day)
        assert abs(g.entity_distinct - whole[kind].entity_distinct) < 0.05 * w.entity_distinct
        assert abs(g.entity_distinct - w.entity_distinct) < 4 * 1.04 / 2 ** (I.LG_K / 2) * w.entity_distinct
        assert abs(g.x_quantile - w.x_quantile) < 0.04  # uniform values: rank is value
        assert g.x_known == rows.where(F.col("kind") == kind).where("x is not null and not isnan(x)").count()


def test_a_new_day_costs_its_own_rows(spark, tmp_path):
    args = (["kind"], ["entity"], ["x"])
    path, rows = f"{tmp_path}/inv", _rows(spark, 3000, 6, 2)
    first = rows.where("at < '2024-01-05'")
    assert len(I.changed_days(first, "at", path)) == 4
    I.refresh(first, "at", I.changed_days(first, "at", path), path, *args)
    late = first.limit(1).withColumn("at", F.lit("2024-01-02").cast("date"))
    now = rows.unionByName(late)
    days = I.changed_days(now, "at", path)
    assert days == [D(2024, 1, 2), D(2024, 1, 5), D(2024, 1, 6)]
    files = lambda: {f: f.stat().st_mtime_ns for f in (tmp_path / "inv").rglob("*.parquet")}
    before = files()
    I.refresh(now, "at", days, path, *args)
    kept = {f for f, t in files().items() if before.get(f) == t}
    assert {f.parent.name for f in kept} == {"day=2024-01-01", "day=2024-01-03", "day=2024-01-04"}
    assert I.changed_days(now, "at", path) == []
    stored = I.merged(spark.read.parquet(path), *args).select("kind", "rows", F.hll_sketch_estimate("entity_distinct").alias("n"))
    fresh = I.merged(I.day_sketches(now, "at", *args), *args).select("kind", "rows", F.hll_sketch_estimate("entity_distinct").alias("n"))
    exact = {r.kind: r for r in I.exact(now, "at", *args).collect()}
    for r in [*stored.collect(), *fresh.collect()]:
        assert r.rows == exact[r.kind].rows and abs(r.n - exact[r.kind].entity_distinct) < 0.07 * exact[r.kind].entity_distinct
    running = {(r.kind, r.day): r.entity_distinct for r in I.running_inventory(spark.read.parquet(path), ["kind"], ["entity"]).collect()}
    assert abs(running["a", D(2024, 1, 6)] - exact["a"].entity_distinct) < 0.07 * exact["a"].entity_distinct
    assert I.day_sketches(rows.limit(0), "at", *args).count() == 0


def test_session_labels_from_sql(spark):
    T.register(spark)
    rows = [(e, D(2024, 1, 1) + dt.timedelta(days=n), n, float(n * (e + 1))) for e in range(2) for n in range(1, 31) if (n, e) not in {(9, 1), (25, 1)}]
    rows += [(2, D(2024, 1, 1), 1, -1.0), (2, D(2024, 1, 6), 6, 3.0), (2, D(2024, 1, 7), None, 3.0)]
    spark.createDataFrame(rows, "entity_id long, session_date date, session_no int, close double").createOrReplaceTempView("bars_t")
    got = {(r.entity_id, r.session_date, r.horizon): (r.target_date, r.expected) for r in spark.sql("SELECT * FROM session_labels(TABLE(bars_t) PARTITION BY entity_id ORDER BY session_no)").collect()}
    at = {(e, n): (day, c) for e, day, n, c in rows if n is not None}
    want = {}
    for (e, n), (day, c) in at.items():
        for h in T.HORIZONS:
            target = at.get((e, n + h))
            want[e, day, h] = (target and target[0], target[1] / c - 1 if target and c > 0 and target[1] > 0 else None)
    assert got == want
    few = spark.sql("SELECT DISTINCT horizon FROM session_labels(horizons => '1,3', bars => TABLE(SELECT * FROM bars_t) PARTITION BY entity_id ORDER BY session_no)").collect()
    assert sorted(r.horizon for r in few) == [1, 3]
    with pytest.raises(Exception, match="needs the columns"):
        spark.sql("SELECT * FROM session_labels(TABLE(SELECT entity_id FROM bars_t))")
