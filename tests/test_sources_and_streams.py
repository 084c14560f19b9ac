"""Sinks are idempotent, payload readers reject what they must, streams equal batches."""

import datetime as dt
import tempfile
import time

import pytest
from pyspark.sql import functions as F

from tidemark.sources import payloads as P
from tidemark.sources import sinks as K
from tidemark.streaming import jobs as J

D, TS = dt.date, dt.datetime


def test_first_observation_wins_and_repeats_add_nothing(spark):
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/t"
    a = spark.createDataFrame([(1, TS(2024, 1, 2), "late"), (1, TS(2024, 1, 1), "first"), (2, TS(2024, 1, 1), "x")], "id long, seen timestamp_ntz, v string")
    for _ in range(2):
        K.append_first(a, path, ["id"], ["seen"])
    assert sorted(map(tuple, spark.read.parquet(path).select("id", "v").collect())) == [(1, "first"), (2, "x")]


def test_replacement_needs_every_required_day(spark):
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/t"
    days = spark.createDataFrame([(D(2024, 1, 1),), (D(2024, 1, 2),)], "session_date date")
    r = spark.createDataFrame([(1, D(2024, 1, 1), 1.0), (1, D(2024, 1, 2), 2.0), (2, D(2024, 1, 1), 3.0), (3, D(2024, 1, 9), 3.0)], "entity_id long, session_date date, close double")
    bad = K.replace_entities(r, days, path)
    assert sorted(x[0] for x in bad.collect()) == [2, 3]
    assert {x["entity_id"] for x in spark.read.parquet(path).collect()} == {1}


def test_constituent_report(spark):
    cur = spark.createDataFrame([(f"T{i}",) for i in range(500)], "ticker string")
    good = spark.createDataFrame([(f"t{i}",) for i in range(3, 503)], "symbol string")
    assert P.constituents(good, cur).select("members", "duplicates", "added", "usable").first() == (500, 0, 3, True)
    assert not P.constituents(good.unionByName(good.limit(1)), cur).first()["usable"]


def test_agency_months_and_series(spark):
    d = spark.createDataFrame([(1, '[{"year":"2024","period":"M03","value":"1.5"},{"year":"2024","period":"M13","value":"9"},{"year":"2024","period":"M04","value":"-"}]')], "k int, p string")
    assert [tuple(r) for r in P.agency_months(d, ["k"], "p").collect()] == [(1, D(2024, 3, 1), 1.5)]
    s = spark.createDataFrame([("2024-01-01", TS(2024, 2, 1), "1", "."), ("2024-03-01", TS(2024, 2, 1), "2", "3")], "day string, seen timestamp_ntz, A string, B string")
    assert [tuple(r)[:3] for r in P.series_csv(s, ["A", "B"], "day", "seen").collect()] == [("A", D(2024, 1, 1), 1.0)]


def test_calendar_zone(spark):
    body = "BEGIN:VEVENT\r\nUID:7\r\nDTSTART;TZID=America/New_York:20240705T083000\r\nSUMMARY:Jobs\\, long\r\n  title\r\nEND:VEVENT"
    d = spark.createDataFrame([(1, body)], "k int, b string")
    assert P.calendar_events(d, ["k"], "b").first() == (1, "7", "Jobs, long title", TS(2024, 7, 5, 12, 30))


def test_report_dates(spark):
    d = spark.createDataFrame([("a.b", "2024-05-01"), ("A-B", "2024-04-01"), ("C", "n/a")], "symbol string, reportDate string")
    assert [tuple(r) for r in P.report_dates(d, ["symbol", "reportDate"]).collect()] == [("A-B", [D(2024, 4, 1), D(2024, 5, 1)])]


def test_stream_equals_batch_over_several_files(spark):
    src = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    schema = "event_id long, k long, ts timestamp, value double"
    t0 = TS(2024, 1, 1)
    data = [(i, i % 3, t0 + dt.timedelta(hours=i), float((i * 7) % 5)) for i in range(60)]
    for part in (data[:30], data[30:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    bars = J.run_to_end(J.bars(s.withColumn("one", F.lit(1)), ["k"], "ts", "value", "one"), "bars_t", "complete")
    got = {(r["k"], r["session_start"].date()): (r["open"], r["high"], r["low"], r["close"], r["volume"]) for r in bars.collect()}
    for (k, day), v in got.items():
        xs = [x for x in data if x[1] == k and x[2].date() == day]
        assert v == (xs[0][3], max(x[3] for x in xs), min(x[3] for x in xs), xs[-1][3], len(xs))
    assert len(got) == 9


def test_streams_read_folders_and_equal_the_batch(spark, tmp_path):
    from tidemark.plans import streams as ST
    from tidemark.plans.tables import Tables

    start = dt.datetime(2024, 1, 1)
    data = [(i, i % 3, "view", start + dt.timedelta(hours=i), None if i % 7 == 3 else float(i // 5)) for i in range(200)]
    schema = "event_id long, user_id long, event_type string, ts timestamp_ntz, value double"
    for k in range(4):  # several files, in the order of time
        spark.createDataFrame(data[50 * k : 50 * k + 50], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
        time.sleep(0.05)
    t = Tables(spark, str(tmp_path))
    assert ST.event_stream(t).isStreaming
    stored = {(r.event_id, r.value) for r in ST.stream_first_observations(t).collect()}
    assert stored == {(d[0], d[4]) for d in data}
    got = {r.event_id for r in ST.stream_change_versions(t).collect()}
    want, last = set(), {}
    for d in data:
        state = None if d[4] is None else int(d[4] // 25)
        if d[1] not in last or last[d[1]] != state:
            want.add(d[0])
        last[d[1]] = state
    assert got == want
    bars = {(r.day, r.volume) for r in ST.stream_bars(t).collect()}
    passed = data[-1][3] - dt.timedelta(hours=30)
    days = [d[3].date() for d in data]
    assert bars == {(x, days.count(x)) for x in set(days) if dt.datetime.combine(x, dt.time()) + dt.timedelta(days=1) <= passed}


def test_changes_after_a_batch_that_ends_in_null(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    big = 2**53 + 1
    batches = [[(1, 1, big), (2, 1, None)], [(3, 1, None), (4, 1, big)], [(5, 1, big), (6, 1, big + 1)]]
    kind = "event_id long, k int, x long, ts timestamp"
    for k, rows in enumerate(batches):
        frame = spark.createDataFrame([(i, key, x, start + dt.timedelta(hours=i)) for i, key, x in rows], kind)
        frame.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(1.1)  # the source takes files by time
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = J.run_to_end(J.change_versions(stream, {"k": "int"}, F.col("x"), "ts", "event_id"), "null_changes")
    assert sorted((r.event_id, r.state) for r in out.collect()) == [(1, big), (2, None), (4, big), (6, big + 1)]


def test_only_a_local_session_goes_without_a_shared_folder(spark, monkeypatch):
    from types import SimpleNamespace

    from tidemark import session

    far = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://host:7077", applicationId="x"))
    with pytest.raises(ValueError, match="share"):
        session.checkpoint_dir(far)
    assert session.checkpoint_dir(spark) == session.checkpoint_dir(spark)
    staged = session.stage(spark.range(3), "three")
    assert staged.count() == 3 and session.exists(spark, session.run_folder(spark))


def test_staged_tables_are_shared_until_a_table_changes(spark, tmp_path):
    from tidemark.plans.tables import Tables

    path = f"{tmp_path}/nation.parquet"
    spark.range(3).write.parquet(path)
    first, second = (Tables(spark, str(tmp_path)).shared("n", spark.read.parquet(path)) for _ in range(2))
    assert first.inputFiles() == second.inputFiles()
    spark.range(5).write.mode("append").parquet(path)
    third = Tables(spark, str(tmp_path)).shared("n", spark.read.parquet(path))
    assert third.count() == 8 and third.inputFiles() != first.inputFiles()
