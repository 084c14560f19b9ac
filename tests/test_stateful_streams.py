"""Timers, dropped state and restarts of the stateful streaming jobs."""

import datetime as dt
import random
import time

from pyspark.sql import functions as F

from tidemark.streaming import jobs as J

T0 = dt.datetime(2024, 1, 1)
KIND = "event_id long, k int, x long, ts timestamp"


def _at(hours):
    return T0 + dt.timedelta(hours=hours)


def _put(spark, path, rows):
    time.sleep(1.1)  # the source takes files by time
    spark.createDataFrame([(i, k, x, None if h is None else _at(h)) for i, k, x, h in rows], KIND).coalesce(1).write.mode("append").parquet(f"{path}/in")


def _stream(spark, path):
    return spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")


def _drained(stream, path):
    """One run up to the end of what is there, from where the last one stopped."""
    with J.stateful(stream.sparkSession):
        q = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/out")


def test_silence_is_reported_without_a_next_row_and_over_a_restart(spark, tmp_path):
    job = lambda: J.overdue_runs(_stream(spark, tmp_path), {"k": "int"}, "ts", lateness="0 seconds")
    shown = lambda df: sorted((r.k, r.session_start, r.overdue_from, r.runs, r.last_started_at) for r in df.collect())
    gap = dt.timedelta(minutes=195)
    # Pipeline 1 runs at 0 and 1 o'clock and then never again; pipeline 2 moves time on.
    _put(spark, tmp_path, [(1, 1, 0, 1), (2, 1, 0, 0), (3, 2, 0, 10), (4, 3, 0, None), (5, None, 0, 2)])
    first = [(1, _at(0), _at(1) + gap, 2, _at(1))]
    lone = (None, _at(2), _at(2) + gap, 1, _at(2))
    got = sorted(((r.k, r.session_start, r.overdue_from, r.runs, r.last_started_at) for r in _drained(job(), tmp_path).collect()), key=str)
    assert got == sorted([*first, lone], key=str)
    # After a restart the open session of 2 goes on; 1 starts anew and falls silent again.
    _put(spark, tmp_path, [(6, 2, 0, 12), (7, 1, 0, 12), (8, 9, 0, 30)])
    now = shown(_drained(job(), tmp_path).where("k IS NOT NULL"))
    assert now == [*first, (1, _at(12), _at(12) + gap, 1, _at(12)), (2, _at(10), _at(12) + gap, 2, _at(12))]


def test_late_runs_join_sessions_and_move_the_timer(spark, tmp_path):
    _put(spark, tmp_path, [(1, 1, 0, 0), (2, 1, 0, 6)])
    _put(spark, tmp_path, [(3, 1, 0, 3), (4, 2, 0, 7)])  # within the lateness: 0, 3 and 6 are one session
    _put(spark, tmp_path, [(5, 2, 0, 60)])
    out = _drained(J.overdue_runs(_stream(spark, tmp_path), {"k": "int"}, "ts", lateness="30 hours"), tmp_path)
    assert sorted((r.k, r.session_start, r.runs) for r in out.collect()) == [(1, _at(0), 3), (2, _at(7), 1)]


def test_sessions_by_event_time_take_no_python_and_split_at_the_gap(spark, tmp_path):
    gap = dt.timedelta(minutes=195)
    _put(spark, tmp_path, [(1, 1, 0, 0), (2, 1, 0, 3.25), (3, 2, 0, 0), (4, 2, 0, 3.2499), (5, None, 0, 1), (6, 9, 0, 90)] + [(7 + i, 3, 0, 4 * (i % 10)) for i in range(500)])
    stream = J.overdue_runs(_stream(spark, tmp_path), {"k": "int"}, "ts")
    plan = stream._jdf.queryExecution().analyzed().toString()
    assert "session_window" in plan and "TransformWithState" not in plan
    got = {(r.k, r.session_start, r.overdue_from - r.last_started_at, r.runs) for r in _drained(stream, tmp_path).collect()}
    assert got == {(1, _at(0), gap, 1), (1, _at(3.25), gap, 1), (2, _at(0), gap, 2), (None, _at(1), gap, 1)} | {(3, _at(4 * i), gap, 50) for i in range(10)}


def test_silence_by_the_clock_needs_no_row_at_all(spark, tmp_path):
    _put(spark, tmp_path, [(1, 1, 0, 0), (2, 1, 0, 0.0001)])
    stream = J.overdue_runs(_stream(spark, tmp_path), {"k": "int"}, "ts", gap="3 seconds", clock=True)
    with J.stateful(spark):
        q = stream.writeStream.format("memory").queryName("clock_t").option("checkpointLocation", f"{tmp_path}/state").trigger(processingTime="1 second").start()
    try:
        until = time.time() + 90
        while time.time() < until and not spark.table("clock_t").count():
            time.sleep(1)
    finally:
        q.stop()
    assert [(r.k, r.runs) for r in spark.table("clock_t").collect()] == [(1, 2)]


def test_idle_keys_are_forgotten(spark, tmp_path):
    job = lambda: J.change_versions(_stream(spark, tmp_path), {"k": "int"}, F.col("x"), "ts", "event_id", idle="2 hours", lateness="0 seconds")
    _put(spark, tmp_path, [(1, 1, 5, 0), (2, 2, 5, 4.5), (3, 3, None, 5)])
    assert sorted(r.event_id for r in _drained(job(), tmp_path).collect()) == [1, 2, 3]
    held = spark.read.format("statestore").option("path", f"{tmp_path}/state").option("stateVarName", "last").load()
    assert sorted(r.key.k for r in held.collect()) == [2, 3]  # 1 is gone before it comes again
    _put(spark, tmp_path, [(4, 1, 5, 6), (5, 2, 5, 6), (6, 3, None, 6), (7, 3, 5, 6.5), (8, 2, 5, 20), (9, 9, 0, 30)])
    assert sorted(r.event_id for r in _drained(job(), tmp_path).collect()) == [1, 2, 3, 4, 7, 8, 9]


def test_versions_by_a_lag_equal_those_by_state(spark, tmp_path):
    rng = random.Random(2)
    for n in range(3):  # late rows, ties, nulls and keys that fall silent
        _put(spark, tmp_path, [(100 * n + i, rng.choice([None, 1, 2, 3]), rng.choice([None, 0, 1]), rng.choice([None, *range(8 * n, 8 * n + 14)])) for i in range(40)])
    _put(spark, tmp_path, [(999, 3, 0, 60), (998, 1, 1, 21), (997, 2, None, 59)])
    want = _drained(J.change_versions(_stream(spark, tmp_path), {"k": "int"}, F.col("x"), "ts", "event_id", idle="5 hours", lateness="6 hours"), tmp_path)
    write = J.change_versions_writer(f"{tmp_path}/versions", f"{tmp_path}/held", ["k"], F.col("x"), "ts", "event_id", idle="5 hours", lateness="6 hours")
    for _ in range(2):  # a repeated run of all batches adds nothing
        _stream(spark, tmp_path).writeStream.foreachBatch(write).option("checkpointLocation", f"{tmp_path}/again{_}").trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/versions").select(want.columns)
    shown = lambda df: sorted(map(str, df.collect()))
    assert shown(got) == shown(want) and got.count() > 20
    assert {r.k for r in spark.read.parquet(f"{tmp_path}/held/batch=3").collect()} == {2, 3}


def test_the_store_is_chosen_for_the_start_only(spark):
    before = spark.conf.get(J._STORE)
    with J.stateful(spark):
        assert "RocksDB" in spark.conf.get(J._STORE)
    assert spark.conf.get(J._STORE) == before
