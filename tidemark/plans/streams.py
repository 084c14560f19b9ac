"""The streaming jobs run over the whole events table with ``availableNow``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import r2
from tidemark.plans.ctes import rnd
from tidemark.plans.registry import query
from tidemark.plans.tables import Tables
from tidemark.session import is_folder, new_folder
from tidemark.streaming import jobs as J


#: Files of one micro-batch.
BATCH_FILES = 64


def event_stream(t: Tables, files: int = BATCH_FILES) -> DataFrame:
    """The events table as a stream, be it a folder of part files or one file, which its folder must then be filtered for."""
    path = f"{t.path}/events.parquet"
    reader = t.spark.readStream.schema(t.raw("events").schema).option("maxFilesPerTrigger", files)
    s = reader.parquet(path) if is_folder(t.spark, path) else reader.option("pathGlobFilter", "events.parquet").parquet(t.path)
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


def _drain(t: Tables, stream: DataFrame, name: str) -> DataFrame:
    """Run to the end into a parquet table of the shared folder and read that.

    Windows are appended once the watermark has passed their end, so those that
    end later than the newest event less the lateness stay in the state.
    """
    out, state = new_folder(t.spark, name), new_folder(t.spark, "state")
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append")
    with J.stateful(t.spark):
        q = q.trigger(availableNow=True).start()
    q.awaitTermination()
    return t.spark.read.schema(stream.schema).parquet(out)


_PASSED = "(SELECT max(ts) - INTERVAL 30 HOUR FROM events)"


@query("stream_bars", "X6", f"SELECT event_type, CAST(ts AS DATE) AS day, {rnd('arg_min(value, (ts, value))', 2)} AS open, {rnd('max(value)', 2)} AS high, {rnd('min(value)', 2)} AS low, {rnd('arg_max(value, (ts, value))', 2)} AS close, count(*) AS volume FROM events GROUP BY 1, 2 HAVING CAST(ts AS DATE) + INTERVAL 1 DAY <= {_PASSED}")
def stream_bars(t: Tables) -> DataFrame:
    s = J.bars(event_stream(t).withColumn("one", F.lit(1)), ["event_type"], "ts", "value", "one")
    d = _drain(t, s, "bars")
    return d.select("event_type", F.to_date("session_start").alias("day"), *[r2(c).alias(c) for c in ("open", "high", "low", "close")], F.col("volume").cast("long").alias("volume"))


@query("stream_rolling_counts", "X5", f"SELECT user_id, CAST(CAST(ts AS DATE) + CAST(i AS INTEGER) AS DATE) AS window_end, count(*) AS articles FROM events, range(1, 8) r(i) GROUP BY 1, 2 HAVING window_end <= {_PASSED}")
def stream_rolling_counts(t: Tables) -> DataFrame:
    d = _drain(t, J.rolling_counts(event_stream(t), ["user_id"], "ts", "value"), "counts")
    return d.select("user_id", F.to_date("window_end").alias("window_end"), "articles")


@query(
    "stream_run_sessions",
    "X8",
    """WITH m AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 195 MINUTE THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sid FROM m)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 195 MINUTE AS overdue_from, count(*) AS runs FROM s GROUP BY user_id, sid HAVING max(ts) + INTERVAL 195 MINUTE <= (SELECT max(ts) - INTERVAL 30 HOUR FROM events)""",
)
def stream_run_sessions(t: Tables) -> DataFrame:
    """Each user's events stand for the runs of a pipeline; every silence of 195 minutes is reported once the watermark has passed it."""
    d = _drain(t, J.overdue_runs(event_stream(t), {"user_id": "long"}, "ts"), "sessions")
    return d.select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), F.col("overdue_from").cast("timestamp_ntz").alias("overdue_from"), "runs")


@query(
    "stream_change_versions",
    "X3",
    "SELECT event_id, user_id, event_type FROM (SELECT *, CAST(floor(value / 25) AS BIGINT) AS state, lag(CAST(floor(value / 25) AS BIGINT)) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS prev FROM events) WHERE state IS DISTINCT FROM prev",
)
def stream_change_versions(t: Tables) -> DataFrame:
    """By a lag inside each micro-batch; ``J.change_versions`` gives the same rows by state and timers of single keys."""
    out, held, state = (new_folder(t.spark, x) for x in ("versions", "held", "state"))
    write = J.change_versions_writer(out, held, ["user_id", "event_type"], F.floor(F.col("value") / 25), "ts", "event_id")
    event_stream(t).writeStream.foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.schema("event_id long, user_id long, event_type string").parquet(out).select("event_id", "user_id", "event_type")


@query("stream_first_observations", "X1 X2", "SELECT event_id, user_id, event_type, ts, value FROM events")
def stream_first_observations(t: Tables) -> DataFrame:
    """Every event arrives twice; each is stored once."""
    s = event_stream(t)
    twice = s.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1)))).drop("copy")
    kept_at, state = new_folder(t.spark, "kept"), new_folder(t.spark, "state")
    kept = J.observations(twice, "ts", ["event_id"])
    q = kept.writeStream.foreachBatch(J.first_wins_writer(kept_at, ["event_id"], ["ts"])).option("checkpointLocation", state).outputMode("append")
    q.trigger(availableNow=True).start().awaitTermination()
    stored = t.spark.read.schema(kept.schema).parquet(kept_at)
    return stored.select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp_ntz").alias("ts"), "value")


@query(
    "stream_guidance_join",
    "X7",
    "SELECT g.event_id AS guidance_id, count(*) AS matches FROM events g JOIN events e ON e.user_id = g.user_id AND e.event_type = 'view' AND e.ts < g.ts AND e.ts >= g.ts - INTERVAL 7 DAY WHERE g.event_type = 'purchase' GROUP BY 1",
)
def stream_guidance_join(t: Tables) -> DataFrame:
    s = event_stream(t)
    g = s.where(F.col("event_type") == "purchase").select(F.col("user_id").alias("entity_id"), F.col("event_id").alias("guidance_id"), F.col("ts").alias("published_at"))
    e = s.where(F.col("event_type") == "view").select(F.col("user_id").alias("entity_id"), F.col("event_id").alias("estimate_id"), F.col("ts").alias("captured_at"), F.col("value").alias("consensus"))
    d = _drain(t, J.matched_guidance(g, e), "pairs")
    return d.groupBy("guidance_id").agg(F.count("*").alias("matches"))


@query("stream_membership", "X9", "SELECT event_type, count(*) AS n FROM events WHERE CAST(ts AS DATE) >= DATE '2024-01-01' + CAST(user_id % 10 AS INTEGER) AND (user_id % 3 = 0 OR CAST(ts AS DATE) < DATE '2024-01-20') GROUP BY 1")
def stream_membership(t: Tables) -> DataFrame:
    users = t.raw("events").select("user_id").distinct()
    start = F.expr("date_add(date'2024-01-01', cast(user_id % 10 as int))")
    m = users.select("user_id", start.alias("effective_from"), F.when(F.col("user_id") % 3 != 0, F.lit("2024-01-20").cast("date")).alias("effective_to"))
    s = event_stream(t).withColumn("day", F.to_date("ts"))
    return _drain(t, J.enriched(s, m, "user_id", "day"), "members").groupBy("event_type").agg(F.count("*").alias("n"))


@query("stream_availability", "X4", "SELECT event_type, count(*) AS n, count(*) FILTER (WHERE event_id % 4 = 0) AS late FROM events GROUP BY 1")
def stream_availability(t: Tables) -> DataFrame:
    s = event_stream(t).withColumn("observed_at", F.col("ts") + F.expr("make_dt_interval(0, cast(if(event_id % 4 = 0, 26, 0) as int))"))
    d = _drain(t, J.with_availability(s, "ts", "observed_at"), "available")
    return d.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("available_at") > F.col("ts")).alias("late"))
