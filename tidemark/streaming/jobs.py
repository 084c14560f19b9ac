"""Streams of observations: event time from the source, arrival as observed time.

State is keyed, so Spark spreads it over the shuffle partitions.  Windowed and
deduplicating jobs drop state behind the watermark, which must be longer than
the longest lateness that still counts.  Change capture keeps one value per key
and forgets keys that were silent for longer than a bound; the overdue monitor
keeps open sessions only.  Both need the state store that ``stateful`` chooses
when they are started.  Sources bound a micro-batch
(``maxFilesPerTrigger``, ``maxOffsetsPerTrigger``), which also bounds the rows
of one key in it.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators.latest import best_row

LATENESS = "30 hours"
_STORE = "spark.sql.streaming.stateStore.providerClass"


@contextlib.contextmanager
def stateful(spark: SparkSession) -> Iterator[None]:
    """Start a stateful job inside: it takes the store that holds value, list and timer state; the session stays as it was."""
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(_STORE) if before is None else spark.conf.set(_STORE, before)


def observations(raw: DataFrame, event_time: str, keys: list[str], lateness: str = LATENESS) -> DataFrame:
    """Overlapping re-reads collapse to the first copy of each key."""
    return raw.withWatermark(event_time, lateness).dropDuplicatesWithinWatermark(keys)


def with_availability(df: DataFrame, published: str, observed: str) -> DataFrame:
    """A late row is usable from its arrival; it never reaches back into closed decisions."""
    return df.withColumn("available_at", F.greatest(F.col(observed), F.coalesce(F.col(published), F.col(observed))))


def bars(ticks: DataFrame, by: list[str], time: str, price: str, size: str, width: str = "1 day", lateness: str = LATENESS) -> DataFrame:
    """Open, high, low, close and volume per tumbling window."""
    order = F.struct(F.col(time), F.col(price))
    return (
        ticks.withWatermark(time, lateness)
        .groupBy(*by, F.window(time, width))
        .agg(
            F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, order).alias("close"), F.sum(size).alias("volume")
        )
        .select(*by, F.col("window.start").alias("session_start"), "open", "high", "low", "close", "volume")
    )


def rolling_counts(df: DataFrame, by: list[str], time: str, value: str, width: str = "7 days", step: str = "1 day", lateness: str = LATENESS) -> DataFrame:
    """Sliding counts and the mean over the rows that state a value."""
    return (
        df.withWatermark(time, lateness)
        .groupBy(*by, F.window(time, width, step))
        .agg(F.count("*").alias("articles"), F.count(value).alias("with_value"), F.avg(value).alias("mean_value"))
        .select(*by, F.col("window.end").alias("window_end"), "articles", "with_value", "mean_value")
    )


def _seconds(interval: str) -> int:
    n, unit = interval.split()
    return int(n) * {"second": 1, "minute": 60, "hour": 3600, "day": 86_400}[unit.rstrip("s")]


class _Overdue(StatefulProcessor):
    """Open activity sessions of a key as (start, last, runs), and a timer by the clock at the end of each."""

    def __init__(self, names: list[str], gap: int):
        self._row, self._gap = Row(*names, "session_start", "overdue_from", "runs", "last_started_at"), gap * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._open = handle.getListState("open", "start long, last long, runs long, due long")

    def _sessions(self) -> list[tuple[int, int, int, int]]:
        return [tuple(x) for x in self._open.get()] if self._open.exists() else []

    def _held(self, sessions: list[tuple[int, int, int, int]]) -> None:
        self._open.put(sessions) if sessions else self._open.clear()

    def handleInputRows(self, key, rows, timerValues):
        now = timerValues.getCurrentProcessingTimeInMs()
        before = self._sessions()
        merged: list[tuple[int, int, int, int]] = []
        for start, last, runs, due in sorted([*before, *((int(r.at), int(r.at), 1, -1) for r in rows)]):
            if merged and start < merged[-1][1] + self._gap:
                s, m, n, d = merged[-1]
                merged[-1] = (s, max(m, last), n + runs, d if last <= m else due)
            else:
                merged.append((start, last, runs, due))
        # A session that grew is due anew, the gap after its arrival; timers know milliseconds.
        merged = [(s, m, n, d if (s, m, n, d) in before else -(-(1000 * now + self._gap) // 1000)) for s, m, n, d in merged]
        old, new = {x[3] for x in before}, {x[3] for x in merged}
        for due in old - new:
            self._handle.deleteTimer(due)
        for due in new - old:
            self._handle.registerTimer(due)
        self._held(merged)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        at = expiredTimerInfo.getExpiryTimeInMs()
        sessions = self._sessions()
        self._held([x for x in sessions if x[3] > at])
        for start, last, runs, due in sessions:
            if due <= at:
                yield self._row(*key, start, last + self._gap, runs, last)


def overdue_runs(runs: DataFrame, by: dict[str, str], time: str, gap: str = "195 minutes", lateness: str = LATENESS, clock: bool = False) -> DataFrame:
    """A row for each activity session that ended in silence: (*by, session_start, overdue_from, runs, last_started_at).

    Runs less than ``gap`` apart are one session.  It is reported without a
    next row of its key: once the watermark, which the rows of any key move
    on, has passed its last run plus ``gap``, or, by ``clock``, by a timer once
    the machine's time is ``gap`` past the arrival of that run, even if no row
    comes at all.  A run that comes in time extends its session, or joins two;
    only open sessions are held.  A null time is no run; null keys are a key.
    Start it inside ``stateful``.

    By event time these are Spark's session windows, one state row per open
    session, whatever their number in a key.
    """
    d = runs.where(F.col(time).isNotNull()).withColumn(time, F.col(time).cast("timestamp"))
    micros = _seconds(gap) * 1_000_000
    found = ("session_start", "overdue_from", "runs", "last_started_at")
    if clock:
        kinds = ", ".join(f"{n} {k}" for n, k in by.items())
        out = d.select(*by, F.unix_micros(time).alias("at")).groupBy(*by).transformWithState(
            _Overdue(list(by), _seconds(gap)), f"{kinds}, session_start long, overdue_from long, runs long, last_started_at long", "append", "ProcessingTime"
        )
        return out.select(*by, *[F.timestamp_micros(c).alias(c) if c != "runs" else F.col(c) for c in found])
    # Windows that touch are one session in Spark; a run exactly the gap later begins another here, so they end a microsecond early.
    window = F.session_window(time, f"{micros - 1} microseconds")
    out = d.withWatermark(time, lateness).groupBy(*by, window.alias("_w")).agg(F.count("*").alias("runs"), F.max(time).alias("last_started_at"))
    start, end = F.col("_w.start").alias(found[0]), F.timestamp_micros(F.unix_micros("last_started_at") + micros).alias(found[1])
    return out.select(*by, start, end, "runs", "last_started_at")


class _Versions(StatefulProcessor):
    """The last state of a key and when it was stated; a timer drops it when the key stays silent for ``idle`` milliseconds."""

    def __init__(self, names: list[str], idle: int):
        self._row, self._idle = Row(*names), 1000 * idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._last = handle.getValueState("last", "state string, missing boolean, at long")

    def handleInputRows(self, key, rows, timerValues):
        last = tuple(self._last.get()) if self._last.exists() else None
        due = None if last is None else self._due(last[2])
        for r in sorted(rows, key=lambda r: (r.at, r.identity)):
            state = ("", True) if r.state is None else (r.state, False)
            if last is None or state != last[:2] or r.at - last[2] > self._idle:
                yield self._row(*key, r.identity, r.time, r.state)
            last = (*state, r.at if last is None else max(last[2], r.at))
        self._last.update(last)
        if due != self._due(last[2]):
            if due is not None:
                self._handle.deleteTimer(due)
            self._handle.registerTimer(self._due(last[2]))

    def _due(self, at: int) -> int:
        return (at + self._idle) // 1000 + 1

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self._last.clear()
        return iter(())


def change_versions(df: DataFrame, keys: dict[str, str], state: Column, time: str, identity: str, idle: str = "400 days", lateness: str = LATENESS) -> DataFrame:
    """Emit a row only when its state differs from the key's previous one (A, B, A keeps all three).

    ``keys``: key columns and their types.  Only the last state is held per
    key, null among them; rows of one micro-batch are taken in event order, and
    those behind the watermark or without a time come too late.  A key without
    a row for more than ``idle`` of event time is forgotten, by a timer where
    no next row comes: the next row is a first version.  Start it inside ``stateful``.
    """
    key_schema = ", ".join(f"{n} {k}" for n, k in keys.items())
    d = df.where(F.col(time).isNotNull()).withColumn("time", F.col(time).cast("timestamp")).withWatermark("time", lateness)
    # States travel as text, so that each kind has one form.
    d = d.select(*keys, F.col(identity).alias("identity"), "time", F.unix_micros("time").alias("at"), state.cast("long").cast("string").alias("state"))
    out = d.groupBy(*keys).transformWithState(_Versions([*keys, identity, time, "state"], 1000 * _seconds(idle)), f"{key_schema}, {identity} long, {time} timestamp, state string", "append", "EventTime")
    return out.withColumn("state", F.col("state").cast("long"))


def change_versions_writer(path: str, held: str, keys: list[str], state: Column, time: str, identity: str, idle: str = "400 days", lateness: str = LATENESS):
    """``foreachBatch`` sink: the rows that ``change_versions`` emits, by a lag inside each micro-batch.

    Versions of batch n go to ``path/batch=n``, the last state of each key that
    is not idle behind the watermark to ``held/batch=n``, which the next batch
    reads.  A repeated batch overwrites both, so the sink is idempotent.  A
    micro-batch is one sort by key, without Python or a timer per key.
    """
    late, quiet = _seconds(lateness) * 1_000_000, _seconds(idle) * 1_000_000

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        d = batch.where(F.col(time).isNotNull()).withColumn(time, F.col(time).cast("timestamp"))
        d = d.select(*keys, F.col(identity), F.col(time), F.unix_micros(time).alias("_at"), state.cast("long").alias("state"), F.lit(False).alias("_held"))
        newest = None
        if batch_id:
            before = spark.read.parquet(f"{held}/batch={batch_id - 1}")
            newest = spark.read.parquet(f"{held}_newest/batch={batch_id - 1}").first()["at"]
            if newest is not None:
                # Spark's watermark knows milliseconds.
                d = d.where(F.col("_at") > newest // 1000 * 1000 - late)
        newest = max((x for x in (newest, d.agg(F.max("_at")).first()[0]) if x is not None), default=None)
        spark.createDataFrame([(newest,)], "at long").write.mode("overwrite").parquet(f"{held}_newest/batch={batch_id}")
        if batch_id:
            d = d.unionByName(before.select(*keys, F.lit(None).cast(d.schema[identity].dataType).alias(identity), F.timestamp_micros("_at").alias(time), "_at", "state", F.lit(True).alias("_held")))
        # The state held comes first in its key, whatever its time; a late row leaves the newest time as it is.
        w = Window.partitionBy(*keys).orderBy(F.col("_held").desc(), "_at", identity)
        seen = d.select("*", F.lag(F.struct("state")).over(w).alias("_last"), F.max("_at").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("_seen"))
        new = F.col("_last").isNull() | ~F.col("_last.state").eqNullSafe(F.col("state")) | (F.col("_at") - F.col("_seen") > quiet)
        seen.where(~F.col("_held") & new).select(*keys, identity, time, "state").write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        last = d.groupBy(*keys).agg(F.max_by(F.struct("state"), F.struct(~F.col("_held"), "_at", identity)).alias("_row"), F.max("_at").alias("_at"))
        last = last.select(*keys, F.col("_row.state").alias("state"), "_at")
        (last if newest is None else last.where(F.col("_at") + quiet >= newest // 1000 * 1000 - late)).write.mode("overwrite").parquet(f"{held}/batch={batch_id}")

    return write


def matched_guidance(guidance: DataFrame, estimates: DataFrame, days: int = 7, lateness: str = LATENESS) -> DataFrame:
    """Each guidance row with the estimates captured in the days before its publication."""
    g = guidance.withWatermark("published_at", lateness).alias("g")
    e = estimates.withWatermark("captured_at", lateness).alias("e")
    on = (
        (F.col("g.entity_id") == F.col("e.entity_id"))
        & (F.col("e.captured_at") < F.col("g.published_at"))
        & (F.col("e.captured_at") >= F.col("g.published_at") - F.expr(f"interval {days} days"))
    )
    return g.join(e, on).select("g.entity_id", "g.guidance_id", "g.published_at", "e.estimate_id", "e.captured_at", "e.consensus")


def enriched(stream: DataFrame, members: DataFrame, key: str, day: str) -> DataFrame:
    """Stream rows that fall into a half-open membership interval of a static table."""
    m = members.select(F.col(key).alias("_k"), "effective_from", "effective_to")
    inside = (F.col(key) == F.col("_k")) & (F.col("effective_from") <= F.col(day)) & (F.col("effective_to").isNull() | (F.col(day) < F.col("effective_to")))
    return stream.join(m, inside, "left_semi")


def first_wins_writer(path: str, keys: list[str], order: list[str]):
    """``foreachBatch`` sink: a key is stored once, and a repeated batch adds nothing."""
    from tidemark.sources.sinks import append_first

    def write(batch: DataFrame, _: int) -> None:
        append_first(batch, path, keys, order)

    return write


def newest_wins_writer(path: str, keys: list[str], order: list[str]):
    """``foreachBatch`` sink: one parquet folder per batch id, the newest row per key on read.

    A repeated batch overwrites its own folder, so the sink is idempotent.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        best_row(batch, keys, [F.col(c) for c in order], "max").write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def run_to_end(stream: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """Process everything available now into a memory table and return it (tests and small jobs)."""
    w = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    if checkpoint:
        w = w.option("checkpointLocation", checkpoint)
    with stateful(stream.sparkSession):
        q = w.start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
