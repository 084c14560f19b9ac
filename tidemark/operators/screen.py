"""Correlation of many series in blocks, and the greedy choice that it and other limits leave."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import stage

#: Joint observations of a correlation, the least of them, and the correlation that keeps a candidate out.
OBSERVATIONS, LEAST, LIMIT = 60, 40, 0.85


def _matrix(table: pa.Table, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entities in order and their values by time, NaN where there is none."""
    entity, time, value = (table[c].to_numpy() for c in ("entity", "time", "value"))
    names, row = np.unique(entity, return_inverse=True)
    out = np.full((len(names), len(times)), np.nan)
    out[row, np.searchsorted(times, time)] = value
    return names, out


def _last_joint(x: np.ndarray, others: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Observations and correlation of one series with each of others over their last ``window`` common times."""
    width = 2 * window
    while True:
        a, b = x[-width:], others[:, -width:]
        both = ~np.isnan(a) & ~np.isnan(b)
        kept = both & (both[:, ::-1].cumsum(axis=1)[:, ::-1] <= window)
        n = kept.sum(axis=1)
        if width >= len(x) or (n == window).all():
            break
        width *= 2
    with np.errstate(invalid="ignore", divide="ignore"):
        p, q = np.where(kept, a, 0.0), np.where(kept, b, 0.0)
        p, q = np.where(kept, p - (p.sum(axis=1) / n)[:, None], 0.0), np.where(kept, q - (q.sum(axis=1) / n)[:, None], 0.0)
        return n, (p * q).sum(axis=1) / np.sqrt((p * p).sum(axis=1) * (q * q).sum(axis=1))


def _correlator(as_of: list[int], window: int, least: int, history: int | None) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], [], []]
        if left.num_rows and right.num_rows:
            times = np.unique(np.concatenate((left["time"].to_numpy(), right["time"].to_numpy())))
            (names, x), (others, y) = _matrix(left, times), _matrix(right, times)
            for at in as_of:
                lo, hi = 0 if history is None else np.searchsorted(times, at - history, side="right"), np.searchsorted(times, at, side="right")
                for i, name in enumerate(names):
                    row = np.arange(i + 1 if key[0] == key[1] else 0, len(others))
                    if not len(row) or lo == hi:
                        continue
                    n, c = _last_joint(x[i, lo:hi], y[row, lo:hi], window)
                    c = np.where((n >= least) & np.isfinite(c), np.clip(c, -1, 1), np.nan)
                    for column, values in zip(out, (np.full(len(row), at), np.minimum(name, others[row]), np.maximum(name, others[row]), n, c)):
                        column.append(values)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
        columns = [pa.array(np.concatenate(c) if c else [], t, from_pandas=True) for c, t in zip(out, kinds)]
        return pa.table(columns, names=["as_of", "left_id", "right_id", "n", "correlation"])

    return run


def pair_correlations(returns: DataFrame, as_of: list[int], entity: str = "entity_id", time: str = "session_no", value: str = "return_1", window: int = OBSERVATIONS, least: int = LEAST, block: int = 256, history: int | None = None) -> DataFrame:
    """(as_of, left_id, right_id, n, correlation) of all pairs of entities, left below right, at each of the times ``as_of``.

    Over the pair's last ``window`` common times up to then; null with fewer
    than ``least`` or without variation; pairs for which no time up to then is
    known have no row.  Entities are dealt into blocks of about ``block``; two
    blocks meet in a task and are multiplied row by block, so a task holds two
    blocks of series, one value per session.  ``history`` bounds how far back a
    common time may lie; null, NaN and infinite values are no observations, and
    of a repeated (entity, time) the largest value counts.
    """
    v = F.col(value).cast("double")
    rows = returns.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))).groupBy(F.col(entity).cast("long").alias("entity"), F.col(time).cast("long").alias("time")).agg(F.max(v).alias("value")).dropna()
    rows = stage(rows, "returns")
    blocks = max(1, -(-rows.select("entity").distinct().count() // block))
    mine = F.pmod(F.xxhash64("entity"), F.lit(blocks)).cast("int")
    own = [F.col(c).alias(c) for c in ("entity", "time", "value")]
    left = rows.select("entity", "time", "value", mine.alias("a"), F.explode(F.sequence(mine, F.lit(blocks - 1))).alias("b"))
    right = rows.select(*own, mine.alias("b"), F.explode(F.sequence(F.lit(0), mine)).alias("a"))
    run = _correlator(sorted(set(as_of)), window, least, history)
    return left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInArrow(run, "as_of long, left_id long, right_id long, n long, correlation double")


def conflicts(correlations: DataFrame, limit: float = LIMIT) -> DataFrame:
    """Pairs that must not be held together: correlated at the limit or above, or not known not to be."""
    return correlations.where(F.col("correlation").isNull() | (F.col("correlation") >= limit))


def greedy_choice(candidates: DataFrame, conflict: DataFrame, by: list[str], order: list[Column], entity: str = "entity_id", sector: str = "sector", per_sector: int | None = None, most: int | None = None) -> DataFrame:
    """Candidates that going down the order would take: no conflict with one taken before, at most ``per_sector`` of a sector, ``most`` in all.

    In rounds over all groups at once: a candidate is settled when nothing
    undecided ahead of it can still matter.  It falls when one ahead that is
    taken conflicts with it or its sector is full, and is taken when no
    undecided one ahead conflicts and its sector has room for it and all those
    undecided ahead.  The first undecided one of a group settles in every round, so the
    rounds end; those past ``most`` are cut at the end, as they can't change
    what is ahead.  ``conflict``: the group's columns, left_id, right_id.  A null
    sector is no sector and never taken.  ``order`` must be total.
    """
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    state = stage(candidates.where(F.col(sector).isNotNull()).select(*candidates.columns, rank.alias("_rank"), F.lit(None).cast("boolean").alias("_taken")), "candidates")
    seats = state.select(*by, F.col(entity).alias("_e"), F.col("_rank").alias("_r"))
    both = conflict.select(*by, F.col("left_id").alias("_e"), F.col("right_id").alias("_o")).unionByName(conflict.select(*by, F.col("right_id").alias("_e"), F.col("left_id").alias("_o")))
    # (later, earlier) in each group: only the one ahead matters to the one behind.
    ahead = both.join(seats, [*by, "_e"]).join(seats.withColumnsRenamed({"_e": "_o", "_r": "_ro"}), [*by, "_o"]).where("_ro < _r").select(*by, "_r", "_ro").distinct()
    ahead = stage(ahead, "ahead")
    w = Window.partitionBy(*by, sector).orderBy("_rank").rowsBetween(Window.unboundedPreceding, -1)
    while True:
        known = state.select(*by, F.col("_rank").alias("_ro"), F.col("_taken").alias("_t"))
        met = ahead.join(known, [*by, "_ro"]).groupBy(*by, F.col("_r").alias("_rank")).agg(F.count_if("_t").alias("_hit"), F.count_if(F.col("_t").isNull()).alias("_open"))
        d = state.join(met, [*by, "_rank"], "left").withColumns({"_held": F.count_if("_taken").over(w), "_waits": F.count_if(F.col("_taken").isNull()).over(w)})
        hit, free = F.coalesce(F.col("_hit"), F.lit(0)) > 0, F.coalesce(F.col("_open"), F.lit(0)) == 0
        full, room = (F.lit(False), F.lit(True)) if per_sector is None else (F.col("_held") >= per_sector, F.col("_held") + F.col("_waits") < per_sector)
        now = F.when(F.col("_taken").isNotNull(), F.col("_taken")).when(hit | full, False).when(free & room, True)
        state = stage(d.select(*candidates.columns, "_rank", now.alias("_taken")), "candidates")
        if state.where("_taken IS NULL").isEmpty():
            break
    taken = state.where("_taken").withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy("_rank")))
    return (taken if most is None else taken.where(F.col("rank") <= most)).drop("_rank", "_taken")
