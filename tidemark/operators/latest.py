"""One row per key without a sort: ``min_by``/``max_by`` combine before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def best_row(df: DataFrame, keys: list[str], order: list[Column], pick: str = "max") -> DataFrame:
    """The row with the largest (or smallest) order tuple of each key.

    Nulls in the order tuple sort lowest.  The tuple must be unique within a
    key for the result to be the same on every run.
    """
    payload = F.struct(*[F.col(c) for c in df.columns if c not in keys])
    by = F.max_by if pick == "max" else F.min_by
    chosen = df.groupBy(*keys).agg(by(payload, F.struct(*order)).alias("_row"))
    return chosen.select(*keys, "_row.*").select(*df.columns)


def latest_row(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """Newest row of each key, ties broken by the later columns of ``order``."""
    return best_row(df, keys, [F.col(c) for c in order], "max")
