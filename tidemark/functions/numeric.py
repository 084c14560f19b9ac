"""Null-preserving numeric expressions: a missing or non-finite input stays missing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_INF = float("inf")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: Column | str) -> Column:
    """Cast to double; text that is no number, NaN and the infinities become null."""
    d = _col(c).try_cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) < F.lit(_INF)), d)


def positive(c: Column | str) -> Column:
    d = finite(c)
    return F.when(d > 0, d)


def ratio(a: Column | str, b: Column | str) -> Column:
    """``a / b`` only for a denominator above zero."""
    b = _col(b)
    return F.when(b > 0, _col(a) / b)


def simple_return(before: Column | str, after: Column | str) -> Column:
    before = _col(before)
    return F.when(before != 0, _col(after) / before - 1)


def growth(cur: Column | str, prev: Column | str) -> Column:
    """``cur / prev - 1`` only for a previous value above zero."""
    prev = _col(prev)
    return F.when(prev > 0, _col(cur) / prev - 1)


def relative_change(a: Column | str, b: Column | str) -> Column:
    """Change against the magnitude of the base, so a negative base keeps its sign."""
    b = _col(b)
    return F.when(b != 0, (_col(a) - b) / F.abs(b))


def clip(c: Column | str, lo: float, hi: float) -> Column:
    """Bounded value; ``greatest``/``least`` skip nulls, so nulls are kept by hand."""
    c = _col(c)
    return F.when(c.isNotNull(), F.least(F.lit(hi), F.greatest(F.lit(lo), c)))


def revision(cur: Column | str, prev: Column | str) -> Column:
    return clip(relative_change(cur, prev), -2.0, 2.0)


def percent_to_decimal(c: Column | str) -> Column:
    return clip(_col(c) / 100.0, -2.0, 2.0)


def midpoint(lo: Column | str, hi: Column | str) -> Column:
    """Middle of a range, or the one bound that is known."""
    lo, hi = _col(lo), _col(hi)
    return F.coalesce((lo + hi) / 2, lo, hi)


def weighted_available(parts: list[tuple[Column, float]]) -> tuple[Column, Column]:
    """Mean of the non-null values with their weights renormalised, and the weight in use."""
    weight = reduce(lambda a, b: a + b, [F.when(v.isNotNull(), F.lit(w)).otherwise(0.0) for v, w in parts])
    total = reduce(lambda a, b: a + b, [F.coalesce(v * w, F.lit(0.0)) for v, w in parts])
    return F.when(weight > 0, total / weight), weight


def round_half_up(c: Column | str, digits: int) -> Column:
    """Half-up rounding by one multiply and one floor, the same arithmetic in every engine."""
    scale = float(10**digits)
    return F.floor(_col(c) * scale + 0.5) / scale


def r2(c: Column | str) -> Column:
    return round_half_up(c, 2)


def r4(c: Column | str) -> Column:
    return round_half_up(c, 4)


def r6(c: Column | str) -> Column:
    return round_half_up(c, 6)
