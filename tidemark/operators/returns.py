"""Price and total return kept apart: closes on both bases from raw closes, splits and dividends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import positive
from tidemark.operators.asof import asof_best

BASES = ("price", "total")


def action_factors(bars: DataFrame, actions: DataFrame, entity: str = "entity_id", day: str = "session_date", close: str = "close") -> DataFrame:
    """What each session's actions do to a holding: (entity, session, split, total, unknown).

    ``actions``: entity, kind (``dividend`` or ``split``), event_date, amount.  An
    action takes effect on the first priced session on or after its date; those
    of one session are taken together.  ``split`` multiplies the shares; ``total``
    also puts the dividends, stated per new share, into shares at that close.
    ``unknown`` counts actions without a valid amount, and those of other kinds;
    actions after the last session have no effect yet.
    """
    priced = bars.select(entity, day, positive(close).alias("_close")).where("_close IS NOT NULL")
    due = asof_best(actions, priced, [entity], "event_date", day, [day, "_close"], forward=True, prefix="_at_")
    split, dividend = F.col("kind") == "split", F.col("kind") == "dividend"
    good = F.when(split, positive("amount")).when(dividend & (F.col("amount") >= 0) & (F.col("amount") < float("inf")), F.col("amount"))
    sums = due.where(F.col(f"_at_{day}").isNotNull()).groupBy(entity, F.col(f"_at_{day}").alias(day)).agg(
        F.coalesce(F.product(F.when(split, good)), F.lit(1.0)).alias("split"), F.coalesce(F.sum(F.when(dividend, good)), F.lit(0.0)).alias("_cash"),
        F.max("_at__close").alias("_close"), F.count_if(good.isNull()).alias("unknown"),
    )
    return sums.select(entity, day, "split", (F.col("split") * (1 + F.col("_cash") / F.col("_close"))).alias("total"), "unknown")


def running_product(df: DataFrame, keys: list[str], order: str, block: Column, factors: dict[str, Column], counts: dict[str, Column]) -> DataFrame:
    """Adds the products and sums of all rows of a key up to each row.

    A product is associative: rows run inside a block of the order, and one row
    per block travels on, so no task holds more than a block of a key.
    """
    d = df.withColumns({"_block": block, **{f"_f_{n}": c for n, c in factors.items()}, **{f"_c_{n}": c for n, c in counts.items()}})
    whole = d.groupBy(*keys, "_block").agg(*[F.product(f"_f_{n}").alias(f"_p_{n}") for n in factors], *[F.sum(f"_c_{n}").alias(f"_s_{n}") for n in counts])
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = whole.select(*keys, "_block", *[F.coalesce(F.product(f"_p_{n}").over(before), F.lit(1.0)).alias(f"_b_{n}") for n in factors], *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_a_{n}") for n in counts])
    inside = Window.partitionBy(*keys, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = d.withColumns({**{f"_f_{n}": F.product(f"_f_{n}").over(inside) for n in factors}, **{f"_c_{n}": F.sum(f"_c_{n}").over(inside) for n in counts}}).join(carried, [*keys, "_block"])
    return out.select(*df.columns, *[(F.col(f"_f_{n}") * F.col(f"_b_{n}")).alias(n) for n in factors], *[(F.col(f"_c_{n}") + F.col(f"_a_{n}")).alias(n) for n in counts])


def return_bases(bars: DataFrame, actions: DataFrame, entity: str = "entity_id", day: str = "session_date", close: str = "close") -> DataFrame:
    """The bars twice, with a ``basis`` and the close on it; both start at the first raw close.

    ``price``: the close of what one first share has become by splits.  ``total``:
    the same with every dividend put back into shares.  The two are equal until
    the first dividend.  They are never mixed: from an action of unknown amount
    on, ``total`` is null, and ``price`` too if that action was a split.
    """
    factors = action_factors(bars, actions, entity, day, close)
    lost = action_factors(bars, actions.where(F.col("kind") != "dividend"), entity, day, close).select(entity, day, F.col("unknown").alias("_lost"))
    d = bars.join(factors, [entity, day], "left").join(lost, [entity, day], "left")
    one, none = (lambda c: F.coalesce(c, F.lit(1.0))), (lambda c: F.coalesce(c, F.lit(0)))
    run = running_product(d, [entity], day, F.year(day), {"_split": one("split"), "_total": one("total")}, {"_unknown": none("unknown"), "_bad": none("_lost")})
    raw = positive(close)
    price, total = F.when(F.col("_bad") == 0, raw * F.col("_split")), F.when(F.col("_unknown") == 0, raw * F.col("_total"))
    both = F.array(F.struct(F.lit("price").alias("basis"), price.alias("close")), F.struct(F.lit("total").alias("basis"), total.alias("close")))
    rest = [c for c in bars.columns if c != close]
    return run.select(*rest, F.inline(both))


def missing_required(series: DataFrame, required: DataFrame, entity: str = "entity_id", day: str = "session_date") -> DataFrame:
    """(entity, basis, missing): required sessions that a basis has no close for; such a series must not stand in for another."""
    asks = required.select(entity, day, F.explode(F.array(*[F.lit(b) for b in BASES])).alias("basis"))
    known = series.where(F.col("close").isNotNull()).select(entity, day, "basis")
    return asks.join(known, [entity, day, "basis"], "left_anti").groupBy(entity, "basis").agg(F.count("*").alias("missing"))
