"""Session features, labels and market context of a panel of bars.

One shuffle by entity serves every frame: the windows share partitioning and
ordering, so Spark evaluates them in a chain over a single sort.  Frames are
ranges over the session ordinal, and a frame counts only if every session in
it is present; a hole makes the value null and never shifts it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import simple_return

ENTITY, SESSION, NO = "entity_id", "session_date", "session_no"
HORIZONS = (5, 10, 20)
ANNUAL = math.sqrt(252)

# Base feature names in reporting order.
BASE_FEATURES = (
    "return_1", "momentum_5", "momentum_20", "volatility_20", "volume_change_5", "range_pct", "close_vs_sma20",
    "volume_ratio_20", "market_momentum_5", "market_momentum_20", "market_volatility_20", "relative_momentum_5",
    "relative_momentum_20", "drawdown_20", "drawdown_60", "distance_to_support_60", "rebound_potential_20",
    "rebound_potential_60",
)
CONTEXT_FEATURES = (
    "momentum_60", "momentum_120", "momentum_250", "sector_momentum_5", "sector_momentum_20",
    "relative_sector_momentum_5", "relative_sector_momentum_20", "breadth_positive_20", "breadth_above_sma20",
    "sector_breadth_positive_20", "market_regime_score",
)


def _at(value: str, offset: int) -> Column:
    """The value exactly ``offset`` sessions away, null if that session is missing."""
    w = Window.partitionBy(ENTITY).orderBy(NO).rangeBetween(offset, offset)
    return F.max(value).over(w)


def _over(lo: int, hi: int = 0):
    return Window.partitionBy(ENTITY).orderBy(NO).rangeBetween(lo, hi)


def row_momentum(n: int) -> Column:
    """Return against the n-th previous row, whichever session that was."""
    return simple_return(F.lag("close", n).over(Window.partitionBy(ENTITY).orderBy(NO)), F.col("close"))


def own_features(bars: DataFrame, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """Features of each entity's own series.  ``bars``: entity, session, session_no, close, high, low, volume.

    Every frame is evaluated once and named; the features are then plain
    arithmetic over the named frames.
    """
    rows = Window.partitionBy(ENTITY).orderBy(NO)
    vol = F.col("volume").cast("double")
    present = lambda back: F.count(F.lit(1)).over(_over(-back)) == back + 1
    frames = {
        **{f"_back_{n}": _at("close", -n) for n in (1, 5, 20)},
        **{f"_ahead_{h}": _at("close", h) for h in horizons},
        **{f"_all_{n}": present(n) for n in (5, 19, 20, 59)},
        "_deviation": F.stddev_samp("_ret").over(_over(-19)),
        "_prior_volume": F.avg(vol).over(_over(-5, -1)),
        "_mean_volume": F.avg(vol).over(_over(-19)),
        "_mean_close": F.avg("close").over(_over(-19)),
        "_high_20": F.max("close").over(_over(-19)),
        "_high_60": F.max("close").over(_over(-59)),
        "_low_60": F.min("close").over(_over(-59)),
    }
    df = bars.withColumn("_ret", simple_return(F.lag("close").over(rows), F.col("close"))).withColumns(frames)
    c, f = F.col("close"), F.col
    whole = lambda back, value: F.when(f(f"_all_{back}"), value)
    out = {
        "return_1": simple_return("_back_1", c),
        "momentum_5": simple_return("_back_5", c),
        "momentum_20": simple_return("_back_20", c),
        "volatility_20": whole(20, f("_deviation") * ANNUAL),
        "volume_change_5": whole(5, F.when(f("_prior_volume") != 0, vol / f("_prior_volume") - 1)),
        "range_pct": F.when(c != 0, (f("high") - f("low")) / c),
        "close_vs_sma20": whole(19, c / f("_mean_close") - 1),
        "volume_ratio_20": whole(19, F.when(f("_mean_volume") != 0, vol / f("_mean_volume"))),
        "drawdown_20": whole(19, c / f("_high_20") - 1),
        "drawdown_60": whole(59, c / f("_high_60") - 1),
        "distance_to_support_60": whole(59, c / f("_low_60") - 1),
        "rebound_potential_20": whole(19, f("_high_20") / c - 1),
        "rebound_potential_60": whole(59, f("_high_60") / c - 1),
    }
    for h in horizons:
        out[f"forward_return_{h}"] = f(f"_ahead_{h}") / c - 1
        out[f"forward_up_{h}"] = f(f"_ahead_{h}") / c - 1 > 0
    return df.select(ENTITY, SESSION, NO, "close", *[v.alias(k) for k, v in out.items()])


def session_features(bars: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Own features plus the benchmark's and the difference to it on the same session."""
    own = own_features(bars)
    market = own_features(benchmark).select(
        SESSION,
        F.col("momentum_5").alias("market_momentum_5"),
        F.col("momentum_20").alias("market_momentum_20"),
        F.col("volatility_20").alias("market_volatility_20"),
    )
    return (
        # The benchmark has one row per session: bounded by the calendar.
        own.join(F.broadcast(market), SESSION, "left")
        .withColumn("relative_momentum_5", F.col("momentum_5") - F.col("market_momentum_5"))
        .withColumn("relative_momentum_20", F.col("momentum_20") - F.col("market_momentum_20"))
    )


def session_labels(features: DataFrame, calendar_targets: DataFrame, closes: DataFrame) -> DataFrame:
    """Long label table (entity, session, horizon): target date and the return to it.

    ``calendar_targets`` comes from ``calendar.session_targets``.  A target
    past the calendar or without a close gives a null return.
    """
    at_target = closes.select(ENTITY, F.col(SESSION).alias("target_date"), F.col("close").alias("target_close"))
    base = features.select(ENTITY, SESSION, "close").join(F.broadcast(calendar_targets), SESSION)
    return base.join(at_target, [ENTITY, "target_date"], "left").select(
        ENTITY,
        SESSION,
        "horizon",
        "target_date",
        F.when((F.col("target_close") > 0) & (F.col("close") > 0), F.col("target_close") / F.col("close") - 1).alias("expected"),
    )


def _share_positive(value: str) -> Column:
    """Share of known values above zero; null, not zero, when none is known."""
    return F.avg((F.col(value) > 0).cast("double"))


def market_breadth(features: DataFrame) -> DataFrame:
    return features.groupBy(SESSION).agg(
        _share_positive("momentum_20").alias("breadth_positive_20"), _share_positive("close_vs_sma20").alias("breadth_above_sma20")
    )


def sector_context(features: DataFrame) -> DataFrame:
    """Mean momentum and breadth of each sector on each session."""
    return features.groupBy(SESSION, "sector").agg(
        F.avg("momentum_5").alias("sector_momentum_5"),
        F.avg("momentum_20").alias("sector_momentum_20"),
        _share_positive("momentum_20").alias("sector_breadth_positive_20"),
    )


def regime_score() -> Column:
    """Mean of the available yes/no market conditions."""
    checks = F.array_compact(
        F.array(
            (F.col("market_momentum_5") > 0).cast("double"),
            (F.col("market_momentum_20") > 0).cast("double"),
            (F.col("breadth_positive_20") > 0.5).cast("double"),
            (F.col("breadth_above_sma20") > 0.5).cast("double"),
        )
    )
    total = F.aggregate(checks, F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(checks) > 0, total / F.size(checks))


def price_context(features: DataFrame) -> DataFrame:
    """Features (with a ``sector`` column) plus breadth, sector and regime context.

    Breadth is one row per session and is broadcast; sector context has
    sessions times sectors rows and the join strategy is left to Spark.
    """
    return (
        features.join(F.broadcast(market_breadth(features)), SESSION, "left")
        .join(sector_context(features), [SESSION, "sector"], "left")
        .withColumn("relative_sector_momentum_5", F.col("momentum_5") - F.col("sector_momentum_5"))
        .withColumn("relative_sector_momentum_20", F.col("momentum_20") - F.col("sector_momentum_20"))
        .withColumn("market_regime_score", regime_score())
    )


def feature_coverage(names: tuple[str, ...]) -> Column:
    """Share of the named features that are known."""
    known = F.lit(0)
    for n in names:
        known = known + F.col(n).isNotNull().cast("int")
    return known / len(names)


def setup_history(features: DataFrame, window_rows: int = 749, purge_rows: int = 5, radius: float = 0.04) -> DataFrame:
    """Outcomes of the entity's own similar past sessions.

    Similar: drawdown and distance to support both within ``radius``.  Past:
    rows ``window_rows`` back to ``purge_rows`` back, so every label used had
    matured.

    The two measures make a grid of cells as wide as the radius, and rows fall
    into blocks as long as the window.  A past row enters its cell and the eight
    around it, a decision its own block and the one before, and they meet by an
    equi join of entity, block and cell: the pairs that are touched follow the
    matches, not the window, and a busy entity is spread over its cells.  Rows
    without either measure have no setup, past rows without outcome don't count.
    """
    drawdown, support = F.col("drawdown_60"), F.col("distance_to_support_60")
    rows = features.select(
        ENTITY, NO, drawdown.alias("d"), support.alias("s"), F.col("forward_return_5").alias("r"),
        F.row_number().over(Window.partitionBy(ENTITY).orderBy(NO)).alias("row"),
    ).where("d IS NOT NULL AND s IS NOT NULL")
    # Slightly wider than the radius, so that rounding never puts two similar rows two cells apart.
    cell = lambda c: F.floor(F.col(c) / (radius * (1 + 1e-9)))
    block = F.floor(F.col("row") / window_rows)
    around = lambda c: F.explode(F.sequence(cell(c) - 1, cell(c) + 1))
    past = rows.where("r IS NOT NULL").select(ENTITY, block.alias("block"), F.col("row").alias("past"), F.col("d").alias("pd"), F.col("s").alias("ps"), "r")
    past = past.withColumn("dc", around("pd")).withColumn("sc", around("ps"))
    now = rows.select(ENTITY, NO, "row", "d", "s", F.explode(F.sequence(block - 1, block)).alias("block"), cell("d").alias("dc"), cell("s").alias("sc"))
    pairs = now.join(past, [ENTITY, "block", "dc", "sc"]).where(
        F.col("past").between(F.col("row") - window_rows, F.col("row") - purge_rows) & (F.abs(F.col("pd") - F.col("d")) <= radius) & (F.abs(F.col("ps") - F.col("s")) <= radius)
    )
    found = pairs.groupBy(ENTITY, NO).agg(
        F.count("*").cast("int").alias("sample_size"), F.count_if(F.col("r") > 0).cast("int").alias("ups"), F.percentile("r", F.lit(0.5)).alias("setup_median")
    )
    return features.join(found, [ENTITY, NO]).withColumn("setup_up", F.col("ups") / F.col("sample_size"))


def setup_score(n: Column, ups: Column, median: Column, upside: Column) -> Column:
    """0-100: shrunk hit rate, median outcome and room to the high, scaled by the evidence."""
    unit = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    hit = unit(((ups + 10) / (n + 20) - 0.45) / 0.25)
    outcome = unit((median + 0.01) / 0.05)
    room = unit(F.coalesce(upside, F.lit(0.0)) / 0.20)
    evidence = F.lit(0.65) + F.lit(0.35) * F.least(F.lit(1.0), n / 100)
    return (hit * 0.50 + outcome * 0.30 + room * 0.20) * 100 * evidence
