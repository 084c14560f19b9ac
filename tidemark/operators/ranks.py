"""Exact ranks, percentiles and quantiles of groups of any size.

``median``/``percentile`` gather the values of a group in one task, and so does
a sorted window.  Here the distinct values of a group are cut into
order-preserving bins: counts run inside a bin and across the short list of
bins, so the largest group is spread over its bins and the answer stays exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def order_bin(value: Column, digits: int = 3) -> Column:
    """Integer that never decreases with the value: sign, decimal exponent, leading digits."""
    a = F.abs(value)
    exponent = F.floor(F.log10(F.when(a > 0, a)))
    lead = F.floor(a / F.pow(F.lit(10.0), exponent) * float(10 ** (digits - 1)))
    b = (exponent + 400) * 10**digits + lead
    return F.when(value > 0, b).when(value < 0, -b).otherwise(F.lit(0).cast("long"))


def ordered_counts(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Per group and distinct value: its count, the number of smaller ones, the group size."""
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).cast("double").alias("value"))
        .agg(F.count("*").alias("ties"))
        .withColumn("_bin", order_bin(F.col("value")))
    )
    bins = counts.groupBy(*keys, "_bin").agg(F.sum("ties").alias("_in_bin"))
    # One row per occupied bin, so this window is short whatever the group holds.
    over_bins = Window.partitionBy(*keys).orderBy("_bin")
    bins = bins.select(
        *keys,
        "_bin",
        F.coalesce(F.sum("_in_bin").over(over_bins.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.sum("_in_bin").over(Window.partitionBy(*keys)).alias("total"),
    )
    in_bin = Window.partitionBy(*keys, "_bin").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    return (
        counts.withColumn("_inside", F.coalesce(F.sum("ties").over(in_bin), F.lit(0)))
        .join(bins, [*keys, "_bin"])
        .withColumn("below", F.col("_before") + F.col("_inside"))
        .select(*keys, "value", "ties", "below", "total")
    )


def mid_rank_percentile(df: DataFrame, keys: list[str], value: str, out: str = "percentile", peers: str = "peers") -> DataFrame:
    """Add the 0-100 mid-rank of each value in its group; nulls get neither rank nor vote."""
    ranks = ordered_counts(df, keys, value).select(
        *keys,
        F.col("value").alias(value),
        (F.lit(100.0) * (F.col("below") + F.col("ties") / 2) / F.col("total")).alias(out),
        F.col("total").alias(peers),
    )
    return df.join(ranks, [*keys, value], "left").select(*df.columns, out, peers)


def _value_at(position: Column) -> Column:
    """The value at a 1-based position of the sorted group."""
    return F.max(F.when((F.col("below") < position) & (position <= F.col("below") + F.col("ties")), F.col("value")))


def quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float], exclusive: bool = False) -> DataFrame:
    """Exact interpolated quantiles per group, one column per entry of ``probs``.

    Inclusive: position ``1 + p (n - 1)``.  Exclusive: position ``p (n + 1)``
    with the lower index held in [1, n - 1], which extrapolates at the ends.
    """
    counts = ordered_counts(df, keys, value)
    n = F.col("total")
    aggs = []
    for name, p in probs.items():
        pos = F.lit(p) * (n + 1) if exclusive else F.lit(1.0) + F.lit(p) * (n - 1)
        low = F.floor(pos)
        if exclusive:
            low = F.greatest(F.lit(1), F.least(low, n - 1))
        high = F.least(low + 1, n)
        aggs += [_value_at(low).alias(f"_lo_{name}"), _value_at(high).alias(f"_hi_{name}"), F.max(pos - low).alias(f"_f_{name}")]
    out = counts.groupBy(*keys).agg(F.max("total").alias("n"), *aggs)
    picks = [(F.col(f"_lo_{k}") + (F.col(f"_hi_{k}") - F.col(f"_lo_{k}")) * F.col(f"_f_{k}")).alias(k) for k in probs]
    return out.select(*keys, "n", *picks)


def medians(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    return quantiles(df, keys, value, {out: 0.5}).drop("n")


def tail_mean(df: DataFrame, keys: list[str], value: str, out: str = "tail_mean") -> DataFrame:
    """Mean of the worst fifth, rounded up to at least one value."""
    c = ordered_counts(df, keys, value)
    k = F.greatest(F.lit(1), F.floor((F.col("total") + 4) / 5))
    taken = F.greatest(F.lit(0), F.least(F.col("ties"), k - F.col("below")))
    return c.withColumn("_take", taken).groupBy(*keys).agg((F.sum(F.col("value") * F.col("_take")) / F.sum("_take")).alias(out))
