"""Inventories kept by day: exact counts and extremes, and mergeable sketches of what has no exact merge.

A day's rows are read once, when the day is new or has changed.  Distinct
entities and quantiles over any span of days come from merging the few
sketches of its days, beside the exact form over all rows (``exact``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ranks import quantiles
from tidemark.session import exists

#: log2 of the registers of a distinct count, whose relative error is about 1.04 / sqrt(2 ^ LG_K); size of a quantile sketch, about 1.3 % of rank.
LG_K, QUANTILE_K = 12, 200


def day_sketches(rows: DataFrame, day: str, by: list[str], distinct: list[str], measured: list[str]) -> DataFrame:
    """One row per day and group: rows, known values, extremes, and a sketch of each column; Spark combines them before the shuffle."""
    aggs = [F.count("*").alias("rows")]
    for c in distinct:
        aggs.append(F.hll_sketch_agg(F.col(c).cast("string"), LG_K).alias(f"{c}_distinct"))
    for c in measured:
        v = F.col(c).cast("double")
        known = F.when(~F.isnan(v), v)
        aggs += [F.count(known).alias(f"{c}_known"), F.min(known).alias(f"{c}_min"), F.max(known).alias(f"{c}_max"), F.kll_sketch_agg_double(known, QUANTILE_K).alias(f"{c}_quantiles")]
    return rows.groupBy(F.to_date(day).alias("day"), *by).agg(*aggs)


def merged(sketches: DataFrame, by: list[str], distinct: list[str], measured: list[str]) -> DataFrame:
    """The sketches of all given days as one per group; merging days counts what sketching their rows together would, within the same error."""
    aggs = [F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.countDistinct("day").alias("days"), F.sum("rows").alias("rows")]
    for c in distinct:
        aggs.append(F.hll_union_agg(f"{c}_distinct").alias(f"{c}_distinct"))
    for c in measured:
        aggs += [F.sum(f"{c}_known").alias(f"{c}_known"), F.min(f"{c}_min").alias(f"{c}_min"), F.max(f"{c}_max").alias(f"{c}_max"), F.kll_merge_agg_double(f"{c}_quantiles", QUANTILE_K).alias(f"{c}_quantiles")]
    return sketches.groupBy(*by).agg(*aggs)


def estimates(sketches: DataFrame, distinct: list[str], measured: list[str], level: float = 0.5) -> DataFrame:
    """The sketches read: distinct counts and one quantile per column, null where nothing was known."""
    out = {f"{c}_distinct": F.hll_sketch_estimate(f"{c}_distinct") for c in distinct}
    out |= {f"{c}_quantiles": F.when(F.col(f"{c}_known") > 0, F.kll_sketch_get_quantile_double(f"{c}_quantiles", F.lit(level))) for c in measured}
    return sketches.withColumns(out).withColumnsRenamed({f"{c}_quantiles": f"{c}_quantile" for c in measured})


def exact(rows: DataFrame, day: str, by: list[str], distinct: list[str], measured: list[str], level: float = 0.5) -> DataFrame:
    """The same figures from all rows."""
    d = rows.withColumn("_day", F.to_date(day))
    out = d.groupBy(*by).agg(F.min("_day").alias("first_day"), F.max("_day").alias("last_day"), F.countDistinct("_day").alias("days"), F.count("*").alias("rows"), *[F.countDistinct(c).alias(f"{c}_distinct") for c in distinct])
    for c in measured:
        known = d.where(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")))
        out = out.join(quantiles(known, by, c, {f"{c}_quantile": level}).select(*by, f"{c}_quantile"), by, "left")
    return out


def changed_days(rows: DataFrame, day: str, path: str) -> list:
    """Days of the table that the inventory lacks or holds with another number of rows; a day is a few bytes, however many rows it has."""
    now = rows.groupBy(F.to_date(day).alias("day")).agg(F.count("*").alias("n"))
    if exists(rows.sparkSession, path):
        held = rows.sparkSession.read.parquet(path).groupBy("day").agg(F.sum("rows").alias("held"))
        now = now.join(held, "day", "left").where(~F.col("held").eqNullSafe(F.col("n")))
    return sorted(r[0] for r in now.select("day").dropna().collect())


def refresh(rows: DataFrame, day: str, days: list, path: str, by: list[str], distinct: list[str], measured: list[str]) -> None:
    """Sketches of the given days anew, the others untouched; running it again changes nothing.

    The days reach the scan as a filter, so with a table that is partitioned or
    clustered by day one day more costs one day's rows.  Each day is a folder
    that is replaced as a whole.
    """
    part = rows.where(F.to_date(day).isin(days)) if days else rows.limit(0)
    day_sketches(part, day, by, distinct, measured).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def running_inventory(sketches: DataFrame, by: list[str], distinct: list[str]) -> DataFrame:
    """Per day and group the rows and distinct values seen up to then, from one short row per day."""
    w = Window.partitionBy(*by).orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return sketches.select("day", *by, F.sum("rows").over(w).alias("rows"), *[F.hll_sketch_estimate(F.hll_union_agg(f"{c}_distinct").over(w)).alias(f"{c}_distinct") for c in distinct])
