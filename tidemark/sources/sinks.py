"""Keyed sinks: first observation wins, newest wins, whole-entity replacement."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.latest import best_row
from tidemark.session import exists


def new_rows(incoming: DataFrame, existing: DataFrame | None, keys: list[str], order: list[str]) -> DataFrame:
    """Rows whose key was never stored; within the batch the first one of each key."""
    first = best_row(incoming, keys, [F.col(c) for c in order], "min")
    return first if existing is None else first.join(existing.select(*keys), keys, "left_anti")


def append_first(incoming: DataFrame, path: str, keys: list[str], order: list[str], parts: int = 64) -> None:
    """Append only unseen keys to a parquet table; running it again adds nothing.

    The table is partitioned by a hash of the key, and only the parts that the
    incoming keys fall into are read: their numbers, ``parts`` at most, are
    what reaches the driver.
    """
    spark = incoming.sparkSession
    rows = incoming.withColumn("key_part", F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int"))
    existing = None
    if exists(spark, path):
        met = [r[0] for r in rows.select("key_part").distinct().collect()]
        existing = spark.read.schema(rows.schema).parquet(path).where(F.col("key_part").isin(met))
    new_rows(rows, existing, [*keys, "key_part"], order).write.mode("append").partitionBy("key_part").parquet(path)


def replace_entities(rows: DataFrame, required: DataFrame, path: str, entity: str = "entity_id", day: str = "session_date") -> DataFrame:
    """Overwrite the partitions of the entities that have every required day; return the others.

    Dynamic partition overwrite replaces one entity's series as a whole.
    """
    days = required.select(day).distinct().withColumn("_required", F.lit(1))
    # Required sessions are bounded by the calendar.
    have = rows.join(F.broadcast(days), day, "left").groupBy(entity).agg(F.countDistinct(F.when(F.col("_required") == 1, F.col(day))).alias("_have"))
    want = required.select(day).distinct().agg(F.count("*")).scalar()
    incomplete = have.where(F.col("_have") < want).select(entity)
    good = rows.join(incomplete, entity, "left_anti")
    good.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(entity).parquet(path)
    return incomplete


def split_by_age(rows: DataFrame, day: str, cutoff: str) -> tuple[DataFrame, DataFrame]:
    """Hot rows on or after the cutoff and archive rows before it."""
    c = F.lit(cutoff).cast("date")
    return rows.where(F.col(day) >= c), rows.where(F.col(day) < c)


def write_archive(rows: DataFrame, day: str, path: str) -> None:
    """Archive partitioned by month."""
    rows.withColumn("month", F.date_format(day, "yyyy-MM")).write.mode("append").partitionBy("month").parquet(path)
