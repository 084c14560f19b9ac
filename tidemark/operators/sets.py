"""Set-style operators: precedence unions, interval ledgers, renames, merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.latest import best_row


def union_by_precedence(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """All rows of both, one per key, the first frame's row where both have it."""
    both = first.withColumn("_p", F.lit(0)).unionByName(second.withColumn("_p", F.lit(1)), allowMissingColumns=True)
    return best_row(both, keys, [F.col("_p")], "min").drop("_p")


def membership_changes(current: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """Each key as added, removed or kept between two member lists."""
    a = current.select(key).distinct().withColumn("_a", F.lit(1))
    b = target.select(key).distinct().withColumn("_b", F.lit(1))
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").otherwise("kept")
    return a.join(b, key, "full").select(key, change.alias("change"))


def close_intervals(open_rows: DataFrame, changes: DataFrame, key: str, day: Column) -> DataFrame:
    """Ledger after a sync: removed members end on ``day``, new ones start on it, kept ones stay open."""
    j = open_rows.join(changes, key, "left").withColumn("effective_to", F.when(F.col("change") == "removed", day).otherwise(F.col("effective_to"))).drop("change")
    new = changes.where(F.col("change") == "added").select(key, day.alias("effective_from"), F.lit(None).cast("date").alias("effective_to"))
    return j.unionByName(new)


def renames(current: DataFrame, target: DataFrame, mapping: DataFrame) -> DataFrame:
    """Renames that keep their key: old name gone, new name present, same identity on both sides.

    ``mapping``: old, new.  Anything else is left out and handled as a change.
    """
    c = current.select(F.col("name").alias("old"), F.col("identity").alias("_i"))
    n = target.select(F.col("name").alias("new"), F.col("identity").alias("_j"))
    gone = mapping.join(target.select(F.col("name").alias("old")), "old", "left_anti")
    return gone.join(c, "old").join(n, "new").where(F.col("_i") == F.col("_j")).select("old", "new", F.col("_i").alias("identity"))


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The newest row of each key over both frames."""
    return best_row(existing.unionByName(incoming), keys, [F.col(c) for c in order], "max")


def merged_statements(income: DataFrame, balance: DataFrame, cash_flow: DataFrame, keys: list[str]) -> DataFrame:
    """Income rows with the balance and the cash flow of the same keys, null where those are missing."""
    return income.join(balance, keys, "left").join(cash_flow, keys, "left")


def preserve_fields(current: DataFrame, previous: DataFrame, identity: list[str], fields: list[str]) -> DataFrame:
    """Fill missing fields from the previous row of the very same record, and name those filled."""
    p = previous.select(*identity, *[F.col(f).alias(f"_p_{f}") for f in fields])
    j = current.join(p, identity, "left")
    kept = F.array_compact(F.array(*[F.when(F.col(f).isNull() & F.col(f"_p_{f}").isNotNull(), F.lit(f)) for f in fields]))
    j = j.withColumn("retained_fields", kept).withColumns({f: F.coalesce(f, f"_p_{f}") for f in fields})
    return j.drop(*[f"_p_{f}" for f in fields])


def unique_target(rows: DataFrame, directory: DataFrame, key: str) -> DataFrame:
    """Route each row to the one directory entry with its key; none or several leave it out."""
    one = directory.groupBy(key).agg(F.count("*").alias("_n"), F.min("entity_id").alias("entity_id")).where(F.col("_n") == 1).drop("_n")
    return rows.join(one, key)
