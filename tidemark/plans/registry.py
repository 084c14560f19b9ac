"""Query registry: a name, a builder over bound tables, and the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans.ctes import with_clause
from tidemark.plans.tables import Tables


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Tables], DataFrame]
    covers: tuple[str, ...]
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, covers: str, sql: str | None = None):
    """Register a builder.  ``covers`` lists inventory ids, ``sql`` may use the shared CTEs by name."""

    def register(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = Query(name, fn, tuple(covers.split()), with_clause(sql) if sql else None)
        return fn

    return register


def run(name: str, spark: SparkSession, path: str) -> DataFrame:
    return QUERIES[name].build(Tables(spark, path))


def load_all() -> dict[str, Query]:
    """Import every plan module so that its queries register."""
    from tidemark.plans import catalog  # noqa: F401

    return QUERIES
