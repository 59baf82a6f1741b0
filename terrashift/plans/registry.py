"""Registered queries: a Spark plan over the given tables and, where SQL can say it, the same result in plain SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from terrashift.session import ship


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    covers: tuple[str, ...]


QUERIES: dict[str, Query] = {}


def register(name: str, covers: str, sql: str | None = None):
    """Add a query. ``covers`` lists the inventory rows it stands for; ``sql`` may use the fixture relations."""

    def add(fn):
        from terrashift.plans.fixtures import Fixtures, with_fixtures

        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return fn(Fixtures(spark, sf_dir))

        QUERIES[name] = Query(run, with_fixtures(sql) if sql else None, tuple(covers.split()))
        return fn

    return add
