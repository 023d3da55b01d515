"""Where queries and their SQL are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from larkspur.plans.demo import Demo, with_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(sql: str | None = None) -> Callable[[Callable[[Demo], DataFrame]], Query]:
    def add(build: Callable[[Demo], DataFrame]) -> Query:
        QUERIES[build.__name__] = lambda spark, sf_dir: build(Demo(spark, sf_dir))
        if sql:
            ORACLES[build.__name__] = with_views(sql)
        return QUERIES[build.__name__]

    return add
