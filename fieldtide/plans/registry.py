"""Named queries with the SQL each is checked against."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _sized_methods(fn: Query) -> Query:
    """HotSpot never compiles a method above 8000 bytes, and runs it some ten times as long.

    With this limit Spark gives up fusing a stage whose method is larger, as its documentation
    advises for HotSpot; the parts are compiled then.
    """
    @functools.wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
        return fn(spark, sf_dir)

    return run


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its inventory name."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = _sized_methods(fn)
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add
