"""Named queries over the input tables, each with the SQL that it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function of (spark, folder) by its name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


from driftline.plans import claims_queries, composite_queries, event_queries, frontier_queries, hindcast_queries, identity_queries, pick_queries, review_queries, star_queries, subgraph_queries, text_queries  # noqa: E402, F401


def entry(spark: SparkSession, folder: str) -> DataFrame:
    """The flagship: momentum states of the event stream."""
    return QUERIES["hysteresis_states"](spark, folder)
