"""Where queries and their SQL are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillgraph.sources.graph import SQL, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def graph_query(sql: str | None = None):
    """Register a function of the graph's tables; sql follows their definition."""

    def put(f: Callable[[dict[str, DataFrame]], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(tables(spark, sf_dir))
        if sql:
            ORACLE[f.__name__] = SQL + sql
        return f

    return put


def query(sql: str | None = None):
    """Register a function of (spark, sf_dir)."""

    def put(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return put
