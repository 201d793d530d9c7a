"""The registry of queries: each operator applied to the driver's tables, with its DuckDB counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, and the SQL that gives the same rows if there is one."""

    def add(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered already")
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def shared(name: str, tables: str, sql: str, doc: str) -> None:
    """Register a query whose SQL both engines understand, over the named tables as views."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        for table in tables.split():
            spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(table)
        return spark.sql(sql)

    run.__doc__, run.__name__ = doc, name
    query(name, sql)(run)
