"""Collects queries with the DuckDB SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers f(read) as a query; read(table) gives a table of the input folder."""

    def keep(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))

        if name in QUERIES:
            raise ValueError(f"{name} is registered already")
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return f

    return keep
