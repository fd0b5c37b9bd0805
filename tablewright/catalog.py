"""All queries of the engine's own operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .plans import aggregate_queries, building_queries, closed_form_queries, consensus_queries, ensemble_queries, metric_queries, model_queries, moment_queries, preprocess_queries, relational_queries, validation_queries  # noqa: F401
from .registry import ORACLES, QUERIES

FLAGSHIP = "metric_all_binary"


def entry(spark: SparkSession) -> DataFrame:
    return QUERIES[FLAGSHIP](spark, "/root/testdata/sf0.001")


def queries() -> dict:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return ORACLES
