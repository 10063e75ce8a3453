"""All registered queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracequarry.plans import core_queries, engine_queries


def queries() -> dict:
    return {**engine_queries.QUERIES, **core_queries.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**engine_queries.ORACLE_SQL, **core_queries.ORACLE_SQL}


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """A hunt with several rules over the event table, in one scan."""
    return engine_queries.hunt_multi_rule(spark, folder)
