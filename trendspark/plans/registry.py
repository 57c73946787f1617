"""All queries of the engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from trendspark.plans import catalogue, clusters, context, finals, payloads, reports, runs, stored, topics, vectors

FLAGSHIP = catalogue.FLAGSHIP


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return catalogue.queries() | clusters.queries() | topics.queries() | context.queries() | payloads.queries() | finals.queries() | stored.queries() | reports.queries() | runs.queries() | vectors.queries()


def oracle_sql() -> dict[str, str]:
    return catalogue.oracle_sql() | clusters.oracle_sql() | topics.oracle_sql() | context.oracle_sql() | payloads.oracle_sql() | finals.oracle_sql() | stored.oracle_sql() | reports.oracle_sql() | runs.oracle_sql() | vectors.oracle_sql()
