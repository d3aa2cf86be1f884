"""All named queries over the driver's tables, each with its SQL twin where it has one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from courtside.plans import analytics, chains, landed, records, shown


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return analytics.QUERIES | records.QUERIES | shown.QUERIES | landed.QUERIES | chains.QUERIES


def oracle_sql() -> dict[str, str]:
    return analytics.SQL | records.SQL | shown.SQL | landed.SQL | chains.SQL
