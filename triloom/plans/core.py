"""All core queries over the test tables, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from triloom.plans import files, graphs, stores


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**files.QUERIES, **graphs.QUERIES, **stores.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**files.SQL, **graphs.SQL, **stores.SQL}
