"""All queries of the library and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import queries as tables
from . import queries_flow  # noqa: F401  registers its queries


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(tables.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(tables.ORACLES)
