"""Named queries with their DuckDB SQL, gathered from the operator modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparrowgrid.plans import base


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q.run for name, q in base.all_queries().items()}


def oracle_sql() -> dict[str, str]:
    return {name: q.sql for name, q in base.all_queries().items() if q.sql}
