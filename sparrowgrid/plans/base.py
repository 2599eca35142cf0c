"""Registration of named queries: a builder and, where SQL can express it, its DuckDB text."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from sparrowgrid.session import sound

#: Modules that register queries when they are imported.
MODULES: list[str] = [f"sparrowgrid.plans.{m}" for m in ("vectors", "texts", "beliefs", "facts", "custom", "more", "fixtures", "wider", "evolving", "records")]

_FOUND: dict[str, Query] = {}


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


def query(name: str, sql: str | None = None):
    """Decorator: register ``(spark, sf_dir) -> DataFrame`` under ``name``."""

    def keep(f):
        if name in _FOUND:
            raise ValueError(f"query {name} is registered twice")
        _FOUND[name] = Query(lambda spark, sf_dir: f(sound(spark), sf_dir), sql)
        return f

    return keep


def all_queries() -> dict[str, Query]:
    for m in MODULES:
        importlib.import_module(m)
    return _FOUND
