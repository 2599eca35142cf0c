"""Structural machines: a stance that looks at a world (any frames) and reports graded observations, or refuses to."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparrowgrid.operators import sequence

SCHEMA = "machine string, target string, statement string, quantity double, grade string"
#: The grade of a refusal (fixed value).
REFUSED = "insufficient-data"


class Machine(Protocol):
    name: str

    def inspect(self, world: dict[str, DataFrame]) -> DataFrame:
        """Observations, by ``SCHEMA``."""


def observed(rows: DataFrame, machine: str, target: Column, statement: Column, quantity: Column, grade: Column) -> DataFrame:
    """Observations; where there is no quantity the machine refuses, with quantity 0."""
    none = quantity.isNull() | F.isnan(quantity.cast("double"))
    return rows.select(
        F.lit(machine).alias("machine"), target.cast("string").alias("target"), statement.alias("statement"),
        F.when(none, 0.0).otherwise(quantity.cast("double")).alias("quantity"), F.when(none, REFUSED).otherwise(grade).alias("grade"),
    )


class Scaling:
    """Growth exponent of each series in ``world["series"](key, x, y)``, both in logarithms."""

    name = "scaling"

    def inspect(self, world: dict[str, DataFrame]) -> DataFrame:
        s = sequence.scaling_exponent(world["series"], "key", "x", "y")
        return observed(s, self.name, F.col("key"), F.lit("exponent of the upper half"), F.col("slope"), F.lit("measured"))


def inspect_all(machines: list[Machine], world: dict[str, DataFrame]) -> DataFrame:
    """What all machines see, one frame."""
    out = None
    for m in machines:
        seen = m.inspect(world)
        out = seen if out is None else out.unionByName(seen)
    if out is None:
        raise ValueError("no machines")
    return out
