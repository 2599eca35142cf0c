"""What lies where: the state folder, run settings, and look-ups over loaded packs."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, field, fields
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def domains(entries: DataFrame, later: DataFrame | None = None) -> DataFrame:
    """``name, domain, mode, category`` by name; entries of ``later`` replace those of the same name."""
    both = entries.withColumn("_o", F.lit(0))
    if later is not None:
        both = both.unionByName(later.withColumn("_o", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy("name").orderBy(F.col("_o").desc(), "domain", "mode", "category")
    return both.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("name", "domain", "mode", "category")


def categories(entries: DataFrame) -> DataFrame:
    return entries.select("category").where("category IS NOT NULL").distinct().orderBy("category")


def source(sources: DataFrame, name: str) -> DataFrame:
    """The registered source of a name, in any case; no rows for an unknown one."""
    return sources.where(F.lower("name") == name.strip().lower())


def state_dir(spark: SparkSession | None = None, variable: str = "SPARROWGRID_DIR") -> str:
    """The session's ``sparrowgrid.state.dir``, else the environment's, else a folder in the home folder, else here."""
    set_ = spark.conf.get("sparrowgrid.state.dir", None) if spark else None
    home = os.environ.get("HOME")
    return set_ or os.environ.get(variable) or (f"{home}/.sparrowgrid" if home else ".sparrowgrid")


def read_optional(path: str) -> str:
    """A small local file's text; empty where there is none."""
    p = Path(path)
    return p.read_text() if p.is_file() else ""


@dataclass
class Run:
    """Settings of a run."""

    corpus: str = "corpus"
    query: str = ""
    budget: int = 400
    model: str | None = None
    ngram: dict = field(default_factory=lambda: {"registry_id": None, "order": 5})


def run_settings(path: str) -> Run:
    """Settings from a JSON file; a missing file, bad JSON or an unknown key is an error that names the file."""
    p = Path(path)
    if not p.is_file():
        raise FileNotFoundError(f"settings not found: {path}")
    try:
        got = json.loads(p.read_text())
        known = {f.name for f in fields(Run)}
        if set(got) - known:
            raise ValueError(f"unknown: {', '.join(sorted(set(got) - known))}")
        return Run(**got)
    except (ValueError, TypeError) as e:
        raise ValueError(f"{path}: {e}") from e


def example_settings() -> str:
    return json.dumps(asdict(Run()), indent=2)
