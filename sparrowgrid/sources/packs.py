"""Ontology packs: JSON files ``{kind, domains: [...]}`` as one frame of entries, with look-ups and facet queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparrowgrid.operators.graph import cut

FACETS = ("sub_domain", "sub_mode", "lifecycle", "agency", "scale", "abstraction")
TEXTS = ("name", "category", "domain", "mode", "axis_kind", "axis_name", "unit")
ENTRY = ", ".join(f"{c}: string" for c in TEXTS) + ", hints: array<string>, facets: struct<" + ", ".join(f"{f}: string" for f in FACETS) + ">"
SCHEMA = f"kind string, domains array<struct<{ENTRY}>>"
#: Spellings of facet values that mean another (fixed values).
ALIASES = {"FABRICATE": "BUILD", "MAINTAIN": "RETIRE", "SELFACTOR": "SELF"}
#: Packs whose names need no prefix.
BUILT_IN = ("human", "machine", "custom")


def canonical(facet):
    """A facet value in upper case, aliases resolved."""
    up = F.upper(facet)
    m = F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv])
    return F.coalesce(m[up], up)


def load(spark: SparkSession, path: str) -> DataFrame:
    """Entries of all packs under ``path``; a pack that doesn't parse fails the load."""
    return entries(spark.read.schema(SCHEMA).option("multiLine", True).option("mode", "FAILFAST").json(path))


def load_sound(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(entries, warnings): entries of the packs that parse, and ``path, why`` of those that don't, which are passed over."""
    read = spark.read.schema(f"{SCHEMA}, _bad string").option("multiLine", True).option("columnNameOfCorruptRecord", "_bad").json(path).withColumn("path", F.input_file_name())
    read = cut(read)
    bad = read.where(F.col("_bad").isNotNull() | F.col("domains").isNull())
    return entries(read.where("_bad IS NULL AND domains IS NOT NULL")), bad.select("path", F.when(F.col("_bad").isNotNull(), "it doesn't parse").otherwise("it has no domains").alias("why"))


def entries(packs: DataFrame) -> DataFrame:
    """Entries with their key: the name alone for built-in kinds, else ``kind:name``; facets under one spelling."""
    e = packs.select("kind", F.explode("domains").alias("d")).select("kind", "d.*")
    key = F.when(F.col("kind").isin(*BUILT_IN), F.col("name")).otherwise(F.concat_ws(":", "kind", "name"))
    return e.withColumn("key", key).withColumn("facets", F.struct(*[canonical(F.col(f"facets.{f}")).alias(f) for f in FACETS]))


def merge(base: DataFrame, over: DataFrame) -> DataFrame:
    """Entries by key; those of ``over`` win."""
    both = base.withColumn("_o", F.lit(0)).unionByName(over.withColumn("_o", F.lit(1)))
    w = Window.partitionBy("key").orderBy(F.col("_o").desc(), *[F.col(c) for c in ("name", "domain", "mode", "category")])
    return both.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_o")


def ordered(entries: DataFrame) -> DataFrame:
    return entries.orderBy("name", "domain", "mode", "category", "axis_kind", "axis_name", "unit", "hints")


def by_facets(entries: DataFrame, kind: str | None = None, domain: str | None = None, mode: str | None = None, **facets: str) -> DataFrame:
    """Every axis that is set must be equal; an entry without the axis doesn't match. Domain and mode in any case."""
    out = entries
    for c, v, low in (("kind", kind, False), ("domain", domain, True), ("mode", mode, True)):
        if v is not None:
            out = out.where(F.lower(c) == v.lower() if low else F.col(c) == v)
    for f, v in facets.items():
        if f not in FACETS:
            raise ValueError(f"no facet {f}")
        out = out.where(F.coalesce(F.col(f"facets.{f}") == canonical(F.lit(v)), F.lit(False)))
    return out.orderBy("name")


def export(proposals: DataFrame, kind: str) -> DataFrame:
    """``json``: discovery proposals (``name, hints, domain, mode``) as one pack."""
    d = F.sort_array(F.collect_list(F.struct("name", "domain", "mode", "hints")))
    return proposals.agg(d.alias("domains")).select(F.to_json(F.struct(F.lit(kind).alias("kind"), "domains")).alias("json"))
