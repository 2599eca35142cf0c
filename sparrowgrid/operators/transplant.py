"""Plans that carry one project's shape over to another: what stays, what is renamed, what is created. Nothing is deleted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def plan(donors: DataFrame, recipients: DataFrame, pairs: DataFrame) -> DataFrame:
    """``project, op, path, donor, adaptations`` from nodes ``project, path, tokens`` and pairs ``project, donor, recipient`` of their paths.

    keep: the pair's names have the same tokens. rewrite: they don't; ``adaptations`` are the donor's tokens that the recipient lacks.
    create: a donor path without a counterpart, at the same path, unless a folder above it is created too (that covers it, however far
    above; one anti-join on the paths' prefixes finds it). unaligned: a recipient path without a counterpart, listed for a person.
    A pair whose path isn't a node says nothing.
    """
    none = F.array().cast("array<string>")
    side = lambda nodes, name: nodes.select("project", F.col("path").alias(name), F.col("tokens").alias(f"{name}_tokens"))
    both = pairs.select("project", "donor", "recipient").distinct().join(side(donors, "donor"), ["project", "donor"]).join(side(recipients, "recipient"), ["project", "recipient"])
    same = F.col("donor_tokens") == F.col("recipient_tokens")
    missing = F.filter("donor_tokens", lambda t: ~F.array_contains("recipient_tokens", t))
    matched = both.select("project", F.when(same, "keep").otherwise("rewrite").alias("op"), F.col("recipient").alias("path"), F.when(~same, F.col("donor")).alias("donor"), F.when(same, none).otherwise(missing).alias("adaptations"))
    alone = lambda nodes, name: nodes.select("project", "path").distinct().join(pairs.select("project", F.col(name).alias("path")), ["project", "path"], "left_anti")
    fresh = alone(donors, "donor").withColumn("parts", F.split("path", "/"))
    above = F.when(F.size("parts") > 1, F.transform(F.sequence(F.lit(1), F.size("parts") - 1), lambda k: F.array_join(F.slice("parts", 1, k), "/"))).otherwise(none)
    covered = fresh.select("project", "path", F.explode(above).alias("folder")).join(fresh.select("project", F.col("path").alias("folder")), ["project", "folder"], "left_semi").select("project", "path").distinct()
    creates = fresh.join(covered, ["project", "path"], "left_anti").select("project", F.lit("create").alias("op"), "path", F.lit(None).cast("string").alias("donor"), none.alias("adaptations"))
    listed = alone(recipients, "recipient").select("project", F.lit("unaligned").alias("op"), "path", F.lit(None).cast("string").alias("donor"), none.alias("adaptations"))
    return matched.unionByName(creates).unionByName(listed)
