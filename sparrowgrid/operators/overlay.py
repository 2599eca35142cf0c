"""Shadow overlays: layers of changes over a base that stays as it is, merged when they are read.

A layer row has the key, what it does (``put`` a row whole, ``patch`` the columns that aren't null, ``drop`` it) and the columns.
Reads fold the layers of a key from the oldest to the newest over its base row (rows of one key in one layer, from the least to
the greatest; rows without a key do nothing); base rows that no layer names aren't shuffled
where the layers are small enough to be broadcast, and are never rewritten. An overlay is a value: adding a layer gives another
one, so a frame is discarded by letting it go, and one can stand on another.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparrowgrid.session import sound

PUT, PATCH, DROP = "put", "patch", "drop"


@dataclass(frozen=True)
class Overlay:
    base: DataFrame
    key: str
    layers: tuple[DataFrame, ...] = field(default=())

    def _layer(self, rows: DataFrame, does: str) -> Overlay:
        if unknown := set(rows.columns) - set(self.base.columns):
            raise ValueError(f"not in the base: {sorted(unknown)}")
        kinds = dict(self.base.dtypes)
        whole = F.struct(*[(F.col(c) if c in rows.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in self.base.columns])
        layer = rows.where(F.col(self.key).isNotNull()).select(F.col(self.key).cast(kinds[self.key]).alias(self.key), F.lit(does).alias("does"), whole.alias("v"))
        return Overlay(self.base, self.key, (*self.layers, layer))

    def put(self, rows: DataFrame) -> Overlay:
        """Inserts rows, or replaces the ones of the same key; columns that ``rows`` lacks are null."""
        return self._layer(rows, PUT)

    def patch(self, rows: DataFrame) -> Overlay:
        """Sets the columns that aren't null, of rows that are there; what isn't there stays away."""
        return self._layer(rows, PATCH)

    def drop(self, keys: DataFrame) -> Overlay:
        return self._layer(keys.select(self.key), DROP)

    def changes(self) -> DataFrame:
        """``key, does, v, layer`` of all layers, oldest 0."""
        out = None
        for k, rows in enumerate(self.layers):
            one = rows.withColumn("layer", F.lit(k))
            out = one if out is None else out.unionByName(one)
        return out

    def read(self, keys: DataFrame | None = None) -> DataFrame:
        """The rows as the layers leave them; with ``keys``, only these, and both sides are cut to them before they meet."""
        sound(self.base.sparkSession)
        base, changed = self.base, self.changes()
        if keys is not None:
            some = keys.select(self.key).distinct()
            base = base.join(some, self.key, "left_semi")
            changed = changed.join(some, self.key, "left_semi") if changed is not None else None
        if changed is None:
            return base
        touched = changed.select(self.key).distinct()
        own = base.join(touched, self.key, "left_semi").select(self.key, F.lit(PUT).alias("does"), F.struct(*base.columns).alias("v"), F.lit(-1).alias("layer"))
        steps = own.unionByName(changed).groupBy(self.key).agg(F.sort_array(F.collect_list(F.struct("layer", "does", "v"))).alias("steps"))
        nothing = F.lit(None).cast(dict(own.dtypes)["v"])
        folded = steps.select(F.aggregate("steps", nothing, self._step).alias("v")).where("v IS NOT NULL").select("v.*")
        return base.join(touched, self.key, "left_anti").unionByName(folded)

    def _step(self, now: Column, step: Column) -> Column:
        patched = F.struct(*[F.coalesce(step["v"][c], now[c]).alias(c) for c in self.base.columns])
        return F.when(step["does"] == PUT, step["v"]).when((step["does"] == PATCH) & now.isNotNull(), patched)

    def flat(self) -> Overlay:
        """One layer in place of all: a put or a drop for each key that any layer names. The base isn't rewritten."""
        changed = self.changes()
        if changed is None:
            return self
        touched = changed.select(self.key).distinct()
        left = self.read(touched)
        puts = left.select(self.key, F.lit(PUT).alias("does"), F.struct(*self.base.columns).alias("v"))
        drops = touched.join(left, self.key, "left_anti").select(self.key, F.lit(DROP).alias("does"), F.lit(None).cast(dict(puts.dtypes)["v"]).alias("v"))
        return Overlay(self.base, self.key, (puts.unionByName(drops),))
