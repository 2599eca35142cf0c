"""Ordered sequences: runs test, trajectories, transitions, antecedents, deviations, agreement of partitions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def runs_z(n1: Column, n2: Column, runs: Column) -> Column:
    """Wald-Wolfowitz z of a two-label sequence; 0 where it is degenerate."""
    n = n1 + n2
    mu = 2.0 * n1 * n2 / n + 1
    var = 2.0 * n1 * n2 * (2.0 * n1 * n2 - n) / (n * n * (n - 1))
    return F.when((n1 == 0) | (n2 == 0) | (n < 2) | (var <= 0), 0.0).otherwise((runs - mu) / F.sqrt(var))


def trajectory(rows: DataFrame, key: str, order: str, label: str) -> DataFrame:
    """``key, n, verdict, z, change_at`` by the two most frequent labels: too-few (n < 6), stable, becoming (z <= -1.96) or split."""
    counts = rows.groupBy(key, label).agg(F.count("*").alias("c"))
    w = Window.partitionBy(key)
    ranked = counts.withColumns({"r": F.row_number().over(w.orderBy(F.col("c").desc(), label)), "n": F.sum("c").over(w)})
    top = ranked.groupBy(key).agg(
        F.max("n").alias("n"), F.max(F.when(F.col("r") == 1, F.col(label))).alias("first"), F.max(F.when(F.col("r") == 2, F.col(label))).alias("second"),
        F.max(F.when(F.col("r") == 1, F.col("c"))).alias("n1"), F.max(F.when(F.col("r") == 2, F.col("c"))).alias("n2"),
    )
    two = rows.join(top, key).where((F.col(label) == F.col("first")) | (F.col(label) == F.col("second")))
    o = w.orderBy(order)
    two = two.withColumns({"change": (F.col(label) != F.lag(label).over(o)).cast("int"), "pos": F.row_number().over(o)})
    changes = two.groupBy(key).agg((F.sum(F.coalesce("change", F.lit(0))) + 1).alias("runs"), F.min(F.when(F.col("change") == 1, F.col("pos") - 2)).alias("change_at"))
    j = top.join(changes, key)
    z = F.round(runs_z(F.col("n1"), F.coalesce("n2", F.lit(0)), F.col("runs")), 6)
    stable = F.col("second").isNull() | (F.col("n1") / F.col("n") > 0.85)
    verdict = F.when(F.col("n") < 6, "too-few").when(stable, "stable").when(z <= -1.96, "becoming").otherwise("split")
    return j.select(key, "n", verdict.alias("verdict"), z.alias("z"), "change_at")


def transitions(mentions: DataFrame, gap: int = 6) -> DataFrame:
    """``seq, pos, label`` from ``seq, pos, entity``: emerge if any entity is new, else recur past ``gap`` places since its last mention, else persist."""
    before = F.col("pos") - F.lag("pos").over(Window.partitionBy("seq", "entity").orderBy("pos"))
    m = mentions.withColumn("since", before)
    by = m.groupBy("seq", "pos").agg(F.max(F.col("since").isNull().cast("int")).alias("new"), F.min("since").alias("since"))
    return by.select("seq", "pos", F.when(F.col("new") == 1, "emerge").when(F.col("since") > gap, "recur").otherwise("persist").alias("label"))


#: What says that something is gone (fixed values), and the gap after which a mention recurs.
GONE = ("no longer", "is removed", "was removed", "is drained", "stops", "stands idle")
GAP = 6


def states(places: DataFrame, mentions: DataFrame, facts: DataFrame, gap: int = GAP, cues: tuple[str, ...] = GONE) -> DataFrame:
    """``seq, pos, label`` of every place (``seq, pos, text``): what its entities and its fact do to the state that the places before it left.

    A cue in the text: disappear. Else a new entity: emerge. Else, with a fact: persist where the same fact was stated before (recur,
    if the latest mention of any of its entities is more than ``gap`` places back), change where the pair's last predicate was another
    or the pair is new (recur, if it isn't another and the mention is as old). Without a fact: recur, none (no entity) or persist.

    ``mentions`` has ``seq, pos, entity``; ``facts`` ``seq, pos, s, p, o``, of which a place uses the least. The state is what
    windows look back on: the entity's, the fact's and the pair's row before. Places without mentions stay; a null text has no cue.
    """
    back = F.col("pos") - F.lag("pos").over(Window.partitionBy("seq", "entity").orderBy("pos"))
    m = mentions.select("seq", "pos", "entity").distinct().withColumn("since", back)
    m = m.groupBy("seq", "pos").agg(F.max(F.col("since").isNull().cast("int")).alias("new"), F.min("since").alias("since"))
    f = facts.groupBy("seq", "pos").agg(F.min(F.struct("s", "p", "o")).alias("f")).select("seq", "pos", "f.s", "f.p", "f.o")
    same, pair = Window.partitionBy("seq", "s", "p", "o").orderBy("pos"), Window.partitionBy("seq", "s", "o").orderBy("pos")
    f = f.select("seq", "pos", "p", F.lag("pos").over(same).isNotNull().alias("again"), F.lag("p").over(pair).alias("before"))
    low = F.lower(F.coalesce("text", F.lit("")))
    gone = F.lit(False)
    for c in cues:
        gone = gone | F.contains(low, F.lit(c))
    rows = places.select("seq", "pos", gone.alias("gone")).join(m, ["seq", "pos"], "left").join(f, ["seq", "pos"], "left")
    stale = F.coalesce(F.col("since") > gap, F.lit(False))
    changed = F.coalesce(F.col("before") != F.col("p"), F.lit(False))
    fact = F.when(F.col("again"), F.when(stale, "recur").otherwise("persist")).when(changed, "change").when(stale, "recur").otherwise("change")
    bare = F.when(stale, "recur").when(F.col("new").isNull(), "none").otherwise("persist")
    label = F.when(F.col("gone"), "disappear").when(F.col("new") == 1, "emerge").when(F.col("p").isNotNull(), fact).otherwise(bare)
    return rows.select("seq", "pos", label.alias("label"))


def transition_scores(derived: DataFrame, gold: DataFrame) -> DataFrame:
    """``label, n, recall, accuracy, majority`` of labels ``seq, pos, label`` against gold ones; a place without a derived label is a miss."""
    j = gold.withColumnRenamed("label", "gold").join(derived, ["seq", "pos"], "left").withColumn("hit", F.coalesce((F.col("gold") == F.col("label")).cast("int"), F.lit(0)))
    by = j.groupBy(F.col("gold").alias("label")).agg(F.count("*").alias("n"), F.sum("hit").alias("h"))
    total = by.agg(F.sum("n").alias("all"), F.sum("h").alias("hits"), F.max("n").alias("most"))  # one row
    r = lambda c, name: F.round(c, 6).alias(name)
    return by.join(F.broadcast(total)).select("label", "n", r(F.col("h") / F.col("n"), "recall"), r(F.col("hits") / F.col("all"), "accuracy"), r(F.col("most") / F.col("all"), "majority"))


def transition_null(mentions: DataFrame, gold: DataFrame, rounds: int, gap: int = 6, seed: int = 7) -> DataFrame:
    """One row ``accuracy, null_mean, null_sd, z``: accuracy of derived labels, and of labels derived after each sequence's places are dealt anew ``rounds`` times.

    A round orders a sequence's places by a hash of place and round; labels go back to the places they came from. All rounds run in one job.
    """
    places = mentions.select("seq", "pos").distinct().select("seq", "pos", F.explode(F.sequence(F.lit(0), F.lit(rounds))).alias("round"))
    w = Window.partitionBy("seq", "round")
    by_pos = places.withColumn("k", F.row_number().over(w.orderBy("pos"))).select("seq", "round", "k", F.col("pos").alias("slot"))
    # Round 0 leaves the order as it is.
    dealt = places.withColumn("k", F.row_number().over(w.orderBy(F.when(F.col("round") > 0, F.xxhash64("seq", "pos", "round", F.lit(seed))).otherwise(F.lit(0)), "pos")))
    slots = dealt.join(by_pos, ["seq", "round", "k"]).select("seq", "round", "pos", "slot")
    moved = mentions.join(slots, ["seq", "pos"]).select(F.struct("seq", "round").alias("seq"), F.col("slot").alias("pos"), "entity")
    back = transitions(moved, gap).select("seq.seq", "seq.round", F.col("pos").alias("slot"), "label").join(slots, ["seq", "round", "slot"])
    hit = back.join(gold.withColumnRenamed("label", "gold"), ["seq", "pos"]).groupBy("round").agg(F.avg((F.col("label") == F.col("gold")).cast("int")).alias("a"))
    null = F.when(F.col("round") > 0, F.col("a"))
    s = hit.agg(F.max(F.when(F.col("round") == 0, F.col("a"))).alias("accuracy"), F.avg(null).alias("null_mean"), F.stddev_pop(null).alias("null_sd"))
    return s.withColumn("z", F.when(F.col("null_sd") > 1e-9, (F.col("accuracy") - F.col("null_mean")) / F.col("null_sd")).otherwise(0.0))


def antecedents(mentions: DataFrame) -> DataFrame:
    """``seq, pos, antecedent``: nearest earlier place that shares an entity."""
    before = F.lag("pos").over(Window.partitionBy("seq", "entity").orderBy("pos"))
    return mentions.select("seq", "pos", before.alias("b")).groupBy("seq", "pos").agg(F.max("b").alias("antecedent"))


def antecedent_scores(ranking: DataFrame, gold: DataFrame, rounds: int = 200) -> DataFrame:
    """One row ``queries, top1, top3, low, high``: how often a ranking (``seq, pos, candidate, rank``) has the true antecedent (``seq, pos, antecedent``, those
    without one aren't asked) first or among the first three, with the bootstrap interval of top1."""
    asked = gold.where("antecedent IS NOT NULL")
    at = ranking.select("seq", "pos", F.col("candidate").alias("antecedent"), "rank")
    hit = asked.join(at, ["seq", "pos", "antecedent"], "left").groupBy("seq", "pos").agg(F.min("rank").alias("rank"))
    hit = hit.select(F.xxhash64("seq", "pos").alias("id"), F.coalesce((F.col("rank") == 1).cast("double"), F.lit(0.0)).alias("top1"), F.coalesce((F.col("rank") <= 3).cast("double"), F.lit(0.0)).alias("top3"))
    means = hit.agg(F.count("*").alias("queries"), F.coalesce(F.avg("top1"), F.lit(0.0)).alias("top1"), F.coalesce(F.avg("top3"), F.lit(0.0)).alias("top3"))
    return means.join(bootstrap(hit, "top1", "id", rounds).select("low", "high"))  # two single rows


def by_shared(mentions: DataFrame, most: int = 3) -> DataFrame:
    """``seq, pos, candidate, rank``: earlier places by how many entities they share (``seq, pos, entity``), the nearer first of equals, up to ``most``."""
    m = mentions.select("seq", "pos", "entity").distinct()
    shared = m.join(m.withColumnRenamed("pos", "candidate"), ["seq", "entity"]).where("candidate < pos").groupBy("seq", "pos", "candidate").agg(F.count("*").alias("n"))
    w = Window.partitionBy("seq", "pos").orderBy(F.col("n").desc(), F.col("candidate").desc())
    return shared.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select("seq", "pos", "candidate", "rank")


def two_means(rows: DataFrame, key: str, order: str, vec_col: str, rounds: int = 20) -> DataFrame:
    """``key, n, verdict, separation, z``: two clusters of a key's vectors, seeded by the least similar pair; the runs test of their order
    tells becoming from split, little separation is stable, under six rows are too few.

    Keys and orders are numbers, an order is distinct within its key. The pair comes from block kernels, and a round's new
    centres from sums, so a key of any size is no one task's. A key ends where a round moves nothing, or would leave one cluster.
    """
    from sparrowgrid.functions import vector as V
    from sparrowgrid.operators import neighbours
    from sparrowgrid.operators.graph import cut

    u = rows.where(F.col(vec_col).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(order).cast("long").alias("at"), V.normalise(V.as_double(F.col(vec_col))).alias("v"))
    n = cut(u.groupBy("key").agg(F.count("*").alias("n")))
    u = cut(u.join(n.where("n >= 6").select("key"), "key", "left_semi").withColumn("id", F.row_number().over(Window.partitionBy("key").orderBy("at"))))
    # Ids of blocks are distinct over keys: they tell rows, the place in the key breaks ties.
    coded = u.select(F.xxhash64("key", "at").alias("id"), "key", F.concat("v", F.array(F.col("id").cast("double"))).alias("v"))

    def least(x, y) -> dict:
        s = np.round(x.v[:, :-1] @ y.v[:, :-1].T, 9)
        s[~((x.label[:, None] == y.label[None, :]) & (x.v[:, -1:] < y.v[:, -1:].T))] = np.inf
        out = {c: [] for c in ("key", "a", "b", "s")}
        for lab in np.unique(x.label):
            mine = np.flatnonzero(x.label == lab)
            some = s[mine]
            if (low := some.min(initial=np.inf)) < np.inf:
                p, q = np.nonzero(some == low)
                first = np.lexsort((y.v[q, -1], x.v[mine[p], -1]))[0]
                for c, v in zip(out, (int(lab), int(x.v[mine[p[first]], -1]), int(y.v[q[first], -1]), low), strict=True):
                    out[c].append(v)
        return {"key": np.array(out["key"], np.int64), "a": np.array(out["a"], np.int64), "b": np.array(out["b"], np.int64), "s": np.array(out["s"], float)}

    b = neighbours.blocks(coded, "id", "v", "key")
    seeds = neighbours.against(b, b, least, "key long, a long, b long, s double").groupBy("key").agg(F.min(F.struct("s", "a", "b")).alias("m")).select("key", "m.a", "m.b")
    at = lambda c: u.select("key", F.col("id").alias(c), F.col("v").alias(f"v{c}"))
    centres = cut(seeds.join(at("a"), ["key", "a"]).join(at("b"), ["key", "b"]).select("key", "va", "vb"))
    sides = cut(u.select("key", "id", F.lit(False).alias("side")))
    going = centres.select("key")
    for _ in range(rounds):
        moved = u.join(centres.join(going, "key", "left_semi"), "key").select("key", "id", "v", (V.dot(F.col("v"), F.col("vb")) > V.dot(F.col("v"), F.col("va"))).alias("new")).join(sides, ["key", "id"])
        moved = cut(moved)
        said = moved.groupBy("key").agg(F.count_if(F.col("new") != F.col("side")).alias("moves"), F.count_if("new").alias("ones"), F.count("*").alias("all"))
        going = cut(said.where((F.col("moves") > 0) & (F.col("ones") > 0) & (F.col("ones") < F.col("all"))).select("key"))
        if going.isEmpty():
            break
        moved = moved.join(going, "key", "left_semi")
        sides = cut(moved.select("key", "id", F.col("new").alias("side")).unionByName(sides.join(going, "key", "left_anti")))
        c = neighbours.centroids(moved, ["key", "new"], "v").select("key", "new", V.normalise(F.col("centroid")).alias("c"))
        pair = c.groupBy("key").agg(F.max(F.when(~F.col("new"), F.col("c"))).alias("va"), F.max(F.when(F.col("new"), F.col("c"))).alias("vb"))
        centres = cut(pair.unionByName(centres.join(going, "key", "left_anti")))
    turn = (F.col("side") != F.lag("side").over(Window.partitionBy("key").orderBy("id"))).cast("int")
    runs = sides.withColumn("turn", turn).groupBy("key").agg(F.count_if(~F.col("side")).alias("n1"), F.count_if("side").alias("n2"), (F.sum(F.coalesce("turn", F.lit(0))) + 1).alias("runs"))
    z = F.round(runs_z(F.col("n1").cast("double"), F.col("n2").cast("double"), F.col("runs")), 6)
    found = runs.join(centres, "key").select("key", "n1", "n2", F.round(1 - V.dot(F.col("va"), F.col("vb")), 6).alias("apart"), z.alias("z"))
    j = n.join(found, "key", "left")
    verdict = F.when(F.col("n") < 6, "too-few").when((F.col("apart") < 0.15) | (F.col("n1") == 0) | (F.col("n2") == 0), "stable").when(F.col("z") <= -1.96, "becoming").otherwise("split")
    return j.select("key", "n", verdict.alias("verdict"), F.coalesce("apart", F.lit(0.0)).alias("separation"), F.coalesce("z", F.lit(0.0)).alias("z"))


def deviations(rows: DataFrame, key: str, order: str, vec_col: str, id_col: str) -> DataFrame:
    """``id, key, sim, kind`` of rows under their key's bar, the mean similarity to the centroid less a deviation: a variation if some later
    row of the key is nearer to it than that row is to the centroid, else a mistake. Keys of under three rows have none.

    Keys and orders are numbers. Whether there is such a later row is looked for block by block (each block pair gives at most one
    witness a row), so pairs are never rows.
    """
    from sparrowgrid.functions import vector as V
    from sparrowgrid.operators import neighbours
    from sparrowgrid.operators.graph import cut

    u = rows.where(F.col(vec_col).isNotNull() & F.col(key).isNotNull()).select(F.col(id_col).alias("id"), F.col(key).cast("double").alias("key"), F.col(order).cast("double").alias("at"), V.normalise(V.as_double(F.col(vec_col))).alias("v"))
    c = neighbours.centroids(u, ["key"], "v").where("n >= 3").select("key", V.normalise(F.col("centroid")).alias("c"))
    s = u.join(c, "key").select("id", "key", "at", "v", F.round(V.dot(F.col("v"), F.col("c")), 9).alias("sim"))
    bar = s.groupBy("key").agg((F.avg("sim") - F.stddev_pop("sim")).alias("bar"))
    # Place and similarity ride at the end of the vector.
    s = cut(s.join(bar, "key").select("id", "key", "sim", (F.col("sim") < F.col("bar")).alias("out"), F.concat("v", F.array("at", "sim")).alias("v")))

    def witness(x, y) -> dict:
        near = np.round(np.clip(x.v[:, :-2] @ y.v[:, :-2].T, -1, 1), 9)
        later = (x.label[:, None] == y.label[None, :]) & (y.v[None, :, -2] > x.v[:, None, -2])
        return {"i": x.id[(later & (near > y.v[None, :, -1])).any(1)]}

    left, right = neighbours.blocks(s.where("out"), "id", "v", "key"), neighbours.blocks(s, "id", "v", "key")
    taken = neighbours.against(left, right, witness, "i long").distinct().withColumnRenamed("i", "id")
    out = s.where("out").join(taken.withColumn("taken", F.lit(True)), "id", "left")
    return out.select("id", F.col("key").cast("long").alias("key"), "sim", F.when(F.col("taken"), "variation").otherwise("mistake").alias("kind"))


def adjusted_rand(rows: DataFrame, a: str, b: str) -> DataFrame:
    """One row ``n, ari`` of two partitions, from counts alone; 0 where it is degenerate."""
    cells = rows.groupBy(a, b).agg(F.count("*").alias("c"))
    two = lambda c: c * (c - 1) / 2
    both = cells.agg(F.sum("c").alias("n"), F.sum(two(F.col("c"))).alias("ij"))
    i = cells.groupBy(a).agg(F.sum("c").alias("c")).agg(F.sum(two(F.col("c"))).alias("i"))
    j = cells.groupBy(b).agg(F.sum("c").alias("c")).agg(F.sum(two(F.col("c"))).alias("j"))
    one = both.join(i).join(j)  # three single rows
    expected = F.col("i") * F.col("j") / two(F.col("n"))
    top = (F.col("i") + F.col("j")) / 2 - expected
    return one.select("n", F.round(F.when((F.col("n") < 2) | (top == 0), 0.0).otherwise((F.col("ij") - expected) / top), 6).alias("ari"))


def scaling_exponent(points: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """``key, slope``: regression slope over the upper half of a key's points by x (all, if under four); null where degenerate."""
    w = Window.partitionBy(key)
    p = points.withColumns({"r": F.row_number().over(w.orderBy(x)), "n": F.count("*").over(w)}).where((F.col("n") < 4) | (F.col("r") > F.floor(F.col("n") / 2)))
    return p.groupBy(key).agg(F.round(F.regr_slope(y, x), 6).alias("slope"))


def bootstrap(values: DataFrame, value: str, id_col: str, rounds: int = 200, seed: int = 7) -> DataFrame:
    """``mean, low, high``: Poisson bootstrap of a mean, so that replicates are sums and no row is gathered; weights come from a hash of (id, replicate)."""
    rows = values.where(F.col(value).isNotNull()).select(F.col(id_col).alias("id"), F.col(value).alias("x"))
    u = F.pmod(F.xxhash64("id", "b", F.lit(seed)), F.lit(1_000_000)) / 1e6
    weight = sum((F.when(u >= p, 1).otherwise(0) for p in (0.36788, 0.73576, 0.91970, 0.98101, 0.99634, 0.99941)), F.lit(0))
    b = rows.select("id", "x", F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("b")).select("b", "x", weight.alias("w"))
    means = b.groupBy("b").agg((F.sum(F.col("x") * F.col("w")) / F.nullif(F.sum("w"), F.lit(0))).alias("m"))
    ends = means.agg(F.sort_array(F.collect_list("m")).alias("m"))
    at = lambda q: F.get("m", F.floor(F.size("m") * q).cast("int"))  # noqa: E731  null without values
    return ends.join(rows.agg(F.avg("x").alias("mean"))).select("mean", at(0.025).alias("low"), at(0.975).alias("high"))
