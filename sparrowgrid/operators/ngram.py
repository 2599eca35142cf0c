"""N-gram back-off tables: ``counts(n, context, next, cnt)`` with the context as text joined by spaces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparrowgrid.operators.graph import cut

ALPHA, ADD_K = 0.4, 0.5


def counts(sequences: DataFrame, tokens: str, order: int, keys: list[str] | None = None) -> DataFrame:
    """All n-grams of 1 to ``order`` tokens; partial counts are made before the shuffle."""
    keys = keys or []
    size = F.size(tokens)

    def of(n: int) -> Column:
        starts = F.when(size >= n, F.sequence(F.lit(1), size - n + 1)).otherwise(F.array().cast("array<int>"))
        one = lambda i: F.struct(F.lit(n).alias("n"), F.array_join(F.slice(tokens, i, n - 1), " ").alias("context"), F.element_at(F.col(tokens), i + n - 1).alias("next"))
        return F.transform(starts, one)

    # The n-grams themselves are exploded: a sequence's tokens don't ride along with each of them.
    grams = sequences.select(*keys, F.explode(F.concat(*[of(n) for n in range(1, order + 1)])).alias("g"))
    return grams.select(*keys, "g.n", "g.context", "g.next").groupBy(*keys, "n", "context", "next").agg(F.count("*").alias("cnt"))


def prune(table: DataFrame, least: int, vocabulary: int) -> DataFrame:
    """Rows of at least ``least``, whose next token is among the most frequent single tokens."""
    kept = table.where(F.col("cnt") >= least)
    top = kept.where("n = 1").orderBy(F.col("cnt").desc(), "next").limit(vocabulary).select("next")
    return kept.join(top, "next", "left_semi")


def stats(table: DataFrame) -> DataFrame:
    """One row of table statistics; branching is kept as the format defines it, all counts over single-token rows."""
    branch = table.groupBy("n", "context").agg(F.count("*").alias("b"))
    a = table.agg(F.sum("cnt").alias("entries"), F.count_if(F.col("n") == 1).alias("vocabulary"), F.max("n").alias("max_order"))
    return a.join(branch.agg(F.max("b").alias("max_branching"))).withColumn("entries_per_unigram", F.round(F.col("entries") / F.col("vocabulary"), 6))


def top_next(table: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("n", "context").orderBy(F.col("cnt").desc(), "next")
    return table.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def cell_tables(steps: DataFrame, seq: str, pos: str, symbol: str, order: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cells, flat, support) of ordered symbols: ``cell, n, context, next, cnt``, ``n, context, next, cnt`` and ``cell, support``.

    A step is evidence of the cell that it is at: its window holds up to ``order`` symbols before it, itself and the one after; the
    n-grams of all windows of a cell are its table. Windows overlap, so a step's symbols count in several. A window of one symbol counts
    for the support alone. The flat table has each n-gram once. Windows come from the rows around a step: no sequence is one array.
    """
    w = Window.partitionBy(seq).orderBy(pos)
    around = [*[F.lag(symbol, k).over(w) for k in range(order, 0, -1)], F.col(symbol), F.lead(symbol, 1).over(w)]
    rows = steps.where(F.col(symbol).isNotNull()).select(F.col(symbol).alias("cell"), F.array_compact(F.array(*around)).alias("w"), F.array_compact(F.array(*around[1:-1])).alias("h"))
    cells = counts(rows.where(F.size("w") >= 2), "w", order, ["cell"])
    # Each n-gram that ends at a step.
    ends = F.transform(F.sequence(F.lit(1), F.size("h")), lambda n: F.struct(n.alias("n"), F.array_join(F.slice("h", F.size("h") - n + 1, n - 1), " ").alias("context")))
    flat = rows.select("cell", F.explode(ends).alias("g")).groupBy("g.n", "g.context", F.col("cell").alias("next")).agg(F.count("*").alias("cnt"))
    return cells, flat, rows.groupBy("cell").agg(F.count("*").alias("support"))


def cell_next(contexts: DataFrame, tables: tuple[DataFrame, DataFrame, DataFrame], order: int, k: int, least: int) -> DataFrame:
    """``id, next, p, rank, source``: the k likeliest symbols after each ``id, context array<string>``, from the longest seen end of the context.

    The table of the context's last symbol is asked where its support is at least ``least``, else (and for an empty context) the flat one.
    """
    cells, flat, support = tables
    c = contexts.withColumn("cell", F.try_element_at("context", F.lit(-1))).join(support.where(F.col("support") >= least), "cell", "left")
    source = F.when(F.col("support").isNotNull(), "cell").otherwise("flat")
    size = F.size("context")
    levels = F.transform(F.sequence(F.lit(1), F.least(size + 1, F.lit(order))), lambda n: F.struct(n.alias("n"), F.array_join(F.slice("context", size - n + 2, n - 1), " ").alias("context")))
    asked = c.select("id", "cell", source.alias("source"), F.explode(levels).alias("l")).select("id", "cell", "source", "l.n", "l.context")
    found = asked.where("source = 'cell'").join(cells, ["cell", "n", "context"]).select("id", "source", "n", "next", "cnt")
    found = found.unionByName(asked.where("source = 'flat'").join(flat, ["n", "context"]).select("id", "source", "n", "next", "cnt"))
    longest = found.withColumn("_m", F.max("n").over(Window.partitionBy("id"))).where(F.col("n") == F.col("_m"))
    w = Window.partitionBy("id")
    ranked = longest.withColumns({"p": F.col("cnt") / F.sum("cnt").over(w), "rank": F.row_number().over(w.orderBy(F.col("cnt").desc(), "next"))})
    return ranked.where(F.col("rank") <= k).select("id", "next", "p", "rank", "source")


def probability(queries: DataFrame, table: DataFrame, order: int) -> DataFrame:
    """``query columns, p``: back-off probability of ``next`` after ``context array<string>``, a row for each query.

    From the longest context down: a seen context with the token gives penalty * count / total, one without the token costs
    a factor alpha, an unseen context costs nothing; single tokens are smoothed by adding k. Only queries that no longer
    context answers go down a level. Joins sort: a small file can hold more n-grams than any estimate of its size says.
    """
    cols, done, left = queries.columns, None, queries.withColumn("_f", F.lit(1.0))
    for n in range(order, 1, -1):
        level = table.where(F.col("n") == n)
        seen = level.select(F.col("context").alias("_c"), "next", "cnt", F.sum("cnt").over(Window.partitionBy("context")).alias("_t"))
        suffix = F.when(F.size("context") >= n - 1, F.array_join(F.slice("context", F.size("context") - n + 2, n - 1), " "))
        met = cut(left.withColumn("_c", suffix).join(seen.hint("merge"), ["_c", "next"], "left"))
        one = met.where("cnt IS NOT NULL").select(*cols, (F.col("_f") * F.col("cnt") / F.col("_t")).alias("p"))
        done = one if done is None else done.unionByName(one)
        missed = met.where("cnt IS NULL")
        if missed.isEmpty():
            return done
        contexts = level.select(F.col("context").alias("_c")).distinct().withColumn("_seen", F.lit(True))
        left = missed.drop("cnt", "_t").join(contexts.hint("merge"), "_c", "left").withColumn("_f", F.when(F.col("_seen"), F.col("_f") * ALPHA).otherwise(F.col("_f"))).drop("_c", "_seen")
    entries = table.agg(F.sum("cnt").alias("entries"), F.coalesce(F.sum(F.when(F.col("n") == 1, F.col("cnt"))), F.lit(0)).alias("t1"))
    single = left.join(table.where("n = 1").select("next", F.col("cnt").alias("c1")).hint("merge"), "next", "left").join(F.broadcast(entries))
    last = single.select(*cols, (F.col("_f") * (F.coalesce("c1", F.lit(0)) + ADD_K) / (F.col("t1") + ADD_K * F.col("entries"))).alias("p"))
    return last if done is None else done.unionByName(last)


def generate(table: DataFrame, start: list[str], steps: int, order: int) -> list[str]:
    """Greedy decoding; it ends where nothing was observed. Each step asks all orders at once, and only the best row of each comes to the driver."""
    best = cut(table.groupBy("n", "context").agg(F.min(F.struct((-F.col("cnt")).alias("c"), "next")).alias("b")).select("n", "context", "b.next"))
    out = list(start)
    for _ in range(steps):
        contexts = {n: " ".join(out[len(out) - n + 1 :]) for n in range(1, min(order, len(out) + 1) + 1)}
        asked = F.lit(False)
        for n, c in contexts.items():
            asked = asked | ((F.col("n") == n) & (F.col("context") == c))
        found = best.where(asked).collect()  # at most one row for each order
        if not found:
            break
        out.append(max(found, key=lambda r: r["n"])["next"])
    return out


class TableModel:
    """An n-gram table as a model: what it can do is said, and what it can't is refused."""

    capabilities = frozenset({"generate", "score"})

    def __init__(self, table: DataFrame, order: int):
        self.table, self.order = table, order

    def metadata(self) -> dict:
        r = stats(self.table).first()
        return {"kind": "ngram", "order": self.order, "entries": r["entries"], "vocabulary": r["vocabulary"]}

    def generate(self, prompt: list[str], steps: int) -> list[str]:
        return generate(self.table, prompt, steps, self.order)

    def score(self, queries: DataFrame) -> DataFrame:
        return probability(queries, self.table, self.order)

    def embed(self, *_):
        raise ValueError("an n-gram table has no embeddings")
