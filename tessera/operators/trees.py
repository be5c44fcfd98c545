"""Totally random trees as an embedding.

All trees grow together, level by level: one aggregate gives the range of every column in
every node of every tree; a node splits on the first column, in an order keyed by (seed,
tree, node), that is not constant there, at a threshold keyed the same way.  No label is
involved.  What goes through the driver is ``trees x 2^depth`` nodes, both parameters.
"""
from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .encoders import keyed_uniform

LEAST_ROWS = 2


def _next(node: Column, tree: int, splits: dict, cols: Sequence[str]) -> Column:
    """The child of a row's node: numbers 2n + 1 and 2n + 2; unsplit nodes stay."""
    mine = {n: s for (t, n), s in splits.items() if t == tree}
    if not mine:
        return node
    column = F.try_element_at(F.create_map(*[F.lit(x) for n, (c, _) in mine.items() for x in (n, c)]), node)
    cut = F.try_element_at(F.create_map(*[F.lit(x) for n, (_, v) in mine.items() for x in (n, v)]), node)
    value = F.get(F.array(*[F.col(c).cast("double") for c in cols]), column)
    return F.when(column.isNull(), node).otherwise(2 * node + F.when(value <= cut, 1).otherwise(2))


def random_trees(df: DataFrame, cols: Sequence[str], n_trees: int = 10, max_depth: int = 5, seed: int = 1337,
                 prefix: str = "tree") -> DataFrame:   # V10
    """``df`` with the number of each tree's leaf (heap order, the root is 0) in ``prefix0`` ...;
    a null counts as larger than any threshold."""
    names = [f"{prefix}{t}" for t in range(n_trees)]
    now = df.select("*", *[F.lit(0).alias(c) for c in names])
    for _ in range(max_depth):
        at = F.explode(F.array(*[F.struct(F.lit(t).alias("tree"), F.col(c).alias("node")) for t, c in enumerate(names)])).alias("at")
        ranges = (now.select(at, *cols).groupBy("at.tree", "at.node")
                  .agg(F.count(F.lit(1)).alias("n"), *[f(F.col(c).cast("double")).alias(f"{f.__name__}_{k}") for k, c in enumerate(cols) for f in (F.min, F.max)])
                  .where(F.col("n") >= LEAST_ROWS))
        # the column with the least keyed draw among those that vary, and where to cut it
        u = lambda *key: keyed_uniform(seed, "tree", "node", *key, method="md5")
        choice = F.array_sort(F.array_compact(F.array(*[
            F.when(F.col(f"min_{k}") < F.col(f"max_{k}"), F.struct(u(F.lit(k)).alias("u"), F.lit(k).alias("k"), F.col(f"min_{k}").alias("lo"), F.col(f"max_{k}").alias("hi")))
            for k in range(len(cols))])))
        picked = ranges.where(F.size(choice) > 0).select("tree", "node", choice[0].alias("c"))
        rows = picked.select("tree", "node", "c.k", (F.col("c.lo") + u(F.lit("cut")) * (F.col("c.hi") - F.col("c.lo"))).alias("cut")).collect()
        splits = {(r["tree"], r["node"]): (r["k"], r["cut"]) for r in rows}
        if not splits:
            break
        now = now.select(*df.columns, *[_next(F.col(c), t, splits, cols).alias(c) for t, c in enumerate(names)])
    return now
