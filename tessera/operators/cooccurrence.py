"""Word vectors from counted neighbourhoods (E6): a co-occurrence table, shifted positive PMI
and its leading directions, all long tables; no vocabulary and no model sits on the driver."""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import explode_rows
from ..session import reliable_checkpoint
from . import blocks as B
from .decompose import fit_subspace, transform_subspace


def cooccurrences(df: DataFrame, tokens: Column, window: int = 5) -> DataFrame:   # E6
    """(a, b, n): how often two words stand within ``window`` places of each other in a text, a
    pair d places apart weighing 1 / d; both directions are listed.  ``n`` is a whole number of
    1 / lcm(1..window), so sums are exact."""
    unit = math.lcm(*range(1, window + 1))
    docs = df.select(tokens.alias("__t"))
    size = F.size("__t")

    def apart(d: int) -> Column:
        m = F.greatest(size - d, F.lit(0))
        zipped = F.arrays_zip(F.slice("__t", 1, m).alias("x"), F.slice("__t", 1 + d, m).alias("y"))
        return F.transform(zipped, lambda s: F.struct(F.least(s["x"], s["y"]).alias("a"), F.greatest(s["x"], s["y"]).alias("b"), F.lit(unit // d).cast("long").alias("n")))

    pairs = explode_rows(docs, [], F.concat(*[apart(d) for d in range(1, window + 1)]), "p")
    # unordered pairs are summed once, then listed both ways
    half = pairs.groupBy("p.a", "p.b").agg(F.sum("p.n").alias("n"))
    ways = F.when(F.col("a") == F.col("b"), F.array(F.struct("a", "b", (F.col("n") * 2).alias("n")))).otherwise(
        F.array(F.struct("a", "b", "n"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "n")))
    return half.select(F.explode(ways).alias("w")).select("w.a", "w.b", "w.n")


def shifted_ppmi(co: DataFrame, shift: float = 1.0, min_count: int = 1) -> DataFrame:
    """(a, b, ppmi): ln(n * total / (n of a * n of b)) - ln(shift) where that is positive; words
    whose weights sum to less than ``min_count`` take no part."""
    sums = reliable_checkpoint(co.groupBy("a").agg(F.sum("n").alias("s")).where(F.col("s") >= min_count))
    j = co.join(sums.select("a", F.col("s").alias("sa")), "a").join(sums.select(F.col("a").alias("b"), F.col("s").alias("sb")), "b")
    total = sums.select(F.sum("s").cast("double")).scalar()
    pmi = F.log(F.col("n") * total / (F.col("sa").cast("double") * F.col("sb"))) - F.lit(math.log(shift))
    return j.select("a", "b", pmi.alias("ppmi")).where(F.col("ppmi") > 0)


def word_vectors(ppmi: DataFrame, dim: int = 50, seed: int = 1337) -> DataFrame:
    """(word, vec): U sqrt(S) of the PPMI matrix, by subspace iteration over its long table."""
    weights = reliable_checkpoint(ppmi.select(F.col("a").alias("word"), F.col("b").alias("term"), F.col("ppmi").alias("weight")))
    words = weights.select("word").distinct()
    packed = B.packed(weights, "word")
    model = fit_subspace(weights, "word", dim, 0, seed=seed, packed=packed)
    scores = transform_subspace(weights, words, "word", model, "v")
    packed[0].unpersist()
    root = [math.sqrt(s) for s in model["singular"]]
    return scores.select("word", F.array(*[(F.col(f"v{j}") / r if r > 1e-9 else F.lit(0.0)).alias(f"v{j}") for j, r in enumerate(root)]).alias("vec"))
