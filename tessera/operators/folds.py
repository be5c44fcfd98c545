"""Reproducible splits and folds (M1-M3).

Assignment depends only on (seed, id) - never on partitioning or row order - so it is
stable under repartitioning and executor loss.  Balanced and stratified folds rank
rows by the hash with the distributed index; a stratum holding a third of the rows
is ranked across many tasks, not one.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import global_index

KNUTH = 2654435761
TWO32 = 4294967296
TWO31 = 2147483648


def id_hash(id_col: str, seed: int, method: str = "xxhash") -> Column:
    """Deterministic per-id hash: Spark's xxhash64, or a multiplicative hash that
    plain SQL engines can repeat (``method='knuth'``, integer ids)."""
    if method == "xxhash":
        return F.xxhash64(F.lit(seed), F.col(id_col))
    if method == "knuth":
        # reduced first, so that no id overflows the product
        return F.pmod(F.pmod(F.col(id_col).cast("bigint"), F.lit(TWO31)) * F.lit(KNUTH) + F.lit(seed), F.lit(TWO32))
    raise ValueError("method must be 'xxhash' or 'knuth'")


def holdout_split(df: DataFrame, id_col: str, test_size: float = 0.2, seed: int = 1337,
                  method: str = "xxhash", out_col: str = "is_val") -> DataFrame:   # M1
    h = F.pmod(id_hash(id_col, seed, method), F.lit(1_000_000))
    return df.withColumn(out_col, h < F.lit(int(round(test_size * 1_000_000))))


def kfold(df: DataFrame, id_col: str, n_splits: int = 5, seed: int = 1337, method: str = "xxhash",
          balanced: bool = True, out_col: str = "fold") -> DataFrame:   # M2
    """``balanced``: rank by hash, fold = rank mod k (sizes differ by at most one);
    otherwise fold = hash mod k."""
    h = id_hash(id_col, seed, method)
    if not balanced:
        return df.withColumn(out_col, F.pmod(h, F.lit(n_splits)).cast("int"))
    # only the keys are ranked; the rows meet their fold by a join
    keys = df.select(id_col).distinct().withColumn("__h", h)
    ranked = global_index(keys, [F.col("__h").asc(), F.col(id_col).asc()], name="__r")
    folds = ranked.select(F.col(id_col).alias("__id"), F.pmod(F.col("__r"), F.lit(n_splits)).cast("int").alias(out_col))
    return df.join(folds, F.col(id_col).eqNullSafe(F.col("__id"))).drop("__id")


def stratified_kfold(df: DataFrame, id_col: str, stratum: Column, n_splits: int = 5, seed: int = 1337,
                     method: str = "xxhash", out_col: str = "fold") -> DataFrame:   # M3
    """Within each stratum, rank ids by hash and deal them round-robin to folds; only id and
    stratum are ranked, the rows meet their fold by a join."""
    h = id_hash(id_col, seed, method)
    tagged = df.select(id_col, stratum.alias("__st")).distinct().withColumn("__h", h)
    ranked = global_index(tagged, [F.col("__st").asc_nulls_first(), F.col("__h").asc(), F.col(id_col).asc()],
                          name="__r")
    # one row per stratum; AQE broadcasts it after measuring it (a caller may pass a
    # high-cardinality stratum, so no unconditional broadcast)
    start = ranked.groupBy("__st").agg(F.min("__r").alias("__s0"))
    out = ranked.join(start, ranked["__st"].eqNullSafe(start["__st"])).drop(start["__st"])
    folds = out.select(F.col(id_col).alias("__id"), F.col("__st").alias("__of"),
                       F.pmod(F.col("__r") - F.col("__s0"), F.lit(n_splits)).cast("int").alias(out_col))
    tagged = df.withColumn("__st", stratum)
    return (tagged.join(folds, F.col(id_col).eqNullSafe(F.col("__id")) & F.col("__st").eqNullSafe(F.col("__of")))
            .drop("__id", "__of", "__st"))


def label_sum(labels) -> Column:
    """Stratum = number of positive labels (reference k-fold)."""
    total = F.lit(0)
    for l in labels:
        total = total + F.coalesce(F.col(l).cast("int"), F.lit(0))
    return total


def label_argmax(labels) -> Column:
    """Stratum = index of the largest label, 0 for all-zero rows (bagged run, Q19)."""
    best = F.lit(0)
    best_v = F.col(labels[0])
    for i, l in enumerate(labels[1:], start=1):
        better = F.col(l) > best_v
        best = F.when(better, F.lit(i)).otherwise(best)
        best_v = F.greatest(best_v, F.col(l))
    return best
