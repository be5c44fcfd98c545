"""Exact ROC-AUC (M10) and run statistics."""
from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import global_prefix


def roc_auc(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Exact ROC-AUC per ``by`` group with ties counted as one half.

    AUC = sum over distinct scores s of pos(s) * (neg_below(s) + neg(s)/2) / (P * N).
    Rows are first reduced to one row per (group, distinct score); the running count
    of negatives below each score is a distributed prefix sum, so no task ever holds
    a whole group.  Groups with only one class give null.
    """
    by = list(by)
    per_score = (df.where(F.col(label).isNotNull() & F.col(score).isNotNull())
                 .groupBy(*by, score)
                 .agg(F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).cast("bigint").alias("__pos"),
                      F.sum(F.when(F.col(label) == 1, 0).otherwise(1)).cast("bigint").alias("__neg")))
    order = [F.col(c).asc_nulls_first() for c in by] + [F.col(score).asc()]
    pref = global_prefix(per_score, order, {"__cum": F.col("__neg")}, inclusive=False)
    if by:
        start = pref.groupBy(*by).agg(F.min("__cum").alias("__start"))
        pref = pref.join(start, by).withColumn("__below", F.col("__cum") - F.col("__start"))
    else:
        pref = pref.withColumn("__below", F.col("__cum"))
    agg = pref.groupBy(*by).agg(
        F.sum("__pos").alias("n_pos"), F.sum("__neg").alias("n_neg"),
        F.sum(F.col("__pos") * (F.col("__below") + F.col("__neg") * 0.5)).alias("__num"))
    auc = F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0),
                 F.col("__num") / (F.col("n_pos").cast("double") * F.col("n_neg")))
    return agg.select(*by, "n_pos", "n_neg", auc.alias("auc"))


def run_statistics(metrics: DataFrame, value: str = "metric", by: Sequence[str] = ("run",)) -> DataFrame:
    """Min / max / mean / population std of a per-fold or per-bag metric."""
    return metrics.groupBy(*by).agg(
        F.count(F.lit(1)).cast("bigint").alias("n"),
        F.min(value).alias("min"), F.max(value).alias("max"),
        F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))


def macro_auc(aucs: DataFrame, by: Sequence[str] = (), auc: str = "auc") -> DataFrame:
    """Mean over the labels of their AUC; labels with one class only are left out."""
    return aucs.groupBy(*by).agg(F.count(auc).cast("bigint").alias("n_labels"), F.avg(auc).alias("macro_auc"))


def record_run(metrics: DataFrame, path: str, run: str) -> None:
    """Append the metrics of a run (one row per fold and label, any columns) to the run
    table at ``path``, under the run's name."""
    metrics.withColumn("run", F.lit(run)).write.mode("append").parquet(path)


def best_runs(runs: DataFrame, value: str = "auc", by: Sequence[str] = ("label",), lowest: bool = False) -> DataFrame:
    """Per ``by`` group the run with the best mean metric of the run table (M14), ties to
    the first name."""
    mean = runs.groupBy("run", *by).agg(F.avg(value).alias("mean"))
    rank = F.struct((F.col("mean") if lowest else -F.col("mean")).alias("m"), "run")
    best = mean.where("mean is not null").groupBy(*by).agg(F.min(rank).alias("b"))
    return best.select(*by, F.col("b.run").alias("run"), (F.col("b.m") if lowest else -F.col("b.m")).alias("mean"))


def prediction_spread(df: DataFrame, target: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """Population std of the targets against that of the predictions."""
    return df.groupBy(*by).agg(F.stddev_pop(target).alias("std_target"), F.stddev_pop(pred).alias("std_pred"))
