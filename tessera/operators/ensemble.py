"""Out-of-fold tables, stacking and blends.

Predictions live in one long table (row_id, label, model, [bag], [fold], pred); the
reference's axis means are group-by averages, its stacked matrix a pivot with a
given value list (no extra pass to discover pivot values).
"""
from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold_mean(preds: DataFrame, keys: Sequence[str], pred: str = "pred") -> DataFrame:
    """Mean over the remaining axes (folds, bags) per ``keys``."""
    return preds.groupBy(*keys).agg(F.avg(pred).alias(pred))


def stack_matrix(preds: DataFrame, row_key: str, labels: Sequence[str], models: Sequence,
                 label_col: str = "label", model_col: str = "model", pred: str = "pred") -> DataFrame:   # M11
    """Columns ``{label}_preds_model{m}`` (mean over folds/bags) - a pivot with an
    explicit value list."""
    tag = F.concat(F.col(label_col), F.lit("_preds_model"), F.col(model_col).cast("string"))
    values = [f"{l}_preds_model{m}" for m in models for l in labels]
    return preds.withColumn("__c", tag).groupBy(row_key).pivot("__c", values).agg(F.avg(pred))


def geometric_mean(pred: str = "pred") -> Column:
    """exp(mean(ln p)) of a group; any p <= 0 gives null."""
    bad = F.max(F.when(F.col(pred) <= 0, 1).otherwise(0))
    return F.when(bad == 0, F.exp(F.avg(F.log(F.when(F.col(pred) > 0, F.col(pred))))))


def harmonic_mean(pred: str = "pred") -> Column:
    """n / sum(1 / p) of a group; any p <= 0 gives null."""
    bad = F.max(F.when(F.col(pred) <= 0, 1).otherwise(0))
    return F.when(bad == 0, F.try_divide(F.count(pred), F.sum(F.try_divide(F.lit(1.0), F.col(pred)))))


def weighted_mean(weights: Mapping, model_col: str = "model", pred: str = "pred") -> Column:
    """sum(w * p) / sum(w) over a group's models with a weight (a literal map, fixed size);
    null when there is none or the weights sum to 0."""
    items = [x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))]
    w = F.try_element_at(F.create_map(*items), F.col(model_col))
    return F.try_divide(F.sum(w * F.col(pred)), F.sum(w))


def geometric_blend(preds: DataFrame, keys: Sequence[str], pred: str = "pred", name: str = "geo") -> DataFrame:   # M12
    return preds.groupBy(*keys).agg(geometric_mean(pred).alias(name))


def harmonic_blend(preds: DataFrame, keys: Sequence[str], pred: str = "pred", name: str = "harm") -> DataFrame:   # M12
    return preds.groupBy(*keys).agg(harmonic_mean(pred).alias(name))


def weighted_blend(preds: DataFrame, keys: Sequence[str], weights: Mapping, model_col: str = "model",
                   pred: str = "pred", name: str = "blend") -> DataFrame:   # M13
    return preds.where(F.col(model_col).isin(*weights)).groupBy(*keys).agg(
        weighted_mean(weights, model_col, pred).alias(name))


def blends(preds: DataFrame, keys: Sequence[str], weights: Mapping, model_col: str = "model", pred: str = "pred") -> DataFrame:
    """geo, harm and blend of every group, by one aggregate."""
    return preds.groupBy(*keys).agg(geometric_mean(pred).alias("geo"), harmonic_mean(pred).alias("harm"),
                                    weighted_mean(weights, model_col, pred).alias("blend"))


def pick_target_columns(columns: Sequence[str], col: str = "toxic") -> list[str]:   # P16
    """Names containing ``col`` (for 'toxic' without 'severe' ones), sorted."""
    return sorted({c for c in columns if col in c and not (col == "toxic" and "severe" in c)})


def feature_list(columns: Sequence[str], targets: Sequence[str]) -> list[str]:   # P17
    """The columns that are no targets, sorted."""
    return sorted(set(columns) - set(targets))
