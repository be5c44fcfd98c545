"""Per-label models, fold runs, bagging and stacking with ``pyspark.ml`` (M4-M9, O2).

The protocol (folds x labels [x bags]) is a short driver loop over *fits*; every fit
is a distributed Spark ML job and every prediction stays a DataFrame.  Predictions
land in one long table (key, label, [bag], fold, pred) for the ensemble operators.
"""
from __future__ import annotations

from typing import Callable, Mapping, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, MultilayerPerceptronClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import reliable_checkpoint, spread_width
from .folds import holdout_split, label_argmax, label_sum, stratified_kfold


def assemble(df: DataFrame, features: Sequence[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol=out, handleInvalid="keep").transform(df)


def gbt(label: str, seed: int = 1337, max_iter: int = 20, max_depth: int = 3, step: float = 0.1,
        subsample: float = 0.8, feature_subset: str = "all", validation: bool = True) -> GBTClassifier:
    kw = dict(featuresCol="features", labelCol=label, maxIter=max_iter, maxDepth=max_depth,
              stepSize=step, subsamplingRate=subsample, featureSubsetStrategy=feature_subset, seed=seed)
    if validation:
        kw["validationIndicatorCol"] = "is_val"
    return GBTClassifier(**kw)


def _score(model, df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return model.transform(df).select(*keys, vector_to_array("probability")[1].alias("pred"))


def _stops_on_validation(estimator) -> bool:
    """Whether the estimator is told which rows are for validation only."""
    return estimator.hasParam("validationIndicatorCol") and estimator.isSet("validationIndicatorCol")


def label_features(features, label: str) -> list[str]:
    """The columns a label's model reads: a list serves every label; a mapping gives the
    shared ones under None and each label's own under its name."""
    if isinstance(features, Mapping):
        return list(dict.fromkeys([*features.get(None, []), *features.get(label, [])]))
    return list(features)


def fold_run(train: DataFrame, test: DataFrame | None, key: str, features: Sequence[str] | Mapping,
             labels: Sequence[str], n_folds: int = 5, seed: int = 1337,
             estimator: Callable[[str, int], object] | None = None, stratify: bool | str = True,
             bag: int | None = None) -> DataFrame:   # M4 / M8
    """For each fold and label: train on the other folds, predict the fold (out-of-fold)
    and the test rows.  The fold's rows reach the fit only when the estimator has a
    validation indicator (early stopping).  ``stratify``: by the number of positive
    labels, or ``'argmax'`` by the largest label.  Returns (key, label, fold, split,
    pred[, bag])."""
    estimator = estimator or (lambda lab, s: gbt(lab, s))
    strat = label_argmax(labels) if stratify == "argmax" else label_sum(labels) if stratify else F.lit(0)
    tr = stratified_kfold(train, key, strat, n_folds, seed)
    # every boosting iteration scans the frame, so it is stored, spread over the session's width
    tr = reliable_checkpoint(tr.repartition(spread_width(train.sparkSession)))
    te = reliable_checkpoint(test) if test is not None else None
    parts = []
    for f in range(n_folds):
        fold_df = tr.withColumn("is_val", F.col("fold") == f)
        for lab in labels:
            columns = label_features(features, lab)
            est = estimator(lab, seed + f)
            data = assemble(fold_df, columns).withColumn(lab, F.col(lab).cast("double"))
            model = est.fit(data if _stops_on_validation(est) else data.where(~F.col("is_val")))
            oof = _score(model, assemble(tr.where(F.col("fold") == f), columns), [key])
            parts.append(oof.select(key, F.lit(lab).alias("label"), F.lit(f).alias("fold"),
                                    F.lit("train").alias("split"), "pred"))
            if te is not None:
                parts.append(_score(model, assemble(te, columns), [key]).select(
                    key, F.lit(lab).alias("label"), F.lit(f).alias("fold"), F.lit("test").alias("split"), "pred"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    if bag is not None:
        out = out.withColumn("bag", F.lit(bag))
    return out


def bagged_fold_run(train: DataFrame, test: DataFrame | None, key: str, features, labels,
                    n_bags: int = 2, n_folds: int = 5, seed: int = 1337, **kw) -> DataFrame:   # M8
    """Bags differ by seed (base + bag), so each bag has its own folds (quirk Q21); strata
    are the largest label (quirk Q19)."""
    kw.setdefault("stratify", "argmax")
    runs = [fold_run(train, test, key, features, labels, n_folds, seed + b, bag=b, **kw) for b in range(n_bags)]
    out = runs[0]
    for r in runs[1:]:
        out = out.unionByName(r)
    return out


def bag_run(train: DataFrame, test: DataFrame | None, key: str, features, labels,
            split_size: float = 0.2, seed: int = 1337) -> DataFrame:   # M5
    """One seeded hold-out split; per label one model with early stopping on it."""
    tr = assemble(reliable_checkpoint(holdout_split(train, key, split_size, seed)), features)
    te = assemble(reliable_checkpoint(test), features) if test is not None else None
    parts = []
    for lab in labels:
        model = gbt(lab, seed).fit(tr.withColumn(lab, F.col(lab).cast("double")))
        parts.append(_score(model, tr.where("is_val"), [key]).select(
            key, F.lit(lab).alias("label"), F.lit("valid").alias("split"), "pred"))
        if test is not None:
            parts.append(_score(model, te, [key]).select(
                key, F.lit(lab).alias("label"), F.lit("test").alias("split"), "pred"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def full_train(train: DataFrame, features, label: str, n_rounds: int = 20, seed: int = 1337) -> PipelineModel:   # M6
    pipe = Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep"),
                            gbt(label, seed, max_iter=n_rounds, validation=False)])
    return pipe.fit(train.withColumn(label, F.col(label).cast("double")))


def predict_saved(path: str, df: DataFrame, keys: Sequence[str]) -> DataFrame:   # M7
    return _score(PipelineModel.load(path), df, keys)


def mlp_stacker(train: DataFrame, test: DataFrame, key: str, features, labels, hidden: int = 8,
                seed: int = 1337, max_iter: int = 100) -> DataFrame:   # M9
    """A small dense network per label on stacked predictions (no batch norm/dropout)."""
    tr = assemble(reliable_checkpoint(train), features)
    te = assemble(test, features)
    parts = []
    for lab in labels:
        mlp = MultilayerPerceptronClassifier(featuresCol="features", labelCol=lab, layers=[len(features), hidden, 2],
                                             seed=seed, maxIter=max_iter)
        model = mlp.fit(tr.withColumn(lab, F.col(lab).cast("double")))
        parts.append(_score(model, te, [key]).select(key, F.lit(lab).alias("label"), "pred"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def feature_importances(model, features: Sequence[str], top: int = 25) -> DataFrame:   # O2
    """Importances of a fitted tree model as a DataFrame, top ``top`` by value.
    The vector has one entry per feature (a bounded, driver-sized object)."""
    spark = SparkSession.getActiveSession()
    imp = model.featureImportances.toArray().tolist()
    df = spark.createDataFrame(list(zip(features, [float(x) for x in imp])), "feature string, importance double")
    return df.orderBy(F.col("importance").desc(), F.col("feature")).limit(top)
