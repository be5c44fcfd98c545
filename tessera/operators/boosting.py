"""Gradient boosted trees for every bag, fold and label in one pass per level (M4-M8, O2).

Features become bins once.  A row carries its bins, its labels, its fold in each bag and one
margin per model, so each level of one tree of *all* models is one scan: every task sums the
gradients by (model, node, feature, bin), Spark adds those sums up and picks the best cut of
every node.  What goes through the driver is the model: ``bags x labels x folds x rounds x
2^depth`` nodes, all parameters.

Gradients are whole numbers of 2^-24, so sums do not depend on the order of rows or tasks: a
lost executor or another partitioning gives the same trees.
"""
from __future__ import annotations

import os
import uuid
from dataclasses import dataclass
from typing import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import delete_folder, ensure_checkpoint_dir, spread_width
from .folds import holdout_split, label_argmax, label_sum, stratified_kfold
from .models import label_features

SCALE = 1 << 24
UNKNOWN = -1.0                                  # a label that is null: the row does not count there
SUMS = "model int, node int, feature int, bin int, g bigint, h bigint, n bigint"


@dataclass
class Boosted:
    """Fitted models.  Model ``(bag * labels + label) * folds + fold`` starts at ``prior`` and
    adds its tree of each of the first ``best`` rounds; a tree is (feature, last bin on the
    left, value, gain) by heap number, feature -1 where it ends."""
    features: list[str]
    edges: list[list[float]]
    labels: list[str]
    folds: int
    bags: int
    prior: list[float]
    trees: list[dict]
    best: list[int]
    losses: list[list[float | None]]            # by round, mean log loss of each model's own fold


def bin_edges(df: DataFrame, features: Sequence[str], n_bins: int = 32, accuracy: int = 10_000) -> dict[str, list[float]]:
    """Cuts between bins at approximate quantiles, by one aggregate; null and NaN left out."""
    x = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    share = [k / n_bins for k in range(1, n_bins)]
    row = df.agg(*[F.percentile_approx(x(c), share, accuracy).alias(f"q{k}") for k, c in enumerate(features)]).first()
    return {c: sorted(set(row[k] or [])) for k, c in enumerate(features)}


def _bins(features: Sequence[str], edges: Sequence[Sequence[float]]) -> Column:
    """A value's bin is the number of edges below it; null and NaN have a bin of their own, the last."""
    def one(c, cuts):
        x = F.col(c).cast("double")
        below = F.aggregate(F.array(*map(F.lit, cuts)), F.lit(0), lambda n, e: n + (e < x).cast("int")) if cuts else F.lit(0)
        return F.when(x.isNull() | F.isnan(x), len(cuts) + 1).otherwise(below).cast("int")
    return F.array(*[one(c, e) for c, e in zip(features, edges)] or [F.lit(0)])


def _matrix(batch: pa.RecordBatch, name: str) -> np.ndarray:
    column = batch.column(name)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _leaves(bins: np.ndarray, tree: tuple, depth: int) -> np.ndarray:
    feature, last = tree[0], tree[1]
    node, row = np.zeros(len(bins), np.int64), np.arange(len(bins))
    for _ in range(depth):
        f = feature[node]
        node = np.where(f < 0, node, 2 * node + 1 + (bins[row, f] > last[node]))
    return node


def _raise(margin: np.ndarray, bins: np.ndarray, rounds: Sequence[dict], depth: int) -> np.ndarray:
    """``margin`` (rows x models) with the trees of these rounds added."""
    margin = margin.copy()
    for grown in rounds:
        for m, tree in grown.items():
            margin[:, m] += tree[2][_leaves(bins, tree, depth)]
    return margin


def _summer(labels: int, folds: int, watched: list, growing: dict, rounds: list, level: int, depth: int, width: int, allowed: list):
    """The task of one level: sums of gradients by (model, node, feature, bin) of the partition, and
    at the root (node -1) each watched model's loss on its own fold."""
    first, nodes = (1 << level) - 1, 1 << level

    def run(batches):
        hist = {m: np.zeros((3, len(allowed[m]), nodes * width), np.int64) for m in growing}
        lost = {m: [0, 0] for m in watched}
        for batch in batches:
            if not batch.num_rows:
                continue
            bins, y, fold = _matrix(batch, "__bins"), _matrix(batch, "__y"), _matrix(batch, "__folds")
            margin = _raise(_matrix(batch, "__margin"), bins, rounds, depth)
            for m in set(watched) | set(growing):
                f, lab, bag = m % folds, m // folds % labels, m // folds // labels
                known, mine = y[:, lab] >= 0, fold[:, bag] == f
                p = 1 / (1 + np.exp(-margin[:, m]))
                if m in lost:
                    at = known & mine
                    q = np.clip(np.where(y[at, lab] > 0, p[at], 1 - p[at]), 1e-15, 1)
                    lost[m][0] += int(np.rint(-np.log(q) * SCALE).astype(np.int64).sum())
                    lost[m][1] += int(at.sum())
                if m in growing:
                    node = _leaves(bins, growing[m], level) - first
                    at = np.flatnonzero(known & ~mine & (node >= 0))
                    g = np.rint((p[at] - y[at, lab]) * SCALE)
                    h = np.rint(p[at] * (1 - p[at]) * SCALE)
                    for i, k in enumerate(allowed[m]):
                        code = node[at] * width + bins[at, k]
                        for j, weight in enumerate((g, h, None)):
                            hist[m][j, i] += np.bincount(code, weight, nodes * width).astype(np.int64)
        out = [(m, -1, -1, -1, s, 0, n) for m, (s, n) in lost.items() if n]
        yield _sums([np.array([r[i] for r in out], np.int64) for i in range(7)])
        for m, (g, h, n) in hist.items():
            i, code = np.nonzero(n)
            yield _sums([np.full(len(i), m), first + code // width, np.array(allowed[m], np.int64)[i], code % width, g[i, code], h[i, code], n[i, code]])
    return run


def _sums(columns: list) -> pa.RecordBatch:
    names = ["model", "node", "feature", "bin", "g", "h", "n"]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i < 4 else pa.int64()) for i, c in enumerate(columns)], names)


def _best_cuts(sums: DataFrame, l2: float, min_rows: int) -> DataFrame:
    """(model, node, best): the cut with the largest gain of every node, ties to the first feature
    and bin.  A window holds the bins of one feature in one node.  Tasks hand over sums, which a
    partial aggregate would not shorten, so one shuffle serves the totals and the windows."""
    part = lambda g, h: f"({g}) / {SCALE}D * (({g}) / {SCALE}D) / (({h}) / {SCALE}D + {float(l2)}D)"
    run = ", ".join(f"sum({c}) OVER upto AS l{c}, sum({c}) OVER one AS t{c}" for c in "ghn")
    return sums.sparkSession.sql(f"""
        WITH total AS (SELECT model, node, feature, bin, sum(g) AS g, sum(h) AS h, sum(n) AS n FROM {{sums}} GROUP BY ALL),
        cut AS (SELECT model, node, feature, bin, {run} FROM total
            WINDOW one AS (PARTITION BY model, node, feature), upto AS (PARTITION BY model, node, feature ORDER BY bin)),
        scored AS (SELECT *, CASE WHEN node < 0 THEN 0D WHEN ln >= {int(min_rows)} AND tn - ln >= {int(min_rows)}
            THEN -({part('lg', 'lh')} + {part('tg - lg', 'th - lh')} - {part('tg', 'th')}) END AS loss FROM cut)
        SELECT model, node, min(struct(loss, feature, bin, lg, lh, tg, th, tn)) AS best FROM scored
        WHERE node < 0 OR loss < 0 GROUP BY model, node""", sums=sums.repartition("model", "node", "feature"))


def binned(df: DataFrame, key: str, models: Boosted) -> DataFrame:
    """Rows as ``predict_boosted`` takes them."""
    return df.select(F.col(key).alias("__key"), _bins(models.features, models.edges).alias("__bins"))


def fit_boosted(train: DataFrame, key: str, features: Sequence[str] | Mapping, labels: Sequence[str], n_folds: int = 5,
                n_bags: int = 1, seed: int = 1337, rounds: int = 20, depth: int = 3, step: float = 0.1, l2: float = 1.0,
                min_rows: int = 20, patience: int = 10, edges: Mapping[str, Sequence[float]] | None = None, n_bins: int = 32,
                stratify: bool | str = True, method: str = "xxhash", store_every: int = 5,
                fold_cols: Sequence[str] | None = None) -> tuple[Boosted, DataFrame]:
    """Models of all bags, labels and folds, and the binned rows they were fitted on.

    A model is fitted on the rows outside its fold and keeps the round whose log loss on the fold
    is least (the earliest of equals; all rounds where the fold has no row with a label); it stops
    ``patience`` rounds after that.  It starts at the log odds of its rows, half a row added to
    either class, so a constant label or an empty table is sound.  Margins are stored every
    ``store_every`` rounds, so a scan walks few trees.  ``features``: a list, or a mapping as in
    ``label_features``.  Null labels do not count for that label.  ``fold_cols``: the caller's
    folds, a column per bag, instead of stratified ones; a row in none of ``n_folds`` folds is
    fitted on by every model.
    """
    spark, labels = train.sparkSession, list(labels)
    by_label = [label_features(features, lab) for lab in labels]
    names = list(dict.fromkeys(c for cs in by_label for c in cs))
    if not names or not labels:
        raise ValueError("boosting takes at least one feature and one label")
    edges = edges or bin_edges(train, names, n_bins)
    cuts = [[float(v) for v in sorted(edges[c])] for c in names]
    n_bags = len(fold_cols) if fold_cols else n_bags
    width, per, models = max((len(e) for e in cuts), default=0) + 2, n_folds, n_bags * len(labels) * n_folds
    allowed = [[names.index(c) for c in by_label[m // per % len(labels)]] for m in range(models)]

    dealt = train.select(key, *[c for c in dict.fromkeys([*names, *labels]) if c != key],
                         *[F.coalesce(F.col(c).cast("int"), F.lit(-1)).alias(f"__fold{b}") for b, c in enumerate(fold_cols or [])])
    stratum = label_argmax(labels) if stratify == "argmax" else label_sum(labels) if stratify else F.lit(0)
    for b in range(0 if fold_cols else n_bags):
        dealt = stratified_kfold(dealt, key, stratum, n_folds, seed + b, method, out_col=f"__fold{b}")
    y = F.array(*[F.coalesce(F.col(lab).cast("double"), F.lit(UNKNOWN)) for lab in labels])
    rows = dealt.select(F.col(key).alias("__key"), _bins(names, cuts).alias("__bins"), y.alias("__y"),
                        F.array(*[F.col(f"__fold{b}") for b in range(n_bags)]).alias("__folds"))
    folder = os.path.join(ensure_checkpoint_dir(spark), "tessera-boost", uuid.uuid4().hex)
    # every level scans the table, so it is spread over the session's width once
    rows.repartition(spread_width(spark)).write.parquet(f"{folder}/rows")
    rows = spark.read.parquet(f"{folder}/rows")

    where = [(m // per // len(labels), m // per % len(labels), m % per) for m in range(models)]
    seen = [(F.col("__y")[lab] >= 0) & (F.col("__folds")[bag] != f) for bag, lab, f in where]
    count = rows.agg(*[F.count_if(s & (F.col("__y")[where[m][1]] == v)).alias(f"c{m}_{v}") for m, s in enumerate(seen) for v in (0, 1)]).first()
    prior = [float(np.log((count[2 * m + 1] + 0.5) / (count[2 * m] + 0.5))) for m in range(models)]

    state, stored = rows.withColumn("__margin", F.array(*map(F.lit, prior))), None
    size = (1 << (depth + 1)) - 1
    done, fresh, losses = [], [], []
    best = [(float("inf"), 0)] * models
    active = list(range(models))
    for r in range(rounds + 1):
        last = r == rounds
        grown = {} if last else {m: (np.full(size, -1), np.zeros(size, np.int64), np.zeros(size), np.zeros(size)) for m in active}
        for level in range(depth):
            task = _summer(len(labels), per, active if level == 0 else [], grown, fresh, level, depth, width, allowed)
            found = _best_cuts(state.mapInArrow(task, SUMS), l2, min_rows).collect()
            if level == 0:
                loss = {x["model"]: (x["best"]["tg"], x["best"]["tn"]) for x in found if x["node"] < 0}
                losses.append([loss[m][0] / SCALE / loss[m][1] if m in loss else None for m in range(models)])
                for m in active:
                    now = loss.get(m, (-r,))[0]           # no loss to go by: every round is better
                    best[m] = (now, r) if now < best[m][0] else best[m]
                active = [m for m in active if r - best[m][1] < patience]
                grown = {m: t for m, t in grown.items() if m in active}
            split = [x for x in found if x["node"] >= 0 and x["model"] in grown]
            for x in split:
                feature, cut, value, gain = grown[x["model"]]
                n, b = x["node"], x["best"]
                feature[n], cut[n], gain[n] = b["feature"], b["bin"], -b["loss"]
                for child, g, h in ((2 * n + 1, b["lg"], b["lh"]), (2 * n + 2, b["tg"] - b["lg"], b["th"] - b["lh"])):
                    value[child] = -step * (g / SCALE) / (h / SCALE + l2)
            if not split:
                break
        if last or not active:
            break
        done.append(grown)
        fresh.append(grown)
        if len(fresh) == store_every:
            path = f"{folder}/margins-{r}"
            state.mapInArrow(_stored(fresh, depth), state.schema).write.parquet(path)
            if stored:
                delete_folder(spark, stored)
            state, stored, fresh = spark.read.parquet(path), path, []
    if stored:
        delete_folder(spark, stored)
    fitted = Boosted(names, cuts, labels, n_folds, n_bags, prior, done, [b for _, b in best], losses)
    return fitted, rows


def _stored(fresh: list, depth: int):
    rounds = list(fresh)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                margin = _raise(_matrix(batch, "__margin"), _matrix(batch, "__bins"), rounds, depth)
                yield batch.set_column(batch.schema.names.index("__margin"), "__margin", _lists(margin))
    return run


def _lists(matrix: np.ndarray) -> pa.ListArray:
    n, k = matrix.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * k, pa.int32()), pa.array(matrix.ravel()))


def predict_boosted(models: Boosted, rows: DataFrame, own_fold: bool) -> DataFrame:
    """(__key, bag, label, fold, pred) of binned rows: of the model whose fold a row is in
    (``own_fold``), or of all."""
    prior, best, trees = models.prior, models.best, models.trees
    depth = max((len(t[0]).bit_length() - 1 for grown in trees for t in grown.values()), default=0)
    kept = [{m: t for m, t in grown.items() if r < best[m]} for r, grown in enumerate(trees)]

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                margin = _raise(np.tile(np.array(prior), (batch.num_rows, 1)), _matrix(batch, "__bins"), kept, depth)
                columns = [batch.column("__key"), _lists(1 / (1 + np.exp(-margin)))]
                if own_fold:
                    columns.append(batch.column("__folds"))
                yield pa.RecordBatch.from_arrays(columns, names)

    kinds = T.StructType([T.StructField("__key", rows.schema["__key"].dataType), T.StructField("__p", T.ArrayType(T.DoubleType()))]
                         + ([T.StructField("__folds", T.ArrayType(T.IntegerType()))] if own_fold else []))
    names = kinds.names
    per, n = models.folds, len(models.labels)
    scored = rows.select("__key", "__bins", *(["__folds"] if own_fold else [])).mapInArrow(run, kinds)
    flat = scored.select(*[c for c in names if c != "__p"], F.posexplode("__p").alias("__m", "pred"))
    group = F.floor(F.col("__m") / per).cast("int")
    flat = flat.select("*", F.floor(group / n).cast("int").alias("bag"), F.array(*map(F.lit, models.labels))[group % n].alias("label"),
                       (F.col("__m") % per).alias("fold"))
    if own_fold:
        flat = flat.where(F.get("__folds", F.col("bag")) == F.col("fold"))
    return flat.select("__key", "bag", "label", "fold", "pred")


def boosted_fold_run(train: DataFrame, test: DataFrame | None, key: str, features, labels, **how) -> DataFrame:   # M4 / M8
    """Out-of-fold predictions of ``train`` and every model's predictions of ``test``:
    (key, bag, label, fold, split, pred).  Parameters as in ``fit_boosted``."""
    models, rows = fit_boosted(train, key, features, labels, **how)
    out = predict_boosted(models, rows, own_fold=True).withColumn("split", F.lit("train"))
    if test is not None:
        scored = predict_boosted(models, binned(test, key, models), own_fold=False)
        out = out.unionByName(scored.withColumn("split", F.lit("test")))
    return out.select(F.col("__key").alias(key), "bag", "label", "fold", "split", "pred")


def boosted_bag_run(train: DataFrame, test: DataFrame | None, key: str, features, labels, split_size: float = 0.2,
                    seed: int = 1337, n_bags: int = 1, method: str = "xxhash", **how) -> DataFrame:   # M5
    """A hold-out split per bag (seed + bag), a model per bag and label stopped by it:
    (key, bag, label, split, pred) of the held-out (``valid``) and the test rows."""
    held = [f"__held{b}" for b in range(n_bags)]
    for b, c in enumerate(held):
        train = holdout_split(train, key, split_size, seed + b, method, out_col=c).withColumn(c, F.when(F.col(c), 0).otherwise(-1))
    out = boosted_fold_run(train, test, key, features, labels, n_folds=1, fold_cols=held, **how)
    return out.select(key, "bag", "label", F.when(F.col("split") == "train", "valid").otherwise(F.col("split")).alias("split"), "pred")


def full_boosted(train: DataFrame, key: str, features, labels, **how) -> Boosted:   # M6
    """A model per label on all rows, all rounds kept."""
    return fit_boosted(train.withColumn("__none", F.lit(-1)), key, features, labels, n_folds=1, fold_cols=["__none"], **how)[0]


def model_table(spark: SparkSession, models: Boosted) -> DataFrame:
    """The nodes of all kept trees, the prior as round -1: (bag, label, fold, round, node,
    feature, cut, value, gain); ``cut`` is the largest value that goes left, null where only
    missing values go right."""
    n, out = len(models.labels), []
    for m, p in enumerate(models.prior):
        who = (m // models.folds // n, models.labels[m // models.folds % n], m % models.folds)
        out.append((*who, -1, 0, None, None, p, None))
        for r, grown in enumerate(models.trees[:models.best[m]]):
            feature, last, value, gain = grown[m]
            alive = [0] + [c for i in np.flatnonzero(feature >= 0) for c in (2 * i + 1, 2 * i + 2)]
            for i in map(int, alive):
                f = int(feature[i])
                cuts = models.edges[f] if f >= 0 else []
                cut = cuts[int(last[i])] if f >= 0 and last[i] < len(cuts) else None
                out.append((*who, r, i, models.features[f] if f >= 0 else None, cut, float(value[i]), float(gain[i])))
    return spark.createDataFrame(out, "bag int, label string, fold int, round int, node int, feature string, cut double, value double, gain double")


def from_table(nodes: DataFrame) -> Boosted:   # M7
    """The models of a ``model_table``, for example one read from a store; its size is the
    models', whatever they were fitted on.  Bins are cut where a tree cuts."""
    rows = nodes.collect()
    if not rows:
        raise ValueError("the table holds no model")
    labels = sorted({r["label"] for r in rows})
    folds, bags = max(r["fold"] for r in rows) + 1, max(r["bag"] for r in rows) + 1
    features = sorted({r["feature"] for r in rows if r["feature"] is not None})
    edges = [sorted({r["cut"] for r in rows if r["feature"] == c and r["cut"] is not None}) for c in features]
    count, size = folds * bags * len(labels), (1 << (max(r["node"] for r in rows) + 1).bit_length()) - 1
    prior, best = [0.0] * count, [0] * count
    trees = [{} for _ in range(max(r["round"] for r in rows) + 1)]
    for r in rows:
        m = (r["bag"] * len(labels) + labels.index(r["label"])) * folds + r["fold"]
        if r["round"] < 0:
            prior[m] = r["value"]
            continue
        best[m] = max(best[m], r["round"] + 1)
        feature, last, value, gain = trees[r["round"]].setdefault(m, (np.full(size, -1), np.zeros(size, np.int64), np.zeros(size), np.zeros(size)))
        value[r["node"]] = r["value"]
        if r["feature"] is not None:
            k = features.index(r["feature"])
            feature[r["node"]], gain[r["node"]] = k, r["gain"]
            last[r["node"]] = len(edges[k]) if r["cut"] is None else edges[k].index(r["cut"])
    return Boosted(features, edges, labels, folds, bags, prior, trees, best, [])


def gain_importances(nodes: DataFrame, top: int = 25) -> DataFrame:   # O2
    """Share of all gain by label and feature over bags and folds, the first ``top`` of each label."""
    by = nodes.where("feature IS NOT NULL").groupBy("label", "feature").agg(F.sum("gain").alias("gain"))
    one = Window.partitionBy("label")                       # one row per feature
    share = by.select("label", "feature", F.try_divide("gain", F.sum("gain").over(one)).alias("importance"))
    ranked = share.withColumn("rank", F.row_number().over(one.orderBy(F.col("importance").desc(), "feature")))
    return ranked.where(F.col("rank") <= top)
