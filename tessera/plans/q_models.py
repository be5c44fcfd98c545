"""Validation and ensembles: splits and folds, OOF tables, stacking, blends, exact
AUC and run statistics (M1-M3, M10-M13, S10)."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ensemble as EN, folds as FO
from ..operators.metrics import best_runs, macro_auc, prediction_spread, record_run, roc_auc, run_statistics
from ..sources.files import scratch_dir
from ..sources.tables import corpus, read_table
from .catalog import register

LABELS = ["toxic", "quality"]
MODELS = [0, 1, 2]
K = 5
SEED = 1337
H_SQL = f"((((doc_id % {FO.TWO31}) + {FO.TWO31}) % {FO.TWO31} * {FO.KNUTH} + {SEED}) % {FO.TWO32})"


def r6(c):
    return F.round(c, 6)


@register("m1_holdout_split", f"SELECT doc_id, CAST({H_SQL} % 1000000 < 200000 AS INTEGER) AS is_val FROM documents")
def m1_holdout_split(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents").select("doc_id")
    out = FO.holdout_split(d, "doc_id", 0.2, SEED, method="knuth")
    return out.select("doc_id", F.col("is_val").cast("int").alias("is_val"))


@register("m2_kfold", f"""SELECT doc_id, CAST((row_number() OVER (ORDER BY {H_SQL}, doc_id) - 1) % {K} AS INTEGER) AS fold
FROM documents""")
def m2_kfold(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents").select("doc_id")
    return FO.kfold(d, "doc_id", K, SEED, method="knuth").select("doc_id", "fold")


STRAT_SQL = f"""SELECT l.doc_id, l.toxic, l.quality,
  CAST((row_number() OVER (PARTITION BY l.toxic + l.quality ORDER BY {H_SQL}, l.doc_id) - 1) % {K} AS INTEGER) AS fold
FROM labels l"""


@register("m3_stratified_kfold", f"SELECT doc_id, fold FROM ({STRAT_SQL})")
def m3_stratified_kfold(spark, sf_dir):
    return _folds(spark, sf_dir).select("doc_id", "fold")


def _folds(spark, sf_dir):
    lab = read_table(spark, sf_dir, "labels").select("doc_id", "toxic", "quality")
    return FO.stratified_kfold(lab, "doc_id", FO.label_sum(LABELS), K, SEED, method="knuth")


# OOF predictions derived from the data (fixture R10): train rows carry their own
# fold and a score that leans on the label; test rows get one score per fold.
def _base(model, label_idx, fold):
    return (F.pmod(F.col("doc_id") * (7 + 3 * model) + 13 * fold + 5 * label_idx, F.lit(1000)) + 1) / 1001.0


def _oof(spark, sf_dir):
    folds = _folds(spark, sf_dir)
    rows = []
    for li, lab in enumerate(LABELS):
        for m in MODELS:
            base = _base(m, li, F.col("fold"))
            rows.append(folds.select("doc_id", F.lit(lab).alias("label"), F.lit(m).alias("model"),
                                     "fold", F.lit("train").alias("split"),
                                     (0.5 * F.col(lab) + 0.5 * base).alias("pred"), F.col(lab).alias("y")))
    train = rows[0]
    for r in rows[1:]:
        train = train.unionByName(r)
    c = corpus(spark, sf_dir).where(F.col("split") == "test").select("doc_id")
    grid = F.explode(F.array(*[F.struct(F.lit(lab).alias("label"), F.lit(li).alias("li"), F.lit(m).alias("model"),
                                        F.lit(f).alias("fold"))
                               for li, lab in enumerate(LABELS) for m in MODELS for f in range(K)]))
    test = c.select("doc_id", grid.alias("g")).select(
        "doc_id", "g.label", "g.model", "g.fold", F.lit("test").alias("split"),
        ((F.pmod(F.col("doc_id") * (7 + 3 * F.col("g.model")) + 13 * F.col("g.fold") + 5 * F.col("g.li"),
                 F.lit(1000)) + 1) / 1001.0).alias("pred"),
        F.lit(None).cast("int").alias("y"))
    return train.unionByName(test)


def _oof_sql():
    tr = []
    for li, lab in enumerate(LABELS):
        for m in MODELS:
            tr.append(f"SELECT doc_id, '{lab}' AS label, {m} AS model, fold, 'train' AS split, "
                      f"0.5 * {lab} + 0.5 * (((doc_id * {7 + 3 * m} + 13 * fold + {5 * li}) % 1000) + 1) / 1001.0 AS pred, "
                      f"{lab} AS y FROM st")
    te = []
    for li, lab in enumerate(LABELS):
        for m in MODELS:
            for f in range(K):
                te.append(f"SELECT doc_id, '{lab}' AS label, {m} AS model, {f} AS fold, 'test' AS split, "
                          f"(((doc_id * {7 + 3 * m} + {13 * f} + {5 * li}) % 1000) + 1) / 1001.0 AS pred, "
                          f"CAST(NULL AS INTEGER) AS y FROM tst")
    return (f"st AS ({STRAT_SQL}), tst AS (SELECT doc_id FROM documents ANTI JOIN labels USING (doc_id)), "
            f"oof AS ({' UNION ALL '.join(tr + te)})")


def _stack_sql():
    cols = ", ".join(f"round(avg(CASE WHEN label = '{l}' AND model = {m} THEN pred END), 6) AS {l}_preds_model{m}"
                     for m in MODELS for l in LABELS)
    return f"WITH {_oof_sql()} SELECT doc_id, split, {cols} FROM oof GROUP BY doc_id, split"


@register("m11_oof_stack_matrix", _stack_sql())
def m11_oof_stack_matrix(spark, sf_dir):
    oof = _oof(spark, sf_dir)
    m = EN.stack_matrix(oof.withColumn("row", F.struct("doc_id", "split")), "row", LABELS, MODELS)
    cols = [c for c in m.columns if c != "row"]
    return m.select("row.doc_id", "row.split", *[r6(c).alias(c) for c in cols])


BLEND_SQL = f"""WITH {_oof_sql()}, fm AS (SELECT doc_id, split, label, model, avg(pred) AS pred FROM oof GROUP BY ALL)
SELECT doc_id, split, label, round(exp(avg(ln(pred))), 6) AS geo, round(count(pred) / sum(1.0 / pred), 6) AS harm,
  round(sum(CASE model WHEN 0 THEN 2.0 WHEN 1 THEN 8.0 END * pred) / sum(CASE model WHEN 0 THEN 2.0 WHEN 1 THEN 8.0 END), 6) AS blend
FROM fm GROUP BY doc_id, split, label"""


def _blends(spark, sf_dir):
    fm = EN.fold_mean(_oof(spark, sf_dir), ["doc_id", "split", "label", "model"])
    return EN.blends(fm, ["doc_id", "split", "label"], {0: 2.0, 1: 8.0})


@register("m12_m13_blends", BLEND_SQL)
def m12_m13_blends(spark, sf_dir):
    """Geometric, harmonic and weighted (2:8) blends across models of fold-mean
    predictions."""
    b = _blends(spark, sf_dir)
    return b.select("doc_id", "split", "label", r6("geo").alias("geo"), r6("harm").alias("harm"),
                    r6("blend").alias("blend"))


@register("m10_blend_auc", f"""WITH {_oof_sql()}, fm AS (SELECT doc_id, label, model, avg(pred) AS pred, max(y) AS y
  FROM oof WHERE split = 'train' GROUP BY ALL),
g AS (SELECT doc_id, label, max(y) AS y, exp(avg(ln(pred))) AS score FROM fm GROUP BY doc_id, label),
per AS (SELECT label, score, sum(CASE WHEN y = 1 THEN 1 ELSE 0 END) AS pos, sum(CASE WHEN y = 1 THEN 0 ELSE 1 END) AS neg
  FROM g GROUP BY label, score),
cum AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY label ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM per)
SELECT label, CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg,
  round(sum(pos * (below + 0.5 * neg)) / (sum(pos) * sum(neg)::DOUBLE), 6) AS auc FROM cum GROUP BY label""")
def m10_blend_auc(spark, sf_dir):
    """Exact ROC-AUC per label of the geometric blend of OOF predictions."""
    oof = _oof(spark, sf_dir).where(F.col("split") == "train")
    fm = oof.groupBy("doc_id", "label", "model").agg(F.avg("pred").alias("pred"), F.max("y").alias("y"))
    g = EN.geometric_blend(fm, ["doc_id", "label"], name="score").join(
        fm.groupBy("doc_id", "label").agg(F.max("y").alias("y")), ["doc_id", "label"])
    a = roc_auc(g, "y", "score", by=["label"])
    return a.select("label", "n_pos", "n_neg", r6("auc").alias("auc"))


def _run_table(spark, sf_dir):
    """AUC per model, label and fold, written to a run table (one run per model) and read
    back."""
    oof = _oof(spark, sf_dir).where(F.col("split") == "train")
    per_fold = roc_auc(oof, "y", "pred", by=["model", "label", "fold"]).where(F.col("auc").isNotNull())
    path = scratch_dir(spark, "runs")
    record_run(per_fold, path, "folds")
    return spark.read.parquet(path).withColumn("run", F.concat(F.lit("model"), F.col("model").cast("string")))


_FOLD_AUC_SQL = f"""WITH {_oof_sql()}, t AS (SELECT * FROM oof WHERE split = 'train'),
per AS (SELECT model, label, fold, pred AS score, sum(CASE WHEN y = 1 THEN 1 ELSE 0 END) AS pos,
        sum(CASE WHEN y = 1 THEN 0 ELSE 1 END) AS neg FROM t GROUP BY model, label, fold, pred),
cum AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY model, label, fold ORDER BY score
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM per),
a AS (SELECT model, label, fold, sum(pos * (below + 0.5 * neg)) / (sum(pos) * sum(neg)::DOUBLE) AS auc
      FROM cum GROUP BY model, label, fold HAVING sum(pos) > 0 AND sum(neg) > 0)"""


@register("m10_macro_auc", _FOLD_AUC_SQL + """
SELECT model, fold, CAST(count(auc) AS BIGINT) AS n_labels, round(avg(auc), 6) AS macro_auc FROM a GROUP BY model, fold""")
def m10_macro_auc(spark, sf_dir):
    """Mean over the labels of the exact AUC, per model and fold."""
    m = macro_auc(_run_table(spark, sf_dir), by=["model", "fold"])
    return m.select("model", "fold", "n_labels", r6("macro_auc").alias("macro_auc"))


@register("m14_best_runs", _FOLD_AUC_SQL + """, mean AS (SELECT 'model' || model AS run, label, avg(auc) AS m FROM a GROUP BY model, label)
SELECT label, run, round(m, 6) AS mean FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY m DESC, run) AS r FROM mean) WHERE r = 1""")
def m14_best_runs(spark, sf_dir):
    """Per label the recorded run with the best mean fold AUC."""
    b = best_runs(_run_table(spark, sf_dir), "auc", by=["label"])
    return b.select("label", "run", r6("mean").alias("mean"))


@register("s10_prediction_spread", f"""WITH {_oof_sql()} SELECT model, label, round(stddev_pop(y), 6) AS std_target,
  round(stddev_pop(pred), 6) AS std_pred FROM oof WHERE split = 'train' GROUP BY model, label""")
def s10_prediction_spread(spark, sf_dir):
    """Std of the targets against that of the out-of-fold predictions."""
    p = prediction_spread(_oof(spark, sf_dir).where(F.col("split") == "train"), "y", "pred", by=["model", "label"])
    return p.select("model", "label", r6("std_target").alias("std_target"), r6("std_pred").alias("std_pred"))


@register("s10_run_statistics", f"""WITH {_oof_sql()}, t AS (SELECT * FROM oof WHERE split = 'train'),
per AS (SELECT model, label, fold, pred AS score, sum(CASE WHEN y = 1 THEN 1 ELSE 0 END) AS pos,
        sum(CASE WHEN y = 1 THEN 0 ELSE 1 END) AS neg FROM t GROUP BY model, label, fold, pred),
cum AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY model, label, fold ORDER BY score
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM per),
a AS (SELECT model, label, fold, sum(pos * (below + 0.5 * neg)) / (sum(pos) * sum(neg)::DOUBLE) AS auc
      FROM cum GROUP BY model, label, fold HAVING sum(pos) > 0 AND sum(neg) > 0)
SELECT model, label, CAST(count(*) AS BIGINT) AS n, round(min(auc), 6) AS min, round(max(auc), 6) AS max,
  round(avg(auc), 6) AS mean, round(stddev_pop(auc), 6) AS std FROM a GROUP BY model, label""")
def s10_run_statistics(spark, sf_dir):
    """Per model and label: min / max / mean / population std of the per-fold AUC."""
    st = run_statistics(_run_table(spark, sf_dir), "auc", by=["model", "label"])
    return st.select("model", "label", "n", *[r6(c).alias(c) for c in ("min", "max", "mean", "std")])
