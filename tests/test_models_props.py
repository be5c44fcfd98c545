"""Property checks for the rows-only (model-based or random) queries."""
import math

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from conftest import SF001
from tessera.operators import encoders as A, numeric as N


@pytest.fixture(scope="module")
def qs():
    return E.queries()


def test_lda_rows_sum_to_one(spark, qs):
    rows = qs["v6_lda_text"](spark, SF001).collect()
    assert rows and all(abs(sum(r[1:]) - 1.0) < 1e-6 for r in rows)


def test_pca_scores_centred_and_lsa_normalised(spark, qs):
    pca = qs["v3_pca_text"](spark, SF001)
    means = pca.agg(*[F.avg(c) for c in pca.columns if c != "doc_id"]).first()
    assert all(abs(m) < 1e-6 for m in means)
    lsa = qs["v5_lsa_text"](spark, SF001).collect()
    norms = [math.sqrt(sum(x * x for x in r[1:])) for r in lsa]
    assert all(abs(n - 1.0) < 1e-9 or n == 0.0 for n in norms)


def test_fold_run_covers_each_labelled_row_once(spark, qs):
    out = qs["m4_gbt_fold_run"](spark, SF001)
    n_lab = spark.read.parquet(f"{SF001}/labels.parquet").count()
    tr = out.where(F.col("split") == "train")
    per = tr.groupBy("doc_id", "label").count()
    assert per.where(F.col("count") != 1).count() == 0
    assert per.count() == 2 * n_lab
    assert out.where((F.col("pred") < 0) | (F.col("pred") > 1)).count() == 0


def test_importances(spark, qs):
    rows = qs["o2_feature_importances"](spark, SF001).collect()
    assert abs(sum(r["importance"] for r in rows) - 1.0) < 1e-9
    assert [r["importance"] for r in rows] == sorted((r["importance"] for r in rows), reverse=True)


def test_noise_seeded_and_zero_noise_exact(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 0.0), ("b", 1.0)], "c string, target double")
    t = A.fit_target_encoding(df, "c", "target", 1, 1)
    exact = {r["c"]: r["e"] for r in A.apply_target_encoding(df, t, "c", "e").collect()}
    n1 = [r["e"] for r in A.apply_target_encoding(df, t, "c", "e", noise_level=1e-3, seed=3).collect()]
    n2 = [r["e"] for r in A.apply_target_encoding(df, t, "c", "e", noise_level=1e-3, seed=3).collect()]
    assert n1 == n2
    assert all(abs(x - exact[c]) <= 0.01 * abs(exact[c]) for x, c in zip(n1, ["a", "a", "b"]))


def test_boxcox_lambda_maximises_likelihood(spark):
    df = spark.range(1, 400).select((F.col("id") * 1.7 + 3.0).alias("x"))
    lam = N.fit_boxcox_lambda(df, "x")
    xs = [r[0] for r in df.collect()]

    def llf(l):
        y = [math.log(v) if abs(l) < 1e-12 else (v ** l - 1) / l for v in xs]
        m = sum(y) / len(y)
        var = sum((a - m) ** 2 for a in y) / len(y)
        return (l - 1) * sum(math.log(v) for v in xs) - len(xs) / 2 * math.log(var)
    assert all(llf(lam) >= llf(lam + d) - 1e-9 for d in (-0.01, -0.001, 0.001, 0.01))


def test_word2vec_and_tree_embedding_shapes(spark, qs):
    w = qs["e6_word2vec"](spark, SF001)
    assert w.where(F.size("vec") != 16).count() == 0 and w.count() > 0
    t = qs["v10_random_trees_embedding"](spark, SF001)
    assert t.groupBy("row_id").count().where(F.col("count") != 5).count() == 0
