import math

from pyspark.sql import functions as F

from tessera.operators import ensemble as EN, folds as FO


def test_kfold_partition_balanced_and_stable(spark):
    df = spark.range(1000).withColumnRenamed("id", "doc_id")
    a = {r[0]: r[1] for r in FO.kfold(df, "doc_id", 5, 11).collect()}
    b = {r[0]: r[1] for r in FO.kfold(df.repartition(13), "doc_id", 5, 11).collect()}
    assert a == b and set(a) == set(range(1000))
    sizes = [list(a.values()).count(f) for f in range(5)]
    assert max(sizes) - min(sizes) <= 1


def test_stratified_balance(spark):
    df = spark.createDataFrame([(i, 1 if i % 10 == 0 else 0) for i in range(500)], "doc_id long, y int")
    out = FO.stratified_kfold(df, "doc_id", F.col("y"), 5, 3).collect()
    for y in (0, 1):
        sizes = [sum(1 for r in out if r["y"] == y and r["fold"] == f) for f in range(5)]
        assert max(sizes) - min(sizes) <= 1


def test_holdout_fraction(spark):
    df = spark.range(20000).withColumnRenamed("id", "doc_id")
    frac = FO.holdout_split(df, "doc_id", 0.2, 1).where("is_val").count() / 20000
    assert abs(frac - 0.2) < 0.02


def test_blends(spark):
    df = spark.createDataFrame([(1, "t", 0, 0.2), (1, "t", 1, 0.8), (2, "t", 0, 0.0), (2, "t", 1, 0.5)],
                               "doc_id long, label string, model int, pred double")
    geo = {r[0]: r[2] for r in EN.geometric_blend(df, ["doc_id", "label"]).collect()}
    assert abs(geo[1] - math.sqrt(0.16)) < 1e-12 and geo[2] is None
    w = {r[0]: r[2] for r in EN.weighted_blend(df, ["doc_id", "label"], {0: 2, 1: 8}).collect()}
    assert abs(w[1] - (0.2 * 2 + 0.8 * 8) / 10) < 1e-12
    m = EN.stack_matrix(df, "doc_id", ["t"], [0, 1]).orderBy("doc_id").collect()
    assert m[0]["t_preds_model1"] == 0.8
