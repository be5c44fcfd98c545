import random

from pyspark.sql import functions as F

from tessera.operators.metrics import roc_auc
from tessera.operators.ranking import global_index, global_prefix


def test_global_index_matches_sort(spark):
    vals = [(f"w{random.Random(i).randint(0, 10**6)}_{i}",) for i in range(500)]
    df = spark.createDataFrame(vals, "v string").repartition(7)
    got = dict((r["v"], r["idx"]) for r in global_index(df, [F.col("v").asc()]).collect())
    for i, v in enumerate(sorted(v for (v,) in vals)):
        assert got[v] == i


def test_global_prefix_inclusive(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(100)], "k int, x int").repartition(5)
    out = {r["k"]: r["c"] for r in global_prefix(df, [F.col("k").asc()], {"c": F.col("x")}, inclusive=True).collect()}
    run = 0
    for k in range(100):
        run += k % 3
        assert out[k] == run


def brute_auc(y, s):
    pos = [b for a, b in zip(y, s) if a == 1]
    neg = [b for a, b in zip(y, s) if a == 0]
    tot = sum((1.0 if p > n else 0.5 if p == n else 0.0) for p in pos for n in neg)
    return tot / (len(pos) * len(neg))


def test_auc_against_brute_force(spark):
    rnd = random.Random(3)
    data = [(g, rnd.randint(0, 1), round(rnd.random(), 1)) for g in ("a", "b") for _ in range(300)]
    df = spark.createDataFrame(data, "g string, y int, s double")
    got = {r["g"]: r["auc"] for r in roc_auc(df, "y", "s", by=["g"]).collect()}
    for g in ("a", "b"):
        sub = [(y, s) for gg, y, s in data if gg == g]
        assert abs(got[g] - brute_auc([a for a, _ in sub], [b for _, b in sub])) < 1e-12


def test_auc_perfect_and_constant(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.2), (1, 0.8), (1, 0.9)], "y int, s double")
    assert roc_auc(df, "y", "s").first()["auc"] == 1.0
    const = spark.createDataFrame([(0, 0.5), (1, 0.5), (1, 0.5)], "y int, s double")
    assert const.transform(lambda d: roc_auc(d, "y", "s")).first()["auc"] == 0.5
    one_class = spark.createDataFrame([(1, 0.5), (1, 0.7)], "y int, s double")
    assert roc_auc(one_class, "y", "s").first()["auc"] is None
