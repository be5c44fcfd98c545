"""One key holding a third of all rows: results stay exact and the plans never put a
whole group in one window partition (aggregates are combined map-side first)."""
from pyspark.sql import functions as F

from tessera.operators import corpus as C, groups as G
from tessera.operators.metrics import roc_auc


def _plan(df):
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString()


def skewed(spark, n=30000):
    return spark.range(n).select(
        F.col("id").alias("row_id"),
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise((F.col("id") % 997).cast("string")).alias("k"),
        (F.col("id") % 7).cast("double").alias("x"),
        F.when(F.col("id") % 3 == 0, F.lit("same text")).otherwise(F.concat(F.lit("t"), (F.col("id") % 50).cast("string"))).alias("text"))


def test_group_transform_hot_key(spark):
    df = skewed(spark)
    out = G.group_transform(df, "k", ["x"], ["mean", "count"])
    hot = out.where(F.col("k") == "hot").select("k_by_x_mean", "k_by_x_count").distinct().collect()
    exp = df.where(F.col("k") == "hot").agg(F.avg("x"), F.count("x")).first()
    assert len(hot) == 1 and abs(hot[0][0] - exp[0]) < 1e-12 and hot[0][1] == exp[1]
    plan = _plan(out)
    assert "partial_avg" in plan and "Window" not in plan


def test_duplicates_hot_text(spark):
    df = skewed(spark)
    out = C.duplicate_features(df, "text", "row_id")
    r = out.where(F.col("text") == "same text").agg(F.sum("duplicated"), F.max("comment_freq")).first()
    assert r[0] == 9999 and r[1] == 10000
    plan = _plan(out)
    assert "partial_count" in plan and "Window" not in plan


def test_auc_hot_score(spark):
    df = skewed(spark).select(((F.col("row_id") % 2) == 0).cast("int").alias("y"),
                              F.when(F.col("k") == "hot", F.lit(0.5)).otherwise(F.col("x")).alias("s"))
    a = roc_auc(df, "y", "s").first()
    assert a["n_pos"] + a["n_neg"] == 30000 and 0.0 <= a["auc"] <= 1.0
