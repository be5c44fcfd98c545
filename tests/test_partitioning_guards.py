"""Regression: branches of one hash-partitioned input, unioned and then joined on a
key prefix, must not skip the join's shuffle (seen with AQE and union output
partitioning in Spark 4.1)."""
from pyspark.sql import functions as F

from conftest import SF01
from tessera.functions import tokens as T
from tessera.operators.graph import keyterm_scores
from tessera.session import apply_guards
from tessera.sources.tables import read_table


def test_union_join_counts(spark):
    apply_guards(spark)
    d = spark.range(20000).select((F.col("id") % 500).alias("k"), (F.col("id") % 37).alias("a"),
                                  (F.col("id") % 11).alias("b")).repartition(8, "k")
    both = d.select("k", "a", "b").unionByName(d.select("k", F.col("b").alias("a"), F.col("a").alias("b")))
    edges = both.groupBy("k", "a", "b").count()
    out_w = edges.groupBy("k", "a").agg(F.sum("count").alias("w"))
    assert edges.join(out_w, ["k", "a"]).count() == edges.count()


def test_keyterm_balanced_equals_plain(spark):
    out = {}
    for bal in (False, True):
        d = read_table(spark, SF01, "documents", balance=bal).where(F.col("doc_id") < 40).select(
            "doc_id", T.remove_stops(T.words("text")).alias("tok"))
        out[bal] = {r[0]: round(r[1], 12) for r in keyterm_scores(d, "doc_id", "tok", iterations=5).collect()}
    assert out[False] == out[True]
    assert all(0.0 <= v <= 1.0 for v in out[True].values())
