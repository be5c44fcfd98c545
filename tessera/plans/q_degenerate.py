"""Queries on divisors of zero: predictions of 0, weights that cancel, constant columns,
ids that are all 0 and word vectors that sum to nothing, all put in by rule."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tokens as T
from ..operators import encoders as A, ensemble as EN, sequences as S
from ..sources.tables import read_table
from .catalog import register
from .q_models import _oof, _oof_sql
from .q_vectors import BENCH_VEC_SQL, KERAS_SQL, _benchmark_vectors


def r6(c):
    return F.round(c, 6)


@register("m12_m13_zero_blends", f"""WITH {_oof_sql()},
z AS (SELECT doc_id, split, label, model, CASE WHEN doc_id % 7 = model THEN 0.0 ELSE pred END AS pred FROM oof WHERE NOT (doc_id % 5 = 0 AND model = 1)),
fm AS (SELECT doc_id, split, label, model, avg(pred) AS pred FROM z GROUP BY ALL)
SELECT doc_id, split, label, CASE WHEN min(pred) > 0 THEN round(exp(avg(CASE WHEN pred > 0 THEN ln(pred) END)), 6) END AS geo,
  CASE WHEN min(pred) > 0 THEN round(count(pred) / sum(CASE WHEN pred > 0 THEN 1.0 / pred END), 6) END AS harm,
  CASE WHEN sum(CASE model WHEN 0 THEN 2 WHEN 1 THEN -2 END) <> 0
       THEN round(sum(CASE model WHEN 0 THEN 2.0 WHEN 1 THEN -2.0 END * pred) / sum(CASE model WHEN 0 THEN 2.0 WHEN 1 THEN -2.0 END), 6) END AS blend
FROM fm GROUP BY doc_id, split, label""")
def m12_m13_zero_blends(spark, sf_dir):
    """Blends where predictions are 0 (mean undefined: null) and weights of 2 and -2 cancel."""
    oof = _oof(spark, sf_dir).where(~((F.col("doc_id") % 5 == 0) & (F.col("model") == 1)))
    oof = oof.withColumn("pred", F.when(F.col("doc_id") % 7 == F.col("model"), 0.0).otherwise(F.col("pred")))
    fm = EN.fold_mean(oof, ["doc_id", "split", "label", "model"])
    b = EN.blends(fm, ["doc_id", "split", "label"], {0: 2.0, 1: -2.0})
    return b.select("doc_id", "split", "label", r6("geo").alias("geo"), r6("harm").alias("harm"), r6("blend").alias("blend"))


@register("a11_polar_constant", """SELECT p_partkey, CASE WHEN p_partkey % 3 <> 0 THEN 0.0::DOUBLE END AS k_sin,
  CASE WHEN p_partkey % 3 <> 0 THEN 0.0::DOUBLE END AS k_cos FROM part""")
def a11_polar_constant(spark, sf_dir):
    """A column of one value and nulls: the scaled angles are 0, null for null."""
    p = read_table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 3 != 0, 5).alias("k"))
    return A.polar_coords(p, "k").select("p_partkey", "k_sin", "k_cos")


@register("a15_zero_ids", """SELECT o_orderkey, NULL::DOUBLE AS customer_max_ratio,
  round(customer_id / (row_number() OVER (ORDER BY o_orderkey) - 1 + 1e-14), 6) AS index_max_ratio,
  CAST(count(*) OVER (PARTITION BY customer_id) AS BIGINT) AS customer_count
FROM (SELECT o_orderkey, -(o_custkey % 4) AS customer_id FROM orders)""")
def a15_zero_ids(spark, sf_dir):
    """Ids of which 0 is the largest: their ratio to it is null."""
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", (-(F.col("o_custkey") % 4)).alias("customer_id"))
    out = A.customer_features(o, "customer_id", order_col="o_orderkey", keep=["o_orderkey"])
    return out.select("o_orderkey", r6("customer_max_ratio").alias("customer_max_ratio"), r6("index_max_ratio").alias("index_max_ratio"), "customer_count")


@register("v8_zero_sums", f"""WITH {BENCH_VEC_SQL},
tok AS (SELECT doc_id, unnest({KERAS_SQL}[1:3]) AS word FROM documents),
ex AS (SELECT tok.doc_id, unnest(range(len(bv.vec))) AS dim, unnest(CASE WHEN length(word) % 2 = 0 THEN list_transform(bv.vec, lambda x: 0.0) ELSE bv.vec END) AS x
       FROM tok JOIN bv USING (word)),
s AS (SELECT doc_id, dim, sum(x) AS s FROM ex GROUP BY doc_id, dim),
n AS (SELECT *, sqrt(sum(s * s) OVER (PARTITION BY doc_id)) AS norm FROM s)
SELECT doc_id, CAST(dim AS INTEGER) AS dim, CASE WHEN norm = 0 THEN 0.0 ELSE round(s / norm, 6) END AS value FROM n""")
def v8_zero_sums(spark, sf_dir):
    """Sentence vectors of the first three words where words of even length have the zero vector."""
    d = read_table(spark, sf_dir, "documents")
    v = _benchmark_vectors(spark, sf_dir)
    v = v.select("word", F.when(F.length("word") % 2 == 0, F.transform("vec", lambda x: F.lit(0.0))).otherwise(F.col("vec")).alias("vec"))
    sv = S.sentence_vectors(d, "doc_id", F.slice(T.keras_words("text"), 1, 3), v)
    return sv.select("doc_id", F.posexplode("vec").alias("dim", "value")).select("doc_id", "dim", r6("value").alias("value"))
