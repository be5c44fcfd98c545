"""Parquet tables and the keyed frames the operators work on.

The reference aligns feature blocks by row position; here every frame carries an
explicit key (``doc_id``, ``o_orderkey``, ...) and blocks meet by equi-join.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLE_NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
               "events", "documents", "embeddings", "pages", "benchmark", "labels",
               "conversations")


# tables whose rows carry text: per-row work on them (regex chains, tokenizers) is
# heavy, so a scan with too few partitions is spread before that work starts
TEXT_TABLE_KEYS = {"documents": "doc_id", "conversations": "conv_id", "pages": "page_id",
                   "benchmark": "item_id"}


def balance_partitions(df: DataFrame, key: str, target: int | None = None) -> DataFrame:
    """Hash-spread ``df`` on ``key`` when its scan yields fewer partitions than the
    shuffle parallelism (e.g. one large row group); well-split inputs are untouched.
    The partition count comes from planning, no job runs."""
    from ..session import spread_width
    target = target or spread_width(df.sparkSession)
    if df.rdd.getNumPartitions() < target:
        return df.repartition(target, key)
    return df


def read_table(spark: SparkSession, sf_dir: str, name: str, balance: bool = True) -> DataFrame:
    if name not in TABLE_NAMES:
        raise ValueError(f"unknown table {name!r}")
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    if balance and name in TEXT_TABLE_KEYS:
        df = balance_partitions(df, TEXT_TABLE_KEYS[name])
    return df


def corpus(spark: SparkSession, sf_dir: str, text_col: str = "comment_text") -> DataFrame:
    """Labelled + unlabelled comments: documents left join labels.

    Columns: doc_id, <text_col>, source, lang, toxic, quality, split ('train' when a
    label exists, else 'test').  Mirrors the reference's train/test row-bind with an
    explicit split column instead of positional slicing.
    """
    docs = read_table(spark, sf_dir, "documents").select(
        "doc_id", F.col("text").alias(text_col), "source", "lang")
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "toxic", "quality")
    return (docs.join(labels, "doc_id", "left")
            .withColumn("split", F.when(F.col("toxic").isNotNull(), F.lit("train"))
                        .otherwise(F.lit("test"))))


def month_index(ts: Column, epoch_year: int = 1995) -> Column:
    """Integer month counter (0 = January of ``epoch_year``) - the panel's ``date``."""
    return ((F.year(ts) - F.lit(epoch_year)) * 12 + F.month(ts) - 1).cast("int")


def customer_panel(spark: SparkSession, sf_dir: str, epoch_year: int = 1995) -> DataFrame:
    """Customer/month panel: orders with customer_id, date (month index), target,
    year, month and market (customer segment, a small broadcastable dimension)."""
    orders = read_table(spark, sf_dir, "orders")
    cust = read_table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("customer_id"), F.col("c_mktsegment").alias("market"))
    return (orders.select(
                "o_orderkey",
                F.col("o_custkey").alias("customer_id"),
                month_index(F.col("o_orderdate"), epoch_year).alias("date"),
                F.col("o_totalprice").alias("target"),
                F.year("o_orderdate").alias("year"),
                F.month("o_orderdate").alias("month"))
            .join(cust, "customer_id", "left"))


def text_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question pairs from consecutive conversation turns (turn t and t+1)."""
    conv = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    a = conv.select("conv_id", "turn", F.col("text").alias("question1"))
    b = conv.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("question2"))
    return a.join(b, ["conv_id", "turn"], "inner")
