"""Minimum end-to-end slice.

documents LEFT JOIN labels -> null-text sentinel -> lower -> non-word runs to space
-> per-document statistics -> smoothed target encoding of ``source`` for every label
at once (long frame, one aggregate) -> exact in-sample ROC-AUC of that encoding per
label, with the mean word count of the scored documents.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clean, textstats
from ..operators.encoders import apply_target_encoding, fit_target_encoding
from ..operators.metrics import roc_auc
from ..sources.tables import corpus

LABELS = ("toxic", "quality")


def cleaned_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus(spark, sf_dir)
    text = clean.remove_nonalpha(clean.lowercase(clean.fill_null_text("comment_text")))
    return c.select("doc_id", "source", *LABELS, "split", text.alias("comment_text"))


def label_long(df: DataFrame, labels=LABELS) -> DataFrame:
    """One row per (document, label) with the label value in ``y``."""
    stack = F.explode(F.array(*[F.struct(F.lit(l).alias("label"), F.col(l).cast("int").alias("y"))
                                for l in labels]))
    return df.select("*", stack.alias("__l")).select(
        *[c for c in df.columns if c not in labels], "__l.label", "__l.y")


def target_encoding_auc(spark: SparkSession, sf_dir: str, min_samples_leaf: int = 100,
                        smoothing: float = 10.0) -> DataFrame:
    docs = cleaned_corpus(spark, sf_dir)
    # only this branch touches the text; the encoding and AUC branches carry keys,
    # sources and labels, so the regex work runs once
    words = docs.select("doc_id", textstats.doc_features("comment_text")[1])
    long = label_long(docs.select("doc_id", "source", *LABELS))
    table = fit_target_encoding(long, "source", "y", min_samples_leaf, smoothing, by=["label"])
    scored = apply_target_encoding(long, table, "source", "score", by=["label"])
    labelled = scored.where(F.col("y").isNotNull())
    auc = roc_auc(labelled, "y", "score", by=["label"])
    avg_words = (labelled.select("doc_id", "label").join(words, "doc_id")
                 .groupBy("label").agg(F.avg("num_words_0").alias("avg_num_words")))
    return auc.join(avg_words, "label").select(
        "label", F.col("n_pos").cast("bigint").alias("n_pos"),
        F.col("n_neg").cast("bigint").alias("n_neg"),
        F.round("auc", 6).alias("auc"), F.round("avg_num_words", 6).alias("avg_num_words"))
