"""Corpus pipeline: five stages over ``documents``, each written as Parquet and read
again as the next one's input.

A stage is a function of (spark, docs, sf_dir).  Rejected documents, all but one document
of a near-duplicate class and contaminated documents go; line dedup rewrites texts; the
last stage keeps the documents that the mix takes, with ``size``, ``source_size``,
``target``, ``taken`` and ``copies``.  All work on whole tables and are defined for empty ones.
"""
from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, jaccard, linededup, mixing, quality
from tessera.llm.common import col, delete, scratch
from tessera.session import ensure_checkpoint_dir


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.drop_rejected(docs, _table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = linededup.dedup_lines(docs).drop("__lines_removed")
    if "n_chars" in docs.columns:                    # the column counts the text's code points
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*map(col, docs.columns))
    return out


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.drop_similar(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, _table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("jaccard_join", jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mixing", source_mixing),
]

# character models and chosen paths are beyond SQL; tests compare the run with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``, each one's result stored in the shared folder until
    the next one is written."""
    folder = os.path.join(ensure_checkpoint_dir(spark), "corpus-pipeline", uuid.uuid4().hex)
    docs, last = _table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        with scratch(spark):                         # a stage's own tables go with it
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            delete(spark, last)
        last = path
    return docs
