"""File sources and sinks (S1-S9): CSV comments, lexicons, Latin-1 tab lists,
cleaned-variant catalog, prediction files, feature blocks, submissions, run tables.

Writers target shared storage (paths given by the caller; helpers derive scratch
folders from the session's ``spark.checkpoint.dir``), never a machine-local folder.
"""
from __future__ import annotations

import functools
import os
import uuid
from typing import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir

COMMENT_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("comment_text", T.StringType()),
    *[T.StructField(l, T.IntegerType()) for l in
      ("toxic", "severe_toxic", "obscene", "threat", "insult", "identity_hate")]])

CSV_OPTS = dict(header=True, multiLine=True, escape='"', quote='"')
CSV_WRITE_OPTS = dict(header=True, escape='"', quote='"', ignoreLeadingWhiteSpace=False,
                      ignoreTrailingWhiteSpace=False)


def scratch_dir(spark: SparkSession, name: str) -> str:
    return os.path.join(ensure_checkpoint_dir(spark), "tessera-io", f"{name}-{uuid.uuid4().hex}")


def read_comments(spark: SparkSession, path: str, schema: T.StructType = COMMENT_SCHEMA) -> DataFrame:   # S1
    return spark.read.schema(schema).options(**CSV_OPTS).csv(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).options(**CSV_WRITE_OPTS).csv(path)


def read_lexicon(spark: SparkSession, path: str, two_columns: bool = True) -> DataFrame:   # S2
    """Headerless 1- or 2-column word list (original[, proper])."""
    cols = "original string, proper string" if two_columns else "word string"
    return spark.read.schema(cols).options(header=False).csv(path)


def read_latin1_list(spark: SparkSession, path: str) -> DataFrame:   # S3
    """Tab-separated Latin-1 list; malformed lines (wrong field count) dropped.  The lines
    are read as bytes and filtered by an expression, so counts see the filter too."""
    line = F.decode(F.col("value").cast("binary"), "ISO-8859-1")
    return (spark.read.text(path).select(line.alias("word"))
            .where((F.col("word") != "") & ~F.col("word").contains("\t")))


VARIANTS = ("BasicClean", "BasicClean2", "SpacyClean", "TextacyClean", "TextacyFullclean")


def write_variant(df: DataFrame, root: str, variant: str, split_col: str = "split") -> None:
    if variant not in VARIANTS:
        raise ValueError(f"variant must be one of {VARIANTS}")
    df.write.mode("overwrite").partitionBy(split_col).parquet(f"{root}/{variant}")


def load_variant(spark: SparkSession, root: str, variant: str) -> tuple[DataFrame, DataFrame]:   # S4
    """(train, test) of a cleaned variant; the split filter prunes partitions."""
    if variant not in VARIANTS:
        raise ValueError(f"variant must be one of {VARIANTS}")
    df = spark.read.parquet(f"{root}/{variant}")
    return df.where(F.col("split") == "train"), df.where(F.col("split") == "test")


def write_predictions(df: DataFrame, root: str, kind: str, name: str) -> None:
    df.write.mode("overwrite").parquet(f"{root}/{kind}/{name}.parquet")


def load_predictions(spark: SparkSession, root: str, load_oof: bool = True, contains: str | None = None,
                     contains2: str | None = None, not_contains: str | None = None) -> tuple[DataFrame, DataFrame]:   # S5
    """All prediction files of train-or-valid and test in one read each, kept by
    substring include/exclude on the file path; ``model`` = file stem.  ``contains2``
    applies only together with ``contains``."""
    def load(kind):
        df = spark.read.parquet(f"{root}/{kind}/*.parquet").withColumn("__path", F.col("_metadata.file_path"))
        path = F.col("__path")
        wanted = [w for w in (contains, contains2 if contains is not None else None) if w is not None]
        tests = [path.contains(w) for w in wanted] + ([~path.contains(not_contains)] if not_contains is not None else [])
        df = df.where(functools.reduce(lambda a, b: a & b, tests, F.lit(True)))
        stem = F.regexp_extract("__path", r"/([^/]+)\.parquet/", 1)
        return df.withColumn("model", stem).drop("__path")
    return load("train" if load_oof else "valid"), load("test")


def write_feature_block(df: DataFrame, path: str, key: str) -> None:   # S7
    df.repartition(key).write.mode("overwrite").parquet(path)


def submission(preds: DataFrame, key: str, labels: Sequence[str], label_col: str = "label",
               pred_col: str = "pred") -> DataFrame:   # S8
    """One row per id, one column per label (pivot with a given value list)."""
    return preds.groupBy(key).pivot(label_col, list(labels)).agg(F.avg(pred_col))


def append_parameters(spark: SparkSession, path: str, run: str, params: Mapping[str, object]) -> None:   # S9
    rows = [(run, str(k), str(v)) for k, v in params.items()]
    spark.createDataFrame(rows, "run string, key string, value string").write.mode("append").parquet(path)


# --- blocks that meet by position -----------------------------------------------------
def write_ordered(df: DataFrame, path: str, order: Sequence[str], drop: Sequence[str] = (), rows_per_file: int = 0) -> None:
    """Parquet files whose names follow the given order; the order's columns may be left out,
    the place of a row is then all that is known of it."""
    df.orderBy(*order).drop(*drop).write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).parquet(path)


def read_positions(spark: SparkSession, path: str, name: str = "position") -> DataFrame:   # S7 / J4
    """The rows of a Parquet folder with their position: files by name, rows of a file as
    stored.  Files are counted once, the offsets are a running sum over files; the position does
    not depend on how the scan is split."""
    from ..operators.ranking import global_prefix
    rows = spark.read.parquet(path).select("*", F.col("_metadata.file_name").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    files = rows.groupBy("__file").agg(F.count(F.lit(1)).alias("n"))
    starts = global_prefix(files, [F.col("__file").asc()], {"__start": F.col("n")}).select("__file", "__start")
    return rows.join(starts, "__file").withColumn(name, (F.col("__start") + F.col("__row")).cast("long")).drop("__file", "__row", "__start")


def glue(blocks: Sequence[DataFrame], position: str = "position") -> DataFrame:   # J4
    """Blocks without a key side by side: joined on the position, missing places null."""
    return functools.reduce(lambda a, b: a.join(b, position, "full"), blocks)


# --- names as data ----------------------------------------------------------------------
def write_note(spark: SparkSession, path: str, text: str) -> None:
    """A small text file of that very name, on whatever file system the path names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p)
    out.writeBytes(text)
    out.close()


def list_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, length, modificationTime) of the files under ``root``; their content is not read.
    Spark's scans leave files of no bytes out, and so does this."""
    return (spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true")
            .load(root).select("path", "length", "modificationTime"))


def checkpoint_losses(files: DataFrame) -> DataFrame:   # M14
    """(run, fold, loss, path) from names such as ``<run>/..._fold_<i>_..._<loss>.txt``: the run is
    the folder, the loss the last ``_`` part up to its second point."""
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    loss = F.substring_index(F.substring_index(name, "_", -1), ".", 2).try_cast("double")
    return (files.select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("run"), F.regexp_extract(name, r"fold_([0-9]+)", 1).alias("fold"),
                         loss.alias("loss"), "path")
            .where("fold <> ''").withColumn("fold", F.col("fold").cast("int")))


def least_losses(losses: DataFrame) -> DataFrame:   # M14
    """(run, fold, n, loss): the least loss of every fold; files whose name holds none do not count."""
    return (losses.where(F.col("loss").isNotNull()).groupBy("run", "fold")
            .agg(F.count(F.lit(1)).cast("bigint").alias("n"), F.min("loss").alias("loss")))
