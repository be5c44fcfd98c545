"""Helpers shared by the operators of this package.

Operators name their id and text columns, read only those, and work on internal names,
so further columns of the input (whatever they are called) are never touched.
"""
from __future__ import annotations

import contextlib
import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

# a word is a run of characters that are not ASCII white space
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

# rows per Arrow batch: bounds what a Python worker holds when texts are long
BATCH_ROWS = 1000
BATCH_BYTES = 16 << 20


def col(name: str) -> Column:
    """The column of that very name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def bounded_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def id_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``text`` only, under these names; the text as a string."""
    return df.select(col(id_col).alias("doc_id"), col(text_col).cast("string").alias("text"))


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder of the shared store, whatever file system that is."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


_OPEN: list[list[str]] = []


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Tables that ``stored`` writes inside the block are removed at its end: for callers that have
    written what they want of them."""
    _OPEN.append([])
    try:
        yield
    finally:
        for path in _OPEN.pop():
            delete(spark, path)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: later steps neither recompute
    it nor depend on the executors that made it.  Its files also give the planner a
    true size, so small tables are broadcast by Spark's own size check.  They stay until the
    ``scratch`` block around them ends; without one they are the caller's to remove."""
    spark = df.sparkSession
    path = os.path.join(ensure_checkpoint_dir(spark), "tessera-llm", uuid.uuid4().hex)
    df.write.parquet(path)
    if _OPEN:
        _OPEN[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def words(text: Column) -> Column:
    """Array of the words of a text; none for a null or blank text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


BROADCAST_ROWS = 500_000


def checked_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A stored table of short rows, marked for broadcast if it was counted to have at
    most ``rows`` of them; beyond that the planner shuffles as it sees fit."""
    return F.broadcast(df) if df.count() <= rows else df


def row_hash(text: Column) -> Column:
    """Hash that tells rows with one id apart; rows equal in both are one document."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))
