"""Line dedup over overlapping windows of three lines.

Every three consecutive lines of a text (all lines, if there are fewer) are hashed to 128
bits; windows found more than once in the whole table are repeated, and every occurrence
but the first - by document id (nulls last), text hash, place - is covered.  The lines
of merged covered places are removed.  Lines are compared without white space at their
ends; a window of blank lines only never counts.

Windows that are common enough to be at most ``HOT`` in number are matched by broadcast,
the others by a shuffle, so that no frequent window meets in one task.

Defined results: a null or blank text has no windows and stays as it is; rows equal in id
and text are one document and keep the same lines; a text may lose all its lines, it is
then empty; an empty table stays empty.
"""
from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import bounded_batches, col, row_hash, stored

LINES = 3
HOT = 1000


def windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, th, pos, h1, h2: one row per window."""
    lines = F.split(F.coalesce(col(text_col).cast("string"), F.lit("")), "\n", -1)
    d = docs.select(col(id_col).alias("doc_id"), row_hash(col(text_col)).alias("th"),
                    F.transform(lines, lambda x: F.btrim(x, F.lit(" \t\r\x0b\x0c"))).alias("l"))
    n = F.size("l")
    blank = F.lit(0).cast("bigint")

    def hashed(seed: int):
        a = F.transform("l", lambda x: F.when(x == "", blank).otherwise(F.xxhash64(x, F.lit(seed))))
        return a

    d = d.select("doc_id", "th", hashed(1).alias("a"), hashed(2).alias("b"))
    n = F.size("a")

    def joined(c: str):
        three = F.zip_with(F.zip_with(F.slice(c, 1, n - 2), F.slice(c, 2, n - 2), lambda x, y: F.struct(x.alias("x"), y.alias("y"))),
                           F.slice(c, 3, n - 2), lambda p, z: F.when((p["x"] == 0) & (p["y"] == 0) & (z == 0), F.lit(None))
                           .otherwise(F.xxhash64(p["x"], p["y"], z)))
        few = F.array(F.when(F.forall(c, lambda x: x == 0), F.lit(None)).otherwise(F.xxhash64(F.array_join(F.col(c).cast("array<string>"), ","))))
        return F.when(n >= LINES, three).otherwise(few)

    d = d.select("doc_id", "th", F.arrays_zip(joined("a").alias("h1"), joined("b").alias("h2")).alias("w"))
    return (d.select("doc_id", "th", F.posexplode("w").alias("pos", "w"))
            .select("doc_id", "th", "pos", F.col("w.h1").alias("h1"), F.col("w.h2").alias("h2")).where("h1 is not null"))


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, th and the places (``at``) of windows that occurred before."""
    w = stored(windows(docs, id_col, text_col))
    order = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "th", "pos")
    g = stored(w.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(order).alias("first")).where("n > 1"))
    hot_from = max(2, w.count() // HOT)              # at most HOT windows are as frequent
    keys = ["h1", "h2"]
    hot = F.broadcast(g.where(F.col("n") >= hot_from))
    common = w.join(hot, keys)
    others = w.join(F.broadcast(g.where(F.col("n") >= hot_from).select(*keys)), keys, "left_anti").join(g.where(F.col("n") < hot_from), keys)
    later = common.unionByName(others).where(order != F.col("first"))
    return later.groupBy("doc_id", "th").agg(F.array_sort(F.collect_set("pos")).alias("at"))


@F.pandas_udf(StringType())
def _without(text: pd.Series, at: pd.Series) -> pd.Series:
    """The text without the lines of the windows that start at these places."""
    out = []
    for t, places in zip(text, at):
        if t is None or places is None:
            out.append(None)
            continue
        gone = {p + k for p in places for k in range(LINES)}
        out.append("\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone))
    return pd.Series(out, dtype=object)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the repeated lines taken out of the text, its other columns as they
    were, and ``__lines_removed``."""
    bounded_batches(docs.sparkSession)
    at = repeated(docs, id_col, text_col).select(F.col("doc_id").alias("__id"), F.col("th").alias("__th"), F.col("at").alias("__at"))
    text = col(text_col).cast("string")
    d = docs.join(at, col(id_col).eqNullSafe(F.col("__id")) & (row_hash(col(text_col)) == F.col("__th")), "left")
    cut = _without(F.when(F.col("__at").isNotNull(), text), F.col("__at"))
    n = F.size(F.array_distinct(F.flatten(F.transform("__at", lambda p: F.array(p, p + 1, p + 2)))))
    lines = F.size(F.split(text, "\n", -1))
    removed = F.when(F.col("__at").isNull(), 0).otherwise(F.least(n, lines)).cast("long")
    return (d.withColumn("__lines_removed", removed).withColumn("__cut", cut)
            .select(*[F.when(F.col("__at").isNotNull(), F.col("__cut")).otherwise(col(c)).alias(c) if c == text_col else col(c)
                      for c in docs.columns], "__lines_removed"))
