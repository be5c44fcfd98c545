"""Word-vector sources (S6): the ``word v1 ... vd`` text format, and a deterministic
vector derived from the word itself for tests and oracle twins."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_word_vectors(spark: SparkSession, path: str, dim: int | None = None) -> DataFrame:
    """(word, vec ARRAY<FLOAT>) from text lines ``word v1 ... vd`` (space separated).
    Lines whose vector length differs from ``dim`` (when given) are dropped."""
    lines = spark.read.text(path)
    parts = F.split(F.trim(F.col("value")), " ")
    out = lines.select(parts[0].alias("word"),
                       F.transform(F.slice(parts, 2, F.size(parts) - 1), lambda x: x.cast("float")).alias("vec"))
    out = out.where(F.col("word").isNotNull() & (F.length("word") > 0))
    if dim is not None:
        out = out.where(F.size("vec") == dim)
    return out


def write_word_vectors(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.select(F.concat_ws(" ", F.col("word"), F.array_join(F.transform("vec", lambda x: x.cast("string")), " "))
              .alias("value")).write.mode(mode).text(path)


DERIVED_DIM = 4


def derived_vector(word) -> Column:
    """A 4-d vector computed from the word: length/10, position of 'e'/10, count of
    'a'/5, +1/-1 for a trailing 's'."""
    w = F.col(word) if isinstance(word, str) else word
    return F.array(F.length(w) / 10.0, F.instr(w, "e") / 10.0,
                   (F.length(w) - F.length(F.replace(w, F.lit("a"), F.lit("")))) / 5.0,
                   F.when(w.endswith("s"), F.lit(1.0)).otherwise(F.lit(-1.0)))


DERIVED_VECTOR_SQL = ("[length({w}) / 10.0, instr({w}, 'e') / 10.0, "
                      "(length({w}) - length(replace({w}, 'a', ''))) / 5.0, "
                      "CASE WHEN suffix({w}, 's') THEN 1.0 ELSE -1.0 END]::DOUBLE[]")


def derived_vectors(words: DataFrame, word_col: str = "word") -> DataFrame:
    return words.select(F.col(word_col).alias("word")).distinct().select(
        "word", derived_vector("word").alias("vec"))
