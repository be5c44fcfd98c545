"""Keras-style vocabularies and id sequences, word-vector tables and pooling
(E1-E5, E7, E8, J5, V8).

The vocabulary is the only globally ordered object and it is ranked with the
distributed index (no single-partition window).  Token rows meet it by equi-join; Spark
broadcasts the vocabulary when its measured size allows it.
"""
from __future__ import annotations

from typing import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import explode_rows
from ..functions.clean import _col
from ..session import reliable_checkpoint
from .ranking import global_index
from .tokencodes import coded_tokens, counted, decoded


def char_tokens(c, lower: bool = True) -> Column:
    """Character-level tokens (code points), lower-cased like a char-level tokenizer."""
    x = F.lower(_col(c)) if lower else _col(c)
    return F.when(x == "", F.array().cast("array<string>")).otherwise(F.split(x, ""))


def fit_vocabulary(df: DataFrame, key: str, tokens: str) -> DataFrame:   # E1
    """(word, count, index): index from 1 by descending corpus count, ties by first
    occurrence in (key, position) order."""
    # a row for each distinct word of a text
    words = explode_rows(df, [key], counted(F.col(tokens)), "__c").select(key, "__c.*")
    counts = words.groupBy("word").agg(F.sum("n").cast("bigint").alias("count"),
                                       F.min(F.struct(F.col(key).alias("k"), F.col("first").alias("p"))).alias("__first"))
    ranked = global_index(counts, [F.col("count").desc(), F.col("__first").asc()], name="index", start=1)
    return ranked.select("word", "count", "index")


def texts_to_sequences(df: DataFrame, key: str, tokens: str, vocab: DataFrame,
                       num_words: int | None = None, out_col: str = "seq") -> DataFrame:   # E2
    """Token arrays -> index arrays; unseen words and indices >= num_words dropped."""
    v = vocab.select("word", "index")
    if num_words is not None:
        v = v.where(F.col("index") < num_words)
    # stored, the vocabulary has a size Spark can plan by; only a text's distinct words meet it.  The numbers of the
    # words travel beside them, packed, and become indices in the row of the text
    words = df.select(F.col(key).alias("__k"), F.monotonically_increasing_id().alias("rid"), coded_tokens(F.col(tokens)).alias("__c"))
    words = explode_rows(words, ["__k", "rid"], F.col("__c"), "c").select("__k", "rid", "c.*")
    v = reliable_checkpoint(v).select(F.col("word").alias("__word"), "index")
    # the packed numbers meet nothing: as nulls they would all be one task's
    beside = F.when(F.col("j") < 0, F.concat(F.lit("\x00"), F.col("rid").cast("string"))).otherwise(F.col("word"))
    met = words.withColumn("__w", beside).join(v, (F.col("__w") == F.col("__word")) & (F.col("j") >= 0), "left")
    met = met.where((F.col("j") < 0) | F.col("__word").isNotNull()).groupBy("__k").agg(
        F.collect_list(F.struct("rid", "j", F.col("index").cast("bigint").alias("index"), "codes")).alias("__s"))
    out = df.join(met, F.col(key) == F.col("__k"), "left").drop("__k")
    return out.withColumn(out_col, decoded("__s")).drop("__s")


def pad_sequences(seq, maxlen: int, value: int = 0, padding: str = "pre",
                  truncating: str = "pre") -> Column:   # E3
    """Fixed length ``maxlen``: keep the last (truncating='pre') or first items,
    pad with ``value`` in front (padding='pre') or behind."""
    s = _col(seq)
    n = F.size(s)
    cut = F.slice(s, -maxlen, maxlen) if truncating == "pre" else F.slice(s, 1, maxlen)
    fill = F.array_repeat(F.lit(value).cast("bigint"), F.greatest(F.lit(maxlen) - n, F.lit(0)))
    padded = F.concat(fill, s) if padding == "pre" else F.concat(s, fill)
    return F.when(n >= maxlen, cut).otherwise(padded)


def spread_columns(df: DataFrame, seq: str, maxlen: int, prefix: str = "word",
                   keep: Sequence[str] = ()) -> DataFrame:   # E5
    return df.select(*keep, *[F.col(seq)[i].alias(f"{prefix}{i}") for i in range(maxlen)])


def embedding_table(vocab: DataFrame, vectors: DataFrame, dim: int, nb_words: int | None = None,
                    random_init: tuple[float, float] | None = None, seed: int = 1337,
                    method: str = "xxhash64") -> DataFrame:   # J5 / E7
    """(index, vec) for vocabulary indices below ``nb_words``: the word's vector, or
    zeros (or seeded N(mean, std) draws) when the word has none."""
    v = vocab.select("word", "index")
    if nb_words is not None:
        v = v.where(F.col("index") < nb_words)
    j = v.join(vectors.select("word", "vec"), "word", "left")
    if random_init is None:
        miss = F.array_repeat(F.lit(0.0).cast("float"), dim)
    else:
        from .encoders import keyed_normal
        mu, sd = random_init
        miss = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)),
                           lambda i: (F.lit(mu) + F.lit(sd) * keyed_normal(seed, F.col("word"), i, method=method)).cast("float"))
    return j.select("index", "word", F.coalesce(F.col("vec"), miss).alias("vec"),
                    F.col("vec").isNull().alias("missing"))


def _weighted_vectors(df: DataFrame, key: str, tokens: Column, vectors: DataFrame) -> DataFrame:
    """(key, n, v): one row per document and distinct word with a vector; the vector stays
    one value, so a row is not multiplied by the dimension."""
    counted = explode_rows(df, [key], tokens, "word").groupBy(key, "word").agg(F.count(F.lit(1)).cast("double").alias("n"))
    v = vectors.select("word", array_to_vector(F.transform("vec", lambda x: x.cast("double"))).alias("v"))
    return counted.join(v, "word")


def pool_vectors(df: DataFrame, key: str, tokens: Column, vectors: DataFrame) -> DataFrame:   # E8
    """Mean and max of the document's word vectors, per dimension (words without a
    vector skipped), by a weighted vector summary per document."""
    s = Summarizer.metrics("mean", "max").summary(F.col("v"), F.col("n"))
    pooled = _weighted_vectors(df, key, tokens, vectors).groupBy(key).agg(s.alias("s"))
    return pooled.select(key, vector_to_array("s.mean").alias("mean_pool"), vector_to_array("s.max").alias("max_pool"))


def sentence_vectors(df: DataFrame, key: str, tokens: Column, vectors: DataFrame) -> DataFrame:   # V8
    """Sum of word vectors (duplicates counted, missing words skipped) divided by its
    L2 norm (a zero sum stays zero); documents without any vector get no row."""
    g = (_weighted_vectors(df, key, tokens, vectors).groupBy(key)
         .agg(Summarizer.sum(F.col("v"), F.col("n")).alias("s")).select(key, vector_to_array("s").alias("v")))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x * x))
    return g.select(key, F.transform("v", lambda x: F.coalesce(F.try_divide(x, norm), x)).alias("vec"))
