"""Corpus-level jobs: duplicates, word weights, lexicon matches, document
frequencies, bag of words, TF-IDF and term statistics (F5-F11, F13, F14, T7, V1, V2).

Shapes are long tables - (doc_id, term, value) - rather than dense matrices: they
partition by key, grow with the data and meet other blocks by join.  Hot terms are
pre-aggregated map-side before any shuffle; joins of token rows against term tables
let AQE broadcast a small table or split a skewed term partition.
"""
from __future__ import annotations

from functools import reduce
from typing import Iterable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import explode_rows
from ..functions.clean import _col
from ..functions.tokens import chargrams
from ..session import reliable_checkpoint
from .blocks import coded, spelled
from .exchange import share, weighed
from .ranking import global_index
from .substrings import Lexicon, found_in


def text_key(c) -> Column:
    """128-bit content key: groups equal texts without shuffling the texts."""
    return F.unhex(F.md5(_col(c)))


# --- F5 / F6 --------------------------------------------------------------------
def duplicate_features(df: DataFrame, text: str, order_col: str) -> DataFrame:
    """``duplicated`` (1 for the 2nd and later occurrence in ``order_col`` order) and
    ``comment_freq`` (rows with the same text).  One partial aggregate per text key,
    joined back - a text repeated across a third of the rows is pre-aggregated."""
    keyed = df.withColumn("__tk", text_key(text))
    stats = keyed.groupBy("__tk").agg(F.count(F.lit(1)).alias("comment_freq"),
                                      F.min(order_col).alias("__first"))
    return (keyed.join(stats, "__tk", "left")
            .withColumn("duplicated", (F.col(order_col) != F.col("__first")).cast("int"))
            .withColumn("comment_freq", F.col("comment_freq").cast("bigint"))
            .drop("__tk", "__first"))


# --- F7 -------------------------------------------------------------------------
def word_weights(df: DataFrame, tokens: Column, eps: float = 10000.0,
                 min_count: int = 2) -> DataFrame:
    """(word, count, weight): weight = 0 below ``min_count`` else 1 / (count + eps)."""
    counts = explode_rows(df, [], tokens, "word").groupBy("word").agg(
        F.count(F.lit(1)).cast("bigint").alias("count"))
    w = F.when(F.col("count") < min_count, F.lit(0.0)).otherwise(1.0 / (F.col("count") + F.lit(eps)))
    return counts.withColumn("weight", w)


# --- T5 -------------------------------------------------------------------------
GRAM_CHARS = 500_000        # about so many runs in a batch
PACKED = 3                  # code points of 21 bits in a 64-bit number


def _gram_numbers(texts: list[str], n: int) -> np.ndarray:
    """The overlapping runs of ``n`` code points of every text, each as one number."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4").astype(np.int64)
    ends = np.cumsum([len(t) for t in texts])
    inside = np.ones(len(codes), bool)
    for d in range(1, n):               # runs that would go beyond their text
        inside[ends[ends >= d] - d] = False
    at = np.flatnonzero(inside)
    return sum((codes[at + i] << 21 * (n - 1 - i) for i in range(n)), np.zeros(len(at), np.int64))


def _texts_to_grams(texts: list[str], n: int):
    """Batches of gram numbers."""
    part, size = [], 0
    for i, t in enumerate(texts):
        part.append(t)
        size += len(t)
        if size >= GRAM_CHARS or i + 1 == len(texts):
            yield pa.RecordBatch.from_arrays([pa.array(_gram_numbers(part, n), pa.int64())], names=["g"])
            part, size = [], 0


def chargram_counts(df: DataFrame, text: str, n: int = 3) -> DataFrame:
    """(gram, cnt) of all runs of ``n`` code points.  A run travels as one number from its text to
    Spark's counts; only the counted runs become texts again."""
    if n > PACKED:
        return explode_rows(df, [], chargrams(text, n), "gram").groupBy("gram").agg(F.count(F.lit(1)).cast("bigint").alias("cnt"))

    def grams(batches):
        for b in batches:
            yield from _texts_to_grams([t for t in b.column(0).to_pylist() if t], n)

    def spelled(batches):
        for b in batches:
            g = b.column(0).to_numpy()
            codes = np.column_stack([(g >> 21 * (n - 1 - i)) & 0x1FFFFF for i in range(n)]).astype("<u4")
            chars = codes.tobytes().decode("utf-32-le")
            yield pa.RecordBatch.from_arrays([pa.array([chars[i:i + n] for i in range(0, len(chars), n)], pa.string()), b.column(1)], names=["gram", "cnt"])
    counted = df.select(_col(text).alias("t")).mapInArrow(grams, "g long").groupBy("g").agg(F.count(F.lit(1)).alias("cnt"))
    return counted.mapInArrow(spelled, "gram string, cnt long")


# --- F9 / F10 / F11 ---------------------------------------------------------------
def lexicon_array(terms: Iterable[str]) -> Column:
    return F.array(*[F.lit(t) for t in terms])


def lexicon_hits(text: Column, terms: Sequence[str]) -> Column:
    """Array of the lexicon terms contained in ``text`` (literal substring), in
    lexicon order.  The lexicon is a caller-given literal, so its size is known when
    the plan is built; every row is tested in generated code, no join.  Written
    without a lambda so the text expression is computed once per row."""
    return F.array_compact(F.array(*[F.when(F.contains(text, F.lit(t)), F.lit(t)) for t in terms]))


def lexicon_matrix(df: DataFrame, key: str, text: Column, terms: Sequence[str]) -> DataFrame:
    """Long form of the binary doc x term matrix: one row per (key, term) hit."""
    return explode_rows(df, [key], lexicon_hits(text, terms), "term")


def lexicon_union(tables: Sequence[DataFrame], term_col: str = "term") -> DataFrame:   # F8
    """One lexicon from word tables (their first column): union, distinct, non-word runs to a
    space, lower case - in that order, so a cleaned duplicate stays, as in the reference."""
    from ..functions.clean import remove_nonalpha
    words = None
    for t in tables:
        w = t.select(F.col(t.columns[0]).alias(term_col))
        words = w if words is None else words.union(w)
    return words.where(F.col(term_col).isNotNull()).distinct().select(F.lower(remove_nonalpha(term_col)).alias(term_col))


def lexicon_token_matrix(df: DataFrame, key: str, tokens: Column, lexicon: DataFrame,
                         term_col: str = "term") -> DataFrame:
    """Token-mode variant for a lexicon *table* of any size: distinct tokens per
    document equi-joined to the lexicon (AQE chooses broadcast or shuffle)."""
    toks = explode_rows(df, [key], F.array_distinct(tokens), term_col)
    return toks.join(lexicon.select(term_col).distinct(), term_col, "left_semi")


LEXICON_BYTES = 8 << 20     # of terms that a scan of the texts looks for


def lexicon_substring_matrix(df: DataFrame, key: str, text: Column, lexicon: DataFrame, term_col: str = "term") -> DataFrame:   # F3 / F9
    """(key, term): the terms of a lexicon *table* of any size that a text contains anywhere,
    as ``contains`` finds them.

    The terms go to the texts in shards of at most about ``LEXICON_BYTES``, one scan of the texts for
    each shard; no text and no candidate is shuffled.  An empty term is in every text and is left out;
    so are rows without a key."""
    spark = df.sparkSession
    terms = reliable_checkpoint(lexicon.select(F.col(term_col).cast("string").alias("term")).where(F.length("term") > 0).distinct())
    shards = max(1, -(-(terms.agg(F.sum(F.octet_length("term"))).first()[0] or 0) // LEXICON_BYTES))
    docs = df.select(F.col(key), text.cast("string").alias("__text"))
    names, kind = [key, term_col], docs.schema[key].dataType.simpleString()

    def scan(shard: int) -> DataFrame:
        held = terms if shards == 1 else terms.where(F.pmod(F.xxhash64("term"), F.lit(shards)) == shard)
        known = spark.sparkContext.broadcast(Lexicon(held.toArrow().column(0).combine_chunks()))
        return docs.mapInArrow(lambda batches: found_in(batches, known.value, names), f"`{key}` {kind}, `{term_col}` string")
    return reduce(DataFrame.union, [scan(k) for k in range(shards)])


def top_terms(matrix: DataFrame, skip: int = 3, k: int = 300, term_col: str = "term") -> DataFrame:
    """Terms by number of hits, descending (ties by term); skip the first ``skip``,
    keep ``k`` - a top-k report over the small per-term table."""
    counts = matrix.groupBy(term_col).agg(F.count(F.lit(1)).cast("bigint").alias("n"))
    return counts.orderBy(F.col("n").desc(), F.col(term_col).asc()).offset(skip).limit(k)


# --- T7 -------------------------------------------------------------------------
def document_frequencies(df: DataFrame, key: str, tokens: Column, term_col: str = "term", words: DataFrame | None = None) -> DataFrame:
    """(term, df): number of documents containing the term; ``words``: as ``coded`` blocks counted them."""
    if words is not None:
        return words.groupBy(F.col("__word").alias(term_col)).agg(F.sum("__docs").cast("bigint").alias("df"))
    return (explode_rows(df, [key], F.array_distinct(tokens), term_col)
            .groupBy(term_col).agg(F.count(F.lit(1)).cast("bigint").alias("df")))


def filter_extremes(df: DataFrame, key: str, tokens: str, no_below: int = 3,
                    no_above: float = 0.75, keep_n: int | None = None,
                    invert: bool = False, out_col: str | None = None) -> DataFrame:
    """Keep tokens whose document frequency is in [no_below, floor(no_above * N)]
    (with ``keep_n``, only the so many most frequent, ties by term), preserving token order.
    ``invert=True`` keeps the other tokens instead (the reference's behaviour, Q7)."""
    out_col = out_col or tokens
    n_docs = df.select(F.count(F.lit(1))).scalar()
    rows, words = coded(df, key, tokens, [c for c in df.columns if c != out_col])
    dfs = document_frequencies(df, key, F.col(tokens), words=words)
    kept = dfs.where((F.col("df") >= no_below) & (F.col("df") <= F.floor(n_docs * F.lit(float(no_above)))))
    if keep_n is not None:
        kept = global_index(kept, [F.col("df").desc(), F.col("term").asc()], name="__r") \
            .where(F.col("__r") < keep_n)
    how = "left_anti" if invert else "left_semi"
    held = words.withColumn("__to", F.col("__word")).join(kept.select(F.col("term").alias("__word")), "__word", how)
    return spelled(df, rows, held, key, out_col)


# --- V1 / V2 --------------------------------------------------------------------
def term_counts(df: DataFrame, key: str, terms: Column, keep: Sequence[str] = ()) -> DataFrame:
    """(key, term, tf): bag of words as a long table, with the columns ``keep`` that follow from the key."""
    return (explode_rows(df, [*keep, key], terms, "term")
            .groupBy(*keep, key, "term").agg(F.count(F.lit(1)).cast("bigint").alias("tf")))


def tfidf(df: DataFrame, key: str, terms: Column, min_df: float = 1, max_df: float = 1.0,
          sublinear_tf: bool = False, smooth_idf: bool = True, norm: str | None = "l2",
          use_idf: bool = True) -> DataFrame:
    """(key, term, tf, df, weight) with vectorizer semantics:

    idf = ln((1 + N) / (1 + df)) + 1 (smooth) or ln(N / df) + 1; tf -> 1 + ln(tf) when
    sublinear; rows L2-normalised.  ``min_df``/``max_df``: an int is a document count,
    a float in (0, 1] a fraction of N.
    """
    n_docs = df.count()
    # texts keep their place: their terms are counted there, and meet the frequencies by block in packed pieces
    return weighed(df.select(key, terms.alias("__g")), key, "__g", share(min_df, n_docs, True), share(max_df, n_docs, False), n_docs,
                   sublinear_tf, smooth_idf, norm, use_idf)


# --- F13 / F14 ------------------------------------------------------------------
def term_statistics(df: DataFrame, key: str, terms: Column, min_df: float = 2,
                    max_df: float = 0.95) -> DataFrame:
    """(term, doc_freq, term_freq, info_content) over the corpus vocabulary.

    doc_freq = df / N, term_freq = total count / total tokens of kept terms,
    info_content = binary entropy of doc_freq, -p log2 p - (1-p) log2(1-p).
    """
    n_docs = df.select(F.count(F.lit(1))).scalar()
    tf = term_counts(df, key, terms)
    per_term = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cnt"))
    lo = F.lit(min_df) if isinstance(min_df, int) else F.ceil(n_docs * F.lit(float(min_df)))
    hi = F.lit(max_df) if isinstance(max_df, int) else F.floor(n_docs * F.lit(float(max_df)))
    kept = per_term.where((F.col("df") >= lo) & (F.col("df") <= hi))
    total = kept.select(F.sum("cnt")).scalar()
    p = F.col("df") / F.lit(n_docs).cast("double")
    ent = F.when((p > 0) & (p < 1), -(p * F.log2(p)) - (1 - p) * F.log2(1 - p)).otherwise(F.lit(0.0))
    return kept.select("term", p.alias("doc_freq"), (F.col("cnt") / total).alias("term_freq"),
                       ent.alias("info_content"))


def term_statistic_features(df: DataFrame, key: str, grams: Column, stats: DataFrame,
                            prefix: str = "q1_") -> DataFrame:
    """Max and mean over a document's n-grams of each statistic; unknown n-grams
    count as 0 and documents without n-grams get 0 (F14)."""
    ex = explode_rows(df, [key], grams, "term")
    j = ex.join(stats, "term", "left")
    names = {"doc_freq": "docfreq", "term_freq": "termfreq", "info_content": "infocontent"}
    agg = j.groupBy(key).agg(*[e for s, n in names.items() for e in (
        F.max(F.coalesce(F.col(s), F.lit(0.0))).alias(f"{prefix}{n}_max"),
        F.avg(F.coalesce(F.col(s), F.lit(0.0))).alias(f"{prefix}{n}_mean"))])
    cols = [c for c in agg.columns if c != key]
    out = df.select(key).join(agg, key, "left")
    return out.select(key, *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in cols])
