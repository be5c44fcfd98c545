"""Spelling repair as a join job.

For a word: itself when known; else the best-ranked known word one edit away; else
two edits away; else itself.  "Edit" = delete any character, transpose two neighbours,
or put a letter a-z in or in place of another; ranks are smaller for more frequent words.

Words within two edits share a string that is left when at most two characters are
deleted from each, so candidates come from an equi-join on hashes of those strings
(some n^2 / 2 keys instead of the 1400 n^2 edits).  A known word of more than ``LONG``
characters is cut into ``PIECES`` pieces instead: two edits leave one of them whole, at a
place that moved by two at most.  Keys are made one row per place, so no row holds more
than its word, however long.  Every candidate is verified by an exact edit test.
"""
from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from ..functions.arrays import explode_rows
from ..session import reliable_checkpoint, spread_width

LONG = 15
PIECES = 5
LETTERS = frozenset("abcdefghijklmnopqrstuvwxyz")


def within(x: str, w: str, k: int) -> int:
    """Fewest edits (at most ``k``) that turn x into w, or ``k + 1``."""
    a = 0
    n = min(len(x), len(w))
    while a < n and x[a] == w[a]:
        a += 1
    z = 0
    while z < n - a and x[-1 - z] == w[-1 - z]:
        z += 1
    x, w = x[a:len(x) - z], w[a:len(w) - z]
    if not x and not w:
        return 0
    if k == 0 or abs(len(x) - len(w)) > k:
        return k + 1
    # what the first edit can be: it touches the place where the words part, or the next
    nexts = [(x[:i] + x[i + 1:], w) for i in range(min(2, len(x)))]
    nexts += [(x[:i] + x[i + 1] + x[i] + x[i + 2:], w) for i in range(min(2, len(x) - 1))]
    if w and w[0] in LETTERS:
        nexts += [(x, w[1:]), (x[1:], w[1:])] if x else [(x, w[1:])]
    return 1 + min((within(p, q, k - 1) for p, q in nexts), default=k)


@F.pandas_udf(IntegerType())
def edits_apart(x: pd.Series, w: pd.Series) -> pd.Series:
    return pd.Series([min(within(a, b, 2), 3) for a, b in zip(x, w)], dtype="int32")


def rank_table(df: DataFrame, tokens: Column, min_count: int = 1) -> DataFrame:
    """(word, rank): corpus word counts ranked by count desc then word (1 = top)."""
    from .ranking import global_index
    counts = (explode_rows(df, [], tokens, "word").groupBy("word")
              .agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count))
    return global_index(counts, [F.col("n").desc(), F.col("word").asc()], name="rank", start=1) \
        .select("word", "rank")


def _deletions(df: DataFrame, keep: list[str], most: int) -> DataFrame:
    """(*keep, key): hashes of the word with up to ``most`` characters deleted.  A key may come
    twice (from equal letters): pairs are made distinct, which spares a shuffle of all keys."""
    rest = 1 << 20
    whole = df.select(*keep, F.col("word").alias("e"), F.lit(1).alias("at"))
    out, last = whole, whole
    for _ in range(most):
        m = F.length("e")
        places = F.when(m >= F.col("at"), F.sequence(F.col("at"), m))
        last = (last.select(*keep, "e", F.explode(places).alias("i"))
                .select(*keep, F.concat(F.substring("e", F.lit(1), F.col("i") - 1), F.substring("e", F.col("i") + 1, F.lit(rest))).alias("e"),
                        F.col("i").alias("at")))
        out = out.unionByName(last)
    return out.select(*keep, F.xxhash64(F.lit("d"), "e").alias("key"))


def _pieces(df: DataFrame, keep: list[str], moves: bool) -> DataFrame:
    """(*keep, key): hashes of (length of the known word, number and text of a piece).  On the
    query side (``moves``) for every length and place two edits can lead to."""
    d = df.withColumn("n", F.length("word"))
    if moves:
        d = d.withColumn("by", F.explode(F.sequence(F.lit(-2), F.lit(2)))).withColumn("to", F.col("n") + F.col("by"))
        d = d.withColumn("move", F.explode(F.sequence(F.lit(-2), F.lit(2)))).where(F.col("to") > LONG)
    else:
        d = d.withColumn("to", F.col("n")).withColumn("move", F.lit(0))
    d = d.withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(PIECES - 1))))
    a = F.floor(F.col("p") * F.col("to") / PIECES).cast("int")
    z = F.floor((F.col("p") + 1) * F.col("to") / PIECES).cast("int")
    piece = F.substring("word", a + F.col("move") + 1, z - a)
    d = d.where(a + F.col("move") >= 0)
    return d.select(*keep, F.xxhash64(F.lit("p"), "to", "p", piece).alias("key")).distinct()


def _nearest(queries: DataFrame, vocab: DataFrame, edits: int) -> DataFrame:
    """(word, fix): best-ranked known word exactly ``edits`` (1 or 2) away, where there is one."""
    parts = spread_width(queries.sparkSession)
    q, v = queries.repartition(parts), vocab.repartition(parts)
    size = F.length("word")
    query_keys = (_deletions(q.where(size <= LONG + edits), ["word"], edits)
                  .unionByName(_pieces(q.where(size > LONG - edits), ["word"], True)))
    known_keys = (_deletions(v.where(size <= LONG), ["word", "rank"], edits)
                  .unionByName(_pieces(v.where(size > LONG), ["word", "rank"], False))
                  .withColumnRenamed("word", "known"))
    # both sides grow with the data and hold many more rows than the words they come from
    pairs = (query_keys.hint("merge").join(known_keys, "key")
             .where(F.abs(F.length("word") - F.length("known")) <= edits)
             .select("word", "known", "rank").distinct()
             .where(F.levenshtein("word", "known", 2 * edits) >= 0))
    found = pairs.where(edits_apart("word", "known") <= edits)
    return (found.groupBy("word").agg(F.min(F.struct("rank", "known")).alias("b"))
            .select("word", F.col("b.known").alias("fix")))


def correct_words(words: DataFrame, ranks: DataFrame, word_col: str = "word") -> DataFrame:
    """(word, correction) for every distinct word of ``words``."""
    vocab = ranks.select("word", "rank")
    distinct = words.select(F.col(word_col).alias("word")).where(F.col("word").isNotNull()).distinct()
    known = distinct.join(vocab, "word", "left_semi")
    oov = reliable_checkpoint(distinct.join(vocab, "word", "left_anti"))
    one = reliable_checkpoint(_nearest(oov, vocab, 1))
    two = _nearest(oov.join(one, "word", "left_anti"), vocab, 2)
    fixed = oov.join(one.unionByName(two), "word", "left").select("word", F.coalesce("fix", "word").alias("correction"))
    return known.select("word", F.col("word").alias("correction")).unionByName(fixed)
