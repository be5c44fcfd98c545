"""Sentences by abbreviations learned from the corpus, and the tokens of whole texts.

A word that nearly always stands with a period, is short and is seldom without one is an
abbreviation: the likelihood ratio of (word, period) times a length, an inner-period and a penalty
factor, as published for unsupervised sentence detection.  Counting is one aggregate over the words;
the table of abbreviations meets the words that end in a period by an equi-join.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import explode_rows, posexplode_rows
from ..functions.tokens import whitespace_split
from ..functions.treebank import treebank_tokens
from ..session import broadcast_few, reliable_checkpoint

LEAST_SCORE = 0.3
SURE = 0.99                                          # how often an abbreviation has its period
_LEAD = r"^[^\p{L}\p{N}]+"
_TAIL = r"[^\p{L}\p{N}.]+$"


def _kind(token: Column) -> Column:
    """A word in lower case without what surrounds it; its own last period stays."""
    return F.regexp_replace(F.regexp_replace(F.lower(token), _LEAD, ""), _TAIL, "")


def _bare(kind: Column) -> Column:
    return F.regexp_replace(kind, r"\.$", "")


def fit_abbreviations(df: DataFrame, text: str) -> DataFrame:
    """(word, score) of the corpus' abbreviations, without their last period."""
    words = posexplode_rows(df, [], whitespace_split(F.col(text)), "__p", "t").select(_kind(F.col("t")).alias("k")).where("k <> ''")
    counts = reliable_checkpoint(words.groupBy(_bare(F.col("k")).alias("word")).agg(
        F.count_if(F.col("k").endswith(".")).alias("dot"), F.count(F.lit(1)).alias("n")))
    total = counts.agg(F.sum("n").cast("double").alias("n"), F.sum("dot").cast("double").alias("dot")).first()
    if not total["n"] or not total["dot"] or total["dot"] == total["n"]:
        return counts.select("word", F.lit(0.0).alias("score")).where(F.lit(False))
    p = F.lit(total["dot"] / total["n"])
    rest = F.col("n") - F.col("dot")
    likely = lambda q: F.col("dot") * F.log(q) + rest * F.log(1 - q)
    inner = F.length("word") - F.length(F.replace("word", F.lit("."), F.lit("")))
    letters = (F.length("word") - inner).cast("double")
    score = (-2 * (likely(p) - likely(F.lit(SURE)))) * F.exp(-letters) * (inner + 1) * F.pow(letters, -rest.cast("double"))
    return counts.where(F.col("word").rlike(r"\p{L}") & (F.col("dot") > 0)).select("word", score.alias("score")).where(F.col("score") >= LEAST_SCORE)


def _keys(df: DataFrame, key: str) -> tuple[bool, bool]:
    """Whether a key repeats, and whether one is null."""
    r = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).agg(F.max(F.col("n") > 1).alias("more"), F.max(F.col(key).isNull()).alias("none")).first()
    return bool(r["more"]), bool(r["none"])


def _words(df: DataFrame, key: str, text: str, more: bool) -> DataFrame:
    """(key, __w): the words of every text; where keys repeat (``more``), one row for each key with the words of
    all its texts, by place."""
    if not more:
        return df.select(key, whitespace_split(F.col(text)).alias("__w"))
    of = df.groupBy(key).agg(F.collect_list(whitespace_split(F.col(text))).alias("__a"))
    placed = F.transform("__a", lambda w: F.transform(w, lambda t, i: F.struct(i.alias("p"), t.alias("t"))))
    merged = F.transform(F.sort_array(F.flatten(placed)), lambda x: x["t"])
    return of.select(key, F.when(F.size("__a") == 1, F.col("__a")[0]).otherwise(merged).alias("__w"))


def _stops(t: Column, following: Column, short: Column) -> Column:
    """Whether a sentence ends behind the word ``t``."""
    end = F.regexp_extract(t, r"([.!?]+)[\"'\)\]\}}»”]*$", 1)
    kind = _kind(t)
    capital = F.coalesce(following, F.lit("")).rlike(r"^[^\p{L}\p{N}]*\p{Lu}")
    known = kind.endswith(".") & F.array_contains(short, _bare(kind))
    return (F.when(end == "", False).when(end.rlike("[!?]"), True).when(F.length(end) > 1, capital)
            .otherwise(~known & ~kind.rlike(r"^\p{L}\.$")))


def _in_sentences(df: DataFrame, key: str, text: str, abbreviations: DataFrame, more: bool, none: bool) -> DataFrame:
    """(key, __s): the sentences of every text that has words (others: null), one row for each key.  The texts' words
    stay in their array; only the words that end in a period are spread out, once a text, to meet the
    abbreviations, and the few that are known come back to their text."""
    words = _words(df, key, text, more)
    kinds = F.transform(F.filter("__w", lambda t: F.contains(t, F.lit("."))), _kind)
    ended = F.array_distinct(F.transform(F.filter(kinds, lambda k: k.endswith(".")), _bare))
    met = explode_rows(words, [F.col(key).alias("__k")], ended, "__b")
    met = met.join(broadcast_few(abbreviations.select(F.col("word").alias("__w")), "__w"), F.col("__b") == F.col("__w"))
    met = met.groupBy("__k").agg(F.collect_set("__b").alias("__short")).hint("shuffle_hash")
    words = words.join(met, F.col(key).eqNullSafe(F.col("__k")) if none else F.col(key) == F.col("__k"), "left")
    short = F.coalesce("__short", F.array().cast("array<string>"))
    words = words.select(key, "__w", short.alias("__short"), F.size("__w").alias("__n"))
    # no word has a line break: one stands behind every word that ends a sentence, but the last
    marked = F.transform("__w", lambda t, i: F.when((i < F.col("__n") - 1) & t.rlike("[.!?]") & _stops(t, F.get(F.col("__w"), i + 1), F.col("__short")),
                                                    F.concat(t, F.lit("\n"))).otherwise(t))
    return words.select(key, F.when(F.col("__n") > 0, F.split(F.array_join(marked, " "), "\n ")).alias("__s"))


def split_sentences(df: DataFrame, key: str, text: str, abbreviations: DataFrame) -> DataFrame:
    """(key, no, sentence): words with single blanks; a sentence ends behind ``!``, ``?`` or a period,
    unless the word before the period is an abbreviation or a single letter; behind an ellipsis
    where a capital follows."""
    return posexplode_rows(_in_sentences(df, key, text, abbreviations, *_keys(df, key)), [key], F.col("__s"), "no", "sentence")


def tokenize_texts(df: DataFrame, key: str, text: str, abbreviations: DataFrame | None = None, out_col: str = "tokens") -> DataFrame:   # T1
    """(key, tokens): the Treebank tokens of every sentence of every text, in order."""
    known = fit_abbreviations(df, text) if abbreviations is None else abbreviations
    more, none = _keys(df, key)
    empty = F.array().cast("array<string>")
    tokens = F.when(F.col(key).isNotNull(), F.flatten(F.transform("__s", treebank_tokens)))
    s = _in_sentences(df, key, text, known, more, none).select(key, F.coalesce(tokens, empty).alias(out_col))
    return df.select(key).join(s, key, "left").select(key, F.coalesce(out_col, empty).alias(out_col)) if more else s
