"""Topics by expectation maximisation over the long (document, term, count) table (V6).

A topic's terms and a document's topics are tables of ``k`` columns by term and by document; the
responsibilities of a (document, term) pair come from two joins, and their sums by document
and by term are the next tables.  Only the ``k`` topic totals reach the driver.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import reliable_checkpoint
from .corpus import term_counts
from .encoders import keyed_uniform


def _responsibilities(counts: DataFrame, key: str, shares: DataFrame, topics: DataFrame, k: int) -> DataFrame:
    """key, term, r0..: the counts of every pair dealt to the topics."""
    j = counts.join(shares, key).join(topics, "term")
    weight = [F.col(f"t{z}") * F.col(f"p{z}") for z in range(k)]
    total = sum(weight[1:], weight[0])
    return j.select(key, "term", *[F.coalesce(F.try_divide(F.col("tf") * w, total), F.lit(0.0)).alias(f"r{z}") for z, w in enumerate(weight)])


def _shares(dealt: DataFrame, key: str, k: int) -> DataFrame:
    s = dealt.groupBy(key).agg(*[F.sum(f"r{z}").alias(f"r{z}") for z in range(k)])
    total = sum((F.col(f"r{z}") for z in range(1, k)), F.col("r0"))
    return s.select(key, *[F.coalesce(F.try_divide(F.col(f"r{z}"), total), F.lit(1.0 / k)).alias(f"t{z}") for z in range(k)])


def _even(counts: DataFrame, key: str, k: int) -> DataFrame:
    return counts.select(key).distinct().select(key, *[F.lit(1.0 / k).alias(f"t{z}") for z in range(k)])


def _of_one(table: DataFrame, names: list[str], out: list[str]) -> DataFrame:
    """Columns divided by their sums (``k`` numbers on the driver; a topic without weight is 0)."""
    sums = table.agg(*[F.sum(c) for c in names]).first()
    return table.select("term", *[(F.col(c) / F.lit(float(s)) if s else F.lit(0.0)).alias(o) for c, o, s in zip(names, out, sums)])


def fit_topics(counts: DataFrame, key: str, k: int, steps: int = 20, seed: int = 1337, method: str = "xxhash64") -> DataFrame:   # V6
    """(term, p0..): each topic's distribution over the terms of ``counts`` (key, term, tf), from
    a start drawn by term and topic."""
    counts = reliable_checkpoint(counts.select(key, "term", "tf"))
    p = [f"p{z}" for z in range(k)]
    topics = counts.select("term").distinct().select("term", *[keyed_uniform(seed, F.col("term"), F.lit(z), method=method).alias(c) for z, c in enumerate(p)])
    topics = _of_one(reliable_checkpoint(topics), p, p)
    shares = _even(counts, key, k)
    for _ in range(steps):
        dealt = reliable_checkpoint(_responsibilities(counts, key, shares, topics, k))
        shares = _shares(dealt, key, k)
        r = [f"r{z}" for z in range(k)]
        topics = _of_one(reliable_checkpoint(dealt.groupBy("term").agg(*[F.sum(c).alias(c) for c in r])), r, p)
    return reliable_checkpoint(topics)


def topic_shares(df: DataFrame, key: str, tokens: Column, topics: DataFrame, steps: int = 20, prefix: str = "topic") -> DataFrame:
    """(key, topic0..): the topics of every text under fitted topics, terms that they do not know
    left out; even shares for a text without known terms."""
    k = len(topics.columns) - 1
    counts = reliable_checkpoint(term_counts(df, key, tokens).join(topics.select("term"), "term", "left_semi").select(key, "term", "tf"))
    shares = _even(counts, key, k)
    for _ in range(steps):
        shares = _shares(_responsibilities(counts, key, shares, topics, k), key, k)
        shares = reliable_checkpoint(shares)
    return df.select(key).join(shares, key, "left").select(key, *[F.coalesce(F.col(f"t{z}"), F.lit(1.0 / k)).alias(f"{prefix}{z}") for z in range(k)])


def pair_topics(df: DataFrame, key: str, one: Column, two: Column, k: int, steps: int = 20, seed: int = 1337, method: str = "xxhash64") -> DataFrame:
    """Topics fitted on both columns of a pair together, then the shares of each: key,
    one_topic0.., two_topic0..."""
    counts = term_counts(df, key, F.concat(one, two))
    topics = fit_topics(counts, key, k, steps, seed, method)
    return topic_shares(df, key, one, topics, steps, "one_topic").join(topic_shares(df, key, two, topics, steps, "two_topic"), key)
