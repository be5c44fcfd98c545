"""Keyterm scores by PageRank on each document's word co-occurrence graph.

Edges join adjacent distinct tokens (undirected, weighted by co-occurrence count).  The
texts stay where they lie; the graphs of a batch of texts are one edge list of numbers, on which
the iterations run for all of them together.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, StructField, StructType

from .blocks import key_numbers, keys_together, whole_keys, word_numbers

BATCH_TOKENS = 500_000


def _best_ranks(t: pa.Table, damping: float, iterations: int) -> np.ndarray:
    """The largest rank in the graph of every row's key."""
    key, keys = key_numbers(t.column(0))
    row, word, words = word_numbers(t.column(1))
    best = np.zeros(len(keys))
    pair = np.flatnonzero((row[1:] == row[:-1]) & (word[1:] != word[:-1]) & (word[1:] >= 0) & (word[:-1] >= 0))
    if len(pair):
        number = key[row] * len(words) + word
        nodes, ends = np.unique(np.r_[number[pair], number[pair + 1]], return_inverse=True)
        a, b = ends[:len(pair)], ends[len(pair):]
        edges, w = np.unique(np.r_[a * len(nodes) + b, b * len(nodes) + a], return_counts=True)
        a, b = edges // len(nodes), edges % len(nodes)
        p = w / np.bincount(a, weights=w)[a]
        of = nodes // len(words)
        n = np.bincount(of)[of].astype(float)
        rank = 1.0 / n
        for _ in range(iterations):
            rank = (1.0 - damping) / n + damping * np.bincount(b, weights=p * rank[a], minlength=len(nodes))
        starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        best[of[starts]] = np.maximum.reduceat(rank, starts)
    best[np.array([k is None for k in keys.to_pylist()], bool)] = 0.0
    return best[key]


def keyterm_scores(df: DataFrame, key: str, tokens: str, damping: float = 0.85, iterations: int = 10) -> DataFrame:
    """(key, keyterm_score): the largest rank of a document's words, 0 without an edge or a key.  Rows of
    one key are one document."""
    docs = keys_together(df.select(key, tokens), key)

    def scores(batches):
        for t in whole_keys(batches, key, tokens, BATCH_TOKENS):
            yield from pa.Table.from_arrays([t.column(0), pa.array(_best_ranks(t, damping, iterations))], names=[key, "keyterm_score"]).to_batches()
    return docs.mapInArrow(scores, StructType([docs.schema[key], StructField("keyterm_score", DoubleType())]))
