"""Pair similarities and vector distances as Column expressions (V7, V9)."""
from __future__ import annotations

from typing import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules as R
from .clean import _col
from .tokens import whitespace_split


def word_match_share(q1, q2, stopwords: Iterable[str] = R.ENGLISH_STOPWORDS) -> Column:   # V7
    """2 * |A & B| / (|A| + |B|) over distinct lower-cased non-stop words; 0 if
    either side is empty."""
    stops = list(dict.fromkeys(stopwords))
    a = F.array_distinct(F.filter(whitespace_split(F.lower(_col(q1))), lambda x: ~x.isin(stops)))
    b = F.array_distinct(F.filter(whitespace_split(F.lower(_col(q2))), lambda x: ~x.isin(stops)))
    shared = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)) \
        .otherwise(2.0 * shared / (F.size(a) + F.size(b)))


def _dot(u: Column, v: Column) -> Column:
    return F.aggregate(F.zip_with(u, v, lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)


def cosine_distance(u, v) -> Column:
    """1 - u.v / (|u| |v|); null when either vector is all zero."""
    u, v = _col(u), _col(v)
    nu, nv = F.sqrt(_dot(u, u)), F.sqrt(_dot(v, v))
    return F.when((nu > 0) & (nv > 0), 1.0 - _dot(u, v) / (nu * nv))


def jaccard_distance(u, v) -> Column:
    """Share of positions that differ among those where either is non-zero."""
    u, v = _col(u), _col(v)
    flags = F.zip_with(u, v, lambda x, y: F.struct(((x != 0) | (y != 0)).cast("int").alias("nz"),
                                                   ((x != y) & ((x != 0) | (y != 0))).cast("int").alias("d")))
    nz = F.aggregate(flags, F.lit(0), lambda a, s: a + s["nz"])
    d = F.aggregate(flags, F.lit(0), lambda a, s: a + s["d"])
    return F.when(nz > 0, d / nz).otherwise(F.lit(0.0))


def hamming_distance(u, v) -> Column:
    """Share of positions that differ; null for empty vectors."""
    u, v = _col(u), _col(v)
    d = F.aggregate(F.zip_with(u, v, lambda x, y: (x != y).cast("int")), F.lit(0), lambda a, x: a + x)
    return F.try_divide(d, F.size(u))
