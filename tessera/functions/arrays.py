"""Exploding computed arrays.

An inner ``explode`` lets the optimizer infer a ``size(array) > 0`` filter and push
it below the projections, which re-evaluates the whole array expression (tokenizers,
n-grams, edit sets) inside that filter.  The outer generators do not trigger that
inference; the row they emit for an empty array is dropped right after.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def explode_rows(df: DataFrame, keep, arr: Column, name: str) -> DataFrame:
    """``df.select(*keep, explode(arr) as name)`` without the inferred filter.
    Null elements are dropped with the empty-array row."""
    return df.select(*keep, F.explode_outer(arr).alias(name)).where(F.col(name).isNotNull())


def posexplode_rows(df: DataFrame, keep, arr: Column, pos: str, name: str) -> DataFrame:
    return df.select(*keep, F.posexplode_outer(arr).alias(pos, name)).where(F.col(pos).isNotNull())
