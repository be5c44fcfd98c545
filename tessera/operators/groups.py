"""Grouped statistics (A12, A13) and their row-broadcast form.

pandas ``groupby(...).transform(stat)`` is written as an aggregate joined back on the
group key rather than a window: the aggregate is combined map-side, so a key that
holds a third of all rows never lands in one task, and AQE broadcasts the small
per-key table or splits a skewed join partition.  All statistics for one key come
from one aggregate and one join.
"""
from __future__ import annotations

import itertools
from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_few

# statistic name -> aggregate; the allow-list replaces free-form aggregate strings
STATISTICS = {
    "mean": F.avg,
    "max": F.max,
    "min": F.min,
    "count": lambda c: F.count(c).cast("bigint"),
    "sum": F.sum,
    "std": F.stddev_samp,
    "nunique": lambda c: F.count_distinct(c).cast("bigint"),
}


def _stat(name: str):
    if name not in STATISTICS:
        raise ValueError(f"statistic {name!r} not in {sorted(STATISTICS)}")
    return STATISTICS[name]


def _as_list(x) -> list:
    return [x] if isinstance(x, str) else list(x)


def group_stats(df: DataFrame, by: str, feats: Sequence[str], statistics,
                name_fmt: str = "{by}_by_{f}_{stat}") -> DataFrame:
    """Aggregate form: one row per non-null key with ``{by}_by_{f}_{stat}`` columns."""
    aggs = [_stat(s)(F.col(f)).alias(name_fmt.format(by=by, f=f, stat=s))
            for s in _as_list(statistics) for f in _as_list(feats)]
    return df.where(F.col(by).isNotNull()).groupBy(by).agg(*aggs)


def group_transform(df: DataFrame, by: str, feats: Sequence[str], statistics,
                    name_fmt: str = "{by}_by_{f}_{stat}") -> DataFrame:
    """Row-broadcast form: every row gets its group's statistics (null key -> null)."""
    stats = group_stats(df, by, feats, statistics, name_fmt)
    return df.join(broadcast_few(stats, by), by, "left")


def group_feat_by_feat(df: DataFrame, by: str, feats: Sequence[str], statistic="mean",
                       transform: bool = False) -> DataFrame:
    if transform:
        return group_transform(df, by, feats, statistic)
    return group_stats(df, by, feats, statistic)


def group_featurebyfeature_encode(df: DataFrame, new_name: str, var1: str, var2: str,
                                  transformation: str) -> DataFrame:   # W1
    return group_transform(df, var1, [var2], transformation, name_fmt=new_name)


def group_feat_by_feat_list(df: DataFrame, features: Sequence[str], transformation: str) -> DataFrame:   # W3
    out = df
    for a, b in zip(features[:-1], features[1:]):
        out = group_transform(out, a, [b], transformation)
    return out


def feature_combinations_grouping(df: DataFrame, features: Sequence[str], transformation: str) -> DataFrame:   # W4
    """All unordered pairs (a groups b); pairs sharing ``a`` share one aggregate."""
    out = df
    for a in features:
        partners = [b for x, b in itertools.combinations(features, 2) if x == a]
        if partners:
            out = group_transform(out, a, partners, transformation,
                                  name_fmt="{by}_by_{f}_{stat}_combinations")
    return out


def groupings_feature_set(df: DataFrame, features: Sequence[str],
                          keys: Sequence[str] = ("year", "month", "market", "customer_id"),
                          statistics: Sequence[str] = ("mean", "max", "count")) -> DataFrame:   # W5
    """12 blocks (4 keys x 3 statistics) from 4 aggregates and 4 joins."""
    out = df
    for k in keys:
        out = group_transform(out, k, features, list(statistics))
    return out
