"""Time-lag features on an (entity, month) panel (L1-L4).

The reference loops over months, filtering and joining once per month.  Here every
variant is one plan: rows are reduced to per-(entity, month) partial aggregates
(sum, count, min, max), cumulative history comes from conditional aggregation or a
range window over an entity's months (a handful of rows per entity, never the raw
rows of a hot entity), and rows meet their features by one equi-join.
"""
from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

AGGS = ("mean", "sum", "count", "min", "max")


def _check(agg: str):
    if agg not in AGGS:
        raise ValueError(f"agg_func must be one of {AGGS}")


def _partials(df: DataFrame, entity: str, date: str, feats: Sequence[str]) -> DataFrame:
    aggs = []
    for f in feats:
        aggs += [F.sum(f).alias(f"{f}__s"), F.count(f).alias(f"{f}__n"),
                 F.min(f).alias(f"{f}__lo"), F.max(f).alias(f"{f}__hi")]
    return df.groupBy(entity, date).agg(*aggs)


def _finish(f: str, agg: str, s: Column, n: Column, lo: Column, hi: Column) -> Column:
    if agg == "mean":
        return F.when(n > 0, s / n)
    if agg == "sum":
        return F.when(n > 0, s)
    if agg == "count":
        return F.coalesce(n, F.lit(0)).cast("bigint")
    return lo if agg == "min" else hi


def _features(features, only_target: bool, target: str) -> list[str]:
    if only_target:
        return [target]
    if not features:
        raise ValueError("give features or only_target=True")   # quirk Q14
    return list(features)


def aggregated_lags(df: DataFrame, current_month: int, features=None, only_target: bool = False,
                    agg_func: str = "mean", month_merge: bool = False, entity: str = "customer_id",
                    date: str = "date", target: str = "target", keep: Sequence[str] = ()) -> DataFrame:   # L1
    """Per entity, aggregate everything strictly before ``current_month``; left join."""
    _check(agg_func)
    feats = _features(features, only_target, target)
    left = df.where(F.col(date) == current_month) if month_merge else df
    hist = df.where(F.col(date) < current_month)
    g = {"mean": F.avg, "sum": F.sum, "count": F.count, "min": F.min, "max": F.max}[agg_func]
    lag = hist.groupBy(entity).agg(*[g(f).alias(f"{f}_lag_agg") for f in feats])
    return left.select(*keep, entity).join(lag, entity, "left")


def lag_features(df: DataFrame, current_month: int = 1, start_lag: int = 0, incremental: bool = False,
                 features=None, only_target: bool = False, agg_func: str = "mean",
                 month_merge: bool = False, entity: str = "customer_id", date: str = "date",
                 target: str = "target", keep: Sequence[str] = ()) -> DataFrame:   # L2
    """Columns ``{f}_lag{i}`` for months ``start_lag .. current_month-1``: that month
    (mean) or all months up to it (incremental), from one conditional aggregate."""
    feats = _features(features, only_target, target)
    if not incremental:
        agg_func = "mean"
    _check(agg_func)
    months = list(range(start_lag, current_month))
    left = df.where(F.col(date) == current_month) if month_merge else df
    aggs = []
    for i, m in enumerate(months):
        cond = (F.col(date) <= m) if incremental else (F.col(date) == m)
        for f in feats:
            v = F.when(cond, F.col(f))
            e = {"mean": F.avg, "sum": F.sum, "count": F.count, "min": F.min, "max": F.max}[agg_func](v)
            aggs.append(e.alias(f"{f}_lag{i}"))
    if not aggs:
        return left.select(*keep, entity)
    lag = df.where(F.col(date) < current_month).groupBy(entity).agg(*aggs)
    return left.select(*keep, entity).join(lag, entity, "left")


def lags_panel(df: DataFrame, start: int, end: int, features=None, only_target: bool = False,
               incremental: bool = False, agg_func: str = "mean", entity: str = "customer_id",
               date: str = "date", target: str = "target", keep: Sequence[str] = ()) -> DataFrame:
    """Rows of months ``start..end`` with their lag features, all months in one plan.

    Non-incremental: ``{f}_lag0`` = mean of the entity's month m-1.
    Incremental: ``{f}_lag{j}`` = aggregate over months <= start+j, defined when
    start+j < m (null otherwise), j = 0 .. end-start-1.
    """
    feats = _features(features, only_target, target)
    if not incremental:
        agg_func = "mean"
    _check(agg_func)
    rows = df.where((F.col(date) >= start) & (F.col(date) <= end)).select(*keep, entity, date)
    parts = _partials(df.where(F.col(date) <= end), entity, date, feats)
    if not incremental:
        prev = parts.select(entity, (F.col(date) + 1).alias(date),
                            *[_finish(f, "mean", F.col(f"{f}__s"), F.col(f"{f}__n"), None, None)
                              .alias(f"{f}_lag0") for f in feats])
        return rows.join(prev, [entity, date], "left")
    span = list(range(0, end - start))
    aggs = []
    for j in span:
        cut = F.col(date) <= start + j
        for f in feats:
            s = F.sum(F.when(cut, F.col(f"{f}__s")))
            n = F.sum(F.when(cut, F.col(f"{f}__n")))
            lo = F.min(F.when(cut, F.col(f"{f}__lo")))
            hi = F.max(F.when(cut, F.col(f"{f}__hi")))
            aggs.append(_finish(f, agg_func, s, n, lo, hi).alias(f"{f}_lag{j}"))
    if not aggs:
        return rows
    cum = parts.groupBy(entity).agg(*aggs)
    out = rows.join(cum, entity, "left")
    masked = [F.when(F.lit(start + j) < F.col(date), F.col(f"{f}_lag{j}")).alias(f"{f}_lag{j}")
              for j in span for f in feats]
    return out.select(*keep, entity, date, *masked)


def lags_long(df: DataFrame, start: int, features=None, only_target: bool = False, agg_func: str = "mean",
              entity: str = "customer_id", date: str = "date", target: str = "target", keep: Sequence[str] = ()) -> DataFrame:   # L3
    """The incremental lags in long layout, for panels of any length: (*keep, entity, date, lag,
    {f}_lag) for every row of month ``start`` or later and every lag j with start + j before the
    row's month; the value covers the entity's months up to start + j.  A row of the first
    month has no lag and so no line.  Months are gathered per entity (one struct each)."""
    feats = _features(features, only_target, target)
    _check(agg_func)
    cols = [f"{f}__{k}" for f in feats for k in ("s", "n", "lo", "hi")]
    months = _partials(df, entity, date, feats).groupBy(entity).agg(F.collect_list(F.struct(F.col(date).alias("__m"), *cols)).alias("__p"))
    rows = df.where(F.col(date) > start).select(*keep, entity, date).join(months, entity)
    rows = rows.select(*keep, entity, date, "__p", F.explode(F.sequence(F.lit(0), (F.col(date) - start - 1).cast("int"))).alias("lag"))
    known = F.filter("__p", lambda p: p["__m"] <= F.lit(start) + F.col("lag"))
    rows = rows.select(*keep, entity, date, "lag", known.alias("__p"))

    def value(f: str) -> Column:
        total = lambda c: F.aggregate("__p", F.lit(0.0), lambda a, p: a + F.coalesce(p[c].cast("double"), F.lit(0.0)))
        each = lambda c: F.transform("__p", lambda p: p[c])
        return _finish(f, agg_func, total(f"{f}__s"), total(f"{f}__n"), F.array_min(each(f"{f}__lo")), F.array_max(each(f"{f}__hi")))

    return rows.select(*keep, entity, date, "lag", *[value(f).alias(f"{f}_lag") for f in feats])


def prepare_lags_data(train: DataFrame, test: DataFrame, start_train: int = 1, end_train: int = 11,
                      start_test: int = 12, end_test: int = 15, **kw) -> tuple[DataFrame, DataFrame]:   # L3
    return (lags_panel(train, start_train, end_train, **kw),
            lags_panel(test, start_test, end_test, **kw))


def history_aggregates(df: DataFrame, start: int, end: int, features=None, only_target: bool = False,
                       agg_func: str = "mean", entity: str = "customer_id", date: str = "date",
                       target: str = "target", keep: Sequence[str] = ()) -> DataFrame:
    """Rows of months ``start..end`` with ``{f}_lag_agg`` over the entity's months
    strictly before the row's month (null when there is no history).

    Rows are reduced to per-(entity, month) partials; a range window over an entity's
    months (at most one row per month) accumulates them; rows join back on
    (entity, month) - every row's own month is present among the partials.
    """
    feats = _features(features, only_target, target)
    _check(agg_func)
    parts = _partials(df.where(F.col(date) <= end), entity, date, feats)
    w = Window.partitionBy(entity).orderBy(date).rangeBetween(Window.unboundedPreceding, -1)
    cum = parts.select(entity, date, *[
        _finish(f, agg_func, F.sum(f"{f}__s").over(w), F.sum(f"{f}__n").over(w),
                F.min(f"{f}__lo").over(w), F.max(f"{f}__hi").over(w)).alias(f"{f}_lag_agg")
        for f in feats])
    rows = df.where((F.col(date) >= start) & (F.col(date) <= end)).select(*keep, entity, date)
    return rows.join(cum, [entity, date], "left")


def prepare_aggregated_lags(train: DataFrame, test: DataFrame, start_train: int = 1, end_train: int = 11,
                            start_test: int = 12, end_test: int = 15, **kw) -> tuple[DataFrame, DataFrame]:   # L4
    return (history_aggregates(train, start_train, end_train, **kw),
            history_aggregates(test, start_test, end_test, **kw))
