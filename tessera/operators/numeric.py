"""Numeric columns: impute, round, bin, scale, row statistics, interactions,
target transforms and duplicate-column detection (N1-N15).

Global statistics (mean, extremes, std) are scalar subqueries; the exact median is
an order statistic found with a distributed prefix count over distinct values, so
neither a single task nor the driver ever holds a column.
"""
from __future__ import annotations

import itertools
import math
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import global_index, global_prefix


def _known(df: DataFrame, c: str) -> Column:
    """The column with NaN read as missing (as data frames do), for float types only."""
    if df.schema[c].dataType.typeName() in ("double", "float"):
        return F.when(~F.isnan(F.col(c)), F.col(c))
    return F.col(c)


# --- N1-N3 ----------------------------------------------------------------------
def impute_constant(df: DataFrame, cols: Sequence[str], value: float = -999) -> DataFrame:   # N1
    return df.fillna(value, subset=list(cols))


def impute_mean(df: DataFrame, cols: Sequence[str]) -> DataFrame:   # N2
    out = df
    for c in cols:
        x = _known(df, c)
        out = out.withColumn(c, F.coalesce(x, df.select(F.avg(x)).scalar()))
    return out


def exact_quantile(df: DataFrame, col: str, q: float = 0.5) -> Column:
    """Exact quantile with linear interpolation (pandas/numpy default) as a scalar.

    Non-null values are reduced to (value, count), a distributed prefix count gives
    each distinct value its position range, and the two order statistics around
    q*(n-1) are picked - no collect, no single-partition sort.
    """
    x = _known(df, col)
    vals = df.where(x.isNotNull()).groupBy(x.alias("v")).agg(
        F.count(F.lit(1)).alias("k"))
    n = vals.select(F.sum("k")).scalar()
    pos = global_prefix(vals, [F.col("v").asc()], {"before": F.col("k")}, inclusive=False)
    h = (n - 1) * F.lit(float(q))
    lo_i, hi_i = F.floor(h), F.ceil(h)
    lo = pos.where((F.col("before") <= lo_i) & (lo_i < F.col("before") + F.col("k"))).select(F.max("v")).scalar()
    hi = pos.where((F.col("before") <= hi_i) & (hi_i < F.col("before") + F.col("k"))).select(F.max("v")).scalar()
    return lo + (hi - lo) * (h - lo_i)


def impute_median(df: DataFrame, cols: Sequence[str]) -> DataFrame:   # N3
    out = df
    for c in cols:
        out = out.withColumn(c, F.coalesce(_known(df, c), exact_quantile(df, c, 0.5)))
    return out


# --- N5-N7 ----------------------------------------------------------------------
def round_half_even(df: DataFrame, cols: Sequence[str], precision: int) -> DataFrame:   # N5
    """numpy-style rounding: rint(x * 10^p) / 10^p (ties to even on the scaled double)."""
    k = float(10 ** precision)
    return df.select(*[(F.rint(F.col(c) * k) / k).alias(c) if c in cols else F.col(c)
                       for c in df.columns])


def bin_codes(df: DataFrame, col: str, step: float) -> DataFrame:   # N6
    """Right-closed bins (0, s], (s, 2s], ... up to the last edge below max; the
    observed bins get dense codes in sorted order, out of range -> -1."""
    mx = df.select(F.max(col)).scalar()
    n_edges = F.ceil(mx / F.lit(float(step)))
    j = F.ceil(F.col(col) / F.lit(float(step))) - 1
    valid = (F.col(col) > 0) & (j <= n_edges - 2)
    tagged = df.withColumn("__bin", F.when(valid, j))
    observed = tagged.where(F.col("__bin").isNotNull()).select("__bin").distinct()
    codes = global_index(observed, [F.col("__bin").asc()], name="__code")
    return (tagged.join(codes, "__bin", "left")
            .withColumn(col, F.coalesce(F.col("__code"), F.lit(-1)).cast("bigint"))
            .drop("__bin", "__code"))


def digitize(df: DataFrame, cols: Sequence[str], step: float, suffix: str = "_binned") -> DataFrame:   # N7
    """Right-inclusive digitize against edges 0, step, ... < max: index = number of
    edges below the value, capped at the edge count; null -> edge count; +inf is
    read as 999 first."""
    out = df
    for c in cols:
        x = F.when(_known(df, c) == float("inf"), F.lit(999.0)).otherwise(_known(df, c))
        mx = df.select(F.max(x)).scalar()
        e = F.greatest(F.ceil(mx / F.lit(float(step))), F.lit(0))
        idx = F.least(F.greatest(F.ceil(x / F.lit(float(step))), F.lit(0)), e)
        # greatest/least skip nulls, so the null case is spelled out
        out = out.withColumn(c + suffix, F.when(x.isNull(), e).otherwise(idx).cast("bigint"))
    return out


# --- N8 / N9 --------------------------------------------------------------------
def scale_standard(df: DataFrame, cols: Sequence[str]) -> DataFrame:   # N8
    """(x - mean) / population std; a constant column becomes 0."""
    out = df
    for c in cols:
        x = _known(df, c)
        m = df.select(F.avg(x)).scalar()
        s = df.select(F.stddev_pop(x)).scalar()
        out = out.withColumn(c, (x - m) / F.when(s == 0, F.lit(1.0)).otherwise(s))
    return out


def scale_minmax(df: DataFrame, cols: Sequence[str]) -> DataFrame:   # N9
    """(x - min) / (max - min); a constant column becomes 0."""
    out = df
    for c in cols:
        x = _known(df, c)
        lo = df.select(F.min(x)).scalar()
        hi = df.select(F.max(x)).scalar()
        rng = hi - lo
        out = out.withColumn(c, (x - lo) / F.when(rng == 0, F.lit(1.0)).otherwise(rng))
    return out


# --- N10 / N11 ------------------------------------------------------------------
def _row_moments(df: DataFrame, cols: Sequence[str]):
    xs = [_known(df, c).cast("double") for c in cols]
    n = sum((x.isNotNull().cast("int") for x in xs), F.lit(0))
    s = sum((F.coalesce(x, F.lit(0.0)) for x in xs), F.lit(0.0))
    mean = F.when(n > 0, s / n)
    ss = sum((F.coalesce((x - mean) * (x - mean), F.lit(0.0)) for x in xs), F.lit(0.0))
    std = F.when(n > 1, F.sqrt(ss / (n - 1)))
    mx = F.greatest(*xs) if len(xs) > 1 else xs[0]
    return n, s, mean, std, mx


def row_statistics(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:   # N10
    """Per row over the given columns: zeros, non-zeros, nulls, negatives, sum, mean,
    sample std and max (all over the original columns, quirk Q17)."""
    xs = [_known(df, c) for c in cols]
    n, s, mean, std, mx = _row_moments(df, cols)
    cnt = lambda pred: sum((F.coalesce(pred(x), F.lit(False)).cast("bigint") for x in xs), F.lit(0).cast("bigint"))
    return df.select(*keep, *cols,
                     cnt(lambda x: x == 0).alias("zeros"),
                     cnt(lambda x: x != 0).alias("non_zeros"),
                     cnt(lambda x: x.isNull()).alias("nans"),
                     cnt(lambda x: x < 0).alias("negatives"),
                     s.alias("sum_row"), mean.alias("mean_row"), std.alias("std_row"),
                     mx.cast("double").alias("max_row"))


def add_statistics(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:   # N11
    k = len(cols)
    n, s, mean, std, mx = _row_moments(df, cols)
    return df.select(*keep, s.alias(f"sum_row_{k}cols"), mean.alias(f"mean_row{k}cols"),
                     std.alias(f"std_row{k}cols"), mx.cast("double").alias(f"max_row{k}cols"))


# --- N12 / N13 ------------------------------------------------------------------
def pairwise_sums(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:   # N12
    return df.select(*keep, *cols, *[(F.col(a) + F.col(b)).alias(f"{a}_plus_{b}")
                                     for a, b in itertools.combinations(cols, 2)])


def pairwise_products(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:   # N13
    return df.select(*keep, *[(F.col(a) * F.col(b)).alias(f"{a}_{b}")
                              for a, b in itertools.combinations(cols, 2)])


# --- N14 ------------------------------------------------------------------------
def boxcox(x: Column, lam: float) -> Column:
    return F.log(x) if abs(lam) < 1e-12 else (F.pow(x, F.lit(lam)) - 1.0) / F.lit(lam)


def fit_boxcox_lambda(df: DataFrame, col: str, lo: float = -2.0, hi: float = 2.0,
                      step: float = 0.05, refine: int = 2) -> float:
    """Maximum-likelihood Box-Cox lambda: the log-likelihood
    (lam - 1) * sum(ln x) - n/2 * ln(var_pop(boxcox(x, lam))) is evaluated for a
    whole grid of lambdas in one pass - each row is paired with the literal grid and
    ``var_pop`` is aggregated per lambda (combined map-side) - and the grid is refined
    around the best point ``refine`` times.  Only one row per grid point reaches the
    driver."""
    x = F.col(col)
    pos = df.where(x > 0).select(x.alias("x"))
    base = pos.agg(F.count("x").alias("n"), F.sum(F.log("x")).alias("sl")).first()
    n, sl = base["n"], base["sl"]
    best = None
    for _ in range(refine + 1):
        grid = [lo + i * step for i in range(int(round((hi - lo) / step)) + 1)]
        lam = F.col("lam")
        bc = F.when(F.abs(lam) < 1e-12, F.log("x")).otherwise((F.pow(F.col("x"), lam) - 1.0) / lam)
        rows = (pos.select(F.explode(F.array(*[F.lit(float(l)) for l in grid])).alias("lam"), "x")
                .groupBy("lam").agg(F.var_pop(bc).alias("v")).collect())
        llf = {r["lam"]: ((r["lam"] - 1) * sl - n / 2.0 * math.log(r["v"])) if r["v"] else -math.inf
               for r in rows}
        best = max(sorted(llf), key=lambda l: llf[l])
        lo, hi, step = best - step, best + step, step / 20.0
    return best


def target_engineering(df: DataFrame, target: str = "target", bin_width: float = 100.0,
                       keep: Sequence[str] = (), lam: float | None = None) -> DataFrame:
    """log -> ^0.25 + 1 -> square -> Box-Cox (fitted lambda, or ``lam``) -> bins of
    ``bin_width`` (left-closed digitize against 0, w, 2w, ... < max)."""
    y = F.pow(F.pow(F.log(F.col(target)), F.lit(0.25)) + 1.0, F.lit(2.0))
    staged = df.select(*keep, y.alias("__y"))
    if lam is None:
        lam = fit_boxcox_lambda(staged, "__y")
    bc = staged.select(*keep, boxcox(F.col("__y"), lam).alias("__bc"))
    mx = bc.select(F.max("__bc")).scalar()
    e = F.greatest(F.ceil(mx / F.lit(bin_width)), F.lit(0))
    idx = F.least(F.greatest(F.floor(F.col("__bc") / F.lit(bin_width)) + 1, F.lit(0)), e)
    return bc.select(*keep, F.col("__bc").alias(f"{target}_boxcox"), idx.cast("bigint").alias(f"{target}_bin"))


# --- N15 ------------------------------------------------------------------------
def duplicate_columns(df: DataFrame, key: str, cols: Sequence[str] | None = None) -> list[str]:
    """The names that ``duplicate_columns_frame`` finds, sorted (at most one per column)."""
    cols = [c for c in (cols or df.columns) if c != key]
    return sorted(r["column_name"] for r in duplicate_columns_frame(df, key, cols).collect())


def duplicate_columns_frame(df: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """(column_name): columns equal (null-safe) to an earlier column, on all rows.

    One aggregate computes an order-free fingerprint per column - sum and xor of
    xxhash64(key, value) - and candidates with equal fingerprints are confirmed with one
    more aggregate of null-safe inequalities.  ``key`` must be unique; only the fingerprint row
    reaches the driver."""
    cols = list(cols)
    fp = df.select(*[F.struct(F.sum(F.xxhash64(F.col(key), F.col(c)) % 1000003),
                              F.bit_xor(F.xxhash64(F.col(key), F.col(c)))).alias(c) for c in cols]).first()
    groups: dict = {}
    for c in cols:
        groups.setdefault(tuple(fp[c]), []).append(c)
    pairs = [(g[0], c) for g in groups.values() if len(g) > 1 for c in g[1:]]
    spark = df.sparkSession
    if not pairs:
        return spark.createDataFrame([], "column_name string")
    checks = df.select(*[F.count_if(~F.col(a).eqNullSafe(F.col(b))).alias(f"p{i}")
                         for i, (a, b) in enumerate(pairs)])
    stacked = checks.select(F.explode(F.array(*[
        F.struct(F.lit(b).alias("column_name"), F.col(f"p{i}").alias("diff"))
        for i, (a, b) in enumerate(pairs)])).alias("s"))
    return stacked.where(F.col("s.diff") == 0).select("s.column_name").distinct()
