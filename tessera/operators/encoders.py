"""Categorical encoders and lookups.

Fit/transform pairs return a fitted *table* keyed by the category; applying it is
an equi-join, so train statistics reach test rows without driver round trips.
Category tables are one row per distinct value: AQE turns the join into a broadcast
when that table is small at run time and keeps a shuffle join (with skew splitting
of hot categories) when it is not.  Global statistics (max, prior) enter as scalar
subqueries, never as collected values.
"""
from __future__ import annotations

import itertools
import math
from typing import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_few
from .ranking import global_index


def _cols(cols) -> list[str]:
    return [cols] if isinstance(cols, str) else list(cols)


# --- A1 -----------------------------------------------------------------------
def fit_label_encoding(df: DataFrame, col: str) -> DataFrame:
    """(value, code): code = position of the value in sorted order of distinct values."""
    vals = df.select(F.col(col).alias("value")).where(F.col("value").isNotNull()).distinct()
    return global_index(vals, [F.col("value").asc()], name="code")


def label_encode(df: DataFrame, cols, suffix: str = "") -> DataFrame:
    """Category -> code in sorted category order, null/unseen -> -1."""
    out = df
    for c in _cols(cols):
        table = fit_label_encoding(df, c).select(F.col("value").alias(c), F.col("code").alias("__code"))
        out = (out.join(table, c, "left")
               .withColumn(c + suffix, F.coalesce(F.col("__code"), F.lit(-1)).cast("bigint"))
               .drop("__code"))
    return out


# --- A4 -----------------------------------------------------------------------
def count_encode(df: DataFrame, cols, normalize: bool = False,
                 suffix: str = "_count_encode") -> DataFrame:
    """Value -> its frequency (optionally divided by the largest frequency)."""
    out = df
    for c in _cols(cols):
        counts = df.groupBy(c).agg(F.count(F.lit(1)).alias("__n")).where(F.col(c).isNotNull())
        val = F.col("__n")
        if normalize:
            val = val / counts.select(F.max("__n")).scalar()
        else:
            val = val.cast("bigint")
        out = out.join(broadcast_few(counts, c), c, "left").withColumn(c + suffix, val).drop("__n")
    return out


# --- A5 -----------------------------------------------------------------------
def fit_labelcount(df: DataFrame, col: str, ascending: bool = False) -> DataFrame:
    """(value, rank): 0 = most frequent (ties by value); reversed when ascending."""
    counts = (df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("value"))
              .agg(F.count(F.lit(1)).alias("n")))
    ranked = global_index(counts, [F.col("n").desc(), F.col("value").asc()], name="rank")
    if ascending:
        k = counts.select(F.count(F.lit(1))).scalar()
        ranked = ranked.withColumn("rank", (k - 1 - F.col("rank")).cast("bigint"))
    return ranked


def labelcount_encode(df: DataFrame, cols, ascending: bool = False,
                      suffix: str = "_lc_encode") -> DataFrame:
    out = df
    for c in _cols(cols):
        t = fit_labelcount(df, c, ascending).select(F.col("value").alias(c), F.col("rank").alias(c + suffix))
        out = out.join(t, c, "left")
    return out


# --- A6 / A7 / A8 -------------------------------------------------------------
def target_mean_encode(df: DataFrame, cols, target: str = "target",
                       suffix: str = "_target_mean") -> DataFrame:
    """Plain target encoding: value -> mean target of its group (in-sample)."""
    out = df
    for c in _cols(cols):
        means = df.groupBy(c).agg(F.avg(target).alias(c + suffix)).where(F.col(c).isNotNull())
        out = out.join(broadcast_few(means, c), c, "left")
    return out


def fit_target_encoding(train: DataFrame, col: str, target: str = "target",
                        min_samples_leaf: int = 100, smoothing: float = 10.0,
                        by: Sequence[str] = ()) -> DataFrame:
    """Smoothed target encoding table: (*by, value, encoding, prior).

    s = 1 / (1 + exp(-(n - min_samples_leaf) / smoothing));
    encoding = prior * (1 - s) + mean * s.  ``by`` fits several targets at once on a
    long frame (one prior per ``by`` group).
    """
    by = list(by)
    stats = (train.where(F.col(target).isNotNull())
             .groupBy(*by, F.col(col).alias("value"))
             .agg(F.avg(target).alias("__mean"), F.count(F.lit(1)).alias("__n"),
                  F.sum(target).alias("__sum")))
    if by:
        priors = stats.groupBy(*by).agg((F.sum("__sum") / F.sum("__n")).alias("prior"))
        stats = stats.join(priors, by)
        prior = F.col("prior")
    else:
        prior = train.select(F.avg(target)).scalar()
        stats = stats.withColumn("prior", prior)
        prior = F.col("prior")
    s = 1.0 / (1.0 + F.exp(-(F.col("__n") - F.lit(min_samples_leaf)) / F.lit(float(smoothing))))
    return stats.select(*by, "value", (prior * (1.0 - s) + F.col("__mean") * s).alias("encoding"), "prior")


def apply_target_encoding(df: DataFrame, table: DataFrame, col: str, out_col: str,
                          by: Sequence[str] = (), noise_level: float = 0.0, seed: int = 1337,
                          noise_key: Sequence[str] | None = None, noise_method: str = "xxhash64") -> DataFrame:
    """Left join the fitted table; unseen values get the prior; optional noise (A8) drawn
    per ``noise_key`` (by default, all columns of the row)."""
    by = list(by)
    t = table.select(*by, F.col("value").alias(col), F.col("encoding").alias("__enc"))
    if by:
        priors = table.select(*by, "prior").distinct()
        out = df.join(t, by + [col], "left").join(priors, by, "left")
        prior = F.col("prior")
    else:
        out = df.join(t, [col], "left")
        prior = table.select(F.first("prior")).scalar()
    val = F.coalesce(F.col("__enc"), prior)
    if noise_level:
        val = add_noise(val, noise_level, seed, noise_key or df.columns, noise_method)
    out = out.withColumn(out_col, val).drop("__enc")
    return out.drop("prior") if by else out


def keyed_uniform(seed: int, *key, method: str = "xxhash64") -> Column:
    """A draw from (0, 1) that depends on the seed and the key columns alone, not on the
    partition or the place of the row; ``md5`` takes it from a digest that SQL engines share."""
    if method == "md5":
        text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(_as_column(k).cast("string"), F.lit("")) for k in key])
        return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    h = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *key), 11)
    return (h.cast("double") + 0.5) / float(1 << 53)


def _as_column(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def keyed_normal(seed: int, *key, method: str = "xxhash64") -> Column:
    """A standard normal draw by Box-Muller from two keyed uniform ones."""
    radius = F.sqrt(-2.0 * F.log(keyed_uniform(2 * seed, *key, method=method)))
    return radius * F.cos(2 * math.pi * keyed_uniform(2 * seed + 1, *key, method=method))


def add_noise(c: Column, noise_level: float, seed: int, key: Sequence[str], method: str = "xxhash64") -> Column:
    """x * (1 + level * N(0, 1)); the draw is a function of seed and row key."""
    return c * (1.0 + F.lit(float(noise_level)) * keyed_normal(seed, *key, method=method))


def target_encode(train: DataFrame, test: DataFrame, cols, target: str = "target",
                  min_samples_leaf: int = 100, smoothing: float = 10.0,
                  noise_level: float = 0.0, seed: int = 1337,
                  suffix: str = "_target_encode") -> tuple[DataFrame, DataFrame]:
    tr, te = train, test
    for c in _cols(cols):
        table = fit_target_encoding(train, c, target, min_samples_leaf, smoothing)
        tr = apply_target_encoding(tr, table, c, c + suffix, noise_level=noise_level, seed=seed)
        te = apply_target_encoding(te, table, c, c + suffix, noise_level=noise_level, seed=seed + 1)
    return tr, te


# --- J3 -------------------------------------------------------------------------
def lookup(df: DataFrame, col: str, table: DataFrame, key: str, value: str,
           out_col: str | None = None, keep_missing: bool = False, default=None) -> DataFrame:
    """``Series.map`` (missing -> null or ``default``) / ``replace`` (missing -> old)."""
    t = table.select(F.col(key).alias("__k"), F.col(value).alias("__v"))
    j = df.join(t, df[col] == t["__k"], "left")
    v = F.col("__v")
    if keep_missing:
        v = F.coalesce(v, F.col(col))
    elif default is not None:
        v = F.coalesce(v, F.lit(default))
    return j.withColumn(out_col or col, v).drop("__k", "__v")


# --- A9 -------------------------------------------------------------------------
def polynomial_features(df: DataFrame, cols: Sequence[str], prefix: str = "poly_",
                        keep: Sequence[str] = ()) -> DataFrame:
    """Degree-2 expansion with bias in the usual order: 1, x_i, then x_i*x_j (i <= j)."""
    cols = list(cols)
    terms = [F.lit(1.0)] + [F.col(c).cast("double") for c in cols]
    for i, j in itertools.combinations_with_replacement(range(len(cols)), 2):
        terms.append(F.col(cols[i]).cast("double") * F.col(cols[j]).cast("double"))
    return df.select(*keep, *[t.alias(f"{prefix}{k}") for k, t in enumerate(terms)])


def polynomial_encode(df: DataFrame, categorical: Sequence[str], numeric: Sequence[str] = (),
                      keep: Sequence[str] = ()) -> DataFrame:
    enc = label_encode(df, categorical)
    return polynomial_features(enc, list(categorical) + list(numeric), keep=keep)


# --- A10 ------------------------------------------------------------------------
def nan_encode(df: DataFrame, cols: Iterable[str] | None = None) -> DataFrame:
    """Columns holding any null become 0/1 null indicators (one aggregate picks them)."""
    from .numeric import _known
    cols = list(cols) if cols is not None else df.columns
    gone = {c: _known(df, c).isNull() for c in cols}         # NaN is missing too
    row = df.select(*[F.count_if(gone[c]).alias(c) for c in cols]).first()
    with_nulls = [c for c in cols if row[c] > 0]
    return df.select(*[gone[c].cast("int").alias(c) if c in with_nulls else F.col(c)
                       for c in df.columns])


# --- A11 ------------------------------------------------------------------------
def polar_coords(df: DataFrame, col: str, normalize: bool = True,
                 angle_unit: str = "radian_as_is") -> DataFrame:
    """Frequency rank -> angle on [0, 360] in steps of 360/max(col); sin and cos.

    ``angle_unit='radian_as_is'`` feeds the degree value to sin/cos unchanged (as the
    reference does, quirk Q13); ``'degree'`` converts first.  Ranks above max(col)
    get no angle.  With ``normalize`` both columns are min-max scaled; a constant one
    becomes 0.
    """
    max_val = df.select(F.max(col)).scalar()
    ranks = fit_labelcount(df, col).where(F.col("value").isNotNull()).select(F.col("value").alias(col), F.col("rank").alias("__r"))
    angle = F.when(F.col("__r") <= max_val, F.try_divide(F.col("__r") * F.lit(360.0), max_val))
    if angle_unit == "degree":
        angle = F.radians(angle)
    made = ranks.select(col, F.sin(angle).alias(f"{col}_sin"), F.cos(angle).alias(f"{col}_cos"))
    if normalize:
        # every value of the table has a row, so the extremes of the table are those of the rows
        names = [f"{col}_sin", f"{col}_cos"]
        ends = made.agg(F.struct(*[f(c).alias(f"{f.__name__}{k}") for k, c in enumerate(names) for f in (F.min, F.max)])).scalar()
        for k, c in enumerate(names):
            lo, width = ends[f"min{k}"], ends[f"max{k}"] - ends[f"min{k}"]
            made = made.withColumn(c, F.when(F.col(c).isNotNull(), F.coalesce(F.try_divide(F.col(c) - lo, width), F.lit(0.0))))
    return df.join(made, col, "left")


# --- A14 ------------------------------------------------------------------------
def value_counts(df: DataFrame, col: str, name: str = "count") -> DataFrame:
    """Frequency table; sort it only when presenting (orderBy on the small result)."""
    return df.groupBy(col).agg(F.count(F.lit(1)).cast("bigint").alias(name))


# --- A15 ------------------------------------------------------------------------
def customer_features(df: DataFrame, id_col: str = "customer_id", index_col: str | None = None,
                      order_col: str | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """id / max(id) (null when that is 0), id / (row index + 1e-14), id frequency, first
    1/2/3/4/6 digits.

    The row index is an explicit column (``index_col``) or the 0-based position in
    ``order_col`` order, computed without a single-partition window.
    """
    base = df
    if index_col is None:
        if order_col is None:
            raise ValueError("give index_col or order_col")
        # only the order column is ranked (it is a key); the rows meet their index by a join
        index = global_index(df.select(order_col), [F.col(order_col).asc()], name="__idx")
        base = df.join(index, order_col)
        index_col = "__idx"
    mx = df.select(F.max(id_col)).scalar()
    freq = df.groupBy(id_col).agg(F.count(F.lit(1)).cast("bigint").alias("customer_count"))
    s = F.col(id_col).cast("string")
    out = base.join(freq, id_col, "left").select(
        *keep,
        F.try_divide(F.col(id_col), mx).alias("customer_max_ratio"),
        F.try_divide(F.col(id_col), F.col(index_col) + F.lit(1e-14)).alias("index_max_ratio"),
        "customer_count",
        *[F.substring(s, 1, k).cast("bigint").alias(n)
          for k, n in ((1, "cust_first"), (2, "cust_2first"), (3, "cust_3first"),
                       (4, "cust_4first"), (6, "cust_6first"))])
    return out


# --- A2 -------------------------------------------------------------------------
def _md5_mod(c: Column, n: int) -> Column:
    """int(md5_hex(str(c)), 16) mod n, from the two 64-bit halves of the digest."""
    h = F.md5(c.cast("string"))
    hi = F.conv(F.substring(h, 1, 16), 16, 10).cast("decimal(20,0)")
    lo = F.conv(F.substring(h, 17, 16), 16, 10).cast("decimal(20,0)")
    two64 = (1 << 64) % n
    return F.pmod(F.pmod(hi, F.lit(n)) * F.lit(two64) + F.pmod(lo, F.lit(n)), F.lit(n)).cast("int")


def hash_encode(df: DataFrame, cols: Sequence[str], n_components: int | None = None,
                keep: Sequence[str] = (), prefix: str = "col_") -> DataFrame:
    """md5 hashing encoder: per row, count of categorical values falling in each of
    ``n_components`` buckets (default: number of columns)."""
    cols = list(cols)
    n = n_components or len(cols)
    buckets = [_md5_mod(F.col(c), n) for c in cols]
    return df.select(*keep, *[sum(((b == k).cast("bigint") for b in buckets), F.lit(0).cast("bigint"))
                              .alias(f"{prefix}{k}") for k in range(n)])


def signed_hash_features(df: DataFrame, cols: Sequence[str], n_features: int, keep: Sequence[str] = (),
                         out_col: str = "hashed") -> DataFrame:   # A3
    """Feature hashing with alternating signs: every ``column=value`` adds +1 or -1 (by a
    further digit of its md5) at one of ``n_features`` places; null values add nothing."""
    tokens = [F.concat(F.lit(c + "="), F.col(c).cast("string")) for c in cols]
    place = [_md5_mod(t, n_features) for t in tokens]
    sign = [F.when(F.substring(F.md5(t), 32, 1) >= "8", F.lit(-1.0)).otherwise(F.lit(1.0)) for t in tokens]
    at = lambda k: sum((F.when(p == k, s).otherwise(F.lit(0.0)) for p, s in zip(place, sign)), F.lit(0.0))
    return df.select(*keep, F.array(*[at(k) for k in range(n_features)]).alias(out_col))
