"""Exact k-nearest imputation without comparing all rows.

The distance of two rows is the mean squared difference over the columns both know.  A
missing value becomes the mean of the column over the k nearest rows that know it (and all
others as near as the k-th), weighted by ``1 / max(distance, LEAST)``.

Equal rows are one vector with a count.  Vectors are dealt to the cells of sampled
pivots, a cell to blocks of about ``block`` vectors.  A vector with a missing value first meets
one block of its own cell, which bounds its k-th distance from above.  The box of a
cell's vectors of one pattern of known columns bounds the distances to them from below
in any set of shared columns, so only cells whose box is not farther than that bound are
searched, and the result is exact.  Only the pivots and the boxes (``pivots`` times the patterns)
go through the driver; blocks of vectors and slices of queries meet by a shuffle.
"""
from __future__ import annotations

import math
from typing import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import reliable_checkpoint
from .numeric import _known

LEAST = 1e-6
FAR = float("inf")
CELLS_AT_ONCE = 200_000       # distances of a slice of rows to all pivots or boxes


def _matrix(column) -> np.ndarray:
    """Rows of a list column, NaN for null."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return x.reshape(len(flat), -1) if len(flat) else np.zeros((0, 1))


def _gaps(q: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Mean squared distance of every row of ``q`` to every box, over the columns both know
    (inf where there is none); a box is a vector when lo is hi."""
    total, shared = np.zeros((len(q), len(lo))), np.zeros((len(q), len(lo)))
    for c in range(q.shape[1]):
        x = q[:, c:c + 1]
        both = ~np.isnan(x) & ~np.isnan(lo[:, c])
        gap = np.maximum(np.maximum(lo[:, c] - x, x - hi[:, c]), 0)
        total += np.where(both, gap * gap, 0)
        shared += both
    return np.where(shared > 0, total / np.maximum(shared, 1), FAR)


def _pattern(x: np.ndarray) -> np.ndarray:
    return (~np.isnan(x)) @ (1 << np.arange(x.shape[1]))


def _slices(x: np.ndarray, others: int):
    """First row and rows of slices that meet ``others`` rows in bounded memory."""
    size = max(1, CELLS_AT_ONCE // max(others, 1))
    return [(a, x[a:a + size]) for a in range(0, max(len(x), 1), size)]


def _cells(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The nearest pivot of every row; rows known in all columns look at such pivots alone, by
    one product (which cell a row is in does not change the result)."""
    cell = np.zeros(len(x), np.int64)
    whole, known = np.flatnonzero(~np.isnan(pivots).any(axis=1)), ~np.isnan(x).any(axis=1)
    if len(whole):
        p = pivots[whole]
        cell[known] = np.concatenate([whole[((p * p).sum(axis=1) - 2 * (q @ p.T)).argmin(axis=1)] for _, q in _slices(x[known], len(p))])
        x = x[~known]
    rest = [_gaps(q, pivots, pivots).argmin(axis=1) for _, q in _slices(x, len(pivots))]
    cell[~known if len(whole) else slice(None)] = np.concatenate(rest)
    return cell


def _with_cells(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """x, n, pattern (bits of the known columns), cell."""
    def run(batches):
        for b in batches:
            x = _matrix(b.column(0))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(_pattern(x).astype(np.int64)), pa.array(_cells(x, pivots).astype(np.int32))],
                                             names=["x", "n", "pattern", "cell"])
    return vectors.select("x", "n").mapInArrow(run, "x array<double>, n long, pattern long, cell int")


def _meet(vectors: pa.Table, queries: pa.Table, k: int) -> pa.Table:
    """For each query and missing column the nearest distances in this block until k rows
    are counted: qid, col, d, s (sum of the column's values), n."""
    out: list[tuple] = []
    if vectors.num_rows and queries.num_rows:
        x, n = _matrix(vectors.column("x")), vectors.column("n").to_numpy()
        q, qid = _matrix(queries.column("x")), queries.column("qid").to_numpy()
        d = _gaps(q, x, x)
        for c in range(q.shape[1]):
            know = np.flatnonzero(~np.isnan(x[:, c]))
            for i in np.flatnonzero(np.isnan(q[:, c])):
                di = d[i, know]
                if len(know) > k:
                    di_k = np.partition(di, k - 1)[k - 1]
                    near = know[di <= di_k]
                else:
                    near = know
                near = near[d[i, near] < FAR]
                dist, inverse = np.unique(d[i, near], return_inverse=True)
                count = np.bincount(inverse, weights=n[near], minlength=len(dist))
                value = np.bincount(inverse, weights=n[near] * x[near, c], minlength=len(dist))
                upto = int(np.searchsorted(np.cumsum(count), k)) + 1
                out += zip([qid[i]] * upto, [c] * upto, dist[:upto], value[:upto], count[:upto].astype(np.int64))
    cols = list(zip(*out)) or [[]] * 5
    kinds = [pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.int64()]
    return pa.Table.from_arrays([pa.array(list(v), t) for v, t in zip(cols, kinds)], names=["qid", "col", "d", "s", "n"])


def _searched(blocks: DataFrame, pairs: DataFrame, k: int, block: int) -> DataFrame:
    """The rows of ``_meet`` for all (qid, x, cell, blk) of ``pairs``; queries of one block
    come in slices of about ``block``, its vectors once for each."""
    slices = pairs.groupBy("cell", "blk").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("slices"))
    p = pairs.join(slices, ["cell", "blk"]).withColumn("slice", F.pmod(F.xxhash64("qid"), F.col("slices")).cast("int"))
    v = blocks.join(slices, ["cell", "blk"]).withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    v = v.select(F.col("cell").alias("c"), F.col("blk").alias("b"), F.col("slice").alias("z"), "x", "n")
    return v.groupBy("c", "b", "z").cogroup(p.select("cell", "blk", "slice", "qid", "x").groupBy("cell", "blk", "slice")).applyInArrow(
        lambda a, b: _meet(a, b, k), "qid long, col int, d double, s double, n long")


def _kept(rows: DataFrame, k: int) -> DataFrame:
    """Per (qid, col) its distances until k rows are counted, equal ones added up; a query has
    at most k rows from each block it met."""
    added = rows.groupBy("qid", "col", "d").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("qid", "col").orderBy("d").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return added.withColumn("before", before).where(F.col("before") < k)


def impute_knn(df: DataFrame, cols: Sequence[str], k: int = 5, pivots: int = 64, block: int = 2048) -> DataFrame:   # N4
    """``df`` with the missing values (null or NaN) of ``cols`` imputed, as doubles, by at least
    ``pivots`` cells and as many as the square root of the vectors.  A value stays
    null where no row that knows the column shares a known column with its row."""
    x = F.array(*[_known(df, c).cast("double") for c in cols])
    rows = df.withColumn("__x", x)
    vectors = reliable_checkpoint(rows.groupBy(F.col("__x").alias("x")).agg(F.count(F.lit(1)).alias("n")))
    # cells shrink as the vectors grow in number: by the square root, as pivots and cells both cost
    pivots = max(pivots, math.isqrt(vectors.count()))
    picked = vectors.orderBy(F.xxhash64("x"), "x").limit(pivots).collect()      # ``pivots`` rows
    if not picked:
        return rows.select(*[F.col("__x")[list(cols).index(c)].alias(c) if c in cols else F.col(c) for c in df.columns])
    p = np.array([[np.nan if v is None else v for v in r["x"]] for r in picked], np.float64)
    dealt = reliable_checkpoint(_with_cells(vectors, p))
    sizes = dealt.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blks"))
    blocks = dealt.join(F.broadcast(sizes), "cell").withColumn("blk", F.pmod(F.xxhash64("x"), F.col("blks")).cast("int"))
    some = F.exists("x", lambda v: v.isNull())
    queries = reliable_checkpoint(dealt.where(some).withColumn("qid", F.monotonically_increasing_id()))

    own = queries.join(F.broadcast(sizes), "cell").select("qid", "x", "cell", F.pmod(F.xxhash64("x"), F.col("blks")).cast("int").alias("blk"))
    bound = _kept(_searched(blocks, own, k, block), k).groupBy("qid", "col").agg(F.max("d").alias("d"), F.sum("n").alias("n"))
    bound = bound.select("qid", "col", F.when(F.col("n") >= k, F.col("d")).alias("d"))
    # a query goes wherever one of its columns may find a nearer row: bounded by the largest
    bound = bound.groupBy("qid").agg(F.max(F.coalesce("d", F.lit(FAR))).alias("d"), F.count(F.lit(1)).alias("found"))
    wanted = F.aggregate("x", F.lit(0), lambda a, v: a + F.when(v.isNull(), 1).otherwise(0))
    reach = queries.join(bound, "qid", "left").select("qid", "x", F.when(F.col("found") == wanted, F.col("d")).otherwise(F.lit(FAR)).alias("u"))

    dims = len(cols)
    boxes = dealt.groupBy("cell", "pattern").agg(*[f(F.col("x")[c]).alias(f"{f.__name__}{c}") for c in range(dims) for f in (F.min, F.max)]).collect()
    lo = np.array([[np.nan if b[f"min{c}"] is None else b[f"min{c}"] for c in range(dims)] for b in boxes], np.float64)
    hi = np.array([[np.nan if b[f"max{c}"] is None else b[f"max{c}"] for c in range(dims)] for b in boxes], np.float64)
    cell = np.array([b["cell"] for b in boxes], np.int32)

    def near(batches):
        for b in batches:
            u = b.column(2).to_numpy()
            pair = [np.zeros((0, 2), np.int64)]
            for a, q in _slices(_matrix(b.column(1)), len(lo)):
                d = _gaps(q, lo, hi)
                # a little room: box and row distances are rounded sums
                i, j = np.nonzero((d <= u[a:a + len(q), None] * (1 + 1e-9)) & (d < FAR))
                if len(i):
                    pair.append(np.unique(np.c_[a + i, cell[j]], axis=0))
            pair = np.concatenate(pair)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(pair[:, 0])), b.column(1).take(pa.array(pair[:, 0])), pa.array(pair[:, 1].astype(np.int32))],
                                             names=["qid", "x", "cell"])

    pairs = reach.mapInArrow(near, "qid long, x array<double>, cell int").join(F.broadcast(sizes), "cell")
    pairs = pairs.withColumn("blk", F.explode(F.sequence(F.lit(0), F.col("blks") - 1))).drop("blks")
    best = _kept(_searched(blocks, reliable_checkpoint(pairs), k, block), k)
    w = 1.0 / F.greatest(F.col("d"), F.lit(LEAST))
    values = best.groupBy("qid", "col").agg((F.sum(w * F.col("s")) / F.sum(w * F.col("n"))).alias("v"))
    found = values.groupBy("qid").agg(F.map_from_entries(F.collect_list(F.struct("col", "v"))).alias("__v"))
    filled = queries.select("qid", F.col("x").alias("__x")).join(found, "qid").drop("qid")
    out = rows.join(filled, "__x", "left")
    value = lambda i: F.coalesce(F.col("__x")[i], F.try_element_at("__v", F.lit(i)))
    return out.select(*[value(list(cols).index(c)).alias(c) if c in cols else F.col(c) for c in df.columns])
