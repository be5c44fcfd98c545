"""Centroid clustering: Lloyd rounds on integer vectors, the nearest centroid found by the
threshold algorithm.

Every dimension has the list of the centroids sorted by their value there.  From a vector's
value each list is walked outward, nearest first; a centroid seen for the first time gets
its exact distance.  An unseen centroid is, in every dimension, at least as far as the
last one walked to, so once the sum of these squared frontier distances strictly exceeds
the best exact distance no unseen centroid can be nearer or equal, and the walk stops.  Ties
go to the smaller number.

Centroids are ``k x dims`` integers, both parameters; only they are sent to the tasks, and
only ``k`` sums per task come back, added up by Spark.

Defined results: vectors with another number of components, a null or non-finite one, or
null are left out; a component ``x`` becomes ``floor(scale * x)``.  The first centroids are
the vectors with the least hashes, equal hashes (repeated ids) by their components; with
fewer than ``k`` vectors there are as many centroids; an empty table gives no row; repeated rows
each get theirs.  Distances are exact while a scaled component stays under 2**27 in
size (64 dimensions); beyond, the run ends with an error instead of a wrong distance.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, col, stored

K = 16
DIMS = 64
SCALE = 64
ROUNDS = 3
SEED = 1
CELLS = 1 << 18                                      # of a chunk's pointers and pairs


class Lists:
    """The sorted lists of one set of centroids."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids                   # k x dims, int64
        self.order = np.argsort(centroids, axis=0, kind="stable").T.copy()
        self.values = np.take_along_axis(centroids.T, self.order, axis=1)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and squared distance of the nearest centroid of each row."""
        step = max(1, CELLS // max(x.shape[1], 1))
        parts = [self._walk(x[a:a + step]) for a in range(0, len(x), step)]
        if not parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def _walk(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, dims = x.shape
        k = len(self.centroids)
        far = np.int64(2**62)
        best, who = np.full(n, far), np.full(n, k, np.int64)
        seen = np.zeros((n, k), bool)
        # the next entry above each value; the one below it is up - 1
        up = np.stack([np.searchsorted(self.values[d], x[:, d]) for d in range(dims)], axis=1)
        down = up - 1
        live = np.arange(n)
        at = np.arange(dims)
        while len(live):
            v, u, w = x[live], up[live], down[live]
            above = np.where(u < k, self.values[at, np.minimum(u, k - 1)] - v, far)
            below = np.where(w >= 0, v - self.values[at, np.maximum(w, 0)], far)
            lower = below <= above
            gap = np.where(lower, below, above)
            out = gap == far                         # a list walked to its end: every centroid is seen
            met = np.where(lower, self.order[at, np.maximum(w, 0)], self.order[at, np.minimum(u, k - 1)])
            up[live] = u + (~lower & ~out)
            down[live] = w - (lower & ~out)
            new = np.zeros((len(live), k), bool)
            new[np.repeat(np.arange(len(live)), dims)[~out.ravel()], met.ravel()[~out.ravel()]] = True
            new &= ~seen[live]
            seen[live] |= new
            row, cent = np.nonzero(new)              # by row, centroids ascending
            for a in range(0, len(row), max(1, CELLS // dims)):
                r, c = row[a:a + CELLS // dims], cent[a:a + CELLS // dims]
                d = ((v[r] - self.centroids[c]) ** 2).sum(axis=1)
                # the least (distance, number) of each row in this slice against the row's best
                o = np.lexsort((c, d, r))
                first = o[np.r_[True, r[o][1:] != r[o][:-1]]]
                g, d, c = live[r[first]], d[first], c[first]
                better = (d < best[g]) | ((d == best[g]) & (c < who[g]))
                best[g[better]], who[g[better]] = d[better], c[better]
            frontier = np.where(out, 0, gap)
            done = out.any(axis=1) | ((frontier ** 2).sum(axis=1) > best[live])
            live = live[~done]
        return who, best


def _scaled(vectors: pa.Array, dims: int, scale: float) -> np.ndarray:
    flat = vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
    x = np.floor(flat * scale)
    if len(x) and np.abs(x).max() >= 2**27 * (64 / max(dims, 64)) ** 0.5:
        raise ValueError("a scaled component is too large for exact distances; use a smaller scale")
    return x.astype(np.int64)


def usable(vector: Column, dims: int) -> Column:
    good = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) == dims) & good, F.lit(False))


def kept(vectors: DataFrame, id_col: str, vector_col: str, dims: int) -> DataFrame:
    v = vectors.select(col(id_col).alias("vec_id"), col(vector_col).cast("array<double>").alias("v"))
    return v.where(usable(F.col("v"), dims))


def first_centroids(vectors: DataFrame, k: int, scale: float, seed: int) -> np.ndarray:
    """The ``k`` vectors with the least hashes of ``seed:vec_id``, in their order."""
    ints = F.transform("v", lambda x: F.floor(x * F.lit(float(scale))))
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = vectors.select(h.alias("h"), ints.alias("c")).orderBy("h", "c").limit(k).collect()
    return np.array([r["c"] for r in rows], np.int64)


def _sums(vectors: DataFrame, centroids: np.ndarray, dims: int, scale: float) -> DataFrame:
    """cluster, n, s (sums of its components), one row per cluster and task before Spark adds
    them up position by position."""
    k = len(centroids)

    def run(batches):
        lists = Lists(centroids)
        n, s = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for b in batches:
            x = _scaled(b.column(0), dims, scale)
            who, _ = lists.nearest(x)
            n += np.bincount(who, minlength=k)
            np.add.at(s, who, x)
        have = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(have, dims), pa.int64()), pa.array(np.tile(np.arange(dims), len(have)), pa.int32()),
             pa.array(np.repeat(n[have], dims), pa.int64()), pa.array(s[have].ravel(), pa.int64())], names=["cluster", "dim", "n", "s"])

    parts = vectors.select("v").mapInArrow(run, "cluster long, dim int, n long, s long")
    return parts.groupBy("cluster", "dim").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))


def lloyd(vectors: DataFrame, k: int = K, dims: int = DIMS, scale: float = SCALE, rounds: int = ROUNDS, seed: int = SEED) -> np.ndarray:
    """The centroids after ``rounds`` rounds; an empty one stays where it is."""
    c = first_centroids(vectors, k, scale, seed)
    for _ in range(rounds if len(c) else 0):
        new = c.copy()
        for r in _sums(vectors, c, dims, scale).collect():   # k x dims numbers
            new[r["cluster"], r["dim"]] = int(r["s"]) // r["n"]
        c = new
    return c


def assign(vectors: DataFrame, centroids: np.ndarray, dims: int, scale: float) -> DataFrame:
    """vec_id, cluster, distance of every kept vector."""
    kind = vectors.schema["vec_id"].dataType.simpleString()

    def run(batches):
        lists = Lists(centroids)
        for b in batches:
            who, d = lists.nearest(_scaled(b.column(1), dims, scale))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(who.astype(np.int32)), pa.array(d)], names=["vec_id", "cluster", "distance"])

    return vectors.select("vec_id", "v").mapInArrow(run, f"vec_id {kind}, cluster int, distance long")


def cluster(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, dims: int = DIMS,
            scale: float = SCALE, rounds: int = ROUNDS, seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance per kept vector, cluster_inertia, inertia, centroid_sha256;
    the final centroids)."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    src = kept(vectors, id_col, vector_col, dims)
    c = lloyd(src, k, dims, scale, rounds, seed)
    if not len(c):
        none = src.select("vec_id", F.lit(0).alias("cluster"), *[F.lit(0).cast("long").alias(x) for x in ("distance", "cluster_inertia", "inertia")],
                          F.lit("").alias("centroid_sha256")).where(F.lit(False))
        return none, c
    found = stored(assign(src, c, dims, scale))
    sums = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()   # k rows
    total = sum(int(r["s"]) for r in sums)
    facts = spark.createDataFrame(
        [(int(r["cluster"]), int(r["s"]), total, hashlib.sha256(",".join(map(str, c[r["cluster"]])).encode()).hexdigest()) for r in sums],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"), c
