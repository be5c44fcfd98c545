"""N-gram Jaccard join by chosen paths.

Sets: hashes of the runs of five consecutive words of a text (all its words, if fewer).
Documents with equal sets are one class; the join works on one set per class.

Each run grows a tree of paths for every set: a node chooses the tokens whose hash, seeded
with the node's path, lies under ``1 / (SIMILARITY * set size)`` (the least one if there is
none), so sets that share most tokens choose shared ones.  Sets with one path are a
bucket; one of more than ``SMALL`` sets is split by the paths of the next level.  Buckets are brute-forced on sketches, large ones of the last level in pairs of
blocks, and give the edges of a spanning forest, never all pairs.  The number of runs
follows from the target recall.

The edges give candidate groups.  Every group is verified on its whole sets: all pairs
are compared in blocks inside the tasks, exactly (``9 |x & y| >= 4 (|x| + |y|)``, Jaccard
0.8), and only a count of links per set and spanning edges leave the task.  The
verified edges give the classes, found by alternating star contraction on stored tables.

Defined results: a null text is empty; texts without words have equal (empty) sets and
form one class; rows equal in id and text are two documents of one class; a class is
named after its least id (null after all others); no row is dropped; an empty table gives none.
"""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, checked_broadcast, col, row_hash, stored, words

SHINGLE = 5
SIMILARITY = 0.8
RECALL = 0.995
SMALL = 64                                           # a bucket of so many sets is compared as it is
BLOCK = 2048                                         # sets of a block
BLOCK_TOKENS = 8 << 20                               # and their tokens: 64 MB
RANGE = 2 << 20                                      # tokens of the sets of two blocks compared at once
ROUNDS = 1000                                        # of a component search; more is an error
BINS = 128                                           # of a sketch
CELLS = 4 << 20                                      # of the dense part of a set matrix

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def runs_for(recall: float) -> int:
    """A pair at the threshold meets at the last of two levels with chance of about 0.45."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - 0.45)))


def shingles(h: np.ndarray) -> np.ndarray:
    """Sorted distinct hashes of the word runs of a text, from its word hashes."""
    h = h.view(np.uint64)
    if len(h) == 0:
        return h
    k = min(SHINGLE, len(h))
    x = np.zeros(len(h) - k + 1, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            x = _mix(x * np.uint64(0x9E3779B97F4A7C15) + h[j:j + len(x)])
    return np.unique(x)


def sketch(u: np.ndarray) -> bytes:
    """One byte for each of ``BINS`` ranges of the token hashes: that of the least token
    in the range, 0 for none."""
    out = np.zeros(BINS, np.uint8)
    if len(u):
        bins = (u >> np.uint64(57)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, bins[1:] != bins[:-1]])
        out[bins[first]] = (_mix(u[first]) % np.uint64(255)).astype(np.uint8) + 1
    return out.tobytes()


def paths(u: np.ndarray, runs: int) -> list[tuple[int, int]]:
    """(path of one token, path of two tokens) for each leaf of each run."""
    if not len(u):
        return []
    out = []
    under = np.uint64(min(1.0, 1 / (SIMILARITY * len(u))) * (2**64 - 2**12))

    def chosen(seed: int) -> np.ndarray:
        h = _mix(u ^ np.uint64(seed))
        c = u[h < under]
        return c if len(c) else u[[int(np.argmin(h))]]

    with np.errstate(over="ignore"):
        for r in range(runs):
            seed = int(_mix(np.array([r * 2 + 1], np.uint64))[0])
            for p1 in _mix(chosen(seed) * _M2 + np.uint64(seed)):
                for p2 in _mix(chosen(int(p1)) * _M1 + p1):
                    out.append((int(p1), int(p2)))
    return out


def signature(u: np.ndarray) -> tuple[int, int]:
    """128 bits of a set."""
    with np.errstate(over="ignore"):
        a = _mix(np.array([np.bitwise_xor.reduce(_mix(u + np.uint64(7))) if len(u) else 0], np.uint64) + np.uint64(len(u)))
        b = _mix(np.array([np.add.reduce(_mix(u ^ np.uint64(0x5851F42D4C957F2D))) if len(u) else 0], np.uint64))
    return int(a.view(np.int64)[0]), int(b.view(np.int64)[0])


def _sets(batch_column) -> list[np.ndarray]:
    """The sets of an Arrow column of word hash lists."""
    flat = batch_column.flatten().to_numpy(zero_copy_only=False)
    ends = np.cumsum(np.asarray(batch_column.value_lengths().to_pylist(), np.int64)) if len(batch_column) else []
    out, at = [], 0
    for end in ends:
        out.append(shingles(flat[at:end]))
        at = end
    return out


def described(docs: DataFrame, id_col: str, text_col: str, runs: int) -> DataFrame:
    """doc_id, th, s1, s2, n, sketch, paths for every row."""
    src = docs.select(col(id_col).alias("doc_id"), row_hash(col(text_col)).alias("th"),
                      F.transform(words(col(text_col).cast("string")), lambda x: F.xxhash64(x)).alias("h"))

    def run(batches):
        for b in batches:
            sets = _sets(b.column(2))
            sigs = [signature(u) for u in sets]
            leaves = [np.array(paths(u, runs), np.uint64).reshape(-1, 2).view(np.int64) for u in sets]
            offsets = pa.array(np.r_[0, np.cumsum([len(x) for x in leaves])].astype(np.int32))
            flat = np.concatenate(leaves) if leaves else np.zeros((0, 2), np.int64)
            pairs = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, 0])), pa.array(np.ascontiguousarray(flat[:, 1]))], names=["p1", "p2"])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([s[0] for s in sigs], pa.int64()), pa.array([s[1] for s in sigs], pa.int64()),
                 pa.array([len(u) for u in sets], pa.int32()), pa.array([sketch(u) for u in sets], pa.binary()),
                 pa.ListArray.from_arrays(offsets, pairs)],
                names=["doc_id", "th", "s1", "s2", "n", "sketch", "paths"])

    kind = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(run, f"doc_id {kind}, th bigint, s1 bigint, s2 bigint, n int, sketch binary, paths array<struct<p1:bigint,p2:bigint>>")


def _groups(batches, keys: int):
    """Arrow batches sorted by their first ``keys`` columns -> (key, rows) one group at a
    time; a group may span batches."""
    key, held = None, []
    for b in batches:
        if not b.num_rows:
            continue
        cols = [c.to_numpy(zero_copy_only=False) for c in b.columns[:keys]]
        change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
        for a, z in zip(np.r_[0, change], np.r_[change, b.num_rows]):
            k = tuple(c[a] for c in cols)
            if k != key and held:
                yield key, pa.Table.from_batches(held)
                held = []
            key = k
            held.append(b.slice(a, z - a))
    if held:
        yield key, pa.Table.from_batches(held)


def _spanning(n: int, near) -> list[tuple[int, int]]:
    """Edges of a spanning forest over 0..n-1; ``near(i, rest)`` says which of ``rest``
    are linked to i."""
    rest, out = np.arange(n), []
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            i = queue.pop()
            hit = near(i, rest)
            out += [(i, j) for j in rest[hit]]
            queue += list(rest[hit])
            rest = rest[~hit]
    return out


def sketch_edges(batches):
    """Buckets of (bucket, bi, bj, rid, sketch) -> spanning edges of sets whose sketches
    agree well enough to be worth comparing (four deviations under the threshold)."""
    for _, t in _groups(batches, 3):
        rid = t.column(3).to_numpy()
        s = np.frombuffer(b"".join(t.column(4).to_pylist()), np.uint8).reshape(len(rid), BINS)

        def near(i, rest, s=s):
            other = s[rest]
            some = ((other | s[i]) != 0).sum(axis=1)
            same = ((other == s[i]) & (other != 0)).sum(axis=1)
            some = np.maximum(some, 1)
            return same / some >= SIMILARITY - np.maximum(4 * np.sqrt(0.16 / some), 0.02)

        edges = _spanning(len(rid), near)
        if edges:
            e = np.array(edges)
            yield pa.RecordBatch.from_arrays([pa.array(rid[e[:, 0]]), pa.array(rid[e[:, 1]])], names=["u", "v"])


def _intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, summed over ranges of the token hashes of about
    ``RANGE`` tokens each."""
    ranges = max(1, sum(map(len, sets)) // RANGE)
    if ranges == 1:
        return _shared(sets)
    ends = [np.searchsorted(u, np.arange(1, ranges, dtype=np.uint64) * np.uint64(2**64 // ranges)) for u in sets]
    cuts = [np.r_[0, e, len(u)] for e, u in zip(ends, sets)]
    return sum(_shared([u[c[r]:c[r + 1]] for u, c in zip(sets, cuts)]) for r in range(ranges))


def _shared(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections; tokens of one set only are left out, the dense matrix
    of the others is made in slices of at most ``CELLS`` cells."""
    owner = np.repeat(np.arange(len(sets)), [len(u) for u in sets])
    tokens, inverse, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    keep = df[inverse] > 1
    owner, inverse = owner[keep], inverse[keep]
    renumber = np.cumsum(df > 1) - 1
    at = renumber[inverse]
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    n, v = len(sets), int((df > 1).sum())
    out = np.zeros((n, n), np.float32)
    wide = max(1, CELLS // n)
    for a in range(0, v, wide):
        lo, hi = np.searchsorted(at, (a, a + wide))
        m = np.zeros((n, min(wide, v - a)), np.float32)
        m[owner[lo:hi], at[lo:hi] - a] = 1
        out += m @ m.T
    return out


def verify(batches):
    """Groups of (comp, bi, bj, rid, block, weight, tokens) -> per set: its links in this
    group, weighted, and the set that stands for its connected part of the group."""
    for (_, bi, bj), t in _groups(batches, 3):
        rid, block = t.column(3).to_numpy(), t.column(4).to_numpy()
        _, first = np.unique(rid, return_index=True)  # rows equal in id and text come twice
        rid, block = rid[first], block[first]
        weight = t.column(5).to_numpy()[first].astype(np.float64)
        raw = t.column(6)
        sets = [np.frombuffer(raw[int(k)].as_py(), np.uint64) for k in first]
        size = np.array([len(u) for u in sets], np.float32)
        linked = 9 * _intersections(sets) >= 4 * (size[:, None] + size[None, :])
        np.fill_diagonal(linked, False)
        if bi != bj:
            linked &= block[:, None] != block[None, :]
        links = linked @ weight
        root = np.arange(len(rid))
        for i, j in _spanning(len(rid), lambda i, rest, linked=linked: linked[i][rest]):
            root[j] = root[i]
        yield pa.RecordBatch.from_arrays([pa.array(rid), pa.array(links.astype(np.int64)), pa.array(rid[root])],
                                         names=["rid", "links", "root"])


def components(edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """node, comp (its least node) of every node of an edge list (u, v), by alternating
    large-star and small-star steps until nothing changes; each round is a stored table.
    The steps needed grow with the logarithm of the nodes; past ``rounds`` of them it raises."""
    e = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    before = None
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = stored(large)
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        e = stored(small.unionByName(small_least.select("u", F.col("m").alias("v"))).distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components not stable after {rounds} rounds")
    stars = e.groupBy("u").agg(F.min("v").alias("comp")).select(F.col("u").alias("node"), "comp")
    return stored(stars.unionByName(stars.select(F.col("comp").alias("node"), "comp")).distinct())


def _blocked(rows: DataFrame, group: str, blocks, keep: list[str]) -> DataFrame:
    """``rows`` with (group, bi, bj), a group dealt into ``blocks`` (a column): each pair of
    blocks of a group meets in one place."""
    r = rows.withColumn("nb", blocks.cast("int")).withColumn("block", F.pmod(F.xxhash64("rid"), F.col("nb")).cast("int"))
    r = r.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    r = r.select(group, F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"), "rid", *keep)
    return r.repartition(group, "bi", "bj").sortWithinPartitions(group, "bi", "bj", "rid")


def similar_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", recall: float = RECALL) -> DataFrame:
    """doc_id, th, class_id, class_th (text hash of the document that names the class) and
    n_links (documents at 0.8 or more, copies included) per row."""
    spark = docs.sparkSession
    bounded_batches(spark)
    all_rows = stored(described(docs, id_col, text_col, runs_for(recall)))
    reps = stored(all_rows.groupBy("s1", "s2").agg(
        F.count("*").alias("weight"), F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th")).alias("pick"),
        F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("paths").alias("paths"))
        .withColumn("rid", F.monotonically_increasing_id()))

    # buckets: a path of one token, of two where the first is shared by too many
    leaves = reps.select("rid", F.explode("paths").alias("p")).select("rid", "p.p1", "p.p2")
    n1 = stored(leaves.select("p1", "rid").distinct().groupBy("p1").agg(F.count("*").alias("size")).where("size > 1"))
    rows = leaves.join(n1, "p1").select("rid", F.when(F.col("size") <= SMALL, F.col("p1")).otherwise(F.col("p2")).alias("bucket")).distinct()
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    members = rows.join(sizes, "bucket").join(reps.select("rid", "sketch"), "rid")
    edges = _blocked(members, "bucket", F.ceil(F.col("size") / BLOCK), ["sketch"]).mapInArrow(sketch_edges, "u bigint, v bigint")
    groups = components(edges)

    # exact comparison inside the candidate groups, on sets read anew from the texts
    found = groups.withColumnRenamed("node", "rid").join(reps.select("rid", "weight", "pick", "n"), "rid")
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_TOKENS)).cast("bigint").alias("blocks")
    wanted = stored(found.join(found.groupBy("comp").agg(blocks), "comp")
                    .select("rid", "comp", "blocks", "weight", F.col("pick.doc_id").alias("__id"), F.col("pick.th").alias("__th")))
    texts = docs.select(col(id_col).alias("doc_id"), row_hash(col(text_col)).alias("th"), col(text_col).cast("string").alias("text"))
    texts = texts.join(checked_broadcast(wanted), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("th") == F.col("__th")))
    hashed = texts.select("comp", "blocks", "rid", "weight", F.transform(words(F.col("text")), lambda x: F.xxhash64(x)).alias("h"))

    def to_sets(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array([u.tobytes() for u in _sets(b.column(4))], pa.binary())],
                                             names=["comp", "blocks", "rid", "weight", "tokens"])

    sets = hashed.mapInArrow(to_sets, "comp bigint, blocks bigint, rid bigint, weight bigint, tokens binary")
    checked = stored(_blocked(sets, "comp", F.col("blocks"), ["block", "weight", "tokens"])
                     .mapInArrow(verify, "rid bigint, links bigint, root bigint"))
    classes = components(checked.where("rid <> root").select(F.col("rid").alias("u"), F.col("root").alias("v")))
    links = checked.groupBy("rid").agg(F.sum("links").alias("links"))
    named = reps.select("rid", "s1", "s2", "weight", "pick").join(links, "rid", "left").join(
        classes.withColumnRenamed("node", "rid"), "rid", "left").withColumn("comp", F.coalesce("comp", "rid"))
    least = named.groupBy("comp").agg(F.min("pick").alias("first"))
    named = named.join(least, "comp").select("s1", "s2", F.col("first.doc_id").alias("class_id"), F.col("first.th").alias("class_th"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).cast("long").alias("n_links"))
    return all_rows.select("doc_id", "th", "s1", "s2").join(stored(named), ["s1", "s2"]).select(
        "doc_id", "th", "class_id", "class_th", "n_links")


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", recall: float = RECALL) -> DataFrame:
    """One document of each class, the one that names it; of rows equal in id and text
    one stays."""
    found = stored(similar_classes(docs, id_col, text_col, recall))
    gone = stored(found.where(~(F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("th") == F.col("class_th"))))
                  .select(F.col("doc_id").alias("__id"), F.col("th").alias("__th")).distinct())
    kept = docs.join(checked_broadcast(gone), col(id_col).eqNullSafe(F.col("__id")) & (row_hash(col(text_col)) == F.col("__th")), "left_anti")
    again = found.groupBy("doc_id", "th").agg(F.count("*").alias("n")).where("n > 1")
    if again.limit(1).count():
        h = "__row_hash"
        kept = kept.withColumn(h, row_hash(col(text_col))).dropDuplicates([id_col, h]).drop(h)
    return kept
