"""Mixing sources to target weights by hash-threshold histograms.

The size of a document is its number of words.  Sources, sorted by code point with null
last, weigh ``weights`` in turn and share ``share`` times all sizes; no target is above
``cap`` times its source's size, the excess being shared again by weight.  With sources
sorted by cap / weight, the level a source gets per unit of weight is the largest of
``(budget - caps before) / (weight left)``: prefix sums instead of repeated rounds.

A source takes each document ``floor(target / size)`` times, and once more those whose
hash lies under the source's threshold.  Thresholds come from nested histograms: sizes
are summed by source and 12 bits of the hash, the bucket in which the running sum passes
the rest of the budget is split by the next 12 bits, and so on until it holds one
hash; that hash is taken if this brings the sum nearer.  Nothing is sorted, and the
documents are filtered by comparing their hash.

Defined results: null or blank texts have size 0 and nothing is taken of them; documents
with one id share a hash and are taken together (as are all null ids of a source); a
source without words has target 0; an empty table gives no rows.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranking import global_index, global_prefix
from .common import WORD, col, stored

BITS, DIGITS = 12, 15                                # 15 hexadecimal digits are 60 bits, five histograms
WEIGHTS = (5, 2, 1)


def sized(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """doc_id, source, sk (a key that tells null from text), size, h (60 bits)."""
    source = col(source_col).cast("string")
    return docs.select(
        col(id_col).alias("doc_id"), source.alias("source"),
        F.when(source.isNull(), "n").otherwise(F.concat(F.lit("s"), source)).alias("sk"),
        F.coalesce(F.regexp_count(col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.conv(F.substring(F.md5(F.coalesce(col(id_col).cast("string"), F.lit("")).cast("binary")), 1, DIGITS), 16, 10).cast("long").alias("h"))


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """One row per source: sk, source_size, target."""
    src = stored(sizes.groupBy("sk", "source").agg(F.sum("size").alias("source_size")))
    ranked = global_index(src, [F.col("source").asc_nulls_last()], "rank")
    turn = F.lit(None)
    for k, w in enumerate(weights):
        turn = F.when(F.col("rank") % len(weights) == k, F.lit(float(w))).otherwise(turn)
    ranked = ranked.withColumn("weight", turn).withColumn("most", F.col("source_size") * F.lit(cap))
    run = global_prefix(ranked.withColumn("ratio", F.col("most") / F.col("weight")), [F.col("ratio"), F.col("rank")],
                        {"caps": F.col("most"), "used": F.col("weight")})
    run = stored(run)
    total = run.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    if total["weight"] is None:
        return run.select("sk", "source_size", F.lit(0.0).alias("target"))
    level = run.agg(F.max((F.lit(share * total["size"]) - F.col("caps")) / (F.lit(total["weight"]) - F.col("used")))).first()[0]
    return run.select("sk", "source_size", F.least(F.col("most"), F.col("weight") * F.lit(level)).alias("target"))


def thresholds(sizes: DataFrame, goal: DataFrame) -> DataFrame:
    """One row per source: sk, source_size, target, whole (times every document is
    taken), bound and include (documents with a hash under the bound, or on it if
    ``include``, are taken once more)."""
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    state = stored(goal.withColumn("whole", whole).select(
        "*", (F.col("target") - F.col("whole") * F.col("source_size")).alias("rest"),
        F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("before")))
    by_source = Window.partitionBy("sk").orderBy("bucket")
    bound = None
    for level in range(1, DIGITS * 4 // BITS + 1):
        shift = DIGITS * 4 - BITS * level
        rows = sizes.where("size > 0").join(state.select("sk", "prefix"), "sk").where(
            F.shiftright("h", shift + BITS) == F.col("prefix"))
        hist = rows.groupBy("sk", F.shiftright("h", shift).alias("bucket")).agg(
            F.sum("size").alias("sum"), F.min("h").alias("lo"), F.max("h").alias("hi"))
        run = hist.withColumn("upto", F.sum("sum").over(by_source)).join(
            state.select("sk", F.col("before").alias("was"), "rest"), "sk")
        edge = (run.where((F.col("was") + F.col("upto") > F.col("rest")) & (F.col("was") + F.col("upto") - F.col("sum") <= F.col("rest")))
                .select("sk", "bucket", (F.col("was") + F.col("upto") - F.col("sum")).alias("under"), "sum", "lo", "hi"))
        edge = stored(edge)
        bound = edge
        if edge.where("lo < hi").limit(1).count() == 0:
            break
        state = stored(state.join(edge.select("sk", "bucket", "under"), "sk", "left").select(
            "sk", "source_size", "target", "whole", "rest", F.coalesce("bucket", F.lit(-1)).alias("prefix"),
            F.coalesce("under", "before").alias("before")))
    nearer = F.col("under") + F.col("sum") - F.col("rest") < F.col("rest") - F.col("under")
    return state.join(bound.select("sk", "lo", "sum", "under"), "sk", "left").select(
        "sk", "source_size", "target", "whole", F.col("lo").alias("bound"), F.coalesce(nearer, F.lit(False)).alias("include"))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
        weights: tuple = WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """doc_id, h, size, source_size, target, copies and taken of every row."""
    sizes = stored(sized(docs, id_col, source_col, text_col))
    edge = stored(thresholds(sizes, targets(sizes, weights, share, cap)))
    more = (F.col("h") < F.col("bound")) | ((F.col("h") == F.col("bound")) & F.col("include"))
    copies = F.when(F.col("size") > 0, F.col("whole") + F.coalesce(more, F.lit(False)).cast("long")).otherwise(0).cast("long")
    return (sizes.join(edge, "sk").withColumn("copies", copies)
            .select("doc_id", "h", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
                    weights: tuple = WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """The documents that the mix takes, with size, source_size, target, taken and
    copies (each behind ``mix_`` where the input has a column of that name); the size is counted
    anew in the same scan that filters by the threshold."""
    sizes = stored(sized(docs, id_col, source_col, text_col))
    edge = stored(thresholds(sizes, targets(sizes, weights, share, cap)))
    named = {c: f"__mix_{c}" for c in edge.columns}
    e = edge.select(*[F.col(k).alias(v) for k, v in named.items()])
    source = col(source_col).cast("string")
    h = F.conv(F.substring(F.md5(F.coalesce(col(id_col).cast("string"), F.lit("")).cast("binary")), 1, DIGITS), 16, 10).cast("long")
    size = F.coalesce(F.regexp_count(col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    d = docs.withColumn("__mix_key", F.when(source.isNull(), "n").otherwise(F.concat(F.lit("s"), source)))
    d = d.join(e, F.col("__mix_key") == F.col("__mix_sk"))
    more = (h < F.col("__mix_bound")) | ((h == F.col("__mix_bound")) & F.col("__mix_include"))
    d = d.withColumn("__mix_copies", F.col("__mix_whole") + F.coalesce(more, F.lit(False)).cast("long")).where("__mix_copies > 0")
    d = d.withColumn("__mix_size", size).where("__mix_size > 0")
    extra = {"size": F.col("__mix_size"), "source_size": F.col("__mix_source_size"), "target": F.col("__mix_target"),
             "taken": F.col("__mix_size") * F.col("__mix_copies"), "copies": F.col("__mix_copies")}
    # a column of the input keeps its name; the mix's own is then called mix_...
    free = lambda k: k if k not in docs.columns else free("mix_" + k)
    return d.select(*[col(c) for c in docs.columns], *[v.alias(free(k)) for k, v in extra.items()])
