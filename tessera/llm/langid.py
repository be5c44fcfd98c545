"""Language identification by nearest centroid.

Vectors: counts of character 1-, 2- and 3-grams over lower-cased letters (every run of
other characters is one space), hashed into ``2**BITS`` cells, damped by
``1 + log(count)``, weighted by inverse document frequency and normalised.  Each
language has up to ``clusters`` centroids (spherical k-means); a text gets the language
of the centroid with the largest cosine, which is also its score.  A text further from
its centroid than the ``reject`` quantile of the language's training distances is marked
``rejected``; the nearest language is still reported.

The fit reads at most about ``per_lang`` labelled rows of each language, chosen by a hash
of id and text (the documented bound of the sample); prediction reads whole texts.  The
centroids are a stored table, sent to the tasks in shards of at most ``SHARD_LANGS`` languages, one
scan of the texts per shard; the nearest of all shards counts.

Defined results: a null text, or one without a letter, is ``und`` with score 0; rows with
a null language are never learned from; without any learned language every row is
``und``; repeated rows each get the same answer; ties go to the first language by code
point.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, checked_broadcast, col, stored

BITS = 13
PER_LANG = 600
CLUSTERS = 4
ROUNDS = 8
SHARD_LANGS = 256                                    # languages whose centroids go to the tasks at once: 32 MB at four clusters
_CELLS = 1 << BITS
_LETTER: np.ndarray | None = None


def _letters() -> np.ndarray:
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(c).isalpha() for c in range(0x110000)), np.bool_, 0x110000)
    return _LETTER


def gram_counts(text: str | None) -> np.ndarray | None:
    """Cell counts of a text, None if it has no letter."""
    if not text:
        return None
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[c]
    if not letter.any():
        return None
    c = np.where(letter, c, np.uint32(32))
    keep = letter.copy()
    keep[1:] |= letter[:-1]                          # one space after a run of letters
    c = np.concatenate(([np.uint32(32)], c[keep])).astype(np.uint32)
    if c[-1] != 32:
        c = np.append(c, np.uint32(32))
    one = c * np.uint32(0x9E3779B1)
    two = (c[:-1] * np.uint32(0x85EBCA6B)) ^ (c[1:] * np.uint32(0xC2B2AE35) + np.uint32(0x27D4EB2F))
    cells = [one >> np.uint32(32 - BITS), (two * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)]
    if len(c) > 2:
        three = (two[:-1] * np.uint32(0x165667B1)) ^ (c[2:] * np.uint32(0xD3A2646C) + np.uint32(0xFD7046C5))
        cells.append((three * np.uint32(0x85EBCA77)) >> np.uint32(32 - BITS))
    return np.bincount(np.concatenate(cells), minlength=_CELLS)


def _vector(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.zeros(_CELLS, np.float32)
    at = np.flatnonzero(counts)
    v[at] = (1 + np.log(counts[at])) * idf[at]
    n = np.linalg.norm(v)
    return v / n if n > 0 else v


def _centroids(vectors: np.ndarray, clusters: int) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means with a fixed start: the mean direction, then the farthest rows."""
    k = min(clusters, len(vectors))
    near = vectors @ _unit(vectors.mean(axis=0))
    start = [int(np.argmax(near))]
    best = vectors @ vectors[start[0]]
    while len(start) < k:
        start.append(int(np.argmin(best)))
        best = np.maximum(best, vectors @ vectors[start[-1]])
    c = vectors[start]
    for _ in range(ROUNDS):
        of = np.argmax(vectors @ c.T, axis=1)
        c = np.stack([_unit(vectors[of == j].mean(axis=0)) if (of == j).any() else c[j] for j in range(k)])
    sims = vectors @ c.T
    return c, sims.max(axis=1)


def _unit(v: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(v)
    return (v / n if n > 0 else v).astype(np.float32)


def fit(train: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        per_lang: int = PER_LANG, clusters: int = CLUSTERS, reject: float = 0.999) -> dict:
    """The model: idf weights, centroids with their language, and the least accepted
    cosine of each language.  Sampling, counting and clustering run as Spark jobs, one
    group per language of at most about ``per_lang`` vectors."""
    spark = train.sparkSession
    bounded_batches(spark)
    rows = train.select(col(text_col).cast("string").alias("text"), col(lang_col).cast("string").alias("lang"),
                        F.pmod(F.xxhash64(F.lit(8), col(id_col), col(text_col)), F.lit(1 << 30)).alias("u")).where("lang is not null and text is not null")
    share = (rows.groupBy("lang").count()
             .select("lang", (F.lit(float(per_lang)) / F.col("count") * (1 << 30)).alias("below")))
    sample = rows.join(checked_broadcast(stored(share)), "lang").where("u < below")

    def encode(batches):
        for b in batches:
            out = {"lang": [], "cells": [], "counts": []}
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                c = gram_counts(text)
                if c is not None:
                    at = np.flatnonzero(c)
                    out["lang"].append(lang), out["cells"].append(at.astype(np.int32)), out["counts"].append(c[at].astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(out["lang"], pa.string()), pa.array(out["cells"], pa.list_(pa.int32())),
                                              pa.array(out["counts"], pa.list_(pa.int32()))], names=["lang", "cells", "counts"])

    vectors = stored(sample.select("lang", "text").mapInArrow(encode, "lang string, cells array<int>, counts array<int>"))
    n = vectors.count()
    idf = np.zeros(_CELLS, np.float32)
    for r in vectors.select(F.explode("cells").alias("cell")).groupBy("cell").count().collect():   # at most 2**BITS rows
        idf[r["cell"]] = np.log((1 + n) / (1 + r["count"])) + 1

    def cluster(pdf: pd.DataFrame) -> pd.DataFrame:
        full = np.zeros((len(pdf), _CELLS), np.float32)
        for i, (cells, counts) in enumerate(zip(pdf["cells"], pdf["counts"])):
            dense = np.zeros(_CELLS, np.int64)
            dense[np.asarray(cells)] = np.asarray(counts)
            full[i] = _vector(dense, idf)
        full = full[np.lexsort(full[:, :8].T)]       # an order that does not depend on the partitioning
        c, sims = _centroids(full, clusters)
        c = c[np.lexsort(c.T[::-1])]
        return pd.DataFrame({"lang": pdf["lang"].iloc[0], "centroids": [c.astype("<f4").tobytes()], "least": float(np.quantile(sims, 1 - reject))})

    table = stored(vectors.groupBy("lang").applyInPandas(cluster, "lang string, centroids binary, least double"))
    return {"idf": idf, "table": table, "langs": table.count()}


def _nearest(text: str | None, m: dict) -> tuple[int, float]:
    """Number of the nearest centroid and its cosine; (-1, 0) for a text without letters."""
    c = gram_counts(text)
    if c is None or not len(m["of"]):
        return -1, 0.0
    at = np.flatnonzero(c)
    v = (1 + np.log(c[at])) * m["idf"][at]
    norm = np.linalg.norm(v)
    sims = m["centroids"][:, at] @ (v / norm if norm > 0 else v).astype(np.float32)
    k = int(np.argmax(sims))
    return k, float(sims[k])


def _shard(model: dict, k: int, shards: int) -> dict:
    """The centroids of one shard of languages, languages and centroids in order."""
    rows = model["table"].where(F.pmod(F.xxhash64("lang"), F.lit(shards)) == k).collect() if model["langs"] else []
    rows.sort(key=lambda r: r["lang"])
    each = [np.frombuffer(r["centroids"], "<f4").reshape(-1, _CELLS) for r in rows]
    return {"idf": model["idf"], "langs": [r["lang"] for r in rows], "least": [r["least"] for r in rows],
            "of": np.repeat(np.arange(len(rows)), [len(c) for c in each]).tolist(),
            "centroids": np.concatenate(each) if each else np.zeros((0, _CELLS), np.float32)}


def predict(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", shard_langs: int = SHARD_LANGS) -> DataFrame:
    """doc_id, lang_pred, score (0 to 1) and rejected for every row."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shards = max(1, -(-model["langs"] // shard_langs))
    src = docs.select(col(id_col).alias("doc_id"), col(text_col).cast("string").alias("text"))

    def scanner(shared):
        def run(batches):
            m = shared.value
            for b in batches:
                lang, score, rejected = [], [], []
                for text in b.column(1).to_pylist():
                    k, s = _nearest(text, m)
                    lang.append("und" if k < 0 else m["langs"][m["of"][k]])
                    score.append(round(min(1.0, max(0.0, s)), 6))
                    rejected.append(k < 0 or bool(s < m["least"][m["of"][k]]))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()),
                                                  pa.array(rejected, pa.bool_())], names=["doc_id", "lang_pred", "score", "rejected"])
        return run

    schema = "doc_id {}, lang_pred string, score double, rejected boolean"
    kind = src.schema["doc_id"].dataType.simpleString()
    if shards == 1:
        return src.mapInArrow(scanner(spark.sparkContext.broadcast(_shard(model, 0, 1))), schema.format(kind))
    keyed = stored(src.withColumn("row_key", F.monotonically_increasing_id()))
    parts = None
    for k in range(shards):
        shared = spark.sparkContext.broadcast(_shard(model, k, shards))
        p = stored(keyed.select(F.col("row_key").alias("doc_id"), "text").mapInArrow(scanner(shared), schema.format("bigint")))
        shared.destroy()
        parts = p if parts is None else parts.unionByName(p)
    best = parts.groupBy(F.col("doc_id").alias("row_key")).agg(F.min(F.struct((-F.col("score")).alias("s"), "lang_pred", "score", "rejected")).alias("b"))
    return keyed.select("row_key", "doc_id").join(best, "row_key").select("doc_id", "b.lang_pred", "b.score", "b.rejected")


def held_out(id_col: Column) -> Column:
    """Whether the fold of an id (crc32 of its text, modulo 4) is the test fold."""
    return F.coalesce(F.crc32(F.encode(id_col.cast("string"), "UTF-8")) % 4 == 2, F.lit(False))
