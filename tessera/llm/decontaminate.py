"""Benchmark decontamination with one Aho-Corasick automaton over normalised items.

Normalisation: A-Z to lower case; a word is a run of ASCII letters, digits and
characters outside ASCII.  A pattern is a window of ``window`` consecutive words of an
item (an item with fewer words is one window).  Texts are scanned once; a document word
inside any occurrence of a pattern is hit.

The items go to the tasks in shards of at most ``shard_bytes`` of text, one scan of the
documents per shard; the usual benchmark set is one shard.

Defined results: a null or wordless text has no words, no hits and is clean; a null or
wordless item has no window and never matches; repeated document rows each get their
row, repeated items (same id) count once; an empty benchmark leaves every row clean.
"""
from __future__ import annotations

import re
import uuid
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, col, id_text, stored

WINDOW = 13
SHARD_BYTES = 8 << 20

#: bytes that separate words become spaces, A-Z become a-z, all others stay
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
               for b in range(256))
_ORIGINAL_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def normalised(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


def patterns(items: list[tuple], window: int = WINDOW) -> tuple[dict[str, tuple[int, list[int]]], list[str]]:
    """Pattern text -> (its words, numbers of the items that hold it), and the item ids."""
    ids = sorted({str(i) for i, _ in items if i is not None})
    number = {x: k for k, x in enumerate(ids)}
    found: dict[str, tuple[int, set]] = {}
    for item_id, text in items:
        w = normalised(text)
        if item_id is None or not w:
            continue
        n = min(window, len(w))
        for k in range(len(w) - n + 1):
            key = " " + b" ".join(w[k:k + n]).decode("utf-8", "surrogatepass") + " "
            found.setdefault(key, (n, set()))[1].add(number[str(item_id)])
    return {k: (n, sorted(v)) for k, (n, v) in found.items()}, ids


def automaton(found: dict):
    import ahocorasick
    a = ahocorasick.Automaton()
    for key, value in found.items():
        a.add_word(key, value)
    if found:
        a.make_automaton()
    return a


def scan(auto, text: str | None) -> tuple[int, list[tuple[int, int]], set[int]]:
    """Words of the text, merged hit ranges of words [from, to), numbers of the items."""
    w = normalised(text)
    if not w or not len(auto):
        return len(w), [], set()
    line = " " + b" ".join(w).decode("utf-8", "surrogatepass") + " "
    spaces, ranges, items = None, [], set()
    for end, (n, who) in auto.iter(line):
        if spaces is None:
            spaces = [k for k, c in enumerate(line) if c == " "]
        last = bisect_right(spaces, end) - 1        # the word that ends before this space
        items.update(who)
        if ranges and last - n <= ranges[-1][1]:
            ranges[-1][0] = min(ranges[-1][0], last - n)
            ranges[-1][1] = max(ranges[-1][1], last)
        else:
            ranges.append([last - n, last])
    merged: list[list[int]] = []
    for a, b in sorted(ranges):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    return len(w), [(a, b) for a, b in merged], items


def original_spans(text: str, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Hit word ranges as character offsets of the original text."""
    at = [m.span() for m in _ORIGINAL_WORD.finditer(text)]
    return [(at[a][0], at[b - 1][1]) for a, b in ranges]


_BUILT: dict = {}


def _cached(shard: tuple, window: int):
    """The automaton of a shard.  Workers are used again by later tasks and sessions, so it
    is told by the shard's own name; an address may be given to another broadcast."""
    name, broadcast = shard
    key = (name, window)
    if key not in _BUILT:
        _BUILT.clear()                               # one automaton per worker at a time
        found, ids = patterns(broadcast.value, window)
        _BUILT[key] = (automaton(found), ids)
    return _BUILT[key]


SCHEMA = "doc_id {id}, n_words long, ranges array<struct<first:int,after:int>>, spans array<struct<start:int,end:int>>, items array<string>"


def _shards(items: DataFrame, shard_bytes: int) -> list:
    """The items as (unique name, broadcast) of about ``shard_bytes`` of text each, fetched
    one by one."""
    size = items.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16)).first()[0] or 0
    n = max(1, -(-size // shard_bytes))
    if n > 1:
        items = stored(items.withColumn("shard", F.pmod(F.xxhash64("item_id"), F.lit(n))))
    spark = items.sparkSession
    return [(uuid.uuid4().hex, spark.sparkContext.broadcast([(r["item_id"], r["text"]) for r in
                                                             (items.where(F.col("shard") == k) if n > 1 else items).collect()]))
            for k in range(n)]


def _items(benchmark: DataFrame, item_col: str, item_text: str) -> DataFrame:
    return benchmark.select(col(item_col).alias("item_id"), col(item_text).cast("string").alias("text")).distinct()


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       item_col: str = "item_id", item_text: str = "text", window: int = WINDOW,
                       shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row per document row: doc_id, n_words, hit word ranges, their character spans
    in the original text, and the ids (as strings) of the items with occurring windows."""
    spark = docs.sparkSession
    bounded_batches(spark)
    src = id_text(docs, id_col, text_col)
    items = _items(benchmark, item_col, item_text)
    schema = SCHEMA.format(id=src.schema["doc_id"].dataType.simpleString())
    shards = _shards(items, shard_bytes)

    def scanner(shared):
        def run(batches):
            auto, ids = _cached(shared, window)
            for b in batches:
                rows = []
                for text in b.column(1).to_pylist():
                    n, ranges, who = scan(auto, text)
                    rows.append((n, ranges, original_spans(text, ranges) if ranges else [], [ids[k] for k in sorted(who)]))
                yield pa.RecordBatch.from_arrays([
                    b.column(0), pa.array([r[0] for r in rows], pa.int64()),
                    pa.array([[{"first": x, "after": y} for x, y in r[1]] for r in rows],
                             pa.list_(pa.struct([("first", pa.int32()), ("after", pa.int32())]))),
                    pa.array([[{"start": x, "end": y} for x, y in r[2]] for r in rows],
                             pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                    pa.array([r[3] for r in rows], pa.list_(pa.string()))],
                    names=["doc_id", "n_words", "ranges", "spans", "items"])
        return run

    if len(shards) == 1:
        return src.mapInArrow(scanner(shards[0]), schema)
    # more items than one automaton may hold: a pass per shard over rows with a key of
    # their own, the findings of a row brought together
    keyed = stored(src.withColumn("row_key", F.monotonically_increasing_id()))
    parts = None
    kschema = SCHEMA.format(id="bigint")
    for s in shards:
        p = keyed.select(F.col("row_key").alias("doc_id"), "text").mapInArrow(scanner(s), kschema)
        parts = p if parts is None else parts.unionByName(p)
    flat = (parts.groupBy(F.col("doc_id").alias("row_key")).agg(
        F.max("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("ranges"))).alias("ranges"),
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")))
    merged = F.expr("""aggregate(ranges, cast(array() as array<struct<first:int,after:int>>), (acc, r) ->
        case when size(acc) > 0 and r.first <= element_at(acc, -1).after
             then concat(slice(acc, 1, size(acc) - 1), array(named_struct('first', element_at(acc, -1).first,
                         'after', greatest(element_at(acc, -1).after, r.after))))
             else concat(acc, array(r)) end)""")
    return (keyed.select("row_key", "doc_id").join(flat.withColumn("ranges", merged), "row_key")
            .select("doc_id", "n_words", "ranges", "spans", "items"))


def verdicts(found: DataFrame) -> DataFrame:
    """The findings as counts: n_hit words, items, their digest, and the verdict
    (``n_hit > 0`` and at least a twentieth of the words)."""
    n_hit = F.expr("aggregate(ranges, 0L, (a, r) -> a + r.after - r.first)")
    f = found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                     F.sha2(F.encode(F.array_join("items", ","), "UTF-8"), 256).alias("items_sha256"))
    return f.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words")))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      item_col: str = "item_id", item_text: str = "text", window: int = WINDOW,
                      shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, all columns as they were: filtered
    in the scan itself with one shard, else by a join on (id, text hash)."""
    bounded_batches(docs.sparkSession)
    shards = _shards(_items(benchmark, item_col, item_text), shard_bytes)
    if len(shards) == 1:
        at, shared = docs.columns.index(text_col), shards[0]

        def run(batches):
            auto, _ = _cached(shared, window)
            for b in batches:
                keep = []
                for text in b.column(at).to_pylist():
                    n, ranges, _ = scan(auto, text)
                    hit = sum(y - x for x, y in ranges)
                    keep.append(not (hit > 0 and 20 * hit >= n))
                yield b.filter(pa.array(keep, pa.bool_()))
        # positional names, since mapInArrow would read a dot in a name as a field
        return docs.toDF(*[f"c{k}" for k in range(len(docs.columns))]).mapInArrow(run, docs.schema)
    named = docs.select(F.struct(col(id_col).alias("id"), F.xxhash64(col(text_col)).alias("h")).alias("k"),
                        col(text_col).alias("text"))
    bad = (verdicts(find_contamination(named, benchmark, "k", "text", item_col, item_text, window, shard_bytes))
           .where("contaminated").select(F.col("doc_id.id").alias("__bad_id"), F.col("doc_id.h").alias("__bad_h")).distinct())
    return docs.join(stored(bad), col(id_col).eqNullSafe(F.col("__bad_id"))
                     & (F.xxhash64(col(text_col)) == F.col("__bad_h")), "left_anti")
