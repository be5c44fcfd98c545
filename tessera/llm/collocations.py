"""Phrase collocations from FM-indexes over word ids.

The texts are dealt into shards of one language and about ``SHARD_WORDS`` words.  A shard is a
sequence of word ids with 0 between pieces; its index holds the Burrows-Wheeler transform
of the sequence and of its reverse, sorted as deep as the longest phrase.  An interval
of each stands for a phrase; extending it by a word on the left (or the right) needs one
transform, and the other interval follows from the counts of the smaller symbols.  So
phrases are listed with their counts level by level, each from the one that lacks its first
or last word, and a longer phrase names those it extends to the left and right.

Counts are summed across shards in three steps, each with what the one before has left:

1. words; only those found ``min_count`` times go on (others end a piece),
2. pairs of such words, extended once in an index of the shard,
3. phrases of three and more words in an index of the stretches whose pairs all were
   found often enough.

No phrase of ``min_count`` occurrences is lost, since none of its parts is rarer.  Between the
steps a phrase is the ids of its words, and a shard's counts travel in arrays or packed rows, one for
each bucket of words or phrases by hash; as many buckets as keep the counts that meet in one
bounded.

Defined results: a null text is empty; a null language is ``und``; an empty table gives no
row; equal rows all count; scores are exact (decimal products, integer division); ranks of a
language are by score, count (both descending) and phrase (UTF-8 bytes).
"""
from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, col, stored

MIN_COUNT = 100
MAX_WORDS = 5
TOP = 2000
NO_LANG = "und"
SHARD_WORDS = 2_000_000
BUCKET_WORDS = 2_000_000
SALTS = 64

#: A-Z to lower case, ends of pieces to \n, tab to blank
_TABLE = bytes(b + 32 if 65 <= b <= 90 else 10 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b for b in range(256))


class _Numbers(dict):
    """Numbers of words by first appearance, from 1."""

    def __missing__(self, word):
        n = self[word] = len(self) + 1
        return n


def _pack(x: np.ndarray) -> bytes:
    """int32 numbers, their count in front, compressed."""
    raw = x.astype("<i4").tobytes()
    return len(x).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(b: bytes) -> np.ndarray:
    n = int.from_bytes(b[:8], "little")
    return np.frombuffer(pa.decompress(b[8:], decompressed_size=4 * n, codec="zstd", asbytes=True), "<i4")


def word_numbers(text: str, numbers: _Numbers) -> np.ndarray:
    """The words of a text as numbers, 0 after each piece."""
    words = text.encode("utf-8", "surrogatepass").translate(_TABLE).replace(b"\n", b" \n ").split(b" ")
    x = np.fromiter(map(numbers.__getitem__, words), np.int32, len(words))
    empty, end = numbers[b""], numbers[b"\n"]
    x = x[x != empty]
    x[x == end] = 0
    return np.append(x, np.int32(0))


class _Transform:
    """Burrows-Wheeler transform of a circular sequence, suffixes sorted by ``depth`` symbols."""

    def __init__(self, seq: np.ndarray, depth: int):
        rank, done, order = seq.astype(np.int64), 1, None
        while done < depth:
            step = min(done, depth - done)           # what is sorted overlaps where depth is no power of two
            key = rank * (int(rank.max(initial=0)) + 1) + np.roll(rank, -step)
            order = np.argsort(key, kind="stable")
            s = key[order]
            rank = np.empty(len(seq), np.int64)
            rank[order] = np.cumsum(np.r_[False, s[1:] != s[:-1]])
            done += step
        if order is None:
            order = np.argsort(rank, kind="stable")
        self.bwt = seq[order - 1]
        self._to = None

    @property
    def to(self) -> np.ndarray:
        """Where the suffix that begins with the symbol of each row is found."""
        if self._to is None:
            order = np.argsort(self.bwt, kind="stable")
            self._to = np.empty(len(order), np.int64)
            self._to[order] = np.arange(len(order))
        return self._to


class Phrases:
    """Phrases of one length: their words and their intervals in both transforms."""

    def __init__(self, words, size, left, right):
        self.words, self.size, self.left, self.right = words, size, left, right


class WordIndex:
    """Bidirectional FM-index of a sequence of numbers, 0 between pieces."""

    def __init__(self, seq: np.ndarray, depth: int):
        self.seq, self.depth = seq, depth
        self._made: dict[str, _Transform] = {}

    def _transform(self, side: str) -> _Transform:
        if side not in self._made:
            self._made[side] = _Transform(self.seq if side == "left" else self.seq[::-1], self.depth)
        return self._made[side]

    def single(self) -> Phrases:
        count = np.bincount(self.seq)
        start = np.cumsum(count) - count
        have = np.flatnonzero(count)
        have = have[have > 0]
        return Phrases(have[:, None], count[have], start[have], start[have])

    def extended(self, p: Phrases, side: str) -> Phrases:
        """All phrases with one more word on the ``side``; ``origin`` is the row of ``p``
        each comes from."""
        t = self._transform(side)
        lo, other = (p.left, p.right) if side == "left" else (p.right, p.left)
        first_row = np.cumsum(p.size) - p.size
        row = np.repeat(np.arange(len(lo)), p.size)
        pos = np.arange(len(row)) - first_row[row] + lo[row]
        sym = t.bwt[pos].astype(np.int64)
        key = row * (int(sym.max(initial=0)) + 1) + sym
        order = np.argsort(key, kind="stable")
        key = key[order]
        at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        size = np.diff(np.r_[at, len(key)])
        first = order[at]
        origin, word = row[first], sym[first]
        keep = word > 0
        at, size, first, origin, word = at[keep], size[keep], first[keep], origin[keep], word[keep]
        mine = t.to[pos[first]] if len(p.words[0]) + 1 < self.depth else None   # the last level is not extended
        theirs = other[origin] + at - first_row[origin]        # smaller symbols come before, there too
        words = p.words[origin]
        words = np.c_[word, words] if side == "left" else np.c_[words, word]
        out = Phrases(words, size, *((mine, theirs) if side == "left" else (theirs, mine)))
        out.origin = origin
        return out


def shards(docs: DataFrame, text_col: str, lang_col: str, shard_words: int = SHARD_WORDS) -> DataFrame:
    """shard, lang, words, counts, tokens (packed numbers of words, 0 after each piece)."""
    src = docs.select(F.coalesce(col(lang_col).cast("string"), F.lit(NO_LANG)).alias("lang"),
                      F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text"))

    def run(batches):
        held: dict[str, list] = {}                   # lang -> numbers, arrays, their length
        made = 0
        task = TaskContext.get().partitionId() << 32

        def flush(lang):
            nonlocal made
            numbers, arrays, _ = held.pop(lang)
            x = np.concatenate(arrays)
            count = np.bincount(x, minlength=len(numbers) + 1)
            made += 1
            used = [(w, n) for w, n in numbers.items() if count[n]]
            # numbers of words in use only, the most frequent ones smallest
            used.sort(key=lambda wn: (-count[wn[1]], wn[0]))
            new = np.zeros(len(numbers) + 1, np.int32)
            new[[n for _, n in used]] = np.arange(1, len(used) + 1)
            return pa.RecordBatch.from_arrays([
                pa.array([task + made], pa.int64()), pa.array([lang], pa.string()),
                pa.array([[w.decode("utf-8", "surrogatepass") for w, _ in used]], pa.list_(pa.string())),
                pa.array([[int(count[n]) for _, n in used]], pa.list_(pa.int64())), pa.array([_pack(new[x])], pa.binary())],
                names=["shard", "lang", "words", "counts", "tokens"])

        total = 0
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if not text:
                    continue
                h = held.setdefault(lang, [_Numbers(), [], 0])
                x = word_numbers(text, h[0])
                h[1].append(x)
                h[2] += len(x)
                total += len(x)
                if h[2] >= shard_words or total >= 2 * shard_words:
                    largest = max(held, key=lambda k: held[k][2])
                    total -= held[largest][2]
                    yield flush(largest)
        for lang in list(held):
            yield flush(lang)

    return src.mapInArrow(run, "shard long, lang string, words array<string>, counts array<long>, tokens binary")


def _ints(column, kind=np.int64) -> np.ndarray:
    return column.to_numpy().astype(kind)


def _packed(cols: list[np.ndarray]) -> bytes:
    """int64 columns of one length, sorted by the first: its steps and the other columns, byte by
    byte, compressed."""
    first = np.diff(cols[0], prepend=0)
    raw = b"".join(np.ascontiguousarray(c.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes() for c in [first, *cols[1:]])
    return len(cols[0]).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpacked(b: bytes, width: int) -> list[np.ndarray]:
    n = int.from_bytes(b[:8], "little")
    raw = pa.decompress(b[8:], decompressed_size=8 * n * width, codec="zstd", asbytes=True)
    cols = [np.ascontiguousarray(np.frombuffer(raw[8 * n * k:8 * n * (k + 1)], np.uint8).reshape(8, n).T).view("<i8").ravel() for k in range(width)]
    return [np.cumsum(cols[0]), *cols[1:]]


def _cells(cols: list[np.ndarray], keys: int, buckets: int):
    """(bucket, packed rows): the rows dealt to buckets by a hash of their first ``keys`` columns."""
    h = np.zeros(len(cols[0]), np.uint64)
    with np.errstate(over="ignore"):
        for c in cols[:keys]:
            h = (h ^ c.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    bucket = (h % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort([*cols[:keys][::-1], bucket])
    at = np.flatnonzero(np.r_[True, np.diff(bucket[order]) != 0]) if len(order) else []
    for a, z in zip(at, np.r_[at[1:], len(order)]):
        rows = order[a:z]
        yield int(bucket[rows[0]]), _packed([c[rows] for c in cols])


def _summed(cols: list[np.ndarray], n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a row of each distinct key, number of the key of each row, summed counts)."""
    if len(cols) == 2 and max(int(c.max(initial=0)) for c in cols) < 2**31:
        order = np.argsort((cols[0] << 32) | cols[1], kind="stable")
    else:
        order = np.lexsort(cols[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in cols:
        s = c[order]
        new[1:] |= s[1:] != s[:-1]
    key = np.empty(len(order), np.int64)
    key[order] = np.cumsum(new) - 1
    return order[new], key, np.bincount(key, weights=n, minlength=int(new.sum())).astype(np.int64)


def _table(kinds: list, rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(kinds)], names=[n for n, _ in kinds])


WORDS = [("bucket", pa.int64()), ("shard", pa.int64()), ("lang", pa.string()), ("locals", pa.list_(pa.int64())), ("words", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))]
FREQUENT = [("part", pa.int64()), ("gid", pa.int64()), ("lang", pa.string()), ("word", pa.string()), ("f", pa.int64()), ("known", pa.binary())]


def words_by_bucket(shard: int, lang: str, words: list[str], counts: list[int], buckets: int) -> list[tuple]:
    """The words of one shard dealt to buckets by a hash: a row of ``WORDS`` for each."""
    found: dict[int, tuple] = {}
    for k, (w, n) in enumerate(zip(words, counts), 1):
        row = found.setdefault(zlib.crc32(w.encode("utf-8", "surrogatepass")) % buckets, ([], [], []))
        for column, x in zip(row, (k, w, n)):
            column.append(x)
    return [(b, shard, lang, *row) for b, row in sorted(found.items())]


def frequent_words(cells: pa.Table, min_count: int, buckets: int) -> pa.Table:
    """One bucket of words summed over its shards: a row (gid, lang, word, f) for each frequent
    word, and a packed row (gid, local number) for each shard with those it holds.  The
    ids of all buckets together are nearly dense."""
    lists = cells.column("words").to_pylist()
    size = np.array([len(x) for x in lists])
    words = pa.array([w for x in lists for w in x], pa.string()).dictionary_encode()
    langs = cells.column("lang").combine_chunks().dictionary_encode()
    count = np.array([n for x in cells.column("counts").to_pylist() for n in x], np.int64)
    local = np.array([n for x in cells.column("locals").to_pylist() for n in x], np.int64)
    both = np.repeat(langs.indices.to_numpy().astype(np.int64), size) * len(words.dictionary) + words.indices.to_numpy()
    key, code = np.unique(both, return_inverse=True)
    total = np.bincount(code, weights=count, minlength=len(key)).astype(np.int64)
    names = [(langs.dictionary[int(k) // len(words.dictionary)].as_py(), words.dictionary[int(k) % len(words.dictionary)].as_py()) if t >= min_count else None
             for k, t in zip(key, total)]
    good = sorted(np.flatnonzero(total >= min_count), key=lambda k: names[k])
    bucket = cells.column("bucket")[0].as_py()
    gid = np.full(len(names), -1, np.int64)
    gid[good] = np.arange(len(good)) * buckets + bucket
    rows = [(None, int(gid[k]), *names[k], int(total[k]), None) for k in good]
    start = np.cumsum(size) - size
    for shard, a, n in zip(cells.column("shard").to_pylist(), start, size):
        g, here = gid[code[a:a + n]], local[a:a + n]
        o = np.argsort(g[g >= 0], kind="stable")
        if len(o):
            rows.append((shard, None, None, None, None, _packed([g[g >= 0][o], here[g >= 0][o]])))
    return _table(FREQUENT, rows)


PAIRS = [("shard", pa.int64()), ("bucket", pa.int64()), ("cell", pa.binary()), ("state", pa.binary()), ("ids", pa.binary())]


def pairs_of_shard(tokens: pa.Table, known: pa.Table, buckets: int) -> pa.Table:
    """The pairs of frequent words of one shard with their counts, a packed row for each
    bucket of pairs, and one row that holds what is left of its sequence (numbers of the
    frequent words, their ids)."""
    if not tokens.num_rows or not known.num_rows:
        return _table(PAIRS, [])
    shard = tokens.column("shard")[0].as_py()
    x = _unpack(tokens.column("tokens")[0].as_py())
    cells = [_unpacked(k.as_py(), 2) for k in known.column("known")]
    ids, local = (np.concatenate([c[k] for c in cells]) for k in range(2))
    by = np.argsort(ids, kind="stable")              # the rows come in no order
    local, ids = local[by], np.r_[np.int64(-1), ids[by]]
    number = np.zeros(max(int(x.max(initial=0)), int(local.max())) + 1, np.int32)
    number[local] = np.arange(1, len(local) + 1)
    x = number[x]
    x = x[(x > 0) | (np.r_[np.int32(1), x[:-1]] > 0)]        # one 0 between stretches
    index = WordIndex(x, 2)
    words = index.single()
    rows = [(shard, None, None, _pack(x), ids.tobytes())]
    if len(words.size):
        two = index.extended(words, "left")
        rows += [(shard, b, cell, None, None) for b, cell in _cells([ids[two.words[:, 0]], ids[two.words[:, 1]], two.size], 2, buckets)]
    return _table(PAIRS, rows)


KNOWN = [("part", pa.int64()), ("p", pa.int64()), ("s", pa.int64()), ("f", pa.int64()), ("known", pa.binary())]


def frequent_pairs(cells: pa.Table, min_count: int) -> pa.Table:
    """One bucket of pairs summed over its shards: a row (p, s, f) for each frequent pair, and a
    packed row for each shard with those it holds."""
    parts = [_unpacked(c.as_py(), 3) for c in cells.column("cell")]
    p, s, n = (np.concatenate([x[k] for x in parts]) for k in range(3))
    shard = np.repeat(_ints(cells.column("shard")), [len(x[0]) for x in parts])
    first, key, total = _summed([p, s], n)
    rows = [(None, int(p[i]), int(s[i]), int(t), None) for i, t in zip(first, total) if t >= min_count]
    good = total[key] >= min_count
    p, s, shard = p[good], s[good], shard[good]
    order = np.lexsort((s, p, shard))
    at = np.flatnonzero(np.r_[True, np.diff(shard[order]) != 0]) if len(order) else []
    rows += [(int(shard[order[a]]), None, None, None, _packed([p[order[a:z]], s[order[a:z]]])) for a, z in zip(at, np.r_[at[1:], len(order)])]
    return _table(KNOWN, rows)


def stretches(x: np.ndarray, ids: np.ndarray, p: np.ndarray, s: np.ndarray) -> np.ndarray:
    """``x`` cut where two neighbours are no pair (p, s), without stretches under three words."""
    order = np.argsort(ids, kind="stable")           # ids -> numbers
    at = lambda v: order[np.searchsorted(ids[order], v)]
    wide = np.int64(len(ids))
    known = np.unique(at(p) * wide + at(s))
    key = x[:-1].astype(np.int64) * wide + x[1:]
    if not len(known):
        return np.zeros(1, np.int32)
    found = np.minimum(np.searchsorted(known, key), len(known) - 1)
    joined = (known[found] == key) & (x[:-1] > 0) & (x[1:] > 0)
    # a word stays if it stands in two joined pairs, or in one whose other word does
    before, after = np.r_[False, joined], np.r_[joined, False]
    middle = before & after
    stays = middle | (after & np.r_[middle[1:], False]) | (before & np.r_[False, middle[:-1]])
    kept = np.flatnonzero(stays)
    if not len(kept):
        return np.zeros(1, np.int32)
    gap = np.r_[True, ~(joined[kept[1:] - 1] & (kept[1:] - kept[:-1] == 1))]
    out = np.zeros(len(kept) + int(gap.sum()) + 1, np.int32)
    out[np.arange(len(kept)) + np.cumsum(gap)] = x[kept]
    return out


CELLS = [("bucket", pa.int64()), ("cell", pa.binary())]


def phrases_of_shard(state: pa.Table, known: pa.Table, max_words: int, buckets: int) -> pa.Table:
    """Phrases of three and more words of one shard with their counts (ids, -1 after the
    last), packed by bucket."""
    if not state.num_rows or not known.num_rows or max_words < 3:
        return _table(CELLS, [])
    x = _unpack(state.column("state")[0].as_py())
    ids = np.frombuffer(state.column("ids")[0].as_py(), np.int64)
    pairs = [_unpacked(k.as_py(), 2) for k in known.column("known")]
    x = stretches(x, ids, *(np.concatenate([q[k] for q in pairs]) for k in range(2)))
    index = WordIndex(x, max_words)
    now = index.single()
    rows = []
    for length in range(2, max_words + 1):
        if not len(now.size):
            break
        now = index.extended(now, "right" if length % 2 else "left")
        if length > 2 and len(now.size):
            w = np.full((len(now.size), max_words), -1, np.int64)
            w[:, :length] = ids[now.words]
            rows += _cells([*w.T, now.size], max_words, buckets)
    return _table(CELLS, rows)


def frequent_phrases(cells: pa.Table, max_words: int, min_count: int) -> pa.Table:
    """One bucket of phrases summed over its shards: w1.., f of the frequent ones."""
    parts = [_unpacked(c.as_py(), max_words + 1) for c in cells.column("cell")]
    cols = [np.concatenate([x[k] for x in parts]) for k in range(max_words + 1)]
    first, _, total = _summed(cols[:-1], cols[-1])
    good = total >= min_count
    return pa.Table.from_arrays([pa.array(c[first[good]]) for c in cols[:-1]] + [pa.array(total[good])], names=[f"w{k}" for k in range(1, max_words + 1)] + ["f"])


def counted_phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = MIN_COUNT,
                    max_words: int = MAX_WORDS, shard_words: int = SHARD_WORDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(words: gid, lang, word, f; phrases of 2 and more: w1.., length, f; lang, n), all that
    occur ``min_count`` times."""
    bounded_batches(docs.sparkSession)
    made = stored(shards(docs, text_col, lang_col, shard_words))
    totals = made.groupBy("lang").agg(F.sum(F.expr("aggregate(counts, 0L, (a, x) -> a + x)")).alias("n"))
    # a bucket holds the counts of about BUCKET_WORDS occurrences
    buckets = max(1, -(-(totals.agg(F.sum("n")).first()[0] or 0) // BUCKET_WORDS))

    def split(batches):
        for b in batches:
            for shard, lang, words, counts in zip(*[c.to_pylist() for c in b.columns]):
                rows = words_by_bucket(shard, lang, words, counts, buckets)
                yield from _table(WORDS, rows).to_batches()

    cells = made.select("shard", "lang", "words", "counts").mapInArrow(split, "bucket long, shard long, lang string, locals array<long>, words array<string>, counts array<long>")
    vocabulary = stored(cells.groupBy("bucket").applyInArrow(lambda t: frequent_words(t, min_count, buckets),
                                                             "part long, gid long, lang string, word string, f long, known binary"))
    frequent = vocabulary.where("part is null").select("gid", "lang", "word", "f")
    here = vocabulary.where("part is not null").select("part", "known")
    first = stored(made.select("shard", "tokens").groupBy("shard").cogroup(here.groupBy("part")).applyInArrow(
        lambda a, b: pairs_of_shard(a, b, buckets), "shard long, bucket long, cell binary, state binary, ids binary"))
    second = stored(first.where("cell is not null").select("bucket", "shard", "cell").groupBy("bucket").applyInArrow(
        lambda t: frequent_pairs(t, min_count), "part long, p long, s long, f long, known binary"))
    two = second.where("part is null").select("p", "s", "f")
    w = [f"w{k}" for k in range(1, max_words + 1)]
    third = (first.where("state is not null").select("shard", "state", "ids").groupBy("shard")
             .cogroup(second.where("part is not null").select("part", "known").groupBy("part"))
             .applyInArrow(lambda a, b: phrases_of_shard(a, b, max_words, buckets), "bucket long, cell binary"))
    longer = third.groupBy("bucket").applyInArrow(lambda t: frequent_phrases(t, max_words, min_count), ", ".join(f"{c} long" for c in [*w, "f"]))
    none = [F.lit(-1).cast("long").alias(c) for c in w[2:]]
    phrases = two.select(F.col("p").alias("w1"), F.col("s").alias("w2"), *none, "f").unionByName(longer)
    length = sum((F.col(c) >= 0).cast("int") for c in w)
    return frequent, stored(phrases.withColumn("length", length)), totals


def _part(w: list[str], a, b) -> list:
    """Words a+1..b of a phrase, moved to the front; a and b may be columns."""
    words = F.array(*[F.col(c) for c in w])
    part = F.slice(words, a + 1, b - a)
    return [F.coalesce(F.try_element_at(part, F.lit(k + 1)), F.lit(-1).cast("long")).alias(f"k{k + 1}") for k in range(len(w))]


def scored_phrases(words: DataFrame, phrases: DataFrame, totals: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, n, score and the counts of the most frequent one-word
    extensions (most_left, most_right; null for none) of every phrase."""
    w = [c for c in phrases.columns if c.startswith("w")]
    k = [f"k{j + 1}" for j in range(len(w))]
    length = F.col("length")
    # a phrase counts as a left extension of its last words and a right one of its first
    ext = (phrases.where("length > 2").select("f", F.explode(F.array(F.lit(0), F.lit(1))).alias("side"), "length", *w)
           .select("f", "side", *_part(w, F.col("side"), length - 1 + F.col("side"))))
    most = ext.groupBy(*k).agg(F.max(F.when(F.col("side") == 1, F.col("f"))).alias("most_left"), F.max(F.when(F.col("side") == 0, F.col("f"))).alias("most_right"))
    cuts = phrases.select(*w, "length", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), length - 1)).alias("cut"))
    none = [F.lit(-1).cast("long").alias(c) for c in k[1:]]
    parts = stored(words.select(F.col("gid").alias("k1"), *none, "f").unionByName(phrases.select(*[F.col(a).alias(b) for a, b in zip(w, k)], "f")))
    rows = cuts
    for name, part in (("l", _part(w, F.lit(0), F.col("cut"))), ("r", _part(w, F.col("cut"), length))):
        rows = rows.select("*", *part).join(parts.withColumnRenamed("f", name), k).drop(*k)
    lang = words.select(F.col("gid").alias("w1"), "lang")
    rows = rows.join(lang, "w1").join(F.broadcast(totals) if totals.count() <= 10_000 else totals, "lang")
    wide = lambda c: F.col(c).cast("decimal(18,0)")
    rows = rows.withColumn("top", (wide("a") * wide("n")).cast("decimal(34,0)") * F.lit(1000).cast("decimal(4,0)")).withColumn("under", wide("l") * wide("r"))
    rows = rows.withColumn("score", F.expr("top div under"))
    best = rows.groupBy("lang", *w).agg(F.min(F.struct("score", "cut", "l", "r", "a", "n", "length")).alias("b")).select("lang", *w, "b.*")
    joined = best.join(most.toDF(*w, "most_left", "most_right"), w, "left")
    named = joined.withColumn("id", F.monotonically_increasing_id())
    named = stored(named)
    text = (named.select("id", F.posexplode(F.array(*w)).alias("at", "gid")).where("gid >= 0").join(words.select("gid", "word"), "gid")
            .groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase")))
    return named.join(text, "id").select("lang", "phrase", "a", "l", "r", "n", "score", "most_left", "most_right")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = MIN_COUNT, max_words: int = MAX_WORDS,
                 top: int = TOP, keep_pct: int = 100, shard_words: int = SHARD_WORDS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of each language; a phrase with a
    longer one around it that is found in ``keep_pct`` percent of its occurrences is left out.

    A longer candidate is nowhere more frequent than the extension by one word that lies
    inside it, so the extensions by one word decide."""
    s = scored_phrases(*counted_phrases(docs, text_col, lang_col, min_count, max_words, shard_words))
    most = F.coalesce(F.greatest("most_left", "most_right"), F.lit(0))
    s = s.where(~(most * 100 >= F.col("a") * keep_pct))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # the first of every slice of a language, then of these at most SALTS * top rows
    some = s.withColumn("slice", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "slice").orderBy(*order))).where(F.col("rank") <= top)
    out = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
