"""Tokens of a text as numbers of its own distinct tokens."""
from __future__ import annotations

from typing import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, LongType, StructType

CHUNK_TOKENS = 2_000_000        # about so many tokens are worked on at once


def _chunks(tok: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]]:
    """Runs of texts: the size of every text, the text and the number of every token, and the distinct tokens
    (a null is one like any other)."""
    sizes = pc.fill_null(pc.list_value_length(tok), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    at = 0
    while at < len(tok):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + CHUNK_TOKENS, side="right")))
        words = pc.list_flatten(tok.slice(at, to - at)).dictionary_encode(null_encoding="encode")
        own = sizes[at:to]
        yield own, np.repeat(np.arange(to - at), own), words.indices.to_numpy(zero_copy_only=False).astype(np.int64), words.dictionary
        at = to


def _pairs(text: np.ndarray, code: np.ndarray, texts: int, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct (text, token) pairs in order as text * words + code, the pair of every token, how often each
    comes and where it comes first."""
    both = text * words + code
    if texts * words <= 4 * len(both):          # few tokens: a cell for each
        often = np.bincount(both, minlength=texts * words)
        pairs = np.flatnonzero(often)
        to = np.zeros(texts * words, np.int64)
        to[pairs] = np.arange(len(pairs))
        of = to[both]
        first = np.zeros(len(pairs), np.int64)
        first[of[::-1]] = np.arange(len(both))[::-1]
        return pairs, of, often[pairs], first
    pairs, first, of, often = np.unique(both, return_index=True, return_inverse=True, return_counts=True)
    return pairs, of, often, first


def _listed(parts: list[pa.Array], sizes: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.r_[0, np.cumsum(np.concatenate(sizes))] if sizes else np.zeros(1, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.concat_arrays(parts) if parts else pa.array([], kind))


_COUNTED = pa.struct([("word", pa.string()), ("n", pa.int64()), ("first", pa.int32())])


@arrow_udf(ArrayType(StructType().add("word", "string").add("n", "long").add("first", "integer")))
def counted(tok: pa.Array) -> pa.Array:
    """Every distinct token of a text, how often it comes and its first position."""
    parts, sizes = [], []
    for own, text, code, words in _chunks(tok):
        m = max(len(words), 1)
        pairs, _, often, first = _pairs(text, code, len(own), m)
        row, word = np.divmod(pairs, m)
        first = first - (np.cumsum(own) - own)[row]
        parts.append(pa.StructArray.from_arrays([words.take(pa.array(word)).cast(pa.string()), pa.array(often.astype(np.int64)), pa.array(first.astype(np.int32))],
                                                fields=list(_COUNTED)))
        sizes.append(np.bincount(row, minlength=len(own)))
    return _listed(parts, sizes, _COUNTED)


_CODED = pa.struct([("j", pa.int32()), ("word", pa.string()), ("codes", pa.binary())])


@arrow_udf(ArrayType(StructType().add("j", "integer").add("word", "string").add("codes", "binary")))
def coded_tokens(tok: pa.Array) -> pa.Array:
    """The distinct tokens (j, word) of a text, after one entry with the number j of every token, as numbers of
    one, two or four bytes (its j is that width, negative); nothing for a text without tokens."""
    parts, sizes = [], []
    for own, text, code, words in _chunks(tok):
        m = max(len(words), 1)
        pairs, of, _, _ = _pairs(text, code, len(own), m)
        row, word = np.divmod(pairs, m)
        kinds = np.bincount(row, minlength=len(own))
        start = np.cumsum(kinds) - kinds
        local = of - start[text]
        some = own > 0
        width = next(w for w in (1, 2, 4) if kinds.max(initial=0) <= 1 << 8 * w)
        # the lists: the entry of the numbers in front of every text's words
        place = np.arange(len(pairs)) + (np.cumsum(some))[row]
        n = len(pairs) + int(some.sum())
        j = np.full(n, -width, np.int32)
        j[place] = np.arange(len(pairs)) - start[row]
        at = np.full(n, -1, np.int64)
        at[place] = word
        held = pa.array(np.maximum(at, 0), mask=at < 0)
        size = np.zeros(n, np.int64)
        size[j < 0] = own[some] * width
        codes = pa.Array.from_buffers(pa.binary(), n, [pa.array(j < 0).buffers()[1], pa.py_buffer(np.r_[0, np.cumsum(size)].astype(np.int32)),
                                                       pa.py_buffer(local.astype(f"<u{width}"))])
        parts.append(pa.StructArray.from_arrays([pa.array(j), words.take(held).cast(pa.string()), codes], fields=list(_CODED)))
        sizes.append(kinds + some)
    return _listed(parts, sizes, _CODED)


def _sequence(rid: np.ndarray, j: np.ndarray, index: np.ndarray, codes: list) -> np.ndarray:
    """The indices of the known tokens of one key's texts, by place, then by index."""
    texts = np.flatnonzero(j < 0)
    places, found = [], []
    for i in texts:
        at = np.frombuffer(codes[i], f"<u{-j[i]}")
        mine = (j >= 0) & (rid == rid[i]) if len(texts) > 1 else j >= 0
        number, value = j[mine], index[mine]
        times = np.bincount(number, minlength=int(at.max()) + 1)
        if len(texts) == 1 and times.max() <= 1:
            to = np.zeros(len(times), np.int64)
            to[number] = value
            return to[at[times[at] > 0]]
        value = value[np.argsort(number, kind="stable")]        # a token may have several indices
        each = np.repeat(np.arange(len(at)), times[at])
        nth = np.arange(len(each)) - np.repeat(np.cumsum(times[at]) - times[at], times[at])
        places.append(each)
        found.append(value[(np.cumsum(times) - times)[at[each]] + nth])
    if not places:
        return np.zeros(0, np.int64)
    place, value = np.concatenate(places), np.concatenate(found)
    return value[np.lexsort((value, place))]


@arrow_udf(ArrayType(LongType()))
def decoded(held: pa.Array) -> pa.Array:
    """The sequences of lists of (rid, j, index, codes): ``coded_tokens`` with the tokens' indices."""
    entries = pc.list_flatten(held)
    sizes = pc.fill_null(pc.list_value_length(held), 0).to_numpy(zero_copy_only=False)
    ends = np.r_[0, np.cumsum(sizes)].astype(np.int64)
    rid, j, index = (pc.fill_null(pc.struct_field(entries, f), 0).to_numpy(zero_copy_only=False).astype(np.int64) for f in ("rid", "j", "index"))
    codes = pc.struct_field(entries, "codes").to_pylist()
    out = [_sequence(rid[a:z], j[a:z], index[a:z], codes[a:z]) for a, z in zip(ends, ends[1:])]
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(x) for x in out])].astype(np.int32)),
                                    pa.array(np.concatenate([np.zeros(0, np.int64), *out])))
