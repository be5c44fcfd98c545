"""Terms of a lexicon found anywhere in texts.

A term of up to eight bytes is one number; a longer one is anchored by that run of eight of its
bytes which the fewest other terms share.  The bytes of a batch of texts make a number at every
place, which is looked up in a hash table of the numbers of each length; places of a longer
term's anchor are compared byte by byte.
"""
from __future__ import annotations

from typing import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

RUN = 8                     # bytes in a 64-bit number
SCAN_BYTES = 1 << 21        # about so many bytes of text are worked on at once
OUT_ROWS = 100_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of strings (none null) end to end, and where each begins and ends."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    a = a.cast(pa.large_binary())
    if not len(a):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    ends = np.frombuffer(a.buffers()[1], np.int64)[a.offset:a.offset + len(a) + 1]
    data = np.frombuffer(a.buffers()[2], np.uint8) if a.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[ends[0]:ends[-1]], ends - ends[0]


def _numbers(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on as one number, zeros behind the end."""
    w = np.concatenate([data, np.zeros(RUN - 1, np.uint8)]).astype(np.uint64)
    for half in (1, 2, 4):
        w = (w[:-half] << np.uint64(8 * half)) | w[half:]
    return w


def _short(w: np.ndarray, n: int) -> np.ndarray:
    return w >> np.uint64(8 * (RUN - n))


class Lexicon:
    """Distinct terms, ready to be looked up; ``terms`` is an Arrow array of strings, none empty."""

    def __init__(self, terms: pa.Array):
        self.terms = terms
        self.data, ends = _bytes(terms)
        self.start, self.size = ends[:-1], np.diff(ends)
        self.anchor = np.zeros(len(terms), np.int64)            # where in the term its number stands
        w = _numbers(self.data)
        if (long := np.flatnonzero(self.size > RUN)).size:
            runs = self.size[long] - RUN + 1
            of = np.repeat(np.arange(len(long)), runs)
            place = np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs)
            _, same, often = np.unique(w[self.start[long][of] + place], return_inverse=True, return_counts=True)
            order = np.lexsort((place, often[same], of))
            self.anchor[long] = place[order[np.cumsum(runs) - runs]]
        self.tables = {}
        length = np.minimum(self.size, RUN)
        for n in np.unique(length).tolist():
            who = np.flatnonzero(length == n)
            value = _short(w[self.start[who] + self.anchor[who]], n)
            values, of = np.unique(value, return_inverse=True)
            bits = max(4, int(len(values) * 4 - 1).bit_length())
            slot = (values * _MIX) >> np.uint64(64 - bits)
            order = np.argsort(slot, kind="stable")
            first = np.searchsorted(slot[order], np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int32)
            by = np.argsort(of, kind="stable")                  # the terms of every number
            self.tables[n] = bits, first, values[order], order, who[by], np.r_[0, np.cumsum(np.bincount(of, minlength=len(values)))]

    def hits(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text, term) numbers of all hits, each once."""
        w, rows, parts = _numbers(data), len(ends) - 1, []
        for n, (bits, first, values, number, who, at) in self.tables.items():
            x = _short(w, n)
            slot = ((x * _MIX) >> np.uint64(64 - bits)).astype(np.int64)
            place = np.flatnonzero(first[slot] < first[slot + 1])
            x, slot = x[place], slot[place]
            found_place, found = [], []
            k = first[slot]
            while len(place):           # the numbers of a slot, one after the other
                same = values[k] == x
                found_place.append(place[same])
                found.append(number[k[same]])
                more = ~same & (k + 1 < first[slot + 1])
                place, x, slot, k = place[more], x[more], slot[more], k[more] + 1
            if not found:
                continue
            place, found = np.concatenate(found_place), np.concatenate(found)
            row = np.searchsorted(ends, place, side="right") - 1
            if n < RUN:
                some = place + n <= ends[row + 1]
                row, found = _once(row[some], found[some], rows, len(at) - 1)
                parts.append((row, who[at[found]]))         # a short number is one term
                continue
            times = np.diff(at)[found]
            each = np.repeat(np.arange(len(found)), times)
            term = who[at[found][each] + np.arange(len(each)) - np.repeat(np.cumsum(times) - times, times)]
            row, begin = row[each], place[each] - self.anchor[term]
            some = (begin >= ends[row]) & (begin + self.size[term] <= ends[row + 1])
            row, begin, term = row[some], begin[some], term[some]
            step, own = 0, _numbers(self.data)
            while len(term) and step < self.size[term].max():       # the last eight bytes overlap
                d = np.minimum(step, self.size[term] - RUN)
                some = w[begin + d] == own[self.start[term] + d]
                row, begin, term = row[some], begin[some], term[some]
                step += RUN
            parts.append(_once(row, term, rows, len(self.terms)))
        if not parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def _once(row: np.ndarray, what: np.ndarray, rows: int, kinds: int) -> tuple[np.ndarray, np.ndarray]:
    both = row * kinds + what
    if rows * kinds <= 8 * len(both):
        seen = np.zeros(rows * kinds, bool)
        seen[both] = True
        both = np.flatnonzero(seen)
    else:
        both = np.unique(both)
    return np.divmod(both, max(kinds, 1))


def found_in(batches: Iterator[pa.RecordBatch], lexicon: Lexicon, names: list[str]) -> Iterator[pa.RecordBatch]:
    """(key, term) of every hit in batches (key, text)."""
    for b in batches:
        keys, texts = b.columns
        live = pc.and_(pc.is_valid(keys), pc.is_valid(texts))
        keys, texts = keys.filter(live), texts.filter(live)
        data, ends = _bytes(texts)
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + SCAN_BYTES, side="right")) - 1)
            row, term = lexicon.hits(data[ends[at]:ends[to]], ends[at:to + 1] - ends[at])
            for i in range(0, len(row), OUT_ROWS):
                part = slice(i, i + OUT_ROWS)
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(row[part] + at)), lexicon.terms.take(pa.array(term[part]))], names=names)
            at = to
