"""Tokens, n-grams and token-array helpers (T1-T6, T8) as Column expressions."""
from __future__ import annotations

from typing import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules as R
from .clean import _col

WORD = r"[\p{L}\p{N}_]+"
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"


def tokenize(c) -> Column:                        # T1 (re-aimed word tokenizer)
    """Runs of word characters, and every other non-space character on its own."""
    return F.regexp_extract_all(_col(c), F.lit(TOKEN), 0)


def words(c) -> Column:                           # T2
    return F.regexp_extract_all(F.lower(_col(c)), F.lit(WORD), 0)


PY_SPACE = R.PY_SPACE + "+"


def whitespace_split(c) -> Column:
    """Python ``str.split()``: whitespace runs, no empty tokens."""
    return F.filter(F.split(_col(c), PY_SPACE), lambda x: x != F.lit(""))


def keras_words(c, filters: str = R.KERAS_FILTERS, lower: bool = True) -> Column:
    """Keras ``text_to_word_sequence``: lower, filter characters -> space, split."""
    x = F.lower(_col(c)) if lower else _col(c)
    x = F.translate(x, filters, " " * len(filters))
    return F.filter(F.split(x, " "), lambda t: t != F.lit(""))


def vectorizer_words(c, lower: bool = True) -> Column:
    """Tokens of two or more word characters (count-vectorizer default pattern)."""
    x = F.lower(_col(c)) if lower else _col(c)
    return F.filter(F.regexp_extract_all(x, F.lit(WORD), 0), lambda t: F.length(t) >= 2)


def ngrams(tokens, n: int, sep: str | None = " ") -> Column:   # T3
    """Word n-grams in order; joined with ``sep`` (or arrays when sep is None).

    Built from ``n`` shifted slices zipped together, so the token array is never
    referenced inside a lambda (Catalyst does not share sub-expressions there, and a
    token expression inside the lambda would be recomputed for every n-gram).
    """
    tok = _col(tokens)
    if n == 1:
        return tok if sep is not None else F.transform(tok, lambda x: F.array(x))
    m = F.greatest(F.size(tok) - n + 1, F.lit(0))
    zipped = F.arrays_zip(*[F.slice(tok, k + 1, m) for k in range(n)])
    fields = [str(k) for k in range(n)]
    if sep is None:
        return F.transform(zipped, lambda s: F.array(*[s[f] for f in fields]))
    return F.transform(zipped, lambda s: F.concat_ws(sep, *[s[f] for f in fields]))


def ngram_range(tokens, n_min: int, n_max: int, sep: str = " ") -> Column:
    parts = [ngrams(tokens, n, sep) for n in range(n_min, n_max + 1)]
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def skipgrams(tokens, n: int, k: int, seed: int, row_key, method: str = "xxhash") -> Column:   # T4
    """``k`` n-grams sampled without replacement (seeded, order kept).  Positions are
    ranked by a hash of (seed, key, pos) - xxhash64, or with ``method='knuth'`` a
    multiplicative hash plain SQL can repeat; fewer than k n-grams -> all (Q5)."""
    grams = ngrams(tokens, n)
    key = _col(row_key)

    def h(i):
        if method == "knuth":
            reduced = F.pmod(key.cast("bigint"), F.lit(2147483648))
            return F.pmod(reduced * F.lit(2654435761) + i * F.lit(40503) + F.lit(seed), F.lit(4294967296))
        return F.xxhash64(F.lit(seed), key, i)
    keyed = F.transform(grams, lambda g, i: F.struct(h(i).alias("h"), i.alias("i"), g.alias("g")))
    picked = F.slice(F.array_sort(keyed), 1, k)
    by_pos = F.array_sort(F.transform(picked, lambda s: F.struct(s["i"].alias("i"), s["g"].alias("g"))))
    return F.transform(by_pos, lambda s: s["g"])


def chargrams(c, n: int = 3) -> Column:           # T5 (honours n, quirk Q6)
    """Character n-grams (code points), overlapping, in order.

    The text is split into code points once and the n-grams are zipped shifted
    slices of that array - linear in the text (indexing with ``substring`` per
    position would rescan the string from its start each time).
    """
    chars = F.regexp_extract_all(_col(c), F.lit("(?s)."), 0)
    return ngrams(chars, n, sep="")


def remove_stops(tokens, stopwords: Iterable[str] = R.ENGLISH_STOPWORDS) -> Column:   # T6
    stops = list(dict.fromkeys(stopwords))
    # IN over a literal list becomes a hash-set test (InSet) once optimized
    return F.filter(_col(tokens), lambda x: ~x.isin(stops))


def chop(tokens, n: int) -> Column:               # T8
    return F.transform(_col(tokens), lambda x: F.substring(x, 1, n))
