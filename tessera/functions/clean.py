"""Text cleaning as pure Column -> Column expressions.

Every function returns a native Spark expression, so a chain of them stays inside
whole-stage code generation and works unchanged on a streaming DataFrame.
"""
from __future__ import annotations

import re
import unicodedata
from typing import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules as R

ColumnOrName = "Column | str"

_REGEX_META = set("\\^$.|?*+()[]{}")

# Python's \W is "not a letter, digit or underscore"; this class means the same in
# Java and RE2 (Java's (?U)\W would keep combining marks as word characters).
NON_WORD_RUN = r"[^\p{L}\p{N}_]+"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _is_literal(pattern: str) -> bool:
    return not any(ch in _REGEX_META for ch in pattern)


def apply_rules(c, rule_list: Sequence[tuple[str, str]], word_boundaries: bool = False) -> Column:
    """Fold an ordered list of (pattern, replacement) rules over a column.

    Literal patterns use the cheaper literal ``replace``; the rest ``regexp_replace``.
    ``word_boundaries`` wraps word-character-bounded patterns in ``\\b`` (quirk Q2).
    """
    out = _col(c)
    for pat, rep in rule_list:
        if word_boundaries and re.fullmatch(r"\w.*\w", pat) and _is_literal(pat):
            out = F.regexp_replace(out, r"\b" + re.escape(pat) + r"\b", rep.replace("$", r"\$"))
        elif _is_literal(pat):
            out = F.replace(out, F.lit(pat), F.lit(rep))
        else:
            out = F.regexp_replace(out, pat, rep)
    return out


def lowercase(c) -> Column:                       # P1
    return F.lower(_col(c))


def strip_non_ascii(c) -> Column:                 # P2: drops, does not transliterate
    return F.regexp_replace(_col(c), r"[^\x00-\x7F]", "")


def remove_nonalpha(c) -> Column:                 # P3
    return F.regexp_replace(_col(c), NON_WORD_RUN, " ")


def repair_words(c) -> Column:                    # P4: runs of one character cut to 2
    return F.regexp_replace(_col(c), r"(?s)(.)\1{2,}", "$1$1")


def concat_words(tokens) -> Column:               # P5
    return F.array_join(_col(tokens), " ")


def glove_preprocess(c, rules: str = "reference") -> Column:   # P6
    """Twitter-style markers.  ``rules='reference'`` keeps the original order and
    patterns (including quirk Q1); ``'fixed'`` swaps in a real URL pattern."""
    rl = list(R.GLOVE_RULES_REFERENCE)
    if rules == "fixed":
        rl = [(R.URL_PATTERN_FIXED, "<URL>")] + rl[2:]
    elif rules != "reference":
        raise ValueError("rules must be 'reference' or 'fixed'")
    return apply_rules(c, rl)


def text_to_wordlist(c, word_boundaries: bool = False) -> Column:   # P7
    out = apply_rules(c, R.WORDLIST_RULES, word_boundaries=word_boundaries)
    return F.translate(out, R.WORDLIST_DROP_CHARS, "")


def replace_contractions(c, include_tail: bool = True) -> Column:   # P8
    """Contraction dictionary; ``include_tail`` also strips the punctuation class
    and squeezes whitespace, as the dictionary's last two entries do."""
    rl = R.CONTRACTIONS if include_tail else R.CONTRACTIONS[:-2]
    return apply_rules(c, rl)


def basic_cleaning(c, stopwords: Iterable[str] = R.BASIC_STOPWORDS) -> Column:   # P9
    from .tokens import whitespace_split
    toks = whitespace_split(F.lower(_col(c)))
    stops = list(stopwords)
    return F.array_join(F.filter(toks, lambda x: ~x.isin(stops)), " ")


def wordlist_clean(c) -> Column:                  # P10 (first composition)
    return text_to_wordlist(glove_preprocess(c))


def fill_null_text(c, sentinel: str = R.NULL_TEXT_SENTINEL) -> Column:   # P11
    return F.coalesce(_col(c), F.lit(sentinel))


def _latin_fold_table() -> tuple[str, str]:
    """Rule-built transliteration table: every code point of U+00C0..U+024F whose
    compatibility decomposition is one ASCII letter plus combining marks."""
    src, dst = [], []
    for cp in range(0x00C0, 0x0250):
        ch = chr(cp)
        base = "".join(x for x in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(x))
        if len(base) == 1 and base.isascii() and base.isalpha() and base != ch:
            src.append(ch)
            dst.append(base)
    return "".join(src), "".join(dst)


LATIN_FOLD_FROM, LATIN_FOLD_TO = _latin_fold_table()


def transliterate_latin(c) -> Column:
    return F.translate(_col(c), LATIN_FOLD_FROM, LATIN_FOLD_TO)


def normalize_text(c) -> Column:                  # P12 (re-aimed)
    """Lower-case, fold Latin diacritics to ASCII, expand contractions."""
    return replace_contractions(transliterate_latin(F.lower(_col(c))), include_tail=False)


def reverse_words(c) -> Column:                   # P13
    return F.array_join(F.reverse(F.split(_col(c), " ", -1)), " ")
