"""Per-row text statistics (F1-F4) as Column expressions."""
from __future__ import annotations

from typing import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules as R
from .clean import _col
from .tokens import whitespace_split


def num_alpha(c) -> Column:
    """Code points that are letters (Python ``str.isalpha`` per character)."""
    return F.length(F.regexp_replace(_col(c), r"\P{L}", ""))


def doc_features(c, i: int = 0) -> list[Column]:  # F1
    s = _col(c)
    n = F.length(s)
    return [
        n.cast("bigint").alias(f"num_characters_{i}"),
        F.size(whitespace_split(s)).cast("bigint").alias(f"num_words_{i}"),
        (n - F.length(F.replace(s, F.lit(" "), F.lit("")))).cast("bigint").alias(f"num_spaces_{i}"),
        num_alpha(s).cast("bigint").alias(f"num_alpha_{i}"),
        (n - num_alpha(s)).cast("bigint").alias(f"num_nonalpha_{i}"),
    ]


def length_features(c, suffix: str = "q1") -> list[Column]:   # F2
    s = _col(c)
    return [
        F.length(s).cast("bigint").alias(f"len_{suffix}"),
        F.length(F.replace(s, F.lit(" "), F.lit(""))).cast("bigint").alias(f"len_char_{suffix}"),
        F.size(whitespace_split(s)).cast("bigint").alias(f"len_word_{suffix}"),
    ]


def contains_flags(c, terms: Iterable[str], prefix: str = "comment_") -> list[Column]:   # F3
    low = F.lower(_col(c))
    return [F.contains(low, F.lit(t)).cast("int").alias(f"{prefix}{t}") for t in terms]


def flag_sum(flag_names: Iterable[str], name: str = "selected_badwords_sum") -> Column:   # F4
    names = list(flag_names)
    total = F.lit(0)
    for n in names:
        total = total + F.col(n)
    return total.cast("bigint").alias(name)


def text_statistics(c) -> list[Column]:
    """The text-statistics block: lengths, question-word and term flags, flag sum."""
    return (length_features(c) + contains_flags(c, R.QUESTION_WORDS)
            + contains_flags(c, R.FLAG_TERMS))
