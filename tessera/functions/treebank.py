"""Tokens of a sentence by the Penn Treebank conventions."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .clean import _col
from .tokens import whitespace_split

# The published substitutions of the Treebank tokenisation, in their order.
OPENING_QUOTES = [(r'^"', "`` "), (r"(``)", " $1 "), (r'([ (\[{<])"', "$1 `` ")]
PUNCTUATION = [(r"([:,])([^0-9])", " $1 $2"), (r"([:,])$", " $1 "), (r"\.\.\.", " ... "), (r"([;@#$%&])", " $1 "),
               (r"([^.])(\.)([\])}>\"']*)\s*$", "$1 $2$3 "), (r"([?!])", " $1 "), (r"([^'])' ", "$1 ' "),
               (r"([\]\[(){}<>])", " $1 "), (r"--", " -- ")]
CLOSING_QUOTES = [(r'"', " '' "), (r"(\S)('')", "$1 $2 "), (r"([^' ])('[sS]|'[mM]|'[dD]|') ", "$1 $2 "),
                  (r"([^' ])('ll|'LL|'re|'RE|'ve|'VE|n't|N'T) ", "$1 $2 ")]
CONTRACTIONS = [(r"(?i)\b(can)(not)\b", " $1 $2 "), (r"(?i)\b(d)('ye)\b", " $1 $2 "), (r"(?i)\b(gim)(me)\b", " $1 $2 "),
                (r"(?i)\b(gon)(na)\b", " $1 $2 "), (r"(?i)\b(got)(ta)\b", " $1 $2 "), (r"(?i)\b(lem)(me)\b", " $1 $2 "),
                (r"(?i)\b(more)('n)\b", " $1 $2 "), (r"(?i)\b(wan)(na) ", " $1 $2 "), (r"(?i) ('t)(is)\b", " $1 $2 "),
                (r"(?i) ('t)(was)\b", " $1 $2 ")]


def treebank_tokens(sentence) -> Column:
    """Array of tokens of one sentence."""
    s = _col(sentence)
    for pattern, to in OPENING_QUOTES + PUNCTUATION:
        s = F.regexp_replace(s, pattern, to)
    s = F.concat(F.lit(" "), s, F.lit(" "))
    for pattern, to in CLOSING_QUOTES + CONTRACTIONS:
        s = F.regexp_replace(s, pattern, to)
    return whitespace_split(s)


def treebank_sql(expr: str) -> str:
    """The same in DuckDB's dialect, up to the split."""
    def step(e: str, pattern: str, to: str) -> str:
        quoted = [x.replace("'", "''") for x in (pattern, to.replace("$1", "\\1").replace("$2", "\\2").replace("$3", "\\3"))]
        return f"regexp_replace({e}, '{quoted[0]}', '{quoted[1]}', 'g')"
    for pattern, to in OPENING_QUOTES + PUNCTUATION:
        expr = step(expr, pattern, to)
    expr = f"(' ' || {expr} || ' ')"
    for pattern, to in CLOSING_QUOTES + CONTRACTIONS:
        expr = step(expr, pattern, to)
    return expr
