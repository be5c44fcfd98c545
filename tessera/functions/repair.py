"""Text repair (P12): undoing doubly encoded UTF-8, and transliteration by Unicode's own
decompositions.

A character that was written as UTF-8, read as Latin-1 or Windows-1252 and written again is a
lead character followed by as many continuation characters as it announces.  Every such
sequence is put back, again and again until nothing changes, so text broken several times
heals.  Both work on runs of non-ASCII characters, once per distinct run.
"""
from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def _bytes_by_character() -> dict[str, int]:
    """Character -> the byte it stood for: Latin-1, and Windows-1252 where that has one."""
    out = {chr(b): b for b in range(0x80, 0x100)}
    for b in range(0x80, 0xA0):
        try:
            out[bytes([b]).decode("cp1252")] = b
        except UnicodeDecodeError:
            pass
    return out


BYTE = _bytes_by_character()


def _class(lo: int, hi: int) -> str:
    return "[" + "".join(re.escape(c) for c, b in sorted(BYTE.items()) if lo <= b <= hi) + "]"


_MORE = _class(0x80, 0xBF)
# two bytes: Latin to Arabic; the scripts behind are rarer than a sharp s before a quote
_ENCODED = re.compile(f"{_class(0xC2, 0xDB)}{_MORE}|{_class(0xE0, 0xEF)}{_MORE}{{2}}|{_class(0xF0, 0xF4)}{_MORE}{{3}}")


def _put_back(m: re.Match) -> str:
    try:
        return bytes(BYTE[c] for c in m[0]).decode("utf-8")
    except UnicodeDecodeError:
        return m[0]


def undouble(run: str) -> str:
    while True:
        fixed = _ENCODED.sub(_put_back, run)
        if fixed == run:
            return run
        run = fixed


def to_ascii(run: str) -> str:
    """Compatibility decomposition without its combining marks, where what is left is ASCII;
    other characters stay."""
    out = []
    for c in run:
        base = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        out.append(base if base.isascii() else c)
    return "".join(out)


@F.pandas_udf(StringType())
def undoubled(runs: pd.Series) -> pd.Series:
    return runs.map(undouble, na_action="ignore")


@F.pandas_udf(StringType())
def ascii_letters(runs: pd.Series) -> pd.Series:
    return runs.map(lambda r: to_ascii(undouble(r)), na_action="ignore")
