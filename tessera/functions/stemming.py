"""English stemming by the published Porter2 algorithm (T9), for distinct tokens.

The suffix tables are fixed values of the algorithm; words with characters other than
a-z and the apostrophe are left as they are.
"""
from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

V, C = "[aeiouy]", "[^aeiouy]"
DOUBLE = re.compile(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)$")
SHORT_END = re.compile(r"([^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$")
REGION = re.compile(rf"{V}{C}")
# Words with a stem of their own, and words left alone after step 1a.
SPECIAL = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl",
           "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
           **{w: w for w in "sky news howe atlas cosmos bias andes".split()}}
AFTER_1A = frozenset("inning outing canning herring earring proceed exceed succeed".split())
# Suffix and replacement of steps 2 and 3; suffixes deleted in step 4.
STEP_2 = {"tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize",
          "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful",
          "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og",
          "fulli": "ful", "lessli": "less", "li": ""}
STEP_3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "",
          "ness": "", "ative": ""}
STEP_4 = {x: "" for x in "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split()}


def _longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


def _regions(w: str) -> tuple[int, int]:
    head = re.match(r"gener|commun|arsen", w)
    m = None if head else REGION.search(w)
    r1 = head.end() if head else m.end() if m else len(w)
    m = REGION.search(w, r1)
    return r1, m.end() if m else len(w)


def _step_1(w: str, r1: int) -> str:
    s = _longest(w, ("sses", "ied", "ies", "us", "ss", "s"))
    if s == "sses":
        w = w[:-2]
    elif s in ("ied", "ies"):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif s == "s" and re.search(V, w[:-2]):
        w = w[:-1]
    if w in AFTER_1A:
        return w
    s = _longest(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if s in ("eed", "eedly"):
        if len(w) - len(s) >= r1:
            w = w[:len(w) - len(s)] + "ee"
    elif s and re.search(V, w[:len(w) - len(s)]):
        w = w[:len(w) - len(s)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif DOUBLE.search(w):
            w = w[:-1]
        elif r1 >= len(w) and SHORT_END.search(w):
            w += "e"
    return re.sub(rf"(?<=.)({C})[yY]$", r"\1i", w)


def _replaced(w: str, table: dict, start: int, r2: int) -> str:
    s = _longest(w, table)
    at = len(w) - len(s) if s else 0
    if s is None or at < start:
        return w
    before = w[:at]
    if (s == "ogi" and not before.endswith("l") or s == "li" and not re.search("[cdeghkmnrt]$", before)
            or s == "ative" and at < r2 or s == "ion" and not before.endswith(("s", "t"))):
        return w
    return before + table[s]


def porter2(word: str) -> str:
    if len(word) <= 2 or not re.fullmatch("[a-z']+", word):
        return word
    if word in SPECIAL:
        return SPECIAL[word]
    w = re.sub(rf"(^|(?<={V}))y", "Y", word.removeprefix("'"))
    r1, r2 = _regions(w)
    w = re.sub(r"('s'|'s|')$", "", w)
    w = _step_1(w, r1)
    if w in AFTER_1A:
        return w
    w = _replaced(w, STEP_2, r1, r2)
    w = _replaced(w, STEP_3, r1, r2)
    w = _replaced(w, STEP_4, r2, r2)
    if w.endswith("e") and (len(w) - 1 >= r2 or len(w) - 1 >= r1 and not SHORT_END.search(w[:-1])):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


@F.pandas_udf(StringType())
def stem(words: pd.Series) -> pd.Series:
    return words.map(porter2, na_action="ignore")
