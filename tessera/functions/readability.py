"""Readability scores (F12, re-aimed) as Column expressions.

Counts: sentences = runs of . ! ? (at least 1), words = whitespace tokens holding a
letter, syllables = vowel groups per word (at least 1), letters = letters, polysyllables
= words of 3+ syllables.  The published formulas are applied to those counts over
the whole text.  Dale-Chall and difficult words need a table of easy words and are in
``operators/lexicon.py``.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .clean import _col
from .tokens import whitespace_split

VOWELS = "[aeiouy]+"


def _syllables(w: Column) -> Column:
    return F.greatest(F.lit(1), F.size(F.regexp_extract_all(F.lower(w), F.lit(VOWELS), 0)))


def counts(c) -> Column:
    """struct(sentences, words, syllables, letters, polysyllables)."""
    s = _col(c)
    words = F.filter(whitespace_split(s), lambda w: w.rlike(r"\p{L}"))
    syl = F.transform(words, _syllables)
    return F.struct(
        F.greatest(F.lit(1), F.size(F.regexp_extract_all(s, F.lit(r"[.!?]+"), 0))).alias("sentences"),
        F.size(words).alias("words"),
        F.aggregate(syl, F.lit(0), lambda a, x: a + x).alias("syllables"),
        F.length(F.regexp_replace(s, r"\P{L}", "")).alias("letters"),
        F.size(F.filter(syl, lambda x: x >= 3)).alias("poly"))


def scores(cnt: Column) -> list[Column]:
    """Scores from a ``counts`` struct column; null when the text has no words."""
    S, W = cnt["sentences"].cast("double"), cnt["words"].cast("double")
    Y, L, P = cnt["syllables"].cast("double"), cnt["letters"].cast("double"), cnt["poly"].cast("double")
    ok = W > 0
    wps, spw = W / S, Y / W
    fre = F.lit(206.835) - 1.015 * wps - 84.6 * spw
    fk = 0.39 * wps + 11.8 * spw - 15.59
    smog = 1.043 * F.sqrt(P * (30.0 / S)) + 3.1291
    cli = 0.0588 * (L / W * 100.0) - 0.296 * (S / W * 100.0) - 15.8
    ari = 4.71 * (L / W) + 0.5 * wps - 21.43
    fog = 0.4 * (wps + 100.0 * P / W)
    lw = ((W - P) + 3.0 * P) / S
    linsear = F.when(lw > 20, lw / 2.0).otherwise((lw - 2.0) / 2.0)
    grades = F.array(*[F.round(x, 0) for x in (fk, cli, ari, smog, fog, linsear)])
    # consensus grade: most frequent rounded grade, ties -> the lower grade
    mode = F.array_sort(F.transform(F.array_distinct(grades), lambda g: F.struct(
        (-F.size(F.filter(grades, lambda x: x == g))).alias("n"), g.alias("g"))))[0]["g"]
    named = [("flesch_reading_ease", fre), ("smog_index", smog), ("flesch_kincaid_grade", fk),
             ("coleman_liau_index", cli), ("automated_readability_index", ari),
             ("linsear_write_formula", linsear), ("gunning_fog", fog), ("text_standard", mode)]
    return [F.when(ok, x).alias(n) for n, x in named]
