"""Lexicon lookups (P14, T10, T11): replacement, lemma and tag tables.

A caller-given dictionary is a literal map evaluated per token in generated code
(its size is fixed in the plan); a lexicon *table* of unknown size is applied by
joining it to the words of every block of texts, numbered in the block.
"""
from __future__ import annotations

from typing import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import posexplode_rows
from ..functions.clean import _col
from .blocks import coded, spelled


def _map_lit(mapping: Mapping[str, str]) -> Column:
    items = [x for k, v in mapping.items() if v is not None for x in (F.lit(k), F.lit(v))]
    return F.create_map(*items) if items else F.create_map().cast("map<string,string>")


def replace_cells(df: DataFrame, col: str, mapping: Mapping[str, str | None]) -> DataFrame:
    """Whole-cell replacement: a value equal to a key becomes its canonical form
    (missing canonical form = the word itself) - the reference default (Q4)."""
    m = _map_lit(mapping)
    return df.withColumn(col, F.coalesce(F.try_element_at(m, _col(col)), _col(col)))


def replace_tokens(tokens, mapping: Mapping[str, str | None]) -> Column:
    """Token mode: every token equal to a key becomes its canonical form."""
    m = _map_lit(mapping)
    return F.transform(_col(tokens), lambda t: F.coalesce(F.try_element_at(m, t), t))


def map_tokens_by_table(df: DataFrame, key: str, tokens: str, table: DataFrame,
                        src: str, dst: str, out_col: str | None = None,
                        drop: DataFrame | None = None, drop_col: str | None = None) -> DataFrame:
    """Replace tokens through a (src -> dst) table of any size, keeping order;
    unmatched tokens are kept; tokens whose *result* is in ``drop`` are removed
    (lemma + stop-lemma removal, T10).  The table meets the words of every block of texts,
    the block's texts then meet their words."""
    out_col = out_col or tokens
    rows, words = coded(df, key, tokens, [c for c in df.columns if c != out_col])
    t = table.select(F.col(src).alias("__word"), F.col(dst).alias("__d")).dropDuplicates(["__word"])
    held = words.join(t, "__word", "left").withColumn("__to", F.coalesce("__d", "__word"))
    if drop is not None:
        held = held.join(drop.select(F.col(drop_col).alias("__to")).distinct(), "__to", "left_anti")
    return spelled(df, rows, held.where(F.length("__to") > 0), key, out_col)


_PIECES = r"[^\x00-\x7F]+|[\x00-\x7F]+"


def repair_text(df: DataFrame, key: str, text: str, transliterate: bool = False, out_col: str | None = None) -> DataFrame:   # P12
    """``df`` with doubly encoded characters put back (and, with ``transliterate``, letters brought
    to ASCII where Unicode decomposes them).  A text is cut into runs of ASCII and of other
    characters; each distinct run of the latter is repaired once and only the changed ones are
    joined back, to the texts that hold one.  Null texts stay null; ``key`` is unique."""
    from ..functions.repair import ascii_letters, undoubled
    out_col = out_col or text
    pieces = F.regexp_extract_all(_col(text), F.lit(_PIECES), 0)
    pos = posexplode_rows(df, [key], pieces, "__p", "__t").where(F.col("__t").rlike(r"^[^\x00-\x7F]"))
    runs = pos.select("__t").distinct()
    fixed = runs.select("__t", (ascii_letters if transliterate else undoubled)("__t").alias("__d")).where(F.col("__d") != F.col("__t"))
    new = pos.join(fixed, "__t").groupBy(key).agg(F.map_from_entries(F.collect_set(F.struct("__t", "__d"))).alias("__m"))
    mended = F.array_join(F.transform(pieces, lambda t: F.coalesce(F.try_element_at("__m", t), t)), "")
    return df.join(new, key, "left").withColumn(out_col, F.when(F.col("__m").isNull(), _col(text)).otherwise(mended)).drop("__m")


def difficult_words(df: DataFrame, key: str, text: str, easy: DataFrame, word_col: str = "word") -> DataFrame:   # F12
    """(key, difficult_words, dale_chall_readability_score) by a caller's table of easy words: a
    text's different words of two and more syllables that the table lacks, and the published
    score over their share of the words.  Null score without words."""
    from ..functions.readability import VOWELS, counts
    from ..functions.tokens import words
    hard = F.filter(F.array_distinct(words(text)), lambda w: F.size(F.regexp_extract_all(w, F.lit(VOWELS), 0)) >= 2)
    found = posexplode_rows(df, [key], hard, "__p", "__w").join(easy.select(F.lower(word_col).alias("__w")).distinct(), "__w", "left_anti")
    n = found.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    d = df.select(key, counts(text).alias("c")).join(n, key, "left").select(key, "c", F.coalesce("__n", F.lit(0)).cast("bigint").alias("difficult_words"))
    w = F.col("c.words").cast("double")
    share = 100.0 * F.col("difficult_words") / w
    score = 0.1579 * share + 0.0496 * (w / F.col("c.sentences")) + F.when(share > 5, 3.6365).otherwise(0.0)
    return d.select(key, "difficult_words", F.when(w > 0, score).alias("dale_chall_readability_score"))
