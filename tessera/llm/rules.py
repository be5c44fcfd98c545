"""Quality rules as a short-circuit cascade, in DataFrame expressions only.

``measured`` gives the statistics of each text; a rule is a predicate over them that
rejects.  ``ordered`` times every rule on the texts of a sample, with the statistics the rule
reads and no others, counts its rejections and sorts the rules by rejections per second.
``kept_documents`` applies them in that order, the statistics of a rule worked out only for
texts no earlier rule has rejected; ``cascade`` does the same over given statistics as one
nested ``when``.  The order changes the work, never the verdict.

Defined results: a null or blank text has no words and fails the base rule; ties in the
order are broken by rule name; repeated rows each get their verdict; an empty table keeps
the order in which the rules are written.
"""
from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, stored, words

SYMBOLS = "#*$%&|<>"
SAMPLE_ROWS = 2000


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the statistics of the whole text, with its words and lines.

    Repeated windows: the hashes of the three-word windows are sorted with their places;
    equal neighbours are repeats, and a word is counted once however many of them cover
    it.  (64-bit hashes: two different windows of one text that collide would count as
    one, about 1e-10 for 50,000 words.)"""
    text = F.coalesce(col(text_col).cast("string"), F.lit(""))
    d = docs.select(col(id_col).alias("doc_id"), text.alias("text")).select("doc_id", "text", words(F.col("text")).alias("w"))
    d = d.select("doc_id", "text", "w", F.transform("w", lambda x: F.xxhash64(x)).alias("h"))
    n = F.size("h")
    tri = F.when(n >= 3, F.zip_with(F.zip_with(F.slice("h", 1, n - 2), F.slice("h", 2, n - 2), lambda a, b: F.xxhash64(a, b)),
                                    F.slice("h", 3, n - 2), lambda a, b: F.xxhash64(a, b))).otherwise(F.array().cast("array<bigint>"))
    d = d.select("doc_id", "text", "w", tri.alias("tri"))
    placed = F.when(F.size(F.array_distinct("tri")) < F.size("tri"),
                    F.array_sort(F.transform("tri", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
                    ).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
    d = d.select("doc_id", "text", "w", placed.alias("s"))
    m = F.size("s")
    equal = F.when(m >= 2, F.zip_with(F.slice("s", 1, m - 1), F.slice("s", 2, m - 1), lambda a, b: a["h"] == b["h"])
                   ).otherwise(F.array().cast("array<boolean>"))
    d = d.select("doc_id", "text", "w", "s", equal.alias("e"))
    # place k repeats if it equals its neighbour on either side
    flagged = F.zip_with(F.col("s"), F.zip_with(F.concat(F.array(F.lit(False)), F.col("e")), F.concat(F.col("e"), F.array(F.lit(False))),
                                                lambda a, b: a | b), lambda p, f: F.when(f, p["i"]))
    at = F.when(m >= 2, F.array_sort(F.filter(flagged, lambda x: x.isNotNull()))).otherwise(F.array().cast("array<int>"))
    d = d.select("doc_id", "text", "w", at.alias("p"))
    k = F.size("p")
    covered = F.when(k > 0, F.lit(3) + F.aggregate(
        F.zip_with(F.slice("p", 1, F.greatest(k - 1, F.lit(0))), F.slice("p", 2, F.greatest(k - 1, F.lit(0))), lambda a, b: F.least(F.lit(3), b - a)),
        F.lit(0), lambda s, x: s + x)).otherwise(F.lit(0))
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    bare = F.col("text")
    for c in SYMBOLS:
        bare = F.replace(bare, F.lit(c), F.lit(""))
    d = d.select("doc_id", "text", "w", covered.cast("long").alias("n_repeat_words"), lines.alias("lines"), F.length(bare).alias("bare"))
    return d.select("doc_id", F.size("w").cast("long").alias("n_words"), F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
                    (F.length("text") - F.col("bare")).cast("long").alias("n_symbols"),
                    (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), "n_repeat_words",
                    F.size("lines").cast("long").alias("n_lines"), F.length("text").cast("long").alias("n_chars"))


def base_failed() -> Column:
    """Too short, or half of the words in repeated windows."""
    return (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)


def rules() -> dict[str, Column]:
    """The rejecting rules beyond the base, each over ``measured`` columns."""
    c = F.col
    return {
        "symbols": c("n_symbols") * 10 > c("n_words"),                       # more than a symbol in ten words
        "short_words": c("word_chars") < c("n_words") * 2,                   # mean word below two characters
        "long_words": c("word_chars") > c("n_words") * 15,                   # or above fifteen
        "repeated_lines": (c("n_dup_lines") >= 3) & (c("n_dup_lines") * 100 > c("n_lines") * 30),  # three lines in ten said before
        "too_long": c("n_words") > 100000,
    }


#: the statistics that each rule reads
NEEDS = {"base": ["n_words", "n_repeat_words"], "symbols": ["n_symbols", "n_words"], "short_words": ["word_chars", "n_words"],
         "long_words": ["word_chars", "n_words"], "repeated_lines": ["n_dup_lines", "n_lines"], "too_long": ["n_words"]}


def ordered(sample: DataFrame, rejecting: dict[str, Column], id_col: str = "doc_id", text_col: str = "text", repeats: int = 2) -> list[dict]:
    """Cost (seconds) and rejections of each rule on a stored sample of texts, best rejection
    per cost first.  A rule's run works out the statistics it reads and no others, from
    the texts; the time of a run that only reads the texts is taken off."""
    total = sample.count()
    out = []

    def timed(df: DataFrame, found: Column) -> tuple[float, int]:
        best, n = float("inf"), 0
        for _ in range(repeats):
            t = time.perf_counter()
            n = df.agg(found).first()[0]
            best = min(best, time.perf_counter() - t)
        return best, n

    scan = timed(sample, F.sum(F.octet_length(col(text_col))))[0] if total else 0.0
    for place, (name, rule) in enumerate(rejecting.items()):
        seconds, rejected = 0.0, 0
        if total:
            own = measured(sample, id_col, text_col).select(*NEEDS.get(name, "*"))
            seconds, rejected = timed(own, F.count_if(F.coalesce(rule, F.lit(False))))
            seconds = max(seconds - scan, 1e-4)
        out.append({"rule": name, "rejected": rejected, "seconds": seconds, "rank": rejected / seconds if total else -place})
    return sorted(out, key=lambda r: (-r["rank"], r["rule"]))


def cascade(stats: DataFrame, rejecting: dict[str, Column], order: list[str]) -> DataFrame:
    """``stats`` with ``rejected_by``: the first rule in the order that rejects, or null."""
    verdict = F.lit(None).cast("string")
    for name in reversed(order):
        verdict = F.when(rejecting[name], F.lit(name)).otherwise(verdict)
    return stats.withColumn("rejected_by", verdict)


def order_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS, seed: int = 6) -> list[str]:
    """The order of the rules, from about ``sample_rows`` rows chosen by a hash of id and text."""
    n = docs.count()
    share = min(1.0, sample_rows / n) if n else 1.0
    u = F.pmod(F.xxhash64(F.lit(seed), col(id_col), col(text_col)), F.lit(1 << 30))
    sample = docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text"), u.alias("u")).where(F.col("u") < int(share * (1 << 30)))
    return [r["rule"] for r in ordered(stored(sample), {"base": base_failed(), **rules()})]


def kept_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: list[str] | None = None) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, all columns as they were.  Rule by rule in
    order, and a rule's statistics are worked out only for texts that are still in."""
    rejecting = {"base": base_failed(), **rules()}
    left = docs
    for name in order or order_of(docs, id_col, text_col):
        row = F.struct(*[col(c).alias(f"c{k}") for k, c in enumerate(docs.columns)])
        own = measured(left.select(row.alias("row"), col(text_col).alias("text")), "row", "text")
        left = own.select("doc_id", *NEEDS[name]).where(~F.coalesce(rejecting[name], F.lit(False))).select(
            *[F.col(f"doc_id.c{k}").alias(c) for k, c in enumerate(docs.columns)])
    return left


def assess(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS,
           seed: int = 6) -> DataFrame:
    """Statistics, base_failed, rejected_by and kept for every row.  The order of the
    rules is taken from a sample; the verdicts cover all rows.  The statistics are results here,
    so all rows have them; ``kept_documents`` saves those of rejected rows."""
    rejecting = {"base": base_failed(), **rules()}
    out = cascade(measured(docs, id_col, text_col), rejecting, order_of(docs, id_col, text_col, sample_rows, seed))
    return out.withColumn("base_failed", base_failed()).withColumn("kept", F.col("rejected_by").isNull())
