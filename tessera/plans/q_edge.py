"""Queries on inputs the fixture lacks, put in by rule (NaN, Unicode space, large and
negative ids), and forms of operators that other queries do not use."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import clean, rules as R, textstats, tokens as T
from ..functions.vectors import cosine_distance
from ..functions.arrays import explode_rows
from ..operators import corpus as C, encoders as A, folds as FO, lexicon as LX, numeric as N, sequences as S
from ..sources.tables import read_table
from .catalog import register
from .q_vectors import BENCH_VEC_SQL, _benchmark_vectors
from .sqlfrag import fold_rules, q, ws_split

KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
KEY_SQL = ", ".join(KEY)


def r6(c):
    return F.round(c, 6)


# --- NaN is missing -----------------------------------------------------------------
_NAN = "CASE WHEN l_linenumber = 3 THEN NULL WHEN l_linenumber = 5 THEN NULL ELSE l_tax END"


def _with_nan(spark, sf_dir):
    tax = F.when(F.col("l_linenumber") == 3, F.lit(float("nan"))).when(F.col("l_linenumber") == 5, F.lit(None)).otherwise(F.col("l_tax"))
    return read_table(spark, sf_dir, "lineitem").select(*KEY, tax.alias("tax"))


@register("n2_n3_impute_nan", f"""WITH t AS (SELECT {KEY_SQL}, {_NAN} AS tax FROM lineitem)
SELECT {KEY_SQL}, round(coalesce(tax, (SELECT avg(tax) FROM t)), 6) AS tax_mean,
  round(coalesce(tax, (SELECT median(tax) FROM t)), 6) AS tax_median FROM t""")
def n2_n3_impute_nan(spark, sf_dir):
    d = _with_nan(spark, sf_dir)
    d = d.select(*KEY, F.col("tax").alias("tax_mean"), F.col("tax").alias("tax_median"))
    d = N.impute_median(N.impute_mean(d, ["tax_mean"]), ["tax_median"])
    return d.select(*KEY, r6("tax_mean").alias("tax_mean"), r6("tax_median").alias("tax_median"))


@register("n8_n9_scale_nan", f"""WITH t AS (SELECT {KEY_SQL}, {_NAN} AS tax FROM lineitem)
SELECT {KEY_SQL}, round((tax - avg(tax) OVER ()) / stddev_pop(tax) OVER (), 6) AS z,
  round((tax - min(tax) OVER ()) / (max(tax) OVER () - min(tax) OVER ()), 6) AS u FROM t""")
def n8_n9_scale_nan(spark, sf_dir):
    d = _with_nan(spark, sf_dir).select(*KEY, F.col("tax").alias("z"), F.col("tax").alias("u"))
    d = N.scale_minmax(N.scale_standard(d, ["z"]), ["u"])
    return d.select(*KEY, r6("z").alias("z"), r6("u").alias("u"))


@register("a10_nan_indicator", f"SELECT {KEY_SQL}, CAST(({_NAN}) IS NULL AS INTEGER) AS tax FROM lineitem")
def a10_nan_indicator(spark, sf_dir):
    return A.nan_encode(_with_nan(spark, sf_dir), ["tax"])


# --- Unicode space --------------------------------------------------------------------
_SPACED = "replace(text, '. ', '.' || chr(160) || chr(160) || chr(8195))"


@register("p7_p8_unicode_space", f"""SELECT doc_id, translate({fold_rules(_SPACED, R.WORDLIST_RULES)}, {q(R.WORDLIST_DROP_CHARS)}, '') AS words,
  {fold_rules(_SPACED, R.CONTRACTIONS)} AS contractions FROM documents""")
def p7_p8_unicode_space(spark, sf_dir):
    """Word-list and contraction rules where no-break and em spaces follow the sentences."""
    t = F.replace("text", F.lit(". "), F.lit(".\u00a0\u00a0\u2003"))
    return read_table(spark, sf_dir, "documents").select(
        "doc_id", clean.text_to_wordlist(t).alias("words"), clean.replace_contractions(t).alias("contractions"))


# --- ids beyond 32 bits and below zero ---------------------------------------------------
_BIG = "CASE WHEN doc_id % 2 = 0 THEN doc_id * 4000000007 ELSE -doc_id * 4000000007 END"


@register("m1_large_ids", f"""WITH d AS (SELECT {_BIG} AS id FROM documents)
SELECT id, CAST(((((id % {FO.TWO31}) + {FO.TWO31}) % {FO.TWO31} * {FO.KNUTH} + 1337) % {FO.TWO32}) % 1000000 < 200000 AS INTEGER) AS is_val FROM d""")
def m1_large_ids(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents")
    big = F.when(F.col("doc_id") % 2 == 0, F.col("doc_id") * F.lit(4000000007)).otherwise(-F.col("doc_id") * F.lit(4000000007))
    out = FO.holdout_split(d.select(big.alias("id")), "id", 0.2, 1337, method="knuth")
    return out.select("id", F.col("is_val").cast("int").alias("is_val"))


# --- P14 whole cells, by a literal map and by a table ---------------------------------------
@register("p14_replace_whole_cells", """SELECT doc_id, CASE lang WHEN 'en' THEN 'english' WHEN 'fr' THEN 'fr' WHEN 'de' THEN 'german' ELSE lang END AS lang
FROM documents""")
def p14_replace_whole_cells(spark, sf_dir):
    """The default form: a cell equal to a word becomes its canonical form (a word without
    one stays)."""
    d = read_table(spark, sf_dir, "documents").select("doc_id", "lang")
    return LX.replace_cells(d, "lang", {"en": "english", "fr": None, "de": "german"})


# --- F2 summary -----------------------------------------------------------------------------
_LEN = ("len_q1", "length(text)"), ("len_char_q1", "length(replace(text, ' ', ''))")


@register("f2_length_summary", " UNION ALL ".join(
    f"""SELECT '{n}' AS feature, CAST(count(x) AS BIGINT) AS n, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std,
  CAST(min(x) AS DOUBLE) AS min, quantile_cont(x, 0.25) AS q25, quantile_cont(x, 0.5) AS q50, quantile_cont(x, 0.75) AS q75,
  CAST(max(x) AS DOUBLE) AS max FROM (SELECT {e} AS x FROM documents)""" for n, e in _LEN))
def f2_length_summary(spark, sf_dir):
    """Count, mean, std, extremes and exact quartiles of the length features."""
    d = read_table(spark, sf_dir, "documents").select(*textstats.length_features("text"))
    out = None
    for n, _ in _LEN:
        x = d.select(F.col(n).cast("double").alias(n))
        qs = [N.exact_quantile(x, n, p).alias(a) for p, a in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75"))]
        row = x.agg(F.count(n).alias("n"), r6(F.avg(n)).alias("mean"), r6(F.stddev_samp(n)).alias("std"),
                    F.min(n).alias("min"), F.max(n).alias("max"))
        row = row.select(F.lit(n).alias("feature"), "n", "mean", "std", "min", *qs, "max")
        out = row if out is None else out.unionByName(row)
    return out


# --- V8 into V9: distances of sentence vectors, zeros for texts without one -------------------
_TOK = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+', 0)"
_DOT = "list_sum(list_transform(range(1, len({0}) + 1), lambda i: {0}[i] * {1}[i]))"


@register("v8_v9_sentence_distances", f"""WITH {BENCH_VEC_SQL},
c AS (SELECT conv_id, turn, {_TOK} AS t FROM conversations),
tok AS (SELECT conv_id, turn, unnest(t) AS word FROM c),
ex AS (SELECT tok.conv_id, tok.turn, unnest(range(len(bv.vec))) AS dim, unnest(bv.vec) AS x FROM tok JOIN bv USING (word)),
s AS (SELECT conv_id, turn, dim, sum(x) AS s FROM ex GROUP BY ALL),
sv AS (SELECT conv_id, turn, list(s ORDER BY dim) AS v FROM s GROUP BY ALL),
u AS (SELECT conv_id, turn, list_transform(v, lambda x: x / sqrt({_DOT.format('v', 'v')})) AS v FROM sv),
z AS (SELECT c.conv_id, c.turn, coalesce(u.v, list_transform(range(4), lambda i: 0.0::DOUBLE)) AS v FROM c LEFT JOIN u USING (conv_id, turn)),
p AS (SELECT a.conv_id, a.turn, a.v AS v, b.v AS w FROM z a JOIN z b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)
SELECT conv_id, turn, round(CASE WHEN {_DOT.format('v', 'v')} > 0 AND {_DOT.format('w', 'w')} > 0
  THEN 1.0 - {_DOT.format('v', 'w')} / (sqrt({_DOT.format('v', 'v')}) * sqrt({_DOT.format('w', 'w')})) END, 5) AS cosine_distance FROM p""")
def v8_v9_sentence_distances(spark, sf_dir):
    """Cosine distance between the sentence vectors of consecutive turns."""
    c = read_table(spark, sf_dir, "conversations").withColumn("k", F.struct("conv_id", "turn"))
    sv = S.sentence_vectors(c, "k", T.words("text"), _benchmark_vectors(spark, sf_dir))
    zero = F.array_repeat(F.lit(0.0), 4)
    z = c.select("k").join(sv, "k", "left").select("k.conv_id", "k.turn", F.coalesce("vec", zero).alias("v"))
    nxt = z.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("v").alias("w"))
    return z.join(nxt, ["conv_id", "turn"]).select("conv_id", "turn", F.round(cosine_distance("v", "w"), 5).alias("cosine_distance"))


# --- F8 / F9 over lexicon tables ---------------------------------------------------------------
_BENCH_WORDS = f"SELECT unnest({ws_split('text')}) AS w FROM benchmark"
_TURN_WORDS = f"SELECT unnest({ws_split('text')}) AS w FROM conversations"
_UNION_SQL = f"""SELECT lower(regexp_replace(w, {q(clean.NON_WORD_RUN)}, ' ', 'g')) AS term
FROM (SELECT w FROM ({_BENCH_WORDS}) UNION SELECT w FROM ({_TURN_WORDS}))"""


def _lexicon(spark, sf_dir):
    table = lambda name: explode_rows(read_table(spark, sf_dir, name), [], T.whitespace_split("text"), "w")
    return C.lexicon_union([table("benchmark"), table("conversations")])


@register("f8_lexicon_union", _UNION_SQL)
def f8_lexicon_union(spark, sf_dir):
    """Two word tables of any size made one lexicon."""
    return _lexicon(spark, sf_dir)


@register("f9_lexicon_table_matrix", f"""WITH lex AS ({_UNION_SQL}),
d AS (SELECT DISTINCT doc_id, unnest({_TOK}) AS term FROM documents)
SELECT doc_id, term FROM d SEMI JOIN lex USING (term)""")
def f9_lexicon_table_matrix(spark, sf_dir):
    """Lexicon terms that occur as tokens of each document, by a join with the table."""
    d = read_table(spark, sf_dir, "documents")
    return C.lexicon_token_matrix(d, "doc_id", T.words("text"), _lexicon(spark, sf_dir)).select("doc_id", "term")
