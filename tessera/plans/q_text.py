"""Text queries: cleaning (P), tokens (T) and text statistics (F) over ``documents``."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import clean, rules as R, textstats, tokens as T
from ..operators import corpus as C
from ..sources.tables import read_table
from .catalog import register
from .sqlfrag import fold_rules, q, str_list, ws_split

TOKEN_SQL = q(T.TOKEN)
WORD_SQL = q(T.WORD)


def _docs(spark, sf_dir):
    return read_table(spark, sf_dir, "documents")


def _text_query(name, col_fn, sql_expr):
    sql = f"SELECT doc_id, {sql_expr} AS text FROM documents" if sql_expr else None

    @register(name, sql)
    def run(spark, sf_dir):
        return _docs(spark, sf_dir).select("doc_id", col_fn(F.col("text")).alias("text"))
    run.__name__ = name
    return run


# --- P: cleaning ----------------------------------------------------------------
_text_query("p1_lowercase", clean.lowercase, "lower(text)")
_text_query("p2_unidecode", clean.strip_non_ascii, r"regexp_replace(text, '[^\x00-\x7F]', '', 'g')")
_text_query("p3_remove_nonalpha", clean.remove_nonalpha,
            f"regexp_replace(text, {q(clean.NON_WORD_RUN)}, ' ', 'g')")
_text_query("p5_concat_words", lambda c: clean.concat_words(T.tokenize(c)),
            f"array_to_string(regexp_extract_all(text, {TOKEN_SQL}, 0), ' ')")
_text_query("p7_text_to_wordlist", clean.text_to_wordlist,
            f"translate({fold_rules('text', R.WORDLIST_RULES)}, {q(R.WORDLIST_DROP_CHARS)}, '')")
_text_query("p8_replace_contractions", clean.replace_contractions,
            fold_rules("text", R.CONTRACTIONS))
_text_query("p9_basic_cleaning", clean.basic_cleaning,
            f"array_to_string(list_filter({ws_split('lower(text)')}, "
            f"lambda x: NOT list_contains({str_list(R.BASIC_STOPWORDS)}, x)), ' ')")
_text_query("p12_normalize_text", clean.normalize_text,
            fold_rules(f"translate(lower(text), {q(clean.LATIN_FOLD_FROM)}, {q(clean.LATIN_FOLD_TO)})",
                       R.CONTRACTIONS[:-2]))
_text_query("p13_reverse_words", clean.reverse_words,
            "array_to_string(list_reverse(string_split(text, ' ')), ' ')")
# P6 and P10 end in a back-reference rule RE2 cannot run; the twin applies rules 1-16
# in SQL and the elongation rule on character islands (a maximal run of 3+ equal
# characters other than a newline becomes the character and " <ELONG>").
def _glove_sql(tail=lambda e: e):
    pre = fold_rules("text", R.GLOVE_RULES_REFERENCE[:-1])
    return f"""WITH t AS (SELECT doc_id, {pre} AS s FROM documents),
ch AS (SELECT doc_id, s, unnest(range(1, length(s) + 1)) AS i FROM t),
c AS (SELECT doc_id, i, substring(s, i, 1) AS c FROM ch),
g AS (SELECT doc_id, i, c, i - row_number() OVER (PARTITION BY doc_id, c ORDER BY i) AS grp FROM c),
runs AS (SELECT doc_id, c, min(i) AS st, count(*) AS n FROM g GROUP BY doc_id, c, grp),
pieces AS (SELECT doc_id, st, CASE WHEN n >= 3 AND c <> chr(10) THEN c || ' <ELONG>' ELSE repeat(c, CAST(n AS BIGINT)) END AS piece FROM runs),
agg AS (SELECT doc_id, string_agg(piece, '' ORDER BY st) AS text FROM pieces GROUP BY doc_id),
out AS (SELECT d.doc_id, coalesce(agg.text, '') AS text FROM documents d LEFT JOIN agg USING (doc_id))
SELECT doc_id, {tail('text')} AS text FROM out"""


_wl = lambda e: f"translate({fold_rules(e, R.WORDLIST_RULES)}, {q(R.WORDLIST_DROP_CHARS)}, '')"
register("p6_glove_preprocess", _glove_sql())(
    lambda spark, sf_dir: _docs(spark, sf_dir).select("doc_id", clean.glove_preprocess("text").alias("text")))
register("p10_wordlist_clean", _glove_sql(_wl))(
    lambda spark, sf_dir: _docs(spark, sf_dir).select("doc_id", clean.wordlist_clean("text").alias("text")))

# RE2 has no back-references, so the twin works on character islands.
P4_SQL = r"""
WITH ch AS (
  SELECT doc_id, text, unnest(range(1, length(text) + 1)) AS i FROM documents
), c AS (
  SELECT doc_id, i, substring(text, i, 1) AS c FROM ch
), g AS (
  SELECT doc_id, i, c, i - row_number() OVER (PARTITION BY doc_id, c ORDER BY i) AS grp FROM c
), k AS (
  SELECT doc_id, i, c, row_number() OVER (PARTITION BY doc_id, c, grp ORDER BY i) AS r FROM g
), agg AS (
  SELECT doc_id, string_agg(c, '' ORDER BY i) AS t FROM k WHERE r <= 2 GROUP BY doc_id
)
SELECT d.doc_id, coalesce(agg.t, '') AS text FROM documents d LEFT JOIN agg USING (doc_id)
"""


@register("p4_repair_words", P4_SQL)
def p4_repair_words(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", clean.repair_words("text").alias("text"))


# The tables hold no null text, so nulls are injected by rule (German rows).
@register("p11_fill_null_text",
          "SELECT doc_id, coalesce(CASE WHEN lang = 'de' THEN NULL ELSE text END, 'CVxTz') AS text "
          "FROM documents")
def p11_fill_null_text(spark, sf_dir):
    d = _docs(spark, sf_dir)
    injected = F.when(F.col("lang") == "de", F.lit(None)).otherwise(F.col("text"))
    return d.select("doc_id", clean.fill_null_text(injected).alias("text"))


# Canonical forms of a few corpus words (token mode; None = keep the word).
CANONICAL = {"the": "THE", "und": "and", "der": None, "les": "the", "que": "what",
             "los": "the", "die": None, "des": "of the", "von": "from", "une": "a"}


def _canon_sql(tok: str) -> str:
    arms = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in CANONICAL.items() if v is not None)
    return f"CASE {tok} {arms} ELSE {tok} END"


@register("p14_lexicon_replace_tokens",
          f"SELECT doc_id, array_to_string(list_transform({ws_split('lower(text)')}, "
          f"lambda t: {_canon_sql('t')}), ' ') AS text FROM documents")
def p14_lexicon_replace_tokens(spark, sf_dir):
    from ..operators.lexicon import replace_tokens
    d = _docs(spark, sf_dir)
    return d.select("doc_id", F.array_join(
        replace_tokens(T.whitespace_split(F.lower("text")), CANONICAL), " ").alias("text"))


# --- T: tokens --------------------------------------------------------------------
@register("t1_tokenize",
          f"SELECT doc_id, CAST(len(regexp_extract_all(text, {TOKEN_SQL}, 0)) AS BIGINT) AS n_tokens, "
          f"array_to_string(regexp_extract_all(text, {TOKEN_SQL}, 0), '|') AS tokens FROM documents")
def t1_tokenize(spark, sf_dir):
    tok = T.tokenize("text")
    return _docs(spark, sf_dir).select("doc_id", F.size(tok).cast("bigint").alias("n_tokens"),
                                       F.array_join(tok, "|").alias("tokens"))


@register("t2_words",
          f"SELECT doc_id, array_to_string(regexp_extract_all(lower(text), {WORD_SQL}, 0), '|') AS words "
          "FROM documents")
def t2_words(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.array_join(T.words("text"), "|").alias("words"))


T3_SQL = f"""
WITH t AS (SELECT doc_id, regexp_extract_all(text, {TOKEN_SQL}, 0) AS tok FROM documents)
SELECT doc_id, CAST(len(g) AS BIGINT) AS n_grams, array_to_string(g, '|') AS grams FROM (
  SELECT doc_id, list_transform(range(0, len(tok) - 1), lambda i: array_to_string(tok[i + 1:i + 2], ' ')) AS g
  FROM t)
"""


@register("t3_ngrams", T3_SQL)
def t3_ngrams(spark, sf_dir):
    g = T.ngrams(T.tokenize("text"), 2)
    return _docs(spark, sf_dir).select("doc_id", F.size(g).cast("bigint").alias("n_grams"),
                                       F.array_join(g, "|").alias("grams"))


T4_SQL = f"""
WITH t AS (SELECT doc_id, regexp_extract_all(text, {TOKEN_SQL}, 0) AS tok FROM documents),
g AS (SELECT doc_id, unnest(range(0, len(tok) - 1)) AS i, tok FROM t),
h AS (SELECT doc_id, i, tok[i + 1] || ' ' || tok[i + 2] AS gram,
      (((doc_id % 2147483648) + 2147483648) % 2147483648 * 2654435761 + i * 40503 + 1337) % 4294967296 AS hv FROM g),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY hv, i) AS rn FROM h),
s AS (SELECT doc_id, string_agg(gram, '|' ORDER BY i) AS sk FROM k WHERE rn <= 5 GROUP BY doc_id)
SELECT d.doc_id, coalesce(s.sk, '') AS skipgrams FROM documents d LEFT JOIN s USING (doc_id)
"""


@register("t4_skipgrams", T4_SQL)
def t4_skipgrams(spark, sf_dir):
    """Seeded sample of 5 bigrams per document, in document order."""
    g = T.skipgrams(T.tokenize("text"), 2, 5, seed=1337, row_key="doc_id", method="knuth")
    return _docs(spark, sf_dir).select("doc_id", F.array_join(g, "|").alias("skipgrams"))


@register("t5_chargram_counts",
          "SELECT g AS gram, CAST(count(*) AS BIGINT) AS cnt FROM (SELECT unnest(list_transform("
          "range(1, length(text) - 1), lambda i: substring(text, i, 3))) AS g FROM documents) GROUP BY g")
def t5_chargram_counts(spark, sf_dir):
    return C.chargram_counts(_docs(spark, sf_dir), "text", 3)


@register("t6_remove_stops",
          f"SELECT doc_id, array_to_string(list_filter(regexp_extract_all(lower(text), {WORD_SQL}, 0), "
          f"lambda x: NOT list_contains({str_list(R.ENGLISH_STOPWORDS)}, x)), ' ') AS text FROM documents")
def t6_remove_stops(spark, sf_dir):
    return _docs(spark, sf_dir).select(
        "doc_id", F.array_join(T.remove_stops(T.words("text")), " ").alias("text"))


T7_SQL = f"""
WITH tok AS (
  SELECT doc_id, list_filter(regexp_extract_all(text, {TOKEN_SQL}, 0),
                             lambda x: NOT list_contains({str_list(R.ENGLISH_STOPWORDS)}, x)) AS t
  FROM documents
), nd AS (SELECT count(*) AS n FROM tok),
dfreq AS (
  SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(t) AS term FROM tok) GROUP BY term
), keep AS (
  SELECT term FROM dfreq, nd WHERE df >= 3 AND df <= floor(0.75 * nd.n)
), pos AS (
  SELECT doc_id, unnest(t) AS term, unnest(range(len(t))) AS p FROM tok
), kept AS (
  SELECT doc_id, string_agg(term, ' ' ORDER BY p) AS txt FROM pos SEMI JOIN keep USING (term) GROUP BY doc_id
)
SELECT tok.doc_id, coalesce(kept.txt, '') AS text FROM tok LEFT JOIN kept USING (doc_id)
"""


@register("t7_remove_extremes", T7_SQL)
def t7_remove_extremes(spark, sf_dir):
    d = _docs(spark, sf_dir).select("doc_id", T.remove_stops(T.tokenize("text")).alias("tok"))
    out = C.filter_extremes(d, "doc_id", "tok", no_below=3, no_above=0.75)
    return out.select("doc_id", F.array_join("tok", " ").alias("text"))


@register("t8_chop",
          f"SELECT doc_id, array_to_string(list_transform(regexp_extract_all(text, {TOKEN_SQL}, 0), "
          "lambda x: substring(x, 1, 4)), ' ') AS text FROM documents")
def t8_chop(spark, sf_dir):
    return _docs(spark, sf_dir).select(
        "doc_id", F.array_join(T.chop(T.tokenize("text"), 4), " ").alias("text"))


# --- F: statistics ----------------------------------------------------------------
_ALPHA = r"length(regexp_replace(text, '\P{L}', '', 'g'))"
F1_SQL = f"""
SELECT doc_id, CAST(length(text) AS BIGINT) AS num_characters_0,
       CAST(len({ws_split('text')}) AS BIGINT) AS num_words_0,
       CAST(length(text) - length(replace(text, ' ', '')) AS BIGINT) AS num_spaces_0,
       CAST({_ALPHA} AS BIGINT) AS num_alpha_0,
       CAST(length(text) - {_ALPHA} AS BIGINT) AS num_nonalpha_0
FROM documents
"""


@register("f1_doc_features", F1_SQL)
def f1_doc_features(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", *textstats.doc_features("text"))


def _flags_sql():
    parts = [f"CAST(contains(lower(text), {q(w)}) AS INTEGER) AS {q('comment_' + w)[1:-1]}"
             for w in R.QUESTION_WORDS + R.FLAG_TERMS]
    return ",\n       ".join(parts)


F2_F6_SQL = f"""
SELECT doc_id,
       CAST(length(text) AS BIGINT) AS len_q1,
       CAST(length(replace(text, ' ', '')) AS BIGINT) AS len_char_q1,
       CAST(len({ws_split('text')}) AS BIGINT) AS len_word_q1,
       CAST(row_number() OVER (PARTITION BY text ORDER BY doc_id) > 1 AS INTEGER) AS duplicated,
       {_flags_sql()},
       CAST(count(*) OVER (PARTITION BY text) AS BIGINT) AS comment_freq,
       CAST({' + '.join(f"CAST(contains(lower(text), {q(w)}) AS INTEGER)" for w in R.FLAG_TERMS)} AS BIGINT)
         AS selected_badwords_sum
FROM documents
"""


@register("f2_f6_text_statistics", F2_F6_SQL)
def f2_f6_text_statistics(spark, sf_dir):
    """Lengths, duplicate ordinal, question-word and term flags, text frequency and
    the flag sum (the text-statistics feature block)."""
    d = _docs(spark, sf_dir).select("doc_id", "text")
    d = C.duplicate_features(d, "text", "doc_id")
    flags = [f"comment_{w}" for w in R.FLAG_TERMS]
    return d.select("doc_id", *textstats.text_statistics("text"), "duplicated", "comment_freq") \
        .withColumn("selected_badwords_sum", textstats.flag_sum(flags))


@register("f7_word_weights",
          f"SELECT word, CAST(count(*) AS BIGINT) AS count, "
          f"round(CASE WHEN count(*) < 2 THEN 0.0 ELSE 1.0 / (count(*) + 10000.0) END, 12) AS weight "
          f"FROM (SELECT unnest({ws_split('lower(text)')}) AS word FROM documents) GROUP BY word")
def f7_word_weights(spark, sf_dir):
    d = _docs(spark, sf_dir)
    w = C.word_weights(d, T.whitespace_split(F.lower("text")))
    return w.select("word", "count", F.round("weight", 12).alias("weight"))


# Lexicon lists built from corpus words (literal in both engines); F8's union
# -> distinct -> \W+ to space -> lower happens when the plan is built.
LEXICON_LISTS = [
    ["the", "and", "der", "that", "for", "was", "die", "with"],
    ["que", "des", "und", "this", "are", "from", "les", "den", "von"],
    ["tion", "ing", "ble", "das", "une", "los", "mit", "sich", "than", "auf", "del"],
    ["pour", "est", "las", "qui", "für", "ein", "token", "password", "of the", "in-the", "THE"],
]


def lexicon_terms():
    import re
    merged = sorted(set(w for lst in LEXICON_LISTS for w in lst))
    # de-duplicate first, then clean: a cleaned duplicate is kept, as in the reference
    return [re.sub(r"\W+", " ", w).lower() for w in merged]


def _clean_doc_sql():
    return f"lower(regexp_replace(text, {q(clean.NON_WORD_RUN)}, ' ', 'g'))"


def _lex_values():
    return ", ".join(f"({q(t)})" for t in lexicon_terms())


F9_SQL = f"""
SELECT d.doc_id, lex.term FROM (SELECT doc_id, {_clean_doc_sql()} AS t FROM documents) d,
  (VALUES {_lex_values()}) lex(term) WHERE contains(d.t, lex.term)
"""


def _clean_docs(spark, sf_dir):
    # materialized once: the lexicon test reads it once per term
    return _docs(spark, sf_dir).select("doc_id", F.lower(clean.remove_nonalpha("text")).alias("t"))


def _lexicon_matrix(spark, sf_dir):
    return C.lexicon_matrix(_clean_docs(spark, sf_dir), "doc_id", F.col("t"), lexicon_terms())


@register("f9_lexicon_matrix", F9_SQL)
def f9_lexicon_matrix(spark, sf_dir):
    return _lexicon_matrix(spark, sf_dir)


@register("f10_top_lexicon_terms",
          f"SELECT term, CAST(count(*) AS BIGINT) AS n FROM ({F9_SQL}) GROUP BY term "
          "ORDER BY n DESC, term LIMIT 300 OFFSET 3")
def f10_top_lexicon_terms(spark, sf_dir):
    return C.top_terms(_lexicon_matrix(spark, sf_dir), skip=3, k=300)


@register("f11_lexicon_count",
          f"SELECT doc_id, CAST(len(list_filter({str_list(lexicon_terms())}, lambda w: contains(t, w))) "
          f"AS BIGINT) AS badwords_count FROM (SELECT doc_id, {_clean_doc_sql()} AS t FROM documents)")
def f11_lexicon_count(spark, sf_dir):
    d = _clean_docs(spark, sf_dir)
    return d.select("doc_id", F.size(C.lexicon_hits(F.col("t"), lexicon_terms())).cast("bigint")
                    .alias("badwords_count"))
