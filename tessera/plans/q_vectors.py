"""Vector-space and sequence queries: bag of words, TF-IDF, term statistics, pair
similarity, vector distances, vocabularies, padded id sequences, pooling, word-vector
tables and spelling repair (V, E, J4, J5, F13, F14, T12)."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import clean, rules as R, tokens as T
from ..functions.arrays import explode_rows
from ..functions.vectors import cosine_distance, hamming_distance, jaccard_distance, word_match_share
from ..operators import corpus as C, sequences as S, spelling as SP
from ..sources.tables import read_table, text_pairs
from ..sources.wordvec import DERIVED_VECTOR_SQL, derived_vectors
from .catalog import register
from .sqlfrag import keyed_normal_sql, q, str_list, ws_split

WORD_SQL = q(T.WORD)
KERAS_SQL = (f"list_filter(string_split(translate(lower(text), {q(R.KERAS_FILTERS)}, "
             f"{q(' ' * len(R.KERAS_FILTERS))}), ' '), lambda t: t <> '')")


def _docs(spark, sf_dir):
    return read_table(spark, sf_dir, "documents")


def r6(c):
    return F.round(c, 6)


# --- V1 / V2 ----------------------------------------------------------------------
VEC_TOKENS_SQL = f"list_filter(regexp_extract_all(lower(text), {WORD_SQL}, 0), lambda t: length(t) >= 2)"


@register("v1_bag_of_words", f"""SELECT doc_id, term, CAST(count(*) AS BIGINT) AS tf FROM (
  SELECT doc_id, unnest({VEC_TOKENS_SQL}) AS term FROM documents) GROUP BY doc_id, term""")
def v1_bag_of_words(spark, sf_dir):
    d = _docs(spark, sf_dir)
    return C.term_counts(d, "doc_id", T.vectorizer_words("text"))


_FOLD = f"translate(lower(text), {q(clean.LATIN_FOLD_FROM)}, {q(clean.LATIN_FOLD_TO)})"
V2_SQL = f"""
WITH tok AS (
  SELECT doc_id, list_filter(regexp_extract_all({_FOLD}, {WORD_SQL}, 0), lambda t: length(t) >= 2) AS t FROM documents
), grams AS (
  SELECT doc_id, t || list_transform(range(0, len(t) - 1), lambda i: t[i + 1] || ' ' || t[i + 2]) AS g FROM tok
), nd AS (SELECT count(*) AS n FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(g) AS term FROM grams) GROUP BY doc_id, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
voc AS (SELECT term, df FROM df, nd WHERE df >= 2 AND df <= floor(0.9 * nd.n)),
w AS (SELECT tf.doc_id, tf.term, (1 + ln(tf.tf)) * (ln((1 + nd.n) / (1 + voc.df)::DOUBLE) + 1) AS w
      FROM tf JOIN voc USING (term), nd)
SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM w
"""


@register("v2_tfidf", V2_SQL)
def v2_tfidf(spark, sf_dir):
    """Smoothed-idf, sublinear-tf, L2-normalised 1-2-gram TF-IDF (accents folded,
    min_df 2, max_df 0.9) as a long table."""
    d = _docs(spark, sf_dir).select("doc_id", T.vectorizer_words(clean.transliterate_latin(F.lower("text")))
                                    .alias("tok"))
    out = C.tfidf(d, "doc_id", T.ngram_range("tok", 1, 2), min_df=2, max_df=0.9, sublinear_tf=True)
    return out.select("doc_id", "term", r6("weight").alias("weight"))


# --- F13 / F14 ----------------------------------------------------------------------
F13_CORE = f"""tok AS (SELECT doc_id, {VEC_TOKENS_SQL} AS t FROM documents),
nd AS (SELECT count(*) AS n FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM tok) GROUP BY doc_id, term),
pt AS (SELECT term, count(*) AS df, sum(tf) AS cnt FROM tf GROUP BY term),
kept AS (SELECT pt.* FROM pt, nd WHERE df >= 2 AND df <= floor(0.95 * nd.n)),
st AS (SELECT term, df / nd.n::DOUBLE AS p, cnt / (SELECT sum(cnt) FROM kept)::DOUBLE AS term_freq FROM kept, nd),
stats AS (SELECT term, p AS doc_freq, term_freq,
  CASE WHEN p > 0 AND p < 1 THEN -(p * log2(p)) - (1 - p) * log2(1 - p) ELSE 0.0 END AS info_content FROM st)"""


@register("f13_term_statistics", f"""WITH {F13_CORE}
SELECT term, round(doc_freq, 6) AS doc_freq, round(term_freq, 9) AS term_freq, round(info_content, 6) AS info_content
FROM stats""")
def f13_term_statistics(spark, sf_dir):
    d = _docs(spark, sf_dir)
    st = C.term_statistics(d, "doc_id", T.vectorizer_words("text"), min_df=2, max_df=0.95)
    return st.select("term", r6("doc_freq").alias("doc_freq"), F.round("term_freq", 9).alias("term_freq"),
                     r6("info_content").alias("info_content"))


def _f14_sql():
    aggs = []
    for s, n in (("doc_freq", "docfreq"), ("term_freq", "termfreq"), ("info_content", "infocontent")):
        aggs.append(f"round(coalesce(max(coalesce(stats.{s}, 0.0)), 0.0), 9) AS q1_{n}_max")
        aggs.append(f"round(coalesce(avg(coalesce(stats.{s}, 0.0)), 0.0), 9) AS q1_{n}_mean")
    return f"""WITH {F13_CORE}, ex AS (SELECT doc_id, unnest(t) AS term FROM tok)
SELECT d.doc_id, {', '.join(aggs)} FROM documents d LEFT JOIN ex USING (doc_id) LEFT JOIN stats USING (term)
GROUP BY d.doc_id"""


@register("f14_term_statistic_features", _f14_sql())
def f14_term_statistic_features(spark, sf_dir):
    """Max / mean of df, tf and information content over each document's unigrams
    (the n-gram size applies to vocabulary and lookups alike)."""
    d = _docs(spark, sf_dir)
    toks = T.vectorizer_words("text")
    st = C.term_statistics(d, "doc_id", toks, min_df=2, max_df=0.95)
    out = C.term_statistic_features(d, "doc_id", toks, st)
    return out.select("doc_id", *[F.round(c, 9).alias(c) for c in out.columns if c != "doc_id"])


# --- V7 / V8 / V9 -----------------------------------------------------------------
def _wms_sql():
    side = lambda col: (f"list_distinct(list_filter({ws_split(f'lower({col})')}, "
                        f"lambda x: NOT list_contains({str_list(R.ENGLISH_STOPWORDS)}, x)))")
    return f"""WITH pr AS (
  SELECT a.conv_id, a.turn, {side('a.text')} AS qa, {side('b.text')} AS qb
  FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)
SELECT conv_id, turn, round(CASE WHEN len(qa) = 0 OR len(qb) = 0 THEN 0.0
  ELSE 2.0 * len(list_intersect(qa, qb)) / (len(qa) + len(qb)) END, 6) AS word_match_share FROM pr"""


@register("v7_word_match_share", _wms_sql())
def v7_word_match_share(spark, sf_dir):
    p = text_pairs(spark, sf_dir)
    return p.select("conv_id", "turn", r6(word_match_share("question1", "question2")).alias("word_match_share"))


def _benchmark_vectors(spark, sf_dir):
    b = read_table(spark, sf_dir, "benchmark")
    return derived_vectors(explode_rows(b, [], T.keras_words("text"), "word"))


BENCH_VEC_SQL = (f"bv AS (SELECT DISTINCT word, {DERIVED_VECTOR_SQL.format(w='word')} AS vec FROM "
                 f"(SELECT unnest({KERAS_SQL}) AS word FROM benchmark))")

_S2V_TOK = (f"list_filter(list_filter(regexp_extract_all(lower(text), {q(T.TOKEN)}, 0), "
            f"lambda x: NOT list_contains({str_list(R.ENGLISH_STOPWORDS)}, x)), lambda x: regexp_full_match(x, '\\p{{L}}+'))")


@register("v8_sent2vec", f"""WITH {BENCH_VEC_SQL},
tok AS (SELECT doc_id, unnest({_S2V_TOK}) AS word FROM documents),
ex AS (SELECT tok.doc_id, unnest(range(len(bv.vec))) AS dim, unnest(bv.vec) AS x FROM tok JOIN bv USING (word)),
s AS (SELECT doc_id, dim, sum(x) AS s FROM ex GROUP BY doc_id, dim)
SELECT doc_id, CAST(dim AS INTEGER) AS dim, round(s / sqrt(sum(s * s) OVER (PARTITION BY doc_id)), 6) AS value FROM s""")
def v8_sent2vec(spark, sf_dir):
    """Normalised sum of word vectors of alphabetic non-stop tokens, long form."""
    d = _docs(spark, sf_dir)
    toks = F.filter(T.remove_stops(T.tokenize(F.lower("text"))), lambda x: x.rlike(r"^\p{L}+$"))
    sv = S.sentence_vectors(d, "doc_id", toks, _benchmark_vectors(spark, sf_dir))
    return sv.select("doc_id", F.posexplode("vec").alias("dim", "value")).select(
        "doc_id", "dim", r6("value").alias("value"))


def _dist_sql():
    dot = lambda a, b: f"list_sum(list_transform(range(1, len({a}) + 1), lambda i: {a}[i] * {b}[i]))"
    return f"""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
pr AS (SELECT a.vec_id, a.v AS u, b.v AS w FROM e a JOIN e b ON b.vec_id = a.vec_id + 1),
m AS (SELECT vec_id, u, w, {dot('u', 'w')} AS uw, sqrt({dot('u', 'u')}) AS nu, sqrt({dot('w', 'w')}) AS nw,
  len(list_filter(range(1, len(u) + 1), lambda i: u[i] <> 0 OR w[i] <> 0)) AS nz,
  len(list_filter(range(1, len(u) + 1), lambda i: u[i] <> w[i] AND (u[i] <> 0 OR w[i] <> 0))) AS dj,
  len(list_filter(range(1, len(u) + 1), lambda i: u[i] <> w[i])) AS dh FROM pr)
SELECT vec_id, round(CASE WHEN nu > 0 AND nw > 0 THEN 1.0 - uw / (nu * nw) END, 6) AS cosine_distance,
  round(CASE WHEN nz > 0 THEN dj / nz::DOUBLE ELSE 0.0 END, 6) AS jaccard_distance,
  round(dh / len(u)::DOUBLE, 6) AS hamming_distance FROM m"""


@register("v9_distances", _dist_sql())
def v9_distances(spark, sf_dir):
    """Cosine, Jaccard and Hamming distance between consecutive embeddings."""
    e = read_table(spark, sf_dir, "embeddings").select(
        "vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    pairs = e.alias("a").join(e.alias("b"), F.col("b.vec_id") == F.col("a.vec_id") + 1).select(
        F.col("a.vec_id").alias("vec_id"), F.col("a.v").alias("u"), F.col("b.v").alias("w"))
    return pairs.select("vec_id", r6(cosine_distance("u", "w")).alias("cosine_distance"),
                        r6(jaccard_distance("u", "w")).alias("jaccard_distance"),
                        r6(hamming_distance("u", "w")).alias("hamming_distance"))


# --- E: vocabularies and sequences ------------------------------------------------
def _vocab_sql(tokens_sql: str) -> str:
    return f"""tok AS (SELECT doc_id, {tokens_sql} AS t FROM documents),
pos AS (SELECT doc_id, unnest(t) AS word, unnest(range(len(t))) AS p FROM tok),
cnt AS (SELECT word, count(*) AS c, min(doc_id * 100000000 + p) AS first FROM pos GROUP BY word),
voc AS (SELECT word, CAST(c AS BIGINT) AS count, CAST(row_number() OVER (ORDER BY c DESC, first) AS BIGINT) AS idx FROM cnt)"""


@register("e1_vocabulary", f"WITH {_vocab_sql(KERAS_SQL)} SELECT word, count, idx AS \"index\" FROM voc")
def e1_vocabulary(spark, sf_dir):
    d = _docs(spark, sf_dir).select("doc_id", T.keras_words("text").alias("tok"))
    return S.fit_vocabulary(d, "doc_id", "tok")


def _seq_sql(tokens_sql: str, num_words: int, maxlen: int) -> str:
    return f"""WITH {_vocab_sql(tokens_sql)},
s AS (SELECT pos.doc_id, list(voc.idx ORDER BY pos.p) AS seq FROM pos JOIN voc USING (word)
      WHERE voc.idx < {num_words} GROUP BY pos.doc_id),
a AS (SELECT d.doc_id, coalesce(s.seq, []::BIGINT[]) AS seq FROM documents d LEFT JOIN s USING (doc_id))
SELECT doc_id, array_to_string(CASE WHEN len(seq) >= {maxlen} THEN seq[len(seq) - {maxlen} + 1:]
  ELSE list_concat(list_transform(range({maxlen} - len(seq)), lambda i: 0::BIGINT), seq) END, ' ') AS seq FROM a"""


def _sequences(spark, sf_dir, tokens, num_words, maxlen):
    d = _docs(spark, sf_dir).select("doc_id", tokens.alias("tok"))
    vocab = S.fit_vocabulary(d, "doc_id", "tok")
    seqs = S.texts_to_sequences(d, "doc_id", "tok", vocab, num_words=num_words)
    return seqs.select("doc_id", S.pad_sequences("seq", maxlen).alias("seq"))


@register("e2_e3_padded_sequences", _seq_sql(KERAS_SQL, 2000, 50))
def e2_e3_padded_sequences(spark, sf_dir):
    out = _sequences(spark, sf_dir, T.keras_words("text"), 2000, 50)
    return out.select("doc_id", F.array_join("seq", " ").alias("seq"))


CHAR_SQL = "regexp_extract_all(lower(text), '(?s).', 0)"


@register("e4_char_sequences", _seq_sql(CHAR_SQL, 300000, 128))
def e4_char_sequences(spark, sf_dir):
    out = _sequences(spark, sf_dir, S.char_tokens("text"), 300000, 128)
    return out.select("doc_id", F.array_join("seq", " ").alias("seq"))


def _e5_sql():
    cols = ", ".join(f"CAST(string_split(seq, ' ')[{i + 1}] AS BIGINT) AS word{i}" for i in range(20))
    return f"SELECT doc_id, {cols} FROM ({_seq_sql(KERAS_SQL, 2000, 20)})"


@register("e5_token_columns", _e5_sql())
def e5_token_columns(spark, sf_dir):
    out = _sequences(spark, sf_dir, T.keras_words("text"), 2000, 20)
    return S.spread_columns(out, "seq", 20, keep=["doc_id"])


@register("e8_sequence_pooling", f"""WITH {BENCH_VEC_SQL},
tok AS (SELECT doc_id, unnest({KERAS_SQL}) AS word FROM documents),
ex AS (SELECT tok.doc_id, unnest(range(len(bv.vec))) AS dim, unnest(bv.vec) AS x FROM tok JOIN bv USING (word))
SELECT doc_id, CAST(dim AS INTEGER) AS dim, round(avg(x), 9) AS mean_pool, round(max(x), 6) AS max_pool
FROM ex GROUP BY doc_id, dim""")
def e8_sequence_pooling(spark, sf_dir):
    d = _docs(spark, sf_dir)
    pooled = S.pool_vectors(d, "doc_id", T.keras_words("text"), _benchmark_vectors(spark, sf_dir))
    z = pooled.select("doc_id", F.posexplode(F.arrays_zip("mean_pool", "max_pool")).alias("dim", "s"))
    return z.select("doc_id", "dim", F.round("s.mean_pool", 9).alias("mean_pool"), r6("s.max_pool").alias("max_pool"))


@register("j5_embedding_table", f"""WITH {_vocab_sql(KERAS_SQL)}, {BENCH_VEC_SQL}
SELECT v.idx AS "index", bv.vec IS NULL AS missing,
  {', '.join(f'round(coalesce(bv.vec[{i + 1}], 0.0), 6) AS v{i}' for i in range(4))}
FROM voc v LEFT JOIN bv USING (word) WHERE v.idx < 5000""")
def j5_embedding_table(spark, sf_dir):
    """Vocabulary (indices below 5000) left-joined to word vectors; misses are zeros."""
    d = _docs(spark, sf_dir).select("doc_id", T.keras_words("text").alias("tok"))
    vocab = S.fit_vocabulary(d, "doc_id", "tok")
    emb = S.embedding_table(vocab, _benchmark_vectors(spark, sf_dir), dim=4, nb_words=5000)
    return emb.select("index", "missing", *[r6(F.col("vec")[i]).alias(f"v{i}") for i in range(4)])


# --- J4: feature assembly ---------------------------------------------------------
@register("j4_feature_assembly", f"""WITH f1 AS (SELECT doc_id, CAST(len({ws_split('text')}) AS BIGINT) AS num_words_0 FROM documents),
f2 AS (SELECT doc_id, CAST(count(*) OVER (PARTITION BY text) AS BIGINT) AS comment_freq FROM documents),
f3 AS (SELECT doc_id, CAST(length(regexp_replace(text, '\\P{{L}}', '', 'g')) AS BIGINT) AS num_alpha_0 FROM documents)
SELECT doc_id, f1.num_words_0, f2.comment_freq, f3.num_alpha_0, l.toxic, l.quality
FROM f1 JOIN f2 USING (doc_id) JOIN f3 USING (doc_id) LEFT JOIN labels l USING (doc_id)""")
def j4_feature_assembly(spark, sf_dir):
    """Feature blocks computed separately and glued by key (not by position)."""
    from ..functions import textstats
    d = _docs(spark, sf_dir)
    b1 = d.select("doc_id", textstats.doc_features("text")[1])
    b2 = C.duplicate_features(d.select("doc_id", "text"), "text", "doc_id").select("doc_id", "comment_freq")
    b3 = d.select("doc_id", textstats.doc_features("text")[3])
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "toxic", "quality")
    return b1.join(b2, "doc_id").join(b3, "doc_id").join(labels, "doc_id", "left")


# --- T12 ------------------------------------------------------------------------------
def _one_byte(e: str) -> str:
    """DuckDB's edit distance counts bytes: the accented letters of lower-case words are
    put as capitals, which those words do not have."""
    accented = "äöüßéèêëàâçñíóáúìîïôûùœæ"
    return f"translate({e}, '{accented}', '{''.join(chr(65 + k) for k in range(len(accented)))}')"


def _has_others(x: str, w: str) -> str:
    """Every character of ``w`` (none of them a-z) is as often in ``x``: they cannot be put in."""
    return (f"len(list_filter(string_split({w}, ''), lambda c: c <> '' AND "
            f"length({w}) - length(replace({w}, c, '')) > length({x}) - length(replace({x}, c, '')))) = 0")


def _shorter(t: str) -> str:
    """(m, e): the words of ``t`` with up to two characters deleted."""
    one = f"SELECT m, i, left(m, i - 1) || substr(m, i + 1) AS e FROM (SELECT m, unnest(range(1, length(m) + 1)) AS i FROM {t})"
    return (f"SELECT m, m AS e FROM {t} UNION SELECT m, e FROM ({one}) UNION "
            f"SELECT m, left(e, j - 1) || substr(e, j + 1) FROM (SELECT m, e, unnest(range(i, length(e) + 1)) AS j FROM ({one}))")


@register("t12_spelling_correction", f"""WITH vw AS (
  SELECT unnest(regexp_extract_all(lower(text), {WORD_SQL}, 0)) AS w FROM documents),
vc AS (SELECT w, count(*) AS n FROM vw GROUP BY w),
voc AS (SELECT w AS word, row_number() OVER (ORDER BY n DESC, w) AS rank FROM vc),
cw AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), {WORD_SQL}, 0)) AS word FROM conversations),
known AS (SELECT word, word AS correction FROM cw SEMI JOIN voc USING (word)),
oov AS (SELECT word FROM cw ANTI JOIN voc USING (word)),
o1 AS (SELECT word, {_one_byte('word')} AS m FROM oov), v1 AS (SELECT *, {_one_byte('word')} AS m FROM voc),
ods AS ({_shorter('o1')}), vds AS ({_shorter('v1')}),
pairs AS (SELECT DISTINCT ods.m, vds.m AS k FROM ods JOIN vds USING (e)),
near AS (SELECT o.word, o.m, v.m AS k, v.word AS cand, v.rank, damerau_levenshtein(o.m, v.m) AS d,
           regexp_replace(o.m, '[a-z]', '', 'g') AS nx, regexp_replace(v.m, '[a-z]', '', 'g') AS nw
         FROM pairs JOIN o1 o ON pairs.m = o.m JOIN v1 v ON pairs.k = v.m WHERE damerau_levenshtein(o.m, v.m) <= 2),
enough AS (SELECT * FROM near WHERE {_has_others('nx', 'nw')}),
far AS (SELECT * FROM enough WHERE nw <> '' AND d = 2),
mids AS (SELECT m, regexp_replace(mid, '[a-z]', '', 'g') AS nm, mid FROM (
  SELECT m, unnest(list_concat(
    list_transform(range(1, length(m) + 1), lambda i: left(m, i - 1) || substr(m, i + 1)),
    list_transform(range(1, length(m)), lambda i: left(m, i - 1) || m[i + 1] || m[i] || substr(m, i + 2)),
    flatten(list_transform(range(0, length(m) + 1), lambda i: list_transform(range(97, 123), lambda c: left(m, i) || chr(c::INT) || substr(m, i + 1)))),
    flatten(list_transform(range(1, length(m) + 1), lambda i: list_transform(range(97, 123), lambda c: left(m, i - 1) || chr(c::INT) || substr(m, i + 1))))
  )) AS mid FROM (SELECT DISTINCT m FROM far))),
two AS (SELECT DISTINCT far.* FROM far JOIN mids ON far.m = mids.m
        WHERE damerau_levenshtein(mid, far.k) <= 1 AND {_has_others('nm', 'nw')}),
cand AS (SELECT word, cand, rank, d FROM enough WHERE nw = '' OR d = 1 UNION ALL SELECT word, cand, rank, d FROM two),
best AS (SELECT word, arg_min(cand, d * 100000000 + rank) AS correction FROM cand GROUP BY word)
SELECT word, correction FROM known
UNION ALL SELECT o.word, coalesce(b.correction, o.word) AS correction FROM oov o LEFT JOIN best b USING (word)""")
def t12_spelling_correction(spark, sf_dir):
    """Each distinct conversation word -> itself if known, else the most frequent
    known word one edit away, else two edits away, else itself.  Known words: all words
    of ``documents``."""
    ranks = SP.rank_table(_docs(spark, sf_dir), T.words("text"))
    conv = explode_rows(read_table(spark, sf_dir, "conversations"), [], T.words("text"), "word")
    return SP.correct_words(conv, ranks)


@register("e7_embedding_random_init", f"""WITH {_vocab_sql(KERAS_SQL)}, {BENCH_VEC_SQL}
SELECT v.idx AS "index", v.word, bv.vec IS NULL AS missing,
  {', '.join(f"round(coalesce(bv.vec[{i + 1}], (0.020940498 + 0.6441043 * {keyed_normal_sql(1337, 'v.word', str(i))})::REAL::DOUBLE), 4) + 0.0 AS v{i}" for i in range(4))}
FROM voc v LEFT JOIN bv USING (word) WHERE v.idx < 5000""")
def e7_embedding_random_init(spark, sf_dir):
    """Embedding rows for the vocabulary (indices below 5000) with seeded N(0.0209, 0.6441)
    draws for words without a vector; misses counted in ``missing``."""
    d = _docs(spark, sf_dir).select("doc_id", T.keras_words("text").alias("tok"))
    vocab = S.fit_vocabulary(d, "doc_id", "tok")
    emb = S.embedding_table(vocab, _benchmark_vectors(spark, sf_dir), dim=4, nb_words=5000,
                            random_init=(0.020940498, 0.6441043), seed=1337, method="md5")
    return emb.select("index", "word", "missing", *[F.round(F.col("vec")[i].cast("double"), 4).alias(f"v{i}") for i in range(4)])
