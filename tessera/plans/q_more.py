"""Remaining inventory rows: readability (F12), lexicon-table lemmas, stems and tags
(T9-T11), md5 hash encoding (A2), feature hashing (A3), seeded noise (A8), column
pickers (P16, P17) and keyterm PageRank (F15)."""
from __future__ import annotations

from pyspark.ml.feature import FeatureHasher
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ..functions.stemming import stem
from ..functions import readability as RD, rules as R, tokens as T
from ..functions.arrays import explode_rows
from ..operators import encoders as A, lexicon as LX
from ..operators.graph import keyterm_scores
from ..session import reliable_checkpoint
from ..sources.tables import read_table
from . import q_vectors  # noqa: F401  (its twins are used below)
from .catalog import ORACLE_SQL, register
from .q_models import LABELS, MODELS
from .sqlfrag import keyed_normal_sql, str_list, ws_split


def _docs(spark, sf_dir):
    return read_table(spark, sf_dir, "documents")


def _readability_sql():
    words = f"list_filter({ws_split('text')}, lambda w: regexp_matches(w, '\\p{{L}}'))"
    syl = f"list_transform({words}, lambda w: greatest(1, len(regexp_extract_all(lower(w), '[aeiouy]+', 0))))"
    return f"""WITH c AS (SELECT doc_id,
  greatest(1, len(regexp_extract_all(text, '[.!?]+', 0)))::DOUBLE AS S, len({words})::DOUBLE AS W,
  coalesce(list_sum({syl}), 0)::DOUBLE AS Y, length(regexp_replace(text, '\\P{{L}}', '', 'g'))::DOUBLE AS L,
  len(list_filter({syl}, lambda x: x >= 3))::DOUBLE AS P FROM documents),
s AS (SELECT doc_id, W,
  206.835 - 1.015 * (W / S) - 84.6 * (Y / W) AS fre, 1.043 * sqrt(P * (30.0 / S)) + 3.1291 AS smog,
  0.39 * (W / S) + 11.8 * (Y / W) - 15.59 AS fk, 0.0588 * (L / W * 100.0) - 0.296 * (S / W * 100.0) - 15.8 AS cli,
  4.71 * (L / W) + 0.5 * (W / S) - 21.43 AS ari, 0.4 * ((W / S) + 100.0 * P / W) AS fog,
  CASE WHEN ((W - P) + 3.0 * P) / S > 20 THEN ((W - P) + 3.0 * P) / S / 2.0 ELSE (((W - P) + 3.0 * P) / S - 2.0) / 2.0 END AS lin
  FROM c),
g AS (SELECT doc_id, unnest([round(fk, 0), round(cli, 0), round(ari, 0), round(smog, 0), round(fog, 0), round(lin, 0)]) AS grade
  FROM s WHERE W > 0),
m AS (SELECT doc_id, arg_min(grade, -n * 1000000 + grade) AS mode FROM (SELECT doc_id, grade + 0.0 AS grade, count(*) AS n FROM g GROUP BY ALL) GROUP BY doc_id)
SELECT doc_id, {', '.join(f'round(CASE WHEN W > 0 THEN {e} END, 6) AS {n}' for n, e in (
        ('flesch_reading_ease', 'fre'), ('smog_index', 'smog'), ('flesch_kincaid_grade', 'fk'),
        ('coleman_liau_index', 'cli'), ('automated_readability_index', 'ari'), ('linsear_write_formula', 'lin'),
        ('gunning_fog', 'fog')))}, m.mode AS text_standard
FROM s LEFT JOIN m USING (doc_id)"""


@register("f12_readability", _readability_sql())
def f12_readability(spark, sf_dir):
    d = _docs(spark, sf_dir).select("doc_id", RD.counts("text").alias("c"))
    out = d.select("doc_id", *RD.scores(F.col("c")))
    return out.select("doc_id", *[F.round(c, 6).alias(c) if c != "text_standard" else F.col(c)
                                  for c in out.columns if c != "doc_id"])


# Lemma table derived from the corpus: plural-looking words -> singular
def _lemma_table(spark, sf_dir):
    d = _docs(spark, sf_dir)
    w = explode_rows(d, [], T.words("text"), "token").distinct()
    return w.where(F.col("token").endswith("s") & (F.length("token") > 3)).select(
        "token", F.expr("substring(token, 1, length(token) - 1)").alias("lemma"))


_LEM_SQL = f"""WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+', 0)) AS token FROM documents),
lem AS (SELECT token, substring(token, 1, length(token) - 1) AS lemma FROM w WHERE suffix(token, 's') AND length(token) > 3),
pos AS (SELECT doc_id, unnest(t) AS token, unnest(range(len(t))) AS p FROM
        (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+', 0) AS t FROM documents)),
r AS (SELECT doc_id, p, coalesce(lem.lemma, pos.token) AS lemma FROM pos LEFT JOIN lem USING (token)),
k AS (SELECT doc_id, string_agg(lemma, ' ' ORDER BY p) AS txt FROM r
      WHERE NOT list_contains({str_list(R.ENGLISH_STOPWORDS)}, lemma) AND length(lemma) > 0 GROUP BY doc_id)
SELECT d.doc_id, coalesce(k.txt, '') AS text FROM documents d LEFT JOIN k USING (doc_id)"""


@register("t10_lemmatize_by_table", _LEM_SQL)
def t10_lemmatize_by_table(spark, sf_dir):
    """Tokens mapped through a (token, lemma) table, stop lemmas removed, order kept."""
    d = _docs(spark, sf_dir).select("doc_id", T.words("text").alias("tok"))
    stops = spark.createDataFrame([(w,) for w in R.ENGLISH_STOPWORDS], "w string")
    out = LX.map_tokens_by_table(d, "doc_id", "tok", _lemma_table(spark, sf_dir), "token", "lemma",
                                 drop=stops, drop_col="w")
    return out.select("doc_id", F.array_join("tok", " ").alias("text"))


@register("t9_stem_by_table", _LEM_SQL.replace(
    f"WHERE NOT list_contains({str_list(R.ENGLISH_STOPWORDS)}, lemma) AND length(lemma) > 0", "WHERE length(lemma) > 0"))
def t9_stem_by_table(spark, sf_dir):
    """Stemming re-aimed as a vocabulary job: distinct tokens -> (token, stem) table ->
    join back (the table here strips a plural s; Porter2 is below)."""
    d = _docs(spark, sf_dir).select("doc_id", T.words("text").alias("tok"))
    out = LX.map_tokens_by_table(d, "doc_id", "tok", _lemma_table(spark, sf_dir), "token", "lemma")
    return out.select("doc_id", F.array_join("tok", " ").alias("text"))


@register("t9_stem_porter2")
def t9_stem_porter2(spark, sf_dir):
    """Porter2 stems: the algorithm runs once per distinct token, the table is joined back."""
    d = _docs(spark, sf_dir).select("doc_id", T.words("text").alias("tok"))
    # stored: in one plan with the lookup the stems would be worked out before the tokens are distinct
    vocab = reliable_checkpoint(explode_rows(d, [], F.col("tok"), "token").distinct())
    out = LX.map_tokens_by_table(d, "doc_id", "tok", vocab.select("token", stem("token").alias("stem")), "token", "stem")
    return out.select("doc_id", F.array_join("tok", " ").alias("text"))


def _tag_expr_sql(t):
    return (f"CASE WHEN regexp_full_match({t}, '\\p{{N}}+') THEN 'NUM' WHEN list_contains({str_list(R.ENGLISH_STOPWORDS)}, {t}) "
            f"THEN 'STOP' ELSE 'WORD' END")


@register("t11_tag_tokens", f"""WITH pos AS (SELECT doc_id, unnest(t) AS token, unnest(range(len(t))) AS p FROM
  (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+', 0) AS t FROM documents)),
k AS (SELECT doc_id, string_agg({_tag_expr_sql('token')}, ' ' ORDER BY p) AS tags FROM pos GROUP BY doc_id)
SELECT d.doc_id, coalesce(k.tags, '') AS tags FROM documents d LEFT JOIN k USING (doc_id)""")
def t11_tag_tokens(spark, sf_dir):
    """Tag arrays in token order from a (token, tag) lexicon table (here built from the
    corpus vocabulary by rule: number, stop word, word)."""
    d = _docs(spark, sf_dir).select("doc_id", T.words("text").alias("tok"))
    vocab = explode_rows(d, [], F.col("tok"), "token").distinct()
    tags = vocab.select("token", F.when(F.col("token").rlike(r"^\p{N}+$"), "NUM")
                        .when(F.col("token").isin(R.ENGLISH_STOPWORDS), "STOP").otherwise("WORD").alias("tag"))
    out = LX.map_tokens_by_table(d, "doc_id", "tok", tags, "token", "tag", out_col="tags")
    return out.select("doc_id", F.array_join("tags", " ").alias("tags"))


def _md5_mod_sql(v, n):
    half = lambda a: f"('0x' || substr(md5({v}), {a}, 16))::UBIGINT::HUGEINT"
    return f"((({half(1)} % {n}) * ({(1 << 64) % n}) + {half(17)} % {n}) % {n})"


@register("a2_hash_encode", f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
  CAST(({_md5_mod_sql('l_returnflag', 2)} = 0)::INT + ({_md5_mod_sql('l_linestatus', 2)} = 0)::INT AS BIGINT) AS col_0,
  CAST(({_md5_mod_sql('l_returnflag', 2)} = 1)::INT + ({_md5_mod_sql('l_linestatus', 2)} = 1)::INT AS BIGINT) AS col_1
FROM lineitem""")
def a2_hash_encode(spark, sf_dir):
    l = read_table(spark, sf_dir, "lineitem")
    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    return A.hash_encode(l, ["l_returnflag", "l_linestatus"], keep=key)


@register("a3_feature_hasher")
def a3_feature_hasher(spark, sf_dir):
    """Signed feature hashing of the categorical columns (Spark's FeatureHasher)."""
    l = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")
    fh = FeatureHasher(inputCols=["l_returnflag", "l_linestatus"], outputCol="h", numFeatures=2)
    return fh.transform(l).select("l_orderkey", "l_linenumber", vector_to_array("h").alias("hashed"))


@register("a3_signed_hashing", f"""WITH t AS (SELECT l_orderkey, l_linenumber, unnest(['l_returnflag=' || l_returnflag, 'l_shipdate=' || cast(l_shipdate as varchar)]) AS t FROM lineitem),
h AS (SELECT l_orderkey, l_linenumber, {_md5_mod_sql('t', 5)} AS p, CASE WHEN substr(md5(t), 32, 1) >= '8' THEN -1.0 ELSE 1.0 END AS s FROM t WHERE t IS NOT NULL)
SELECT l.l_orderkey, l.l_linenumber, {', '.join(f"(SELECT coalesce(sum(s), 0.0) FROM h WHERE h.l_orderkey = l.l_orderkey AND h.l_linenumber = l.l_linenumber AND p = {k}) AS h{k}" for k in range(5))}
FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) l""")
def a3_signed_hashing(spark, sf_dir):
    """Feature hashing with alternating signs into five places, summed per order line."""
    l = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_shipdate")
    h = A.signed_hash_features(l, ["l_returnflag", "l_shipdate"], 5, keep=["l_orderkey", "l_linenumber"])
    return h.groupBy("l_orderkey", "l_linenumber").agg(*[F.sum(F.col("hashed")[k]).alias(f"h{k}") for k in range(5)])


NOISE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


@register("a8_add_noise", f"""WITH p AS (SELECT avg(l_quantity) AS prior FROM lineitem),
e AS (SELECT l_partkey, avg(l_quantity) AS m, 1 / (1 + exp(-(count(*) - 20) / 5.0)) AS s FROM lineitem WHERE l_quantity IS NOT NULL GROUP BY l_partkey)
SELECT {', '.join(NOISE_KEY)}, l_extendedprice,
  round((prior * (1 - s) + m * s) * (1.0 + 0.001 * {keyed_normal_sql(7, *NOISE_KEY)}), 6) AS enc
FROM lineitem JOIN e USING (l_partkey), p""")
def a8_add_noise(spark, sf_dir):
    """Multiplicative seeded noise on a smoothed target encoding, keyed by the row."""
    l = read_table(spark, sf_dir, "lineitem")
    table = A.fit_target_encoding(l, "l_partkey", "l_quantity", 20, 5)
    out = A.apply_target_encoding(l.select(*NOISE_KEY, "l_extendedprice"), table, "l_partkey", "enc", noise_level=1e-3, seed=7,
                                  noise_key=NOISE_KEY, noise_method="md5")
    return out.select(*NOISE_KEY, "l_extendedprice", F.round("enc", 6).alias("enc"))


@register("p16_p17_pick_target_columns", f"""WITH s AS (SELECT doc_id, round(avg(CASE WHEN model = 0 THEN pred END), 6) AS toxic_preds_model0,
  round(avg(CASE WHEN model = 1 THEN pred END), 6) AS toxic_preds_model1, round(avg(CASE WHEN model = 2 THEN pred END), 6) AS toxic_preds_model2
  FROM (SELECT doc_id, model, 0.5 * toxic + 0.5 * (((doc_id * (7 + 3 * model) + 13 * fold) % 1000) + 1) / 1001.0 AS pred
        FROM (SELECT l.doc_id, l.toxic, CAST((row_number() OVER (PARTITION BY l.toxic + l.quality ORDER BY
        ((((doc_id % 2147483648) + 2147483648) % 2147483648 * 2654435761 + 1337) % 4294967296), l.doc_id) - 1) % 5 AS INTEGER) AS fold FROM labels l),
        (SELECT unnest([0, 1, 2]) AS model)) GROUP BY doc_id)
SELECT * FROM s""")
def p16_p17_pick_target_columns(spark, sf_dir):
    """The stacked matrix projected to the label's columns (names containing the
    label), sorted - a schema-level pick feeding ``select``."""
    from ..operators import ensemble as EN
    from .q_models import _oof
    oof = _oof(spark, sf_dir).where(F.col("split") == "train")
    m = EN.stack_matrix(oof, "doc_id", LABELS, MODELS)
    cols = EN.pick_target_columns(m.columns, "toxic")
    return m.select("doc_id", *[F.round(c, 6).alias(c) for c in cols])


@register("p17_feature_list", f"SELECT doc_id, comment_freq, num_alpha_0, num_words_0 FROM ({ORACLE_SQL['j4_feature_assembly']})")
def p17_feature_list(spark, sf_dir):
    """The assembled features without the targets, in sorted order."""
    from ..operators import ensemble as EN
    from .q_vectors import j4_feature_assembly
    x = j4_feature_assembly(spark, sf_dir)
    return x.select(*EN.feature_list(x.columns, LABELS))


F15_SQL = f"""WITH RECURSIVE tok AS (
  SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+', 0),
                             lambda x: NOT list_contains({str_list(R.ENGLISH_STOPWORDS)}, x)) AS t FROM documents),
pairs AS (SELECT doc_id, t[i] AS a, t[i + 1] AS b FROM (SELECT doc_id, t, unnest(range(1, len(t))) AS i FROM tok)
          WHERE t[i] <> t[i + 1]),
und AS (SELECT doc_id, a, b FROM pairs UNION ALL SELECT doc_id, b AS a, a AS b FROM pairs),
ew AS (SELECT doc_id, a, b, count(*)::DOUBLE AS w FROM und GROUP BY ALL),
edges AS (SELECT doc_id, a, b, w / sum(w) OVER (PARTITION BY doc_id, a) AS p FROM ew),
nodes AS (SELECT doc_id, a AS node, count(*) OVER (PARTITION BY doc_id)::DOUBLE AS n FROM (SELECT DISTINCT doc_id, a FROM edges)),
pr(it, doc_id, node, r) AS (
  SELECT 0, doc_id, node, 1.0 / n FROM nodes
  UNION ALL
  SELECT it, doc_id, node, (1 - 0.85) / n + 0.85 * s FROM (
    SELECT pr.it + 1 AS it, e.doc_id, e.b AS node, sum(e.p * pr.r) AS s FROM pr
    JOIN edges e ON e.doc_id = pr.doc_id AND e.a = pr.node WHERE pr.it < 10 GROUP BY pr.it, e.doc_id, e.b)
    JOIN nodes USING (doc_id, node)),
fin AS (SELECT doc_id, max(r) AS s FROM pr WHERE it = 10 GROUP BY doc_id)
SELECT d.doc_id, round(coalesce(fin.s, 0.0), 6) AS keyterm_score FROM documents d LEFT JOIN fin USING (doc_id)"""


@register("f15_keyterm_pagerank", F15_SQL)
def f15_keyterm_pagerank(spark, sf_dir):
    """Top PageRank score of each document's word co-occurrence graph (0 if none)."""
    d = _docs(spark, sf_dir).select("doc_id", T.remove_stops(T.words("text")).alias("tok"))
    out = keyterm_scores(d, "doc_id", "tok", iterations=10)
    return out.select("doc_id", F.round("keyterm_score", 6).alias("keyterm_score"))
