"""Nearest rows (N4), lexicon tables found anywhere in a text (F3, F9), blocks glued by
position (J4, S8), losses read from file names (M14), totally random trees (V10) and lags of
long panels (L3)."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import textstats, tokens as T
from ..functions.arrays import explode_rows
from ..functions.treebank import treebank_sql
from ..operators import corpus as C, knn, lags as L
from ..operators.trees import random_trees
from ..sources import files as IO
from ..sources.tables import read_table
from .catalog import register
from .q_models import K, _folds, STRAT_SQL
from .q_vectors import WORD_SQL
from .sqlfrag import ws_split


def r6(c):
    return F.round(c, 6)


# --- N4 -------------------------------------------------------------------------------
KNN_COLS = ["q", "d", "t", "p"]
KNN_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


def _knn_sql(k: int = 5):
    both = " + ".join(f"(a.{c} IS NOT NULL AND b.{c} IS NOT NULL)::INT" for c in KNN_COLS)
    far = " + ".join(f"coalesce((a.{c} - b.{c}) * (a.{c} - b.{c}), 0)" for c in KNN_COLS)
    one = " UNION ALL ".join(f"SELECT a.id, '{c}' AS col, ({far}) / ({both}) AS dist, b.{c} AS v, b.n FROM v a, v b "
                             f"WHERE a.{c} IS NULL AND b.{c} IS NOT NULL AND {both} > 0" for c in KNN_COLS)
    put = ", ".join(f"round(coalesce(r.{c}, (SELECT y FROM filled f WHERE f.id = v.id AND f.col = '{c}')), 6) AS {c}" for c in KNN_COLS)
    same = " AND ".join(f"r.{c} IS NOT DISTINCT FROM v.{c}" for c in KNN_COLS)
    return f"""WITH r AS (SELECT {', '.join(KNN_KEY)},
  CASE WHEN l_orderkey % 200 <> 0 THEN l_quantity::DOUBLE END AS q, CASE WHEN l_orderkey % 200 NOT IN (0, 7) THEN round(l_discount * 100)::DOUBLE END AS d,
  CASE WHEN l_partkey % 400 <> 3 THEN round(l_tax * 100)::DOUBLE END AS t, round(l_extendedprice / 100)::DOUBLE AS p FROM lineitem),
v AS (SELECT *, row_number() OVER () AS id FROM (SELECT q, d, t, p, count(*) AS n FROM r GROUP BY ALL)),
pairs AS ({one}),
g AS (SELECT id, col, dist, sum(n * v) AS s, sum(n) AS n FROM pairs GROUP BY id, col, dist),
c AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY id, col ORDER BY dist ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM g),
filled AS (SELECT id, col, sum(s / greatest(dist, 1e-6)) / sum(n / greatest(dist, 1e-6)) AS y FROM c WHERE before < {k} GROUP BY id, col)
SELECT {', '.join('r.' + c for c in KNN_KEY)}, {put} FROM r JOIN v ON {same}"""


@register("n4_impute_knn", _knn_sql())
def n4_impute_knn(spark, sf_dir):
    """Quantity, discount and tax, missing by rule, from the five nearest order lines."""
    l = read_table(spark, sf_dir, "lineitem")
    d = l.select(*KNN_KEY, F.when(F.col("l_orderkey") % 200 != 0, F.col("l_quantity").cast("double")).alias("q"),
                 F.when(~(F.col("l_orderkey") % 200).isin(0, 7), F.round(F.col("l_discount") * 100).cast("double")).alias("d"),
                 F.when(F.col("l_partkey") % 400 != 3, F.round(F.col("l_tax") * 100).cast("double")).alias("t"),
                 F.round(F.col("l_extendedprice") / 100).cast("double").alias("p"))
    out = knn.impute_knn(d, KNN_COLS, k=5)
    return out.select(*KNN_KEY, *[r6(c).alias(c) for c in KNN_COLS])


# --- F9 / F3: a lexicon table found anywhere -----------------------------------------------
@register("f9_substring_table_matrix", f"""WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), {WORD_SQL}, 0)) AS w FROM conversations),
t AS (SELECT DISTINCT substr(w, 2, 5) AS term FROM w WHERE length(w) >= 6 UNION SELECT DISTINCT substr(w, 1, 2) || ' ' AS term FROM w WHERE length(w) = 3
      UNION SELECT w AS term FROM w WHERE length(w) <= 2)
SELECT doc_id, term FROM documents JOIN t ON contains(lower(text), term)""")
def f9_substring_table_matrix(spark, sf_dir):
    """Document x term hits of some 10,000 terms taken from conversation words, found
    anywhere in the lower-cased text."""
    w = explode_rows(read_table(spark, sf_dir, "conversations"), [], T.words("text"), "w").distinct()
    n = F.length("w")
    term = (F.when(n >= 6, F.substring("w", 2, 5)).when(n == 3, F.concat(F.substring("w", 1, 2), F.lit(" "))).when(n <= 2, F.col("w")))
    lexicon = w.select(term.alias("term")).where(F.col("term").isNotNull())
    return C.lexicon_substring_matrix(read_table(spark, sf_dir, "documents"), "doc_id", F.lower("text"), lexicon)


# --- J4 / S8: by position --------------------------------------------------------------------
@register("j4_positional_glue", f"""SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS position, CAST(len({ws_split('text')}) AS BIGINT) AS num_words_0,
  CAST(length(regexp_replace(text, '\\P{{L}}', '', 'g')) AS BIGINT) AS num_alpha_0 FROM documents""")
def j4_positional_glue(spark, sf_dir):
    """Three feature blocks stored without a key, in files of different sizes, side by side."""
    d = read_table(spark, sf_dir, "documents")
    root = IO.scratch_dir(spark, "glue")
    f = d.select("doc_id", *textstats.doc_features("text"))
    IO.write_ordered(d.select("doc_id"), f"{root}/ids", ["doc_id"])
    IO.write_ordered(f.select("doc_id", "num_words_0"), f"{root}/words", ["doc_id"], drop=["doc_id"], rows_per_file=97)
    IO.write_ordered(f.select("doc_id", "num_alpha_0").repartition(3), f"{root}/alpha", ["doc_id"], drop=["doc_id"], rows_per_file=250)
    return IO.glue([IO.read_positions(spark, f"{root}/{b}") for b in ("ids", "words", "alpha")])


@register("s8_positional_submission", """SELECT o_orderkey AS id, round((row_number() OVER (ORDER BY o_orderkey) - 1) % 101 / 101.0, 6) AS toxic,
  round(o_totalprice / 1000.0, 6) AS quality FROM orders""")
def s8_positional_submission(spark, sf_dir):
    """Predictions without ids put into the sample submission's rows by position."""
    o = read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_totalprice")
    root = IO.scratch_dir(spark, "submission")
    IO.write_ordered(o, f"{root}/preds", ["id"], drop=["id"], rows_per_file=1111)
    IO.write_ordered(o.select("id"), f"{root}/sample", ["id"])
    both = IO.glue([IO.read_positions(spark, f"{root}/sample"), IO.read_positions(spark, f"{root}/preds")])
    return both.select("id", r6(F.col("position") % 101 / 101.0).alias("toxic"), r6(F.col("o_totalprice") / 1000.0).alias("quality"))


# --- M14: losses in file names -------------------------------------------------------------------
RUNS = {"gru": 1, "lstm": 2}


@register("m14_checkpoint_losses", f"""WITH f AS ({STRAT_SQL}), s AS (SELECT fold, avg(toxic) AS a, count(*) AS n FROM f GROUP BY fold),
r AS (SELECT unnest(['gru', 'lstm']) AS run, unnest([1, 2]) AS w), e AS (SELECT unnest([1, 2, 3]) AS epoch)
SELECT run, fold, count(*) AS n, min(round((a * w + 1.0 / n) / epoch, 4)) AS loss FROM s, r, e GROUP BY run, fold""")
def m14_checkpoint_losses(spark, sf_dir):
    """The least loss of every fold of two runs, from the names of their checkpoint files."""
    folds = _folds(spark, sf_dir).groupBy("fold").agg(F.avg("toxic").alias("a"), F.count(F.lit(1)).alias("n"))
    names = folds.select("fold", F.explode(F.array(*[F.struct(F.lit(r).alias("run"), F.lit(w).alias("w")) for r, w in RUNS.items()])).alias("r"), "a", "n")
    names = names.select("fold", "r.run", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("epoch"), "a", "n", "r.w")
    loss = F.format_string("%.4f", F.round((F.col("a") * F.col("w") + 1.0 / F.col("n")) / F.col("epoch"), 4))
    root = IO.scratch_dir(spark, "checkpoints")
    for r in names.select("run", "fold", "epoch", loss.alias("loss")).collect():     # runs x folds x epochs names
        IO.write_note(spark, f"{root}/{r['run']}/{r['run']}_fold_{r['fold']}_epoch_{r['epoch']}_{r['loss']}.txt", r["loss"])
        IO.write_note(spark, f"{root}/{r['run']}/{r['run']}_fold_{r['fold']}_best.h5", "weights")
    return IO.least_losses(IO.checkpoint_losses(IO.list_files(spark, root, "*.txt")))


# --- V10 -------------------------------------------------------------------------------------------
TREES, DEPTH = 4, 4


def _trees_sql():
    u = lambda key: f"((('0x' || substr(md5('1337|' || tree || '|' || node || '|' || {key}), 1, 13))::BIGINT::DOUBLE + 0.5) / {1 << 52}.0)"
    levels = "".join(f""",
g{l} AS (SELECT tree, node, k, min(x[k + 1]) AS lo, max(x[k + 1]) AS hi FROM r{l}, (SELECT unnest(range(3)) AS k) GROUP BY tree, node, k HAVING count(*) >= 2),
p{l} AS (SELECT tree, node, arg_min({{'k': k, 'lo': lo, 'hi': hi}}, {u('k')}) AS s FROM g{l} WHERE lo < hi GROUP BY tree, node),
r{l + 1} AS (SELECT id, x, r.tree, CASE WHEN s IS NULL THEN r.node ELSE 2 * r.node + CASE WHEN x[s.k + 1] <= s.lo + u * (s.hi - s.lo) THEN 1 ELSE 2 END END AS node
  FROM r{l} r LEFT JOIN (SELECT *, {u("'cut'")} AS u FROM p{l}) p ON r.tree = p.tree AND r.node = p.node)""" for l in range(DEPTH))
    leaves = ", ".join(f"CAST(max(CASE WHEN tree = {t} THEN node END) AS INTEGER) AS tree{t}" for t in range(TREES))
    return f"""WITH r0 AS (SELECT p_partkey AS id, [p_size::DOUBLE, CASE WHEN p_partkey % 9 <> 0 THEN p_retailprice::DOUBLE END, (p_partkey % 17)::DOUBLE] AS x,
  unnest(range({TREES})) AS tree, 0 AS node FROM part){levels}
SELECT id AS p_partkey, {leaves} FROM r{DEPTH} GROUP BY id"""


@register("v10_totally_random_trees", _trees_sql())
def v10_totally_random_trees(spark, sf_dir):
    """Leaves of random trees over three columns of the parts, one of them with nulls."""
    p = read_table(spark, sf_dir, "part").select("p_partkey", "p_size", F.when(F.col("p_partkey") % 9 != 0, F.col("p_retailprice")).alias("price"),
                                                 (F.col("p_partkey") % 17).alias("r"))
    out = random_trees(p, ["p_size", "price", "r"], n_trees=TREES, max_depth=DEPTH)
    return out.select("p_partkey", *[f"tree{t}" for t in range(TREES)])


# --- L3: incremental lags of a panel of any length ------------------------------------------------------
@register("l3_lags_long", """WITH p AS (SELECT o_orderkey, o_custkey AS customer_id, (year(o_orderdate) - 1995) * 12 + month(o_orderdate) - 1 + 40 * (o_orderkey % 2) AS date,
  o_totalprice AS target FROM orders),
m AS (SELECT customer_id, date, max(target) AS hi FROM p GROUP BY customer_id, date),
r AS (SELECT o_orderkey, customer_id, date, unnest(range(0, greatest(date - 60, 0))) AS lag FROM p WHERE date > 60)
SELECT r.o_orderkey, r.customer_id, r.date, CAST(r.lag AS INTEGER) AS lag, max(m.hi) AS target_lag
FROM r LEFT JOIN m ON m.customer_id = r.customer_id AND m.date <= 60 + r.lag GROUP BY ALL""")
def l3_lags_long(spark, sf_dir):
    """The running maximum up to every month from 60 on, one line per lag; by rule half of the
    orders lie 40 months later, so the panel goes on past month 79."""
    o = read_table(spark, sf_dir, "orders")
    date = ((F.year("o_orderdate") - 1995) * 12 + F.month("o_orderdate") - 1 + 40 * (F.col("o_orderkey") % 2)).cast("int")
    panel = o.select("o_orderkey", F.col("o_custkey").alias("customer_id"), date.alias("date"), F.col("o_totalprice").alias("target"))
    return L.lags_long(panel, 60, only_target=True, agg_func="max", keep=["o_orderkey"])


# --- E6: counted neighbourhoods -------------------------------------------------------------------------
WINDOW, PPMI_SHIFT, PPMI_LEAST = 3, 2.0, 60
CO_SQL = f"""tok AS (SELECT row_number() OVER () AS id, regexp_extract_all(lower(text), {WORD_SQL}, 0) AS t FROM conversations),
pl AS (SELECT t, unnest(range(1, len(t) + 1)) AS i FROM tok), d AS (SELECT unnest(range(1, {WINDOW + 1})) AS d),
one AS (SELECT t[i] AS a, t[i + d] AS b, 6 // d AS n FROM pl, d WHERE i + d <= len(t)),
co AS (SELECT a, b, CAST(sum(n) AS BIGINT) AS n FROM (SELECT a, b, n FROM one UNION ALL SELECT b, a, n FROM one) GROUP BY a, b)"""


def _cooccurrences(spark, sf_dir):
    from ..operators import cooccurrence as W
    return W.cooccurrences(read_table(spark, sf_dir, "conversations"), T.words("text"), WINDOW)


@register("e6_cooccurrence", f"WITH {CO_SQL} SELECT a, b, n FROM co WHERE n >= 12")
def e6_cooccurrence(spark, sf_dir):
    """Distance-weighted neighbours of the conversations' words (in sixths), those of two and more."""
    return _cooccurrences(spark, sf_dir).where("n >= 12")


@register("e6_ppmi", f"""WITH {CO_SQL}, s AS (SELECT a, sum(n) AS s FROM co GROUP BY a HAVING sum(n) >= {PPMI_LEAST}),
v AS (SELECT co.a, co.b, ln(n * (SELECT sum(s) FROM s)::DOUBLE / (x.s::DOUBLE * y.s)) - ln({PPMI_SHIFT}) AS p FROM co JOIN s x ON co.a = x.a JOIN s y ON co.b = y.a)
SELECT a, b, round(p, 6) AS ppmi FROM v WHERE p > 0""")
def e6_ppmi(spark, sf_dir):
    """Shifted positive PMI of words whose neighbourhoods weigh ten and more."""
    from ..operators import cooccurrence as W
    return W.shifted_ppmi(_cooccurrences(spark, sf_dir), PPMI_SHIFT, PPMI_LEAST).select("a", "b", r6("ppmi").alias("ppmi"))


@register("e6_ppmi_vectors")
def e6_ppmi_vectors(spark, sf_dir):
    """Word vectors of five dimensions from the PPMI table (directions: rows check)."""
    from ..operators import cooccurrence as W
    return W.word_vectors(W.shifted_ppmi(_cooccurrences(spark, sf_dir), PPMI_SHIFT, PPMI_LEAST), dim=5)


# --- T11: tags in context -----------------------------------------------------------------------------------
ARTICLES = ["the", "a", "la", "le", "der", "die", "de", "el"]
ENDINGS = ["ed", "ing", "er", "en", "ar", "ment"]


def _hmm_sql():
    arts, ends = (", ".join(f"'{x}'" for x in xs) for xs in (ARTICLES, ENDINGS))
    cost = lambda p: f"CAST(round(ln({p}) * 1000000) AS BIGINT)"
    return f"""WITH RECURSIVE tok AS (SELECT conv_id * 1000 + turn AS id, role, regexp_extract_all(lower(text), {WORD_SQL}, 0) AS t FROM conversations),
w AS (SELECT id, role, unnest(t) AS w, unnest(range(1, len(t) + 1)) AS i, t FROM tok),
tg AS (SELECT id, i, w, CASE WHEN list_contains([{arts}], w) THEN 'A' WHEN i > 1 AND list_contains([{arts}], t[i - 1]) THEN 'N'
  WHEN {' OR '.join(f"suffix(w, '{e}')" for e in ENDINGS)} THEN 'V' ELSE 'W' END AS tag FROM w WHERE role = 'user'),
names AS (SELECT DISTINCT tag FROM tg), nt AS (SELECT count(*) AS n FROM names), nv AS (SELECT count(DISTINCT w) AS n FROM tg),
st AS (SELECT coalesce(lag(tag) OVER (PARTITION BY id ORDER BY i), '') AS p, tag FROM tg),
sc AS (SELECT p, tag, count(*) AS n FROM st GROUP BY p, tag), sp AS (SELECT p, sum(n) AS n FROM sc GROUP BY p),
tr AS (SELECT a.p, b.tag, {cost('(coalesce(sc.n, 0) + 1) / (coalesce(sp.n, 0) + nt.n)::DOUBLE')} AS c
  FROM (SELECT tag AS p FROM names UNION ALL SELECT '') a CROSS JOIN names b CROSS JOIN nt LEFT JOIN sc ON sc.p = a.p AND sc.tag = b.tag LEFT JOIN sp ON sp.p = a.p),
tt AS (SELECT tag, count(*) AS n FROM tg GROUP BY tag), wc AS (SELECT w, tag, count(*) AS n FROM tg GROUP BY w, tag),
em AS (SELECT x.w, tt.tag, {cost('(coalesce(wc.n, 0) + 1) / (tt.n + nv.n + 1)::DOUBLE')} AS c
  FROM (SELECT DISTINCT w FROM w) x CROSS JOIN tt CROSS JOIN nv LEFT JOIN wc ON wc.w = x.w AND wc.tag = tt.tag),
v(id, i, tag, s, path) AS (
  SELECT w.id, w.i, em.tag, tr.c + em.c, [em.tag] FROM w JOIN em ON em.w = w.w JOIN tr ON tr.p = '' AND tr.tag = em.tag WHERE w.i = 1
  UNION ALL
  SELECT id, i, tag, m.s + c, list_append(m.path, tag) FROM (
    SELECT w.id, w.i, em.tag, em.c, min(struct_pack(s := -(v.s + tr.c), p := v.tag, path := v.path)) AS b FROM v JOIN w ON w.id = v.id AND w.i = v.i + 1
      JOIN em ON em.w = w.w JOIN tr ON tr.p = v.tag AND tr.tag = em.tag GROUP BY w.id, w.i, em.tag, em.c) x,
    LATERAL (SELECT -b.s AS s, b.path AS path) m),
best AS (SELECT v.id, min(struct_pack(s := -s, t := tag, path := path)).path AS path FROM v JOIN (SELECT id, max(i) AS n FROM w GROUP BY id) z ON z.id = v.id AND z.n = v.i GROUP BY v.id)
SELECT tok.id, coalesce(array_to_string(path, ' '), '') AS tags FROM tok LEFT JOIN best ON best.id = tok.id"""


@register("t11_tags_in_context", _hmm_sql())
def t11_tags_in_context(spark, sf_dir):
    """Tags of all turns by a model of the users' turns, which are tagged by a rule that looks at
    the word before."""
    from ..operators.tagging import fit_tagger, tag_in_context
    turns = read_table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "role", T.words("text").alias("tokens"))
    before = F.concat(F.array(F.lit("")), F.col("tokens"))
    rule = F.transform(F.arrays_zip(F.col("tokens").alias("w"), F.slice(before, 1, F.size("tokens")).alias("p")), lambda x: F.when(x["w"].isin(ARTICLES), "A")
                       .when(x["p"].isin(ARTICLES), "N").when(x["w"].rlike(f"({'|'.join(ENDINGS)})$"), "V").otherwise("W"))
    model = fit_tagger(turns.where("role = 'user'").select("tokens", rule.alias("tags")))
    return tag_in_context(turns, "id", "tokens", model).select("id", F.array_join("tags", " ").alias("tags"))


# --- P12: text repair ------------------------------------------------------------------------------------------
@register("p12_fix_unicode", "SELECT doc_id, text FROM documents")
def p12_fix_unicode(spark, sf_dir):
    """Texts of which a third is broken once and a third twice (UTF-8 read as Latin-1), repaired."""
    from ..operators.lexicon import repair_text
    broken = lambda c: F.decode(F.encode(c, "UTF-8"), "ISO-8859-1")
    t = F.col("text")
    d = read_table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, broken(t)).when(F.col("doc_id") % 3 == 1, broken(broken(t))).otherwise(t).alias("text"))
    return repair_text(d, "doc_id", "text")


# --- F12: scores by a table of easy words --------------------------------------------------------------------
@register("f12_difficult_words", f"""WITH tok AS (SELECT doc_id, text, regexp_extract_all(lower(text), {WORD_SQL}, 0) AS t FROM documents),
easy AS (SELECT w FROM (SELECT unnest(t) AS w FROM tok) GROUP BY w HAVING count(*) >= 30),
h AS (SELECT doc_id, count(DISTINCT w) AS n FROM (SELECT doc_id, unnest(t) AS w FROM tok) WHERE len(regexp_extract_all(w, '[aeiouy]+', 0)) >= 2
  AND w NOT IN (SELECT w FROM easy) GROUP BY doc_id),
c AS (SELECT tok.doc_id, coalesce(n, 0) AS d, len(list_filter({ws_split('text')}, lambda w: regexp_matches(w, '\\p{{L}}')))::DOUBLE AS w,
  greatest(1, len(regexp_extract_all(text, '[.!?]+', 0))) AS s FROM tok LEFT JOIN h USING (doc_id))
SELECT doc_id, CAST(d AS BIGINT) AS difficult_words, round(CASE WHEN w > 0 THEN 0.1579 * (100.0 * d / w) + 0.0496 * (w / s)
  + CASE WHEN 100.0 * d / w > 5 THEN 3.6365 ELSE 0.0 END END, 6) AS dale_chall_readability_score FROM c""")
def f12_difficult_words(spark, sf_dir):
    """Dale-Chall score and difficult words; easy are the words found 30 times and more."""
    from ..operators.lexicon import difficult_words
    d = read_table(spark, sf_dir, "documents")
    easy = explode_rows(d, [], T.words("text"), "word").groupBy("word").count().where("count >= 30")
    out = difficult_words(d, "doc_id", "text", easy)
    return out.select("doc_id", "difficult_words", r6("dale_chall_readability_score").alias("dale_chall_readability_score"))


# --- V6: topics of pairs ----------------------------------------------------------------------------------------
TOPICS = 3


def _topics_sql(steps: int = 2):
    u = f"((('0x' || substr(md5('1337|' || term || '|' || z), 1, 13))::BIGINT::DOUBLE + 0.5) / {1 << 52}.0)"
    toks = lambda c: f"regexp_extract_all(lower({c}), {WORD_SQL}, 0)"
    even = f"SELECT DISTINCT id, z, 1.0 / {TOPICS} AS s FROM {{}}, zs"

    def deal(c, shares, topics):
        return (f"SELECT c.id, c.term, z, c.n * t.s * p.s / nullif(sum(t.s * p.s) OVER (PARTITION BY c.id, c.term), 0) AS r "
                f"FROM {c} c JOIN {topics} p USING (term) JOIN {shares} t USING (id, z)")

    share = lambda r: f"SELECT id, z, sum(r) / sum(sum(r)) OVER (PARTITION BY id) AS s FROM {r} GROUP BY id, z"
    ctes = [f"zs AS (SELECT unnest(range({TOPICS})) AS z)",
            "pr AS (SELECT a.conv_id * 1000 + a.turn AS id, a.text AS q1, b.text AS q2 FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)",
            f"c0 AS (SELECT id, term, count(*) AS n FROM (SELECT id, unnest({toks('q1')} || {toks('q2')}) AS term FROM pr) GROUP BY id, term)",
            f"p0 AS (SELECT term, z, {u} / sum({u}) OVER (PARTITION BY z) AS s FROM (SELECT DISTINCT term FROM c0), zs)", f"t0 AS ({even.format('c0')})"]
    for k in range(steps):
        ctes += [f"r{k} AS ({deal('c0', f't{k}', f'p{k}')})", f"t{k + 1} AS ({share(f'r{k}')})",
                 f"p{k + 1} AS (SELECT term, z, sum(r) / sum(sum(r)) OVER (PARTITION BY z) AS s FROM r{k} GROUP BY term, z)"]
    for q in ("q1", "q2"):
        ctes += [f"c{q} AS (SELECT id, term, count(*) AS n FROM (SELECT id, unnest({toks(q)}) AS term FROM pr) GROUP BY id, term)", f"{q}_0 AS ({even.format('c' + q)})"]
        for k in range(steps):
            ctes += [f"{q}_{k + 1} AS ({share('(' + deal('c' + q, f'{q}_{k}', f'p{steps}') + ')')})"]
    out = ", ".join(f"round(coalesce((SELECT s FROM {q}_{steps} x WHERE x.id = pr.id AND x.z = {z}), 1.0 / {TOPICS}), 6) AS {n}_topic{z}"
                    for q, n in (("q1", "one"), ("q2", "two")) for z in range(TOPICS))
    return f"WITH {', '.join(ctes)} SELECT id, {out} FROM pr"


@register("v6_topics", _topics_sql())
def v6_topics(spark, sf_dir):
    """Three topics fitted on both texts of a pair of turns by two steps from a drawn start, and the
    topic shares of each text."""
    from ..operators.topics import pair_topics
    conv = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    nxt = conv.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("q2"))
    pairs = conv.join(nxt, ["conv_id", "turn"]).select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("q1"), "q2")
    out = pair_topics(pairs, "id", T.words("q1"), T.words("q2"), TOPICS, steps=2, method="md5")
    return out.select("id", *[r6(c).alias(c) for c in out.columns if c != "id"])


# --- T1: Treebank tokens -----------------------------------------------------------------------------------------
def _treebank_sql():
    kind = "regexp_replace(regexp_replace(lower(t), '^[^\\p{L}\\p{N}]+', ''), '[^\\p{L}\\p{N}.]+$', '')"
    like = lambda q: f"(dot * ln({q}) + (n - dot) * ln(1 - {q}))"
    inner = "(length(word) - length(replace(word, '.', '')))"
    return f"""WITH w AS (SELECT doc_id, unnest(x) AS t, unnest(range(len(x))) AS p FROM (SELECT doc_id, {ws_split('text')} AS x FROM documents)),
k AS (SELECT *, {kind} AS k FROM w),
c AS (SELECT regexp_replace(k, '\\.$', '') AS word, count(*) FILTER (suffix(k, '.')) AS dot, count(*) AS n FROM k WHERE k <> '' GROUP BY 1),
tot AS (SELECT sum(dot)::DOUBLE / sum(n)::DOUBLE AS q FROM c),
abbr AS (SELECT word FROM (SELECT word, (-2 * ({like('q')} - {like('0.99::DOUBLE')})) * exp(-(length(word) - {inner})::DOUBLE) * ({inner} + 1)
  * pow((length(word) - {inner})::DOUBLE, -(n - dot)::DOUBLE) AS score FROM c, tot WHERE regexp_matches(word, '\\p{{L}}') AND dot > 0) WHERE score >= 0.3),
e AS (SELECT k.*, regexp_extract(t, '([.!?]+)["''\\)\\]\\}}»”]*$', 1) AS e, abbr.word IS NOT NULL AS short,
  regexp_matches(coalesce(lead(t) OVER (PARTITION BY doc_id ORDER BY p), ''), '^[^\\p{{L}}\\p{{N}}]*\\p{{Lu}}') AS capital
  FROM k LEFT JOIN abbr ON suffix(k, '.') AND abbr.word = regexp_replace(k, '\\.$', '')),
s AS (SELECT doc_id, p, t, CASE WHEN e = '' THEN 0 WHEN regexp_matches(e, '[!?]') THEN 1 WHEN length(e) > 1 THEN capital::INT
  ELSE (NOT short AND NOT regexp_full_match(k, '\\p{{L}}\\.'))::INT END AS s FROM e),
n AS (SELECT *, coalesce(sum(s) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS no FROM s),
g AS (SELECT doc_id, no, string_agg(t, ' ' ORDER BY p) AS x FROM n GROUP BY doc_id, no),
o AS (SELECT doc_id, string_agg(array_to_string({ws_split(treebank_sql('x'))}, ' '), ' ' ORDER BY no) AS tokens FROM g GROUP BY doc_id)
SELECT d.doc_id, coalesce(tokens, '') AS tokens FROM documents d LEFT JOIN o USING (doc_id)"""


@register("t1_treebank_tokens", _treebank_sql())
def t1_treebank_tokens(spark, sf_dir):
    """Treebank tokens of every text, sentence by sentence, abbreviations learned from all texts."""
    from ..operators.sentences import tokenize_texts
    d = read_table(spark, sf_dir, "documents")
    return tokenize_texts(d, "doc_id", "text").select("doc_id", F.array_join("tokens", " ").alias("tokens"))
