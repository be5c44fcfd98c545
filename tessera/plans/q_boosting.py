"""Boosted trees of all bags, folds and labels in one pass per level (M4-M8, O2)."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import boosting as B
from ..sources.files import scratch_dir
from ..sources.tables import corpus
from .catalog import register
from .q_ml import FEATURES, _split
from .q_models import H_SQL, SEED

LABELS = ["toxic", "quality"]
KINDS = {"chars": None, "capitals": "[^A-Z]", "digits": "[^0-9]", "blanks": "[^ ]"}
BY_LABEL = {None: ["chars", "blanks"], "toxic": ["capitals"], "quality": ["digits"]}
NAMES = ["chars", "blanks", "capitals", "digits"]
EDGES = {c: [2.0 ** k for k in range(1, 14)] for c in NAMES}
FOLDS, BAGS, ROUNDS, DEPTH, STEP, L2, LEAST = 3, 2, 2, 2, 0.3, 1.0, 5

HOW = {"rounds": ROUNDS, "depth": DEPTH, "step": STEP, "l2": L2, "min_rows": LEAST, "edges": EDGES, "store_every": 1}


def _frame(spark, sf_dir):
    """Counts of characters by kind; no digit at all counts as missing."""
    count = lambda p: F.length("comment_text") if p is None else F.length(F.regexp_replace("comment_text", p, ""))
    f = corpus(spark, sf_dir).select("doc_id", "split", *LABELS, *[count(p).alias(c) for c, p in KINDS.items()])
    return f.withColumn("digits", F.when(F.col("digits") > 0, F.col("digits")))


def _fit(spark, sf_dir):
    f = _frame(spark, sf_dir)
    return f, B.fit_boosted(f.where("split = 'train'"), "doc_id", BY_LABEL, LABELS, n_folds=FOLDS, n_bags=BAGS, seed=SEED, method="knuth", **HOW)


HELD = f"CASE WHEN {H_SQL} % 1000000 < 200000 THEN 0 ELSE -1 END"
STRATA = [f"(row_number() OVER (PARTITION BY toxic + quality ORDER BY {H_SQL.replace(str(SEED), str(SEED + b))}, doc_id) - 1) % {FOLDS}" for b in range(BAGS)]


def _grown_sql(folds: int, deal: list[str]) -> str:
    """The growth spelled out, one CTE per step; ``s<r>`` holds the margins after r rounds.
    ``deal``: a row's fold in each bag."""
    scale, n = f"{B.SCALE}::DOUBLE", len(LABELS)
    count = {c: "length(text)" if p is None else f"length(regexp_replace(text, '{p}', '', 'g'))" for c, p in KINDS.items()}
    count["digits"] = f"nullif({count['digits']}, 0)"
    bins = ", ".join(f"CASE WHEN {count[c]} IS NULL THEN {len(EDGES[c]) + 1} ELSE len(list_filter({EDGES[c]}, lambda e: e < {count[c]})) END" for c in NAMES)
    mine = [[NAMES.index(c) for c in BY_LABEL[None] + BY_LABEL[lab]] for lab in LABELS]
    ctes = [f"x AS (SELECT doc_id, toxic, quality, folds, l.doc_id IS NOT NULL AS known, [{bins}] AS b FROM documents LEFT JOIN (SELECT *, [{', '.join(deal)}] AS folds FROM labels) l USING (doc_id))",
            f"mo AS (SELECT unnest(range({len(deal) * n * folds})) AS m)",
            f"""mr AS (SELECT doc_id, m, known, b, CASE m // {folds} % {n} WHEN 0 THEN toxic ELSE quality END AS y,
              known AND folds[m // {folds * n} + 1] = m % {folds} AS mine FROM x, mo)""",
            "pr AS (SELECT m, ln((count(*) FILTER (y = 1) + 0.5::DOUBLE) / (count(*) FILTER (y = 0) + 0.5::DOUBLE)) AS p FROM mr WHERE known AND NOT mine GROUP BY m)",
            "s0 AS (SELECT mr.*, p AS margin FROM mr JOIN pr USING (m))"]
    part = lambda g, h: f"(({g}) / {scale}) * (({g}) / {scale}) / (({h}) / {scale} + {L2}::DOUBLE)"
    leaf = lambda g, h: f"(-{STEP})::DOUBLE * (({g}) / {scale}) / (({h}) / {scale} + {L2}::DOUBLE)"
    for r in range(ROUNDS):
        ctes.append(f"n{r}_0 AS (SELECT doc_id, m, known, b, y, mine, margin, 1 / (1 + exp(-margin)) AS p, 0 AS node, 0::DOUBLE AS v FROM s{r})")
        for d in range(DEPTH):
            ctes += [f"""h{r}_{d} AS (SELECT m, node, k, bin, sum(g) AS g, sum(h) AS h, count(*) AS n FROM (SELECT m, node, unnest(b) AS bin, unnest(range(len(b))) AS k,
                  CAST(round((p - y) * {scale}) AS BIGINT) AS g, CAST(round(p * (1 - p) * {scale}) AS BIGINT) AS h FROM n{r}_{d} WHERE known AND NOT mine AND node >= {2 ** d - 1})
                  WHERE list_contains(CASE m // {folds} % {n} WHEN 0 THEN {mine[0]} ELSE {mine[1]} END, k) GROUP BY ALL)""",
                     f"""c{r}_{d} AS (SELECT m, node, k, bin, {', '.join(f'sum({c}) OVER (PARTITION BY m, node, k ORDER BY bin) AS l{c}, sum({c}) OVER (PARTITION BY m, node, k) AS t{c}' for c in 'ghn')} FROM h{r}_{d})""",
                     f"""b{r}_{d} AS (SELECT * FROM (SELECT *, {part('lg', 'lh')} + {part('tg - lg', 'th - lh')} - {part('tg', 'th')} AS gain FROM c{r}_{d}
                  WHERE ln >= {LEAST} AND tn - ln >= {LEAST}) WHERE gain > 0 QUALIFY row_number() OVER (PARTITION BY m, node ORDER BY gain DESC, k, bin) = 1)""",
                     f"""n{r}_{d + 1} AS (SELECT n.doc_id, n.m, known, b, y, mine, margin, p, CASE WHEN z.m IS NULL THEN n.node ELSE 2 * n.node + 1 + (b[k + 1] > bin)::INT END AS node,
                  CASE WHEN z.m IS NULL THEN v WHEN b[k + 1] > bin THEN {leaf('tg - lg', 'th - lh')} ELSE {leaf('lg', 'lh')} END AS v
                  FROM n{r}_{d} n LEFT JOIN b{r}_{d} z ON z.m = n.m AND z.node = n.node)"""]
        ctes.append(f"s{r + 1} AS (SELECT doc_id, m, known, b, y, mine, margin + v AS margin FROM n{r}_{DEPTH})")
    lost = f"sum(CAST(round(-ln(greatest(CASE WHEN y > 0 THEN 1 / (1 + exp(-margin)) ELSE 1 - 1 / (1 + exp(-margin)) END, 1e-15)) * {scale}) AS BIGINT))"
    ctes.append("every AS (" + " UNION ALL ".join(f"SELECT {r} AS r, doc_id, m, known, y, mine, margin FROM s{r}" for r in range(ROUNDS + 1)) + ")")
    ctes.append(f"best AS (SELECT m, r FROM (SELECT m, r, {lost} AS s FROM every WHERE mine GROUP BY m, r) QUALIFY row_number() OVER (PARTITION BY m ORDER BY s, r) = 1)")
    return "WITH " + ",\n".join(ctes)


def _named_sql(m: str, folds: int = FOLDS) -> str:
    return (f"CAST({m} // {folds * len(LABELS)} AS INTEGER) AS bag, CASE {m} // {folds} % {len(LABELS)} WHEN 0 THEN '{LABELS[0]}' ELSE '{LABELS[1]}' END AS label, "
            f"CAST({m} % {folds} AS INTEGER) AS fold")


@register("m4_m8_boosted_folds", f"""{_grown_sql(FOLDS, STRATA)}
SELECT doc_id, {_named_sql('m')}, CASE WHEN known THEN 'train' ELSE 'test' END AS split, round(1 / (1 + exp(-margin)), 6) AS pred
FROM every JOIN best USING (m, r) WHERE mine OR NOT known""")
def m4_m8_boosted_folds(spark, sf_dir):
    """Two bags of three folds and two labels, twelve models grown together for two rounds, the
    best round kept: out-of-fold and test predictions."""
    f, (models, rows) = _fit(spark, sf_dir)
    test = f.where("split = 'test'")
    out = (B.predict_boosted(models, rows, own_fold=True).withColumn("split", F.lit("train"))
           .unionByName(B.predict_boosted(models, B.binned(test, "doc_id", models), own_fold=False).withColumn("split", F.lit("test"))))
    return out.select(F.col("__key").alias("doc_id"), "bag", "label", "fold", "split", F.round("pred", 6).alias("pred"))


def _gains_sql() -> str:
    cuts = " UNION ALL ".join(f"SELECT {r} AS r, m, k, gain FROM b{r}_{d}" for r in range(ROUNDS) for d in range(DEPTH))
    return f"""{_grown_sql(FOLDS, STRATA)},
g AS (SELECT {_named_sql('m')}, ({NAMES})[k + 1] AS feature, gain FROM ({cuts}) c JOIN best USING (m) WHERE c.r < best.r),
s AS (SELECT label, feature, sum(gain) AS gain FROM g GROUP BY label, feature)
SELECT label, feature, round(gain / sum(gain) OVER (PARTITION BY label), 6) AS importance FROM s"""


@register("o2_gain_importances", _gains_sql())
def o2_gain_importances(spark, sf_dir):
    """Shares of the gain by label and feature over the kept rounds of those models."""
    _, (models, _rows) = _fit(spark, sf_dir)
    nodes = B.model_table(spark, models)
    return B.gain_importances(nodes, top=len(NAMES)).select("label", "feature", F.round("importance", 6).alias("importance"))


@register("m5_boosted_bag_run", f"""{_grown_sql(1, [HELD])}
SELECT doc_id, {_named_sql('m', 1).rsplit(',', 1)[0]}, CASE WHEN known THEN 'valid' ELSE 'test' END AS split, round(1 / (1 + exp(-margin)), 6) AS pred
FROM every JOIN best USING (m, r) WHERE mine OR NOT known""")
def m5_boosted_bag_run(spark, sf_dir):
    """A fifth of the labelled rows held out; both labels fitted on the others, the best round kept."""
    f = _frame(spark, sf_dir)
    out = B.boosted_bag_run(f.where("split = 'train'"), f.where("split = 'test'"), "doc_id", BY_LABEL, LABELS, 0.2, SEED, method="knuth", **HOW)
    return out.withColumn("pred", F.round("pred", 6))


@register("m6_m7_boosted_saved_model", f"""{_grown_sql(1, ['-1'])}
SELECT doc_id, {_named_sql('m', 1)}, round(1 / (1 + exp(-margin)), 6) AS pred FROM s{ROUNDS} WHERE NOT known""")
def m6_m7_boosted_saved_model(spark, sf_dir):
    """Models of all labelled rows, stored as a table of nodes, read back and applied to the others."""
    f = _frame(spark, sf_dir)
    path = scratch_dir(spark, "boosted")
    B.model_table(spark, B.full_boosted(f.where("split = 'train'"), "doc_id", BY_LABEL, LABELS, **HOW)).write.parquet(path)
    models = B.from_table(spark.read.parquet(path))
    out = B.predict_boosted(models, B.binned(f.where("split = 'test'"), "doc_id", models), own_fold=False)
    return out.select(F.col("__key").alias("doc_id"), "bag", "label", "fold", F.round("pred", 6).alias("pred"))


@register("m4_boosted_quantile_run")
def m4_boosted_quantile_run(spark, sf_dir):
    """Thirty rounds on quantile bins of the text statistics, five folds, both labels, early stopping."""
    tr, te = _split(spark, sf_dir)
    return B.boosted_fold_run(tr, te, "doc_id", FEATURES, LABELS, n_folds=5, seed=SEED, rounds=30, depth=3, patience=5)
