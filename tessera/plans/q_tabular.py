"""Tabular queries: encoders (A), joins (J), group transforms (W), lags (L), numeric
columns (N), limits (O) and set operations (U) over lineitem, part, orders and the
customer panel.  Nulls are injected by rule where the tables have none."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.arrays import explode_rows
from ..operators import encoders as A, groups as G, lags as L, numeric as N
from ..sources.tables import corpus, customer_panel, read_table
from .catalog import register

KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
KEY_SQL = ", ".join(KEY)

LI_SQL = """li AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount,
         l_tax, l_returnflag, l_linestatus,
         CASE WHEN l_linenumber = 3 THEN NULL ELSE l_discount END AS disc_n,
         CASE WHEN l_linenumber = 5 THEN NULL ELSE l_tax END AS tax_n,
         CASE WHEN l_linenumber = 3 THEN NULL ELSE l_linenumber END AS ln_n
  FROM lineitem)"""


def _li(spark, sf_dir):
    l = read_table(spark, sf_dir, "lineitem")
    return l.select(*KEY, "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
                    F.when(F.col("l_linenumber") == 3, F.lit(None)).otherwise(F.col("l_discount")).alias("disc_n"),
                    F.when(F.col("l_linenumber") == 5, F.lit(None)).otherwise(F.col("l_tax")).alias("tax_n"),
                    F.when(F.col("l_linenumber") == 3, F.lit(None)).otherwise(F.col("l_linenumber")).alias("ln_n"))


def r6(c):
    return F.round(c, 6)


# --- A: encoders ----------------------------------------------------------------
@register("a1_label_encode", f"""WITH {LI_SQL}
SELECT {KEY_SQL},
  CAST(dense_rank() OVER (ORDER BY l_returnflag) - 1 AS BIGINT) AS l_returnflag,
  CAST(dense_rank() OVER (ORDER BY l_linestatus) - 1 AS BIGINT) AS l_linestatus,
  CAST(dense_rank() OVER (ORDER BY CAST(l_suppkey AS VARCHAR)) - 1 AS BIGINT) AS supp
FROM li""")
def a1_label_encode(spark, sf_dir):
    d = _li(spark, sf_dir).withColumn("supp", F.col("l_suppkey").cast("string"))
    return A.label_encode(d, ["l_returnflag", "l_linestatus", "supp"]).select(
        *KEY, "l_returnflag", "l_linestatus", "supp")


@register("a4_count_encode", f"""WITH {LI_SQL}
SELECT {KEY_SQL},
  CAST(count(*) OVER (PARTITION BY l_suppkey) AS BIGINT) AS l_suppkey_count_encode,
  CAST(count(*) OVER (PARTITION BY l_partkey) AS BIGINT) AS l_partkey_count_encode
FROM li""")
def a4_count_encode(spark, sf_dir):
    return A.count_encode(_li(spark, sf_dir), ["l_suppkey", "l_partkey"]).select(
        *KEY, "l_suppkey_count_encode", "l_partkey_count_encode")


@register("a4_count_encode_normalized", f"""WITH {LI_SQL}, c AS (
  SELECT *, count(*) OVER (PARTITION BY l_partkey) AS n FROM li)
SELECT {KEY_SQL}, round(n / (SELECT max(n) FROM c)::DOUBLE, 6) AS l_partkey_count_encode FROM c""")
def a4_count_encode_normalized(spark, sf_dir):
    out = A.count_encode(_li(spark, sf_dir), ["l_partkey"], normalize=True)
    return out.select(*KEY, r6("l_partkey_count_encode").alias("l_partkey_count_encode"))


@register("a5_labelcount_encode", f"""WITH {LI_SQL}, c AS (
  SELECT l_suppkey, count(*) AS n FROM li GROUP BY l_suppkey
), r AS (SELECT l_suppkey, row_number() OVER (ORDER BY n DESC, l_suppkey) - 1 AS rk FROM c)
SELECT {KEY_SQL}, CAST(r.rk AS BIGINT) AS l_suppkey_lc_encode FROM li JOIN r USING (l_suppkey)""")
def a5_labelcount_encode(spark, sf_dir):
    return A.labelcount_encode(_li(spark, sf_dir), ["l_suppkey"]).select(*KEY, "l_suppkey_lc_encode")


@register("a6_target_mean_encode", f"""WITH {LI_SQL}
SELECT {KEY_SQL},
  round(avg(l_quantity) OVER (PARTITION BY l_returnflag), 6) AS l_returnflag_target_mean,
  round(avg(l_quantity) OVER (PARTITION BY l_suppkey), 6) AS l_suppkey_target_mean
FROM li""")
def a6_target_mean_encode(spark, sf_dir):
    out = A.target_mean_encode(_li(spark, sf_dir), ["l_returnflag", "l_suppkey"], target="l_quantity")
    return out.select(*KEY, r6("l_returnflag_target_mean").alias("l_returnflag_target_mean"),
                      r6("l_suppkey_target_mean").alias("l_suppkey_target_mean"))


@register("a7_target_encode_smoothed", f"""WITH {LI_SQL}, tr AS (SELECT * FROM li WHERE l_linestatus = 'F'),
pri AS (SELECT avg(l_quantity) AS prior FROM tr),
st AS (SELECT l_partkey, avg(l_quantity) AS m, count(*) AS n FROM tr GROUP BY l_partkey),
enc AS (SELECT l_partkey, pri.prior * (1 - 1 / (1 + exp(-(n - 20) / 5.0))) + m * (1 / (1 + exp(-(n - 20) / 5.0))) AS e
        FROM st, pri)
SELECT {KEY_SQL}, CASE WHEN l_linestatus = 'F' THEN 'train' ELSE 'test' END AS split,
       round(coalesce(enc.e, (SELECT prior FROM pri)), 6) AS l_partkey_target_encode
FROM li LEFT JOIN enc USING (l_partkey)""")
def a7_target_encode_smoothed(spark, sf_dir):
    d = _li(spark, sf_dir)
    train = d.where(F.col("l_linestatus") == "F")
    test = d.where(~(F.col("l_linestatus") == "F"))
    tr, te = A.target_encode(train, test, ["l_partkey"], target="l_quantity",
                             min_samples_leaf=20, smoothing=5)
    cols = lambda s: [*KEY, F.lit(s).alias("split"), r6("l_partkey_target_encode").alias("l_partkey_target_encode")]
    return tr.select(*cols("train")).unionByName(te.select(*cols("test")))


_POLY_BASE = ["CAST(dense_rank() OVER (ORDER BY l_returnflag) - 1 AS DOUBLE)",
              "CAST(dense_rank() OVER (ORDER BY l_linestatus) - 1 AS DOUBLE)", "l_quantity", "l_discount"]


def _poly_sql():
    import itertools
    terms = ["1.0::DOUBLE"] + [f"x{i}" for i in range(4)] + \
            [f"x{i} * x{j}" for i, j in itertools.combinations_with_replacement(range(4), 2)]
    base = ", ".join(f"{e} AS x{i}" for i, e in enumerate(_POLY_BASE))
    sel = ", ".join(f"round({t}, 6) AS poly_{k}" for k, t in enumerate(terms))
    return f"WITH {LI_SQL}, b AS (SELECT {KEY_SQL}, {base} FROM li) SELECT {KEY_SQL}, {sel} FROM b"


@register("a9_polynomial_encode", _poly_sql())
def a9_polynomial_encode(spark, sf_dir):
    out = A.polynomial_encode(_li(spark, sf_dir), ["l_returnflag", "l_linestatus"],
                              ["l_quantity", "l_discount"], keep=KEY)
    return out.select(*KEY, *[r6(c).alias(c) for c in out.columns if c.startswith("poly_")])


@register("a10_nan_encode", f"""WITH {LI_SQL}
SELECT {KEY_SQL}, l_quantity, CAST(disc_n IS NULL AS INTEGER) AS disc_n,
       CAST(tax_n IS NULL AS INTEGER) AS tax_n, CAST(ln_n IS NULL AS INTEGER) AS ln_n FROM li""")
def a10_nan_encode(spark, sf_dir):
    d = _li(spark, sf_dir).select(*KEY, "l_quantity", "disc_n", "tax_n", "ln_n")
    return A.nan_encode(d, ["l_quantity", "disc_n", "tax_n", "ln_n"])


@register("a11_polar_coords", """WITH c AS (SELECT p_size, count(*) AS n FROM part GROUP BY p_size),
r AS (SELECT p_size, row_number() OVER (ORDER BY n DESC, p_size) - 1 AS rk FROM c),
mx AS (SELECT max(p_size) AS m FROM part),
a AS (SELECT p.p_partkey, CASE WHEN r.rk <= mx.m THEN r.rk * 360.0 / mx.m END AS ang
      FROM part p JOIN r USING (p_size), mx),
s AS (SELECT p_partkey, sin(ang) AS sn, cos(ang) AS cs FROM a)
SELECT p_partkey, round((sn - min(sn) OVER ()) / (max(sn) OVER () - min(sn) OVER ()), 6) AS p_size_sin,
       round((cs - min(cs) OVER ()) / (max(cs) OVER () - min(cs) OVER ()), 6) AS p_size_cos FROM s""")
def a11_polar_coords(spark, sf_dir):
    p = read_table(spark, sf_dir, "part").select("p_partkey", "p_size")
    out = A.polar_coords(p, "p_size")
    return out.select("p_partkey", r6("p_size_sin").alias("p_size_sin"), r6("p_size_cos").alias("p_size_cos"))


@register("a12_group_feat_by_feat", f"""WITH {LI_SQL}
SELECT l_suppkey,
  round(avg(l_quantity), 6) AS l_suppkey_by_l_quantity_mean, round(avg(disc_n), 6) AS l_suppkey_by_disc_n_mean,
  max(l_quantity) AS l_suppkey_by_l_quantity_max, max(disc_n) AS l_suppkey_by_disc_n_max,
  min(l_quantity) AS l_suppkey_by_l_quantity_min, min(disc_n) AS l_suppkey_by_disc_n_min,
  CAST(count(l_quantity) AS BIGINT) AS l_suppkey_by_l_quantity_count,
  CAST(count(disc_n) AS BIGINT) AS l_suppkey_by_disc_n_count
FROM li GROUP BY l_suppkey""")
def a12_group_feat_by_feat(spark, sf_dir):
    out = G.group_feat_by_feat(_li(spark, sf_dir), "l_suppkey", ["l_quantity", "disc_n"],
                               ["mean", "max", "min", "count"])
    return out.select(*[r6(c).alias(c) if c.endswith("_mean") else F.col(c) for c in out.columns])


@register("a13_group_feat_by_feat_multiple", f"""WITH {LI_SQL}
SELECT l_returnflag, round(avg(l_quantity), 6) AS l_returnflag_by_l_quantity_mean,
  round(avg(l_extendedprice), 6) AS l_returnflag_by_l_extendedprice_mean,
  round(avg(tax_n), 6) AS l_returnflag_by_tax_n_mean
FROM li GROUP BY l_returnflag""")
def a13_group_feat_by_feat_multiple(spark, sf_dir):
    out = G.group_stats(_li(spark, sf_dir), "l_returnflag", ["l_quantity", "l_extendedprice", "tax_n"], "mean")
    return out.select("l_returnflag", *[r6(c).alias(c) for c in out.columns if c != "l_returnflag"])


@register("a14_value_counts",
          "SELECT l_partkey, CAST(count(*) AS BIGINT) AS count FROM lineitem GROUP BY l_partkey")
def a14_value_counts(spark, sf_dir):
    return A.value_counts(read_table(spark, sf_dir, "lineitem"), "l_partkey")


def _digits_sql(k):
    return f"CAST(substring(CAST(o_custkey AS VARCHAR), 1, {k}) AS BIGINT)"


@register("a15_customer_features", f"""WITH o AS (
  SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS idx,
         count(*) OVER (PARTITION BY o_custkey) AS cnt, max(o_custkey) OVER () AS mx FROM orders)
SELECT o_orderkey, round(o_custkey / mx::DOUBLE, 6) AS customer_max_ratio,
       round(o_custkey / (idx + 1e-14), 6) AS index_max_ratio, CAST(cnt AS BIGINT) AS customer_count,
       {_digits_sql(1)} AS cust_first, {_digits_sql(2)} AS cust_2first, {_digits_sql(3)} AS cust_3first,
       {_digits_sql(4)} AS cust_4first, {_digits_sql(6)} AS cust_6first
FROM o""")
def a15_customer_features(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("customer_id"))
    out = A.customer_features(o, "customer_id", order_col="o_orderkey", keep=["o_orderkey"])
    return out.select("o_orderkey", r6("customer_max_ratio").alias("customer_max_ratio"),
                      r6("index_max_ratio").alias("index_max_ratio"), "customer_count",
                      "cust_first", "cust_2first", "cust_3first", "cust_4first", "cust_6first")


# --- J: joins ---------------------------------------------------------------------
@register("j1_entity_aggregates_join", """
SELECT o_orderkey, o_custkey AS customer_id, round(avg(o_totalprice) OVER (PARTITION BY o_custkey), 6) AS cust_mean,
       max(o_totalprice) OVER (PARTITION BY o_custkey) AS cust_max,
       CAST(count(*) OVER (PARTITION BY o_custkey) AS BIGINT) AS cust_n FROM orders""")
def j1_entity_aggregates_join(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("customer_id"),
                                                  "o_totalprice")
    agg = o.groupBy("customer_id").agg(F.avg("o_totalprice").alias("cust_mean"),
                                       F.max("o_totalprice").alias("cust_max"),
                                       F.count(F.lit(1)).cast("bigint").alias("cust_n"))
    return o.join(agg, "customer_id", "left").select("o_orderkey", "customer_id", r6("cust_mean").alias("cust_mean"),
                                                     "cust_max", "cust_n")


@register("j3_lookup_map", f"""SELECT {KEY_SQL}, p.p_retailprice AS retail_price,
  coalesce(p.p_brand, CAST(l.l_partkey AS VARCHAR)) AS brand_or_key
FROM lineitem l LEFT JOIN part p ON l.l_partkey = p.p_partkey""")
def j3_lookup_map(spark, sf_dir):
    li = read_table(spark, sf_dir, "lineitem").select(*KEY)
    part = read_table(spark, sf_dir, "part")
    out = A.lookup(li, "l_partkey", part, "p_partkey", "p_retailprice", out_col="retail_price")
    out = out.withColumn("brand_or_key", F.col("l_partkey").cast("string"))
    out = A.lookup(out, "brand_or_key", part.withColumn("k", F.col("p_partkey").cast("string")), "k",
                   "p_brand", keep_missing=True)
    return out.select(*KEY, "retail_price", "brand_or_key")


# --- W: group transforms ----------------------------------------------------------
@register("w1_group_featurebyfeature_encode", f"""WITH {LI_SQL}
SELECT {KEY_SQL}, round(avg(l_quantity) OVER (PARTITION BY l_suppkey), 6) AS supp_qty_mean FROM li""")
def w1_group_featurebyfeature_encode(spark, sf_dir):
    out = G.group_featurebyfeature_encode(_li(spark, sf_dir), "supp_qty_mean", "l_suppkey", "l_quantity", "mean")
    return out.select(*KEY, r6("supp_qty_mean").alias("supp_qty_mean"))


@register("w2_group_transform", f"""WITH {LI_SQL}
SELECT {KEY_SQL},
  round(avg(l_quantity) OVER w, 6) AS l_returnflag_by_l_quantity_mean, round(avg(disc_n) OVER w, 6) AS l_returnflag_by_disc_n_mean,
  max(l_quantity) OVER w AS l_returnflag_by_l_quantity_max, max(disc_n) OVER w AS l_returnflag_by_disc_n_max,
  min(l_quantity) OVER w AS l_returnflag_by_l_quantity_min, min(disc_n) OVER w AS l_returnflag_by_disc_n_min,
  CAST(count(l_quantity) OVER w AS BIGINT) AS l_returnflag_by_l_quantity_count,
  CAST(count(disc_n) OVER w AS BIGINT) AS l_returnflag_by_disc_n_count
FROM li WINDOW w AS (PARTITION BY l_returnflag)""")
def w2_group_transform(spark, sf_dir):
    out = G.group_feat_by_feat(_li(spark, sf_dir), "l_returnflag", ["l_quantity", "disc_n"],
                               ["mean", "max", "min", "count"], transform=True)
    stats = [c for c in out.columns if c.startswith("l_returnflag_by_")]
    return out.select(*KEY, *[r6(c).alias(c) if c.endswith("_mean") else F.col(c) for c in stats])


@register("w3_group_feat_by_feat_list", f"""WITH {LI_SQL}
SELECT {KEY_SQL}, round(avg(l_partkey) OVER (PARTITION BY l_suppkey), 6) AS l_suppkey_by_l_partkey_mean,
  round(avg(l_quantity) OVER (PARTITION BY l_partkey), 6) AS l_partkey_by_l_quantity_mean,
  round(avg(disc_n) OVER (PARTITION BY l_quantity), 6) AS l_quantity_by_disc_n_mean FROM li""")
def w3_group_feat_by_feat_list(spark, sf_dir):
    out = G.group_feat_by_feat_list(_li(spark, sf_dir), ["l_suppkey", "l_partkey", "l_quantity", "disc_n"], "mean")
    names = ["l_suppkey_by_l_partkey_mean", "l_partkey_by_l_quantity_mean", "l_quantity_by_disc_n_mean"]
    return out.select(*KEY, *[r6(c).alias(c) for c in names])


@register("w4_feature_combinations_grouping", f"""WITH {LI_SQL}
SELECT {KEY_SQL}, max(l_linenumber) OVER (PARTITION BY l_suppkey) AS l_suppkey_by_l_linenumber_max_combinations,
  max(l_quantity) OVER (PARTITION BY l_suppkey) AS l_suppkey_by_l_quantity_max_combinations,
  max(l_quantity) OVER (PARTITION BY l_linenumber) AS l_linenumber_by_l_quantity_max_combinations FROM li""")
def w4_feature_combinations_grouping(spark, sf_dir):
    out = G.feature_combinations_grouping(_li(spark, sf_dir), ["l_suppkey", "l_linenumber", "l_quantity"], "max")
    return out.select(*KEY, *[c for c in out.columns if c.endswith("_combinations")])


def _w5_sql():
    cols = []
    for k in ("year", "month", "market", "customer_id"):
        cols += [f"round(avg(target) OVER (PARTITION BY {k}), 6) AS {k}_by_target_mean",
                 f"max(target) OVER (PARTITION BY {k}) AS {k}_by_target_max",
                 f"CAST(count(target) OVER (PARTITION BY {k}) AS BIGINT) AS {k}_by_target_count"]
    return f"""WITH {PANEL_SQL} SELECT o_orderkey, {', '.join(cols)} FROM p"""


PANEL_SQL = """p AS (
  SELECT o.o_orderkey, o.o_custkey AS customer_id,
         CAST((year(o.o_orderdate) - 1995) * 12 + month(o.o_orderdate) - 1 AS INTEGER) AS date,
         o.o_totalprice AS target, year(o.o_orderdate) AS year, month(o.o_orderdate) AS month,
         c.c_mktsegment AS market
  FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey)"""


@register("w5_groupings_feature_set", _w5_sql())
def w5_groupings_feature_set(spark, sf_dir):
    out = G.groupings_feature_set(customer_panel(spark, sf_dir), ["target"])
    stats = [c for c in out.columns if "_by_target_" in c]
    return out.select("o_orderkey", *[r6(c).alias(c) if c.endswith("_mean") else F.col(c) for c in stats])


# --- L: lags ----------------------------------------------------------------------
@register("l1_aggregated_lags", f"""WITH {PANEL_SQL},
h AS (SELECT customer_id, avg(target) AS m FROM p WHERE date < 40 GROUP BY customer_id)
SELECT p.o_orderkey, p.customer_id, round(h.m, 6) AS target_lag_agg FROM p LEFT JOIN h USING (customer_id)""")
def l1_aggregated_lags(spark, sf_dir):
    out = L.aggregated_lags(customer_panel(spark, sf_dir), 40, only_target=True, keep=["o_orderkey"])
    return out.select("o_orderkey", "customer_id", r6("target_lag_agg").alias("target_lag_agg"))


def _l2_sql():
    cols = ", ".join(f"round(avg(CASE WHEN date = {m} THEN target END), 6) AS target_lag{i}"
                     for i, m in enumerate(range(12, 24)))
    outs = ", ".join(f"h.target_lag{i}" for i in range(12))
    return f"""WITH {PANEL_SQL}, h AS (SELECT customer_id, {cols} FROM p WHERE date < 24 GROUP BY customer_id)
SELECT p.o_orderkey, p.customer_id, {outs} FROM p LEFT JOIN h USING (customer_id)"""


@register("l2_lag_features", _l2_sql())
def l2_lag_features(spark, sf_dir):
    out = L.lag_features(customer_panel(spark, sf_dir), current_month=24, start_lag=12,
                         only_target=True, keep=["o_orderkey"])
    return out.select("o_orderkey", "customer_id", *[r6(f"target_lag{i}").alias(f"target_lag{i}") for i in range(12)])


# train months up to 59, test months from 60 to the panel's last one; the wide incremental
# layout needs its columns fixed beforehand and stops at month 79
FIRST_TEST = 60
SPLITS = ((1, 59, "train"), (FIRST_TEST, 79, "test"))


def last_month(panel) -> int:
    return panel.agg(F.max("date")).first()[0] or FIRST_TEST


def _l3_sql(incremental: bool):
    parts = []
    for start, end, split in SPLITS:
        if not incremental:
            parts.append(f"""SELECT r.o_orderkey, r.customer_id, r.date, '{split}' AS split,
  round(m.mean_t, 6) AS target_lag0 FROM p r
  LEFT JOIN (SELECT customer_id, date + 1 AS date, avg(target) AS mean_t FROM p GROUP BY customer_id, date) m
  USING (customer_id, date) WHERE r.date >= {start}{f" AND r.date <= {end}" if split == "train" else ""}""")
        else:
            aggs = ", ".join(f"max(CASE WHEN date <= {start + j} THEN target END) AS c{j}" for j in range(end - start))
            cols = ", ".join(f"CASE WHEN {start + j} < r.date THEN c.c{j} END AS target_lag{j}"
                             for j in range(end - start))
            parts.append(f"""SELECT r.o_orderkey, r.customer_id, r.date, '{split}' AS split, {cols}
  FROM p r LEFT JOIN (SELECT customer_id, {aggs} FROM p WHERE date <= {end} GROUP BY customer_id) c
  USING (customer_id) WHERE r.date BETWEEN {start} AND {end}""")
    if not incremental:
        return f"WITH {PANEL_SQL} " + " UNION ALL ".join(parts)
    # the test block has fewer lag columns; pad with NULLs like unionByName(allowMissingColumns)
    n_tr = SPLITS[0][1] - SPLITS[0][0]
    n_te = SPLITS[1][1] - SPLITS[1][0]
    pad = ", ".join(f"CAST(NULL AS DOUBLE) AS target_lag{j}" for j in range(n_te, n_tr))
    return f"WITH {PANEL_SQL} {parts[0]} UNION ALL SELECT *, {pad} FROM ({parts[1]})"


def _l3(spark, sf_dir, incremental, agg):
    panel = customer_panel(spark, sf_dir)
    end = SPLITS[1][1] if incremental else last_month(panel)
    tr, te = L.prepare_lags_data(panel, panel, SPLITS[0][0], SPLITS[0][1], SPLITS[1][0], end,
                                 only_target=True, incremental=incremental, agg_func=agg, keep=["o_orderkey"])
    tr = tr.withColumn("split", F.lit("train"))
    te = te.withColumn("split", F.lit("test"))
    out = tr.unionByName(te, allowMissingColumns=True)
    lag_cols = [c for c in out.columns if c.startswith("target_lag")]
    lag_cols.sort(key=lambda c: int(c[len("target_lag"):]))
    return out.select("o_orderkey", "customer_id", "date", "split",
                      *[(r6(c) if not incremental else F.col(c)).alias(c) for c in lag_cols])


@register("l3_lags_panel", _l3_sql(False))
def l3_lags_panel(spark, sf_dir):
    return _l3(spark, sf_dir, False, "mean")


@register("l3_lags_panel_incremental", _l3_sql(True))
def l3_lags_panel_incremental(spark, sf_dir):
    return _l3(spark, sf_dir, True, "max")


def _l4_sql():
    parts = []
    for months, split in ((f"r.date < {FIRST_TEST}", "train"), (f"r.date >= {FIRST_TEST}", "test")):
        parts.append(f"""SELECT r.o_orderkey, r.customer_id, r.date, '{split}' AS split,
  round((SELECT avg(h.target) FROM p h WHERE h.customer_id = r.customer_id AND h.date < r.date), 6) AS target_lag_agg
  FROM p r WHERE {months}""")
    return f"WITH {PANEL_SQL} " + " UNION ALL ".join(parts)


@register("l4_history_aggregates", _l4_sql())
def l4_history_aggregates(spark, sf_dir):
    panel = customer_panel(spark, sf_dir)
    tr, te = L.prepare_aggregated_lags(panel, panel, 0, FIRST_TEST - 1, FIRST_TEST, last_month(panel),
                                       only_target=True, keep=["o_orderkey"])
    sel = lambda d, s: d.select("o_orderkey", "customer_id", "date", F.lit(s).alias("split"),
                                r6("target_lag_agg").alias("target_lag_agg"))
    return sel(tr, "train").unionByName(sel(te, "test"))


# --- N: numeric ---------------------------------------------------------------------
@register("n1_impute_constant", f"""WITH {LI_SQL}
SELECT {KEY_SQL}, coalesce(disc_n, -999.0)::DOUBLE AS disc_n, coalesce(tax_n, -999.0)::DOUBLE AS tax_n,
       coalesce(ln_n, -999)::INTEGER AS ln_n FROM li""")
def n1_impute_constant(spark, sf_dir):
    d = _li(spark, sf_dir).select(*KEY, "disc_n", "tax_n", "ln_n")
    return N.impute_constant(d, ["disc_n", "tax_n", "ln_n"], -999)


@register("n2_impute_mean", f"""WITH {LI_SQL}
SELECT {KEY_SQL}, round(coalesce(disc_n, (SELECT avg(disc_n) FROM li)), 6) AS disc_n,
       round(coalesce(tax_n, (SELECT avg(tax_n) FROM li)), 6) AS tax_n FROM li""")
def n2_impute_mean(spark, sf_dir):
    d = N.impute_mean(_li(spark, sf_dir), ["disc_n", "tax_n"])
    return d.select(*KEY, r6("disc_n").alias("disc_n"), r6("tax_n").alias("tax_n"))


@register("n3_impute_median", f"""WITH {LI_SQL}
SELECT {KEY_SQL}, round(coalesce(disc_n, (SELECT median(disc_n) FROM li)), 6) AS disc_n,
       round(coalesce(ln_n::DOUBLE, (SELECT median(ln_n::DOUBLE) FROM li)), 6) AS ln_n FROM li""")
def n3_impute_median(spark, sf_dir):
    d = _li(spark, sf_dir).withColumn("ln_n", F.col("ln_n").cast("double"))
    d = N.impute_median(d, ["disc_n", "ln_n"])
    return d.select(*KEY, r6("disc_n").alias("disc_n"), r6("ln_n").alias("ln_n"))


def _rint_sql(x: str, k: int) -> str:
    y = f"({x} * {10 ** k}.0::DOUBLE)"
    return (f"(CASE WHEN {y} - floor({y}) > 0.5 THEN floor({y}) + 1 WHEN {y} - floor({y}) < 0.5 THEN floor({y}) "
            f"WHEN floor({y}) % 2 = 0 THEN floor({y}) ELSE floor({y}) + 1 END) / {10 ** k}.0::DOUBLE")


@register("n5_round_half_even", f"""SELECT {KEY_SQL}, {_rint_sql('l_extendedprice', 1)} AS price_r1,
  {_rint_sql('l_quantity / 7.0', 2)} AS qty7_r2 FROM lineitem""")
def n5_round_half_even(spark, sf_dir):
    d = read_table(spark, sf_dir, "lineitem").select(
        *KEY, F.col("l_extendedprice").alias("price_r1"), (F.col("l_quantity") / 7.0).alias("qty7_r2"))
    d = N.round_half_even(d, ["price_r1"], 1)
    return N.round_half_even(d, ["qty7_r2"], 2)


def _n6_expr(col, step):
    return f"""CASE WHEN {col} > 0 AND ceil({col} / {step}.0) - 1 <= ceil((SELECT max({col}) FROM lineitem) / {step}.0) - 2
               THEN ceil({col} / {step}.0) - 1 END"""


@register("n6_bin_codes", f"""WITH b AS (SELECT {KEY_SQL}, {_n6_expr('l_quantity', 5)} AS bq,
  {_n6_expr('l_extendedprice', 10000)} AS bp FROM lineitem),
cq AS (SELECT bq, dense_rank() OVER (ORDER BY bq) - 1 AS code FROM (SELECT DISTINCT bq FROM b WHERE bq IS NOT NULL)),
cp AS (SELECT bp, dense_rank() OVER (ORDER BY bp) - 1 AS code FROM (SELECT DISTINCT bp FROM b WHERE bp IS NOT NULL))
SELECT {KEY_SQL}, CAST(coalesce(cq.code, -1) AS BIGINT) AS l_quantity, CAST(coalesce(cp.code, -1) AS BIGINT) AS price
FROM b LEFT JOIN cq USING (bq) LEFT JOIN cp USING (bp)""")
def n6_bin_codes(spark, sf_dir):
    d = read_table(spark, sf_dir, "lineitem").select(*KEY, "l_quantity", F.col("l_extendedprice").alias("price"))
    d = N.bin_codes(d, "l_quantity", 5)
    d = N.bin_codes(d, "price", 10000)
    return d.select(*KEY, "l_quantity", "price")


def _n7_expr(col, step):
    e = f"greatest(ceil((SELECT max({col}) FROM li) / {step}.0), 0)"
    return f"CAST(CASE WHEN {col} IS NULL THEN {e} ELSE least(greatest(ceil({col} / {step}.0), 0), {e}) END AS BIGINT)"


@register("n7_digitize", f"""WITH {LI_SQL}
SELECT {KEY_SQL}, {_n7_expr('l_quantity', 5)} AS l_quantity_binned, {_n7_expr('l_extendedprice', 5000)} AS l_extendedprice_binned,
       {_n7_expr('ln_n', 2)} AS ln_n_binned FROM li""")
def n7_digitize(spark, sf_dir):
    d = _li(spark, sf_dir)
    d = N.digitize(d, ["l_quantity"], 5)
    d = N.digitize(d, ["l_extendedprice"], 5000)
    d = N.digitize(d, ["ln_n"], 2)
    return d.select(*KEY, "l_quantity_binned", "l_extendedprice_binned", "ln_n_binned")


@register("n8_scale_standard", f"""WITH {LI_SQL}
SELECT {KEY_SQL}, round((l_quantity - (SELECT avg(l_quantity) FROM li)) / (SELECT stddev_pop(l_quantity) FROM li), 6) AS l_quantity,
       round((disc_n - (SELECT avg(disc_n) FROM li)) / (SELECT stddev_pop(disc_n) FROM li), 6) AS disc_n FROM li""")
def n8_scale_standard(spark, sf_dir):
    d = N.scale_standard(_li(spark, sf_dir), ["l_quantity", "disc_n"])
    return d.select(*KEY, r6("l_quantity").alias("l_quantity"), r6("disc_n").alias("disc_n"))


@register("n9_scale_minmax", f"""WITH {LI_SQL}
SELECT {KEY_SQL}, round((l_quantity - (SELECT min(l_quantity) FROM li)) / ((SELECT max(l_quantity) FROM li) - (SELECT min(l_quantity) FROM li)), 6) AS l_quantity,
       round((disc_n - (SELECT min(disc_n) FROM li)) / ((SELECT max(disc_n) FROM li) - (SELECT min(disc_n) FROM li)), 6) AS disc_n FROM li""")
def n9_scale_minmax(spark, sf_dir):
    d = N.scale_minmax(_li(spark, sf_dir), ["l_quantity", "disc_n"])
    return d.select(*KEY, r6("l_quantity").alias("l_quantity"), r6("disc_n").alias("disc_n"))


def _moments_sql(cols):
    xs = [f"CAST({c} AS DOUBLE)" for c in cols]
    n = " + ".join(f"CAST({x} IS NOT NULL AS INTEGER)" for x in xs)
    s = " + ".join(f"coalesce({x}, 0.0)" for x in xs)
    mean = f"(CASE WHEN ({n}) > 0 THEN ({s}) / ({n}) END)"
    ss = " + ".join(f"coalesce(({x} - {mean}) * ({x} - {mean}), 0.0)" for x in xs)
    std = f"(CASE WHEN ({n}) > 1 THEN sqrt(({ss}) / (({n}) - 1)) END)"
    mx = f"CAST(greatest({', '.join(xs)}) AS DOUBLE)"
    return n, s, mean, std, mx


def _n10_sql():
    cols = ["l_quantity", "disc_n", "tax_n", "ln_n"]
    n, s, mean, std, mx = _moments_sql(cols)
    cnt = lambda pred: "CAST(" + " + ".join(f"CAST(coalesce({pred(c)}, false) AS BIGINT)" for c in cols) + " AS BIGINT)"
    return f"""WITH {LI_SQL} SELECT {KEY_SQL}, l_quantity, disc_n, tax_n, ln_n,
  {cnt(lambda c: f'{c} = 0')} AS zeros, {cnt(lambda c: f'{c} <> 0')} AS non_zeros,
  {cnt(lambda c: f'{c} IS NULL')} AS nans, {cnt(lambda c: f'{c} < 0')} AS negatives,
  round({s}, 6) AS sum_row, round({mean}, 6) AS mean_row, round({std}, 6) AS std_row, round({mx}, 6) AS max_row FROM li"""


@register("n10_row_statistics", _n10_sql())
def n10_row_statistics(spark, sf_dir):
    d = N.row_statistics(_li(spark, sf_dir), ["l_quantity", "disc_n", "tax_n", "ln_n"], keep=KEY)
    return d.select(*[r6(c).alias(c) if c in ("sum_row", "mean_row", "std_row", "max_row") else F.col(c)
                      for c in d.columns])


def _n11_sql():
    cols = ["l_quantity", "l_extendedprice", "l_discount"]
    n, s, mean, std, mx = _moments_sql(cols)
    return f"""SELECT {KEY_SQL}, round({s}, 6) AS sum_row_3cols, round({mean}, 6) AS mean_row3cols,
  round({std}, 6) AS std_row3cols, round({mx}, 6) AS max_row3cols FROM lineitem"""


@register("n11_add_statistics", _n11_sql())
def n11_add_statistics(spark, sf_dir):
    d = N.add_statistics(read_table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"], keep=KEY)
    return d.select(*KEY, *[r6(c).alias(c) for c in d.columns if c not in KEY])


@register("n12_pairwise_sums", f"""WITH {LI_SQL} SELECT {KEY_SQL}, l_quantity, disc_n, tax_n,
  round(l_quantity + disc_n, 6) AS l_quantity_plus_disc_n, round(l_quantity + tax_n, 6) AS l_quantity_plus_tax_n,
  round(disc_n + tax_n, 6) AS disc_n_plus_tax_n FROM li""")
def n12_pairwise_sums(spark, sf_dir):
    d = N.pairwise_sums(_li(spark, sf_dir), ["l_quantity", "disc_n", "tax_n"], keep=KEY)
    return d.select(*[r6(c).alias(c) if "_plus_" in c else F.col(c) for c in d.columns])


@register("n13_pairwise_products", f"""SELECT {KEY_SQL}, round(l_quantity * l_discount, 6) AS l_quantity_l_discount,
  round(l_quantity * l_tax, 6) AS l_quantity_l_tax, round(l_discount * l_tax, 6) AS l_discount_l_tax FROM lineitem""")
def n13_pairwise_products(spark, sf_dir):
    d = N.pairwise_products(read_table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount", "l_tax"], keep=KEY)
    return d.select(*KEY, *[r6(c).alias(c) for c in d.columns if c not in KEY])


@register("n14_target_engineering")
def n14_target_engineering(spark, sf_dir):
    """Box-Cox with a fitted lambda: rows check plus property tests."""
    panel = customer_panel(spark, sf_dir)
    return N.target_engineering(panel, "target", keep=["o_orderkey"])


@register("n14_boxcox_fixed_lambda", f"""WITH {PANEL_SQL},
b AS (SELECT o_orderkey, (pow(pow(ln(target), 0.25) + 1.0, 2.0) ^ 0.5 - 1.0) / 0.5 AS bc FROM p),
e AS (SELECT greatest(ceil(max(bc) / 0.5), 0) AS e FROM b)
SELECT o_orderkey, round(bc, 6) AS target_boxcox,
       CAST(least(greatest(floor(bc / 0.5) + 1, 0), e.e) AS BIGINT) AS target_bin FROM b, e""")
def n14_boxcox_fixed_lambda(spark, sf_dir):
    """The target transform with a given lambda (0.5) and bins of width 0.5."""
    out = N.target_engineering(customer_panel(spark, sf_dir), "target", bin_width=0.5,
                               keep=["o_orderkey"], lam=0.5)
    return out.select("o_orderkey", r6("target_boxcox").alias("target_boxcox"), "target_bin")


N15_COLS = ["q", "q_copy", "disc", "disc_n", "tax", "tax_copy", "price"]


def _n15_frame(spark, sf_dir):
    l = read_table(spark, sf_dir, "lineitem")
    return l.select(*KEY, F.col("l_quantity").alias("q"), (F.col("l_quantity") * 1.0).alias("q_copy"),
                    F.col("l_discount").alias("disc"),
                    F.when(F.col("l_linenumber") == 3, F.lit(None)).otherwise(F.col("l_discount")).alias("disc_n"),
                    F.col("l_tax").alias("tax"),
                    F.when(F.col("l_linenumber") > 0, F.col("l_tax")).alias("tax_copy"),
                    F.col("l_extendedprice").alias("price"))


def _n15_sql():
    import itertools
    fr = """f AS (SELECT l_quantity AS q, l_quantity * 1.0 AS q_copy, l_discount AS disc,
  CASE WHEN l_linenumber = 3 THEN NULL ELSE l_discount END AS disc_n, l_tax AS tax,
  CASE WHEN l_linenumber > 0 THEN l_tax END AS tax_copy, l_extendedprice AS price FROM lineitem)"""
    checks = ", ".join(f"count_if({a} IS DISTINCT FROM {b}) AS \"{a}|{b}\""
                       for a, b in itertools.combinations(N15_COLS, 2))
    return f"""WITH {fr}, c AS (SELECT {checks} FROM f),
u AS (UNPIVOT c ON COLUMNS(*) INTO NAME pair VALUE diff)
SELECT split_part(pair, '|', 2) AS column_name FROM u WHERE diff = 0 GROUP BY 1"""


@register("n15_duplicate_columns", _n15_sql())
def n15_duplicate_columns(spark, sf_dir):
    d = _n15_frame(spark, sf_dir).withColumn("__k", F.xxhash64(*KEY))
    return N.duplicate_columns_frame(d, "__k", N15_COLS)


# --- O / U ------------------------------------------------------------------------
@register("o3_first_rows", "SELECT doc_id, n_chars FROM documents ORDER BY doc_id LIMIT 100")
def o3_first_rows(spark, sf_dir):
    """Quick-run truncation: first rows by key (the limit is the feature)."""
    return read_table(spark, sf_dir, "documents").select("doc_id", "n_chars").orderBy("doc_id").limit(100)


@register("u1_union_train_test", """SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'test' ELSE 'train' END AS split,
  l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)""")
def u1_union_train_test(spark, sf_dir):
    c = corpus(spark, sf_dir)
    train = c.where(F.col("split") == "train").select("doc_id", "split", "toxic")
    test = c.where(F.col("split") == "test").select("doc_id", "split")
    return train.unionByName(test, allowMissingColumns=True)


_WORDS_SQL = "unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+', 0))"


@register("u2_distinct_union", " UNION ".join(f"SELECT {_WORDS_SQL} AS word FROM documents WHERE lang {x}"
                                              for x in ("= 'en'", "= 'fr'", "NOT IN ('en', 'fr') OR lang IS NULL")))
def u2_distinct_union(spark, sf_dir):
    from ..functions.tokens import words
    d = read_table(spark, sf_dir, "documents")
    lang = F.coalesce(F.col("lang"), F.lit(""))
    w = lambda cond: explode_rows(d.where(cond), [], words("text"), "word")
    return w(lang == "en").union(w(lang == "fr")).union(w(~lang.isin("en", "fr"))).distinct()


@register("u3_except_all", f"""SELECT {_WORDS_SQL} AS word FROM documents WHERE lang IN ('es', 'de') OR lang IS NULL
EXCEPT ALL SELECT {_WORDS_SQL} AS word FROM documents WHERE lang NOT IN ('es', 'de')""")
def u3_except_all(spark, sf_dir):
    from ..functions.tokens import words
    d = read_table(spark, sf_dir, "documents")
    left = F.coalesce(F.col("lang").isin("es", "de"), F.lit(True))
    w = lambda cond: explode_rows(d.where(cond), [], words("text"), "word")
    return w(left).exceptAll(w(~left))
