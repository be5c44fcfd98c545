import random

from pyspark.sql import functions as F

from tessera.operators import groups as G, lags as L


def panel(spark, n=300, seed=5):
    rnd = random.Random(seed)
    data = [(i, rnd.randint(1, 8), rnd.randint(0, 10), float(rnd.randint(1, 100))) for i in range(n)]
    return data, spark.createDataFrame(data, "k long, customer_id long, date int, target double")


def test_history_aggregates_brute(spark):
    data, df = panel(spark)
    out = {r["k"]: r["target_lag_agg"] for r in
           L.history_aggregates(df, 1, 10, only_target=True, agg_func="mean", keep=["k"]).collect()}
    for k, c, d, t in data:
        if 1 <= d <= 10:
            hist = [tt for kk, cc, dd, tt in data if cc == c and dd < d]
            exp = sum(hist) / len(hist) if hist else None
            assert (out[k] is None and exp is None) or abs(out[k] - exp) < 1e-9


def test_lags_panel_incremental_brute(spark):
    data, df = panel(spark, seed=9)
    out = {r["k"]: r for r in L.lags_panel(df, 2, 6, only_target=True, incremental=True,
                                           agg_func="max", keep=["k"]).collect()}
    for k, c, d, t in data:
        if 2 <= d <= 6:
            for j in range(4):
                exp = None
                if 2 + j < d:
                    hist = [tt for kk, cc, dd, tt in data if cc == c and dd <= 2 + j]
                    exp = max(hist) if hist else None
                assert out[k][f"target_lag{j}"] == exp


def test_lag_features_nonincremental(spark):
    data, df = panel(spark, seed=2)
    out = {r["k"]: r for r in L.lag_features(df, 5, 3, only_target=True, keep=["k"]).collect()}
    for k, c, d, t in data:
        for i, m in enumerate((3, 4)):
            vals = [tt for kk, cc, dd, tt in data if cc == c and dd == m]
            exp = sum(vals) / len(vals) if vals else None
            got = out[k][f"target_lag{i}"]
            assert (got is None and exp is None) or abs(got - exp) < 1e-9


def test_group_transform_null_key(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), (None, 5.0)], "g string, x double")
    out = sorted(G.group_transform(df, "g", ["x"], ["mean", "count"]).collect(), key=lambda r: (r["g"] is None, r["x"]))
    assert [r["g_by_x_mean"] for r in out] == [2.0, 2.0, None]
    assert [r["g_by_x_count"] for r in out] == [2, 2, None]
