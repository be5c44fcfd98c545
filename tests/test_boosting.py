"""Boosted trees of all models at once, against plain Python over rows."""
import math
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import boosting as B

EDGES = {"a": [0.0, 1.0, 2.0, 3.0], "b": [10.0, 20.0, 30.0]}


def data(spark, n=300, seed=1, label=lambda a, b, rnd: int((a or 0) + rnd.random() > 2.5)):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        a = None if rnd.random() < 0.1 else float(rnd.randint(0, 4))
        b = float("nan") if rnd.random() < 0.05 else rnd.random() * 40
        rows.append((i, a, b, label(a, b, rnd), None if rnd.random() < 0.1 else rnd.randint(0, 1), "x"))
    return spark.createDataFrame(rows, "id int, a double, b double, y int, z int, __bins string")


def plain(rows, folds, f, lab, rounds, depth, step, l2, min_rows):
    """One model by recursion over lists of rows; returns margins after each round by id."""
    def bins(r):
        return [len(EDGES[c]) + 1 if r[c] is None or r[c] != r[c] else sum(e < r[c] for e in EDGES[c]) for c in ("a", "b")]
    known = {r["id"]: r[lab] for r in rows if r[lab] is not None}
    code = {r["id"]: bins(r) for r in rows}
    fit = [i for i in known if folds[i] != f]
    pos = sum(known[i] for i in fit)
    margin = {r["id"]: math.log((pos + 0.5) / (len(fit) - pos + 0.5)) for r in rows}
    history = [dict(margin)]

    def grow(ids, every, level, value):
        best = None
        if level < depth:
            score = lambda s: sum(g[i] for i in s) ** 2 / (sum(h[i] for i in s) + l2)
            for k in range(2):
                for cut in range(6):
                    left = [i for i in ids if code[i][k] <= cut]
                    right = [i for i in ids if code[i][k] > cut]
                    if len(left) >= min_rows and len(right) >= min_rows:
                        gain = score(left) + score(right) - score(ids)
                        if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                            best = (gain, k, cut, left, right)
        if best is None:
            for i in every:
                margin[i] += value
            return
        for side, ids2 in ((False, best[3]), (True, best[4])):
            v = -step * sum(g[i] for i in ids2) / (sum(h[i] for i in ids2) + l2)
            grow(ids2, [i for i in every if (code[i][best[1]] > best[2]) == side], level + 1, v)

    for _ in range(rounds):
        p = {i: 1 / (1 + math.exp(-margin[i])) for i in known}
        g, h = {i: p[i] - known[i] for i in known}, {i: p[i] * (1 - p[i]) for i in known}
        grow(fit, [r["id"] for r in rows], 0, 0.0)
        history.append(dict(margin))
    loss = [sum(math.log1p(math.exp(-m[i] if known[i] else m[i])) for i in known if folds[i] == f) for m in history]
    return history, loss


@pytest.mark.parametrize("store_every", [1, 4])
def test_against_plain_python(spark, store_every):
    df = data(spark).repartition(3)
    models, rows = B.fit_boosted(df, "id", ["a", "b"], ["y", "z"], n_folds=3, rounds=3, depth=2, step=0.4, min_rows=8, edges=EDGES, store_every=store_every)
    got = {(r["__key"], r["label"], r["fold"]): r["pred"] for r in B.predict_boosted(models, rows, own_fold=True).collect()}
    own = {r["__key"]: r["__folds"][0] for r in rows.collect()}
    src = [r.asDict() for r in df.collect()]
    assert len(got) == 2 * len(src)
    for m, (lab, f) in enumerate((lab, f) for lab in ("y", "z") for f in range(3)):
        history, loss = plain(src, own, f, lab, 3, 2, 0.4, 1.0, 8)
        n = sum(r[lab] is not None and own[r["id"]] == f for r in src)
        assert all(abs(models.losses[r][m] * n - loss[r]) < 1e-4 for r in range(4))
        assert abs(loss[models.best[m]] - min(loss)) < 1e-4
        for i in (i for i in own if own[i] == f):
            assert abs(got[i, lab, f] - 1 / (1 + math.exp(-history[models.best[m]][i]))) < 1e-5


def test_same_trees_under_another_partitioning(spark):
    df = data(spark)
    tables = []
    for parts in (1, 5):
        models, _ = B.fit_boosted(df.repartition(parts), "id", ["a", "b"], ["y"], n_folds=2, n_bags=2, rounds=3, stratify="argmax")
        tables.append(sorted(map(str, B.model_table(spark, models).collect())))
    assert tables[0] == tables[1]


def test_learns_and_random_labels_do_not(spark):
    df = data(spark, 1200, label=lambda a, b, rnd: int(b == b and b > 20))
    out = B.boosted_fold_run(df, df.limit(10), "id", ["a", "b"], ["y", "z"], n_folds=3, rounds=8, step=0.3, patience=3)
    assert out.where("split = 'test'").count() == 10 * 2 * 3
    rows = out.where("split = 'train'").join(df.select("id", "y", "z"), "id").collect()
    assert len(rows) == 2400
    right = sum((r["pred"] > 0.5) == (r["y"] == 1) for r in rows if r["label"] == "y") / 1200
    assert right > 0.97
    ones = [r["pred"] for r in rows if r["label"] == "z" and r["z"] == 1]
    noughts = [r["pred"] for r in rows if r["label"] == "z" and r["z"] == 0]
    above = sum((a > b) + (a == b) / 2 for a in ones for b in noughts) / (len(ones) * len(noughts))
    assert abs(above - 0.5) < 0.08


def test_stops_early_and_keeps_the_best_round(spark):
    models, _ = B.fit_boosted(data(spark), "id", ["a", "b"], ["z"], n_folds=2, rounds=12, depth=3, step=0.8, min_rows=2, patience=2)
    assert len(models.trees) < 12 and all(b <= len(models.trees) for b in models.best)
    for m, b in enumerate(models.best):
        seen = [loss[m] for loss in models.losses if loss[m] is not None]
        assert seen[b] == min(seen)


def test_edges(spark):
    df = data(spark, 40)
    one = df.withColumn("y", F.lit(1))                                      # a constant label
    models, rows = B.fit_boosted(one, "id", {None: ["a"], "y": ["b"]}, ["y"], n_folds=2, rounds=2)
    preds = [r["pred"] for r in B.predict_boosted(models, rows, True).collect()]
    assert len(preds) == 40 and all(0.9 < p < 1 for p in preds)
    none, rows = B.fit_boosted(df.where("id < 0"), "id", ["a", "b"], ["y"], n_folds=2, rounds=2)
    assert none.best == [2, 2]                                              # nothing to measure a round by
    assert B.predict_boosted(none, rows, True).count() == 0
    assert {r["pred"] for r in B.predict_boosted(none, B.binned(df, "id", none), False).collect()} == {0.5}
    void, _ = B.fit_boosted(df.withColumn("y", F.lit(None).cast("int")), "id", ["a"], ["y"], n_folds=2, rounds=1)
    assert void.prior == [0.0, 0.0]
    with pytest.raises(ValueError):
        B.fit_boosted(df, "id", [], ["y"])
    nodes = B.model_table(spark, models)
    assert nodes.where("round = -1").count() == 2
    assert B.gain_importances(nodes).count() <= 2


def test_stored_models_predict_the_same(spark, tmp_path):
    df = data(spark)
    models, _ = B.fit_boosted(df, "id", ["a", "b"], ["z", "y"], n_folds=2, rounds=4, depth=3, min_rows=5)
    B.model_table(spark, models).write.parquet(str(tmp_path / "nodes"))
    back = B.from_table(spark.read.parquet(str(tmp_path / "nodes")))
    tables = [{(r["__key"], r["label"], r["fold"]): r["pred"] for r in B.predict_boosted(m, B.binned(df, "id", m), own_fold=False).collect()}
              for m in (models, back)]
    assert len(tables[0]) == 300 * 4 and tables[0] == tables[1]
    assert B.from_table(B.model_table(spark, back)).best == back.best
    bare = B.from_table(B.model_table(spark, back).where("round < 0"))                  # priors alone
    assert B.predict_boosted(bare, B.binned(df, "id", bare), own_fold=False).select("pred").distinct().count() <= 4
    with pytest.raises(ValueError):
        B.from_table(B.model_table(spark, back).limit(0))


def test_hold_out_and_full_fit(spark):
    df = data(spark)
    test = data(spark, 20, seed=9)
    out = B.boosted_bag_run(df, test, "id", ["a", "b"], ["y", "z"], n_bags=2, rounds=4, patience=2)
    held = {r["id"] for b in (0, 1) for r in out.where(f"split = 'valid' AND bag = {b} AND label = 'y'").collect()}
    assert 60 < len(held) < 160 and out.where("split = 'test'").count() == 20 * 2 * 2
    full = B.full_boosted(df, "id", ["a", "b"], ["y"], rounds=4, min_rows=5)
    assert full.best == [4] and full.folds == full.bags == 1
    known = df.where("y IS NOT NULL")
    assert abs(full.prior[0] - math.log((known.where("y = 1").count() + 0.5) / (known.where("y = 0").count() + 0.5))) < 1e-9


def test_bins(spark):
    df = spark.createDataFrame([(None,), (float("nan"),), (1.0,), (1.5,), (9.0,)], "x double")
    got = [r[0] for r in df.select(B._bins(["x"], [[1.0, 2.0]])).collect()]
    assert [g[0] for g in got] == [3, 3, 0, 1, 2]
    assert B.bin_edges(df.where("x > 100"), ["x"]) == {"x": []}
    assert [g[0][0] for g in df.select(B._bins(["x"], [[]])).collect()] == [1, 1, 0, 0, 0]
