"""Nearest-row imputation, lexicon tables, positional blocks, names as data, random trees and
the keyterm graph's layout."""
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import corpus as C, graph, knn, lags as L, sequences as S
from tessera.operators.trees import random_trees
from tessera.sources import files as IO


def plain_knn(rows, k):
    """Every row against every other."""
    out = []
    for x in rows:
        filled = list(x)
        for c, v in enumerate(x):
            if v is not None:
                continue
            near = []
            for y in rows:
                both = [j for j in range(len(x)) if x[j] is not None and y[j] is not None]
                if y[c] is not None and both:
                    near.append((sum((x[j] - y[j]) ** 2 for j in both) / len(both), y[c]))
            near.sort()
            if near:
                cut = near[min(k, len(near)) - 1][0]
                w = [(1 / max(d, knn.LEAST), y) for d, y in near if d <= cut]
                filled[c] = sum(a * y for a, y in w) / sum(a for a, _ in w)
        out.append(filled)
    return out


@pytest.mark.parametrize("pivots,block,k", [(1, 1000, 5), (7, 8, 5), (64, 4, 1), (5, 16, 400)])
def test_knn_against_all_pairs(spark, pivots, block, k):
    rnd = random.Random(pivots)
    rows = [[None if rnd.random() < 0.2 else float(rnd.choice([0, 0, 1, 5, rnd.randint(0, 90)])) for _ in range(3)] for _ in range(150)]
    rows += [[None] * 3, [1.0, None, None], [float("nan"), 2.0, 3.0]] + rows[:9]
    df = spark.createDataFrame([(i, *r, "x") for i, r in enumerate(rows)], "id int, a double, b double, c double, __h string").repartition(3)
    got = {r["id"]: (r["a"], r["b"], r["c"]) for r in knn.impute_knn(df, ["a", "b", "c"], k=k, pivots=pivots, block=block).collect()}
    want = plain_knn([[None if v is None or v != v else v for v in r] for r in rows], k)
    assert len(got) == len(rows)
    for i, w in enumerate(want):
        for g, v in zip(got[i], w):
            assert (g is None) == (v is None) and (g is None or abs(g - v) < 1e-9 * max(1, abs(v))), (i, got[i], w)


def test_knn_edges(spark):
    df = spark.createDataFrame([(1, 2.0)], "id int, a double")
    assert knn.impute_knn(df.where("id > 1"), ["a"]).columns == df.columns
    assert knn.impute_knn(df.where("id > 1"), ["a"]).count() == 0
    assert [tuple(r) for r in knn.impute_knn(df, ["a"]).collect()] == [(1, 2.0)]
    none = spark.createDataFrame([(1, None), (2, None)], "id int, a double")
    assert [r["a"] for r in knn.impute_knn(none, ["a"]).collect()] == [None, None]


def test_knn_plan_has_no_cross_join_and_searches_few_cells(spark):
    rnd = random.Random(4)
    df = spark.createDataFrame([(i, float(i), None if i % 50 == 0 else float(2 * i)) for i in range(4000)], "id int, a double, b double")
    met = []
    real = knn._searched

    def counted(blocks, pairs, k, block):
        met.append(pairs.count())
        return real(blocks, pairs, k, block)

    knn._searched = counted
    try:
        out = knn.impute_knn(df, ["a", "b"], pivots=40, block=100)
        plan = out._jdf.queryExecution().toString()
        assert "Cartesian" not in plan and "NestedLoop" not in plan
        assert all(abs(r["b"] - 2 * r["a"]) < 20 for r in out.collect())
    finally:
        knn._searched = real
    assert met[0] == 80 and met[1] < 80 * 8                # of 40 and more blocks


def test_lexicon_anywhere(spark):
    rnd = random.Random(2)
    texts = ["".join(rnd.choice("abc d\U0001f642é%_\\") for _ in range(rnd.randint(0, 40))) for _ in range(80)] + ["", None, "abcabc"]
    terms = list({"".join(rnd.choice("abc dé%_\\\U0001f642") for _ in range(rnd.randint(1, 5))) for _ in range(150)}) + ["", None, "a", "a"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    lex = spark.createDataFrame([(t,) for t in terms], "term string")
    out = C.lexicon_substring_matrix(docs, "id", F.col("text"), lex)
    want = sorted((i, t) for i, x in enumerate(texts) if x is not None for t in set(terms) if t and t in x)
    assert sorted((r["id"], r["term"]) for r in out.collect()) == want
    assert not any(t and len(t) > 3 and t in out._jdf.queryExecution().toString() for t in terms if t and t.isascii())
    assert C.lexicon_substring_matrix(docs, "id", F.col("text"), lex.where("term = 'zzzz'")).count() == 0


def test_positions_do_not_depend_on_the_scan(spark):
    root = IO.scratch_dir(spark, "test-positions")
    df = spark.range(1000).select("id", (F.col("id") * 7 % 101).alias("v")).repartition(5)
    IO.write_ordered(df.select("id", "v"), f"{root}/a", ["id"], drop=["id"], rows_per_file=33)
    IO.write_ordered(df.select("id"), f"{root}/b", ["id"])
    for size in ("128m", "1k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            got = IO.glue([IO.read_positions(spark, f"{root}/{x}") for x in "ab"]).collect()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert len(got) == 1000 and all(r["id"] == r["position"] and r["v"] == r["id"] * 7 % 101 for r in got)


def test_losses_from_names(spark):
    root = IO.scratch_dir(spark, "test-names")
    for name in ("gru/gru_fold_0_e1_0.0456.txt", "gru/gru_fold_0_e2_0.0311.txt", "gru/gru_fold_1_1.5.txt", "gru/notes.txt", "lstm/x_fold_12_best.txt"):
        IO.write_note(spark, f"{root}/{name}", "x")
    files = IO.list_files(spark, root, "*.txt")
    assert "content" not in files._jdf.queryExecution().executedPlan().toString()
    got = {(r["run"], r["fold"]): (r["n"], r["loss"]) for r in IO.least_losses(IO.checkpoint_losses(files)).collect()}
    assert got == {("gru", 0): (2, 0.0311), ("gru", 1): (1, 1.5)}


def test_random_trees(spark):
    rnd = random.Random(8)
    df = spark.createDataFrame([(i, rnd.random(), float(i % 3), 1.0) for i in range(300)], "id int, a double, b double, k double")
    out = random_trees(df, ["a", "b", "k"], n_trees=3, max_depth=3, seed=5)
    one = {r["id"]: tuple(r)[4:] for r in out.collect()}
    two = {r["id"]: tuple(r)[4:] for r in random_trees(df.repartition(7), ["a", "b", "k"], n_trees=3, max_depth=3, seed=5).collect()}
    assert one == two and len(one) == 300
    assert all(max(v) <= 14 for v in one.values()) and len({v[0] for v in one.values()}) > 3
    assert len({v[:1] for v in one.values()} | {v[1:2] for v in one.values()}) > 4
    same = random_trees(df.select("id", "k"), ["k"], n_trees=2).collect()
    assert all(r["tree0"] == 0 and r["tree1"] == 0 for r in same)
    assert random_trees(df.where("id < 0"), ["a"], n_trees=1).count() == 0


def test_keyterm_graph_is_shuffled_by_document_only(spark):
    df = spark.createDataFrame([(1, ["a", "b", "c", "a"]), (2, ["x"]), (3, [])], "id int, tok array<string>")
    out = graph.keyterm_scores(df, "id", "tok")
    got = {r["id"]: r["keyterm_score"] for r in out.collect()}
    assert abs(got[1] - 1 / 3) < 1e-9 and got[2] == 0 and got[3] == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    plan = plan[plan.index("== Final Plan") if "== Final Plan" in plan else 0:].split("== Initial Plan")[0]
    assert plan.count("hashpartitioning(id") <= 2            # the layout, and the last join's left side


def test_sequences_leave_the_broadcast_to_spark(spark):
    df = spark.createDataFrame([(1, ["a", "b"])], "id int, tok array<string>")
    vocab = spark.createDataFrame([("a", 1)], "word string, index long")
    plan = S.texts_to_sequences(df, "id", "tok", vocab, num_words=10)._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" not in plan


def test_lags_past_any_month(spark):
    rows = [(1, 0, 5.0), (1, 90, 7.0), (1, 95, 1.0), (2, 92, None), (2, 93, 3.0)]
    df = spark.createDataFrame(rows, "customer_id int, date int, target double")
    got = {(r["customer_id"], r["date"], r["lag"]): r["target_lag"] for r in L.lags_long(df, 90, only_target=True, agg_func="max").collect()}
    assert got == {**{(1, 95, j): 7.0 for j in range(5)}, (2, 92, 0): None, (2, 92, 1): None, (2, 93, 0): None, (2, 93, 1): None, (2, 93, 2): None}
    mean = {(r["customer_id"], r["date"], r["lag"]): r["target_lag"] for r in L.lags_long(df, 0, only_target=True).collect()}
    assert mean[1, 95, 89] == 5.0 and mean[1, 95, 90] == 6.0 and len(mean) == 90 + 95 + 92 + 93
    assert L.lags_long(df.where("date < 0"), 0, only_target=True).count() == 0


def test_knn_cells_grow_with_the_vectors(spark, monkeypatch):
    from tessera.operators import knn
    made = []
    deal = knn._with_cells
    monkeypatch.setattr(knn, "_with_cells", lambda v, p: made.append(len(p)) or deal(v, p))
    monkeypatch.setattr(knn, "CELLS_AT_ONCE", 50)
    df = spark.range(900).select("id", F.when(F.col("id") % 9 != 0, F.col("id") * 3 % 101).cast("double").alias("a"), (F.col("id") * 7 % 1000).cast("double").alias("b"))
    got = {r["id"]: r["a"] for r in knn.impute_knn(df, ["a", "b"], k=1, pivots=4, block=50).collect()}
    assert made[0] >= 30                      # about the square root of the vectors, not 4
    known = [(i * 7 % 1000, i * 3 % 101) for i in range(900) if i % 9]
    for i in range(0, 900, 9):
        best = min(abs(b - i * 7 % 1000) for b, _ in known)
        near = [a for b, a in known if abs(b - i * 7 % 1000) == best]
        assert abs(got[i] - sum(near) / len(near)) < 1e-9
