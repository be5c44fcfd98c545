"""Fold runs without leak, per-label columns, subspace iteration, missing values, ids and
readers on inputs the fixture lacks."""
import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier, MultilayerPerceptronClassifier
from pyspark.sql import functions as F

from tessera.functions import clean, tokens as T
from tessera.operators import corpus as C, decompose as D, encoders as A, folds as FO, metrics as M, models as MD, numeric as N
from tessera.sources import files as IO
from tessera import session


@pytest.fixture(scope="module")
def noise(spark):
    rng = np.random.default_rng(2)
    rows = [(int(i), *map(float, rng.normal(size=4)), int(rng.integers(0, 2)), int(rng.integers(0, 2))) for i in range(400)]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, d double, y int, z int")


@pytest.mark.parametrize("estimator", [
    lambda lab, s: DecisionTreeClassifier(featuresCol="features", labelCol=lab, maxDepth=10, seed=s),
    lambda lab, s: MultilayerPerceptronClassifier(featuresCol="features", labelCol=lab, layers=[4, 12, 2], maxIter=60, seed=s),
    lambda lab, s: MD.gbt(lab, s, max_iter=5, max_depth=5, validation=False),
])
def test_random_labels_score_half(spark, noise, estimator):
    out = MD.fold_run(noise, None, "id", ["a", "b", "c", "d"], ["y"], n_folds=2, estimator=estimator)
    hit = out.join(noise, "id").agg(F.avg(((F.col("pred") > 0.5).cast("int") == F.col("y")).cast("int")), F.count("*")).first()
    assert hit[1] == 400 and abs(hit[0] - 0.5) < 0.1


def test_per_label_columns(spark, noise):
    df = noise.withColumn("own", F.col("y") + F.lit(0.0))
    tree = lambda lab, s: DecisionTreeClassifier(featuresCol="features", labelCol=lab, maxDepth=3, seed=s)
    out = MD.fold_run(df, None, "id", {None: ["b"], "y": ["own"]}, ["y", "z"], n_folds=2, estimator=tree).join(df, "id")
    ok = {r["label"]: r["ok"] for r in out.groupBy("label").agg(F.avg(
        ((F.col("pred") > 0.5).cast("int") == F.when(F.col("label") == "y", F.col("y")).otherwise(F.col("z"))).cast("int")).alias("ok")).collect()}
    assert ok["y"] > 0.99 and ok["z"] < 0.65
    assert MD.label_features({None: ["b"], "y": ["own", "b"]}, "y") == ["b", "own"] and MD.label_features(["a"], "y") == ["a"]


def test_argmax_strata(spark):
    df = spark.createDataFrame([(0, 0, 0), (1, 1, 0), (2, 0, 1), (3, 1, 1)], "id int, a int, b int")
    assert [r[0] for r in df.select(FO.label_argmax(["a", "b"])).collect()] == [0, 0, 1, 0]


@pytest.fixture(scope="module")
def matrix(spark):
    rng = np.random.default_rng(4)
    low = rng.normal(size=(40, 3)) @ rng.normal(size=(3, 25)) + 0.05 * rng.normal(size=(40, 25))
    low[37:] = 0                                     # documents without terms
    rows = [(i, f"t{j}", float(low[i, j])) for i in range(37) for j in range(25)]
    return low, spark.createDataFrame(rows, "doc long, term string, weight double"), spark.range(40).select(F.col("id").alias("doc"))


@pytest.mark.parametrize("center", [False, True])
def test_subspace_against_dense(spark, matrix, center):
    low, long, keys = matrix
    model = D.fit_subspace(long, "doc", 3, 40, center)
    got = D.transform_subspace(long, keys, "doc", model, "p").orderBy("doc").collect()
    got = np.array([[r["p0"], r["p1"], r["p2"]] for r in got])
    x = low - low.mean(axis=0) if center else low
    u, s, _ = np.linalg.svd(x, full_matrices=False)
    assert np.allclose(model["singular"], s[:3], rtol=1e-6)
    assert all(np.allclose(np.abs(got[:, j]), np.abs(u[:, j] * s[j]), atol=1e-5) for j in range(3))
    assert np.allclose(got.T @ got, np.diag(s[:3] ** 2), atol=1e-4)
    unit = D.transform_subspace(long, keys, "doc", model, "p", normalize=True).collect()
    assert all(abs(sum(v * v for v in r[1:]) - 1) < 1e-9 or r["doc"] >= 37 and not center for r in unit)


def test_keyed_draws(spark):
    df = spark.range(20000)
    a = df.repartition(7).select("id", A.keyed_normal(3, F.col("id")).alias("x"))
    b = df.coalesce(1).select("id", A.keyed_normal(3, F.col("id")).alias("y"))
    j = a.join(b, "id").agg(F.count_if(F.col("x") != F.col("y")), F.avg("x"), F.stddev("x")).first()
    assert j[0] == 0 and abs(j[1]) < 0.03 and abs(j[2] - 1) < 0.03


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (3.0,)], "x double")
    assert [r[0] for r in N.impute_mean(df, ["x"]).collect()] == [1.0, 2.0, 2.0, 3.0]
    assert [r[0] for r in N.impute_median(df, ["x"]).collect()] == [1.0, 2.0, 2.0, 3.0]
    assert [r[0] for r in N.scale_standard(df, ["x"]).collect()] == [-1.0, None, None, 1.0]
    assert [r[0] for r in N.scale_minmax(df, ["x"]).collect()] == [0.0, None, None, 1.0]
    assert [r[0] for r in A.nan_encode(df).collect()] == [0, 1, 1, 0]
    assert [r["nans"] for r in N.row_statistics(df, ["x"]).collect()] == [0, 1, 1, 0]


def test_ids_beyond_32_bits(spark):
    df = spark.createDataFrame([(4_000_000_000,), (-7,), (2**62,), (-2**63,)], "id long")
    assert FO.holdout_split(df, "id", method="knuth").count() == 4
    assert FO.kfold(df, "id", 2, method="knuth").groupBy("fold").count().count() == 2
    g = df.select(T.skipgrams(F.array(*map(F.lit, "abcd")), 2, 2, 1, "id", method="knuth").alias("g"))
    assert all(len(r["g"]) == 2 for r in g.collect())


def test_unicode_space(spark):
    df = spark.createDataFrame([("a  b  c",)], "t string")
    assert df.select(clean.text_to_wordlist("t")).first()[0] == "a b c"


def test_latin1_list_counts_what_it_returns(spark, tmp_path):
    (tmp_path / "l.txt").write_bytes("idiot\nbête\nbad\tline\n\nfoo\n".encode("latin-1"))
    df = IO.read_latin1_list(spark, str(tmp_path / "l.txt"))
    assert sorted(r[0] for r in df.collect()) == ["bête", "foo", "idiot"] and df.count() == 3


def test_no_frequency_cap(spark):
    df = spark.createDataFrame([(k, [f"w{k}", "all"]) for k in range(50)], "doc_id long, tok array<string>")
    assert C.filter_extremes(df, "doc_id", "tok", no_below=1, no_above=0.5).where(F.size("tok") == 1).count() == 50


def test_run_table(spark, tmp_path):
    m = spark.createDataFrame([("x", 0, 0.5), ("x", 1, 0.7), ("y", 0, None)], "label string, fold int, auc double")
    M.record_run(m, f"{tmp_path}/runs", "one")
    M.record_run(m.withColumn("auc", F.col("auc") - 0.1), f"{tmp_path}/runs", "two")
    runs = spark.read.parquet(f"{tmp_path}/runs")
    assert [tuple(r) for r in M.best_runs(runs).collect()] == [("x", "one", pytest.approx(0.6))]
    assert M.macro_auc(m.where("fold = 0")).first()["macro_auc"] == 0.5


def test_cluster_without_shared_folder_is_refused(monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session())
