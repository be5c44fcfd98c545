"""Constant, zero and empty columns: no operator divides by zero."""
from pyspark.sql import functions as F

from tessera.functions.vectors import cosine_distance, hamming_distance, jaccard_distance, word_match_share
from tessera.operators import encoders as A, ensemble as EN, numeric as N, sequences as S


def test_blends(spark):
    rows = [(1, 0, 0.0), (1, 1, 0.5), (2, 0, 0.5), (2, 1, 0.25), (3, 2, 0.5), (4, 0, None)]
    df = spark.createDataFrame(rows, "id int, model int, pred double")
    got = {r["id"]: tuple(r)[1:] for r in EN.blends(df, ["id"], {0: 2.0, 1: -2.0}).collect()}
    assert got[1] == (None, None, None) and got[3] == (0.5, 0.5, None) and got[4] == (None, None, None)
    assert got[2][1] == 2 / 6 and got[2][2] is None
    harm = {r["id"]: r["harm"] for r in EN.harmonic_blend(df, ["id"]).collect()}
    assert harm[1] is None and harm[2] == 2 / 6
    only = EN.weighted_blend(df, ["id"], {0: 2.0, 1: -2.0}).collect()
    assert {r["id"]: r["blend"] for r in only} == {1: None, 2: None, 4: None}
    assert EN.blends(df.where("id > 9"), ["id"], {0: 1.0}).count() == 0


def test_polar_coords(spark):
    df = spark.createDataFrame([(1, 5), (2, 5), (3, None)], "id int, v int")
    got = {r["id"]: (r["v_sin"], r["v_cos"]) for r in A.polar_coords(df, "v").collect()}
    assert got == {1: (0.0, 0.0), 2: (0.0, 0.0), 3: (None, None)}
    zero = A.polar_coords(spark.createDataFrame([(1, 0)], "id int, v int"), "v", normalize=False).first()
    assert zero["v_sin"] is None
    assert A.polar_coords(df.where("id > 9"), "v").count() == 0


def test_customer_features(spark):
    df = spark.createDataFrame([(k, 0) for k in range(3)], "row int, customer_id int")
    got = A.customer_features(df, order_col="row", keep=["row"]).collect()
    assert all(r["customer_max_ratio"] is None and r["index_max_ratio"] == 0 for r in got) and len(got) == 3


def test_sentence_vectors(spark):
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [-1.0, 0.0]), ("c", [0.0, 0.0])], "word string, vec array<double>")
    docs = spark.createDataFrame([(1, ["a", "b"]), (2, ["c"]), (3, ["a"]), (4, ["x"]), (5, [])], "id int, tok array<string>")
    got = {r["id"]: list(r["vec"]) for r in S.sentence_vectors(docs, "id", F.col("tok"), vectors).collect()}
    assert got == {1: [0.0, 0.0], 2: [0.0, 0.0], 3: [1.0, 0.0]}


def test_distances(spark):
    rows = [([0.0, 0.0], [1.0, 0.0]), ([], []), ([0.0], [0.0])]
    df = spark.createDataFrame(rows, "u array<double>, v array<double>")
    got = df.select(cosine_distance("u", "v").alias("c"), jaccard_distance("u", "v").alias("j"), hamming_distance("u", "v").alias("h")).collect()
    assert [tuple(r) for r in got] == [(None, 1.0, 0.5), (None, 0.0, None), (None, 0.0, 0.0)]
    assert spark.range(1).select(word_match_share(F.lit(""), F.lit("the")).alias("x")).first()["x"] == 0.0


def test_scales_and_counts(spark):
    df = spark.createDataFrame([(1, 2.0, None), (2, 2.0, None)], "id int, k double, e double")
    s = N.scale_standard(df, ["k", "e"]).collect()
    m = N.scale_minmax(df, ["k", "e"]).collect()
    assert all(r["k"] == 0 and r["e"] is None for r in s + m)
    assert [r["e_count_encode"] for r in A.count_encode(df, ["e"], normalize=True).collect()] == [None, None]
    assert A.count_encode(df.where("id > 9"), ["k"], normalize=True).count() == 0
