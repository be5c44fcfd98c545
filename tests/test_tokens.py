from pyspark.sql import functions as F

from tessera.functions import tokens as T


def arr(spark, expr_fn, text, schema="t string"):
    return spark.createDataFrame([(text,)], schema).select(expr_fn(F.col("t")).alias("o")).first()["o"]


def test_tokenize_words(spark):
    assert arr(spark, T.tokenize, "Hi, there! x_1") == ["Hi", ",", "there", "!", "x_1"]
    assert arr(spark, T.words, "Hi, THERE") == ["hi", "there"]


def test_ngrams_edges(spark):
    df = spark.createDataFrame([(["a", "b", "c"],), (["a"],), ([],)], "tok array<string>")
    got = [r[0] for r in df.select(T.ngrams("tok", 2)).collect()]
    assert got == [["a b", "b c"], [], []]
    got3 = [r[0] for r in df.select(T.ngrams("tok", 3, sep=None)).collect()]
    assert got3 == [[["a", "b", "c"]], [], []]


def test_chargrams_honours_n(spark):
    assert arr(spark, lambda c: T.chargrams(c, 2), "abcd") == ["ab", "bc", "cd"]
    assert arr(spark, lambda c: T.chargrams(c, 3), "ab") == []
    assert arr(spark, lambda c: T.chargrams(c, 2), "é😀x") == ["é😀", "😀x"]


def test_skipgrams_seeded_ordered(spark):
    df = spark.createDataFrame([(1, "a b c d e f g"), (2, "a b")], "id long, t string")
    sk = lambda seed: [r[0] for r in df.orderBy("id").select(
        T.skipgrams(T.tokenize("t"), 2, 3, seed, "id")).collect()]
    first, again = sk(7), sk(7)
    assert first == again
    grams = ["a b", "b c", "c d", "d e", "e f", "f g"]
    assert len(first[0]) == 3 and first[0] == sorted(first[0], key=grams.index)
    assert first[1] == ["a b"]          # fewer n-grams than asked: all of them


def test_remove_stops_and_chop(spark):
    df = spark.createDataFrame([(["the", "Cat", "the", "sat"],)], "tok array<string>")
    assert df.select(T.remove_stops("tok")).first()[0] == ["Cat", "sat"]
    assert df.select(T.chop("tok", 2)).first()[0] == ["th", "Ca", "th", "sa"]


def test_keras_words(spark):
    assert arr(spark, T.keras_words, "Hello, World!! it's-ok") == ["hello", "world", "it's", "ok"]
