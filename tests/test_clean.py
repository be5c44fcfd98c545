from pyspark.sql import functions as F

from tessera.functions import clean, rules as R


def one(spark, fn, text):
    return spark.createDataFrame([(text,)], "t string").select(fn(F.col("t")).alias("o")).first()["o"]


def test_repair_words_runs(spark):
    assert one(spark, clean.repair_words, "a bb ccc dddddddddd") == "a bb cc dd"
    assert one(spark, clean.repair_words, "") == ""
    assert one(spark, clean.repair_words, "😀😀😀 ééé") == "😀😀 éé"


def test_remove_nonalpha_unicode(spark):
    assert one(spark, clean.remove_nonalpha, "héllo,  wörld! x_1") == "héllo wörld x_1"
    # combining marks are not word characters (Python semantics)
    assert one(spark, clean.remove_nonalpha, "éx") == "e x"


def test_strip_non_ascii(spark):
    assert one(spark, clean.strip_non_ascii, "café ☕ ok") == "caf  ok"


def test_glove_reference_quirks(spark):
    g = lambda t: one(spark, clean.glove_preprocess, t)
    # Q1: real URLs are not caught by "https?:* " ...
    assert "<URL>" not in g("see https://x.org now").replace("see https", "")
    # ... but "www.* " eats to the last space of the line
    assert g("go www.a.com and more text end") == "go <URL>end"
    assert g("I <3 you") == "I <HEART> you"
    assert g("soooo good") == "so <ELONG> good"
    assert g("what!!!") == "what! <REPEAT>"
    assert g("ok :) fine") == "ok <SMILE> fine"
    # digits become <NUMBER> before the smiley rules run
    assert g("8)") == "<NUMBER>)"
    assert g("a/b") == "a / b"


def test_glove_fixed_urls(spark):
    assert one(spark, lambda c: clean.glove_preprocess(c, rules="fixed"),
               "see https://x.org now") == "see <URL> now"


def test_text_to_wordlist(spark):
    t = lambda s: one(spark, clean.text_to_wordlist, s)
    assert t("I'm sure it can't be, isn't it?") == "I am sure it cannot be is not it"
    # Q2: unanchored rules rewrite inside words
    assert t("studios") == "studoperating system"
    assert t(" usa  is big") == " America is big"


def test_contractions_and_basic(spark):
    assert one(spark, clean.replace_contractions, "what's  up, i'm here.") == "what is up i am here"
    assert one(spark, clean.basic_cleaning, "The cat  is ON the\tmat") == "cat mat"
    assert one(spark, clean.basic_cleaning, "   ") == ""


def test_fill_reverse_normalize(spark):
    df = spark.createDataFrame([(None,), ("a b c",)], "t string")
    out = [r[0] for r in df.select(clean.fill_null_text("t")).collect()]
    assert out == [R.NULL_TEXT_SENTINEL, "a b c"]
    assert one(spark, clean.reverse_words, "a b  c") == "c  b a"
    assert one(spark, clean.normalize_text, "Ça ÉTÉ, don't") == "ca ete, do not"
