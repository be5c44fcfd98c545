"""Joins that keep the large side in place, and work that follows the input (round 3)."""
from pyspark.sql import functions as F

from tessera.operators import corpus as C, encoders as A, groups as G


def _plan(df):
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString()


def _flags(spark, n=3000):
    return spark.range(n).select("id", F.when(F.col("id") % 2 == 0, "N").when(F.col("id") % 4 == 1, "A").otherwise("R").alias("flag"),
                                 (F.col("id") % 7).cast("double").alias("x"))


def test_stream_batches_hold_a_file_for_every_task(spark, monkeypatch):
    import os

    import tessera.streaming as st
    from conftest import SF001
    from tessera.plans.q_sources import p10_streaming_row_features
    seen = {}
    start = st.start_cleaning_stream

    def spy(spark, source, *args, **kw):
        seen["files"] = len([f for f in os.listdir(source.removeprefix('file:')) if f.endswith(".parquet")])
        seen["per_batch"] = kw["max_files_per_trigger"]
        return start(spark, source, *args, **kw)
    monkeypatch.setattr(st, "start_cleaning_stream", spy)
    n = p10_streaming_row_features(spark, SF001).count()
    assert n == spark.read.parquet(f"{SF001}/documents.parquet").count()
    assert seen["files"] >= 8 and 2 <= seen["per_batch"] < seen["files"]


def test_few_groups_leave_the_rows_in_place(spark):
    df = _flags(spark)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plans = [_plan(G.group_transform(df, "flag", ["x"], "mean")), _plan(A.target_mean_encode(df, "flag", "x")), _plan(A.count_encode(df, "flag"))]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert all("BroadcastHashJoin" in p and "SortMergeJoin" not in p for p in plans)
    got = {r["flag"]: r["m"] for r in A.target_mean_encode(df, "flag", "x").groupBy("flag").agg(F.max("flag_target_mean").alias("m")).collect()}
    want = {r["flag"]: r["m"] for r in df.groupBy("flag").agg(F.avg("x").alias("m")).collect()}
    assert got == want


def test_words_without_a_period_are_spread(spark):
    from tessera.operators import sentences as SE
    df = spark.range(400).select("id", F.lit("One word more than two. Then dr. Smith came").alias("t"))
    abbr = spark.createDataFrame([("dr", 1.0)], "word string, score double")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = SE.split_sentences(df, "id", "t", abbr)
        plan = out._jdf.queryExecution().executedPlan().toString()
        got = [r[0] for r in out.where("id = 7").orderBy("no").select("sentence").collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == ["One word more than two.", "Then dr. Smith came"]
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_sequences_shuffle_texts_not_words(spark):
    from tessera.operators import sequences as S
    df = spark.createDataFrame([(1, ["b", "a", "c"]), (2, []), (3, ["zz", "a"]), (4, None)], "id long, tok array<string>")
    vocab = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "word string, index long")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = S.texts_to_sequences(df, "id", "tok", vocab, num_words=3)
        plan = out._jdf.queryExecution().executedPlan().toString()
        got = {r["id"]: r["seq"] for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert got == {1: [2, 1], 2: [], 3: [1], 4: []}
    # no exchange by word: rows meet the vocabulary where their text is
    assert "hashpartitioning(word" not in plan and "BroadcastHashJoin" in plan


def test_deletion_keys_need_no_shuffle(spark):
    from tessera.operators import spelling as SP
    df = spark.createDataFrame([("aab", 1), ("ab", 2), ("x", 3)], "word string, rank long")
    out = SP._deletions(df, ["word", "rank"], 1)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    e = spark.createDataFrame([("aab", "aab"), ("aab", "ab"), ("aab", "aa"), ("ab", "ab"), ("ab", "a"), ("ab", "b"), ("x", "x"), ("x", "")], "word string, e string")
    want = {tuple(r) for r in e.select("word", F.xxhash64(F.lit("d"), "e")).collect()}
    assert {(r["word"], r["key"]) for r in out.collect()} == want
    words = spark.createDataFrame([("aabb",), ("xy",), ("ab",), ("qqqqq",)], "word string")
    assert {tuple(r) for r in SP.correct_words(words, df).collect()} == {("aabb", "aab"), ("xy", "x"), ("ab", "ab"), ("qqqqq", "qqqqq")}



def test_substring_runs_are_not_stored(spark, monkeypatch):
    stored = []
    keep = C.reliable_checkpoint
    monkeypatch.setattr(C, "reliable_checkpoint", lambda df: stored.append(keep(df)) or stored[-1])
    texts = {1: "abcdef xyz", 2: "bcd", 3: "", 4: None, 5: "xy zabc"}
    df = spark.createDataFrame(list(texts.items()), "id long, t string")
    terms = ["abc", "bcde", "z", "xy", "qqq", "abcdef x", ""]
    got = {tuple(r) for r in C.lexicon_substring_matrix(df, "id", F.col("t"), spark.createDataFrame([(t,) for t in terms], "term string")).collect()}
    assert got == {(k, t) for k, x in texts.items() for t in terms if t and x and t in x}
    # rows of one key: each is searched for itself, a hit is listed once a row
    two = spark.createDataFrame([(1, "abc z"), (1, "abc"), (1, "z")], "id long, t string")
    pairs = [tuple(r) for r in C.lexicon_substring_matrix(two, "id", F.col("t"), spark.createDataFrame([("abc",), ("z",)], "term string")).collect()]
    assert sorted(pairs) == [(1, "abc"), (1, "abc"), (1, "z"), (1, "z")]
    # what is stored grows with the terms, not with the texts
    assert sum(s.count() for s in stored[:1]) <= len(terms)


def test_chargrams_are_counted_as_numbers(spark, monkeypatch):
    from collections import Counter

    from tessera.plans import q_text
    texts = ["abcab", "", None, "x", "yz", "aé\U0001F600é\n", "\U0001F600" * 5, "abc", "\x00ab", "a"] * 3
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    monkeypatch.setattr(q_text, "_docs", lambda spark, d: df)
    out = q_text.t5_chargram_counts(spark, "")
    assert "Generate" not in out._jdf.queryExecution().executedPlan().toString()      # no array of texts to spread
    want = Counter(t[i:i + 3] for t in texts if t for i in range(len(t) - 2))
    assert {r["gram"]: r["cnt"] for r in out.collect()} == want
    monkeypatch.setattr(C, "GRAM_CHARS", 4)
    for n in (1, 2, 3, 4):
        want = Counter(t[i:i + n] for t in texts if t for i in range(len(t) - n + 1))
        assert {r["gram"]: r["cnt"] for r in C.chargram_counts(df, "text", n).collect()} == want
