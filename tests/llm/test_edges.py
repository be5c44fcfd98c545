"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import chat, decontaminate, htmltext, jaccard, langid, linededup, mixing, quality, rules, tokencount

BENCH = [("b1", "second line here third"), ("b2", None), ("b3", ""), (None, "one two"), ("b1", "second line here third")]
LABELS = [(1, 1, 0), (5, 1, None), (5, None, 0), (6, 0, 1), (None, 1, 0), (3, None, None)]


def bench(spark, rows=BENCH):
    return spark.createDataFrame(rows, "item_id string, text string")


def labels(spark, rows=LABELS):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def by_id(df, *cols):
    out = {}
    for r in df.collect():
        out.setdefault(r["doc_id"], []).append(tuple(r[c] for c in cols))
    return out


def test_quality(spark, edge, empty):
    got = by_id(quality.classify(edge, labels(spark)), "n_chars", "perplexity", "accepted")
    assert sum(map(len, got.values())) == edge.count()
    assert got[2] == [(0, None, False)] and got[3] == [(0, None, False)] and got[4] == [(0, None, False)]
    assert got[1][0] == got[1][1] and got[1][0][2] and got[5][0][2]
    assert quality.classify(empty, labels(spark)).count() == 0
    none = by_id(quality.classify(edge, labels(spark, [])), "accepted")
    assert none[1] == [(True,), (True,)] and none[2] == [(False,)]
    assert quality.drop_rejected(edge, labels(spark)).columns == edge.columns


def test_mixing(spark, edge, empty):
    got = mixing.mix(edge)
    assert got.count() == edge.count()
    rows = by_id(got, "size", "taken", "target")
    assert rows[2][0][:2] == (0, 0) and rows[1][0] == rows[1][1]
    assert all(t in (0, s, 2 * s) for v in rows.values() for s, t, _ in v)
    assert mixing.mix(empty).count() == 0
    taken = mixing.mixed_documents(edge)
    assert taken.columns[:len(edge.columns)] == edge.columns and "copies" in taken.columns
    assert taken.where("text is null").count() == 0
    kept = by_id(got.where("taken > 0"), "taken")
    assert {k: len(v) for k, v in by_id(taken, "copies").items()} == {k: len(v) for k, v in kept.items()}


def test_jaccard(spark, edge, empty):
    rows = by_id(jaccard.similar_classes(edge), "class_id", "n_links")
    assert rows[1] == [(1, 1), (1, 1)]                       # the row that is there twice
    assert rows[2] == rows[3] == rows[4] == [(2, 3)]         # texts without words, the null id's too
    assert rows[5] == rows[6] == [(5, 1)] and rows[7] == [(7, 0)]
    assert sorted(rows[None], key=str) == sorted([(None, 0), (2, 3)], key=str)
    assert jaccard.similar_classes(empty).count() == 0
    kept = jaccard.drop_similar(edge)
    assert kept.columns == edge.columns
    assert sorted(by_id(kept, "text"), key=str) == sorted([1, 2, 5, 7, 8, None], key=str) and len(by_id(kept, "text")[1]) == 1


def test_html(spark):
    pages = spark.createDataFrame([(1, None, None), (2, "u", ""), (3, "u", "<p>x <b>y</b>&amp;z"), (3, "u", "<p>x <b>y</b>&amp;z"),
                                   (None, "u", "<div><nav>menu</nav>"), (4, "u", "a < b <"), (5, "u", "<p>" + "w " * 50000)],
                                  "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = [(r["page_id"], r["text"], r["n_chars"]) for r in htmltext.extract(pages, htmltext.fit(pages)).collect()]
    assert sorted(got, key=str)[0][:2] == (1, "") and got.count((3, "x y&z", 5)) == 2
    assert (None, "", 0) in got and (4, "a < b <", 7) in got and (5, " ".join(["w"] * 50000), 99999) in got
    none = pages.where("false")
    assert htmltext.extract(none, htmltext.fit(none)).count() == 0


def test_chat(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", None), (1, 1, "assistant", "<|im_end|>\\</s>"), (1, None, None, "x\ny"),
            (None, 0, "assistant", "q"), (2, 0, "assistant", "\\"), (2, 0, "assistant", "\\")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1))
    f = chat.format_chats(df)
    read = {r["conv_id"]: [(b["role"], list(b["texts"])) for b in r["blocks"]] for r in chat.parsed(f).collect()}
    assert read[1] == [("", ["x\ny"]), ("user", ["a"]), ("assistant", ["", "<|im_end|>\\</s>"])]
    assert read[2] == [("assistant", ["\\", "\\"])] and read[None] == [("assistant", ["q"])]
    assert chat.digests(chat.parsed(chat.format_chats(df.where("false")))).count() == 0


def test_rules(spark, edge, empty):
    rows = by_id(rules.assess(edge), "n_words", "n_repeat_words", "base_failed", "kept")
    assert rows[2] == rows[3] == rows[4] == [(0, 0, True, False)] and rows[1][0] == rows[1][1]
    assert rows[5] == [(30000, 0, False, True)] and sum(map(len, rows.values())) == edge.count()
    assert rules.assess(empty).count() == 0


def test_decontaminate(spark, edge, empty):
    found = decontaminate.find_contamination(edge, bench(spark))
    v = by_id(decontaminate.verdicts(found), "n_words", "n_hit", "n_items", "contaminated")
    assert v[1] == [(12, 4, 1, True)] * 2 and v[2] == [(0, 0, 0, False)] and v[5] == [(30000, 0, 0, False)]
    spans = [r for r in found.where("doc_id = 1").collect()][0]["spans"]
    assert [edge.first()["text"][s["start"]:s["end"]] for s in spans] == ["second line here\nthird"]
    assert decontaminate.find_contamination(empty, bench(spark)).count() == 0
    assert decontaminate.verdicts(decontaminate.find_contamination(edge, bench(spark, []))).where("contaminated").count() == 0
    kept = decontaminate.drop_contaminated(edge, bench(spark))
    assert kept.columns == edge.columns and kept.count() == edge.count() - 2


def test_decontaminate_in_shards(spark, edge):
    """Items beyond one shard give the same rows by several scans."""
    rows = [(f"i{k}", t) for k, t in enumerate(["one two three", "three four", "second line here", "here third line", "no such words"])]
    one = decontaminate.find_contamination(edge, bench(spark, rows))
    more = decontaminate.find_contamination(edge, bench(spark, rows), shard_bytes=40)
    key = lambda df: sorted(map(str, decontaminate.verdicts(df).collect()))
    assert key(one) == key(more)
    a = decontaminate.drop_contaminated(edge, bench(spark, rows))
    b = decontaminate.drop_contaminated(edge, bench(spark, rows), shard_bytes=40)
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_langid(spark, edge, empty):
    model = langid.fit(edge)
    rows = by_id(langid.predict(edge, model), "lang_pred", "score")
    assert rows[2] == rows[3] == rows[4] == [("und", 0.0)] and rows[1][0] == rows[1][1]
    assert rows[8][0][0] == "xx" and all(0 <= s <= 1 for v in rows.values() for _, s in v)
    nothing = langid.fit(empty)
    assert {r["lang_pred"] for r in langid.predict(edge, nothing).collect()} == {"und"}
    assert langid.predict(empty, model).count() == 0


def test_tokencount(spark, edge, empty):
    vocabulary = [("▁", -5.0), ("▁one", -1.0), ("one", -1.0), ("o", -3.0), ("n", -3.0), ("e", -3.0)]
    rows = by_id(tokencount.count_tokens(edge, vocabulary), "n_tokens")
    assert rows[2] == [(0,)] and rows[3] == [(0,)] and rows[1][0] == rows[1][1]
    assert tokencount.count_tokens(empty, vocabulary).count() == 0
    assert by_id(tokencount.count_tokens(edge, []), "n_tokens")[7] == [(len("▁solo".encode()),)]


def test_linededup(spark, edge, empty):
    got = linededup.dedup_lines(edge)
    assert got.columns[:-1] == edge.columns
    rows = by_id(got, "text", "__lines_removed")
    assert rows[1][0] == rows[1][1] == (edge.first()["text"], 0) and rows[2] == [(None, 0)]
    assert linededup.dedup_lines(empty).count() == 0


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages(spark, edge, empty, name, tmp_path):
    labels(spark).write.parquet(f"{tmp_path}/labels.parquet")
    bench(spark).write.parquet(f"{tmp_path}/benchmark.parquet")
    stage = dict(corpus_pipeline.STAGES)[name]
    docs = edge.withColumn("n_chars", F.length("text").cast("long"))
    out = stage(spark, docs, str(tmp_path))
    assert out.columns[:len(docs.columns)] == docs.columns
    assert name == "source_mixing" or out.columns == docs.columns
    assert out.count() <= docs.count()
    assert stage(spark, empty, str(tmp_path)).count() == 0
