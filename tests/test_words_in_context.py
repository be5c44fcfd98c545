"""Neighbourhood counts, PMI vectors, the context tagger and text repair."""
import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions.repair import to_ascii, undouble
from tessera.operators import cooccurrence as W
from tessera.operators.lexicon import repair_text
from tessera.operators.tagging import fit_tagger, tag_in_context


def texts(rnd, n):
    return [[rnd.choice("abcdefgh") for _ in range(rnd.randint(0, 12))] for _ in range(n)]


def test_cooccurrences_and_ppmi(spark):
    docs = texts(random.Random(3), 40)
    df = spark.createDataFrame([(t,) for t in docs], "tok array<string>").repartition(3)
    want = Counter()
    for t in docs:
        for i, j in itertools.combinations(range(len(t)), 2):
            if j - i <= 4:
                want[t[i], t[j]] += 12 // (j - i)
                want[t[j], t[i]] += 12 // (j - i)
    co = W.cooccurrences(df, F.col("tok"), 4)
    assert {(r["a"], r["b"]): r["n"] for r in co.collect()} == want
    s = Counter()
    for (a, _), n in want.items():
        s[a] += n
    total = sum(s.values())
    pmi = {(a, b): math.log(n * total / (s[a] * s[b])) - math.log(1.1) for (a, b), n in want.items()}
    got = {(r["a"], r["b"]): r["ppmi"] for r in W.shifted_ppmi(co, 1.1).collect()}
    assert got.keys() == {k for k, v in pmi.items() if v > 0} and all(abs(v - pmi[k]) < 1e-9 for k, v in got.items())
    assert W.shifted_ppmi(W.cooccurrences(df.limit(0), F.col("tok"), 4)).count() == 0


def test_vectors_against_a_dense_solve(spark):
    rnd = random.Random(9)
    docs = [[rnd.choice("abcd" if k % 2 else "efgh") for _ in range(9)] for k in range(60)] + texts(rnd, 10)
    ppmi = W.shifted_ppmi(W.cooccurrences(spark.createDataFrame([(t,) for t in docs], "tok array<string>"), F.col("tok"), 3))
    names = sorted({r["a"] for r in ppmi.collect()})
    m = np.zeros((len(names), len(names)))
    for r in ppmi.collect():
        m[names.index(r["a"]), names.index(r["b"])] = r["ppmi"]
    u, sv, _ = np.linalg.svd(m)
    got = {r["word"]: np.array(r["vec"]) for r in W.word_vectors(ppmi, dim=4).collect()}
    dense = u[:, :4] * np.sqrt(sv[:4])
    x = np.stack([got[n] for n in names])
    for k in range(4):
        if sv[k] - (sv[k + 1] if k + 1 < len(sv) else 0) > 1e-6 and (k == 0 or sv[k - 1] - sv[k] > 1e-6):
            assert min(np.abs(x[:, k] - dense[:, k]).max(), np.abs(x[:, k] + dense[:, k]).max()) < 1e-6


def plain_tagger(tagged, rows):
    names = sorted({t for _, ts in tagged for t in ts})
    step, total, word = Counter(), Counter(), Counter()
    for ws, ts in tagged:
        step.update(zip(["", *ts], ts))
        total.update(ts)
        word.update(zip(ws, ts))
    vocab = len({w for w, _ in word})
    of = Counter()
    for (p, _), n in step.items():
        of[p] += n
    cost = lambda p: round(math.log(p) * 1e6)
    tr = lambda p, t: cost((step[p, t] + 1) / (of[p] + len(names)))
    em = lambda w, t: cost((word[w, t] + 1) / (total[t] + vocab + 1))
    out = []
    for ws in rows:
        best = {"": (0, [])}
        for w in ws:
            best = {t: max(((s + tr(p, t) + em(w, t), path + [t]) for p, (s, path) in sorted(best.items(), reverse=True)), key=lambda x: x[0]) for t in names}
            # equal scores: the first previous tag by name
            best = {t: v for t, v in best.items()}
        out.append(best)
    return names, tr, em, out


def test_tagger_finds_the_best_path(spark):
    rnd = random.Random(5)
    tagged = []
    for _ in range(60):
        ws = [rnd.choice("abcd") for _ in range(rnd.randint(1, 6))]
        tagged.append((ws, ["X" if k and ws[k - 1] == "a" else "Y" if w in "bc" else "Z" for k, w in enumerate(ws)]))
    rows = [[rnd.choice("abcdq") for _ in range(rnd.randint(0, 7))] for _ in range(40)]
    model = fit_tagger(spark.createDataFrame(tagged, "tokens array<string>, tags array<string>"))
    names, tr, em, want = plain_tagger(tagged, rows)
    assert model["tags"] == names
    got = {r["id"]: r["tags"] for r in tag_in_context(spark.createDataFrame(list(enumerate(rows)), "id int, tokens array<string>"), "id", "tokens", model).collect()}
    differs = 0
    for i, ws in enumerate(rows):
        assert len(got[i]) == len(ws)
        if ws:
            score = sum(tr(p, t) + em(w, t) for p, t, w in zip(["", *got[i]], got[i], ws))
            assert abs(score - max(s for s, _ in want[i].values())) <= len(ws) * 2      # logs of two libraries
            single = {w: max(names, key=lambda t: em(w, t)) for w in ws}
            differs += got[i] != [single[w] for w in ws]
    assert differs > 5                                       # the words before decide
    long = spark.createDataFrame([(1, ["a", "b"] * 4000)], "id int, tokens array<string>")
    assert len(tag_in_context(long, "id", "tokens", model).first()["tags"]) == 8000


def test_tagger_edges(spark):
    none = fit_tagger(spark.createDataFrame([], "tokens array<string>, tags array<string>"))
    df = spark.createDataFrame([(1, ["a"]), (2, []), (3, None)], "id int, tokens array<string>")
    assert [r["tags"] for r in tag_in_context(df, "id", "tokens", none).collect()] == [[]] * 3
    many = spark.createDataFrame([([str(k)], [str(k)]) for k in range(201)], "tokens array<string>, tags array<string>")
    with pytest.raises(ValueError, match="tags"):
        fit_tagger(many)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="éüßñ 日本語\U0001f642aя", max_size=12), st.integers(0, 3))
def test_broken_text_heals(text, times):
    broken = text
    for _ in range(times):
        broken = broken.encode("utf-8").decode("latin-1")
    assert undouble(broken) == text


def test_repair_examples(spark):
    assert undouble("Ã¼ber cafÃ© â€œquotesâ€\x9d") == "über café “quotes”" and undouble("déjà vu Ã") == "déjà vu Ã"
    assert undouble("Straße, ßœ") == "Straße, ßœ"
    assert to_ascii("Ærø ﬁn Škoda 日") == "Ærø fin Skoda 日"
    rows = [(1, "fÃ¼r x Ã¼"), (2, None), (3, "plain"), (4, ""), (5, "für")]
    df = spark.createDataFrame(rows, "id int, text string")
    got = {r["id"]: r["text"] for r in repair_text(df, "id", "text").collect()}
    assert got == {1: "für x ü", 2: None, 3: "plain", 4: "", 5: "für"}
    assert {r["id"]: r["t"] for r in repair_text(df, "id", "text", transliterate=True, out_col="t").collect()}[1] == "fur x u"


def test_topics_part_two_vocabularies(spark):
    from tessera.operators.topics import fit_topics, pair_topics, topic_shares
    rnd = random.Random(2)
    rows = [(k, [rnd.choice("abcd") for _ in range(20)] if k % 2 else [rnd.choice("wxyz") for _ in range(20)], [rnd.choice("abcd")] * 5 if k % 2 else []) for k in range(40)]
    df = spark.createDataFrame([*rows, (90, [], None), (91, ["new"], ["q"])], "id int, one array<string>, two array<string>")
    out = {r["id"]: r for r in pair_topics(df.where("id < 90"), "id", F.col("one"), F.col("two"), 2, steps=25).collect()}
    side = {i: max((0, 1), key=lambda z: r[f"one_topic{z}"]) for i, r in out.items()}
    assert len({side[i] for i in out if i % 2}) == 1 and len({side[i] for i in out if not i % 2}) == 1 and side[0] != side[1]
    assert all(abs(r["one_topic0"] + r["one_topic1"] - 1) < 1e-9 for r in out.values())
    assert out[0]["two_topic0"] == 0.5                       # no words: even shares
    counts = df.select("id", F.explode("one").alias("term")).groupBy("id", "term").count().withColumnRenamed("count", "tf")
    topics = fit_topics(counts.where("id < 90"), "id", 2, steps=3)
    sums = topics.agg(F.sum("p0"), F.sum("p1")).first()
    assert all(abs(x - 1) < 1e-9 for x in sums)
    late = {r["id"]: (r["topic0"], r["topic1"]) for r in topic_shares(df, "id", F.col("one"), topics, steps=2).collect()}
    assert late[90] == late[91] == (0.5, 0.5)


def test_difficult_words(spark):
    from tessera.operators.lexicon import difficult_words
    df = spark.createDataFrame([(1, "Apple banana banana cat. Dog"), (2, ""), (3, None)], "id int, text string")
    easy = spark.createDataFrame([("APPLE",)], "word string")
    got = {r["id"]: (r["difficult_words"], r["dale_chall_readability_score"]) for r in difficult_words(df, "id", "text", easy).collect()}
    assert got[1][0] == 1 and abs(got[1][1] - (0.1579 * 20 + 0.0496 * 5 + 3.6365)) < 1e-9
    assert got[2] == (0, None) and got[3] == (0, None)
