"""Whole work and growth (round 4)."""
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F


def test_topics_keep_nothing_of_their_start(spark, monkeypatch):
    from tessera.operators import blocks as B, decompose as D
    passes, met = [], B.met
    monkeypatch.setattr(B, "met", lambda *a, **kw: passes.append(1) or met(*a, **kw))
    n, rare = 300, 30
    drawn = lambda i, m: F.pmod(F.xxhash64("id", i, F.lit(m)), F.lit(m)).cast("string")
    kind = F.pmod(F.col("id"), F.lit(3)).cast("string")
    tok = F.transform(F.sequence(F.lit(1), F.lit(30)), lambda i: F.concat(F.lit("w"), kind, F.lit("_"), drawn(i, 20)))
    own = F.when(F.col("id") < 2 * rare, F.array(F.concat(F.lit("rare"), F.pmod(F.col("id"), F.lit(rare)).cast("string")))).otherwise(F.array())
    # a rare word stands in two texts of one kind, and alone in a text of its own
    alone = [(1000 + i, [f"rare{i}"]) for i in range(rare)]
    df = spark.range(n).select("id", F.concat(tok, own).alias("tok")).union(spark.createDataFrame(alone, "id long, tok array<string>"))
    top = {r["id"]: int(np.argmax(r[1:])) for r in D.lda_topics(df, "id", "tok", k=3).collect()}
    of = [{top[i] for i in range(n) if i % 3 == a} for a in range(3)]
    assert all(len(x) == 1 for x in of) and len(set.union(*of)) == 3
    assert all({top[1000 + i]} == of[i % 3] for i in range(rare))
    assert len(passes) >= 11                 # ten passes over all texts, and their shares


def test_lexicon_is_looked_up_in_bytes(spark, monkeypatch):
    from tessera.operators import corpus as C, substrings as SU
    rnd = np.random.default_rng(5)
    letters = ["a", "b", " ", "é", "\U0001F642", "ab", "http://example.org/"]
    draw = lambda n: "".join(letters[i] for i in rnd.choice(7, n, p=[.3, .25, .15, .1, .05, .1, .05]))
    texts = [(i, draw(int(rnd.integers(0, 60)))) for i in range(120)] + [(0, "ab" * 30), (1, None), (None, "abab"), (2, ""), (3, "\x00a\x00")]
    whole = "".join(t or "" for _, t in texts)
    cuts = [(int(a), int(n)) for a, n in zip(rnd.integers(0, len(whole), 250), rnd.integers(1, 40, 250))]
    terms = sorted({whole[a:a + n] for a, n in cuts} | {draw(3) for _ in range(50)} | {"http://example.org/a", "http://example.org/zz", "\x00a", "a\x00"} - {""})
    df = spark.createDataFrame(texts, "id long, t string").repartition(3)
    lex = spark.createDataFrame([(t,) for t in [*terms, "", None, terms[0]]], "term string")
    want = sorted((k, t) for k, x in texts if k is not None and x for t in terms if t and t in x)
    for scan, shard in ((SU.SCAN_BYTES, C.LEXICON_BYTES), (300, 700)):
        monkeypatch.setattr(SU, "SCAN_BYTES", scan)
        monkeypatch.setattr(C, "LEXICON_BYTES", shard)
        out = C.lexicon_substring_matrix(df, "id", F.col("t"), lex)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and "Generate" not in plan        # no candidate is spread out, none is shuffled
        assert sorted(tuple(r) for r in out.collect()) == want
    assert C.lexicon_substring_matrix(df, "id", F.col("t"), lex.where("term is null")).count() == 0


def test_words_of_a_text_stay_in_its_row(spark):
    from tessera.operators.sentences import split_sentences, tokenize_texts
    abbr = spark.createDataFrame([("dr", 1.0), ("no", 1.0)], "word string, score double")
    df = spark.createDataFrame([(1, "We met Dr. Smith. He left... then (no. 5) came"), (2, None), (3, " "), (4, "One dr.")], "id long, t string")
    out = tokenize_texts(df, "id", "t", abbr)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "posexplode" not in plan        # no word is sorted or gathered again
    want = {1: "We met Dr. Smith . He left ... then ( no. 5 ) came".split(), 2: [], 3: [], 4: ["One", "dr", "."]}
    assert {r["id"]: r["tokens"] for r in out.collect()} == want
    # rows of one key have the words of all, by place; a row without a key has none
    many = df.union(spark.createDataFrame([(4, "b. C"), (None, "no. x"), (None, "Yes! y")], "id long, t string"))
    got = sorted((r["id"] or 0, r["tokens"]) for r in tokenize_texts(many, "id", "t", abbr).collect())
    assert got == [(0, []), (0, []), (1, want[1]), (2, []), (3, []), *[(4, ["One", "b.", "C", "dr", "."])] * 2]
    s = split_sentences(many, "id", "t", abbr).collect()
    assert sorted((r["id"] or 0, r["no"], r["sentence"]) for r in s)[:2] == [(0, 0, "Yes!"), (0, 1, "no. x y")]


def test_sequences_from_distinct_tokens(spark, monkeypatch):
    from tessera.operators import sequences as S, tokencodes as K
    long = [f"x{i % 700}" for i in range(1500)]
    rows = [(1, ["b", "a", "b", None, ""]), (2, []), (3, None), (4, long), (None, ["a", "q"]), (1, ["a", "a", "c"]), (5, ["\x00"])]
    df = spark.createDataFrame(rows, "id long, tok array<string>").coalesce(2)
    order, counts = {}, {}
    for k, toks in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        for p, t in enumerate(toks or []):
            counts[t] = counts.get(t, 0) + 1
            first = (k is not None, k or 0, p)
            order[t] = min(order.get(t, first), first)
    for chunk in (K.CHUNK_TOKENS, 3):
        monkeypatch.setattr(K, "CHUNK_TOKENS", chunk)
        vocab = S.fit_vocabulary(df, "id", "tok")
        got = {r["word"]: (r["count"], r["index"]) for r in vocab.collect()}
        assert {t: n for t, (n, _) in got.items()} == counts
        ranked = sorted(got, key=lambda t: got[t][1])
        assert [(-counts[t], order[t]) for t in ranked] == sorted((-counts[t], order[t]) for t in ranked)
        out = S.texts_to_sequences(df, "id", "tok", vocab, num_words=650)
        index = {t: i for t, (_, i) in got.items() if i < 650 and t is not None}
        def of(k):
            return [x for _, x in sorted((p, index[t]) for k2, toks in rows if k2 == k for p, t in enumerate(toks or []) if t in index)] if k else []
        assert sorted((r["id"] or 0, r["seq"]) for r in out.collect()) == sorted((k or 0, of(k)) for k, _ in rows)
    assert "posexplode" not in vocab._jdf.queryExecution().toString() + out._jdf.queryExecution().toString()
    # a word that the vocabulary lists twice has both its indices
    two = spark.createDataFrame([("a", 2), ("a", 9), ("b", 5)], "word string, index int")
    assert {tuple(r["seq"]) for r in S.texts_to_sequences(df.where("id = 1"), "id", "tok", two).collect()} == {(2, 5, 9, 2, 2, 9, 9, 5)}
    chars = [r[0] for r in spark.createDataFrame([("aÉ\U0001F642\n",), ("",), (None,)], "t string").select(S.char_tokens("t")).collect()]
    assert chars == [["a", "é", "\U0001F642", "\n"], [], None]


def test_terms_travel_in_packed_pieces(spark, monkeypatch):
    from collections import Counter

    from tessera.operators import blocks as B, corpus as C, exchange as X
    rnd = np.random.default_rng(3)
    texts = [(i % 90 if i != 50 else None, [["a", "é", "", "w%d" % rnd.integers(0, 40), None, "only%d" % i][j] for j in rnd.integers(0, 6, int(rnd.integers(0, 30)))]) for i in range(100)]
    texts += [(200, []), (201, None)]
    df = spark.createDataFrame(texts, "id long, tok array<string>").repartition(3)
    tf = {}
    for k, t in texts:
        tf.setdefault(k, Counter()).update(x for x in t or [] if x is not None)
    freq = Counter(t for c in tf.values() for t in c)
    monkeypatch.setattr(B, "BLOCK_TOKENS", 150)
    pieces = X.counted_blocks(df, "id", "tok")
    assert pieces.select("blk").distinct().count() > 4 and pieces.select("shard").distinct().count() > 3
    for lo, hi, norm in ((2, 0.5, "l2"), (0.05, 1.0, None), (1, 3, "l1")):
        out = C.tfidf(df, "id", F.col("tok"), min_df=lo, max_df=hi, norm=norm)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(term" not in plan and "hashpartitioning(__word" not in plan       # terms are no rows of a shuffle
        a, z = lo if isinstance(lo, int) else int(np.ceil(102 * lo)), hi if isinstance(hi, int) else int(np.floor(102 * hi))
        want = {}
        for k, c in tf.items():
            w = {t: n * (np.log(103 / (1 + freq[t])) + 1) for t, n in c.items() if a <= freq[t] <= z}
            size = {"l2": np.sqrt(sum(x * x for x in w.values())), "l1": sum(w.values()), None: 1.0}[norm]
            want.update({(k, t): (c[t], freq[t], round(x / size, 9)) for t, x in w.items()})
        rows = out.collect()
        assert {(r["id"], r["term"]): (r["tf"], r["df"], round(r["weight"], 9)) for r in rows} == want and len(rows) == len(want)
    a = pa.array(["x", "", "yz", "é"] * 2)
    assert X.strings(*X.string_arrays(a[1:6])).to_pylist() == a[1:6].to_pylist()
    assert [x.tolist() for x in X.unpack(X.pack(np.arange(3, dtype=np.uint32), np.zeros(0)))] == [[0, 1, 2], []]


def test_own_rows_are_not_multiplied_again(spark, monkeypatch):
    from tessera.operators import blocks as B, decompose as D
    runs, beside = [], B.beside
    monkeypatch.setattr(B, "beside", lambda *a, **kw: runs.append(1) or beside(*a, **kw))
    rnd = np.random.default_rng(7)
    m = rnd.poisson(np.outer(rnd.random(30) * 4, rnd.random(12)))
    df = spark.createDataFrame([(i, [f"t{j}" for j in range(12) for _ in range(m[i, j])]) for i in range(30)], "id long, tok array<string>")
    for method in ("svd", "pca"):
        runs.clear()
        got = np.array([r[1:] for r in D.reduced_text(df, "id", "tok", k=2, method=method).orderBy("id").collect()])
        u, s, _ = np.linalg.svd(m - m.mean(axis=0) if method == "pca" else m, full_matrices=False)
        assert np.abs(np.abs(got) - np.abs(u[:, :2] * s[:2])).max() < 1e-6 * s[0]
        assert len(runs) == 5               # four steps and the scores


def test_topic_passes_deal_the_texts_once(spark):
    from tessera.operators import blocks as B
    docs = spark.createDataFrame([(0, ["a", "b"]), (1, ["b"])], "blk int, tok array<string>").repartition(2, "blk").persist()
    held = spark.createDataFrame([(0, "a"), (0, "b"), (1, "b")], "blk int, word string")
    import pyarrow as pa
    out = B.met(docs, held, 2, lambda a, w: pa.table({"n": [a.num_rows * 10 + w.num_rows]}), "n long")
    assert sorted(r["n"] for r in out.collect()) == [11, 12]
    plan = out._jdf.queryExecution().executedPlan().toString()
    plan = plan[plan.index("== Final Plan") if "== Final Plan" in plan else 0:].split("== Initial Plan")[0]
    assert "InMemoryTableScan" in plan and "Exchange" not in plan.split("InMemoryTableScan")[0]
    docs.unpersist()
