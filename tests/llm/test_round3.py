"""Personal data, collocations and centroid clusters against brute force; edge frames."""
import math
import os
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import centroids, chat, collocations, common, htmltext, langid, mixing, pii, rules

FINDER = pii.Finder()


def base_spans(text):
    """The base kinds by the contract's own patterns."""
    out = []
    digits = lambda m: re.sub("[^0-9]", "", m)
    for k, p, good in [
        (0, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", lambda m: True),
        (1, r"[0-9]+(?:\.[0-9]+){3}", lambda m: all(int(x) <= 255 for x in m.split("."))),
        (2, r"[0-9](?:[ -]?[0-9])+", lambda m: 14 <= len(digits(m)) <= 19 and luhn(digits(m))),
        (3, r"\+[0-9][ ().0-9-]+[0-9]", lambda m: 10 <= len(digits(m)) <= 15)]:
        out += [(m.start(), k, m.end()) for m in re.finditer(p, text) if good(m[0])]
    return sorted(out)


def luhn(d):
    doubled = {c: sum(map(int, str(2 * int(c)))) for c in "0123456789"}
    return (sum(int(c) for c in d[-1::-2]) + sum(doubled[c] for c in d[-2::-2])) % 10 == 0


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="ab.@+-1234 5()0\nÄé_", max_size=60))
def test_base_spans_of_any_text(text):
    assert [s for s in FINDER.spans(text) if s[1] < 4] == base_spans(text)


def test_base_spans_of_digits():
    rnd = random.Random(3)
    for _ in range(4000):
        text = "".join(rnd.choices(["4", "0", "7", "25", ".", " ", "-", "+", "4111111111111111", "@x.y", "("], k=rnd.randint(1, 25)))
        assert [s for s in FINDER.spans(text) if s[1] < 4] == base_spans(text), text


def named(text):
    return [(pii.KINDS[k], text[a:b]) for a, k, b in FINDER.spans(text)]


def test_added_spans():
    assert named("ruf jürgen.müller@käse.example.com an")[0] == ("address", "jürgen.müller@käse.example.com")
    assert named("ruf jürgen@example.com an") == [("address", "jürgen@example.com"), ("email", "rgen@example.com")]
    assert named("see sftp://anna:geheim@host1/x") == [("address", "sftp://anna:geheim@host1")]
    assert named("IBAN: DE89 3704 0044 0532 0130 00 and") == [("account", "DE89 3704 0044 0532 0130 00")]
    assert named("IBAN: DE88 3704 0044 0532 0130 00") == []
    assert named("Passport No. X1234567, acct number: 12-345-678") == [("account", "X1234567"), ("account", "12-345-678")]
    assert named("see https://example.com/a?b=c and the token = 0123abc and account of 12") == []


def test_personal_data_edges(spark, edge, empty):
    found = pii.digests(pii.find_personal(edge)).collect()
    assert len(found) == edge.count() and all(r["spans"] == "" for r in found)
    assert pii.find_personal(empty).count() == 0
    rows = [(1, "mail anna@example.org now"), (1, "mail anna@example.org now"), (2, None), (3, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text as `text.x`", "text", "text as spans")
    got = pii.digests(pii.find_personal(docs)).orderBy("doc_id").collect()
    assert [(r["n_email"], r["spans"]) for r in got] == [(1, "email:5:21")] * 2 + [(0, "")] * 2
    masked = pii.mask_personal(docs)
    assert masked.columns == docs.columns
    assert [r["text"] for r in masked.orderBy("doc_id").collect()] == ["mail <EMAIL> now"] * 2 + [None, ""]


def test_long_runs_take_linear_time():
    for text in ("a" * 400_000 + "@", "1" * 400_000, "1.1" * 200_000, "+1 " * 200_000, "a@" * 300_000, "iban " * 100_000):
        assert [s for s in FINDER.spans(text) if s[1] == 0] == []


# -- collocations ---------------------------------------------------------------------------

def brute(rows, least, longest, top, keep_pct=100):
    counts, total = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            w = [x for x in re.split("[ \t]", piece) if x]
            total[lang] += len(w)
            for n in range(1, longest + 1):
                counts.update((lang, tuple(w[i:i + n])) for i in range(len(w) - n + 1))
    cand = {k: a for k, a in counts.items() if len(k[1]) > 1 and a >= least}
    out = {}
    for (lang, w), a in cand.items():
        inside = any(l2 == lang and len(v) > len(w) and 100 * b >= keep_pct * a and any(v[i:i + len(w)] == w for i in range(len(v) - len(w) + 1))
                     for (l2, v), b in cand.items())
        score, _, l, r = min((1000 * a * total[lang] // (counts[lang, w[:k]] * counts[lang, w[k:]]), k, counts[lang, w[:k]], counts[lang, w[k:]]) for k in range(1, len(w)))
        if not inside:
            out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), l, r))
    return sorted((lang, k, p.decode(), -a, l, r, total[lang], -s) for lang, v in out.items() for k, (s, a, p, l, r) in enumerate(sorted(v)[:top], 1))


def phrases_text(rnd, n):
    stock = ["of the", "in spite of the", "Strasse nach Köln", "a", "b", "the", "aa aa aa", "日本 語"]
    return "".join(rnd.choice(stock) + rnd.choice([" ", " ", "  ", "\t", ". ", "\n", ", "]) for _ in range(n))


@pytest.mark.parametrize("shard_words,keep_pct,longest", [(2_000_000, 100, 5), (60, 100, 5), (60, 70, 3), (40, 100, 2)])
def test_collocations(spark, shard_words, keep_pct, longest):
    rnd = random.Random(5)
    rows = [(phrases_text(rnd, rnd.randint(0, 30)), rnd.choice(["en", "de", None, "und"])) for _ in range(60)] + [(None, "en"), ("", None), (" . ", "en")]
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(5)
    got = collocations.collocations(docs, min_count=6, max_words=longest, top=9, keep_pct=keep_pct, shard_words=shard_words)
    assert sorted(map(tuple, got.collect())) == brute(rows, 6, longest, 9, keep_pct)


def test_index_extends_both_ways():
    """Every order of sides lists the same phrases with the same counts."""
    rnd = np.random.default_rng(7)
    x = np.r_[rnd.integers(0, 4, 500), 0].astype(np.int32)
    for depth in (2, 3, 5):
        index = collocations.WordIndex(x, depth)
        for sides in (["left"] * 4, ["right"] * 4, ["left", "right", "right", "left"]):
            now = index.single()
            for n, side in enumerate(sides[:depth - 1], 2):
                now = index.extended(now, side)
                want = Counter(tuple(x[i:i + n]) for i in range(len(x) - n + 1) if (x[i:i + n] > 0).all())
                assert {tuple(w): c for w, c in zip(now.words, now.size)} == want and len(now.size) == len(want)


def test_collocation_edges(spark, edge, empty):
    assert collocations.collocations(empty).count() == 0
    assert collocations.collocations(edge).count() == 0
    few = collocations.collocations(edge, min_count=2).collect()
    assert {r["lang"] for r in few} == {"en"} and all(r["a"] >= 2 and r["n"] > 30000 for r in few)


# -- centroids ------------------------------------------------------------------------------

def lloyd(rows, k, dims, scale, rounds):
    import hashlib
    good = [(i, [int(np.floor(scale * float(x))) for x in v]) for i, v in rows
            if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted(good, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    c = [v for _, v in first]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, m)), j) for j, m in enumerate(c))
    for _ in range(rounds):
        at = [near(v)[1] for _, v in good]
        c = [[sum(col) // len(col) for col in zip(*[v for (_, v), a in zip(good, at) if a == j])] if j in at else m for j, m in enumerate(c)]
    return sorted(((i, *near(v)[::-1]) for i, v in good), key=str), c


@pytest.mark.parametrize("k,dims,rounds", [(16, 8, 3), (5, 1, 2), (40, 3, 4)])
def test_clusters(spark, k, dims, rounds):
    rnd = random.Random(k)
    rows = [(i if i % 13 else None, [rnd.choice([-1.5, -0.02, 0.0, 0.01, 0.4, 3.0, rnd.gauss(0, 1)]) for _ in range(dims)]) for i in range(200)]
    rows += rows[:20]                                        # repeated rows, equal centroids
    rows += [(900, None), (901, []), (902, [None] * dims), (903, [float("nan")] * dims), (904, [float("inf")] * dims), (905, [0.5] * (dims + 1))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    got, c = centroids.cluster(df.selectExpr("vec_id", "embedding", "1 as cluster", "2 as v"), k=k, dims=dims, rounds=rounds)
    want, centers = lloyd(rows, k, dims, 64, rounds)
    assert sorted(((r["vec_id"], r["cluster"], r["distance"]) for r in got.collect()), key=str) == want
    assert c.tolist() == centers
    sums = Counter()
    for _, j, d in want:
        sums[j] += d
    assert all(r["cluster_inertia"] == sums[r["cluster"]] and r["inertia"] == sum(sums.values()) for r in got.collect())


def test_walk_stops_only_when_nothing_can_be_nearer():
    rnd = np.random.default_rng(1)
    for scale in (2, 50):                                    # many ties, few ties
        c = rnd.integers(-scale, scale + 1, (12, 3))
        x = rnd.integers(-scale, scale + 1, (2000, 3))
        d = ((x[:, None] - c[None]) ** 2).sum(axis=2)
        who, best = centroids.Lists(c).nearest(x)
        assert (who == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()


def test_cluster_edges(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    got, c = centroids.cluster(none)
    assert got.count() == 0 and len(c) == 0
    one = spark.createDataFrame([(4, [0.5] * 64)], "vec_id long, embedding array<float>")
    assert [tuple(r)[:5] for r in centroids.cluster(one)[0].collect()] == [(4, 0, 0, 0, 0)]
    with pytest.raises(Exception, match="too large"):
        centroids.cluster(spark.createDataFrame([(4, [1e9] * 64)], "vec_id long, embedding array<double>"))[0].count()


# -- language ID by plain dictionaries ----------------------------------------------------------

M32 = 0xFFFFFFFF


def cells(text):
    """Cell -> count, one character at a time."""
    t, out = " ", Counter()
    for c in (text or "").lower():
        if c.isalpha():
            t += c
        elif t[-1] != " ":
            t += " "
    t += "" if t[-1] == " " else " "
    two = []
    for c in t:
        out[(ord(c) * 0x9E3779B1 & M32) >> 32 - langid.BITS] += 1
    for a, b in zip(t, t[1:]):
        two.append((ord(a) * 0x85EBCA6B & M32) ^ (ord(b) * 0xC2B2AE35 + 0x27D4EB2F & M32))
        out[(two[-1] * 0x9E3779B1 & M32) >> 32 - langid.BITS] += 1
    for x, c in zip(two, t[2:]):
        three = (x * 0x165667B1 & M32) ^ (ord(c) * 0xD3A2646C + 0xFD7046C5 & M32)
        out[(three * 0x85EBCA77 & M32) >> 32 - langid.BITS] += 1
    return out


def test_languages_against_dictionaries(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    d = d.where("length(text) < 3000").withColumn("lang", F.concat("lang", F.lit("-"), (F.col("doc_id") % 3).cast("string")))
    rows = [r for r in d.collect() if any(c.isalpha() for c in r["text"])]
    model = langid.fit(d)
    df = Counter(c for r in rows for c in cells(r["text"]))
    idf = {c: math.log((1 + len(rows)) / (1 + n)) + 1 for c, n in df.items()}

    def unit(v):
        n = math.sqrt(sum(x * x for x in v.values()))
        return {k: x / n for k, x in v.items()} if n else v

    vector = {r["doc_id"]: unit({c: (1 + math.log(n)) * idf[c] for c, n in cells(r["text"]).items()}) for r in rows}
    whole = langid._shard(model, 0, 1)
    centroids = [(whole["langs"][k], dict(enumerate(c.tolist()))) for k, c in zip(whole["of"], whole["centroids"])]
    cosine = lambda v, c: sum(x * c[k] for k, x in v.items())
    # the centroids are the directions of the texts nearest to them
    for lang in whole["langs"]:
        own = [c for k, c in centroids if k == lang]
        assert len(own) <= langid.CLUSTERS
        groups = [Counter() for _ in own]
        for r in rows:
            if r["lang"] == lang:
                v = vector[r["doc_id"]]
                groups[max(range(len(own)), key=lambda j: cosine(v, own[j]))].update(v)
        for g, c in zip(groups, own):
            assert not g or cosine(unit(g), c) > 0.99
    want = {}
    for r in rows:
        best = max(range(len(centroids)), key=lambda j: cosine(vector[r["doc_id"]], centroids[j][1]))
        want[r["doc_id"]] = (centroids[best][0], cosine(vector[r["doc_id"]], centroids[best][1]))
    ranked = {r["doc_id"]: sorted((cosine(vector[r["doc_id"]], c) for _, c in centroids), reverse=True)[:2] for r in rows}
    for shard_langs in (256, 3):                             # one scan and several
        got = {r["doc_id"]: r for r in langid.predict(d, model, shard_langs=shard_langs).collect()}
        for i, (lang, s) in want.items():
            assert abs(got[i]["score"] - s) < 1e-4
            assert got[i]["lang_pred"] == lang or ranked[i][0] - ranked[i][1] < 1e-4


def test_more_languages_than_a_shard(spark):
    """Every language is learned, the last by name too."""
    rows = [(k, f"{chr(0x4E00 + 7 * k) * 3} {chr(0x4E00 + 7 * k + 1) * 2}", f"l{k:03d}") for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs)
    for n in (256, 7):
        assert {r["doc_id"]: r["lang_pred"] for r in langid.predict(docs, model, shard_langs=n).collect()} == {k: x for k, _, x in rows}


# -- rule cascade, chat ties, mixed columns, scratch tables ------------------------------------------

def test_kept_documents_agree_with_the_cascade(spark, edge, empty):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = {r["doc_id"] for r in rules.assess(d).where("kept").collect()}
    for order in (None, list(reversed(rules.NEEDS))):
        assert {r["doc_id"] for r in rules.kept_documents(d, order=order).collect()} == want
    assert rules.kept_documents(edge).columns == edge.columns and rules.kept_documents(empty).count() == 0
    order = rules.order_of(d)
    assert sorted(order) == sorted(rules.NEEDS) and rules.order_of(d.repartition(5), sample_rows=50)


def test_chat_ties_go_by_text(spark):
    rows = [(1, 0, "user", "<|x"), (1, 0, "user", "<a"), (1, 1, "assistant", None)]
    out = chat.parsed(chat.format_chats(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string"))).first()
    assert [list(b["texts"]) for b in out["blocks"]] == [["<a", "<|x"], [""]]
    long = spark.createDataFrame([(1, k, "user", f"t{k}") for k in range(20_000)], "conv_id int, turn int, role string, text string")
    assert len(chat.parsed(chat.format_chats(long)).first()["blocks"][0]["texts"]) == 20_000


def test_mix_keeps_its_columns(spark):
    docs = spark.createDataFrame([(1, "a b", "s", "mine")], "doc_id long, text string, source string, taken string")
    out = mixing.mixed_documents(docs)
    assert out.first()["taken"] == "mine" and out.first()["mix_taken"] == 2 and "copies" in out.columns


def test_scratch_tables_go(spark):
    with common.scratch(spark):
        t = common.stored(spark.range(3))
        path = t.inputFiles()[0].removeprefix("file://")
        assert os.path.exists(path)
    assert not os.path.exists(os.path.dirname(path))


# -- pages: article text that must stay --------------------------------------------------------------

def shown(page):
    return htmltext.main_text(page, htmltext.weights({}))


W = "several words of text that stand here for reading"


@pytest.mark.parametrize("page,kept", [
    (f"<article><p>one {W}</p><img alt=Bob's src=x><p>two {W}</p><p>it's three {W}</p></article>", ["one", "two", "three"]),
    (f"<article><p>{W}</p><pre><code>x = 1 <span class=\"hljs-comment\"># the answer</span></code></pre><p>end {W}</p></article>", ["# the answer", "end"]),
    (f"<article><p class=\"share-price\">prices rose {W}</p><div class=\"search-results-explained\"><p>how it works {W}</p></div></article>", ["prices rose", "how it works"]),
    (f"<article><p>one {W}</p><script>var x = '<p>';</script foo><p>two {W}</p></article>", ["one", "two"]),
    ("<article><h1>News</h1>" + "<div><img src=a.png></div>" * 12 + f"<p>story {W}</p></article>", ["News", "story"]),
    (f"<div><p>first {W} {W}</p><ul>" + "".join(f"<li><a href=/{k}>link {k}</a></li>" for k in range(30)) + f"</ul><p>last {W} {W} {W} {W}</p></div>", ["first", "last"]),
    (f"<article><p title=\"a>two {W}</p></article>", ["two"]),
    (f"<article><a href=/x/>label</a><p>one {W}</p></article>", ["one"]),
])
def test_page_text_that_stays(page, kept):
    text = shown(page)
    assert all(k in text for k in kept) and "<" not in text.replace("<p>", "") and "title=" not in text, text


def test_page_parts_that_go():
    text = shown(f"<article><p>one {W}</p><div class='comment-list'><p>nice post</p></div><div class='related-posts'>more here</div>"
                 f"<div class='ad'>buy</div><aside>side</aside><p>two {W}</p></article>")
    assert "one" in text and "two" in text and not any(x in text for x in ("nice post", "more here", "buy", "side"))


def test_page_depth_takes_linear_time():
    for page in ("<div>" * 100_000 + "word", "<b>" * 100_000 + "</i>" * 1000 + "word", "<p><div>" + "<b>" * 50_000 + "<hr>" * 50_000):
        shown(page)
