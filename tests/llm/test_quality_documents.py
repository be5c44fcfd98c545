"""Perplexity, cost, thresholds and verdict of every document against plain dictionaries, and
texts that only their order or repetition gives away."""
import math
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.llm import quality

SMALL = "/root/testdata/sf0.001"


def plain_grams(text, order):
    t = "".join("0" if c in "123456789" else " " if c in "\x02\x03" else c for c in " ".join(text.split()))
    t = "\x02" * (order - 1) + t + "\x03"
    return [t[k:k + order] for k in range(len(t) - order + 1)]


class Model:
    """Interpolated modified Kneser-Ney over the n-grams of some texts; letters of the corpus."""

    def __init__(self, texts, order, letters):
        self.letters, self.c, self.d, self.ctx = letters, {}, {}, {}
        c = Counter(g for t in texts for g in plain_grams(t, order))
        for k in range(order, 0, -1):
            n = Counter(c.values())
            d = (0.5, 0.5, 0.5)
            if n[1] and n[2]:
                y = n[1] / (n[1] + 2 * n[2])
                d = tuple(min(max(x, 0.05), m) for x, m in ((1 - 2 * y * n[2] / n[1], 0.95), (2 - 3 * y * n[3] / n[2], 1.95),
                                                            (3 - 4 * y * n[4] / n[3] if n[3] else 1.5, 2.95)))
            total, off = Counter(), Counter()
            for g, m in c.items():
                total[g[:-1]] += m
                off[g[:-1]] += d[min(m, 3) - 1]
            self.c[k], self.d[k], self.ctx[k] = c, d, (total, off)
            c = Counter(g[1:] for g in c)

    def p(self, g):
        k = len(g)
        if not k:
            return 1 / self.letters
        low, (total, off), m = self.p(g[1:]), self.ctx[k], self.c[k][g]
        if not total[g[:-1]]:
            return low
        return ((m - self.d[k][min(m, 3) - 1] if m else 0) + off[g[:-1]] * low) / total[g[:-1]]


def quantile(values, q):
    v = sorted(values)
    return v[max(0, math.ceil(q * len(v)) - 1)]


def verdicts(rows, trusted, order):
    """(perplexity, cost, least, threshold, accepted) of each row (id, text, lang)."""
    texts = {i: t for i, t, _ in rows if t and t.split()}
    fold = {i: zlib.crc32(" ".join(t.split()).lower().encode()) % 2 for i, t in texts.items()}
    letters = len({g[-1] for t in texts.values() for g in plain_grams(t, order)}) + 1
    models = [Model([t for i, t in texts.items() if i in trusted and fold[i] != f], order, letters) for f in (0, 1)]
    n = {i: len(plain_grams(t, order)) for i, t in texts.items()}
    rate = {i: -sum(math.log(models[fold[i]].p(g)) for g in plain_grams(t, order)) / n[i] for i, t in texts.items()}
    by = defaultdict(list)
    for i, _, lang in rows:
        if i in texts:
            by[lang].append(i)
    out = {}
    for ids in by.values():
        good = [i for i in ids if i in trusted]
        med = quantile([rate[i] for i in good or ids], 0.5)
        cost = {i: (rate[i] * n[i] + quality.SHRINK * med) / (n[i] + quality.SHRINK) for i in ids}
        q1, q3 = quantile(cost.values(), 0.25), quantile(cost.values(), 0.75)
        top = q3 + quality.OWN_FENCE * max(q3 - q1, quality.LEAST_SPREAD * q3)
        low = q1 - quality.OWN_FENCE * max(q3 - q1, quality.LEAST_SPREAD * q1)
        if good:
            w = len(good) / (len(good) + quality.PRIOR_TEXTS)
            top += w * (quantile([cost[i] for i in good], 1 - quality.LOSS) - top)
            low += w * (quantile([cost[i] for i in good], quality.LOW_LOSS) * (1 - quality.LEAST_SPREAD) - low)
        out.update({i: (math.exp(rate[i]), cost[i], low, top, low <= cost[i] <= top) for i in ids})
    return out


@pytest.mark.parametrize("order,shard_rows", [(3, 1 << 22), (5, 4000)])
def test_every_document(spark, order, shard_rows):
    d = spark.read.parquet(f"{SMALL}/documents.parquet").where("length(text) < 2500").select("doc_id", "text", "lang")
    d = d.unionByName(spark.createDataFrame([(9001, "a \x02 b\x03 12", "en"), (9002, " ", "en"), (9003, None, "xx"), (9004, "solo", None)], d.schema))
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    trusted = {r["doc_id"] for r in quality.trusted_ids(labels).collect()}
    rows = [tuple(r) for r in d.collect()]
    want = verdicts(rows, trusted, order)
    got = {r["doc_id"]: r for r in quality.classify(d.repartition(3), labels, order=order, shard_rows=shard_rows).collect()}
    assert set(got) == {i for i, _, _ in rows} and len(want) > 60
    for i, r in got.items():
        if i not in want:
            assert r["perplexity"] is None and not r["accepted"]
            continue
        ppl, cost, low, top, ok = want[i]
        assert r["perplexity"] == pytest.approx(ppl, rel=1e-4) and r["cost"] == pytest.approx(cost, rel=1e-4)
        assert r["least"] == pytest.approx(low, rel=1e-4) and r["threshold"] == pytest.approx(top, rel=1e-4)
        assert r["accepted"] == ok or min(abs(cost - low), abs(cost - top)) < 1e-4


def test_shuffled_and_one_word_texts(spark):
    """Contexts reach across words: most trusted texts are rejected once their words are shuffled, and
    texts of one word said 300 times are no prose."""
    sf = SMALL.replace("0.001", "0.01")
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rnd = random.Random(1)
    trusted = [r for r in d.join(quality.trusted_ids(labels), "doc_id").collect() if len(r["text"].split()) >= 60 and r["lang"] == "en"][:60]
    extra = []
    for k, r in enumerate(trusted):
        w = r["text"].split()
        often = Counter(w).most_common(3)[-1][0]
        extra.append((20000 + k, " ".join(rnd.sample(w, len(w))), r["lang"]))
        extra.append((30000 + k, " ".join([often] * 300), r["lang"]))
    got = {r["doc_id"]: r["accepted"] for r in quality.classify(d.unionByName(spark.createDataFrame(extra, d.schema)), labels).collect()}
    shuffled = sum(not got[20000 + k] for k in range(len(trusted)))
    repeated = sum(not got[30000 + k] for k in range(len(trusted)))
    print(f"rejected: {shuffled} shuffled, {repeated} of one word, of {len(trusted)}")
    assert shuffled >= 0.6 * len(trusted) and repeated >= 0.6 * len(trusted)


def test_thresholds_do_not_jump(spark):
    """29, 30 and 31 trusted texts of a language give nearly the same verdicts."""
    d = spark.read.parquet(f"{SMALL.replace('0.001', '0.01')}/documents.parquet").where("lang = 'fr'")
    labels = spark.read.parquet(f"{SMALL.replace('0.001', '0.01')}/labels.parquet")
    ids = sorted(r["doc_id"] for r in quality.trusted_ids(labels).join(d, "doc_id").collect())
    seen = []
    for n in (29, 30, 31):
        some = labels.where(F.col("doc_id").isin(ids[:n]))
        seen.append({r["doc_id"]: (r["accepted"], r["threshold"]) for r in quality.classify(d, some).collect()})
    for a, b in zip(seen, seen[1:]):
        assert sum(a[i][0] != b[i][0] for i in a) <= 0.05 * len(a)
        assert max(abs(a[i][1] - b[i][1]) for i in a if a[i][1]) < 0.15
