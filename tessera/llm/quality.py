"""Quality classifier: interpolated modified Kneser-Ney n-gram model, perplexity per
document, thresholds from quantiles of each language.

Units: the n-grams are of ``ORDER`` characters of the whole text, blanks included, so that a
context reaches into the word before (white space is one blank, digits are read as 0,
``ORDER - 1`` start marks stand before the text and an end mark behind it).  A word model would need a
row for nearly every word of the corpus in the joins below (README); the character n-grams
of the corpus stay few, and all of them are counted.

Training: counts of every n-gram of all trusted texts; lower orders count the distinct
characters before an n-gram; three discounts per order from the counts of counts.
Scoring: the distinct n-grams of the whole corpus are joined with the count tables, order
by order, sharded by n-gram, which gives one log probability each; these go to the
scoring tasks in shards of at most ``SHARD_ROWS`` entries, one scan and one broadcast at a
time, and a document's sums are added up.

Cross-fitting: documents are dealt to ``FOLDS`` folds by a hash of the lower-cased text with
single blanks, and each is scored by the model of the trusted texts of the other folds: no
text is judged by a model that has read it or an exact copy of it (near copies may be in
either fold).

Verdict: the cost (negative log probability per character, with ``SHRINK`` characters at
the language's median added so that a short text is not judged by a few letters) has to lie
between two thresholds of the language (null is one).  The upper one is the quantile of the costs of
its trusted texts that at most a share ``LOSS`` of them exceeds; the lower one, for texts that
repeat themselves, the quantile that at most ``LOW_LOSS`` of them fall below, less
``LEAST_SPREAD`` of it.  Both are drawn towards fences around the quartiles of all texts of the
language (``OWN_FENCE`` times the quartile distance, or times ``LEAST_SPREAD`` of the quartile), as if
``PRIOR_TEXTS`` trusted texts stood for those: a language with many trusted texts is judged by
them, one without any by its own texts, by one rule.

Defined results: a null or blank text has no perplexity and is rejected; labels that are
null are not trusted; a text with several labels is trusted if one says so and none calls
it toxic; repeated rows each get their verdict; with nothing trusted no text is
rejected but the blank ones; an empty table gives no rows.
"""
from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, checked_broadcast, col, row_hash, stored

ORDER = 5
SHARD_ROWS = 1 << 22
SHRINK = 200
LOSS = 0.01
LOW_LOSS = 0.002
PRIOR_TEXTS = 20
OWN_FENCE = 1.5
LEAST_SPREAD = 0.05
FOLDS = 2
CHUNK = 1 << 20                                      # characters counted or scored at once
HELD = 1 << 21                                       # n-grams a counting task holds
START, STOP = 2, 3                                   # code points of the marks


def plain(text: str) -> str:
    return " ".join(text.split())


def fold_of(text: str) -> int:
    """The fold of a plain text."""
    return zlib.crc32(text.lower().encode("utf-8", "surrogatepass")) % FOLDS


def points(texts: list[str], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points of plain texts between their marks, one after another, and where the
    n-grams of each text end in the list of all n-grams."""
    mark = chr(START) * (order - 1)
    p = np.frombuffer("".join(f"{mark}{t}{chr(STOP)}" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    size = np.array([len(t) + order for t in texts])
    own = np.ones(len(p), bool)                      # marks inside a text are blanks
    ends = np.cumsum(size)
    own[ends - 1] = False
    for k in range(order - 1):
        own[ends - size + k] = False
    p[own & ((p == START) | (p == STOP))] = 32
    p[(p >= 49) & (p <= 57)] = 48
    return p, ends - (order - 1) * np.arange(1, len(texts) + 1)


def gram_keys(p: np.ndarray, order: int) -> np.ndarray:
    """64-bit keys of all runs of ``order`` code points."""
    n = len(p) - order + 1
    x = np.zeros(max(n, 0), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(order):
            x ^= p[k:k + len(x)]
            x *= np.uint64(0x9E3779B97F4A7C15)
            x ^= x >> np.uint64(29)
    return x


def inside(sizes: np.ndarray, order: int) -> np.ndarray:
    """Which runs of the joined texts lie within one text, from the n-grams per text."""
    ok = np.ones(int(sizes.sum()) + (order - 1) * (len(sizes) - 1), bool)
    gaps = np.cumsum(sizes + order - 1)[:-1] - (order - 1)
    for k in range(order - 1):
        ok[gaps + k] = False
    return ok


def grams(text: str, order: int) -> list[str]:
    """The n-grams of a text as strings."""
    p, _ = points([plain(text)], order)
    s = p.tobytes().decode("utf-32-le", "surrogatepass")
    return [s[k:k + order] for k in range(len(s) - order + 1)] if plain(text) else []


def _distinct(texts: list[str], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, code points and counts of the distinct n-grams of some texts."""
    p, ends = points(texts, order)
    ok = inside(np.diff(ends, prepend=0), order)
    keys, first, count = np.unique(gram_keys(p, order)[ok], return_index=True, return_counts=True)
    at = np.flatnonzero(ok)[first]
    return keys, np.stack([p[at + k] for k in range(order)], axis=1), count


def corpus_grams(docs: DataFrame, trusted: DataFrame, id_col: str, text_col: str, order: int) -> DataFrame:
    """gram, c, and c0, c1, ... by fold: every n-gram of the corpus and how often trusted
    texts (of the fold) have it (0 for those that only others have).  Counted per task,
    then summed by n-gram."""
    t = trusted.select(F.col("doc_id").alias("__id"), F.lit(True).alias("__t"))
    src = (docs.select(col(id_col).alias("doc_id"), col(text_col).cast("string").alias("text"))
           .join(t, F.col("doc_id") == F.col("__id"), "left").select("text", F.coalesce("__t", F.lit(False)).alias("t")))
    names = [f"c{k}" for k in range(FOLDS)]

    def flush(held: list):
        """The n-grams held, each once, with its counts of every fold."""
        key, first, which = np.unique(np.concatenate([h[0] for h in held]), return_index=True, return_inverse=True)
        pts = np.concatenate([h[1] for h in held])[first]
        s = np.ascontiguousarray(pts).tobytes().decode("utf-32-le", "surrogatepass")
        count = np.concatenate([h[2] for h in held])
        fold = np.repeat([h[3] for h in held], [len(h[0]) for h in held])
        return pa.RecordBatch.from_arrays([pa.array([s[k:k + order] for k in range(0, len(s), order)], pa.string())] + [
            pa.array(np.bincount(which, weights=np.where(fold == k, count, 0), minlength=len(key)).astype(np.int64)) for k in range(FOLDS)], names=["gram", *names])

    def run(batches):
        waiting: dict[int, list] = {k: [] for k in range(-1, FOLDS)}    # texts by fold, -1 those not trusted
        chars = dict.fromkeys(waiting, 0)
        held, n = [], 0
        for b in batches:
            for text, good in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                s = plain(text) if text else ""
                if not s:
                    continue
                k = fold_of(s) if good else -1
                waiting[k].append(s)
                chars[k] += len(s)
                if chars[k] >= CHUNK:
                    held.append((*_distinct(waiting[k], order), k))
                    n += len(held[-1][0])
                    waiting[k], chars[k] = [], 0
                    if n > HELD:                     # a task holds a bounded number of n-grams
                        yield flush(held)
                        held, n = [], 0
        held += [(*_distinct(texts, order), k) for k, texts in waiting.items() if texts]
        if held:
            yield flush(held)

    counted = src.mapInArrow(run, "gram string, " + ", ".join(f"{c} long" for c in names))
    return stored(counted.groupBy("gram").agg(*[F.sum(c).alias(c) for c in names])
                  .select("gram", sum(map(F.col, names[1:]), F.col(names[0])).alias("c"), *names))


def _discounts(counts: DataFrame) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from the numbers of n-grams seen 1 to 4 times."""
    n = [counts.where(F.col("c") <= 4).groupBy("c").count().collect()]
    by = {r["c"]: r["count"] for r in n[0]}
    n1, n2, n3, n4 = (by.get(k, 0) for k in (1, 2, 3, 4))
    if not n1 or not n2:
        return 0.5, 0.5, 0.5
    y = n1 / (n1 + 2 * n2)
    d = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5)
    return tuple(min(max(x, 0.05), k) for k, x in zip((0.95, 1.95, 2.95), d))


def log_probabilities(counted: DataFrame, order: int) -> DataFrame:
    """gram, lp for every n-gram of the corpus, by sharded joins with the count tables."""
    wanted = {order: counted.select("gram")}
    for k in range(order - 1, 0, -1):
        wanted[k] = wanted[k + 1].select(F.substring("gram", 2, k).alias("gram")).distinct()
    counts = {order: counted.where("c > 0")}
    for k in range(order - 1, 0, -1):                # how many characters come before
        counts[k] = stored(counts[k + 1].groupBy(F.substring("gram", 2, k).alias("gram")).agg(F.count("*").alias("c")))
    letters = max(1, wanted[1].count()) + 1
    p = None
    for k in range(1, order + 1):
        d1, d2, d3 = _discounts(counts[k])
        less = F.when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3)
        c = counts[k].select("gram", F.substring("gram", 1, k - 1).alias("h"), "c", less.alias("d"))
        ctx = c.groupBy("h").agg(F.sum("c").alias("total"), F.sum("d").alias("off")).select("h", "total", (F.col("off") / F.col("total")).alias("gamma"))
        w = wanted[k].select("gram", F.substring("gram", 1, k - 1).alias("h"), F.substring("gram", 2, k - 1).alias("low"))
        j = w.join(c.select("gram", (F.col("c") - F.col("d")).alias("left")), "gram", "left").join(ctx, "h", "left")
        below = F.lit(1.0 / letters) if p is None else F.col("pl")
        if p is not None:
            j = j.join(p.select(F.col("gram").alias("low"), F.col("p").alias("pl")), "low")
        j = j.select("gram", (F.coalesce(F.col("left") / F.col("total"), F.lit(0.0)) + F.coalesce("gamma", F.lit(1.0)) * below).alias("p"))
        p = stored(j)
    return p.select("gram", F.log("p").alias("lp"))


def held_out(counted: DataFrame, order: int) -> DataFrame:
    """gram, lp0, lp1, ...: log probabilities by the trusted texts of all folds but that one."""
    out = None
    for k in range(FOLDS):
        lp = log_probabilities(counted.select("gram", (F.col("c") - F.col(f"c{k}")).alias("c")), order).withColumnRenamed("lp", f"lp{k}")
        out = lp if out is None else out.join(lp, "gram")
    return out


def _shards(lp: DataFrame, order: int, shard_rows: int) -> tuple[DataFrame, int]:
    """key, lp0, lp1, ... of every n-gram, stored, and the number of shards of at most about
    ``shard_rows`` of them."""
    names = [f"lp{k}" for k in range(FOLDS)]

    def keyed(batches):
        for b in batches:
            p = np.frombuffer("".join(b.column(0).to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32)
            k = gram_keys(p, order)[::order] if len(p) else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), *[b.column(1 + f).cast(pa.float32()) for f in range(FOLDS)]], names=["k", *names])

    rows = stored(lp.select("gram", *names).mapInArrow(keyed, "k long, " + ", ".join(f"{c} float" for c in names)))
    return rows, max(1, -(-rows.count() // shard_rows))


def _sent(rows: DataFrame, shard: int, shards: int):
    """One shard as a broadcast: sorted keys, and values by fold."""
    t = rows.where(F.pmod("k", F.lit(shards)) == shard).toArrow()
    k = t.column(0).to_numpy().view(np.uint64)
    o = np.argsort(k)
    return rows.sparkSession.sparkContext.broadcast((k[o], [t.column(1 + f).to_numpy()[o] for f in range(FOLDS)]))


def _sums(texts: list[str], order: int, keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of the values of the n-grams of each plain text (none of them empty)."""
    out = []
    a = 0
    while a < len(texts):
        z, n = a, 0
        while z < len(texts) and (n == 0 or n + len(texts[z]) <= CHUNK):
            n += len(texts[z])
            z += 1
        p, ends = points(texts[a:z], order)
        k, which = np.unique(gram_keys(p, order)[inside(np.diff(ends, prepend=0), order)], return_inverse=True)
        i = np.minimum(np.searchsorted(keys, k), max(0, len(keys) - 1))
        v = np.where(keys[i] == k, values[i], np.float32(0)).astype(np.float64) if len(keys) else np.zeros(len(k))
        out.append(np.add.reduceat(v[which], np.r_[0, ends[:-1]]))
        a = z
    return np.concatenate(out) if out else np.zeros(0)


def _scorer(shared, order: int):
    def run(batches):
        keys, values = shared.value
        for b in batches:
            texts = [plain(t) if t else "" for t in b.column(2).to_pylist()]
            fold = np.array([fold_of(t) if t else -1 for t in texts], np.int64)
            lp = np.zeros(len(texts))
            for f in range(FOLDS):
                at = np.flatnonzero(fold == f)
                if len(at):
                    lp[at] = _sums([texts[k] for k in at], order, keys, values[f])
            n = [len(t) + 1 if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(lp, pa.float64())],
                                             names=["doc_id", "th", "n", "lp"])
    return run


def perplexities(docs: DataFrame, rows: DataFrame, shards: int, order: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, th, n (characters scored), lp per row; one scan and one broadcast at a time
    per shard.  With several shards, rows equal in id and text are brought together as one."""
    src = docs.select(col(id_col).alias("doc_id"), row_hash(col(text_col)).alias("th"), col(text_col).cast("string").alias("text"))
    schema = f"doc_id {src.schema['doc_id'].dataType.simpleString()}, th long, n long, lp double"
    if shards == 1:
        return src.mapInArrow(_scorer(_sent(rows, 0, 1), order), schema)
    parts = None
    for s in range(shards):
        shared = _sent(rows, s, shards)
        p = stored(src.mapInArrow(_scorer(shared, order), schema))
        shared.destroy()
        parts = p if parts is None else parts.unionByName(p)
    one = parts.groupBy("doc_id", "th").agg(F.max("n").alias("n"), (F.sum("lp") * shards / F.count("*")).alias("lp"), (F.count("*") / shards).cast("int").alias("times"))
    return one.select("doc_id", "th", "n", "lp", F.explode(F.sequence(F.lit(1), "times"))).drop("col")


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids of documents that a label calls good and none calls toxic."""
    return (labels.where("doc_id is not null").groupBy("doc_id")
            .agg(F.max("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("x")).where("q = 1 and x = 0").select("doc_id"))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
             order: int = ORDER, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """doc_id, th, lang, n_chars (scored), perplexity, cost, least and threshold (what the cost
    has to lie between) and accepted."""
    bounded_batches(docs.sparkSession)
    trusted = stored(trusted_ids(labels))
    near = checked_broadcast(trusted)
    counted = corpus_grams(docs, near, id_col, text_col, order)
    rows, shards = _shards(held_out(counted, order), order, shard_rows)
    named = docs.select(F.struct(col(id_col).alias("id"), col(lang_col).cast("string").alias("lang")).alias("k"), col(text_col).alias("text"))
    raw = perplexities(named, rows, shards, order, "k", "text")
    scored = raw.select(F.col("doc_id.id").alias("doc_id"), "th", F.col("doc_id.lang").alias("lang"), "n",
                        F.when(F.col("n") > 0, -F.col("lp") / F.col("n")).alias("rate"))
    t = near.select(F.col("doc_id").alias("__id"), F.lit(True).alias("__t"))
    scored = stored(scored.join(t, F.col("doc_id") == F.col("__id"), "left").select(
        "doc_id", "th", "lang", "n", "rate", F.coalesce("__t", F.lit(False)).alias("trusted")))

    def per_language(*aggregates):
        t = stored(scored.where("n > 0").groupBy(F.col("lang").alias("__lang")).agg(*aggregates))
        return checked_broadcast(t, 100_000)

    same = F.col("lang").eqNullSafe(F.col("__lang"))
    good = lambda c: F.when(F.col("trusted"), F.col(c))
    median = F.coalesce(F.percentile_approx(good("rate"), 0.5, 10000), F.percentile_approx("rate", 0.5, 10000)).alias("median")
    cost = (F.col("rate") * F.col("n") + F.lit(float(SHRINK)) * F.col("median")) / (F.col("n") + F.lit(SHRINK))
    scored = scored.join(per_language(median), same, "left").withColumn("cost", cost).drop("__lang", "median")
    scored = scored.join(per_language(F.count(good("cost")).alias("known"), F.percentile_approx(good("cost"), [LOW_LOSS, 1 - LOSS], 10000).alias("q"),
                                      F.percentile_approx("cost", [0.25, 0.75], 10000).alias("own")), same, "left")
    low, high = F.col("own")[0], F.col("own")[1]
    share = F.col("known") / (F.col("known") + F.lit(PRIOR_TEXTS))
    drawn = lambda own, q: F.round(own + share * F.coalesce(q - own, F.lit(0.0)), 6)
    threshold = drawn(high + OWN_FENCE * F.greatest(high - low, LEAST_SPREAD * high), F.col("q")[1])
    least = drawn(low - OWN_FENCE * F.greatest(high - low, LEAST_SPREAD * low), F.col("q")[0] * (1 - LEAST_SPREAD))
    fits = F.coalesce(F.round("cost", 6).between(least, threshold), F.lit(True))
    return scored.select("doc_id", "th", "lang", "trusted", F.col("n").alias("n_chars"), F.round(F.exp("rate"), 6).alias("perplexity"),
                         F.round("cost", 6).alias("cost"), least.alias("least"), threshold.alias("threshold"),
                         (F.col("n").isNotNull() & (F.col("n") > 0) & fits).alias("accepted"))


def drop_rejected(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The accepted rows of ``docs``, all columns as they were."""
    gone = stored(classify(docs, labels, id_col, text_col, lang_col).where("not accepted")
                  .select(F.col("doc_id").alias("__id"), F.col("th").alias("__th")).distinct())
    return docs.join(checked_broadcast(gone), col(id_col).eqNullSafe(F.col("__id")) & (row_hash(col(text_col)) == F.col("__th")), "left_anti")
