"""Tags in context (T11): a bigram hidden Markov model counted by Spark from a tagged table and
decoded by one array aggregate per text.

Probabilities carry one added count and are whole millionths of a nat, so sums are exact and
equal paths tie the same way everywhere: the tag that comes first by name wins.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import explode_rows, posexplode_rows
from ..session import reliable_checkpoint

MAX_TAGS = 200
UNIT = 1_000_000


def _cost(p: Column) -> Column:
    return F.round(F.log(p) * UNIT).cast("long")


def fit_tagger(tagged: DataFrame, tokens: str = "tokens", tags: str = "tags") -> dict:
    """The model of a table with arrays of tokens and tags of equal length: the tags, their costs in
    sequence (tags squared numbers) and the cost table (word, e) with one cost per tag.
    More than ``MAX_TAGS`` tags are refused."""
    pairs = explode_rows(tagged, [], F.transform(F.arrays_zip(F.col(tokens).alias("w"), F.col(tags).alias("t")),
                                                 lambda x: F.struct(x["w"].alias("w"), x["t"].alias("t"))), "x").select("x.w", "x.t")
    names = [r["t"] for r in pairs.select("t").distinct().orderBy("t").limit(MAX_TAGS + 1).collect()]
    if len(names) > MAX_TAGS:
        raise ValueError(f"more than {MAX_TAGS} tags")
    n = max(1, len(names))
    before = F.concat(F.array(F.lit("")), F.col(tags))
    steps = explode_rows(tagged, [], F.transform(F.arrays_zip(F.slice(before, 1, F.size(tags)).alias("p"), F.col(tags).alias("t")),
                                                 lambda x: F.struct(x["p"].alias("p"), x["t"].alias("t"))), "x").select("x.p", "x.t")
    seen = {(r["p"], r["t"]): r["n"] for r in steps.groupBy("p", "t").agg(F.count(F.lit(1)).alias("n")).collect()}   # (tags + 1) x tags
    of = {p: sum(c for (q, _), c in seen.items() if q == p) for p in ["", *names]}
    cost = {p: [round(math.log((seen.get((p, t), 0) + 1) / (of[p] + n)) * UNIT) for t in names] for p in ["", *names]}
    counts = reliable_checkpoint(pairs.groupBy("w", "t").agg(F.count(F.lit(1)).alias("n")))
    total = {r["t"]: r["n"] for r in counts.groupBy("t").agg(F.sum("n").alias("n")).collect()}
    words = counts.select("w").distinct().count()
    by_tag = F.map_from_entries(F.collect_list(F.struct("t", "n")))
    rows = counts.groupBy(F.col("w").alias("word")).agg(by_tag.alias("m"))
    e = F.array(*[_cost((F.coalesce(F.try_element_at("m", F.lit(t)), F.lit(0)) + 1) / F.lit(float(total[t] + words + 1))) for t in names])
    unknown = [round(math.log(1 / (total[t] + words + 1)) * UNIT) for t in names]
    return {"tags": names, "first": cost[""], "next": [cost[t] for t in names], "words": reliable_checkpoint(rows.select("word", e.alias("e"))), "unknown": unknown}


def tag_in_context(df: DataFrame, key: str, tokens: str, model: dict, out_col: str = "tags") -> DataFrame:   # T11
    """(key, tags): the best tag sequence of every text.  Words meet their costs by an equi-join;
    the best path is carried through an aggregate over the text's tokens, one score and one
    string of tag letters per tag."""
    names = model["tags"]
    long = lambda xs: F.array(*[F.lit(int(x)).cast("long") for x in xs])
    if not names:
        return df.select(key, F.array().cast("array<string>").alias(out_col))
    pos = posexplode_rows(df, [key], F.col(tokens), "__p", "word")
    j = pos.join(model["words"], "word", "left").select(key, "__p", F.coalesce("e", long(model["unknown"])).alias("e"))
    texts = j.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("__p", "e"))), lambda x: x["e"]).alias("es"))
    letter = [chr(0x100 + k) for k in range(len(names))]     # one character per tag
    number = F.sequence(F.lit(0), F.lit(len(names) - 1))
    follow = F.array(*[long([model["next"][i][k] for i in range(len(names))]) for k in range(len(names))])
    letters = F.array(*[F.lit(x) for x in letter])

    def step(acc: Column, e: Column) -> Column:
        def to(k: Column) -> Column:
            best = F.array_max(F.zip_with(acc["s"], F.get(follow, k), lambda s, f: s + f))
            i = F.array_position(F.zip_with(acc["s"], F.get(follow, k), lambda s, f: s + f), best).cast("int") - 1
            return F.struct((best + F.get(e, k)).alias("s"), F.concat(F.get(acc["p"], i), F.get(letters, k)).alias("p"))
        moved = F.transform(number, to)
        return F.struct(F.transform(moved, lambda x: x["s"]).alias("s"), F.transform(moved, lambda x: x["p"]).alias("p"))

    start = F.struct(F.zip_with(long(model["first"]), F.get("es", F.lit(0)), lambda a, b: a + b).alias("s"), letters.alias("p"))
    done = F.aggregate(F.slice("es", 2, F.size("es")), start, step)
    path = texts.select(key, done.alias("d")).select(key, F.get(F.col("d.p"), F.array_position("d.s", F.array_max("d.s")).cast("int") - 1).alias("path"))
    named = F.transform(F.filter(F.split("path", ""), lambda c: c != ""), lambda c: F.get(F.array(*[F.lit(t) for t in names]), F.array_position(letters, c).cast("int") - 1))
    return df.select(key).join(path.select(key, named.alias(out_col)), key, "left").select(key, F.coalesce(out_col, F.array().cast("array<string>")).alias(out_col))
