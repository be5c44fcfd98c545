"""One query per operator: ``op<N>_<name>`` over its whole table, with production
parameters, and the DuckDB twin where SQL can express the operator."""
from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (centroids, chat, collocations, decontaminate, htmltext, jaccard, langid, linededup, mixing, pii, quality, rules,
               tokencount)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
PIECES = "/opt/tokenizers/piece_bpe_32k.model"


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE_SQL[name] = sql.strip()
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@register("op1_quality_classifier")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select(
        "doc_id", "lang", "n_chars", "perplexity", "cost", "threshold", "accepted")


#: the mix as one sorted running sum per source; the Spark side finds the same threshold by histograms
MIX_CTES = """
d as (select {cols}, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as size,
        cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), '')), 1, 15) as bigint) as h from {docs}),
src as (select source, sum(size) as source_size, row_number() over (order by source nulls last) - 1 as rnk from d group by source),
wt as (select *, case rnk % 3 when 0 then 5.0::double when 1 then 2.0::double else 1.0::double end as weight, 2.0::double * source_size as most from src),
run as (select *, (1.5::double * sum(source_size) over () - coalesce(sum(most) over w, 0)) / (sum(weight) over () - coalesce(sum(weight) over w, 0)) as level
        from wt window w as (order by most / weight, rnk rows between unbounded preceding and 1 preceding)),
goal as (select source, source_size, least(most, weight * max(level) over ()) as target from run),
part as (select *, case when source_size > 0 then cast(floor(target / source_size) as bigint) else 0 end as whole from goal),
cum as (select d.*, source_size, target, whole, target - whole * source_size as rest,
          sum(size) over (partition by d.source order by h) as upto, sum(size) over (partition by d.source, h) as same
        from d join part on d.source is not distinct from part.source),
took as (select *, case when size = 0 then 0 else whole + cast(upto <= rest or (upto - same <= rest and upto - rest < rest - (upto - same)) as bigint) end as copies from cum)
"""


@register("op2_source_mixing", "with " + MIX_CTES.format(cols="doc_id, source", docs="documents") + """
select doc_id, cast(size as bigint) as size, cast(source_size as bigint) as source_size, target, cast(copies * size as bigint) as taken from took
""")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@register("op3_ngram_jaccard_join")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


@register("op4_html_main_text")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return htmltext.extract(pages, htmltext.fit(pages))


_ESCAPED = "replace(coalesce({}, ''), '\\', '\\\\')"
for _c in chat.CONTROL:
    _ESCAPED = f"replace({_ESCAPED}, '{_c}', '{_c[0]}\\{_c[1:]}')"


@register("op5_chat_format", f"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), marked as (
  select *, {_ESCAPED.format('role')} as erole, {_ESCAPED.format('text')} as etext,
    case when role = lag(role) over (partition by conv_id order by turn nulls first, role, text) then 0 else 1 end as opens
  from rows
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars,
  sha256(coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn nulls first, role, text), '')) as loss_sha256,
  cast(sum(length(etext) + case when opens = 1 then length(erole) + {len(chat.START) + len(chat.MID) + len(chat.END)}
           else {len(chat.SEP)} end) as bigint) as formatted_chars
from marked group by conv_id
""")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    probe = spark.range(2).select(F.lit(-1).cast(conv.schema["conv_id"].dataType).alias("conv_id"),
                                  F.col("id").cast(conv.schema["turn"].dataType).alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return chat.digests(chat.parsed(chat.format_chats(conv.unionByName(probe))))


@register("op6_quality_rules", """
with d as (
  select doc_id, coalesce(text, '') as text,
    list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as lines
  from documents
), t as (
  select doc_id, unnest(generate_series(1, len(w) - 2)) as i, w from d where len(w) >= 3
), g as (
  select doc_id, i, count(*) over (partition by doc_id, w[i], w[i + 1], w[i + 2]) as n from t
), r as (
  select doc_id, count(distinct k) as n_repeat_words
  from (select doc_id, unnest([i, i + 1, i + 2]) as k from g where n >= 2) group by doc_id
), s as (
  select d.doc_id, len(w) as n_words, length(array_to_string(w, '')) as word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as n_symbols,
    len(lines) - len(list_distinct(lines)) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words, len(lines) as n_lines
  from d left join r on d.doc_id = r.doc_id
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
  not (n_words < 50 or 100 * n_repeat_words > 50 * n_words or n_symbols * 10 > n_words or word_chars < n_words * 2
       or word_chars > n_words * 15 or (n_dup_lines >= 3 and n_dup_lines * 100 > n_lines * 30) or n_words > 100000) as kept
from s
""")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.assess(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_W7 = "list_filter(string_split_regex({}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')".format(
    "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")


@register("op7_decontamination", f"""
with b as (select cast(item_id as varchar) as item, {_W7} as w from benchmark where item_id is not null),
bw as (select item, least(13, len(w)) as n, w, unnest(generate_series(1, len(w) - least(13, len(w)) + 1)) as i from b where len(w) > 0),
pat as (select distinct item, n, array_to_string(w[i:i + n - 1], ' ') as k from bw),
d as (select doc_id, {_W7} as w from documents),
sizes as (select distinct n from pat),
dw as (select doc_id, n, w, unnest(generate_series(1, len(w) - n + 1)) as i from d, sizes where len(w) >= n),
hit as (select doc_id, i, dw.n, item from (select doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') as k from dw) dw
        join pat on pat.n = dw.n and pat.k = dw.k),
words as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(generate_series(i, i + n - 1)) as p from hit) group by doc_id),
items as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as ids from (select distinct doc_id, item from hit) group by doc_id)
select d.doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join words on d.doc_id = words.doc_id left join items on d.doc_id = items.doc_id
""")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.verdicts(decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


@register("op8_language_id")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    test = langid.held_out(F.col("doc_id"))
    model = langid.fit(docs.where(~test))
    # the fold is a function of the id, joined to the prediction in the same row
    return (langid.predict(docs, model).withColumn("held_out", test)
            .select("doc_id", "held_out", "lang_pred", "score", "rejected"))


@register("op9_token_counts")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(table(spark, sf_dir, "documents"), tokencount.read_vocabulary(PIECES))


LINE_CTES = """
l as (select doc_id, coalesce(text, '') as text, string_split(coalesce(text, ''), chr(10)) as raw,
        list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(11) || chr(12) || chr(13))) as t from documents),
w as (select doc_id, len(t) as n, t, unnest(generate_series(1, greatest(1, len(t) - 2))) as i from l),
k as (select doc_id, i, case when n >= 3 then t[i:i + 2] else t end as k, n from w),
o as (select *, row_number() over (partition by k order by doc_id, i) as nth from k where array_to_string(k, '') <> ''),
gone as (select doc_id, list(distinct p) as p from (select doc_id, unnest([i, i + 1, i + 2]) as p from o where nth > 1) group by doc_id)
"""


@register("op10_line_dedup", "with " + LINE_CTES + """
select l.doc_id, cast(len(raw) as bigint) as n_lines,
  cast(len(list_filter(generate_series(1, len(raw)), lambda j: coalesce(list_contains(p, j), false))) as bigint) as n_removed,
  array_to_string(list_transform(list_filter(generate_series(1, len(raw)), lambda j: not coalesce(list_contains(p, j), false)), lambda j: raw[j]), chr(10)) as text
from l left join gone on l.doc_id = gone.doc_id
""")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("n_lines", F.size(F.split("text", "\n", -1)).cast("long"))
    return linededup.dedup_lines(docs).select("doc_id", "n_lines", F.col("__lines_removed").alias("n_removed"), "text")


def _any_case(words) -> str:
    return "|".join("".join(f"[{c.upper()}{c}]" for c in w) for w in words)


#: (kind, pattern, group that holds the span, test of a match m)
_DIGITS11 = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN11 = ("list_sum(list_transform(string_split(reverse({0}), ''), lambda c, i: case when i % 2 = 1 then cast(c as int) "
           "else cast(c as int) * 2 - case when cast(c as int) > 4 then 9 else 0 end end)) % 10 = 0").format(_DIGITS11)
_IBAN11 = ("list_reduce(list_transform(string_split(array_to_string(list_transform(string_split(substr(replace(m, ' ', ''), 5) || substr(m, 1, 4), ''), "
           "lambda c: case when c >= 'A' then cast(ascii(c) - 55 as varchar) else c end), ''), ''), lambda c: cast(c as bigint)), lambda a, b: (a * 10 + b) % 97) = 1")
_PII = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", 0, "true"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", 0,
     "len(list_filter(string_split(m, '.'), lambda x: length(ltrim(x, '0')) > 3 or cast(coalesce(nullif(right(ltrim(x, '0'), 3), ''), '0') as int) > 255)) = 0"),
    ("card", r"[0-9]([\x20-]?[0-9])+", 0, f"length({_DIGITS11}) between 14 and 19 and {_LUHN11}"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 0, f"length({_DIGITS11}) between 10 and 15"),
    ("address", r"[\p{L}\p{N}._%+-]+@[\p{L}\p{N}-]+(\.[\p{L}\p{N}-]+)+", 0, r"regexp_matches(m, '[^\x00-\x7F]')"),
    ("address", f"({_any_case(['https', 'http', 'ftps', 'sftp', 'ftp', 'ssh'])})" + r"://[^\x20\x09-\x0D/?#@:]+(:[^\x20\x09-\x0D/?#@]*)?@[A-Za-z0-9.-]+", 0, "true"),
    ("account", f"({_any_case(['iban'])})" + r"[\x20:=#]{0,3}([A-Z]{2}[0-9]{2}(\x20?[A-Z0-9]{4}){2,7}(\x20?[A-Z0-9]{1,3})?)", 2, _IBAN11),
    ("account", f"({_any_case([c for c in pii.CUES if c != 'iban'])})" + r"(\x20([Nn][Uu][Mm][Bb][Ee][Rr]|[Nn][OoRr]))?[\x20:=#.]{1,3}([A-Z]{0,2}[0-9]+([\x20-][0-9]+)*)", 4,
     f"length({_DIGITS11}) between 6 and 20"),
]


def _pii_sql() -> str:
    parts = []
    for kind, pattern, group, good in _PII:
        p = "'" + pattern + "'"
        size = "list_sum(list_transform({0}, lambda x: length(x)))"
        parts.append(f"""
select doc_id, {pii.KINDS.index(kind)} as k, '{kind}' as kind, coalesce({size.format('g[1:i]')}, 0) + coalesce({size.format('w[1:i]')}, 0) - length(m) as s, m
from (select doc_id, g, w, v, unnest(generate_series(1, len(w))) as i, v[i] as m
      from (select doc_id, string_split_regex(text, {p}) as g, regexp_extract_all(text, {p}, 0) as w, regexp_extract_all(text, {p}, {group}) as v from d))
where {good}""")
    return ("with d as (select doc_id, coalesce(text, '') as text from documents), f as (" + " union all ".join(parts) + """),
x as (select doc_id, count(*) filter (k = 0) as n_email, count(*) filter (k = 1) as n_ip, count(*) filter (k = 2) as n_card, count(*) filter (k = 3) as n_phone,
        string_agg(kind || ':' || s || ':' || (s + length(m)), ',' order by s, k, length(m)) filter (k < 4) as base,
        string_agg(kind || ':' || s || ':' || (s + length(m)), ',' order by s, k, length(m)) as spans from f group by doc_id)
select d.doc_id, coalesce(n_email, 0) as n_email, coalesce(n_ip, 0) as n_ip, coalesce(n_card, 0) as n_card, coalesce(n_phone, 0) as n_phone,
  sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from d left join x on d.doc_id = x.doc_id
""")


@register("op11_personal_data", _pii_sql())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.find_personal(table(spark, sf_dir, "documents")))


def _collocation_sql(longest: int = collocations.MAX_WORDS) -> str:
    cuts = " union all ".join(f"select lang, p, n, f as a, {k} as k, array_to_string(p[1:{k}], ' ') as x, array_to_string(p[{k + 1}:], ' ') as y from c where len(p) > {k}"
                              for k in range(1, longest))
    inside = " union all ".join(f"select lang, p[{a}:{a} + {m} - 1] as p, f from c where len(p) > {m} and len(p) >= {a + m - 1}"
                                for m in range(2, longest) for a in range(1, longest - m + 2))
    return f"""
with d as (select coalesce(lang, 'und') as lang, regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[.,;:!?\x0A-\x0D]') as pieces from documents),
w as (select lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') as w from (select lang, unnest(pieces) as piece from d)),
i as (select lang, w, unnest(generate_series(1, len(w))) as i from w),
g as (select lang, w[i:i + m - 1] as p from i, (select unnest(generate_series(1, {longest})) as m) where i + m - 1 <= len(w)),
f as (select lang, p, count(*) as f from g group by lang, p),
t as (select lang, sum(f) as n from f where len(p) = 1 group by lang),
c as (select f.lang, p, f, n from f join t on f.lang = t.lang where len(p) > 1 and f >= {collocations.MIN_COUNT}),
s as (select lang, array_to_string(p, ' ') as x, f from f where f >= {collocations.MIN_COUNT}),
cut as ({cuts}),
sc as (select cut.*, l.f as l, r.f as r, (1000::hugeint * a * n) // (l.f::hugeint * r.f) as score
       from cut join s l on cut.lang = l.lang and cut.x = l.x join s r on cut.lang = r.lang and cut.y = r.x),
b as (select *, row_number() over (partition by lang, p order by score, k) as nth from sc),
gone as (select distinct c.lang, c.p from c join ({inside}) o on c.lang = o.lang and c.p = o.p and o.f >= c.f),
ok as (select b.lang, array_to_string(b.p, ' ') as phrase, a, l, r, n, score from b left join gone on b.lang = gone.lang and b.p = gone.p where nth = 1 and gone.p is null),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from ok)
select lang, cast(rank as bigint) as rank, phrase, cast(a as bigint) as a, cast(l as bigint) as l, cast(r as bigint) as r, cast(n as bigint) as n, cast(score as bigint) as score
from ranked where rank <= {collocations.TOP}
"""


@register("op12_collocations", _collocation_sql())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def _centroid_sql(k: int = centroids.K, rounds: int = centroids.ROUNDS) -> str:
    dims = centroids.DIMS
    near = """
a{r} as materialized (select id, vec_id, v, c, d as distance from (
  select x.*, c, list_sum(list_transform(list_zip(v, m), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as d, row_number() over (partition by id order by d, c) as nth from x, c{r}) where nth = 1)"""
    step = """,
n{r} as (select c, j, sum(v[j])::bigint as s, count(*)::bigint as n from a{r}, (select unnest(generate_series(1, {dims})) as j) group by c, j),
c{s} as materialized (select c{r}.c, coalesce(list((n{r}.s - ((n{r}.s % n) + n) % n) // n order by j) filter (n is not null), any_value(m)) as m
  from c{r} left join n{r} on c{r}.c = n{r}.c group by c{r}.c),"""
    body = "".join(near.format(r=r) + step.format(r=r, s=r + 1, dims=dims) for r in range(rounds)) + near.format(r=rounds)
    return f"""
with x as materialized (select row_number() over () as id, vec_id, list_transform(embedding, lambda e: cast(floor({centroids.SCALE} * cast(e as double)) as bigint)) as v from embeddings
  where embedding is not null and len(embedding) = {dims} and len(list_filter(embedding, lambda e: e is null or not isfinite(e))) = 0),
c0 as materialized (select row_number() over (order by h, v) - 1 as c, v as m from (select *, sha256('{centroids.SEED}:' || coalesce(cast(vec_id as varchar), '')) as h from x order by h, v limit {k})),
{body}
select vec_id, cast(a{rounds}.c as int) as cluster, distance, cast(sum(distance) over (partition by a{rounds}.c) as bigint) as cluster_inertia,
  cast(sum(distance) over () as bigint) as inertia, sha256(array_to_string(m, ',')) as centroid_sha256
from a{rounds} join c{rounds} on a{rounds}.c = c{rounds}.c
"""


@register("op13_centroid_clusters", _centroid_sql())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))[0]
