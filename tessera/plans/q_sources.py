"""Source and sink queries: every one writes a table-derived frame through the
reader/writer under test and reads it back (S1, S2, S4-S9)."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import clean, rules as R, tokens as T
from ..functions.arrays import explode_rows
from ..session import spread_width
from ..sources import files as IO
from ..sources.tables import corpus, read_table
from ..sources.wordvec import DERIVED_VECTOR_SQL, derived_vectors, read_word_vectors, write_word_vectors
from .catalog import register
from .q_models import LABELS, _blends, _oof, _oof_sql
from .q_text import F1_SQL, _glove_sql, _wl
from .sqlfrag import q, str_list, ws_split


@register("s1_read_comments_csv", """SELECT CAST(d.doc_id AS VARCHAR) AS id, d.text AS comment_text, l.toxic,
  CAST(NULL AS INTEGER) AS severe_toxic, CAST(NULL AS INTEGER) AS obscene, CAST(NULL AS INTEGER) AS threat,
  CAST(NULL AS INTEGER) AS insult, CAST(NULL AS INTEGER) AS identity_hate
FROM documents d LEFT JOIN labels l USING (doc_id)""")
def s1_read_comments_csv(spark, sf_dir):
    """Comments with labels written as quoted multi-line CSV and read back with an
    explicit schema (text with quotes and newlines survives)."""
    c = corpus(spark, sf_dir, text_col="comment_text")
    out = c.select(F.col("doc_id").cast("string").alias("id"), "comment_text", "toxic")
    path = IO.scratch_dir(spark, "comments-csv")
    IO.write_csv(out, path)
    return IO.read_comments(spark, path)


_ALL_WORDS_SQL = r"SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+', 0)) AS original FROM documents"


@register("s2_read_lexicon", f"""SELECT original, CASE WHEN length(original) > 3 THEN original || '_' END AS proper
FROM ({_ALL_WORDS_SQL})""")
def s2_read_lexicon(spark, sf_dir):
    """Every word of the corpus written as a headerless two-column
    lexicon (canonical form for the longer words, empty otherwise) and read back."""
    d = read_table(spark, sf_dir, "documents")
    lex = explode_rows(d, [], T.words("text"), "w").distinct().select(F.col("w").alias("original"),
                     F.when(F.length("w") > 3, F.concat("w", F.lit("_"))).alias("proper"))
    path = IO.scratch_dir(spark, "lexicon")
    lex.write.mode("overwrite").options(header=False).csv(path)
    return IO.read_lexicon(spark, path)


@register("s4_load_variant", f"""SELECT d.doc_id, {'array_to_string(list_filter(list_filter(regexp_split_to_array(lower(d.text), '
    + "'" + T.PY_SPACE + "'" + "), lambda x: x <> ''), lambda x: NOT list_contains(['a', 'and', 'of', 'the', 'to', 'on', 'in', 'at', 'is'], x)), ' ')"} AS comment_text,
  l.toxic FROM documents d JOIN labels l USING (doc_id)""")
def s4_load_variant(spark, sf_dir):
    """The BasicClean variant written partitioned by split; loading it prunes to the
    train partition."""
    c = corpus(spark, sf_dir)
    v = c.select("doc_id", clean.basic_cleaning("comment_text").alias("comment_text"), "toxic", "split")
    root = IO.scratch_dir(spark, "variants")
    IO.write_variant(v, root, "BasicClean")
    train, _ = IO.load_variant(spark, root, "BasicClean")
    return train.select("doc_id", "comment_text", "toxic")


@register("s5_load_predictions", f"""WITH {_oof_sql()}
SELECT doc_id, label, fold, round(pred, 6) AS pred, 'model' || model || '_oof' AS model FROM oof
WHERE split = 'train' AND model <> 2""")
def s5_load_predictions(spark, sf_dir):
    """One prediction file per model; loaded with include/exclude substrings on the
    file name (model 2 excluded), file stem as the model name."""
    oof = _oof(spark, sf_dir)
    root = IO.scratch_dir(spark, "predictions")
    for m in (0, 1, 2):
        for kind, split in (("train", "train"), ("test", "test")):
            part = oof.where((F.col("model") == m) & (F.col("split") == split)).select(
                "doc_id", "label", "fold", F.round("pred", 6).alias("pred"))
            IO.write_predictions(part, root, kind, f"model{m}_oof")
    tr, _ = IO.load_predictions(spark, root, load_oof=True, contains="model", contains2="_oof",
                                not_contains="model2")
    return tr


@register("s6_word_vectors_text", f"""SELECT word, list_transform({DERIVED_VECTOR_SQL.format(w='word')},
  lambda x: round(x, 6)) AS vec FROM (SELECT DISTINCT unnest(list_filter(string_split(translate(lower(text),
  '!"#$%&()*+,-./:;<=>?@[\\]^_`{{|}}~' || chr(9) || chr(10), repeat(' ', 34)), ' '), lambda t: t <> '')) AS word FROM benchmark)""")
def s6_word_vectors_text(spark, sf_dir):
    """Word vectors written in the ``word v1 ... vd`` text format and parsed back."""
    b = read_table(spark, sf_dir, "benchmark")
    vec = derived_vectors(explode_rows(b, [], T.keras_words("text"), "word"))
    path = IO.scratch_dir(spark, "wordvec")
    write_word_vectors(vec.select("word", F.transform("vec", lambda x: F.round(x, 6)).alias("vec")), path)
    back = read_word_vectors(spark, path, dim=4)
    return back.select("word", F.transform("vec", lambda x: F.round(x.cast("double"), 6)).alias("vec"))


@register("s7_feature_block_store", """SELECT d.doc_id, CAST(length(d.text) AS BIGINT) AS num_characters_0, l.toxic
FROM documents d LEFT JOIN labels l USING (doc_id)""")
def s7_feature_block_store(spark, sf_dir):
    """A feature block persisted keyed by doc_id, read back and joined by key."""
    d = read_table(spark, sf_dir, "documents")
    block = d.select("doc_id", F.length("text").cast("bigint").alias("num_characters_0"))
    path = IO.scratch_dir(spark, "block")
    IO.write_feature_block(block, path, "doc_id")
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return spark.read.parquet(path).join(labels, "doc_id", "left")


@register("s8_submission_csv", f"""WITH {_oof_sql()}, fm AS (SELECT doc_id, label, model, avg(pred) AS pred FROM oof
  WHERE split = 'test' GROUP BY ALL), g AS (SELECT doc_id, label, exp(avg(ln(pred))) AS p FROM fm GROUP BY ALL)
SELECT CAST(doc_id AS VARCHAR) AS id, {', '.join(f"round(max(CASE WHEN label = '{l}' THEN p END), 6) AS {l}" for l in LABELS)}
FROM g GROUP BY doc_id""")
def s8_submission_csv(spark, sf_dir):
    """Geometric blend of test predictions pivoted per label, written as a CSV
    submission with header and read back."""
    b = _blends(spark, sf_dir).where(F.col("split") == "test").select("doc_id", "label", F.round("geo", 6).alias("pred"))
    sub = IO.submission(b, "doc_id", LABELS).select(F.col("doc_id").cast("string").alias("id"), *LABELS)
    path = IO.scratch_dir(spark, "submission")
    IO.write_csv(sub, path)
    schema = "id string, " + ", ".join(f"{l} double" for l in LABELS)
    return spark.read.schema(schema).options(**IO.CSV_OPTS).csv(path)


@register("s9_run_parameters", """SELECT 'run0' AS run, k AS key, v AS value FROM (
  SELECT 'n_docs' AS k, CAST(count(*) AS VARCHAR) AS v FROM documents
  UNION ALL SELECT 'n_labelled', CAST(count(*) AS VARCHAR) FROM labels
  UNION ALL SELECT 'n_folds', '5')""")
def s9_run_parameters(spark, sf_dir):
    """Run parameters (with table-derived counts) appended to a parquet run table."""
    path = IO.scratch_dir(spark, "runs")
    n_docs = read_table(spark, sf_dir, "documents").count()
    n_lab = read_table(spark, sf_dir, "labels").count()
    IO.append_parameters(spark, path, "run0", {"n_docs": n_docs, "n_labelled": n_lab, "n_folds": 5})
    return spark.read.parquet(path)


STREAM_BATCHES = 4
_STREAM_SQL = _glove_sql(lambda e: f"array_to_string(list_filter({ws_split(f'lower({_wl(e)})')}, lambda x: NOT list_contains({str_list(R.BASIC_STOPWORDS)}, x)), ' ')")
_FILLED = f"(SELECT doc_id, coalesce(text, {q(R.NULL_TEXT_SENTINEL)}) AS text FROM documents)"


@register("p10_streaming_row_features", f"""WITH c AS ({_STREAM_SQL.replace('documents', _FILLED)}), f AS ({F1_SQL.replace('documents', _FILLED)}),
n AS (SELECT doc_id, CAST(length(text) AS BIGINT) AS len_q1, CAST(length(replace(text, ' ', '')) AS BIGINT) AS len_char_q1,
        CAST(len({ws_split('text')}) AS BIGINT) AS len_word_q1 FROM {_FILLED})
SELECT doc_id, c.text AS clean_text, f.* EXCLUDE (doc_id), n.* EXCLUDE (doc_id), l.toxic
FROM c JOIN f USING (doc_id) JOIN n USING (doc_id) LEFT JOIN labels l USING (doc_id)""")
def p10_streaming_row_features(spark, sf_dir):
    """Documents arriving as several parquet files run through the cleaning chain as
    a Structured Streaming query (availableNow) into a parquet sink joined with the
    labels (stream-static); the sink is read back.  The files are as many as the session's
    partitions and come in four batches, so a batch keeps all tasks busy."""
    from ..streaming import start_cleaning_stream
    root = IO.scratch_dir(spark, "stream")
    docs = read_table(spark, sf_dir, "documents")
    files = max(STREAM_BATCHES, spread_width(spark), docs.rdd.getNumPartitions())
    docs.repartition(files, "doc_id").write.mode("overwrite").parquet(f"{root}/in")
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "toxic")
    q = start_cleaning_stream(spark, f"{root}/in", f"{root}/out", f"{root}/ckpt", lookup=labels,
                              max_files_per_trigger=-(-files // STREAM_BATCHES))
    q.awaitTermination()
    return spark.read.parquet(f"{root}/out")


@register("s3_read_latin1_list", r"""WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+', 0)) AS word
  FROM documents)
SELECT word FROM w WHERE regexp_full_match(word, '[\x{00}-\x{FF}]+') AND length(word) > 4""")
def s3_read_latin1_list(spark, sf_dir):
    """Latin-1 tab list: distinct corpus words (Latin-1 range) written in
    ISO-8859-1 together with malformed two-field lines, read back with malformed
    lines dropped."""
    d = read_table(spark, sf_dir, "documents")
    w = explode_rows(d, [], T.words("text"), "word").distinct()
    w = w.where(F.col("word").rlike(r"^[\x{00}-\x{FF}]+$"))
    good = w.where(F.length("word") > 4).select(F.col("word").alias("line"))
    bad = w.where(F.length("word") <= 4).select(F.concat_ws("\t", "word", F.lit("junk")).alias("line"))
    path = IO.scratch_dir(spark, "latin1")
    (good.unionByName(bad).write.mode("overwrite")
     .options(encoding="ISO-8859-1", sep="\t", quote="", escape="", header=False).csv(path))
    return IO.read_latin1_list(spark, path)
