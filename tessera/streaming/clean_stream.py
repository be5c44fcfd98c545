"""The per-row cleaning and statistics chain on a streaming DataFrame.

Everything in ``functions/`` is a stateless Column expression, so the same chain
runs on ``readStream`` unchanged.  Corpus-level operators (document frequencies,
vocabularies, encoders) need the whole corpus and stay batch jobs; their fitted
tables can be joined to the stream (stream-static join).
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import clean, textstats

DOCUMENT_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def row_features(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Cleaned text (sentinel, twitter markers, word-list rules, basic cleaning) and
    the per-row statistics; valid on batch and streaming frames alike."""
    filled = clean.fill_null_text(F.col(text))
    cleaned = clean.basic_cleaning(clean.wordlist_clean(filled))
    return df.select(key, cleaned.alias("clean_text"), *textstats.doc_features(filled),
                     *textstats.length_features(filled))


def start_cleaning_stream(spark: SparkSession, source_dir: str, sink_dir: str, checkpoint_location: str,
                          schema: str = DOCUMENT_SCHEMA, lookup: DataFrame | None = None,
                          lookup_key: str = "doc_id", available_now: bool = True,
                          max_files_per_trigger: int | None = None) -> StreamingQuery:
    """Parquet files arriving in ``source_dir`` -> row features -> parquet sink.
    ``lookup`` (a fitted batch table, e.g. labels or encodings) is joined to each
    micro-batch as a stream-static join.  Exactly-once through the checkpoint."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    out = row_features(reader.parquet(source_dir))
    if lookup is not None:
        out = out.join(lookup, lookup_key, "left")
    w = (out.writeStream.format("parquet").option("path", sink_dir)
         .option("checkpointLocation", checkpoint_location).outputMode("append"))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()
