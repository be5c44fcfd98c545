"""Treebank tokens (published examples), sentences and learned abbreviations."""
import pytest
from pyspark.sql import functions as F

from tessera.functions.treebank import treebank_tokens
from tessera.operators.sentences import fit_abbreviations, split_sentences, tokenize_texts

EXAMPLES = {
    "They'll save and invest more.": ["They", "'ll", "save", "and", "invest", "more", "."],
    "hi, my name can't hello,": ["hi", ",", "my", "name", "ca", "n't", "hello", ","],
    "I cannot work under these conditions!": ["I", "can", "not", "work", "under", "these", "conditions", "!"],
    "The company spent $30,000,000 last year.": ["The", "company", "spent", "$", "30,000,000", "last", "year", "."],
    "Good muffins cost $3.88 in New York.": ["Good", "muffins", "cost", "$", "3.88", "in", "New", "York", "."],
    'He said "stop (now)" and left...': ["He", "said", "``", "stop", "(", "now", ")", "''", "and", "left", "..."],
    "it's John's -- gonna 'tis": ["it", "'s", "John", "'s", "--", "gon", "na", "'t", "is"],
    "": [], "   ": [],
}


@pytest.mark.parametrize("sentence", EXAMPLES)
def test_published_examples(spark, sentence):
    df = spark.createDataFrame([(sentence,)], "s string")
    assert df.select(treebank_tokens("s").alias("t")).first()["t"] == EXAMPLES[sentence]


def corpus(spark):
    rows = [(k, f"We met Dr. Smith at noon. The dog ran home e.g. fast. Was it late? Yes! At noon a fast home was wordy{k}. The dog sat {k}.") for k in range(30)]
    rows += [(100, "He left... Then Dr. Who came. It cost 3.50 or so... maybe. A. B. Cole sat"), (101, None), (102, ""), (103, "no end")]
    return spark.createDataFrame(rows, "id int, text string").repartition(3)


def test_abbreviations_are_learned(spark):
    found = {r["word"] for r in fit_abbreviations(corpus(spark), "text").collect()}
    assert {"dr", "e.g"} <= found and not found & {"noon", "home", "fast", "so", "dog"}
    assert fit_abbreviations(corpus(spark).where("id = 103"), "text").count() == 0
    assert fit_abbreviations(corpus(spark).where("id > 900"), "text").count() == 0


def test_sentences(spark):
    df = corpus(spark)
    s = split_sentences(df, "id", "text", fit_abbreviations(df, "text"))
    of = lambda i: [r["sentence"] for r in s.where(F.col("id") == i).orderBy("no").collect()]
    assert of(0) == ["We met Dr. Smith at noon.", "The dog ran home e.g. fast.", "Was it late?", "Yes!", "At noon a fast home was wordy0.", "The dog sat 0."]
    assert of(100) == ["He left...", "Then Dr. Who came.", "It cost 3.50 or so... maybe.", "A. B. Cole sat"]
    assert of(101) == [] and of(103) == ["no end"]


def test_tokens_of_texts(spark):
    df = corpus(spark)
    got = {r["id"]: r["tokens"] for r in tokenize_texts(df, "id", "text").collect()}
    assert got[0][:8] == ["We", "met", "Dr.", "Smith", "at", "noon", ".", "The"] and got[0][-2:] == ["0", "."]
    assert got[101] == got[102] == [] and len(got) == df.count()
