"""Published word pairs of the English stemmer."""
from pyspark.sql import functions as F

from tessera.functions.stemming import porter2, stem

PAIRS = """consign consign consigned consign consistency consist consistently consist consolation consol
consolatory consolatori consolidating consolid consolingly consol consonant conson consorting consort conspicuously conspicu
conspiracy conspiraci conspirators conspir conspiring conspir constables constabl constancy constanc constant constant
knackeries knackeri knavish knavish kneaded knead kneeling kneel knees knee knightly knight knitting knit knives knive
knockers knocker knotted knot generate generat generously generous communism communism gaps gap this this kiwis kiwi
hopping hop hoping hope happy happi cry cri by by say say relational relat skies sky news news inning inning
proceed proceed dying die ties tie cries cri agreed agre luxuriated luxuri falling fall""".split()


def test_published_pairs():
    for word, want in zip(PAIRS[::2], PAIRS[1::2]):
        assert porter2(word) == want, word


def test_column(spark):
    df = spark.createDataFrame([("running",), (None,), ("",), ("été",), ("B2B",)], "w string")
    assert [r[0] for r in df.select(stem("w")).collect()] == ["run", None, "", "été", "B2B"]
