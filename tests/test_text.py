import pytest
from pyspark.sql import functions as F

from glossweave.functions import text as T


def values(spark, column, rows):
    """The column over single-value rows, in order; x is the value."""
    df = spark.createDataFrame(list(enumerate(rows)), "n int, x string")
    return [r["y"] for r in df.select("n", column.alias("y")).orderBy("n").collect()]


def test_normalise(spark):
    rows = ["Submit  order", "SUBMIT ORDER", "Submit order.", "Hi {V1}", "Hi %s", "Hi {{ count }}", "a<br/>b", "x&nbsp;y", "ﬁne", " ", "...", "Ärger!", None]
    want = ["submit order"] * 3 + ["hi "] * 3 + ["a b", "x y", "fine", "", "", "ärger", None]
    assert values(spark, T.normalise(F.col("x")), rows) == want


def test_nested_placeholder_is_one_tag(spark):
    assert values(spark, T.normalise(F.col("x")), ['<a href="{x}">Go</a> ${name} &#39; &#x27;']) == ["go  x27"]


@pytest.mark.parametrize(("word", "want"), [("Pallets", "pallet"), ("deliveries", "delivery"), ("boxes", "box"), ("address", "address"), ("status", "status"), ("gas", "gas"), ("driver’s", "driver's"), ("h2os", "h2os"), ("ties", "tie")])
def test_lemma(spark, word, want):
    assert values(spark, T.lemma(F.col("x")), [word]) == [want]


def test_words(spark):
    assert values(spark, T.words(F.col("x")), ["De-hire {n} CHEP’s pallets, now https://x.org/a"]) == [["De-hire", "CHEP’s", "pallets", "now"]]


def test_invariants(spark):
    rows = ["EUR", "SAP", "B1208A", "OK", "{V1}", "12.5 %", "https://a.b/c", "CANCEL", "Cancel", "Pallet exchange"]
    assert values(spark, T.is_invariant(F.col("x")), rows) == [True] * 7 + [False] * 3


def test_locale_names(spark):
    rows = ["de.json", "en-GB.json", "en_gb.json", "package.json", "de.txt", "messages.json"]
    assert values(spark, T.locale_of_file(F.col("x")), rows) == ["de", "en-gb", "en-gb", None, None, None]


def test_similarity_and_candidates(spark):
    df = spark.createDataFrame([("issue date", "issued date"), ("abc", "xyz"), ("a", "a")], "a string, b string")
    got = [round(r[0], 3) for r in df.select(T.similarity(F.col("a"), F.col("b"), 0.85)).collect()]
    assert got == [0.909, 0.0, 1.0]
    grams = spark.createDataFrame([(["proof", "of", "delivery"],), (["of", "delivery"],), (["the"],), (["docket"],), (["2nd", "docket"],)], "g array<string>")
    assert [r[0] for r in grams.select(T.is_candidate(F.col("g"))).collect()] == [True, False, False, True, False]


def test_kept_english(spark):
    df = spark.createDataFrame([("CHEP", "myCHEP", "mychep"), ("Supportanfragen", "support", "support"), ("Palette", "pallet", "pallet"), ("", "x", "x")], "t string, e string, id string")
    assert [r[0] for r in df.select(T.kept_english(F.col("t"), F.col("e"), F.col("id"))).collect()] == [True, True, False, False]
