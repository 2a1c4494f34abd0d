import unicodedata

from pyspark.sql import functions as F

from tenuis.functions import ids, urls
from tenuis.functions import text as tx


def one(spark, column, *values):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    return [r[0] for r in df.select(column(F.col("v"))).collect()]


def test_fold_is_exact_for_any_text(spark):
    values = ["Straße", "ＡＢＣ", "ﬁne", "ΟΔΟΣ", "İx", "Ünïcode", "é", "кириЛЛица", "№5", "", "a b", "ǅ"]
    assert one(spark, tx.fold, *values) == [unicodedata.normalize("NFKC", v).casefold() for v in values]


def test_orthographic_key_strips_plural_per_word(spark):
    got = one(spark, tx.orthographic_key, "Edge-AI  Chips", "glass_bus basis", "gas abs", "x2s models.", "RAGs nets")
    assert got == ["edge ai chip", "glass bus basis", "gas abs", "x2s models.", "rag net".replace("rag", "rag")]


def test_queue_and_card_keys_differ_in_plural_rule(spark):
    assert one(spark, tx.queue_key, "Чипs nets!", "bus ss ideas") == ["чип net", "bus ss idea"]
    assert one(spark, tx.card_key, "Large models nets", "Federated Learning (FL)", "Graph nets (XYZ)") == [
        "large models net", "federated learning", "graph nets (xyz)",
    ]


def test_title_key_keeps_underscore_and_identity_key_does_not(spark):
    assert one(spark, tx.title_key, "A_b - c!") == ["a_b c"]
    assert one(spark, tx.identity_key, "A_b - c!") == ["a b c"]


def test_phrase_needs_whole_words(spark):
    df = spark.createDataFrame([("edge ai chip", "ai chip"), ("edge aichip", "ai"), ("x", "")], "t string, p string")
    assert [r[0] for r in df.select(tx.has_phrase(F.col("t"), F.col("p"))).collect()] == [True, False, False]


def test_first_spelling_keeps_order(spark):
    df = spark.createDataFrame([(["b", "B", "a", "A"],)], "v array<string>")
    assert df.select(tx.first_spelling(F.col("v"))).first()[0] == ["b", "a"]


def test_doi_rules(spark):
    got = one(spark, ids.normalize_doi, " HTTPS://doi.org/10.1000/AbC ", "doi: 10.12345/x", "10.1/x", "ftp", None)
    assert got == ["10.1000/abc", "10.12345/x", None, None, None]


def test_canonical_url_edges(spark):
    got = one(
        spark, urls.canonical_url, "HTTP://Ex.com:80/a/?b=2&a=1&utm_source=q#f", "https://ex.com:8443", "https://u:p@ex.com/", "ftp://ex.com",
        "https://ex.com/p?q=a+b&e=", "https://ex.com//",
    )
    assert got == ["http://ex.com/a?a=1&b=2", "https://ex.com:8443/", None, None, "https://ex.com/p?e=&q=a+b", "https://ex.com"]
