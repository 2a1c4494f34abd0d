import re

import pytest
from pyspark.sql import functions as F

from tenuis.functions import text as tx
from tenuis.operators import evidence as ev
from tenuis.operators import relevance as rel
from tenuis.operators.beside import Words
from tenuis.plans import relevance as pr
from tenuis.plans import tables as t

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_row_is_made_beside_a_whole_text(spark):
    docs = spark.createDataFrame([("d", "x. is widely used. " * 5)], "document_id string, excerpt string")
    links = spark.createDataFrame([("c", "d", "x is")], "candidate_id string, document_id string, term string")
    for df in (ev.text_chunks(docs), ev.passages(links, docs), ev.maturity_passages(links, docs)):
        made = re.findall(r"Generate .*", _plan(df))
        assert all(not re.search(r"\[[^\]]*excerpt#", line) for line in made), made


def test_chunks_equal_substrings(spark):
    texts = [None, "", "a", "é𝒳" * 1500, "ab\n c" * 2000, "x" * 3001, "y" * 5500]
    docs = spark.createDataFrame(list(enumerate(texts)), "document_id long, excerpt string")
    got = {(r["document_id"], r["chunk"]): r["key"] for r in ev.text_chunks(docs).collect()}
    want = {}
    for i, text in enumerate(texts):
        for n in range(max(0, -(-(len(text or "") - ev.PASSAGE_CHARS) // ev.PASSAGE_STEP)) + 1):
            want[i, n] = text and text[n * ev.PASSAGE_STEP : n * ev.PASSAGE_STEP + ev.PASSAGE_CHARS]
    keys = spark.createDataFrame([(*k, v) for k, v in want.items()], "d long, c long, p string").select("d", "c", tx.identity_key(F.col("p")).alias("k"))
    assert got == {(r["d"], r["c"]): r["k"] for r in keys.collect()}


def test_texts_are_normalized_once_and_pairs_not_shuffled(spark):
    assert "documents.parquet" not in _plan(pr.ranked(spark, SF))
    docs = t.stored_documents(spark, SF)
    assert "BroadcastHashJoin [pair" in _plan(t.links(spark, SF, docs, t.candidates(spark, SF)))


def test_links_beside_repeated_missing_and_null_rows(spark):
    docs = spark.createDataFrame(
        [("d", "edge chip", "text"), ("d", "other", "edge of a chip"), ("n", None, None), (None, "edge chip", "x")],
        "document_id string, title_key string, excerpt_key string",
    )
    links = spark.createDataFrame([("c", "d"), ("c", "d"), ("c", "n"), ("c", "gone"), ("c", None), (None, "d")], "candidate_id string, document_id string")
    terms = rel.term_rows(spark.createDataFrame([("c", ["chip of", "edge chip", ""])], "candidate_id string, search_terms array<string>"))
    got = {r["document_id"]: (r["term"], r["score"], r["reason"], r["matched_tokens"]) for r in rel.score_links(links, docs, terms).collect()}
    # A term without words counts as wholly in the title, as it always did.
    assert got == {"d": ("edge chip", 100, "exact_title_phrase", ["chip", "edge"]), "n": ("", 80, "all_tokens_in_title", [])}


@pytest.mark.parametrize("phrase", ["b", "b c", "c b", "a b c", "", "ab", "b  c"])
def test_phrases_are_whole_words(spark, phrase):
    row = spark.range(1).select(tx.has_phrase(F.lit("a b c ab"), F.lit(phrase)).alias("x")).first()
    assert Words("a b c ab").has(phrase) == row["x"]


def test_ascii_is_ruled_out_before_the_ranges():
    assert tx.unsafe_pattern().startswith("[[^\\x00-\\x7f]&&")
