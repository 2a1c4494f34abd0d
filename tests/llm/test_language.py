import math
import zlib

import numpy as np
import pytest

from tenuis.llm import language
from tenuis.llm.pieces import Vocabulary, edges

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def vocabulary():
    return Vocabulary.read()


def brute(vocabulary, p, chunk):
    lattice = edges(vocabulary.known, chunk)

    def go(at):
        return 1.0 if at == len(chunk) else sum(p[number] * go(end) for end, number, _ in lattice[at])

    return math.log(go(0))


def test_forward_sums_all_segmentations(vocabulary):
    rng = np.random.default_rng(1)
    p = rng.random((len(vocabulary.surface) + 1, 3)) / 1000
    model = language.Model(vocabulary, ["a", "b", "c"], p)
    scorer = language.Scorer(model)
    words = [" the", "\n", "ingx", " a", "é", " international", "", "  ", " x\0y"]
    fast = language.forward(vocabulary.known, scorer.pieces_in, p, words)
    for i, word in enumerate(words):
        for lang in range(3):
            assert fast[i, lang] == pytest.approx(brute(vocabulary, p[:, lang], word))
            assert language._forward_long(vocabulary.known, p, word)[lang] == pytest.approx(fast[i, lang])


def test_expected_counts_of_one_segmentation(vocabulary):
    p = [1e-9] * (len(vocabulary.surface) + 1)
    number = vocabulary.known[" the"][0]
    p[number] = 0.5
    assert language.expected_counts(vocabulary.known, p, " the")[number] == pytest.approx(1.0, abs=1e-6)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = language.report(docs).join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    assert len(rows) == docs.count()
    out = [r for r in rows if r["held_out"]]
    assert {r["doc_id"] for r in out} == {r["doc_id"] for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2}
    right = sum(r["lang_pred"] == r["lang"] for r in out)
    assert right / len(out) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_edge_rows_and_empty_training(spark):
    rows = [(1, "the thing is in the end", "en"), (3, "der die das und nicht", "de"), (4, None, "en"), (5, "", None), (6, "12 ... 5", "en"),
            (None, "the end", "en"), (7, "nicht " * 50_000, None), (7, "y" * 50_000, None)]
    docs = spark.createDataFrame([(*r, "q") for r in rows], "doc_id long, text string, lang string, score string")
    got = [(r["doc_id"], r["lang_pred"]) for r in language.report(docs).collect()]
    assert len(got) == 8 and [p for i, p in got if i in (4, 5, 6)] == ["und"] * 3 and got[6] == (7, "de")
    model = language.fit(docs)
    kept = language.with_known_language(docs, model)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} >= {1, 3, None}
    assert {r["lang_pred"] for r in language.report(docs.withColumn("lang", docs.lang.substr(9, 1)).where("lang is null")).collect()} <= {"und"}
    assert language.report(docs.where("false")).count() == 0
