import corpus_pipeline as cp
import test_decontaminate
import test_jaccard
import test_pii
from tenuis.llm import language, nbest
from tenuis.llm.pieces import Vocabulary

SF = "/root/testdata/sf0.001"


def test_stages_equal_their_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = [(10_001, None, "en", "s", 0), (10_002, "123 !", "en", "s", 5), (10_003, "", "de", "s", 0)]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    bench = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    columns, out = docs.columns, []
    for name, stage in cp.STAGES:
        before = {r["doc_id"]: r for r in docs.collect()}
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after = {r["doc_id"]: r for r in docs.collect()}
        out.append(len(after))
        texts = [(k, r["text"]) for k, r in before.items()]
        if name != "segmentation":
            assert docs.columns == columns
        if name == "language_id":
            assert set(before) - set(after) == {10_001, 10_002, 10_003}
        elif name == "near_copies":
            assert set(after) == {k for k, _, c in test_jaccard.slow(texts) if k == c}
        elif name == "decontamination":
            assert set(after) == {w[0] for w in test_decontaminate.slow(texts, bench, 10) if w[2] == 0}
        elif name == "personal_data":
            assert set(after) == set(before)
            for key, text in texts:
                spans = test_pii.slow(text)
                assert (after[key]["text"] == text) == (not spans) and after[key]["n_chars"] == len(after[key]["text"])
                assert not test_pii.slow(after[key]["text"])
        else:
            decode = nbest.Segmenter(Vocabulary.read()).decode
            assert all(decode(after[key]["ids"]) == text for key, text in texts) and set(after) == set(before)
    assert out[0] > out[1] > out[2] == out[3] == out[4]
    assert sorted(r["doc_id"] for r in cp.run(spark, SF).select("doc_id").collect()) == sorted(after)


def test_rows_without_language_or_id(spark):
    docs = spark.createDataFrame([(1, "the one and the other", "en"), (None, "the two of them", "en")], "doc_id long, text string, lang string")
    assert language.with_known_language(docs, language.fit(docs)).count() == 2
