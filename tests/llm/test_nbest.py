import itertools
import random

import pyarrow as pa
import pytest

from tenuis.llm import nbest
from tenuis.llm.common import cut_batch
from tenuis.llm.pieces import Vocabulary, chunks, edges


@pytest.fixture(scope="module")
def vocabulary():
    return Vocabulary.read()


def every(vocabulary, text):
    """All segmentations of a text with its leading space, by brute force over the whole text, as (score, ids)."""
    lattice = edges(vocabulary.known, text)

    def go(at):
        if at == len(text):
            yield 0.0, ()
            return
        for end, number, score in lattice[at]:
            head = (number,) if number >= 0 else tuple(vocabulary.bytes_of(text[at]))
            for rest, ids in go(end):
                yield (score if number >= 0 else vocabulary.unknown) + rest, head + ids

    return list(go(0))


def test_n_best_of_short_texts_equal_brute_force(vocabulary):
    rng = random.Random(5)
    alphabet = ["a", "n", "th", "e", " ", "  ", "\n", "é", "▁", "", ".", "ing"]
    for _ in range(150):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 6)))
        segmenter = nbest.Segmenter(vocabulary, 5)
        ids, score, others = segmenter.encode(text)
        want = sorted((s for s, _ in every(vocabulary, " " + text)), reverse=True)[:5]
        got = [score, *(s for s, _ in others)]
        assert got == pytest.approx(want, abs=1e-4), repr(text)
        found = [tuple(ids), *(tuple(nbest.edited(ids, e)) for _, e in others)]
        assert len(set(found)) == len(found)
        scores = dict((i, s) for s, i in every(vocabulary, " " + text))
        for one, value in zip(found, got, strict=True):
            assert scores[one] == pytest.approx(value, abs=1e-4)
            assert segmenter.decode(one) == text


def test_search_order_and_fast_path(vocabulary):
    segmenter = nbest.Segmenter(vocabulary, 4)
    for chunk in (" thereading", "international", " a", "x", " ciónmente,"):
        found = segmenter.search(chunk, 10)
        assert [s for s, _ in found] == sorted((s for s, _ in found), reverse=True)
        ids, score, gap = segmenter.viterbi(chunk)
        assert score == found[0][0] and (len(found) == 1 or gap == pytest.approx(found[0][0] - found[1][0]))
        slow = nbest.Segmenter(vocabulary)
        slow.covered = frozenset()
        assert slow.viterbi(chunk)[1:] == (score, gap)
    assert "".join(itertools.chain(chunks("  a\n b  "))) == "  a\n b  "


def test_rows(spark):
    rows = [(1, None), (2, ""), (3, "Hello  wörld ▁ x\n y\tz 漢字 \U0001f600"), (3, "ab"), (None, "x" * 30_000), (5, " " * 500)]
    docs = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, ids string")
    got = nbest.segmented(docs).collect()
    assert [r["doc_id"] for r in got] == [1, 2, 3, 3, None, 5] and got[0]["ids"] is None and got[0]["n_pieces"] is None
    assert all(r["round_trip"] and r["n_pieces"] == len(r["ids"]) for r in got[1:])
    assert nbest.segmented(docs.where("false")).count() == 0


def test_memory_is_bounded_in_bytes_and_changes_nothing(vocabulary, monkeypatch):
    rng = random.Random(8)
    texts = [" ".join("".join(rng.choices("abcdefgh", k=rng.randint(1, 12))) for _ in range(40)) + " " + "x" * 200 for _ in range(60)]
    free = nbest.Segmenter(vocabulary)
    want = [free.encode(t) for t in texts]
    monkeypatch.setattr(nbest, "CACHE_BYTES", 20_000)
    monkeypatch.setattr(nbest, "SEARCHED_BYTES", 5_000)
    small = nbest.Segmenter(vocabulary)
    for text, expected in zip(texts, want, strict=True):
        assert small.encode(text) == expected
        assert small.held < 21_000 and small.searched_held < 7_000 and len(small.older) < 100
    assert max(map(len, small.cache)) <= nbest.LONGEST


def test_own_bounds_and_lists_of_texts_bounded_in_bytes(vocabulary, spark, monkeypatch):
    rng = random.Random(9)
    texts = [" ".join("".join(rng.choices("abcdéfgh", k=rng.randint(1, 12))) for _ in range(40)) for _ in range(60)]
    free, small = nbest.Segmenter(vocabulary), nbest.Segmenter(vocabulary, memory=(20_000, 5_000))
    for text in texts:
        assert small.encode(text) == free.encode(text)
        assert small.held < 21_000 and small.searched_held < 7_000
    rows = [None, "", *texts, None, "x" * 3000, *texts]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(rows))), pa.array(rows)], names=["doc_id", "text"])
    cut = list(cut_batch(batch, 1000))
    assert pa.Table.from_batches(cut).to_pydict() == batch.to_pydict() and len(cut) > 40
    assert all(b.num_rows == 1 or sum(len((t or "").encode()) for t in b.column(1).to_pylist()) <= 1000 for b in cut)
    assert list(cut_batch(batch.slice(0, 0), 1000))[0].num_rows == 0
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").coalesce(1)
    want = nbest.segmented(docs).collect()
    monkeypatch.setattr(nbest, "AT_ONCE", 1000)
    assert nbest.segmented(docs, memory=(20_000, 5_000)).collect() == want


def test_chunks_side_by_side_equal_single_ones(vocabulary, monkeypatch):
    rng = random.Random(10)
    letters = ["a", "b", "e", "n", "s", "t", "i", "o", "r", "th", "é", " ", "1", ",", "\n", "漢", "\U0001f600", "▁"]
    found = list(dict.fromkeys("".join(rng.choices(letters[:11] if rng.random() < 0.8 else letters, k=rng.randint(1, 30))) for _ in range(3000)))
    found += ["a" * 64, "a" * 65, "b" * 500, " "]
    segmenter, alone = nbest.Segmenter(vocabulary), nbest.Segmenter(vocabulary)
    calls = []
    monkeypatch.setattr(segmenter, "viterbi", lambda chunk: calls.append(chunk) or alone.viterbi(chunk))
    monkeypatch.setattr(nbest, "TOGETHER", 500)
    assert segmenter.viterbi_of(found) == [alone.viterbi(chunk) for chunk in found]
    assert len(calls) < len(found) / 3 and {"a" * 65, "b" * 500} <= set(calls) and "a" * 64 not in calls


def test_texts_of_a_list_are_segmented_as_alone(vocabulary):
    rng = random.Random(11)
    texts = [" ".join("".join(rng.choices("abcdefghijé漢", k=rng.randint(1, 9))) for _ in range(rng.randint(0, 60))) for _ in range(80)]
    texts += ["", " ", "a", "\n\n", *texts[:5]]
    got = [(ids.tolist(), *rest) for ids, *rest in nbest.Segmenter(vocabulary, 5).encoded(texts)]
    assert got == [nbest.Segmenter(vocabulary, 5).encode(text) for text in texts]
    assert list(nbest.Segmenter(vocabulary).encoded([])) == []
    assert [nbest.Segmenter(vocabulary, 1).encode(text)[::2] for text in texts] == [(ids, []) for ids, *_ in got]


def test_a_chunk_of_a_list_is_looked_up_once(vocabulary):
    segmenter = nbest.Segmenter(vocabulary)
    seen = []
    segmenter.cache = type("Seen", (dict,), {"get": lambda self, key: seen.append(key)})()
    list(segmenter.encoded(["one two one", "two two", "one"]))
    assert sorted(seen) == [" one", " two"]
