import math

import numpy as np
import pytest

from tenuis.llm import pseudo_lm as lm

SF = "/root/testdata/sf0.001"


def small(classes=70, seed=1):
    rng = np.random.default_rng(seed)
    net = lm.Network(classes)
    net.flat[:] = rng.standard_normal(len(net.flat)).astype(np.float32) * 0.3
    return net


def slow(net, ids):
    """The sum of log-probabilities, word by word."""
    total = 0.0
    for i, target in enumerate(ids):
        h = net.bias.astype(float).copy()
        for k, offset in enumerate(lm.OFFSETS):
            at = i + offset
            h += net.embed[k][ids[at] if 0 <= at < len(ids) else net.classes]
        group, slot = divmod(int(target), lm.SLOTS)
        for out, bias, want in ((net.group_out, net.group_bias, group), (net.out[group], net.out_bias[group], slot)):
            logits = np.tanh(h) @ out.astype(float) + bias
            total += logits[want] - math.log(np.exp(logits).sum())
    return total


def test_scores_equal_a_plain_loop():
    net, ids = small(), np.array([0, 33, 69, 69, 1, 40, 5], dtype=np.uint16)
    for part in (ids, ids[:1], ids[:2]):
        got = net.log_probability(net.contexts(part, np.arange(len(part))), part.astype(np.int64)).sum()
        assert got == pytest.approx(slow(net, part), abs=1e-4)


def test_gradient_equals_differences():
    net, ids = small(), np.array([0, 33, 69, 69, 1, 40, 5], dtype=np.uint16)
    context, target = net.contexts(ids, np.arange(7)), ids.astype(np.int64)
    loss, grown = net.gradient(context, target)
    assert loss == pytest.approx(-net.log_probability(context, target).mean(), abs=1e-5)
    for at in np.random.default_rng(0).choice(len(net.flat), 60, replace=False):
        old = net.flat[at]
        sides = []
        for step in (0.02, -0.02):
            net.flat[at] = old + np.float32(step)
            sides.append(-net.log_probability(context, target).mean())
        net.flat[at] = old
        assert grown[at] == pytest.approx((sides[0] - sides[1]) / 0.04, abs=2e-3)


def test_masks_cover_places_and_differ_by_round():
    masks = [set(lm.masked_places(200_000, 5, turn).tolist()) for turn in range(3)]
    assert all(0.05 < len(m) / 200_000 < 0.075 for m in masks)
    assert len(masks[0] & masks[1]) < 0.1 * len(masks[0])


def test_training_helps_and_every_document_is_scored(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    frequent, total = lm.frequent_words(docs, "text")
    plain = {}
    for row in docs.select("text").collect():
        for word in lm.words_of(row["text"]):
            plain[word] = plain.get(word, 0) + 1
    assert total == sum(plain.values()) and frequent == sorted(plain.items(), key=lambda w: (-w[1], w[0]))[: lm.FREQUENT]
    scores = lm.pseudo_likelihood(docs).collect()
    base = lm.pseudo_likelihood(docs, rounds=0).collect()
    assert len(scores) == docs.count() and sum(r["n_words"] for r in scores) == total
    assert sum(r["score"] for r in scores) > sum(r["score"] for r in base) + 0.02 * total


def test_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n "), (4, "one two three"), (4, "one two three"), (None, "word " * 150_000)]
    docs = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, score double")
    got = lm.report(docs).collect()
    assert [(r["doc_id"], r["n_words"], r["mean_score"] is None) for r in got] == [
        (1, 0, True), (2, 0, True), (3, 0, True), (4, 3, False), (4, 3, False), (None, 150_000, False)
    ]
    assert got[3]["score"] == got[4]["score"]
    assert lm.report(docs.where("false")).count() == 0


def test_every_place_trains_in_exactly_one_round():
    for size in (1, 3, 15, 5000):
        for rounds in (1, lm.ROUNDS, lm.MASK_EVERY):
            taken = [place for turn in range(rounds) for place in lm.masked_places(size, 5, turn, rounds).tolist()]
            assert sorted(taken) == list(range(size))


def test_number_of_frequent_words_follows_the_corpus():
    assert [lm.frequent_size(n) for n in (0, 86_461, 404_216, 100_000_000)] == [448, 448, 640, 10_016]


def test_a_rare_word_scores_by_its_own_count(spark, monkeypatch):
    monkeypatch.setattr(lm, "FREQUENT", 0)
    monkeypatch.setattr(lm, "SLOTS", 1)
    rows = [(i, "the the the") for i in range(40)] + [(90, "kaling"), (91, "kaling"), (92, "kaling"), (93, "zzqing")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in lm.pseudo_likelihood(docs).collect()}
    # One frequent word ('the'); the two others share a class, so that their scores differ by their counts alone.
    assert got[90] - got[93] == pytest.approx(math.log(3), abs=1e-5)
    classes = lm.Classes({b"the": 0}, tuple(4 if c == lm.suffix_class(b"ng") else 0 for c in range(lm.SUFFIX_CLASSES)))
    inside = classes.inside(classes.of([b"the", b"kaling", b"zzqing", b"madeuping"]).astype(np.int64), np.array([0, 3, 1, 0]))
    assert np.exp(inside).tolist() == pytest.approx([1, 3 / 5, 1 / 5, 1 / 5])


def test_blocks_end_by_distinct_words_and_counts_meet_them_packed(spark, monkeypatch):
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{w}" for w in rng.zipf(1.3, 40) % 500) for _ in range(50)]
    docs = spark.createDataFrame(list(enumerate([*texts, None, "", "a " * 150_000, "b " * 150_000])), "doc_id long, text string").coalesce(1)
    assert lm.blocks(docs, "doc_id", "text").count() == 1
    monkeypatch.setattr(lm, "BLOCK_DISTINCT", 60)
    monkeypatch.setattr(lm, "PACKED_ROWS", 7)
    cut = lm.cut_lineage(lm.blocks(docs, "doc_id", "text"))
    assert cut.count() > 10
    plain = {}
    for row in docs.collect():
        for word in lm.words_of(row["text"]):
            plain[word] = plain.get(word, 0) + 1
    counts = lm.folded(lm.word_counts(cut))
    frequent = sorted(plain.items(), key=lambda w: (-w[1], w[0]))[:5]
    classes = lm.Classes({w: i for i, (w, _) in enumerate(frequent)}, tuple(lm.shared_tokens(counts, frequent).tolist()))
    got = lm.sequences(cut, counts, classes, "doc_id").collect()
    want = docs.collect()
    assert [r["doc_id"] for r in got] == [r["doc_id"] for r in want]
    for r, w in zip(got, want, strict=True):
        words = lm.words_of(w["text"])
        ids = classes.of(words)
        assert r["ids"] == ids.tobytes()
        assert r["__inside"] == pytest.approx(classes.inside(ids.astype(np.int64), np.array([plain[x] for x in words])).sum())


def test_packed_counts_come_back():
    held = [[np.array([5, 3, 5]), np.array([9, 1, 2]), np.array([4, 1 << 40, 7])], [np.array([3]), np.array([0]), np.array([2])]]
    got = {r["block"]: [x.tolist() for x in lm.found_counts(r["found"])] for r in lm.by_block(held).to_pylist()}
    assert got == {3: [[0, 1], [2, 1 << 40]], 5: [[2, 9], [7, 4]]}


def test_a_step_equals_the_dense_one():
    rng, net = np.random.default_rng(4), small(100)
    squares, flat, dense = lm.Network(100, np.full_like(net.flat, 1e-6)), net.flat.copy(), np.full_like(net.flat, 1e-6)
    for size in (1, 2, 512, 300):
        target = np.minimum(rng.zipf(1.3, size) - 1, 99)
        context = rng.integers(0, 101, (size, 4))
        want, grown = lm.Network(100, flat).gradient(context, target)
        assert want == pytest.approx(-net.log_probability(context, target).mean(), abs=1e-4)
        dense += grown * grown
        flat -= np.float32(lm.RATE) * grown / np.sqrt(dense)
        net.descend(squares, net.cells_of(context), target)
        assert np.abs(net.flat - flat).max() < 1e-5
    untouched = net.cells_of(np.full((1, 4), 100))
    before = net.flat.copy()
    net.descend(squares, untouched, np.array([0]))
    assert (net.flat == before).sum() > len(before) * 0.7


def test_large_logits_score_as_the_loop_does():
    net, ids = small(), np.array([0, 33, 69, 69, 1, 40, 5], dtype=np.uint16)
    net.flat[:] *= 80
    got = net.log_probability(net.contexts(ids, np.arange(7)), ids.astype(np.int64))
    assert np.isfinite(got).all() and got.sum() == pytest.approx(slow(net, ids), rel=1e-4)
    assert math.isfinite(net.gradient(net.contexts(ids, np.arange(7)), ids.astype(np.int64))[0])


def test_documents_in_a_list_keep_their_own_ends():
    net = small()
    documents = [np.array(d, dtype=np.uint16) for d in ([1, 2, 3], [], [4], [], [5, 6])]
    around, at = net.edged(documents)
    want = [net.contexts(d, np.arange(len(d))) for d in documents]
    assert lm._contexts_at(around, at).tolist() == np.concatenate(want).tolist()
    assert around[at].tolist() == [1, 2, 3, 4, 5, 6] and [len(some) for some in lm.listed(documents, 3)] == [1, 4]


def test_words_of_blocks_are_not_sorted_to_meet_their_counts(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, "b c")], "doc_id long, text string")
    cut = lm.blocks(docs, "doc_id", "text")
    plan = lm.sequences(cut, lm.folded(lm.word_counts(cut)), lm.Classes({b"a": 0}), "doc_id")._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
