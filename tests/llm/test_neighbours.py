import numpy as np

from tenuis.llm import neighbours

SF = "/root/testdata/sf0.1"


def brute(rows, queries, k=5):
    out = {}
    good = [(i, np.array(v, dtype=np.float64)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    for q in queries:
        for i, v in good:
            if i == q:
                scores = [(-float(neighbours.exact_scores(v, w[None])[0]), j) for j, w in good if j != q]
                out[q] = [(j, -s) for s, j in sorted(scores)[:k]]
    return out


def found(frame):
    out = {}
    for r in sorted(frame.collect()):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_recall_against_brute_force(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in table.collect()]
    got, want = found(neighbours.report(table)), brute(rows, [i for i, _ in rows if i % 50 == 0])
    assert set(got) == set(want)
    hits = sum(len({j for j, _ in got[q]} & {j for j, _ in want[q]}) for q in want)
    assert hits / (5 * len(want)) >= 0.93
    scores = {q: dict(v) for q, v in want.items()}
    assert all(abs(s - scores[q][j]) < 1e-12 for q in got for j, s in got[q] if j in scores[q])


def test_bad_vectors_copies_and_ties(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (1, None), (2, []), (3, [0.0, 0.0]), (4, [None, 1.0]), (5, [nan, 1.0]), (6, [float("inf"), 1.0]),
            (None, [1.0, 1.0]), (7, [2.0, 0.0]), (8, [0.0, 3.0]), (50, [1.0, 1.0]), (100, None), (150, [1.0, 2.0, 3.0])]
    rows += [(i, [1.0, 0.0]) for i in range(200, 240)]
    table = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, score int")
    table = table.unionByName(table.where("vec_id = 50"))
    got = found(neighbours.report(table))
    assert set(got) == {0, 50, 200}
    assert [j for j, _ in got[0]] == [7, 200, 201, 202, 203] and [j for j, _ in got[200]] == [0, 7, 201, 202, 203]
    assert [j for j, _ in got[50]] == [0, 7, 8, 200, 201]
    assert neighbours.report(table.where("false")).count() == 0
    assert neighbours.report(table.where("vec_id = 0")).count() == 0


def test_vectors_whose_squares_overflow_or_vanish(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((12, 3))
    factors = [2.0**1000, 2.0**-1000, 1.0, 2.0**600, 2.0**-600, 2.0**-1030]
    rows = [(i * 50, [float(x) * factors[i % 6] for x in v]) for i, v in enumerate(base)]
    got = found(neighbours.report(spark.createDataFrame(rows, "vec_id long, embedding array<double>")))
    plain = brute([(i * 50, v.tolist()) for i, v in enumerate(base)], [i * 50 for i in range(12)])
    for q, want in plain.items():
        assert [j for j, _ in got[q]] == [j for j, _ in want] and len(got[q]) == 5
        assert np.allclose([s for _, s in got[q]], [s for _, s in want], atol=1e-6)
    two = spark.createDataFrame([(0, [1.7976931348623157e308, 1.7e308]), (1, [5e-324, 0.0])], "vec_id long, embedding array<double>")
    assert [(r["vec_id"], round(r["score"], 3)) for r in neighbours.report(two).collect()] == [(1, 0.727)]


def test_queue_opens_leaves_in_falling_priority():
    rng = np.random.default_rng(2)
    sample = rng.standard_normal((500, 8))
    forest = neighbours.fitted(sample, 5000)
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    margins = [(unit[0] @ d.T - t).tolist() for d, t in zip(forest.directions, forest.thresholds, strict=True)]
    opened = forest.search(margins)
    assert [p for p, _, _ in opened] == sorted((p for p, _, _ in opened), reverse=True)
    assert {(t, int(forest.leaves(unit[:1], t)[0])) for t in range(len(margins))} <= {(t, leaf) for _, t, leaf in opened}


def test_leaves_opened_at_once_are_those_of_the_queue():
    sample = np.random.default_rng(6).standard_normal((600, 8))
    forest = neighbours.fitted(sample, 9000)
    unit = sample[:40] / np.linalg.norm(sample[:40], axis=1, keepdims=True)
    opened = forest.opened(unit)
    for row, one in enumerate(unit):
        margins = [(one @ d.T - t).tolist() for d, t in zip(forest.directions, forest.thresholds, strict=True)]
        assert {(t, leaf) for _, t, leaf in forest.search(margins)} == {(int(t), int(leaf)) for t, leaf in np.argwhere(opened[:, row])}


def test_many_groups_give_the_same_and_nothing_is_broadcast(spark, monkeypatch):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").where("vec_id < 700")
    whole = neighbours.report(table)
    want = found(whole)
    assert "Broadcast" not in whole._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(neighbours, "GROUP_BYTES", 5 * 64 * 8)
    assert found(neighbours.report(table)) == want
