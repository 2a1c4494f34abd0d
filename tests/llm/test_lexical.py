import random
import re
from collections import Counter
from math import floor, log

import numpy as np

from tenuis.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def slow_terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def slow(docs, items, best=10):
    corpus = [(key, Counter(slow_terms(text))) for key, text in docs if slow_terms(text)]
    n_docs, length = len(corpus), sum(sum(c.values()) for _, c in corpus)
    df = Counter(t for _, c in corpus for t in c)
    out = []
    for item, text in set(items):
        scored = []
        for key, tally in corpus:
            m = 25 + (75 * sum(tally.values()) * n_docs) // length
            score = 0
            for term, times in Counter(slow_terms(text)).items():
                if tally[term]:
                    w = floor(1000 * log((2 * n_docs + 2) / (2 * df[term] + 1)))
                    score += times * w * ((1_000_000_000 * tally[term]) // (1000 * tally[term] + 8 * m))
            if score > 0:
                scored.append((-score, key is None, key or 0, key))
        scored.sort()
        out += [(item, rank + 1, key, -score) for rank, (score, _, _, key) in enumerate(scored[:best])]
    return sorted(out, key=str)


def found(spark, docs, items, **more):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    i = spark.createDataFrame(items, "item_id long, text string")
    return sorted((tuple(r) for r in lexical.search(d, i, **more).collect()), key=str)


def test_equals_brute_force_with_ties_nulls_repeats_and_blocks(spark):
    rng = random.Random(3)
    words = ["Alpha", "beta", "ÉTÉ", "x1", "día", "b", "c", "d", "e", "f"]
    docs = [(n, " ".join(rng.choices(words, k=rng.randint(0, 12)))) for n in range(150)]
    docs += [(7, docs[7][1]), (None, "beta beta"), (None, "beta beta"), (900, None), (901, ""), (902, "-- !"), (903, "beta " * 20_000)]
    items = [(n, " ".join(rng.choices(words + ["never"], k=rng.randint(1, 15)))) for n in range(12)]
    items += [items[0], (1, "beta x1"), (50, None), (51, "?"), (52, "nowhere")]
    want = slow(docs, items)
    assert found(spark, docs, items) == want
    assert found(spark, docs, items, block_bytes=60) == want


def test_empty_tables(spark):
    assert found(spark, [], [(1, "a")]) == []
    assert found(spark, [(1, "a")], []) == []
    assert found(spark, [(1, None)], [(1, "a")]) == []


def test_graph_shares_sums_and_keeps_scores():
    rng = random.Random(5)
    base = rng.sample(range(40), 20)
    items = [{t: rng.choice([1, 1, 2]) for t in rng.sample(base, rng.randint(0, 15)) + rng.sample(range(40, 60), 3)} for _ in range(30)]
    items.append(dict(items[0]))
    graph = lexical.shared_graph(items)
    table = np.array([[rng.randint(0, 9) for _ in range(7)] for _ in range(60)])
    want = [[sum(m * table[t][d] for t, m in item.items()) for d in range(7)] for item in items]
    assert lexical.accumulators(graph, table).tolist() == want
    assert len(graph.left) > 0
    assert len(graph.left) + sum(map(len, graph.roots)) < sum(map(len, items))
    assert graph.roots[-1] == graph.roots[0]


def test_other_columns_with_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b", 5, 6)], "doc_id int, text string, n int, score int")
    items = spark.createDataFrame([(1, "a", 3)], "item_id int, text string, doc_id int")
    assert lexical.search(docs, items).columns == ["item_id", "rank", "doc_id", "score"]
    assert lexical.search(docs, items).count() == 1
