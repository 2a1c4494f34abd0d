import random
import re

import numpy as np

from tenuis.llm import jaccard as jj

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def slow_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def slow(rows):
    """(id, set size, smallest linked id) per row, by all pairs."""
    sets = [slow_set(t) for _, t in rows]
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and None not in (rows[i][0], rows[j][0]):
                both = len(sets[i] & sets[j])
                if 100 * both >= 75 * len(sets[i] | sets[j]):
                    group[root(i)] = root(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[root(i)] = min(least.get(root(i), key), key)
    return sorted(((k, len(s), None if k is None else least[root(i)]) for i, ((k, _), s) in enumerate(zip(rows, sets, strict=True))), key=repr)


def check(spark, rows):
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, node string")
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jj.joined(docs).collect()), key=repr)
    assert got == slow(rows)
    return docs


def texts(rng, count):
    words = [f"w{i}" for i in range(400)]
    made = []
    for number in range(count):
        if made and rng.random() < 0.6:
            near = rng.choice(made).split()
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                if near:
                    near[rng.randrange(len(near))] = rng.choice(words)
            made.append(" ".join(near))
        else:
            made.append(" ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 3, 4, 5, 20, 60, 120]))))
    return made


def test_components_equal_all_pairs(spark, monkeypatch):
    rng = random.Random(9)
    made = texts(rng, 220)
    rows = list(enumerate(made)) + [(900, None), (901, ""), (902, " \t"), (None, made[3]), (5, made[5]), (903, "A b C d"), (904, "a B c D")]
    docs = check(spark, rows)
    kept = jj.without_near_copies(docs)
    want = {k for k, n, c in slow(rows) if k is not None and k == c}
    got = [r["doc_id"] for r in kept.collect()]
    assert kept.columns == docs.columns and sorted(i for i in got if i is not None) == sorted(want) and got.count(None) == 1
    assert jj.joined(docs.where("false")).count() == 0
    # Blocks of a few rows take the paths of hot cells.
    monkeypatch.setattr(jj, "BLOCK", 3)
    monkeypatch.setattr(jj, "FIRST_CELLS", 1)
    check(spark, rows)


def test_one_group_of_near_copies_and_a_shared_passage(spark, monkeypatch):
    monkeypatch.setattr(jj, "BLOCK", 8)
    rng = random.Random(2)
    base = [f"b{i}" for i in range(80)]
    passage = " ".join(f"p{i}" for i in range(60))
    rows = []
    for number in range(90):
        near = list(base)
        for _ in range(rng.randint(0, 3)):
            near[rng.randrange(80)] = f"x{rng.randrange(1000)}"
        rows.append((number, " ".join(near)))
    rows += [(200 + i, passage + " " + " ".join(f"u{i}_{j}" for j in range(rng.choice([2, 10, 100])))) for i in range(40)]
    check(spark, rows)


def test_trees_lose_no_pair():
    rng = np.random.default_rng(1)
    base = [rng.integers(-(2**62), 2**62, 300) for _ in range(8)]
    sets = []
    for i in range(200):
        of = base[i % 8]
        sets.append(np.unique(np.concatenate([of[: rng.integers(150, 300)], rng.integers(-(2**62), 2**62, rng.integers(0, 60))])))
    cell = np.repeat([3, 5], [120, 80])
    sizes = np.array([len(s) for s in sets])
    order = np.lexsort((sizes, cell))
    sets, cell, sizes = [sets[i] for i in order], cell[order], sizes[order]
    labels = np.arange(200) % 150
    a, b, most = jj.Forest(cell, sizes, np.stack([jj.signature(s) for s in sets]), labels).pairs()
    got = set(zip(a.tolist(), b.tolist(), strict=True))
    for i in range(200):
        for j in range(i + 1, 200):
            both = len(np.intersect1d(sets[i], sets[j]))
            if cell[i] == cell[j] and labels[i] != labels[j] and 175 * both >= 75 * (len(sets[i]) + len(sets[j])):
                assert (i, j) in got
    assert all(m >= len(np.intersect1d(sets[i], sets[j])) for i, j, m in zip(a, b, most, strict=True))
    assert len(got) < 200 * 199 / 8


def test_a_pair_is_given_where_it_first_meets(spark):
    schema = "node long, n long, at long, token long, label long"
    # Nodes 1 and 2 share tokens 10 to 17 of their prefix, 2 and 3 only token 17; the rows of node 2 are there twice.
    rows = [(1, 32, i, 10 + i, 1) for i in range(8)] + 2 * [(2, 32, i, 10 + i, 2) for i in range(8)] + [(3, 32, 0, 17, 3)]
    before = jj._with_before(spark.createDataFrame(rows, schema)).collect()
    assert len(before) == 17
    met = []
    for token in range(10, 18):
        cell = sorted((r for r in before if r["token"] == token), key=lambda r: r["node"])
        column = {name: np.array([r[name] for r in cell]) for name in ("node", "n", "at", *jj._BEFORE)}
        a, b = np.triu_indices(len(cell), 1)
        new = jj.first_meeting(column["n"], column["at"], [column[c] for c in jj._BEFORE], a, b)
        met += [(token, *pair) for pair in zip(column["node"][a[new]].tolist(), column["node"][b[new]].tolist(), strict=True)]
    # What shares only the last token of a prefix of 8 of 32 with its place 7 can't link any more.
    assert met == [(10, 1, 2)]


def test_wide_bitmaps_and_sizes_lose_no_pair(spark):
    rng = np.random.default_rng(3)
    sets = []
    for _ in range(60):
        of = rng.integers(-(2**62), 2**62, rng.choice([1, 5, 70, 600]))
        sets += [of, *(np.unique(np.concatenate([of[rng.random(len(of)) < keep], rng.integers(-(2**62), 2**62, rng.integers(0, 9))])) for keep in (0.9, 0.8, 0.5))]
    sets = [s for s in sets if len(s)]
    wide = [jj.wide_bitmap(s) for s in sets]
    ruled = 0
    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            may = jj.may_link(wide[i], wide[j])
            ruled += not may
            assert may or 175 * both < 75 * (len(sets[i]) + len(sets[j]))
    assert ruled > 0.9 * len(sets) * (len(sets) - 1) / 2
    rows = [(1, 100, 0, 5, 1), (2, 134, 0, 5, 2), (3, 75, 0, 6, 3), (4, 100, 0, 6, 4), (5, 100, 10, 7, 5), (6, 100, 0, 7, 6), (7, 90, 20, 8, 7), (8, 100, 5, 8, 8)]
    kept = jj._with_partner(spark.createDataFrame(rows, "node long, n long, at long, token long, label long"))
    assert sorted(r["node"] for r in kept.collect()) == [3, 4, 5, 6]
