import random
import re

from tenuis.llm import decontaminate as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def slow(docs, items, size):
    windows = {}
    for key, text in items:
        words = WORD.findall((text or "").translate(LOWER))
        if words and len(words) <= size:
            windows.setdefault(tuple(words), set()).add(key)
        for i in range(len(words) - size + 1):
            windows.setdefault(tuple(words[i : i + size]), set()).add(key)
    out = []
    for key, text in docs:
        words, hit, found = WORD.findall((text or "").translate(LOWER)), set(), set()
        for window, ids in windows.items():
            for i in range(len(words) - len(window) + 1):
                if tuple(words[i : i + len(window)]) == window:
                    hit |= set(range(i, i + len(window)))
                    found |= ids
        out.append((key, len(words), len(hit), sorted(i for i in found if i is not None)))
    return sorted(out, key=repr)


def got(frame):
    return sorted(
        ((r["doc_id"], r["n_words"], sum(b - a for a, b in r["spans"]), r["items"]) for r in frame.collect()), key=repr
    )


def fixture(spark):
    rng = random.Random(3)
    text = lambda n: " ".join(rng.choice(["A", "b", "É", "d1"]) for _ in range(n))
    items = [(1, text(12)), (2, text(3)), (3, "b"), (4, None), (5, ""), (6, "...!"), (1, "b, b; b"), (None, text(5)), (7, text(40))]
    docs = [(i, text(rng.randint(0, 60))) for i in range(60)] + [(60, None), (61, ""), (0, "b"), (None, "b b"), (62, "xé " * 5000)]
    return (
        docs, items,
        spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, spans int"),
        spark.createDataFrame(items, "item_id long, text string"),
    )


def test_equals_brute_force_for_one_and_for_many_blocks(spark):
    docs, items, frame, bench = fixture(spark)
    for size in (4, 10):
        want = slow(docs, items, size)
        assert got(dc.contamination(frame, bench, size=size)) == want
        assert got(dc.contamination(frame, bench, size=size, max_words=30)) == want
        clean = dc.without_contaminated(frame, bench, size=size, max_words=30)
        assert clean.columns == frame.columns
        assert sorted((r["doc_id"] for r in clean.collect()), key=repr) == sorted((w[0] for w in want if w[2] == 0), key=repr)


def test_empty_tables(spark):
    docs, items, frame, bench = fixture(spark)
    assert dc.report(frame.where("false"), bench).count() == 0
    assert {r["n_hit"] for r in dc.report(frame, bench.where("false")).collect()} == {0}


def test_a_huge_item_is_cut_without_loss():
    words = [str(i).encode() for i in range(9000)]
    whole = set(dc.windows_of(words))
    step, parts = 2000, set()
    for start in range(0, len(words) - 9, step):
        parts |= set(dc.windows_of(words[start : start + step + 9]))
    assert parts == whole
