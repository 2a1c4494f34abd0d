import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tenuis.llm import alignment


@pytest.fixture(scope="module")
def coders():
    return alignment.Coders.read()


@pytest.fixture(scope="module")
def file_coder():
    """A as its file describes it."""
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(alignment.BYTE_BPE)
    coder.encode_special_tokens = True
    return coder


def slow_document(coders, text, file_coder=None):
    """(n_a, n_b, groups, linked pairs) from one encoding of the whole text."""
    if not text:
        return 0, 0, [], []
    full = (" " + text).encode()
    a = file_coder.encode(" " + text, add_special_tokens=False).ids if file_coder else coders.a.encode_ordinary(" " + text)
    b = coders.b.encode(text)
    a_raw, b_raw = [coders.a_bytes[i] for i in a], [coders.b_bytes[i] for i in b]
    if b"".join(a_raw) != full or b"".join(b_raw) != full:
        return 0, 0, [], []
    a_ends, b_ends = np.cumsum([len(x) for x in a_raw]).tolist(), np.cumsum([len(x) for x in b_raw]).tolist()
    pairs = [(x, y) for x, s in zip(a, a_ends) for y, e in zip(b, b_ends) if s == e] if len(a) < 300 else None
    cuts = sorted(set(a_ends) & set(b_ends))
    if pairs is None:
        pairs = [(a[a_ends.index(c)], b[b_ends.index(c)]) for c in cuts]
    groups, last = [], 0
    for cut in cuts:
        left = [i for i, e in zip(a, a_ends) if last < e <= cut]
        right = [i for i, e in zip(b, b_ends) if last < e <= cut]
        groups.append(",".join(map(str, left)) + "|" + ",".join(map(str, right)))
        last = cut
    return len(a), len(b), groups, pairs


def slow(coders, texts, file_coder=None):
    docs = [slow_document(coders, t, file_coder) for t in texts]
    links = Counter(p for d in docs for p in d[3])
    most = Counter()
    for (_, b), n in links.items():
        most[b] = max(most[b], n)
    out = []
    for n_a, n_b, groups, pairs in docs:
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if n_a else ""
        out.append((n_a, n_b, len(groups), len(pairs), sum(links[p] == most[p[1]] for p in pairs), sum(links[p] for p in pairs), digest))
    return out, links


TEXTS = [
    None, "", " ", "  ", "a", "plain words here", "plain words here", "two  spaces and\ttab\n new line \n\n end ", "▁ literal mark",
    "x▁y", "<|endoftext|> and <s> </s> <unk> stay text", "Größe, 東京都 に 住む \U0001f600 emoji nbsp \u0085 \x1c odd", "word " * 3000,
    "it's they'll 12345 3.14 --- foo_bar http://x.y/z?q=1", "\n\nlead", "tail\n ", "a   b", "<0x41> bytes", "é combining",
]


def test_equals_whole_text_encoding(spark, coders, file_coder):
    rng = random.Random(2)
    pieces = ["a", "the", "Wort", " ", " ", "  ", "\n", "\t", "'s", "9", "é", "東", ".", "▁", " ", "x\x1c", "\x85", "​", "<s>", "\U0001f600"]
    texts = TEXTS + ["".join(rng.choices(pieces, k=rng.randint(1, 30))) for _ in range(300)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r[0]: tuple(r)[1:] for r in alignment.report(frame).collect()}
    want, _ = slow(coders, texts, file_coder)
    for number, text in enumerate(texts):
        assert got[number] == want[number], repr(text)


def test_small_containers_memory_and_pair_scores(spark, coders, monkeypatch):
    texts = [f"common word {n % 3} and some {n % 50} more more more" for n in range(120)]
    want, links = slow(coders, texts)
    parts = alignment.Parts(coders, most=1000)
    rows = {}
    for name, container_postings in (("a", 50), ("b", 10**9)):
        monkeypatch.setattr(alignment, "CONTAINER_POSTINGS", container_postings)
        monkeypatch.setattr(alignment, "SLICE_BYTES", 300)
        current, batches, made = alignment._Container(), [], 0
        for start in range(0, 120, 5):
            current.add(parts, list(range(start, start + 5)), texts[start : start + 5])
            if current.full():
                batches += list(current.batches(made))
                made, current = made + 1, alignment._Container()
        batches += list(current.batches(made))
        frame = spark.createDataFrame(pa.Table.from_batches(batches), alignment._INDEX)
        scores = alignment.pair_scores(frame)
        rows[name] = {(r["a"], r["b"]): (r["docs"], r["links"]) for r in scores.collect()}
        sums = {(r["container"], r["place"]): (r["n_best"], r["count_sum"]) for r in alignment.document_sums(frame, scores).collect()}
        places = [(r["container"], r["place"], r["doc_id"]) for r in frame.where("place is not null").collect()]
        assert {d: sums[c, p] for c, p, d in places} == {n: w[4:6] for n, w in enumerate(want)}
    held = Counter(p for t in texts for p in set(slow_document(coders, t)[3]))
    assert rows["a"] == rows["b"] == {p: (held[p], n) for p, n in links.items()}


def test_planes_sparse_and_dense():
    rng = np.random.default_rng(1)
    pair = np.repeat([5, 9, 1 << 40], [3, 60_000, 2])
    place = np.concatenate([[1, 7, 65_535], np.sort(rng.choice(65_536, 60_000, replace=False)), [0, 2]])
    times = np.concatenate([[1, 2, 9], rng.integers(1, 4, 60_000), [4, 4]])
    pairs, planes = alignment.bit_planes(pair, place, times)
    assert pairs.tolist() == [5, 9, 1 << 40]
    assert [len(p) for p in planes.to_pylist()[2]] == [0, 0, 4]
    for part in (planes, planes.slice(1, 2)):
        row, at, bit = alignment.places_of(part)
        got = Counter()
        for r, p, b in zip(row.tolist(), at.tolist(), bit.tolist()):
            got[r, p] += 1 << b
        shift = 3 - len(part)
        want = {(i - shift, p): t for i, p, t in zip(np.repeat([0, 1, 2], [3, 60_000, 2]).tolist(), place.tolist(), times.tolist()) if i >= shift}
        assert got == want


def test_empty_table_null_and_repeated_ids_and_clashing_names(spark):
    kind = "doc_id int, text string, a int, place int, n_best int"
    assert alignment.report(spark.createDataFrame([], kind)).count() == 0
    frame = spark.createDataFrame([(None, "x y", 1, 2, 3), (4, "x y", 1, 2, 3), (4, "x y", 1, 2, 3)], kind)
    got = alignment.report(frame).collect()
    assert sorted(str(r["doc_id"]) for r in got) == ["4", "4", "None"]
    assert len({tuple(r)[1:] for r in got}) == 1
