import gzip
import hashlib
import random
from pathlib import Path

import pytest

from tenuis.llm import warc
from tenuis.session import shared_path, stored

KIND = "page_id long, url string, html string"
BIG = "<p>" + "x" * 1200
TRICK = "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 30


def slow(pages):
    payloads = [(p, (h or "").encode()) for p, _, h in pages]
    out = []
    for page, data in payloads:
        same = [p for p, d in payloads if d == data and p is not None]
        last = max(same, default=None)
        again = len(data) >= 1000 and last is not None and page != last
        out.append((page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", last if again else None))
    return sorted(out, key=str)


def found(spark, pages):
    return sorted((tuple(r) for r in warc.report(spark.createDataFrame(pages, KIND).repartition(3)).collect()), key=str)


def test_pages_come_back(spark):
    rng = random.Random(4)
    pages = [(n, f"http://h{n % 5}.org/p/{n}?q=1#f", "".join(rng.choices("aé東<>&\r\n ", k=rng.randint(0, 2500)))) for n in range(60)]
    pages += [(100 + n, f"http://same/{n}", BIG) for n in range(40)] + [(200, None, None), (201, "", ""), (202, "no scheme\r\nX: y", TRICK), (203, "u", TRICK)]
    pages += [(None, "null id", BIG), (None, "null", "y" * 1500), (300, "a", "z" * 1000), (300, "b", "z" * 1000), (300, "b", "z" * 1000), (301, "c", "z" * 999), (302, "c", "z" * 999)]
    pages += [(400, "long", "word é " * 400_000)]
    assert found(spark, pages) == slow(pages)


def test_empty_table_and_clashing_names(spark):
    assert found(spark, []) == []
    frame = spark.createDataFrame([(1, "u", BIG, 2, "x"), (2, "u", BIG, 2, "x")], KIND + ", payload int, digest string")
    assert sorted(tuple(r)[3:] for r in warc.report(frame).collect()) == [("response", None), ("revisit", 2)]


def test_archives_are_gzip_members_of_whole_records(spark):
    path = shared_path(spark, "test")
    warc.write_archives(spark.createDataFrame([(1, "http://h/a b", BIG), (2, "http://h/b", BIG)], KIND).coalesce(1), path)
    data = b"".join(gzip.decompress(p.read_bytes()) for p in Path(path.removeprefix("file:")).glob("part-*"))
    assert data.count(b"WARC/1.1\r\n") == 6 and data.endswith(b"\r\n\r\n")
    assert b"WARC-Target-URI: http://h/a%20b\r\n" in data and b"WARC-Profile: " + warc.SAME_PAYLOAD.encode() in data
    assert data.count(BIG.encode()) == 1


@pytest.mark.parametrize("packed", [True, False])
def test_records_of_any_archive_and_problems(packed):
    blocks = [b"", b"x" * 3_000_000, TRICK.encode(), b"\r\n\r\n", b"\x00\xff"]
    raw = [warc.record([("WARC-Type", "resource"), ("WARC-Record-ID", f"<{n}>")], block) for n, block in enumerate(blocks)]
    pack = gzip.compress if packed else bytes
    whole = b"".join(map(pack, raw))
    assert [(dict(f)["WARC-Record-ID"], b, p) for f, b, p in warc.records_of(memoryview(whole))] == [(f"<{n}>", b, None) for n, b in enumerate(blocks)]
    cut = list(warc.records_of(memoryview(b"".join(map(pack, raw[:1])) + pack(raw[1])[:-30])))
    assert cut[0][2] is None and cut[-1][2] is not None
    assert list(warc.records_of(memoryview(pack(b"junk\r\n\r\n"))))[-1][2] == "not a record"
    assert list(warc.records_of(memoryview(b""))) == []


def stored_records(spark, rows):
    full = [
        {"archive": "a", "place": n, "record_id": i, "type": t, "concurrent_to": c, "fields": {}, "payload": bytearray(b"p"), "problem": None}
        for n, (i, t, c) in enumerate(rows)
    ]
    return stored(spark.createDataFrame(full, warc.RECORDS), "test")


def test_transactions_over_steps_both_directions_and_without_root(spark):
    rows = [
        ("r1", "response", ["q1"]), ("q1", "request", []), ("m1", "metadata", ["q1"]), ("m0", "metadata", ["m1"]),
        ("r2", "response", []), ("q2", "request", ["r2"]), ("q3", "request", ["r2"]), ("m2", "metadata", ["r2", "nowhere"]),
        ("r3", "resource", []), ("q4", "request", []), ("m4", "metadata", ["q4"]), ("m5", "metadata", ["gone"]),
        ("r4", "response", ["r1"]), ("i", "warcinfo", []),
    ]
    got = {
        r["capture_id"]: (r["response"] and r["response"]["record_id"], r["request"] and r["request"]["record_id"], r["metadata"] and r["metadata"]["record_id"], r["n_requests"], r["n_metadata"])
        for r in warc.captures(stored_records(spark, rows)).collect()
    }
    assert got == {
        "r1": ("r1", "q1", "m0", 1, 2), "r2": ("r2", "q2", "m2", 2, 1), "r3": ("r3", None, None, 0, 0), "r4": ("r4", None, None, 0, 0),
        "m4": (None, "q4", "m4", 1, 1), "m5": (None, None, "m5", 0, 1),
    }


def test_broken_archives_give_problem_rows(spark, tmp_path):
    good = gzip.compress(warc.record([("WARC-Type", "response"), ("WARC-Record-ID", "<1>")], b"abc"))
    (tmp_path / "a.warc.gz").write_bytes(good + good[: len(good) // 2])
    (tmp_path / "b.warc").write_bytes(warc.record([("WARC-Type", "response")], b"no id"))
    rows = warc.read_archives(spark, str(tmp_path)).orderBy("archive", "place").collect()
    assert [(r["record_id"], r["problem"] is None) for r in rows] == [("<1>", True), (None, False), (None, False)]
    assert [r["capture_id"] for r in warc.captures(stored(warc.read_archives(spark, str(tmp_path)), "test")).collect()] == ["<1>"]
