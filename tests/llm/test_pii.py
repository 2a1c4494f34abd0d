import random
import re

from tenuis.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def slow_luhn(digits):
    values = [int(d) for d in digits[::-1]]
    return sum(v if i % 2 == 0 else sum(divmod(2 * v, 10)) for i, v in enumerate(values)) % 10 == 0


def slow(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub(r"[^0-9]", "", m.group())
            good = {
                "email": lambda: True,
                "ip": lambda: all(int(p) <= 255 for p in m.group().split(".")),
                "card": lambda: 13 <= len(digits) <= 19 and slow_luhn(digits),
                "phone": lambda: 9 <= len(digits) <= 15,
            }[kind]()
            if good:
                out.append((kind, m.start(), m.end()))
    return out


def base(text):
    return [s for s in pii.find(pii.anchors(), text) if s[0] in pii.BASE_KINDS]


def test_base_kinds_equal_the_patterns_on_random_texts():
    rng = random.Random(7)
    pieces = ["@", "@", ".", ".", "+", "1", "25", "255", "0", "4111111111111111", " ", "-", "(", ")", "a", "b.c", "é", "\n", "x@y.z", "+1 (2", "10.0.0.1", "%"]
    for _ in range(20000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(1, 25)))
        assert base(text) == slow(text), repr(text)


def test_added_kinds_and_masking():
    machine = pii.anchors()
    text = "pay to IBAN: DE89 3704 0044 0532 0130 00 or http://bob:pw1@host.org, account no 12-345-678x; ssn 078-05-1120."
    kinds = [(k, text[a:b]) for k, a, b in pii.find(machine, text) if k not in pii.BASE_KINDS]
    assert kinds == [("account", "DE89 3704 0044 0532 0130 00"), ("account", "078-05-1120"), ("login", "bob:pw1")]
    out = pii.masked("mail a@b.co now", pii.find(machine, "mail a@b.co now"))
    assert out == "mail [EMAIL] now"
    assert pii.masked("plain", []) == "plain"


def test_long_runs_stay_linear():
    machine = pii.anchors()
    assert pii.find(machine, "1" * 200_000 + "@" + "a" * 200_000) == []
    assert base("1." * 50_000) == slow("1." * 50_000)


def test_rows_nulls_empty_and_clashing_columns(spark):
    rows = [(1, None, "a"), (2, "", "b"), (3, "x@y.org 1.2.3.4", "c"), (3, "x@y.org 1.2.3.4", "c"), (None, "+1 (234) 555-1234", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    out = sorted((r["doc_id"] or 0, r["n_email"], r["n_ip"], r["n_phone"], r["spans"]) for r in pii.report(docs).collect())
    assert out == [(0, 0, 0, 1, "phone:0:17"), (1, 0, 0, 0, ""), (2, 0, 0, 0, ""), (3, 1, 1, 0, "email:0:7,ip:8:15"), (3, 1, 1, 0, "email:0:7,ip:8:15")]
    cleaned = pii.mask(docs)
    assert cleaned.columns == docs.columns and {r["text"] for r in cleaned.collect()} == {None, "", "[EMAIL] [IP]", "[PHONE]"}
    assert pii.report(docs.where("false")).count() == 0
