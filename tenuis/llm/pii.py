"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds the anchors: at-signs, plus signs, digits, digit-dot pairs, address schemes
and identifier cues. At each anchor a deterministic local parser expands to both sides and validates the boundary.
Per kind the parsers run from left to right and never re-enter a span that was taken, so the base kinds equal the
leftmost non-overlapping matches of their patterns; matches that fail validation are consumed and dropped.

Base kinds: email, ip, card, phone. Added kinds: account (an identifier behind a cue such as "IBAN" or "account no",
validated by its checksum or digit count) and login (user and password inside an address, scheme://user:pw@host).

Defined results: a null or empty text has no span; every row is treated alone, so repeated rows give repeated
results; a text is read whole, in one linear pass.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenuis.llm.common import change_text, with_text_columns

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "account", "login")
CUES = (
    "iban", "account", "account no", "account number", "acct", "customer id", "customer number", "passport", "passport no",
    "tax id", "social security number", "ssn", "national id", "member id", "patient id",
)

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGITS = frozenset("0123456789")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_QUAD = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_CUE_GAP = re.compile(r"[\x20]?[:=#][\x20]?|[\x20]")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_IDENTIFIER = re.compile(r"[A-Z]{0,4}[0-9](?:-?[0-9A-Z])+(?![A-Za-z0-9])")
_USERINFO = re.compile(r"[A-Za-z0-9._~%!$&'()*+,;=-]+:[A-Za-z0-9._~%!$&'()*+,;=:-]+@")

Span = tuple[str, int, int]


def anchors() -> ahocorasick.Automaton:
    machine = ahocorasick.Automaton()
    machine.add_word("@", ("email", 1))
    machine.add_word("+", ("phone", 1))
    machine.add_word("://", ("login", 3))
    for digit in "0123456789":
        machine.add_word(digit, ("card", 1))
        machine.add_word(f"{digit}.", ("ip", 1))
    for cue in CUES:
        for form in {cue, cue.upper(), cue.capitalize(), cue.title()}:
            machine.add_word(form, ("account", len(form)))
    machine.make_automaton()
    return machine


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def _email(text: str, at: int, taken: int) -> tuple[int, int, bool] | None:
    start = at
    while start > taken and text[start - 1] in _LOCAL:
        start -= 1
    domain = _DOMAIN.match(text, at + 1) if start < at else None
    return (start, domain.end(), True) if domain else None


def _ip(text: str, dot: int, taken: int) -> tuple[int, int, bool] | None:
    start = dot
    while start > taken and text[start - 1] in _DIGITS:
        start -= 1
    quad = _QUAD.match(text, start) if start < dot else None
    if not quad:
        return None
    parts = [p.lstrip("0") or "0" for p in quad.group().split(".")]
    return start, quad.end(), all(len(p) <= 3 and int(p) <= 255 for p in parts)


def _card(text: str, at: int, taken: int) -> tuple[int, int, bool] | None:
    run = _CARD.match(text, at)
    if not run:
        return None
    digits = run.group().replace(" ", "").replace("-", "")
    return at, run.end(), 13 <= len(digits) <= 19 and luhn(digits)


def _phone(text: str, at: int, taken: int) -> tuple[int, int, bool] | None:
    run = _PHONE.match(text, at)
    return (at, run.end(), 9 <= sum(c in _DIGITS for c in run.group()) <= 15) if run else None


def _iban(value: str) -> bool:
    plain = value.replace(" ", "")
    return 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def _account(text: str, end: int, size: int) -> tuple[int, int, bool] | None:
    """The identifier behind the cue text[end - size : end]."""
    if end > size and text[end - size - 1].isalnum():
        return None
    gap = _CUE_GAP.match(text, end)
    if not gap:
        return None
    iban = _IBAN.match(text, gap.end())
    if iban and _iban(iban.group()):
        return iban.start(), iban.end(), True
    other = _IDENTIFIER.match(text, gap.end())
    if not other:
        return None
    return other.start(), other.end(), 6 <= sum(c in _DIGITS for c in other.group()) and len(other.group()) <= 24


def _login(text: str, end: int) -> tuple[int, int, bool] | None:
    info = _USERINFO.match(text, end)
    return (end, info.end() - 1, True) if info else None


def find(machine: ahocorasick.Automaton, text: str) -> list[Span]:
    """All spans of a text, by kind in the order of KINDS, then by start."""
    taken = dict.fromkeys(KINDS, 0)
    found: dict[str, list[Span]] = {kind: [] for kind in KINDS}
    for last, (kind, size) in machine.iter(text):
        if kind == "account":
            span = _account(text, last + 1, size)
        elif kind == "login":
            span = _login(text, last + 1)
        elif last < taken[kind]:
            continue
        else:
            span = _PARSERS[kind](text, last, taken[kind])
        if span and span[0] >= taken[kind]:
            taken[kind] = span[1]
            if span[2]:
                found[kind].append((kind, span[0], span[1]))
    return [span for kind in KINDS for span in found[kind]]


_PARSERS: dict[str, Callable] = {"email": _email, "ip": _ip, "card": _card, "phone": _phone}


def masked(text: str, spans: list[Span]) -> str:
    """The text with every span, or group of overlapping spans, replaced by the kind of its first span in brackets."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


_SPAN = T.ArrayType(
    T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
)


def personal_data(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: `key` and the spans found, as code points with an exclusive end."""

    def work():
        machine = anchors()

        def compute(texts):
            spans = [find(machine, t) if t else [] for t in texts]
            flat = [s for row in spans for s in row]
            values = pa.StructArray.from_arrays(
                [pa.array([s[0] for s in flat], pa.string()), pa.array([s[1] for s in flat], pa.int64()), pa.array([s[2] for s in flat], pa.int64())],
                names=["kind", "start", "end"],
            )
            offsets = [0]
            for row in spans:
                offsets.append(offsets[-1] + len(row))
            return [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)]

        return compute

    return with_text_columns(documents, [key], text, [T.StructField("spans", _SPAN)], work)


def mask(documents: DataFrame, text: str = "text") -> DataFrame:
    """The same rows and columns, with personal data in the text replaced by its kind."""

    def work():
        machine = anchors()
        return lambda texts: [masked(t, find(machine, t)) if t else t for t in texts]

    return change_text(documents, text, work)


def _of_kinds(*kinds: str):
    return F.filter("spans", lambda span: span.kind.isin(*kinds))


def report(documents: DataFrame) -> DataFrame:
    """Counts of the base kinds, their digest and the list of all spans."""
    found = personal_data(documents)
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")
    return found.select(
        "doc_id",
        *[F.size(_of_kinds(kind)).cast("long").alias(f"n_{kind}") for kind in BASE_KINDS],
        F.sha2(listed(_of_kinds(*BASE_KINDS)).cast("binary"), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )
