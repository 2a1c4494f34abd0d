"""Quotes in documents and discovery answers against plain loops."""

import json
import random

from tenuis.operators import quotes as qt

KEYS = ["candidate_id", "document_id"]


def places(spark, claims, documents):
    c = spark.createDataFrame(claims, "claim_id long, candidate_id string, document_id string, quote string").repartition(3)
    d = spark.createDataFrame(documents, "candidate_id string, document_id string, excerpt string").repartition(3)
    return {r["claim_id"]: r["start"] for r in qt.located(c, d, KEYS).collect()}


def test_located_equals_find(spark):
    rng = random.Random(9)
    texts = {("c", f"d{n}"): "".join(rng.choices("aé東b \U0001f600", k=rng.randint(0, 200))) for n in range(20)}
    claims = []
    for n in range(800):
        key = ("c", f"d{rng.randrange(22)}")
        text = texts.get(key, "zzz")
        at = rng.randint(0, max(0, len(text) - 1))
        claims.append((n, *key, rng.choice([text[at : at + rng.randint(1, 9)], "nope", "ab", "", None])))
    got = places(spark, claims, [(*k, t) for k, t in texts.items()] + [("c", "d30", None)])
    for n, c, d, quote in claims:
        text = texts.get((c, d))
        assert got[n] == (None if not quote or text is None else text.find(quote)), (n, quote)


def test_ten_thousand_quotes_of_one_document_in_slices(spark, monkeypatch):
    monkeypatch.setattr(qt, "SLICE", 700)
    text = " ".join(f"w{n}" for n in range(12_000))
    claims = [(n, "c", "hot", f"w{n} w{n + 1}") for n in range(10_000)] + [(20_000, "c", "cold", "w1")]
    got = places(spark, claims, [("c", "hot", text), ("c", "cold", "w0 w1")])
    assert len(got) == 10_001 and got[20_000] == 3
    assert all(got[n] == text.find(f"w{n} w{n + 1}") for n in range(0, 10_000, 97))


def test_claim_rules(spark):
    known = spark.createDataFrame([("c",)], "candidate_id string")
    documents = spark.createDataFrame([("c", "d", "the pump works"), ("c", "e", None), ("x", "d", "the pump works")], "candidate_id string, document_id string, excerpt string")
    good = ("d", "pump", "core_only", "support", "pilot", "факт")
    cases = {
        None: good, "not_verbatim": ("d", "Pump", *good[2:]), "unknown_document": ("z", *good[1:]), "invalid_identity": ("d", "", *good[2:]), "invalid_scope": (*good[:2], None, *good[3:]),
        "invalid_direction": (*good[:3], "both", *good[4:]), "invalid_kind": (*good[:4], None, good[5]), "no_explanation": (*good[:5], None),
    }
    rows = [(f"k{n}", "c", *case) for n, case in enumerate(cases.values())] + [("u", "x", *good), ("twice", "c", *good), ("twice", "c", *good), (None, "c", *good), ("n", "c", "e", *good[1:])]
    claims = spark.createDataFrame(rows, "claim_id string, candidate_id string, document_id string, quote string, scope string, direction string, kind string, explanation_ru string")
    got = [(r["claim_id"], r["violation"], r["locator"]) for r in qt.checked_claims(known, claims, documents).collect()]
    want = [(f"k{n}", code, "excerpt[4:8]" if code is None else None) for n, code in enumerate(cases)]
    want += [("u", "unknown_candidate", None), ("twice", "invalid_identity", None), ("twice", "invalid_identity", None), (None, "invalid_identity", None), ("n", "unknown_document", None)]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_discovery_answers_name_every_issue(spark):
    text = "The pilot plant has run since May without any stop."
    asked = [(b, f"g{n}", f"d{n}", "o", "u", text) for b in ("ok", "json", "form", "many", "named", "silent", "typed") for n in range(3)]
    claim = {"quote": text[:30], "kind": "pilot", "direction": "support"}
    record = lambda n, *claims: {"alias_group_id": f"g{n}", "document_id": f"d{n}", "claims": list(claims)}
    answers = {
        "ok": {"documents": [
            record(0, claim, claim, {**claim, "kind": "guess"}), record(1, {**claim, "quote": text[:30].upper()}, {**claim, "more": 1}, {**claim, "quote": 5}), record(1, claim), record(9, claim),
        ]},
        "form": {"documents": [record(0, claim)], "more": 1}, "many": {"documents": [record(0, claim)] * 5}, "named": {"documents": [{**record(0, claim), "x": 1}]},
        "typed": {"documents": [{**record(0, claim), "document_id": 5}]},
    }
    payloads = [(b, json.dumps(a)) for b, a in answers.items()] + [("json", "{oops")]
    a = spark.createDataFrame(asked, "batch_id string, alias_group_id string, document_id string, origin_id string, canonical_url string, excerpt string")
    claims, coverage, issues = qt.discovery_answers(a, spark.createDataFrame(payloads, "batch_id string, payload string"))
    assert [(r["batch_id"], r["document_id"], r["locator"]) for r in claims.collect()] == [("ok", "d0", "excerpt[0:30]")]
    assert sorted((r["document_id"], r["status"]) for r in coverage.where("batch_id = 'ok'").collect()) == [("d0", "processed"), ("d1", "processed"), ("d2", "model_failed")]
    assert {r["status"] for r in coverage.where("batch_id <> 'ok'").collect()} == {"model_failed"} and coverage.count() == len(asked)
    found = sorted((r["batch_id"], r["document_id"] or "", r["code"]) for r in issues.collect())
    assert found == sorted([
        ("ok", "d0", "duplicate_claim"), ("ok", "d0", "invalid_claim"), ("ok", "d1", "non_verbatim"), ("ok", "d1", "invalid_claim"), ("ok", "d1", "invalid_claim"),
        ("ok", "d1", "duplicate_document"), ("ok", "d9", "unknown_document"), ("ok", "d2", "missing_document"),
        *[(b, "", "invalid_response") for b in ("form", "json", "many", "named", "silent", "typed")],
    ])
