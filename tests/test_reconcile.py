"""Reconciliation of tables on small fixtures with every outcome planted."""

import pytest

from tenuis.operators import reconcile as rec

PROPOSAL = "group_id string, canonical_name string, primary_group_id string, run_id string, domain string"


def outcomes(spark, slots=("duplicate",)):
    proposals = spark.createDataFrame(
        [("a2", " Pump s ", "a", "r1", "D"), ("b2", "Fan", "b", "r1", "D"), ("a3", " ", "a", "r1", "D"), ("a4", "Pumps", "a", "r1", "D"), ("a5", "PUMP", "a", "r2", "D")], PROPOSAL
    )
    queued = spark.createDataFrame([("a", "slot-1")], "group_id string, candidate_id string")
    held = spark.createDataFrame([("a2", "r1", 2, "d2"), ("a2", "r1", 1, "d1"), ("a2", "r1", 0, "d0"), ("a4", "r1", 0, "d0"), ("a5", "r2", 0, "d1"), ("b2", "r1", 0, "d1")], "group_id string, run_id string, pos int, document_id string")
    documents = spark.createDataFrame([("r1", "d0", " "), ("r1", "d1", " u1 "), ("r1", "d2", "u2"), ("r2", "d1", None)], "run_id string, document_id string, url string")
    addresses = rec.first_addresses(held, documents)
    slot_rows = spark.createDataFrame([(s,) for s in slots], "noise_type string")
    return rec.duplicate_outcomes(proposals, queued, addresses, slot_rows), queued, addresses


def test_each_duplicate_has_one_outcome_and_one_table(spark):
    out, queued, addresses = outcomes(spark)
    assert {r["group_id"]: r["outcome"] for r in out.collect()} == {"a2": "moved", "b2": "primary_not_queued", "a3": "blank_text", "a4": "no_url", "a5": "no_url"}
    overflow = spark.createDataFrame([("candidate_duplicate", k, r) for k, r in (("a2", "r1"), ("b2", "r1"), ("a3", "r1"), ("a4", "r1"), ("a5", "r2"))] + [("candidate", "a2", "r1"), ("candidate_duplicate", "a2", "r9")], "kind string, key string, run_id string")
    assert sorted(map(tuple, rec.remaining_overflow(overflow, out).collect())) == sorted(
        [("candidate_duplicate", k, r) for k, r in (("b2", "r1"), ("a3", "r1"), ("a4", "r1"), ("a5", "r2"), ("a2", "r9"))] + [("candidate", "a2", "r1")]
    )
    suggestions = spark.createDataFrame([("s", "u", "D", "p1", "a"), ("t", "u", "D", "p2", "zz")], "text string, url string, domain string, pos string, primary_group_id string")
    aliases = spark.createDataFrame([("a", "Pumpe", "p3", "D"), ("a2", "P", "p4", "D")], "group_id string, alias string, pos string, domain string")
    pool = rec.duplicate_pool(out, suggestions, queued, aliases, addresses.unionByName(spark.createDataFrame([("a", "ua")], "group_id string, url string")))
    assert sorted((r["text"], r["url"], r["origin_kind"], r["duplicate_of"]) for r in pool.collect()) == [
        ("Pump s", "u1", "candidate_duplicate", "slot-1"), ("Pumpe", "ua", "candidate_alias", "slot-1"), ("s", "u", "alias_suggestion", "slot-1"), ("t", "u", "alias_suggestion", None),
    ]


@pytest.mark.parametrize("slots", [(), ("irrelevant",)])
def test_without_a_slot_nothing_moves(spark, slots):
    assert {r["outcome"] for r in outcomes(spark, slots)[0].where("group_id = 'a2'").collect()} == {"waits"}


def test_grounded_sets(spark):
    rows = [("c", "d2", "canonical", "t", "title", 0, 4), ("c", "d1", "canonical", "t", "excerpt", 5, 9), ("c", "d1", "canonical", "t", "excerpt", 5, 9), ("c", "d3", "alias", "t", "title", 0, 1), ("e", "d3", "alias", "t", "title", 0, 1)]
    groundings = spark.createDataFrame(rows, "candidate_id string, document_id string, term_role string, term string, location string, start int, end int")
    documents = spark.createDataFrame([("d1", " 10.1/X ", "u1", "o1", "k"), ("d2", "10.1/x", "u2", "o2", "k"), ("d3", None, "u3", "o3", "k")], "document_id string, doi string, canonical_url string, origin_id string, connector string")
    members = rec.grounded_members(groundings, documents, "s")
    assert sorted((r["candidate_id"], r["set"], r["member"]) for r in members.where("set <> 'mention'").collect()) == [("c", "connector", "k"), ("c", "document", "d1"), ("c", "origin", "o1"), ("c", "source_kind", "excerpt")]
    names = spark.createDataFrame([("c", "Heat  Pump"), ("e", "Fan")], "candidate_id string, canonical_name string")
    out = rec.grounded_proposals(names, members).collect()
    assert [(r["candidate_id"], r["normalized_name"], r["mentions"], r["documents"]) for r in out] == [("c", "heat pump", 1, 1)]


SHEET = [
    "decision_id", "subject_type", "subject_id", "review_round", "status", "model_label", "noise_type", "rationale", "reviewer_id", "annotated_at", "cutoff_date", "evidence_ids", "search_queries",
    "search_source_classes", "searched_at", "search_notes",
]
MODEL = dict(zip(SHEET, ["m", "model_candidate", "c1", "primary", "reviewed", "mature", None, "why", "r", "2026-01-02", "2026-09-15", "e1; e2;", "q", "scientific;official", "2026-01-01", "n"], strict=True))
NOISE = MODEL | {"subject_type": "noise_control", "subject_id": "n1", "model_label": None, "noise_type": "irrelevant", "evidence_ids": " ; "}
CASES = {
    "blank_cell": MODEL | {"rationale": " "}, "bad_date": MODEL | {"annotated_at": "2026-02-30"}, "unknown_subject_type": MODEL | {"subject_type": "x"}, "unknown_round": MODEL | {"review_round": "x"},
    "unknown_status": MODEL | {"status": "x"}, "noise_type_of_model": MODEL | {"noise_type": "irrelevant"}, "unknown_label": MODEL | {"model_label": None}, "missing_searched_at": MODEL | {"searched_at": None},
    "unknown_search_class": MODEL | {"search_source_classes": "web"}, "missing_search_notes": MODEL | {"search_notes": ""}, "label_of_noise": NOISE | {"model_label": "mature"}, "evidence_of_noise": NOISE | {"evidence_ids": "e1"},
    "unknown_noise_type": NOISE | {"noise_type": "x"},
}


def test_every_rule_of_a_decision(spark):
    good = {"good": MODEL, "noise": NOISE, "unsearched": MODEL | dict.fromkeys(SHEET[12:])}
    rows = [case | {"decision_id": name} for name, case in (CASES | good).items()] + [MODEL | {"decision_id": "twice"}] * 2
    out = rec.typed_decisions(spark.createDataFrame([tuple(r[c] for c in SHEET) for r in rows], ", ".join(f"{c} string" for c in SHEET)))
    got = {r["decision_id"]: r["violation"] for r in out.collect()}
    assert got == {name: name for name in CASES} | dict.fromkeys(good) | {"twice": "repeated_decision"}
    assert [r["evidence_ids"] for r in out.where("decision_id = 'good'").collect()] == [["e1", "e2"]]


def test_references_resolve_once_over_three_tables(spark):
    rows = [MODEL | {"decision_id": "a"}, MODEL | {"decision_id": "b", "subject_id": "c9", "evidence_ids": "e3;e4"}, NOISE | {"decision_id": "c"}, NOISE | {"decision_id": "d", "subject_id": "c1"}]
    decisions = rec.typed_decisions(spark.createDataFrame([tuple(r[c] for c in SHEET) for r in rows], ", ".join(f"{c} string" for c in SHEET)))
    candidates = spark.createDataFrame([("c1",), ("c2",)], "candidate_id string")
    noise = spark.createDataFrame([("n1",), ("n2",)], "noise_id string")
    evidence = spark.createDataFrame([("e1", "c1", "verified"), ("e2", "c2", "verified"), ("e3", "c9", "draft")], "evidence_id string, candidate_id string, status string")
    refs = rec.decision_references(decisions, candidates, noise, evidence)
    assert sorted(map(tuple, refs.collect())) == [
        ("a", "candidate", "c1", "resolved"), ("a", "evidence", "e1", "resolved"), ("a", "evidence", "e2", "foreign"), ("b", "candidate", "c9", "unknown"), ("b", "evidence", "e3", "unknown"),
        ("b", "evidence", "e4", "unknown"), ("c", "noise", "n1", "resolved"), ("d", "noise", "c1", "unknown"),
    ]
    assert [(r["decision_id"], r["evidence_id"]) for r in rec.linked_evidence(refs, evidence).collect()] == [("a", "e1")]
    assert sorted(map(tuple, rec.undecided(refs, candidates, noise).collect())) == [("candidate", "c2"), ("noise", "n2")]


def test_every_rule_of_the_evidence_input(spark):
    kind = "candidate_id string, has_evidence_input boolean, final_evidence_input_count int, scientific_selected int, media_selected int, source_classes_present array<string>"
    declared = {
        "good": (True, 2, 1, 1, ["scientific", "industry"]), "empty": (False, 0, 0, 0, []), "counts_disagree": (True, 2, 2, 1, ["scientific", "industry"]), "flag_disagrees": (False, 1, 1, 0, []),
        "bad_declaration": (None, 0, 0, 0, []), "bad_classes": (True, 1, 1, 0, ["scientific", "scientific"]), "documents_without_input": (False, 0, 0, 0, []), "input_without_documents": (True, 1, 1, 0, ["scientific"]),
        "count_differs": (True, 1, 1, 0, ["scientific", "industry"]), "class_counts_differ": (True, 2, 2, 0, ["scientific", "industry"]), "classes_differ": (True, 2, 1, 1, ["industry"]), "ranks_broken": (True, 2, 1, 1, ["industry", "scientific"]),
        "ranks_null": (True, 2, 1, 1, ["industry", "scientific"]), "count_out_of_range": (True, 7, 7, 0, ["scientific"]),
    }
    coverage = spark.createDataFrame([(k, *v) for k, v in declared.items()] + [("repeated_candidate", False, 0, 0, 0, [])] * 2, kind)
    ranks = {"ranks_broken": (1, 3), "ranks_null": (1, None)}
    documents = [(k, "scientific", ranks.get(k, (1, 2))[0]) for k in declared if k not in ("empty", "input_without_documents", "count_out_of_range", "bad_declaration")]
    documents += [(k, "industry", ranks.get(k, (1, 2))[1]) for k, _, _ in documents if k not in ("bad_classes", "flag_disagrees")] + [("unknown_candidate", "industry", 1)]
    documents += [("count_out_of_range", "scientific", n) for n in range(1, 8)]
    got = {}
    for r in rec.broken_input(coverage, spark.createDataFrame(documents, "candidate_id string, source_class string, final_rank int")).collect():
        got.setdefault(r["candidate_id"], set()).add(r["violation"])
    assert set(got) == {*declared, "unknown_candidate", "repeated_candidate"} - {"good", "empty"}
    assert got.pop("ranks_null") == {"ranks_broken"}
    assert all(name in found for name, found in got.items())
    assert got["ranks_broken"] == {"ranks_broken"} and got["classes_differ"] == {"classes_differ"} and got["count_out_of_range"] == {"count_out_of_range", "too_many_documents"}


def test_identities_of_a_selection(spark):
    selected = spark.createDataFrame([(f"c{n}", "N") for n in range(6)], "candidate_id string, canonical_name string")
    identities = spark.createDataFrame(
        [("c0", "reviewed", "N", "cross-corpus-1"), ("c1", "draft", "N", "cross-corpus-1"), ("c2", "reviewed", "M", "cross-corpus-1"), ("c3", "reviewed", "N", None), ("c4", "reviewed", "N", "cross-corpus-1"), ("c4", "reviewed", "N", "cross-corpus-1")],
        "candidate_id string, identity_status string, canonical_name string, group_id string",
    )
    got = {r["candidate_id"]: (r["group_id"], r["violation"]) for r in rec.selected_identities(selected, identities).collect()}
    assert got == {"c0": ("cross-corpus-1", None), "c1": (None, "not_reviewed"), "c2": (None, "name_differs"), "c3": (None, "bad_group"), "c4": (None, "repeated_identity"), "c5": (None, "missing_identity")}
    pairs = spark.createDataFrame([("c0", "c1", "same_candidate"), ("c0", "x", "same_candidate"), ("c1", "c2", "same_family"), (None, "c1", "same_candidate")], "left_candidate_id string, right_candidate_id string, relation string")
    conflicts = rec.selection_conflicts(pairs, selected)
    assert [tuple(r) for r in conflicts.collect()] == [("c0", "c1")]
    assert [tuple(r) for r in rec.selection_readiness(conflicts).collect()] == [(1, False)]
