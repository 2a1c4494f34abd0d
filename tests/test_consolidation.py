"""Consolidation against plain loops on small fixtures."""

import random

import pytest
from pyspark.sql import functions as F

from tenuis.operators import consolidation as con


def least(rows):
    """The row with the least (search, request, time) per key; keys with different content are conflicts."""
    groups = {}
    for row in rows:
        groups.setdefault(row[:2], []).append(row)
    chosen, conflicts = [], []
    for key, copies in groups.items():
        if len({c[5:] for c in copies}) > 1:
            conflicts.append((*key, len(copies)))
        else:
            chosen.append((*min(copies, key=lambda c: [v or "" for v in c[2:5]]), len(copies)))
    return sorted(chosen, key=str), sorted(conflicts, key=str)


def test_least_provenance(spark):
    rng = random.Random(1)
    rows = []
    for n in range(600):
        c, d = ("c", "hot") if n % 3 == 0 else (rng.choice("abc"), f"d{rng.randrange(60)}")
        title = None if d == "d7" else "t" if d != "d9" else rng.choice("xy")
        rows.append((c, d, rng.choice(["s1", "s2", None]), f"r{n:03}", "2026", title, 5))
    rows += [("n", "d", "s", "r", None, None, 1), ("n", "d", "s", "q", None, "", 1)]  # null is not blank in content
    rows += [("e", "e", "s", "r", "t", "same", 1)] * 2
    frame = spark.createDataFrame(rows, "candidate_id string, document_id string, search_id string, request_id string, retrieved_at string, title string, size int")
    keys, provenance = ["candidate_id", "document_id"], ["search_id", "request_id", "retrieved_at"]
    chosen, conflicts = con.least_provenance(frame.repartition(5), keys, provenance)
    want = least(rows)
    assert sorted(map(tuple, chosen.collect()), key=str) == want[0]
    assert sorted(map(tuple, conflicts.collect()), key=str) == want[1]
    assert con.least_provenance(frame.limit(0), keys, provenance)[0].count() == 0


def test_hot_key_moves_one_row_for_each_task(spark):
    rows = spark.range(0, 40_000, 1, 8).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), F.col("id").cast("string").alias("p"), F.lit("x").alias("content")
    )
    out = rows.groupBy("k").agg(F.min_by("content", "p"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Aggregate(") >= 2 and "partial_min_by" in plan  # combined before the shuffle
    chosen, _ = con.least_provenance(rows, ["k"], ["p"])
    assert chosen.where("k = 0").collect()[0]["copies"] == len(range(0, 40_000, 3))


def test_typed_union_adds_up(spark):
    known = spark.createDataFrame([("c1",), ("c2",), ("c2",)], "candidate_id string")
    science = spark.createDataFrame(
        [("c1", "d1", "openalex", "u1", "s", 5), ("c1", "d1", "openalex", "u1", "s", 5), ("c1", "d2", "crossref", "u2", "s", 5), ("c9", "d1", "openalex", "u", "s", 5), ("c2", None, "openalex", "u", "s", 1), ("c2", "d3", None, "u", "s", 1)],
        "candidate_id string, document_id string, connector string, canonical_url string, source_type string, excerpt_length int",
    )
    web = spark.createDataFrame(
        [
            ("c1", "w2", "https://News.example/A", 9), ("c1", "w1", "https://news.example/a", 9), ("c1", "w0", "https://news.example/a", 3), ("c1", "w3", "https://arxiv.org/abs/1", 99),
            ("c2", "w4", "https://blog.nvidia.com/x", None), ("c2", "w5", None, 1), ("c8", "w6", "https://a.example/", 1), ("c2", " ", "https://a.example/", 1), ("c1", "w1", "https://news.example/a", 9),
        ],
        "candidate_id string, document_id string, canonical_url string, excerpt_length int",
    )
    typed = con.typed_union(known, science, web)
    got = sorted((r["connector"] or "-", r["document_id"] or "-", r["outcome"], r["source_type"] or "-") for r in typed.collect())
    assert got == sorted([
        ("openalex", "d1", "science", "s"), ("openalex", "d1", "repeated", "s"), ("crossref", "d2", "other_connector", "s"), ("openalex", "d1", "unknown_candidate", "s"),
        ("openalex", "-", "no_document_id", "s"), ("-", "d3", "other_connector", "s"), ("exa", "w2", "superseded", "industry_media"), ("exa", "w1", "web", "industry_media"),
        ("exa", "w0", "superseded", "industry_media"), ("exa", "w3", "excluded", "scientific_publication"), ("exa", "w4", "web", "company_technical"), ("exa", "w5", "no_address", "-"),
        ("exa", "w6", "unknown_candidate", "industry_media"), ("exa", " ", "no_document_id", "industry_media"), ("exa", "w1", "superseded", "industry_media"),
    ])
    parts = [con.kept_documents(typed), con.excluded_documents(typed), con.left_out(typed)]
    assert sum(p.count() for p in parts) == science.count() + web.count()
    assert [r["reason"] for r in parts[1].collect()] == ["academic_domain"]


def test_totals_by_level(spark):
    log = spark.createDataFrame(
        [("a", "r1", 5, 3, 2, "o1"), ("a", "r1", 1, 1, 0, "o1"), ("a", "r2", 1, 1, 0, "o1"), ("b", "r3", 4, 0, 4, None)],
        "connector string, run_id string, returned long, accepted long, rejected long, origin_id string",
    )
    got = {(r["connector"], r["run_id"]): (r["requests"], r["returned_records"], r["unique_documents"], r["duplicate_documents"]) for r in con.budget_usage(log).collect()}
    assert got == {("a", "r1"): (2, 6, 1, 1), ("a", "r2"): (1, 1, 1, 0), ("a", None): (3, 7, 1, 2), ("b", "r3"): (1, 4, 0, 0), ("b", None): (1, 4, 0, 0), (None, None): (4, 11, 1, 2)}
    gate = spark.createDataFrame(
        [("x", 2, True, "accept", "evidence_review_required", 0), ("y", 0, False, None, "not_grounded", 1)],
        "candidate_id string, groundings long, canonical_grounded boolean, gate_decision string, promotion_status string, issues long",
    )
    rows = {(r["kind"], r["value"]): (r["candidates"], r["groundings"], r["ungrounded"]) for r in con.grounding_totals(gate).collect()}
    assert rows == {
        ("total", None): (2, 2, 1), ("decision", "accept"): (1, 2, 0), ("decision", "not_called"): (1, 0, 1),
        ("status", "evidence_review_required"): (1, 2, 0), ("status", "not_grounded"): (1, 0, 1),
    }


@pytest.mark.parametrize("rows", [0, 1])
def test_enrichment_totals(spark, rows):
    known = spark.createDataFrame([("c",)] * rows, "candidate_id string")
    typed = spark.createDataFrame([("c", "d", "exa", "web"), ("c", "e", "exa", "excluded")][: 2 * rows], "candidate_id string, document_id string, connector string, outcome string")
    coverage = spark.createDataFrame([("c", "industry", "complete"), ("c", "scientific", "partial")][: 2 * rows], "candidate_id string, source_class string, status string")
    got = {r["source_class"]: (r["documents"], r["excluded"], r["left_out"], r["coverage_complete"]) for r in con.enrichment_totals(known, typed, coverage).collect()}
    if rows:
        assert got == {"industry": (1, 1, 0, 1), "scientific": (0, 0, 0, 0), "all": (1, 1, 0, 1)}
    else:
        assert set(got) <= {"all"}
