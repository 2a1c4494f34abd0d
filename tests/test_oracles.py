"""Queries against their SQL on the smallest tables; the full set runs with oracle_check.py."""

import pytest

import __spark_entry__ as entry
import oracle_check

SF = "/root/testdata/sf0.001"
FAST = [
    "relevance_scores", "best_document_copies", "evidence_documents", "openalex_documents", "mediacloud_issues", "canonical_urls",
    "candidate_proposals", "gate_batch", "acronym_suggestions", "echo_links", "identity_groups", "identity_suggestions", "feature_table",
    "gate_decisions", "groundings", "term_support", "evidence_summary", "queue_filled", "noise_filled", "rubric_audit", "final_decisions",
    "rubric_violations", "nested_documents", "table_digest", "enrichment_rows", "merged_documents", "checked_claims", "discovery_issues",
    "duplicate_overflow", "grounded_proposals", "dangling_decisions", "broken_evidence_input", "model_compatibility",
]


@pytest.mark.parametrize("name", FAST)
def test_query_equals_sql(spark, name):
    message, ok = oracle_check.compare(
        spark, oracle_check.connect(SF), name, entry.queries()[name], entry.oracle_sql()[name], SF
    )
    assert ok, message


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_has_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1
