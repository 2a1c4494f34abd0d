"""Corpus assembly and coverage on the benchmark tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenuis.functions import crosswalk
from tenuis.operators import corpus
from tenuis.plans import relevance as pr
from tenuis.plans import tables as t

_CLAIMS = [*crosswalk.EVIDENCE_KIND, "unknown_kind"]
_SOURCES = [*crosswalk.EVIDENCE_SOURCE, "unknown_source"]


def labelled(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Parts are positives, customers negatives, and a customer's segment and balance make its decision."""
    positives = t.table(spark, sf, "part").select(
        F.concat(F.lit("part-"), "p_partkey").alias("candidate_id"), F.when(F.col("p_size") % 2 == 0, "reviewed").otherwise("open").alias("identity_status")
    )
    customers = t.table(spark, sf, "customer").select(F.concat(F.lit("cust-"), "c_custkey").alias("candidate_id"), "c_custkey", "c_nationkey")
    decisions = customers.select(
        "candidate_id",
        t.pick(["accepted", "proposed", "rejected"], F.col("c_nationkey") % 3).alias("decision_status"),
        t.pick(["mature", "hype", "mature", "unclear"], F.col("c_custkey") % 4).alias("proposed_label"),
    )
    return positives, customers.select("candidate_id"), decisions


def training_rows(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.training_rows(*labelled(spark, sf))


def unusable_decisions(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.unusable_decisions(labelled(spark, sf)[2])


def proposals(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Orders are proposals; those with a returned line were checked."""
    orders = t.table(spark, sf, "orders").select(F.concat(F.lit("order-"), "o_orderkey").alias("proposal_id"))
    lines = t.table(spark, sf, "lineitem").where(F.col("l_returnflag") == "R")
    return orders, lines.select(F.concat(F.lit("order-"), "l_orderkey").alias("proposal_id"))


def gate_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.gate_coverage(*proposals(spark, sf))


def skipped_proposals(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.skipped_proposals(*proposals(spark, sf))


def evidence_names(spark: SparkSession, sf: str) -> DataFrame:
    """Claims of all lines by their kind of evidence and source."""
    rows = t.table(spark, sf, "lineitem").select(
        t.pick(_CLAIMS, F.col("l_partkey") % len(_CLAIMS)).alias("claim_kind"), t.pick(_SOURCES, F.col("l_suppkey") % len(_SOURCES)).alias("source_type")
    )
    return rows.groupBy(
        crosswalk.renamed(F.col("claim_kind"), crosswalk.EVIDENCE_KIND).alias("evidence_kind"),
        crosswalk.renamed(F.col("source_type"), crosswalk.EVIDENCE_SOURCE).alias("evidence_source"),
    ).agg(F.count(F.lit(1)).alias("claims"))


def relevance_ranks(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.relevance_ranks(pr.kept(spark, sf))


def mentions_over_limit(spark: SparkSession, sf: str) -> DataFrame:
    rows = t.table(spark, sf, "lineitem").select(
        F.concat(F.lit("order-"), "l_orderkey").alias("document_id"), F.col("l_linenumber").alias("position"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("mention_id"),
    )
    return corpus.mentions_over_limit(rows, 4)


QUERIES = {
    "training_rows": training_rows,
    "unusable_decisions": unusable_decisions,
    "gate_coverage": gate_coverage,
    "skipped_proposals": skipped_proposals,
    "evidence_names": evidence_names,
    "relevance_ranks": relevance_ranks,
    "mentions_over_limit": mentions_over_limit,
}

_DECISIONS_SQL = """WITH d AS (SELECT 'cust-' || c_custkey AS candidate_id, (['accepted', 'proposed', 'rejected'])[c_nationkey % 3 + 1] AS decision_status,
  (['mature', 'hype', 'mature', 'unclear'])[c_custkey % 4 + 1] AS proposed_label FROM customer)"""


def _case(column: str, names: dict[str, str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{old}' THEN '{new}'" for old, new in names.items()) + " END"


ORACLES = {
    "training_rows": _DECISIONS_SQL + """
SELECT 'part-' || p_partkey AS candidate_id, 1 AS target, NULL AS negative_class, p_size % 2 = 0 AS identity_reviewed FROM part
UNION ALL SELECT candidate_id, 0, CASE proposed_label WHEN 'hype' THEN 'marketing_hype' ELSE 'mature' END, false FROM d
WHERE decision_status = 'accepted' AND proposed_label IN ('mature', 'hype')""",
    "unusable_decisions": _DECISIONS_SQL + " SELECT candidate_id, proposed_label FROM d WHERE decision_status = 'accepted' AND proposed_label NOT IN ('mature', 'hype')",
    "gate_coverage": """WITH c AS (SELECT o_orderkey, o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') AS seen FROM orders)
SELECT count(*) AS total_proposals, count(*) FILTER (seen) AS checked_proposals, count(*) FILTER (NOT seen) AS skipped_proposals,
  CASE WHEN bool_and(seen) THEN 'complete' ELSE 'partial' END AS status FROM c""",
    "skipped_proposals": "SELECT 'order-' || o_orderkey AS proposal_id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')",
    "evidence_names": f"""WITH r AS (SELECT ({_CLAIMS})[l_partkey % {len(_CLAIMS)} + 1] AS k, ({_SOURCES})[l_suppkey % {len(_SOURCES)} + 1] AS s FROM lineitem)
SELECT {_case('k', crosswalk.EVIDENCE_KIND)} AS evidence_kind, {_case('s', crosswalk.EVIDENCE_SOURCE)} AS evidence_source, count(*) AS claims FROM r GROUP BY 1, 2""",
    "relevance_ranks": t.BASE_SQL + """
SELECT candidate_id, document_id, score, row_number() OVER (PARTITION BY candidate_id ORDER BY score DESC, published_at DESC NULLS LAST, document_id) AS rank FROM kept""",
    "mentions_over_limit": """SELECT document_id, mention_id, place FROM (SELECT 'order-' || l_orderkey AS document_id, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS mention_id,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey)) AS place FROM lineitem) WHERE place > 4""",
}
