"""Rule checks and digests over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenuis.operators import checks, entities
from tenuis.plans import features as pf
from tenuis.plans import results as res
from tenuis.plans import tables as t
from tenuis.sources import bundles


def repeated_keys(spark: SparkSession, sf: str) -> DataFrame:
    return checks.bad_keys(t.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"])


def roster_difference(spark: SparkSession, sf: str) -> DataFrame:
    """Customers with orders, renumbered by 100, against all customers."""
    a = t.table(spark, sf, "orders").select((F.col("o_custkey") + 100).alias("c_custkey"))
    return checks.roster_difference(a, t.table(spark, sf, "customer"), "c_custkey")


def dangling_references(spark: SparkSession, sf: str) -> DataFrame:
    """Lines whose order is not among the finished ones."""
    done = t.table(spark, sf, "orders").where(F.col("o_orderstatus") == "F").select(F.col("o_orderkey").alias("l_orderkey"))
    return checks.dangling(t.table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"), done, ["l_orderkey"])


def differing_attributes(spark: SparkSession, sf: str) -> DataFrame:
    """Copies of the customer's nation and segment, spoilt by number, against the customer."""
    real = t.table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    k = F.col("c_custkey")
    copy = real.select(k, F.when(k % 9 == 0, 99).otherwise(F.col("c_nationkey")).alias("c_nationkey"), F.when(k % 6 == 0, F.lit(None)).otherwise(F.col("c_mktsegment")).alias("c_mktsegment"))
    return checks.differing(copy, real, ["c_custkey"], ["c_nationkey", "c_mktsegment"])


def conflicting_copies(spark: SparkSession, sf: str) -> DataFrame:
    return entities.conflicting_copies(t.table(spark, sf, "part"), "p_name", ["p_brand", "p_type"])


def later_wins(spark: SparkSession, sf: str) -> DataFrame:
    parts = t.table(spark, sf, "part").select("p_name", "p_size")
    least = parts.groupBy("p_name").agg(F.min("p_size").alias("p_size"))
    later = parts.groupBy("p_name").agg(F.max("p_size").alias("p_size")).where(F.col("p_size") > 48)
    return checks.later_wins(least, later, "p_name")


def incomplete_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return checks.incomplete_coverage(pf.candidates(spark, sf), pf.filled_coverage(spark, sf), ["scientific", "industry"])


def coverage_mismatch(spark: SparkSession, sf: str) -> DataFrame:
    """Every seventh customer states one order too many."""
    k = F.col("o_custkey")
    docs = t.table(spark, sf, "orders").select(F.concat(F.lit("cust-"), k).alias("candidate_id"), k)
    stated = docs.groupBy("candidate_id", "o_custkey").agg((F.count(F.lit(1)) + (k % 7 == 0).cast("int")).alias("documents"))
    return checks.coverage_mismatch(stated, docs, "documents")


def assessment_violations(spark: SparkSession, sf: str) -> DataFrame:
    """Cards with their status raised to main for every part whose review is complete."""
    rows = res.assessed(spark, sf).withColumn("status", F.when(F.col("evidence_review_complete"), "main").otherwise(F.col("status")))
    return checks.assessment_violations(rows).groupBy("violation").agg(F.count(F.lit(1)).alias("cards"))


def schema_violations(spark: SparkSession, sf: str) -> DataFrame:
    rows = t.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", (F.col("l_discount") * 11).alias("ratio"))
    return checks.schema_violations(rows, ["l_returnflag"], {"l_returnflag": ["A", "N"]}, ["ratio"]).groupBy("violation").agg(F.count(F.lit(1)).alias("rows"))


def nested_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as nested runs: user turns, assistant turns, system turns."""
    rows = t.table(spark, sf, "conversations").select("conv_id", "role", "turn", F.struct(F.substring(F.sha2("text", 256), 1, 16).alias("document_id"), "turn").alias("d"))
    pick = lambda role: F.transform(F.filter(F.col("all"), lambda x: x["role"] == role), lambda x: x["d"])
    runs = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "d"))).alias("all")).select(
        F.format_string("run-%09d", "conv_id").alias("run_id"), pick("user").alias("scientific"), pick("assistant").alias("media"), pick("system").alias("verification")
    )
    return checks.flatten_runs(runs, ["scientific", "media", "verification"], "document_id")


def table_digest(spark: SparkSession, sf: str) -> DataFrame:
    return bundles.content_digest(t.table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey"))


QUERIES = {
    name: globals()[name]
    for name in (
        "repeated_keys", "roster_difference", "dangling_references", "differing_attributes", "conflicting_copies", "later_wins",
        "incomplete_coverage", "coverage_mismatch", "assessment_violations", "schema_violations", "nested_documents", "table_digest",
    )
}

ORACLES = {
    "repeated_keys": "SELECT l_orderkey, l_linenumber, count(*) AS rows, 'repeated_key' AS violation FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
    "roster_difference": """WITH a AS (SELECT DISTINCT o_custkey + 100 AS c_custkey FROM orders), b AS (SELECT c_custkey FROM customer)
SELECT c_custkey, 'left_only' AS side FROM a WHERE c_custkey NOT IN (SELECT c_custkey FROM b) UNION ALL SELECT c_custkey, 'right_only' FROM b WHERE c_custkey NOT IN (SELECT c_custkey FROM a)""",
    "dangling_references": "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')",
    "differing_attributes": "SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN 'c_nationkey' ELSE 'c_mktsegment' END AS attribute FROM customer WHERE c_custkey % 9 = 0 OR c_custkey % 6 = 0",
    "conflicting_copies": "SELECT p_name, count(*) AS copies FROM part GROUP BY 1 HAVING count(DISTINCT p_brand || '|' || p_type) > 1",
    "later_wins": "SELECT p_name, coalesce(max(p_size) FILTER (p_size > 48), min(p_size)) AS p_size FROM part GROUP BY 1",
    "incomplete_coverage": pf.FEATURES_SQL + "SELECT candidate_id, count(*) FILTER (status = 'complete') AS complete_classes FROM fill GROUP BY 1 HAVING count(*) FILTER (status = 'complete') < 2",
    "coverage_mismatch": "SELECT 'cust-' || o_custkey AS candidate_id, count(*) + 1 AS stated, count(*) AS actual FROM orders WHERE o_custkey % 7 = 0 GROUP BY o_custkey",
    "schema_violations": "SELECT CASE WHEN l_returnflag NOT IN ('A','N') THEN 'enum:l_returnflag' ELSE 'ratio:ratio' END AS violation, count(*) AS rows FROM lineitem WHERE l_returnflag NOT IN ('A','N') OR l_discount * 11 > 1 GROUP BY 1",
    "nested_documents": """SELECT run_id, document_id, turn, (['scientific','media','verification'])[r + 1] AS section FROM (SELECT 'run-' || lpad(CAST(conv_id AS VARCHAR), 9, '0') AS run_id, substr(sha256(text), 1, 16) AS document_id, turn,
 CASE role WHEN 'user' THEN 0 WHEN 'assistant' THEN 1 ELSE 2 END AS r FROM conversations) QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY r, run_id, turn) = 1""",
    "table_digest": """WITH h AS (SELECT CAST('0x' || substr(sha256('{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '","c_nationkey":' || c_nationkey || '}'), 1, 15) AS UBIGINT) AS v FROM customer)
SELECT count(*) AS rows, sha256(count(*) || '|' || CAST(sum(CAST(v AS HUGEINT)) AS VARCHAR)) AS digest FROM h""",
}
