"""Result cards of parts from claims made of line items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenuis.functions import text as tx
from tenuis.operators import evidence as ev
from tenuis.operators import results as res
from tenuis.plans import features as pf
from tenuis.plans import tables as t

QUERY = "blue widget technology"


def titles(spark: SparkSession, sf: str) -> DataFrame:
    """Titles of orders: 8 to 11 words of a benchmark text from a start that depends on the order."""
    w = tx.words(tx.identity_key(F.col("text")))
    items = t.table(spark, sf, "benchmark").select("item_id", w.alias("w"))
    k = F.col("o_orderkey")
    total = t.row_count(t.table(spark, sf, "benchmark"))
    orders = t.table(spark, sf, "orders").select("o_orderkey", "o_custkey").withColumn("item_id", k % total)
    return orders.join(items, "item_id").select(
        "o_orderkey", "o_custkey", F.array_join(F.slice("w", (k % 5 + 1).cast("int"), (k % 4 + 8).cast("int")), " ").alias("title_key")
    )


def claims(spark: SparkSession, sf: str) -> DataFrame:
    items = t.spread(t.table(spark, sf, "lineitem"), "l_orderkey")
    suppliers = t.table(spark, sf, "supplier").select("s_suppkey", "s_name")
    kind = t.pick(ev.CLAIM_KINDS, (F.col("l_quantity") + F.col("l_linenumber")).cast("int") % 7)
    kind = F.when(F.col("l_discount") >= 0.1, t.pick(["adoption", "standard", "market", "promotional_claim"], F.col("l_linenumber") % 4)).otherwise(kind)
    rows = items.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).join(titles(spark, sf), F.col("l_orderkey") == F.col("o_orderkey"))
    scope_words = res.scope_terms(QUERY)
    return rows.select(
        F.concat(F.lit("part-"), "l_partkey").alias("candidate_id"),
        F.concat_ws("-", F.lit("claim"), F.lpad(F.col("l_orderkey").cast("string"), 9, "0"), "l_linenumber", "l_suppkey", F.unix_date(F.col("l_shipdate").cast("date"))).alias("claim_id"),
        F.concat(F.lit("order-"), "l_orderkey").alias("document_id"), kind.alias("kind"),
        F.when(F.col("l_linestatus") == "F", "support").otherwise("counter").alias("direction"),
        F.when(F.col("l_returnflag") == "N", "core_only").otherwise("full_candidate").alias("scope"),
        t.pick(["A", "B", "C", "D", "unknown"], F.col("l_suppkey") % 5).alias("trust_tier"),
        F.when(F.col("l_suppkey") % 2 == 0, F.array("s_name")).otherwise(F.array().cast("array<string>")).alias("organizations"),
        F.concat(F.lit("pub "), F.col("l_suppkey") % 9).alias("publisher"),
        F.col("l_shipdate").cast("date").alias("published_at"),
        F.when(F.col("l_returnflag") == "A", "industry").otherwise("scientific").alias("source_class"),
        F.concat(F.lit("cust-"), "o_custkey").alias("origin_id"), "title_key", res.in_scope(F.col("title_key"), scope_words).alias("document_in_scope"),
    )


def candidates(spark: SparkSession, sf: str) -> DataFrame:
    temporal = pf.table(spark, sf).select("candidate_id", F.col("temporal_count_coverage_complete").alias("temporal_coverage_complete"))
    rows = t.table(spark, sf, "part").select(
        F.concat(F.lit("part-"), "p_partkey").alias("candidate_id"),
        F.concat_ws(" ", F.when(F.col("p_partkey") % 3 == 0, F.concat("p_name", F.lit("s"))).otherwise(F.upper("p_name")), "p_brand", "p_size").alias("canonical_name"),
        (F.col("p_size") % 10 != 3).alias("evidence_review_complete"),
        (F.col("p_retailprice") % 100 / 100).alias("score"), F.lit(0.5).alias("threshold"),
    )
    scope = res.in_scope(tx.identity_key(F.col("canonical_name")), res.scope_terms(QUERY))
    return rows.join(temporal, "candidate_id").withColumn("name_in_scope", scope)


def evidence_summary(spark: SparkSession, sf: str) -> DataFrame:
    return res.evidence_summary(claims(spark, sf))


def support_documents(spark: SparkSession, sf: str) -> DataFrame:
    return claims(spark, sf).where(res.is_support()).select("candidate_id", F.col("claim_id").alias("place"), "title_key", "origin_id")


def independent_origins(spark: SparkSession, sf: str) -> DataFrame:
    return res.independent_origins(support_documents(spark, sf))


def assessed(spark: SparkSession, sf: str) -> DataFrame:
    return res.assess(candidates(spark, sf), evidence_summary(spark, sf), independent_origins(spark, sf))


def assessments(spark: SparkSession, sf: str) -> DataFrame:
    return assessed(spark, sf).select("candidate_id", "independent_origins", "independent_actors", "status", "reason", F.round("score", 6).alias("score"))


def deduplicated(spark: SparkSession, sf: str) -> DataFrame:
    rows = assessed(spark, sf)
    return res.mark_duplicates(rows, rows.select("candidate_id", F.col("canonical_name").alias("name")))


def result_cards(spark: SparkSession, sf: str) -> DataFrame:
    return deduplicated(spark, sf).select("candidate_id", "status", "reason", "duplicate_of")


def top_results(spark: SparkSession, sf: str) -> DataFrame:
    return res.top_results(deduplicated(spark, sf)).select("top_rank", "candidate_id", "canonical_name", F.round("score", 6).alias("score"))


def result_summary(spark: SparkSession, sf: str) -> DataFrame:
    return res.summary_counts(deduplicated(spark, sf))


def document_totals(spark: SparkSession, sf: str) -> DataFrame:
    return res.document_totals(claims(spark, sf).select("candidate_id", "document_id", "origin_id").distinct())


def best_claims(spark: SparkSession, sf: str) -> DataFrame:
    return res.best_claim(claims(spark, sf).where(F.col("scope") == "full_candidate"), ["pilot", "prototype", "adoption", "investment", "research"])


def model_shortlist(spark: SparkSession, sf: str) -> DataFrame:
    return res.shortlist(candidates(spark, sf), 100, 50).select("shortlist_rank", "candidate_id", F.round("score", 6).alias("score"))


def card_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Spelling keys of part names in four forms with matching and foreign acronyms."""
    p = F.col("p_partkey")
    initials = F.concat(F.substring("p_name", 1, 1), F.substring(F.split_part("p_name", F.lit(" "), F.lit(2)), 1, 1))
    tail = F.when(p % 4 == 0, F.concat(F.lit(" ("), F.upper(initials), F.lit(")"))).when(p % 4 == 1, " (XQZ)").when(p % 4 == 2, "s").otherwise("")
    name = F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), tail)
    return t.table(spark, sf, "part").select("p_partkey", tx.card_key(F.when(p % 4 < 2, F.replace(name, F.lit("-"), F.lit(" "))).otherwise(name)).alias("card_key"), tx.queue_key(name).alias("queue_key"))


QUERIES = {
    name: globals()[name]
    for name in (
        "evidence_summary", "independent_origins", "assessments", "result_cards", "top_results", "result_summary", "document_totals",
        "best_claims", "model_shortlist", "card_keys",
    )
}

_CLAIMS = pf.FEATURES_SQL.rstrip() + f""", tt AS (SELECT o_orderkey, o_custkey, array_to_string(w[CAST(o_orderkey % 5 + 1 AS INT):CAST(o_orderkey % 5 + o_orderkey % 4 + 8 AS INT)], ' ') AS title_key
  FROM orders JOIN (SELECT item_id, string_split({t.norm('text')}, ' ') AS w FROM benchmark) ON item_id = o_orderkey % (SELECT count(*) FROM benchmark)),
cl AS (SELECT 'part-' || l_partkey AS candidate_id,
  'claim-' || lpad(CAST(l_orderkey AS VARCHAR), 9, '0') || '-' || l_linenumber || '-' || l_suppkey || '-' || date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS claim_id,
  'order-' || l_orderkey AS document_id,
  CASE WHEN l_discount >= 0.1 THEN (['adoption','standard','market','promotional_claim'])[l_linenumber % 4 + 1]
    ELSE (['novelty','growth','research','patent','prototype','pilot','investment'])[CAST(l_quantity + l_linenumber AS INT) % 7 + 1] END AS kind,
  CASE WHEN l_linestatus = 'F' THEN 'support' ELSE 'counter' END AS direction, CASE WHEN l_returnflag = 'N' THEN 'core_only' ELSE 'full_candidate' END AS scope,
  (['A','B','C','D','unknown'])[l_suppkey % 5 + 1] AS trust_tier, CASE WHEN l_suppkey % 2 = 0 THEN lower(s_name) ELSE 'pub ' || (l_suppkey % 9) END AS actor,
  'cust-' || o_custkey AS origin_id, title_key, CAST(l_shipdate AS DATE) AS published_at, CASE WHEN l_returnflag = 'A' THEN 'industry' ELSE 'scientific' END AS source_class, contains(' ' || title_key || ' ', ' blue ') OR contains(' ' || title_key, ' widget') AS document_in_scope
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN tt ON l_orderkey = o_orderkey),
cs AS (SELECT *, scope = 'full_candidate' AS fc, kind IN ('adoption','standard','market') AS mk, kind = 'promotional_claim' AS pk,
  scope = 'full_candidate' AND direction = 'support' AND kind NOT IN ('adoption','standard','market','promotional_claim') AS sup FROM cl),
es AS (SELECT candidate_id, count(*) FILTER (fc) AS full_candidate_claims, count(*) FILTER (sup) AS support_claims, count(*) FILTER (fc AND mk) AS maturity_claims,
  count(*) FILTER (fc AND pk) AS promotion_claims, count(*) FILTER (fc AND (direction = 'counter' OR mk OR pk)) AS counter_claims,
  bool_or(sup AND trust_tier IN ('A','B')) AS grounded_ab_support, bool_or(sup AND document_in_scope) AS documents_in_scope, count(DISTINCT actor) FILTER (sup) AS independent_actors FROM cs GROUP BY 1)
"""

ORACLES = {
    "evidence_summary": _CLAIMS + "SELECT * FROM es",
    "document_totals": _CLAIMS + "SELECT count(*) AS relations, count(DISTINCT document_id) AS documents, count(DISTINCT origin_id) AS origins FROM (SELECT DISTINCT candidate_id, document_id, origin_id FROM cl)",
    "best_claims": _CLAIMS + """SELECT candidate_id, claim_id, kind FROM (SELECT *, coalesce(list_position(['pilot','prototype','adoption','investment','research'], kind), 6) AS r FROM cl WHERE scope = 'full_candidate')
 QUALIFY row_number() OVER (PARTITION BY candidate_id ORDER BY r, claim_id, kind) = 1""",
    "model_shortlist": """SELECT row_number() OVER (ORDER BY p_retailprice % 100 / 100 DESC, 'part-' || p_partkey) AS shortlist_rank, 'part-' || p_partkey AS candidate_id, round(p_retailprice % 100 / 100, 6) AS score
 FROM part QUALIFY shortlist_rank BETWEEN 51 AND 150""",
    "card_keys": """WITH n AS (SELECT p_partkey, p_name FROM part) SELECT p_partkey, CASE p_partkey % 4 WHEN 1 THEN p_name || ' (xqz)' ELSE p_name END AS card_key,
 CASE p_partkey % 4 WHEN 0 THEN p_name || ' ' || lower(p_name[1] || split_part(p_name, ' ', 2)[1]) WHEN 1 THEN p_name || ' xqz' ELSE p_name END AS queue_key FROM n""",
}
