"""Repeated requests, typed union of science and web results, totals, on the benchmark tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenuis.functions import urls
from tenuis.operators import consolidation as con
from tenuis.plans import sources as ps
from tenuis.plans import tables as t


def enrichment_copies(spark: SparkSession, sf: str) -> DataFrame:
    """Lines as returned documents: the supplier is the candidate, the part the document, the line number the search.
    Lines of every third order return one and the same document. Copies of every 40th part differ in their language."""
    hot = F.col("l_orderkey") % 3 == 0
    return t.table(spark, sf, "lineitem").select(
        F.concat(F.lit("cand-"), F.when(hot, 0).otherwise(F.col("l_suppkey"))).alias("candidate_id"),
        F.concat(F.lit("part-"), F.when(hot, 0).otherwise(F.col("l_partkey"))).alias("document_id"),
        F.concat(F.lit("search-"), "l_linenumber").alias("search_id"), F.concat(F.lit("req-"), "l_orderkey").alias("request_id"),
        F.col("l_shipdate").cast("date").cast("string").alias("retrieved_at"),
        F.concat(F.lit("Part "), F.when(hot, 0).otherwise(F.col("l_partkey"))).alias("title"),
        F.when(~hot & (F.col("l_partkey") % 40 == 0), F.col("l_returnflag")).otherwise("en").alias("language"),
    )


_PROVENANCE = ["search_id", "request_id", "retrieved_at"]


def enrichment_rows(spark: SparkSession, sf: str) -> DataFrame:
    return con.least_provenance(enrichment_copies(spark, sf), ["candidate_id", "document_id"], _PROVENANCE)[0]


def enrichment_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    return con.least_provenance(enrichment_copies(spark, sf), ["candidate_id", "document_id"], _PROVENANCE)[1]


def typed_input(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Eleven candidates; documents as science, pages as web results. Every fourth host is swapped for a known one, and
    every seventh page shows one and the same address."""
    d, p = F.col("doc_id"), F.col("page_id")
    known = spark.range(11).select(F.concat(F.lit("cand-"), "id").alias("candidate_id"))
    number = F.substring("source", 4, 10).cast("int")
    science = t.table(spark, sf, "documents").select(
        F.concat(F.lit("cand-"), d % 13).alias("candidate_id"), F.concat(F.lit("doc-"), F.floor(d / 2)).alias("document_id"),
        F.when(number % 2 == 0, "openalex").otherwise("crossref").alias("connector"), F.concat(F.lit("https://journal.example.org/"), d).alias("canonical_url"),
        F.lit("scientific_publication").alias("source_type"), F.length("text").alias("excerpt_length"),
    )
    swapped = t.pick(["arxiv.org", "blog.nvidia.com", "www.prnewswire.com", "someone.medium.com", "www.nature.com"], p % 5)
    url = F.when(p % 4 == 0, F.concat(F.lit("https://"), swapped, F.lit("/articles/"), F.floor(p / 100))).when(p % 7 == 0, "http://hot.example.org/A").otherwise(F.col("url"))
    web = t.table(spark, sf, "pages").select(
        F.concat(F.lit("cand-"), p % 12).alias("candidate_id"), F.when(p % 19 != 0, F.concat(F.lit("page-"), p)).alias("document_id"),
        urls.canonical_url(url).alias("canonical_url"), F.length("html").alias("excerpt_length"),
    )
    return known, science, web


def typed(spark: SparkSession, sf: str) -> DataFrame:
    return con.typed_union(*typed_input(spark, sf))


def merged_documents(spark: SparkSession, sf: str) -> DataFrame:
    return con.kept_documents(typed(spark, sf))


def merged_excluded(spark: SparkSession, sf: str) -> DataFrame:
    return con.excluded_documents(typed(spark, sf))


def merged_left_out(spark: SparkSession, sf: str) -> DataFrame:
    return con.left_out(typed(spark, sf)).groupBy("candidate_id", "connector", "outcome").agg(F.count(F.lit(1)).alias("rows"))


def enrichment_totals(spark: SparkSession, sf: str) -> DataFrame:
    known, science, web = typed_input(spark, sf)
    n = F.substring("candidate_id", 6, 4).cast("int")
    coverage = known.select("candidate_id", F.explode(F.array(F.lit("scientific"), F.lit("industry"))).alias("source_class")).withColumn(
        "status", F.when((n + F.length("source_class")) % 3 == 0, "partial").otherwise("complete")
    )
    return con.enrichment_totals(known, con.typed_union(known, science, web), coverage)


def budget_usage(spark: SparkSession, sf: str) -> DataFrame:
    """Lines as requests: the line status is the connector, the line number the run, the part the origin found."""
    bad = F.col("l_returnflag") == "R"
    q = F.col("l_quantity").cast("bigint")
    log = t.table(spark, sf, "lineitem").select(
        F.col("l_linestatus").alias("connector"), F.concat(F.lit("run-"), "l_linenumber").alias("run_id"), q.alias("returned"),
        F.when(bad, 0).otherwise(q).alias("accepted"), F.when(bad, q).otherwise(0).alias("rejected"), F.when(~bad, F.col("l_partkey")).alias("origin_id"),
    )
    return con.budget_usage(log)


def grounding_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as gate rows: their lines are groundings."""
    lines = t.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("groundings"), F.bool_or(F.col("l_linenumber") == 1).alias("canonical_grounded"))
    k = F.col("o_orderkey")
    rows = t.table(spark, sf, "orders").join(lines, k == F.col("l_orderkey"), "left").select(
        F.concat(F.lit("order-"), k).alias("candidate_id"), F.coalesce("groundings", F.lit(0)).alias("groundings"), F.coalesce("canonical_grounded", F.lit(False)).alias("canonical_grounded"),
        F.when(k % 5 != 0, t.pick(["accept", "reject", "review"], k % 3)).alias("gate_decision"),
        F.when(F.col("groundings").isNull(), "not_grounded").when(F.col("canonical_grounded"), "evidence_review_required").otherwise("alias_review_required").alias("promotion_status"),
        (k % 11 == 0).cast("int").alias("issues"),
    )
    return con.grounding_totals(rows)


QUERIES = {
    name: globals()[name]
    for name in ("enrichment_rows", "enrichment_conflicts", "merged_documents", "merged_excluded", "merged_left_out", "enrichment_totals", "budget_usage", "grounding_totals")
}

_COPIES = """WITH c AS (SELECT 'cand-' || CASE WHEN l_orderkey % 3 = 0 THEN 0 ELSE l_suppkey END AS candidate_id, 'part-' || CASE WHEN l_orderkey % 3 = 0 THEN 0 ELSE l_partkey END AS document_id,
 'search-' || l_linenumber AS search_id, 'req-' || l_orderkey AS request_id, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS retrieved_at,
 'Part ' || CASE WHEN l_orderkey % 3 = 0 THEN 0 ELSE l_partkey END AS title, CASE WHEN l_orderkey % 3 <> 0 AND l_partkey % 40 = 0 THEN l_returnflag ELSE 'en' END AS language FROM lineitem),
g AS (SELECT candidate_id, document_id, count(*) AS copies, count(DISTINCT title || '|' || language) AS kinds FROM c GROUP BY ALL)
"""
_TYPED = f"""WITH science AS (SELECT 'cand-' || (doc_id % 13) AS candidate_id, 'doc-' || CAST(floor(doc_id / 2) AS BIGINT) AS document_id,
 CASE WHEN CAST(substr(source, 4) AS INT) % 2 = 0 THEN 'openalex' ELSE 'crossref' END AS connector, 'https://journal.example.org/' || doc_id AS canonical_url, 'scientific_publication' AS source_type,
 length(text) AS excerpt_length, doc_id AS n, doc_id % 13 < 11 AS known FROM documents),
raw AS (SELECT page_id, page_id % 4 = 0 AS swapped, length(html) AS excerpt_length, CASE WHEN page_id % 4 = 0
 THEN 'https://' || (['arxiv.org','blog.nvidia.com','www.prnewswire.com','someone.medium.com','www.nature.com'])[page_id % 5 + 1] || '/articles/' || CAST(floor(page_id / 100) AS BIGINT)
 WHEN page_id % 7 = 0 THEN 'http://hot.example.org/A' ELSE url END AS u FROM pages),
web AS (SELECT 'cand-' || (page_id % 12) AS candidate_id, CASE WHEN page_id % 19 <> 0 THEN 'page-' || page_id END AS document_id, 'exa' AS connector, {ps._url('u')} AS canonical_url,
 CASE WHEN swapped THEN (['scientific_publication','company_technical','press_release','social_or_blog','scientific_publication'])[page_id % 5 + 1] ELSE 'industry_media' END AS source_type,
 excerpt_length, page_id AS n, page_id % 12 < 11 AS known, CASE WHEN swapped THEN page_id % 5 IN (1, 2, 3) ELSE true END AS eligible,
 CASE WHEN NOT swapped THEN 'web_news_or_trade_source' ELSE (['academic_domain','company_domain','press_release_domain','social_or_blog_domain','journal_article_path'])[page_id % 5 + 1] END AS reason FROM raw),
s AS (SELECT *, CASE WHEN NOT known THEN 'unknown_candidate' WHEN connector <> 'openalex' THEN 'other_connector' END AS issue FROM science),
w AS (SELECT *, CASE WHEN NOT known THEN 'unknown_candidate' WHEN document_id IS NULL THEN 'no_document_id' WHEN canonical_url IS NULL THEN 'no_address' WHEN NOT eligible THEN 'excluded' END AS issue FROM web),
so AS (SELECT *, coalesce(issue, CASE WHEN row_number() OVER (PARTITION BY candidate_id, document_id, issue ORDER BY n) = 1 THEN 'science' ELSE 'repeated' END) AS outcome, NULL AS reason FROM s),
wo AS (SELECT *, coalesce(issue, CASE WHEN row_number() OVER (PARTITION BY candidate_id, lower(canonical_url), issue ORDER BY excerpt_length DESC, document_id) = 1 THEN 'web' ELSE 'superseded' END) AS outcome FROM w),
typed AS (SELECT candidate_id, document_id, connector, canonical_url, source_type, excerpt_length, outcome, reason FROM so
 UNION ALL SELECT candidate_id, document_id, connector, canonical_url, source_type, excerpt_length, outcome, reason FROM wo)
"""

ORACLES = {
    "enrichment_rows": _COPIES + """SELECT c.*, copies FROM c JOIN g USING (candidate_id, document_id) WHERE kinds = 1
QUALIFY row_number() OVER (PARTITION BY candidate_id, document_id ORDER BY search_id, request_id, retrieved_at) = 1""",
    "enrichment_conflicts": _COPIES + "SELECT candidate_id, document_id, copies FROM g WHERE kinds > 1",
    "merged_documents": _TYPED + "SELECT candidate_id, document_id, connector, canonical_url, source_type, excerpt_length FROM typed WHERE outcome IN ('science', 'web')",
    "merged_excluded": _TYPED + "SELECT candidate_id, document_id, canonical_url, reason, source_type AS classified_source_type FROM typed WHERE outcome = 'excluded'",
    "merged_left_out": _TYPED + "SELECT candidate_id, connector, outcome, count(*) AS rows FROM typed WHERE outcome NOT IN ('science', 'web', 'excluded') GROUP BY ALL",
    "enrichment_totals": _TYPED + """, cov AS (SELECT i AS n, c, (i + length(c)) % 3 <> 0 AS complete FROM range(11) r(i), (SELECT unnest(['scientific', 'industry']) AS c)),
t AS (SELECT CASE WHEN connector = 'exa' THEN 'industry' ELSE 'scientific' END AS c, count(*) FILTER (outcome IN ('science', 'web')) AS documents,
 count(*) FILTER (outcome = 'excluded') AS excluded, count(*) FILTER (outcome NOT IN ('science', 'web', 'excluded')) AS left_out FROM typed GROUP BY 1),
j AS (SELECT c, documents, excluded, left_out, (SELECT count(*) FROM cov WHERE cov.c = t.c AND complete) AS coverage_complete FROM t)
SELECT coalesce(c, 'all') AS source_class, CAST(sum(documents) AS BIGINT) AS documents, CAST(sum(excluded) AS BIGINT) AS excluded, CAST(sum(left_out) AS BIGINT) AS left_out,
 CAST(sum(coverage_complete) AS BIGINT) AS coverage_complete, CAST(11 AS BIGINT) AS candidates FROM j GROUP BY ROLLUP (c)""",
    "budget_usage": """SELECT l_linestatus AS connector, 'run-' || l_linenumber AS run_id, count(*) AS requests, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS returned_records,
 CAST(sum(CASE WHEN l_returnflag = 'R' THEN 0 ELSE CAST(l_quantity AS BIGINT) END) AS BIGINT) AS accepted_records, CAST(sum(CASE WHEN l_returnflag = 'R' THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS BIGINT) AS rejected_records,
 count(DISTINCT CASE WHEN l_returnflag <> 'R' THEN l_partkey END) AS unique_documents, count(*) FILTER (l_returnflag <> 'R') - count(DISTINCT CASE WHEN l_returnflag <> 'R' THEN l_partkey END) AS duplicate_documents
FROM lineitem GROUP BY ROLLUP (1, 2)""",
    "grounding_totals": """WITH l AS (SELECT l_orderkey, count(*) AS g, bool_or(l_linenumber = 1) AS c FROM lineitem GROUP BY 1),
r AS (SELECT o_orderkey AS k, coalesce(g, 0) AS g, coalesce(c, false) AS c, CASE WHEN o_orderkey % 5 <> 0 THEN (['accept','reject','review'])[o_orderkey % 3 + 1] ELSE 'not_called' END AS d,
 CASE WHEN g IS NULL THEN 'not_grounded' WHEN c THEN 'evidence_review_required' ELSE 'alias_review_required' END AS s FROM orders LEFT JOIN l ON o_orderkey = l_orderkey)
SELECT CASE GROUPING(d, s) WHEN 3 THEN 'total' WHEN 1 THEN 'decision' ELSE 'status' END AS kind, coalesce(d, s) AS value, count(*) AS candidates, CAST(sum(g) AS BIGINT) AS groundings,
 count(*) FILTER (g > 0) AS grounded, count(*) FILTER (g = 0) AS ungrounded, count(*) FILTER (c) AS canonical_grounded, count(*) FILTER (k % 11 = 0) AS issues FROM r GROUP BY GROUPING SETS ((), (d), (s))""",
}
