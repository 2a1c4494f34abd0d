"""Claims with quotes of documents, and discovery answers about conversations, on the benchmark tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenuis.operators import evidence as ev
from tenuis.operators import quotes as qt
from tenuis.plans import tables as t


def claim_input(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Four quotes of every document, some spoilt by number, and one quote per order, all of the longest text."""
    d = F.col("doc_id")
    texts = t.table(spark, sf, "documents")
    known = spark.range(5).select(F.concat(F.lit("cand-"), "id").alias("candidate_id"))
    documents = texts.select(F.concat(F.lit("cand-"), d % 6).alias("candidate_id"), F.concat(F.lit("doc-"), d).alias("document_id"), F.col("text").alias("excerpt"))
    n = d * 4 + F.col("j")
    own = texts.select("doc_id", "text", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("j")).select(
        n.alias("n"), F.concat(F.lit("cand-"), d % 6).alias("candidate_id"), F.concat(F.lit("doc-"), d + F.when(n % 23 == 0, 1_000_000).otherwise(0)).alias("document_id"),
        F.concat(F.substring("text", ((d * 31 + F.col("j") * 97) % 400 + 1).cast("int"), (F.col("j") * 13 + 20).cast("int")), F.when(n % 9 == 0, "¤").otherwise("")).alias("quote"),
    )
    longest = texts.select(F.max(F.struct(F.length("text").alias("n"), "doc_id", "text")).alias("m"))
    hot, hot_text = longest.select("m.doc_id").scalar(), longest.select("m.text").scalar()
    o = F.col("o_orderkey")
    orders = t.table(spark, sf, "orders").select(
        (-o - 1).alias("n"), F.concat(F.lit("cand-"), hot % 6).alias("candidate_id"), F.concat(F.lit("doc-"), hot).alias("document_id"),
        F.substring(hot_text, (o % 5000 + 1).cast("int"), (F.col("o_custkey") % 50 + 21).cast("int")).alias("quote"),
    )
    n = F.col("n")
    claims = own.unionByName(orders).select(
        F.concat(F.lit("claim-"), F.when(n % 41 == 0, 0).otherwise(n)).alias("claim_id"), "candidate_id", "document_id", "quote",
        F.when(n % 13 == 0, "any").when(n % 2 == 0, "full_candidate").otherwise("core_only").alias("scope"), F.when(n % 17 == 0, F.lit(None)).when(n % 3 == 0, "counter").otherwise("support").alias("direction"),
        F.when(n % 19 != 0, "pilot").alias("kind"), F.when(n % 29 != 0, "факт").alias("explanation_ru"),
    )
    return known, claims, documents


def checked_claims(spark: SparkSession, sf: str) -> DataFrame:
    return qt.checked_claims(*claim_input(spark, sf))


def discovery_input(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """A conversation is a batch, its turns are the documents; answers are spoilt by number."""
    c, n = F.col("conv_id"), F.col("turn")
    batch = F.concat(F.lit("batch-"), c, F.lit("-"), F.floor(n / 3))
    rows = t.table(spark, sf, "conversations").where(F.length("text") > 0).select(
        batch.alias("batch_id"), F.concat(F.lit("group-"), c % 7).alias("alias_group_id"), F.concat_ws("-", F.lit("turn"), c, n).alias("document_id"),
        F.concat(F.lit("origin-"), c).alias("origin_id"), F.concat(F.lit("https://c.example/"), c).alias("canonical_url"), F.col("text").alias("excerpt"), "conv_id", "turn",
    )
    quote = F.substring("excerpt", 1, 60)
    claim = F.struct(
        F.when(n % 5 == 3, F.upper(quote)).when(n % 7 == 5, F.substring(quote, 1, 10)).otherwise(quote).alias("quote"),
        F.when(n % 8 == 6, "guess").otherwise("pilot").alias("kind"), F.lit("support").alias("direction"),
    )
    record = F.struct(
        F.col("alias_group_id"), F.when((c % 10 == 4) & (n % 3 == 1), "lost").otherwise(F.col("document_id")).alias("document_id"),
        F.when(n % 4 == 2, F.array(claim, claim)).when((c % 19 == 3) & (n % 3 == 0), F.array(claim, claim, claim, claim)).otherwise(F.array(claim)).alias("claims"),
    )
    given = F.when((c % 6 == 5) & (n % 3 == 2), F.array(record, record)).otherwise(F.array(record))
    packed = rows.groupBy("batch_id", "conv_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("turn", given.alias("r")))), lambda x: x["r"])).alias("documents"))
    whole = F.to_json(F.struct("documents"))
    payload = F.when(c % 17 == 6, F.substring(whole, 2, 40)).when(c % 23 == 8, F.replace(whole, F.lit('{"documents"'), F.lit('{"more":1,"documents"'))).otherwise(whole)
    return rows.drop("conv_id", "turn"), packed.where(c % 13 != 9).select("batch_id", payload.alias("payload"))


def discovery_claims(spark: SparkSession, sf: str) -> DataFrame:
    return qt.discovery_answers(*discovery_input(spark, sf))[0]


def discovery_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return qt.discovery_answers(*discovery_input(spark, sf))[1]


def discovery_issues(spark: SparkSession, sf: str) -> DataFrame:
    return qt.discovery_answers(*discovery_input(spark, sf))[2]


def retry_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Coverage rows of the run that each customer's results come from: primary, or retry where it repaired or found more.
    The retry was not run for low balances; a customer's orders are claims of it."""
    k = F.col("c_custkey")
    customers = t.table(spark, sf, "customer").select(F.concat(F.lit("cust-"), k).alias("candidate_id"), k, "c_acctbal")
    claims = t.table(spark, sf, "orders").select(F.concat(F.lit("cust-"), "o_custkey").alias("candidate_id"))
    primary = customers.select("candidate_id", F.when(k % 4 == 0, "failed").otherwise("complete").alias("status"), k.alias("rows"))
    retry = customers.select("candidate_id", F.when(F.col("c_acctbal") <= 3000, "not_run").when(k % 3 == 0, "failed").otherwise("complete").alias("status"), (k + 1000).alias("rows"))
    return ev.merged_rows(ev.retry_source(primary, retry, claims), primary, retry)


QUERIES = {name: globals()[name] for name in ("checked_claims", "discovery_claims", "discovery_coverage", "discovery_issues", "retry_rows")}

_DISCOVERY = """WITH rows AS (SELECT *, 'batch-' || conv_id || '-' || CAST(floor(turn / 3) AS BIGINT) AS batch_id, 'group-' || (conv_id % 7) AS g, 'turn-' || conv_id || '-' || turn AS d, conv_id AS c, turn AS n,
 row_number() OVER (PARTITION BY conv_id, turn) AS copy FROM conversations WHERE length(text) > 0),
rec AS (SELECT *, CASE WHEN c % 10 = 4 AND n % 3 = 1 THEN 'lost' ELSE d END AS rd, CASE WHEN n % 4 = 2 THEN 2 WHEN c % 19 = 3 AND n % 3 = 0 THEN 4 ELSE 1 END AS k, CASE WHEN c % 6 = 5 AND n % 3 = 2 THEN 2 ELSE 1 END AS times,
 CASE WHEN n % 5 = 3 THEN upper(substr(text, 1, 60)) WHEN n % 7 = 5 THEN substr(text, 1, 10) ELSE substr(text, 1, 60) END AS q FROM rows),
b AS (SELECT batch_id, c, c % 13 <> 9 AND c % 17 <> 6 AND c % 23 <> 8 AND sum(times) <= 4 AND max(k) <= 3 AS valid FROM rec GROUP BY 1, 2),
asked AS (SELECT DISTINCT batch_id, g, d FROM rows),
first AS (SELECT * FROM rec JOIN b USING (batch_id, c) WHERE valid AND rd = d QUALIFY row_number() OVER (PARTITION BY batch_id, g, d ORDER BY n) = 1),
cl AS (SELECT *, unnest(range(k)) AS position, CASE WHEN length(q) NOT BETWEEN 20 AND 500 OR n % 8 = 6 THEN 'invalid_claim' WHEN strpos(text, q) = 0 THEN 'non_verbatim' END AS code0,
 'claim-' || substr(sha256(g || '|' || d || '|pilot|support|' || q), 1, 20) AS claim_id FROM first),
cr AS (SELECT *, CASE WHEN code0 IS NULL AND position > 0 THEN 'duplicate_claim' ELSE code0 END AS code FROM cl)
"""

ORACLES = {
    "checked_claims": """WITH hot AS (SELECT doc_id AS hid, text AS htext FROM documents ORDER BY length(text) DESC, doc_id DESC LIMIT 1),
own AS (SELECT doc_id * 4 + j AS n, 'cand-' || (doc_id % 6) AS candidate_id, 'doc-' || (doc_id + CASE WHEN (doc_id * 4 + j) % 23 = 0 THEN 1000000 ELSE 0 END) AS document_id,
 substr(text, (doc_id * 31 + j * 97) % 400 + 1, j * 13 + 20) || CASE WHEN (doc_id * 4 + j) % 9 = 0 THEN '¤' ELSE '' END AS quote, text,
 (doc_id * 4 + j) % 23 <> 0 AS there FROM documents, range(4) r(j)),
ord AS (SELECT -o_orderkey - 1 AS n, 'cand-' || (hid % 6) AS candidate_id, 'doc-' || hid AS document_id, substr(htext, o_orderkey % 5000 + 1, o_custkey % 50 + 21) AS quote, htext AS text, true AS there FROM orders, hot),
c AS (SELECT *, 'claim-' || CASE WHEN n % 41 = 0 THEN 0 ELSE n END AS claim_id FROM (SELECT * FROM own UNION ALL SELECT * FROM ord)),
x AS (SELECT *, CASE WHEN candidate_id = 'cand-5' THEN 'unknown_candidate' WHEN coalesce(quote, '') = '' OR count(*) OVER (PARTITION BY claim_id) > 1 THEN 'invalid_identity' WHEN NOT there THEN 'unknown_document'
 WHEN strpos(text, quote) = 0 THEN 'not_verbatim' WHEN n % 13 = 0 THEN 'invalid_scope' WHEN n % 17 = 0 THEN 'invalid_direction' WHEN n % 19 = 0 THEN 'invalid_kind' WHEN n % 29 = 0 THEN 'no_explanation' END AS violation FROM c)
SELECT claim_id, candidate_id, document_id, violation, CASE WHEN violation IS NULL THEN 'excerpt[' || (strpos(text, quote) - 1) || ':' || (strpos(text, quote) - 1 + length(quote)) || ']' END AS locator FROM x""",
    "discovery_claims": _DISCOVERY + """SELECT batch_id, g AS alias_group_id, d AS document_id, claim_id, 'origin-' || c AS origin_id, 'https://c.example/' || c AS canonical_url, 'pilot' AS kind, 'support' AS direction, q AS quote,
 'excerpt[' || (strpos(text, q) - 1) || ':' || (strpos(text, q) - 1 + length(q)) || ']' AS locator FROM cr WHERE code IS NULL""",
    "discovery_coverage": _DISCOVERY + "SELECT batch_id, g AS alias_group_id, d AS document_id, CASE WHEN (batch_id, g, d) IN (SELECT (batch_id, g, d) FROM first) THEN 'processed' ELSE 'model_failed' END AS status FROM asked",
    "discovery_issues": _DISCOVERY + """SELECT batch_id, g AS alias_group_id, d AS document_id, code FROM cr WHERE code IS NOT NULL
UNION ALL SELECT batch_id, NULL, NULL, 'invalid_response' FROM b WHERE NOT valid
UNION ALL SELECT batch_id, g, d, 'missing_document' FROM asked JOIN b USING (batch_id) WHERE valid AND (batch_id, g, d) NOT IN (SELECT (batch_id, g, d) FROM first)
UNION ALL SELECT batch_id, g, 'lost', 'unknown_document' FROM rec JOIN b USING (batch_id, c), range(times) WHERE valid AND rd = 'lost'
UNION ALL SELECT batch_id, g, d, 'duplicate_document' FROM rec JOIN b USING (batch_id, c) WHERE valid AND rd = d AND times = 2""",
    "retry_rows": """WITH p AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 4 = 0 THEN 'failed' ELSE 'complete' END AS ps, c_acctbal > 3000 AS retried, CASE WHEN c_custkey % 3 = 0 THEN 'failed' ELSE 'complete' END AS rs,
 c_custkey IN (SELECT o_custkey FROM orders) AS h FROM customer), u AS (SELECT *, retried AND rs = 'complete' AND (h OR ps = 'failed') AS u FROM p)
SELECT 'cust-' || k AS candidate_id, CASE WHEN u THEN rs ELSE ps END AS status, CASE WHEN u THEN k + 1000 ELSE k END AS rows, CASE WHEN u THEN 'retry' ELSE 'primary' END AS run FROM u""",
}
