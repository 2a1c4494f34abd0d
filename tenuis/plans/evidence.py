"""Untrusted answers about conversations, gate answers about parts, passages of linked documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenuis.functions import text as tx
from tenuis.operators import evidence as ev
from tenuis.operators import relevance as rel
from tenuis.operators import selection as sel
from tenuis.plans import relevance as pr
from tenuis.plans import tables as t
from tenuis.session import stored


def tasks(spark: SparkSession, sf: str) -> DataFrame:
    w = tx.words(tx.identity_key(F.col("text")))
    return t.table(spark, sf, "conversations").select(
        F.concat(F.lit("task-"), "conv_id").alias("task_id"), F.concat(F.lit("cand-"), "conv_id").alias("candidate_id"),
        F.concat_ws("-", F.lit("turn"), "conv_id", "turn").alias("document_id"), F.col("text").alias("passage"),
        F.lit(0).alias("passage_start"), F.array_join(F.slice(w, 3, 3), " ").alias("matched_term"),
        F.when(F.col("conv_id") % 3 == 0, "maturity").otherwise("general").alias("purpose"), "conv_id", "turn",
    )


def answers(spark: SparkSession, sf: str) -> DataFrame:
    """One answer per conversation; some quotes, ids and payloads are spoilt by number."""
    c, n = F.col("conv_id"), F.col("turn")
    quote = F.substring("passage", 1, 80)
    claim = F.struct(
        F.when(n % 5 == 1, F.upper(quote)).otherwise(quote).alias("quote"),
        F.when(c % 3 == 0, t.pick(["adoption", "market", "standard"], n % 3)).otherwise(t.pick(ev.CLAIM_KINDS, n % 11)).alias("kind"),
        F.when((c % 3 == 0) | (n % 2 == 1), "counter").otherwise("support").alias("direction"),
        F.when(c % 2 == 0, "full_candidate").otherwise("core_only").alias("scope"),
        F.when(n % 7 == 3, "мало").otherwise("Цитата подтверждает факт").alias("explanation_ru"),
        F.when(n % 6 == 2, F.split_part("matched_term", F.lit(" "), F.lit(1))).otherwise("").alias("missing_components"),
    )
    document = F.struct(
        F.when((c % 13 == 4) & (n == 1), "lost").otherwise(F.col("document_id")).alias("document_id"),
        F.when(n % 4 == 2, F.array(claim, claim)).otherwise(F.array(claim)).alias("claims"),
    )
    packed = tasks(spark, sf).groupBy("task_id", "candidate_id", "conv_id").agg(F.collect_list(document).alias("documents"))
    name = F.when(c % 11 == 5, "cand-other").otherwise(F.col("candidate_id")).alias("candidate_id")
    whole = F.to_json(F.struct(name, "documents"))
    return packed.select("task_id", F.when(c % 17 == 6, F.substring(whole, 2, 40)).otherwise(whole).alias("payload"))


def evidence_claims(spark: SparkSession, sf: str) -> DataFrame:
    asked = tasks(spark, sf)
    records, _ = ev.answer_records(asked, answers(spark, sf), most_claims=4)
    return ev.validate_claims(asked, records).select(
        "task_id", "document_id", "position", "kind", "issue", "final_scope", F.concat_ws(";", "final_missing").alias("missing"),
        "locator_start", "locator_end", "claim_id",
    )


def evidence_failures(spark: SparkSession, sf: str) -> DataFrame:
    return ev.answer_records(tasks(spark, sf), answers(spark, sf), most_claims=4)[1]


def evidence_document_results(spark: SparkSession, sf: str) -> DataFrame:
    asked = tasks(spark, sf)
    records, _ = ev.answer_records(asked, answers(spark, sf), most_claims=4)
    return ev.document_results(records, ev.validate_claims(asked, records))


def gate_input(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    p = F.col("p_partkey")
    parts = t.table(spark, sf, "part")
    asked = parts.select(
        F.concat(F.lit("batch-"), F.floor(p / 10)).alias("batch_id"), F.concat(F.lit("part-"), p).alias("proposal_id"),
        F.array(F.concat(F.lit("doc-"), p), F.concat(F.lit("doc-"), p + 1)).alias("context"),
    )
    decision = t.pick(["accept", "reject", "review"], p % 3)
    reason = F.when(p % 5 == 0, "because").otherwise(t.pick(["technical_mechanism", "generic_area", "insufficient_context"], p % 3))
    basis = F.when(p % 13 == 0, F.array(F.lit("doc-x"))).otherwise(F.array(F.concat(F.lit("doc-"), p)))
    item = F.struct(
        F.when(p % 7 == 0, "part-unknown").otherwise(F.concat(F.lit("part-"), p)).alias("proposal_id"), decision.alias("decision"),
        reason.alias("reason"), basis.alias("basis_document_ids"), F.lit("fact").alias("explanation"),
    )
    items = F.when(p % 11 == 0, F.array(item, item)).otherwise(F.array(item))
    packed = parts.groupBy(F.floor(p / 10).alias("b")).agg(F.flatten(F.collect_list(items)).alias("decisions"))
    whole = F.to_json(F.struct("decisions"))
    answers_ = packed.select(F.concat(F.lit("batch-"), "b").alias("batch_id"), F.when(F.col("b") % 9 == 4, "oops").otherwise(whole).alias("payload"))
    return asked, answers_


def gate_decisions(spark: SparkSession, sf: str) -> DataFrame:
    return ev.gate_decisions(*gate_input(spark, sf))[0]


def gate_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Every part has an audit answer: review for sizes over 40, else accept."""
    first = gate_decisions(spark, sf)
    large = F.col("p_size") > 40
    audit = t.table(spark, sf, "part").select(
        F.concat(F.lit("part-"), "p_partkey").alias("proposal_id"), F.when(large, "review").otherwise("accept").alias("decision"),
        F.when(large, "insufficient_context").otherwise("technical_application").alias("reason"),
    )
    return ev.audited(first, audit).groupBy("decision", "reason").agg(F.count(F.lit(1)).alias("proposals"))


def gate_attempts(spark: SparkSession, sf: str) -> DataFrame:
    rows = gate_decisions(spark, sf)
    second = rows.withColumn("issue", F.when(F.col("issue") != "invalid_decision", F.col("issue")))
    return ev.best_attempt(rows.withColumn("attempt", F.lit(1)).unionByName(second.withColumn("attempt", F.lit(2))))


def mention_answers(spark: SparkSession, sf: str) -> DataFrame:
    docs = t.documents(spark, sf).select("doc_id", "document_id", "title", "excerpt", "connector")
    n = F.col("doc_id")
    text = F.substring("title", 2, 30)
    item = F.struct(
        F.when(n % 7 == 0, F.concat(text, F.lit("¤"))).when(n % 11 == 0, " ").otherwise(text).alias("text"),
        F.when(n % 5 == 0, "excerpt").when(n % 13 == 0, "body").otherwise("title").alias("field"),
    )
    given = docs.select("document_id", F.to_json(F.struct(F.array(item).alias("mentions"))).alias("payload"))
    return ev.validate_mentions(docs, given).drop("text")


def passages(spark: SparkSession, sf: str) -> DataFrame:
    rows = pr.scored(spark, sf).where(F.col("relevance_class") != "none").select("candidate_id", "document_id", "term")
    texts = t.texts(spark, sf)
    return ev.cut_passages(ev.passages(rows, texts), texts).withColumn("passage", F.sha2("passage", 256))


def groundings(spark: SparkSession, sf: str) -> DataFrame:
    docs, cands = t.documents(spark, sf), t.candidates(spark, sf)
    rows = ev.groundings(t.links(spark, sf, docs, cands), docs, rel.term_rows(cands))
    return rows.select("candidate_id", "document_id", "term_pos", "location", tx.identity_key(F.col("quote")).alias("quote"))


def term_support(spark: SparkSession, sf: str) -> DataFrame:
    docs, cands = t.documents(spark, sf), t.candidates(spark, sf)
    rows = t.links(spark, sf, docs, cands).join(rel.term_rows(cands).select("candidate_id", "term_pos", "term_key"), "candidate_id").join(
        docs.select("document_id", "excerpt_key"), "document_id"
    )
    return rows.select("candidate_id", "document_id", "term_pos", ev.supports_term(F.col("excerpt_key"), F.col("term_key")).alias("supported"))


def cued_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Whole texts followed by a sentence that names the start of the text with a maturity cue."""
    n = F.col("doc_id")
    cue = t.pick(["is widely used in production.", "is a promising future challenge of adoption.", "has no use."], n % 3)
    head = F.array_join(F.slice(tx.words(F.col("excerpt_key")), 1, 4), " ")
    docs = t.documents(spark, sf)
    return docs.select("document_id", head.alias("term"), F.concat_ws(" ", F.concat("excerpt", F.lit(".")), F.concat_ws(" ", head, cue)).alias("excerpt"))


def maturity_passages(spark: SparkSession, sf: str) -> DataFrame:
    docs = stored(cued_documents(spark, sf), "documents")
    links = docs.select(F.lit("cand-0").alias("candidate_id"), "document_id", "term").where(F.col("term") != "")
    return ev.maturity_passages(links, docs.select("document_id", "excerpt"))


def evidence_tasks(spark: SparkSession, sf: str) -> DataFrame:
    rows = pr.kept(spark, sf).where(F.col("relevance_class") != "none").withColumn(
        "source_class", F.when(F.col("connector") == "openalex", "scientific").otherwise("industry")
    )
    chosen = stored(sel.evidence_documents(rows).select("candidate_id", "document_id", "term"), "chosen")
    spans = ev.passages(chosen.select("candidate_id", "document_id", "term"), t.texts(spark, sf))
    return ev.evidence_tasks(chosen.select("candidate_id", "document_id"), spans)


def promotion_status(spark: SparkSession, sf: str) -> DataFrame:
    cands = t.candidates(spark, sf)
    decisions = cands.select("candidate_id", t.pick(["accept", "accept", "reject", "review"], F.col("item_id") % 4).alias("decision"))
    return ev.promotion_status(cands, groundings(spark, sf), decisions)


def retry_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Primary and retry runs of every customer (not run for low balances); its orders are claims of the retry."""
    k = F.col("c_custkey")
    name = F.concat(F.lit("cust-"), k).alias("candidate_id")
    customers = t.table(spark, sf, "customer")
    primary = customers.select(name, F.when(k % 4 == 0, "failed").otherwise("complete").alias("status"))
    retry = customers.select(name, F.when(F.col("c_acctbal") <= 3000, "not_run").when(k % 3 == 0, "failed").otherwise("complete").alias("status"))
    claims = t.table(spark, sf, "orders").select(F.concat(F.lit("cust-"), "o_custkey").alias("candidate_id"))
    return ev.retry_source(primary, retry, claims)


QUERIES = {
    name: globals()[name]
    for name in (
        "evidence_claims", "evidence_failures", "evidence_document_results", "gate_decisions", "gate_audit", "gate_attempts",
        "mention_answers", "passages", "groundings", "term_support", "retry_merge",
        "maturity_passages", "evidence_tasks", "promotion_status",
    )
}

_GATE = """WITH a AS (SELECT p_partkey AS p, p_size, CAST(floor(p_partkey / 10) AS BIGINT) AS b FROM part),
g AS (SELECT 'batch-' || b AS batch_id, 'part-' || p AS proposal_id, p_size,
 CASE WHEN b % 9 = 4 THEN 'invalid_response' WHEN p % 7 = 0 THEN 'missing_proposal' WHEN p % 11 = 0 THEN 'duplicate_proposal' WHEN p % 5 = 0 OR p % 13 = 0 THEN 'invalid_decision' END AS issue,
 (['accept','reject','review'])[p % 3 + 1] AS d, (['technical_mechanism','generic_area','insufficient_context'])[p % 3 + 1] AS r FROM a),
gd AS (SELECT batch_id, proposal_id, p_size, CASE WHEN issue IS NULL THEN d ELSE 'review' END AS decision, CASE WHEN issue IS NULL THEN r ELSE 'insufficient_context' END AS reason, issue FROM g)
"""
_FAIL = """WITH tk AS (SELECT conv_id, count(*) AS n, bool_or(turn = 1) AS has1 FROM conversations GROUP BY 1)
"""

ORACLES = {
    "evidence_failures": _FAIL + """SELECT 'task-' || conv_id AS task_id, CASE WHEN conv_id % 17 = 6 THEN 'invalid_json' WHEN conv_id % 11 = 5 THEN 'candidate_differs' ELSE 'documents_differ' END AS failure
 FROM tk WHERE conv_id % 17 = 6 OR conv_id % 11 = 5 OR (conv_id % 13 = 4 AND has1)""",
    "gate_decisions": _GATE + "SELECT batch_id, proposal_id, decision, reason, issue FROM gd",
    "gate_audit": _GATE + "SELECT decision, reason, count(*) AS proposals FROM (SELECT CASE WHEN decision = 'accept' AND p_size > 40 THEN 'review' ELSE decision END AS decision, CASE WHEN decision = 'accept' THEN CASE WHEN p_size > 40 THEN 'insufficient_context' ELSE 'technical_application' END ELSE reason END AS reason FROM gd) GROUP BY ALL",
    "gate_attempts": _GATE + """SELECT batch_id, CASE WHEN count(*) FILTER (issue = 'invalid_decision') > 0 THEN 2 ELSE 1 END AS attempt,
 count(*) FILTER (issue IS NOT NULL AND issue <> 'invalid_decision') AS issues FROM gd GROUP BY 1""",
    "mention_answers": f"""WITH {t.DOCS_SQL.strip()},
m AS (SELECT *, CASE WHEN doc_id % 7 = 0 THEN substr(title, 2, 30) || '¤' WHEN doc_id % 11 = 0 THEN ' ' ELSE substr(title, 2, 30) END AS mt,
 CASE WHEN doc_id % 5 = 0 THEN 'excerpt' WHEN doc_id % 13 = 0 THEN 'body' ELSE 'title' END AS field FROM docs),
x AS (SELECT *, CASE WHEN trim(mt) = '' OR field = 'body' THEN 'invalid_mention' WHEN strpos(CASE WHEN field = 'title' THEN title ELSE excerpt END, mt) = 0 THEN 'non_verbatim' END AS issue,
 strpos(CASE WHEN field = 'title' THEN title ELSE excerpt END, mt) - 1 AS p0 FROM m)
SELECT document_id, 0 AS position, issue, CASE WHEN issue IS NULL THEN CASE WHEN field = 'excerpt' THEN 'excerpt' WHEN connector = 'mediacloud' THEN 'headline' ELSE 'title' END END AS kind,
 CASE WHEN issue IS NULL THEN field || '[' || p0 || ':' || (p0 + length(mt)) || ']' END AS locator FROM x""",
    "groundings": t.BASE_SQL + """ SELECT candidate_id, document_id, term_pos, location, term AS quote FROM links JOIN terms USING (candidate_id)
JOIN (SELECT document_id, unnest(['title', 'excerpt']) AS location, unnest([title_key, excerpt_key]) AS k FROM docs WHERE published_at IS NOT NULL) USING (document_id)
WHERE contains(' ' || k || ' ', ' ' || term || ' ')""",
    "term_support": t.BASE_SQL + """, w AS (SELECT candidate_id, document_id, term_pos, string_split(term, ' ') AS tw, ' ' || excerpt_key || ' ' AS k FROM links JOIN terms USING (candidate_id) JOIN docs USING (document_id))
SELECT candidate_id, document_id, term_pos, len(list_filter(list_distinct(tw), lambda x: contains(k, ' ' || x || ' '))) >= least(3, len(list_distinct(tw)))
 AND len(list_filter(list_transform(range(1, len(tw)), lambda i: tw[i] || ' ' || tw[i+1]), lambda x: contains(k, ' ' || x || ' '))) > 0 AS supported FROM w""",
    "promotion_status": t.BASE_SQL + """, gr AS (SELECT candidate_id, bool_or(term_pos = 0) AS n FROM links JOIN terms USING (candidate_id)
JOIN (SELECT document_id, unnest([title_key, excerpt_key]) AS k FROM docs WHERE published_at IS NOT NULL) USING (document_id) WHERE contains(' ' || k || ' ', ' ' || term || ' ') GROUP BY 1)
SELECT candidate_id, CASE WHEN n IS NULL THEN 'not_grounded' WHEN item_id % 4 < 2 THEN CASE WHEN n THEN 'evidence_review_required' ELSE 'alias_review_required' END
 WHEN item_id % 4 = 2 THEN 'gate_rejected' ELSE 'gate_review' END AS promotion_status FROM cands LEFT JOIN gr USING (candidate_id)""",
    "retry_merge": """WITH p AS (SELECT 'cust-' || c_custkey AS candidate_id, CASE WHEN c_custkey % 4 = 0 THEN 'failed' ELSE 'complete' END AS ps,
 CASE WHEN c_acctbal > 3000 THEN CASE WHEN c_custkey % 3 = 0 THEN 'failed' ELSE 'complete' END END AS rs, c_custkey IN (SELECT o_custkey FROM orders) AS h FROM customer),
u AS (SELECT *, coalesce(rs = 'complete', false) AND (h OR ps = 'failed') AS u FROM p)
SELECT candidate_id, CASE WHEN u THEN 'retry' ELSE 'primary' END AS run, u AND NOT h AS recovered FROM u""",
}
