"""Queue, noise, review history, rubric and readiness on the benchmark tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tenuis.functions import text as tx
from tenuis.operators import entities as ent
from tenuis.operators import labeling as lab
from tenuis.operators.evidence import CUE_GROUPS
from tenuis.operators.ranking import trust_rank
from tenuis.plans import entities as pe
from tenuis.plans import relevance as pr
from tenuis.plans import results as res
from tenuis.plans import tables as t

RECENT, CUTOFF = t.ITEM_WINDOWS.recent, t.ITEM_WINDOWS.cutoff


def region_of(spark: SparkSession, sf: str) -> DataFrame:
    return t.table(spark, sf, "region").select(F.col("r_regionkey").alias("_r"), F.col("r_name").alias("domain"))


def groups(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as alias groups; their sources are the orders that hold them."""
    items = t.table(spark, sf, "lineitem").join(
        t.table(spark, sf, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")
    )
    sources = items.groupBy("l_partkey").agg(
        F.countDistinct("o_custkey").alias("origins"), F.countDistinct("l_orderkey").alias("documents"),
        F.bool_or(F.col("l_returnflag") == "A").alias("has_scientific"), F.bool_or(F.col("l_returnflag") == "N").alias("has_media"),
    )
    p = F.col("p_partkey")
    name = F.concat_ws(" ", F.when(p % 3 == 0, F.concat("p_name", F.lit("s"))).when(p % 3 == 1, F.upper("p_name")).otherwise(F.col("p_name")), F.col("p_type"))
    rows = t.table(spark, sf, "part").withColumn("_r", (p % 5).cast("int")).join(region_of(spark, sf), "_r")
    return rows.join(sources, p == F.col("l_partkey"), "left").na.fill(0).na.fill(False).select(
        F.concat(F.lit("part-"), p).alias("group_id"), F.concat(F.lit("run-"), F.col("p_size") % 4).alias("run_id"), "domain",
        F.lower(F.concat_ws(" ", "p_name", "p_brand")).alias("key"), name.alias("canonical_name"), "origins", "documents", "has_scientific", "has_media",
    )


def slots(spark: SparkSession, sf: str) -> DataFrame:
    """One slot per customer; two regions share a domain, so some domains have slots to spare and others none."""
    nations = t.table(spark, sf, "nation").select("n_nationkey", F.floor(F.col("n_regionkey") / 2).cast("int").alias("_r"))
    rows = t.table(spark, sf, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.join(region_of(spark, sf), "_r").select(F.concat(F.lit("slot-"), "c_custkey").alias("slot_id"), "domain")


def queue_groups(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return lab.spelling_duplicates(lab.merge_runs(groups(spark, sf)))


def merged_groups(spark: SparkSession, sf: str) -> DataFrame:
    return lab.merge_runs(groups(spark, sf)).select("group_id", "run_id", "domain", "key")


def queue_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return queue_groups(spark, sf)[1]


def queue_filled(spark: SparkSession, sf: str) -> DataFrame:
    return lab.fill_slots(queue_groups(spark, sf)[0], slots(spark, sf))[0].select("slot_id", "domain", "position", "group_id", "stratum")


def queue_overflow(spark: SparkSession, sf: str) -> DataFrame:
    return lab.fill_slots(queue_groups(spark, sf)[0], slots(spark, sf))[1].select("group_id", "domain", "position")


def queue_deficits(spark: SparkSession, sf: str) -> DataFrame:
    return lab.fill_slots(queue_groups(spark, sf)[0], slots(spark, sf))[2]


def queue_selection(spark: SparkSession, sf: str) -> DataFrame:
    """Every slot selects the part of its number folded to half of the parts."""
    rows = slots(spark, sf)
    total = t.row_count(t.table(spark, sf, "part"))
    number = F.substring("slot_id", 6, 12).cast("bigint")
    chosen = rows.select("slot_id", "domain", F.concat(F.lit("part-"), number * 3 % (total + 50)).alias("group_id"))
    return lab.fill_selected(groups(spark, sf), chosen)


def noise_items(spark: SparkSession, sf: str) -> DataFrame:
    u = F.col("user_id")
    return t.table(spark, sf, "events").select(
        F.col("event_type").alias("noise_type"), F.col("event_id").alias("pos"), F.when(u % 17 == 0, " ").otherwise(F.concat("props", F.lit(" "), F.floor("value"))).alias("text"),
        F.when(u % 10 != 0, F.concat(F.lit("https://e.example/"), "event_id")).alias("url"), F.concat(F.lit("domain-"), u % 4).alias("domain"),
    )


def noise_slots(spark: SparkSession, sf: str) -> DataFrame:
    kinds = ["view", "signup", "click", "purchase", "error"]
    return t.table(spark, sf, "supplier").select(F.concat(F.lit("noise-"), F.lpad(F.col("s_suppkey").cast("string"), 9, "0")).alias("slot_id"), t.pick(kinds, F.col("s_suppkey") % 5).alias("noise_type"))


def noise_filled(spark: SparkSession, sf: str) -> DataFrame:
    return lab.fill_noise(lab.noise_pool(noise_items(spark, sf))[0], noise_slots(spark, sf))[0].select("slot_id", "noise_type", "domain", "pos")


def noise_dropped(spark: SparkSession, sf: str) -> DataFrame:
    return lab.noise_pool(noise_items(spark, sf))[1].groupBy("noise_type", "reason").agg(F.count(F.lit(1)).alias("items"))


def noise_urls(spark: SparkSession, sf: str) -> DataFrame:
    items = t.table(spark, sf, "orders").join(t.table(spark, sf, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.concat(F.lit("noise-"), "o_custkey").alias("noise_id"), F.col("l_partkey").alias("pos"), F.col("l_partkey").alias("document_id")
    )
    docs = t.table(spark, sf, "part").select(F.col("p_partkey").alias("document_id"), F.when(F.col("p_size") > 45, F.concat(F.lit("https://p.example/"), "p_partkey")).otherwise("").alias("url"))
    return lab.first_url(items, docs)


def noise_controls(spark: SparkSession, sf: str) -> DataFrame:
    """Every part is a control and a proposal. Controls of larger sizes name a part by name and brand as the proposals do,
    those of smaller ones add the type, so some match no proposal, some one and some several."""
    label = F.concat_ws(" ", "p_name", "p_brand", F.when(F.col("p_size") < 5, F.col("p_type")))
    parts = t.table(spark, sf, "part")
    controls = parts.select(F.concat(F.lit("noise-"), "p_partkey").alias("noise_id"), F.upper(label).alias("text"))
    names = parts.select(F.concat_ws(" ", "p_name", "p_brand").alias("name"), F.concat(F.lit("part-"), "p_partkey").alias("proposal_id"))
    return lab.control_matches(controls, names)


def noise_report(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("p_partkey")
    rows = t.table(spark, sf, "part").select(
        (F.col("p_size") > 10).alias("gate_expected"), F.when(p % 7 != 0, t.pick(["reject", "review", "accept", "reject"], p % 4)).alias("gate_decision"), (p % 9 != 0).alias("contained")
    )
    return lab.noise_report(rows)


def evidence_queue(spark: SparkSession, sf: str) -> DataFrame:
    entries = res.claims(spark, sf).select(F.substring("candidate_id", 6, 12).cast("bigint").alias("candidate_order"), "candidate_id", F.col("claim_id").alias("pos"), "direction")
    return lab.evidence_queue(entries).select("evidence_number", "candidate_id", "pos", "direction")


def evidence_budget(spark: SparkSession, sf: str) -> DataFrame:
    rows = pr.ranked(spark, sf)
    generated = F.col("trust_tier") == "D"
    issue = lab.source_issue(generated, F.col("connector"), F.when(F.col("excerpt_length") > 500, "article_text"), F.col("excerpt_length"))
    docs = rows.select(F.col("candidate_id").alias("group_id"), "document_id", "origin_id", "connector", "excerpt_length", trust_rank(F.col("trust_tier")).alias("trust_rank"), issue.alias("source_issue"))
    return lab.evidence_budget(docs)


def maturity_queue(spark: SparkSession, sf: str) -> DataFrame:
    """Texts of a fifth, third and half of the document numbers end in maturity words."""
    n = F.col("doc_id")
    tail = F.concat_ws(" ", F.when(n % 2 == 0, "widely used"), F.when(n % 3 == 0, "market vendors"), F.when(n % 5 == 0, "in production use, standardized"))
    docs = t.documents(spark, sf).select("document_id", "title", F.concat_ws(" ", "excerpt", tail).alias("excerpt"))
    return lab.maturity_queue(pr.ranked(spark, sf), docs).select("candidate_id", "document_id", "maturity_score", "selection_rank", F.concat_ws(",", "cues").alias("cues"))


def publicity_input(spark: SparkSession, sf: str) -> DataFrame:
    rows = pr.kept(spark, sf).where(F.col("score") >= 30)
    place = F.row_number().over(W.partitionBy("candidate_id").orderBy(F.col("score").desc(), F.col("document_id")))
    media = rows.where(F.col("connector") == "mediacloud").withColumn("media_rank", place)
    science = rows.where(F.col("connector") == "openalex").withColumn("science_rank", place).where(F.col("science_rank") <= 6)
    gate = t.candidates(spark, sf).select("candidate_id", F.when(F.col("item_id") % 3 != 0, "evidence_review_required").otherwise("gate_review").alias("promotion_status"))
    return lab.publicity_input(media.where(F.col("media_rank") <= 6), science, gate).select("candidate_id", "document_id", "final_rank")


def broken_ranks(spark: SparkSession, sf: str) -> DataFrame:
    rows = t.table(spark, sf, "lineitem").select(F.concat(F.lit("order-"), "l_orderkey").alias("candidate_id"), "l_linenumber")
    return lab.broken_ranks(rows, "l_linenumber")


def rubric_audit(spark: SparkSession, sf: str) -> DataFrame:
    claims = res.claims(spark, sf)
    cands = t.table(spark, sf, "part").select(F.concat(F.lit("part-"), "p_partkey").alias("candidate_id"), (F.col("p_size") % 10 != 3).alias("search_coverage_complete"))
    media = claims.select("candidate_id", F.lit("mediacloud").alias("connector"), F.when(F.col("scope") == "core_only", "weak").otherwise("none").alias("relevance_class"), "published_at", "origin_id")
    return lab.rubric_audit(cands, claims, media, RECENT, CUTOFF)


def contract_input(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    parts = t.table(spark, sf, "part")
    cands = parts.select(F.concat(F.lit("part-"), "p_partkey").alias("candidate_id"), F.col("p_name").alias("canonical_name"), F.array("p_name", "p_brand").alias("names"), "p_size")
    items = t.table(spark, sf, "lineitem").join(parts.select("p_partkey", "p_name", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    rows = items.select(
        F.concat(F.lit("part-"), "l_partkey").alias("candidate_id"), F.when(F.col("l_suppkey") % 29 == 0, "other").otherwise(F.col("p_name")).alias("canonical_name"),
        F.when(F.col("l_linenumber") < 6, F.concat(F.lit("about "), F.upper("p_name"))).alias("quote"), F.when(F.col("l_linenumber") > 3, F.concat("p_brand", F.lit(" news"))).alias("headline"),
        F.when(F.col("l_discount") < 0.03, "title_only").otherwise("article_text").alias("content_status"), F.concat(F.lit("o"), F.col("l_orderkey") % 3).alias("origin_id"),
        F.concat(F.lit("p"), F.col("l_suppkey") % 4).alias("publisher"), F.col("l_shipdate").cast("date").alias("published_at"),
        F.when(F.col("l_suppkey") % 31 == 0, "ftp://x").otherwise("https://x.example/a").alias("url"),
    )
    return cands, rows


def evidence_contract(spark: SparkSession, sf: str) -> DataFrame:
    cands, rows = contract_input(spark, sf)
    return lab.evidence_contract(cands, rows, dt.date(1996, 1, 1), CUTOFF)


def label_readiness(spark: SparkSession, sf: str) -> DataFrame:
    cands, _ = contract_input(spark, sf)
    size = F.col("p_size")
    rows = cands.select("candidate_id", F.when(size % 4 != 0, "accepted").otherwise("proposed").alias("decision_status"), F.when(size % 2 == 0, "mature").otherwise("hype").alias("proposed_label"), F.concat(F.lit("domain-"), size % 5).alias("domain"))
    return lab.label_readiness(rows, evidence_contract(spark, sf))


def readiness_by_domain(spark: SparkSession, sf: str) -> DataFrame:
    ready = label_readiness(spark, sf)
    quotas = ready.select("domain", "proposed_label").distinct().withColumn("quota", F.lit(50))
    return lab.readiness_by_domain(ready, quotas)


def review_rows(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("l_linenumber")
    return t.table(spark, sf, "lineitem").select(
        F.concat(F.lit("order-"), "l_orderkey").alias("subject_id"),
        F.when(n.isin(2, 5), "secondary").when(n == 3, "adjudication").otherwise("primary").alias("review_round"),
        F.when(F.col("l_quantity") < 48, "reviewed").otherwise("draft").alias("status"), F.col("l_returnflag").alias("label"),
        F.concat(F.lit("reviewer-"), F.col("l_suppkey") % 10).alias("reviewer_id"),
    )


def final_decisions(spark: SparkSession, sf: str) -> DataFrame:
    return lab.final_decisions(review_rows(spark, sf))


def second_review_quota(spark: SparkSession, sf: str) -> DataFrame:
    return lab.second_review_quota(final_decisions(spark, sf))


def rubric_violations(spark: SparkSession, sf: str) -> DataFrame:
    kinds = ["publicity_wave", "publicity_wave", "technical_validation", "publicity_wave", "pilot", "standard_adoption", "publicity_wave", "publicity_wave"]
    rows = t.table(spark, sf, "lineitem").select(
        F.concat(F.lit("order-"), "l_orderkey").alias("decision_id"), t.pick(kinds, F.col("l_quantity").cast("int") % 8).alias("kind"),
        F.when(F.col("l_linestatus") == "F", "support").otherwise("counter").alias("direction"), t.pick(["A", "B", "C", "D", "unknown"], F.col("l_suppkey") % 5).alias("trust_level"),
        F.concat(F.lit("o"), F.col("l_suppkey") % 6).alias("origin_id"), F.col("l_shipdate").cast("date").alias("published_at"),
    )
    p = F.col("o_orderkey")
    decisions = t.table(spark, sf, "orders").select(
        F.concat(F.lit("order-"), p).alias("decision_id"), F.when(p % 2 == 0, "mature").otherwise("marketing_hype").alias("label"),
        (p % 5 != 0).alias("searched_scientific"), (p % 7 != 0).alias("searched_industry"),
    )
    return lab.rubric_violations(decisions, rows, dt.date(1995, 1, 1), dt.date(2001, 6, 30))


def search_notes(spark: SparkSession, sf: str) -> DataFrame:
    rows = t.table(spark, sf, "lineitem").select(
        F.concat(F.lit("run-"), "l_suppkey").alias("run_id"), F.when(F.col("l_returnflag") == "A", "scientific").otherwise("industry").alias("source_class"),
        F.when(F.col("l_quantity") < 5, "failed").when(F.col("l_linestatus") == "F", "complete").otherwise("partial").alias("status"),
        F.when(F.col("l_linenumber") < 7, F.lit(0)).otherwise(1).alias("requests"), F.when(F.col("l_linenumber") == 7, t.pick(["budget", "", "pages"], F.col("l_suppkey") % 3)).alias("stop_reason"),
    )
    return lab.search_notes(rows)


def fallback_documents(spark: SparkSession, sf: str) -> DataFrame:
    orders = t.table(spark, sf, "orders")
    run = F.concat(F.lit("run-"), F.col("o_custkey") % 50)
    docs = orders.select(run.alias("run_id"), F.when(F.col("o_orderstatus") == "F", "primary").otherwise("fallback").alias("provider"), F.concat(F.lit("cust-"), "o_custkey").alias("origin_id"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("request_pos"), F.col("o_orderkey").alias("record_index"))
    log = orders.select(run.alias("run_id"), F.lit("primary").alias("provider"), (F.col("o_custkey") % 50 % 3 == 0).alias("success")).distinct()
    return lab.with_fallback(docs, log)


def run_domains(spark: SparkSession, sf: str) -> DataFrame:
    runs = t.table(spark, sf, "nation").select("n_name", F.col("n_name").alias("run_id"), F.col("n_regionkey").alias("_r"), "n_nationkey").join(region_of(spark, sf), "_r")
    stored = runs.select("run_id", F.when(F.col("n_nationkey") % 2 == 0, F.col("domain")).otherwise("free text").alias("domain"))
    overrides = runs.where(F.col("_r") != 2).select("run_id", F.col("domain").alias("override"))
    return lab.run_domains(stored, overrides, ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"])


def gate_context(spark: SparkSession, sf: str) -> DataFrame:
    """Best documents of a candidate by query words: phrases and words of its own search terms."""
    docs, cands = t.documents(spark, sf), t.candidates(spark, sf)
    rows = t.links(spark, sf, docs, cands).join(cands.select("candidate_id", "search_terms"), "candidate_id").join(
        docs.select("document_id", "connector", "title_key", "excerpt_key"), "document_id"
    )
    words = F.array_distinct(F.split(F.array_join("search_terms", " "), " "))
    both = F.concat_ws(" ", "title_key", "excerpt_key")
    scored = rows.select(
        F.col("candidate_id").alias("proposal_id"), "document_id", "connector",
        F.size(F.filter("search_terms", lambda p: (F.length(p) >= 4) & F.contains(both, p))).alias("phrase_hits"),
        F.size(F.filter(words, lambda w: (F.length(w) >= 2) & tx.has_phrase(F.col("title_key"), w))).alias("title_hits"),
        F.size(F.filter(words, lambda w: (F.length(w) >= 2) & tx.has_phrase(both, w))).alias("text_hits"),
    )
    return ent.gate_context(scored).select("proposal_id", "document_id", "position")


QUERIES = {
    name: globals()[name]
    for name in (
        "merged_groups", "queue_duplicates", "queue_filled", "queue_overflow", "queue_deficits", "queue_selection", "noise_filled", "noise_dropped",
        "noise_urls", "noise_controls", "noise_report", "evidence_queue", "evidence_budget", "maturity_queue", "publicity_input", "broken_ranks",
        "rubric_audit", "evidence_contract", "label_readiness", "readiness_by_domain", "final_decisions", "second_review_quota", "rubric_violations",
        "search_notes", "fallback_documents", "run_domains", "gate_context",
    )
}

_G = """WITH src AS (SELECT l_partkey, count(DISTINCT o_custkey) AS origins, count(DISTINCT l_orderkey) AS documents, bool_or(l_returnflag = 'A') AS hs, bool_or(l_returnflag = 'N') AS hm
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1),
g AS (SELECT 'part-' || p_partkey AS group_id, 'run-' || (p_size % 4) AS run_id, r_name AS domain, lower(p_name || ' ' || p_brand) AS key,
  CASE p_partkey % 3 WHEN 0 THEN p_name || 's' WHEN 1 THEN upper(p_name) ELSE p_name END || ' ' || p_type AS canonical_name, lower(p_name || ' ' || p_type) AS qk,
  coalesce(origins, 0) AS origins, coalesce(documents, 0) AS documents, coalesce(hs, false) AS hs, coalesce(hm, false) AS hm
  FROM part JOIN region ON r_regionkey = p_partkey % 5 LEFT JOIN src ON l_partkey = p_partkey),
mg AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY domain, key ORDER BY run_id, group_id) = 1),
qd AS (SELECT *, first_value(group_id) OVER (PARTITION BY domain, qk ORDER BY origins DESC, documents DESC, lower(canonical_name), group_id) AS primary_group_id FROM mg),
kp AS (SELECT *, CASE WHEN hs AND hm THEN 0 WHEN hm THEN 1 WHEN origins >= 2 THEN 2 ELSE 3 END AS stratum FROM qd WHERE group_id = primary_group_id),
tn AS (SELECT *, row_number() OVER (PARTITION BY domain, stratum ORDER BY origins DESC, documents DESC, lower(canonical_name), group_id) AS turn FROM kp),
pl AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY turn, stratum) AS position FROM tn),
sl AS (SELECT 'slot-' || c_custkey AS slot_id, r_name AS domain FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey // 2 = r_regionkey),
sn AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY slot_id) AS position FROM sl)
"""
_N = """WITH it AS (SELECT event_type AS noise_type, event_id AS pos, CASE WHEN user_id % 17 = 0 THEN '' ELSE trim(props || ' ' || CAST(floor(value) AS BIGINT)) END AS text,
  CASE WHEN user_id % 10 <> 0 THEN 'u' END AS url, 'domain-' || (user_id % 4) AS domain FROM events),
rs AS (SELECT *, CASE WHEN text = '' THEN 'blank_text' WHEN url IS NULL THEN 'no_url' END AS reason FROM it),
us AS (SELECT * FROM rs WHERE reason IS NULL QUALIFY row_number() OVER (PARTITION BY noise_type, lower(text) ORDER BY pos) = 1),
tn AS (SELECT *, row_number() OVER (PARTITION BY noise_type, domain ORDER BY pos) AS turn FROM us),
pl AS (SELECT *, row_number() OVER (PARTITION BY noise_type ORDER BY turn, domain) AS position FROM tn),
sn AS (SELECT 'noise-' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') AS slot_id, (['view','signup','click','purchase','error'])[s_suppkey % 5 + 1] AS noise_type, row_number() OVER (PARTITION BY s_suppkey % 5 ORDER BY s_suppkey) AS position FROM supplier)
"""
_FD = """WITH r AS (SELECT 'order-' || l_orderkey AS subject_id, CASE WHEN l_linenumber IN (2, 5) THEN 'secondary' WHEN l_linenumber = 3 THEN 'adjudication' ELSE 'primary' END AS rd,
 l_quantity < 48 AS rev, l_returnflag AS label, 'reviewer-' || (l_suppkey % 10) AS reviewer FROM lineitem),
a AS (SELECT subject_id, count(*) FILTER (rd = 'primary') AS n1, count(*) FILTER (rd = 'secondary') AS n2, count(*) FILTER (rd = 'adjudication') AS n3,
 max(label) FILTER (rd = 'primary') AS l1, max(label) FILTER (rd = 'secondary') AS l2, max(label) FILTER (rd = 'adjudication') AS l3,
 max(reviewer) FILTER (rd = 'primary') AS r1, max(reviewer) FILTER (rd = 'secondary') AS r2, max(reviewer) FILTER (rd = 'adjudication') AS r3,
 count(*) FILTER (rd <> 'adjudication' AND NOT rev) AS un FROM r GROUP BY 1),
b AS (SELECT *, CASE WHEN n1 <> 1 OR n2 > 1 OR n3 > 1 THEN 'invalid_history' WHEN un > 0 THEN 'not_reviewed' WHEN r1 = r2 THEN 'same_reviewer' WHEN r3 = r1 OR r3 = r2 THEN 'adjudicator_not_third'
 WHEN n2 = 1 AND l1 <> l2 AND n3 = 0 THEN 'needs_adjudication' WHEN NOT (n2 = 1 AND coalesce(l1 <> l2, false)) AND n3 > 0 THEN 'adjudication_without_disagreement' END AS issue FROM a),
fd AS (SELECT subject_id, issue, CASE WHEN issue IS NULL THEN CASE WHEN n2 = 1 AND l1 <> l2 THEN l3 ELSE l1 END END AS label, n2 > 0 AS second_review FROM b)
"""
_EC = f"""WITH e AS (SELECT 'part-' || l_partkey AS candidate_id, l_suppkey % 29 = 0 AND p_name <> 'other' AS foreign_c,
 CASE WHEN l_linenumber < 6 THEN 'about ' || p_name ELSE '' END AS q, CASE WHEN l_linenumber > 3 THEN lower(replace(p_brand, '#', ' ')) || ' news' ELSE '' END AS h, p_name, lower(replace(p_brand, '#', ' ')) AS pb,
 l_discount >= 0.03 AS subst, l_orderkey % 3 AS o, l_suppkey % 4 AS p, CAST(l_shipdate AS DATE) AS d, l_suppkey % 31 = 0 AS bu FROM lineitem JOIN part ON l_partkey = p_partkey),
f AS (SELECT candidate_id, count(*) AS rows_total, count(*) FILTER (subst) AS substantive_rows, count(DISTINCT o) AS origins, count(DISTINCT p) AS publishers, bool_or(foreign_c) AS fc,
 bool_or(NOT d BETWEEN DATE '1996-01-01' AND DATE '2001-11-04') AS bd, bool_or(bu) AS bu, bool_or(NOT (contains(q, p_name) OR contains(h, p_name) OR contains(q, pb) OR contains(h, pb))) AS na FROM e GROUP BY 1),
c AS (SELECT 'part-' || p_partkey AS candidate_id, p_size, coalesce(rows_total, 0) AS rows_total, coalesce(substantive_rows, 0) AS substantive_rows, coalesce(origins, 0) AS origins, coalesce(publishers, 0) AS publishers,
 coalesce(fc, false) AS fc, coalesce(bd, false) AS bd, coalesce(bu, false) AS bu, coalesce(na, false) AS na FROM part LEFT JOIN f ON f.candidate_id = 'part-' || p_partkey),
ec AS (SELECT candidate_id, p_size, rows_total, substantive_rows, origins, publishers, concat_ws(',', CASE WHEN rows_total < 3 THEN 'insufficient_rows' END, CASE WHEN fc THEN 'foreign_candidate' END, CASE WHEN bd THEN 'bad_date' END,
 CASE WHEN bu THEN 'bad_url' END, CASE WHEN na THEN 'name_absent' END, CASE WHEN origins < 2 THEN 'single_origin' END, CASE WHEN publishers < 2 THEN 'single_publisher' END,
 CASE WHEN substantive_rows < 1 THEN 'no_substantive_evidence' END) AS reasons FROM c),
lr AS (SELECT candidate_id, CASE WHEN p_size % 4 <> 0 THEN 'accepted' ELSE 'proposed' END AS decision_status, CASE WHEN p_size % 2 = 0 THEN 'mature' ELSE 'hype' END AS proposed_label, 'domain-' || (p_size % 5) AS domain,
 CASE WHEN p_size % 4 = 0 THEN 'proposed_not_accepted' WHEN p_size % 2 = 0 THEN '' ELSE reasons END AS reason FROM ec)
"""

ORACLES = {
    "merged_groups": _G + "SELECT group_id, run_id, domain, key FROM mg",
    "queue_duplicates": _G + "SELECT group_id, primary_group_id, run_id, domain FROM qd WHERE group_id <> primary_group_id",
    "queue_filled": _G + "SELECT slot_id, domain, position, group_id, stratum FROM sn JOIN pl USING (domain, position)",
    "queue_overflow": _G + "SELECT group_id, domain, position FROM pl WHERE (domain, position) NOT IN (SELECT (domain, position) FROM sn)",
    "queue_deficits": _G + "SELECT domain, count(*) AS missing FROM sn WHERE (domain, position) NOT IN (SELECT (domain, position) FROM pl) GROUP BY 1",
    "queue_selection": _G + """, c AS (SELECT slot_id, domain, 'part-' || (CAST(substr(slot_id, 6) AS BIGINT) * 3 % ((SELECT count(*) FROM part) + 50)) AS group_id FROM sl)
SELECT slot_id, c.domain, c.group_id, g.domain AS group_domain, CASE WHEN count(*) OVER (PARTITION BY c.group_id) > 1 THEN 'group_repeated' WHEN g.domain IS NULL THEN 'unknown_group' WHEN g.domain <> c.domain THEN 'domain_differs' END AS violation
 FROM c LEFT JOIN g ON g.group_id = c.group_id""",
    "noise_filled": _N + "SELECT slot_id, noise_type, domain, pos FROM sn JOIN pl USING (noise_type, position)",
    "noise_dropped": _N + "SELECT noise_type, reason, count(*) AS items FROM rs WHERE reason IS NOT NULL GROUP BY ALL",
    "noise_urls": "SELECT 'noise-' || o_custkey AS noise_id, 'https://p.example/' || min(l_partkey) AS url FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey WHERE p_size > 45 GROUP BY o_custkey",
    "noise_controls": """WITH n AS (SELECT lower(p_name || ' ' || p_brand) AS k, 'part-' || p_partkey AS id FROM part), c AS (SELECT 'noise-' || p_partkey AS noise_id, lower(p_name || ' ' || p_brand || CASE WHEN p_size < 5 THEN ' ' || p_type ELSE '' END) AS k FROM part)
SELECT noise_id, count(id) AS matches, CASE WHEN count(id) = 1 THEN min(id) END AS proposal_id FROM c LEFT JOIN n USING (k) GROUP BY 1""",
    "evidence_budget": t.BASE_SQL + """, d AS (SELECT candidate_id AS group_id, document_id, origin_id, excerpt_length, connector = 'mediacloud' AS news, CASE trust_tier WHEN 'A' THEN 0 WHEN 'B' THEN 1 WHEN 'C' THEN 2 WHEN 'D' THEN 3 ELSE 4 END AS tr,
 CASE WHEN trust_tier = 'D' THEN 'generated_text' WHEN connector = 'mediacloud' AND excerpt_length <= 500 THEN 'news_text_unavailable' WHEN excerpt_length = 0 THEN 'no_source_text' END AS issue FROM ranked),
ch AS (SELECT * FROM d WHERE issue IS NULL QUALIFY row_number() OVER (PARTITION BY group_id, origin_id ORDER BY news, excerpt_length DESC, document_id) = 1),
tu AS (SELECT *, row_number() OVER (PARTITION BY group_id, news ORDER BY tr, excerpt_length DESC, document_id) AS turn FROM ch QUALIFY turn <= 6),
ba AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY turn, news) AS place FROM tu QUALIFY place <= 6),
hd AS (SELECT group_id, document_id, row_number() OVER (ORDER BY place, group_id) AS budget_rank FROM ba QUALIFY budget_rank <= 60)
SELECT d.group_id, d.document_id, CASE WHEN d.issue IS NOT NULL THEN d.issue WHEN budget_rank IS NOT NULL THEN 'selected' WHEN ch.document_id IS NOT NULL THEN 'budget' ELSE 'same_origin' END AS status, budget_rank
 FROM d LEFT JOIN ch USING (group_id, document_id) LEFT JOIN hd USING (group_id, document_id)""",
    "maturity_queue": t.BASE_SQL + """, x AS (SELECT r.candidate_id, r.document_id, r.origin_id, r.score, r.trust_tier, r.published_at, d.title || chr(10) || d.excerpt || ' ' || concat_ws(' ', CASE WHEN doc_id % 2 = 0 THEN 'widely used' END,
 CASE WHEN doc_id % 3 = 0 THEN 'market vendors' END, CASE WHEN doc_id % 5 = 0 THEN 'in production use, standardized' END) AS txt FROM ranked r JOIN docs d USING (document_id) WHERE r.connector = 'openalex' AND r.relevance_class IN ('strong', 'weak')),
c AS (SELECT *, list_filter([""" + ", ".join(f"CASE WHEN regexp_matches(txt, '{pattern}') THEN '{name}' END" for name, pattern in CUE_GROUPS.items()) + """], lambda n: n IS NOT NULL) AS found FROM x),
m AS (SELECT *, score + 15 * len(found) AS maturity_score FROM c WHERE len(found) > 0),
o AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY candidate_id, origin_id ORDER BY maturity_score DESC, trust_tier <> 'A', published_at NULLS LAST, document_id) = 1)
SELECT candidate_id, document_id, maturity_score, row_number() OVER (PARTITION BY candidate_id ORDER BY maturity_score DESC, trust_tier <> 'A', published_at NULLS LAST, document_id) AS selection_rank, array_to_string(found, ',') AS cues
 FROM o QUALIFY selection_rank <= 4""",
    "noise_report": """WITH r AS (SELECT p_size > 10 AS e, CASE WHEN p_partkey % 7 <> 0 THEN (['reject','review','accept','reject'])[p_partkey % 4 + 1] END AS d, p_partkey % 9 <> 0 AS c FROM part),
a AS (SELECT count(*) AS controls, count(*) FILTER (e) AS expected, count(*) FILTER (e AND d IS NOT NULL) AS observed, count(*) FILTER (e AND d = 'reject') AS reject, count(*) FILTER (e AND d = 'review') AS review,
 count(*) FILTER (e AND d = 'accept') AS accept, count(*) FILTER (c) AS contained_controls FROM r)
SELECT *, round(observed / expected, 6) AS gate_coverage, round(reject / observed, 6) AS rejection_rate, round(accept / observed, 6) AS false_accept_rate, round(contained_controls / controls, 6) AS containment_rate FROM a""",
    "evidence_queue": res._CLAIMS + """, e AS (SELECT candidate_id, CAST(substr(candidate_id, 6) AS BIGINT) AS co, claim_id AS pos, direction, row_number() OVER (PARTITION BY candidate_id, direction ORDER BY claim_id) AS n,
 count(*) FILTER (direction = 'support') OVER (PARTITION BY candidate_id) AS s, count(*) FILTER (direction = 'counter') OVER (PARTITION BY candidate_id) AS c FROM cl)
SELECT row_number() OVER (ORDER BY co, n > least(s, c), n, direction DESC) AS evidence_number, candidate_id, pos, direction FROM e QUALIFY evidence_number <= 400""",
    "broken_ranks": "SELECT 'order-' || l_orderkey AS candidate_id, count(*) AS rows, count(DISTINCT l_linenumber) AS ranks, min(l_linenumber) AS low, max(l_linenumber) AS high FROM lineitem GROUP BY 1 HAVING low <> 1 OR high <> rows OR ranks <> rows",
    "rubric_audit": res._CLAIMS + """, x AS (SELECT *, fc AND trust_tier IN ('A','B') AS tr, published_at BETWEEN DATE '2000-11-04' AND DATE '2001-11-04' AS ins FROM cs),
y AS (SELECT *, fc AND kind IN ('investment','growth','promotional_claim') AND source_class = 'industry' AND ins AS pu FROM x),
a AS (SELECT candidate_id, count(*) AS claim_count, count(*) FILTER (fc) AS full_claims, count(DISTINCT origin_id) FILTER (tr AND mk) AS maturity_origins,
 count(DISTINCT origin_id) FILTER (tr AND (mk OR kind IN ('pilot','prototype','research'))) AS technical_origins, count(DISTINCT origin_id) FILTER (tr AND kind = 'pilot') AS pilot_origins,
 count(*) FILTER (pu) AS publicity_items, count(DISTINCT origin_id) FILTER (pu) AS publicity_origins, count(DISTINCT origin_id) FILTER (scope = 'core_only' AND ins) AS media_origins FROM y GROUP BY 1),
b AS (SELECT 'part-' || p_partkey AS candidate_id, p_size % 10 <> 3 AS search_coverage_complete, a.* EXCLUDE (candidate_id) FROM part LEFT JOIN a ON a.candidate_id = 'part-' || p_partkey),
c AS (SELECT *, maturity_origins > 0 AS mature_eligible, search_coverage_complete AND publicity_items >= 3 AND publicity_origins >= 2 AND technical_origins < 2 AND pilot_origins = 0 AS hype_eligible FROM b)
SELECT *, concat_ws(',', CASE WHEN maturity_origins = 0 THEN 'missing_ab_standard_deployment_or_market' END, CASE WHEN NOT search_coverage_complete THEN 'incomplete_candidate_search_coverage' END,
 CASE WHEN publicity_items < 3 THEN 'fewer_than_three_verified_recent_publicity_items' END, CASE WHEN publicity_origins < 2 THEN 'fewer_than_two_verified_publicity_origins' END,
 CASE WHEN technical_origins >= 2 THEN 'two_or_more_ab_technical_origins' END, CASE WHEN pilot_origins > 0 THEN 'confirmed_ab_pilot' END) AS deficits,
 CASE WHEN mature_eligible AND hype_eligible THEN 'conflict' WHEN mature_eligible THEN 'mature_ready' WHEN hype_eligible THEN 'marketing_hype_ready' WHEN media_origins >= 3 THEN 'needs_verified_publicity' ELSE 'insufficient_evidence' END AS status FROM c""",
    "evidence_contract": _EC + "SELECT candidate_id, rows_total, substantive_rows, origins, publishers, reasons FROM ec",
    "label_readiness": _EC + "SELECT *, reason = '' AS label_ready FROM lr",
    "readiness_by_domain": _EC + "SELECT domain, proposed_label, 50 AS quota, count(*) AS candidates, count(*) FILTER (reason = '') AS ready, count(*) FILTER (reason = '') >= 50 AS quota_met FROM lr GROUP BY ALL",
    "final_decisions": _FD + "SELECT * FROM fd",
    "second_review_quota": _FD + "SELECT label, count(*) AS total, count(*) FILTER (second_review) AS reviewed, CAST(ceil(count(*) * 0.2) AS BIGINT) AS required, count(*) FILTER (second_review) >= ceil(count(*) * 0.2) AS met FROM fd WHERE label IS NOT NULL GROUP BY 1",
    "publicity_input": t.BASE_SQL + """,
pl AS (SELECT candidate_id, document_id, publisher, connector, row_number() OVER (PARTITION BY candidate_id, connector ORDER BY score DESC, document_id) AS place FROM kept WHERE score >= 30),
hd AS (SELECT * FROM pl WHERE connector = 'mediacloud' AND place <= 4),
en AS (SELECT candidate_id FROM hd GROUP BY 1 HAVING count(*) >= 3 AND count(DISTINCT publisher) >= 2),
bt AS (SELECT candidate_id, document_id, 0 AS class, place FROM hd UNION ALL SELECT candidate_id, document_id, 1, place FROM pl WHERE connector = 'openalex' AND place <= 6)
SELECT candidate_id, document_id, CAST(row_number() OVER (PARTITION BY candidate_id ORDER BY class, place) AS INT) AS final_rank
FROM bt JOIN en USING (candidate_id) JOIN cands USING (candidate_id) WHERE item_id % 3 <> 0
QUALIFY row_number() OVER (PARTITION BY candidate_id ORDER BY class, place) <= 6""",
    "rubric_violations": """WITH e AS (SELECT 'order-' || l_orderkey AS id, (['publicity_wave','publicity_wave','technical_validation','publicity_wave','pilot','standard_adoption','publicity_wave','publicity_wave'])[CAST(l_quantity AS INT) % 8 + 1] AS kind,
 l_linestatus = 'F' AS s, l_suppkey % 5 < 2 AS ab, l_suppkey % 6 AS o, CAST(l_shipdate AS DATE) AS d FROM lineitem),
f AS (SELECT id, count(*) FILTER (s AND ab AND kind = 'standard_adoption') AS mature, count(*) FILTER (s AND kind = 'publicity_wave' AND d BETWEEN DATE '1995-01-01' AND DATE '2001-06-30') AS wave,
 count(DISTINCT o) FILTER (s AND kind = 'publicity_wave' AND d BETWEEN DATE '1995-01-01' AND DATE '2001-06-30') AS wo, count(DISTINCT o) FILTER (s AND ab AND kind IN ('technical_validation','pilot')) AS tech,
 count(*) FILTER (s AND kind = 'pilot') AS pilots, count(*) FILTER (d > DATE '2001-06-30') AS fut FROM e GROUP BY 1)
SELECT 'order-' || o_orderkey AS decision_id, CASE WHEN o_orderkey % 2 = 0 THEN 'mature' ELSE 'marketing_hype' END AS label,
 CASE WHEN coalesce(fut, 0) > 0 THEN 'evidence_after_cutoff' WHEN o_orderkey % 2 = 0 THEN CASE WHEN coalesce(mature, 0) = 0 THEN 'mature_without_trusted_evidence' END
  WHEN coalesce(wave, 0) < 3 OR coalesce(wo, 0) < 2 THEN 'no_publicity_wave' WHEN o_orderkey % 5 = 0 OR o_orderkey % 7 = 0 THEN 'search_incomplete' WHEN tech >= 2 THEN 'technical_origins' WHEN pilots > 0 THEN 'pilot_or_deployment' WHEN mature > 0 THEN 'maturity_evidence' END AS violation
 FROM orders LEFT JOIN f ON f.id = 'order-' || o_orderkey""",
    "search_notes": """WITH r AS (SELECT 'run-' || l_suppkey AS run_id, CASE WHEN l_returnflag = 'A' THEN 'scientific' ELSE 'industry' END AS sc, CASE WHEN l_quantity < 5 THEN 'failed' WHEN l_linestatus = 'F' THEN 'complete' ELSE 'partial' END AS st,
 CASE WHEN l_linenumber < 7 THEN 0 ELSE 1 END AS rq, CASE WHEN l_linenumber = 7 THEN nullif((['budget','','pages'])[l_suppkey % 3 + 1], '') END AS stop FROM lineitem),
p AS (SELECT run_id, sc, st, sum(rq) AS rq, array_to_string(list_sort(list_distinct(list(stop) FILTER (stop IS NOT NULL))), ',') AS stops FROM r GROUP BY ALL),
n AS (SELECT run_id, array_to_string(list_sort(list(sc || '=' || st || CASE WHEN coalesce(stops, '') <> '' THEN '(' || stops || ')' ELSE '' END)), ';') AS notes FROM p WHERE rq > 0 AND st <> 'failed' GROUP BY 1)
SELECT run_id, coalesce(notes, '') AS notes FROM (SELECT DISTINCT run_id FROM r) LEFT JOIN n USING (run_id)""",
    "fallback_documents": """SELECT 'run-' || (o_custkey % 50) AS run_id, CASE WHEN o_orderstatus = 'F' THEN 'primary' ELSE 'fallback' END AS provider, 'cust-' || o_custkey AS origin_id, CAST(substr(o_orderpriority, 1, 1) AS INT) AS request_pos, o_orderkey AS record_index
 FROM orders WHERE (o_custkey % 50 % 3 = 0) = (o_orderstatus = 'F') QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY substr(o_orderpriority, 1, 1), o_orderkey) = 1""",
    "run_domains": """SELECT n_name AS run_id, CASE WHEN n_nationkey % 2 = 0 OR n_regionkey <> 2 THEN r_name END AS domain, NOT (n_nationkey % 2 = 0 OR n_regionkey <> 2) AS violation FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "gate_context": t.BASE_SQL + """, s AS (SELECT l.candidate_id AS proposal_id, d.document_id, d.connector, d.title_key AS tk, d.title_key || ' ' || d.excerpt_key AS bk, c.search_terms AS st, list_distinct(string_split(array_to_string(c.search_terms, ' '), ' ')) AS w
 FROM links l JOIN cands c USING (candidate_id) JOIN docs d USING (document_id)),
h AS (SELECT *, len(list_filter(st, lambda p: length(p) >= 4 AND contains(bk, p))) AS ph, len(list_filter(w, lambda x: length(x) >= 2 AND contains(' ' || tk || ' ', ' ' || x || ' '))) AS th, len(list_filter(w, lambda x: length(x) >= 2 AND contains(' ' || bk || ' ', ' ' || x || ' '))) AS xh FROM s),
c1 AS (SELECT *, row_number() OVER (PARTITION BY proposal_id, connector ORDER BY ph DESC, th DESC, xh DESC, document_id) AS r FROM h)
SELECT proposal_id, document_id, row_number() OVER (PARTITION BY proposal_id ORDER BY r > 1, ph DESC, th DESC, xh DESC, document_id) AS position FROM c1 QUALIFY position <= 3""",
}
