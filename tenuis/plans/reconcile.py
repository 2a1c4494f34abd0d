"""Duplicates, grounded proposals, review decisions, evidence input and reviewed identities on the benchmark tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenuis.functions.ids import digest_id
from tenuis.operators import labeling as lab
from tenuis.operators import reconcile as rec
from tenuis.plans import labeling as pl
from tenuis.plans import tables as t
from tenuis.session import stored

# Duplicates


def queue(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """(outcomes, queued, addresses, overflow, groups): the queue of parts; its documents are the orders of a part, and those of
    every fourth customer number have an address in one run."""
    groups = stored(pl.groups(spark, sf), "groups")
    kept, duplicates = lab.spelling_duplicates(lab.merge_runs(groups))
    filled, overflow, _ = lab.fill_slots(kept, pl.slots(spark, sf))
    queued = stored(filled.select("group_id", F.col("slot_id").alias("candidate_id")), "queued")
    o = F.col("o_orderkey")
    documents = t.table(spark, sf, "orders").select(
        F.concat(F.lit("run-"), F.col("o_custkey") % 4).alias("run_id"), o.alias("document_id"), F.when(F.col("o_custkey") % 4 < 2, F.concat(F.lit(" https://o.example/"), o)).otherwise(" ").alias("url")
    )
    runs = groups.select("group_id", "run_id")
    held = t.table(spark, sf, "lineitem").select(F.concat(F.lit("part-"), "l_partkey").alias("group_id"), F.col("l_orderkey").alias("document_id")).distinct()
    addresses = stored(rec.first_addresses(held.join(runs, "group_id").withColumn("pos", F.col("document_id")), documents), "addresses")
    names = duplicates.join(groups.select("group_id", "canonical_name"), "group_id")
    slots = t.table(spark, sf, "supplier").select(t.pick(rec.NOISE_TYPES, F.col("s_suppkey") % 5).alias("noise_type"))
    outcomes = stored(rec.duplicate_outcomes(names, queued, addresses, slots), "outcomes")
    rest = overflow.select(F.lit("candidate").alias("kind"), F.col("group_id").alias("key"), "run_id").unionByName(
        duplicates.select(F.lit("candidate_duplicate").alias("kind"), F.col("group_id").alias("key"), "run_id")
    )
    return outcomes, queued, addresses, rest, groups


def duplicate_pool(spark: SparkSession, sf: str) -> DataFrame:
    outcomes, queued, addresses, _, groups = queue(spark, sf)
    p = F.col("p_partkey")
    suggestions = t.table(spark, sf, "part").select(
        F.concat(F.lit("alias "), p).alias("text"), F.concat(F.lit("https://a.example/"), p).alias("url"), F.col("p_brand").alias("domain"), F.concat(F.lit("part-"), p).alias("pos"),
        F.concat(F.lit("part-"), p * 3).alias("primary_group_id"),
    )
    aliases = groups.select("group_id", F.lower("canonical_name").alias("alias"), F.col("group_id").alias("pos"), "domain")
    return rec.duplicate_pool(outcomes, suggestions, queued, aliases, addresses)


def duplicate_drops(spark: SparkSession, sf: str) -> DataFrame:
    return queue(spark, sf)[0].where(F.col("outcome") != "moved").select("group_id", "primary_group_id", "outcome")


def duplicate_overflow(spark: SparkSession, sf: str) -> DataFrame:
    outcomes, _, _, overflow, _ = queue(spark, sf)
    return rec.remaining_overflow(overflow, outcomes)


# Proposals

def grounding_rows(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Parts as candidates, their lines as matches, orders as documents; orders of one customer and status are one identity."""
    line = F.col("l_linenumber")
    rows = t.table(spark, sf, "lineitem").join(t.table(spark, sf, "part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey")).select(
        F.concat(F.lit("part-"), "l_partkey").alias("candidate_id"), F.concat(F.lit("order-"), "l_orderkey").alias("document_id"),
        F.when(F.col("l_returnflag") == "R", "alias").otherwise("canonical").alias("term_role"), F.col("p_name").alias("term"),
        F.when(F.col("l_linestatus") == "O", "title").otherwise("excerpt").alias("location"), line.alias("start"), (line + 5).alias("end"),
    )
    identity = F.concat("o_orderstatus", F.lit("/"), F.col("o_custkey") % 20)
    documents = t.table(spark, sf, "orders").select(
        F.concat(F.lit("order-"), "o_orderkey").alias("document_id"), F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("10.1/"), identity)).alias("doi"), F.concat(F.lit("https://Y.example/"), identity).alias("canonical_url"),
        F.concat(F.lit("cust-"), "o_custkey").alias("origin_id"), F.col("o_orderpriority").alias("connector"),
    )
    names = t.table(spark, sf, "part").select(F.concat(F.lit("part-"), "p_partkey").alias("candidate_id"), F.col("p_name").alias("canonical_name"))
    return rows, documents, names


def grounded_members(spark: SparkSession, sf: str) -> DataFrame:
    rows, documents, _ = grounding_rows(spark, sf)
    return rec.grounded_members(rows, documents, "scope-1")


def grounded_proposals(spark: SparkSession, sf: str) -> DataFrame:
    rows, documents, names = grounding_rows(spark, sf)
    return rec.grounded_proposals(names, rec.grounded_members(rows, documents, "scope-1"))


# Decisions


def decision_input(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(sheet, candidates, noise, evidence): orders are decision rows about customers as candidates or suppliers as noise;
    lines are evidence, owned by the customer of their order and verified but for returned ones."""
    k = F.col("o_orderkey")
    model = k % 3 != 0
    text = lambda c: c.cast("string")
    sheet = t.table(spark, sf, "orders").select(
        F.concat(F.lit("dec-"), F.when(k % 97 == 0, 0).otherwise(k)).alias("decision_id"), F.when(k % 53 == 0, "other").when(model, "model_candidate").otherwise("noise_control").alias("subject_type"),
        F.when(model, F.concat(F.lit("cust-"), F.when(k % 29 == 0, -1).otherwise(F.col("o_custkey")))).otherwise(F.concat(F.lit("supp-"), k % 12)).alias("subject_id"),
        F.when(k % 31 == 0, "third").otherwise(t.pick(rec.REVIEW_ROUNDS, k % 3)).alias("review_round"), t.pick(rec.REVIEW_STATUSES, k % 2 + 1).alias("status"),
        F.when(model, t.pick([*rec.MODEL_LABELS, "mature"], k % 3)).alias("model_label"), F.when(~model, t.pick(rec.NOISE_TYPES, k % 5)).when(k % 41 == 0, "duplicate").alias("noise_type"),
        F.when(k % 37 == 0, " ").otherwise("because").alias("rationale"), F.concat(F.lit("reviewer-"), k % 4).alias("reviewer_id"),
        text(F.when(k % 43 == 0, F.lit("soon")).otherwise(F.col("o_orderdate").cast("date").cast("string"))).alias("annotated_at"), F.lit("2026-09-15").alias("cutoff_date"),
        F.when(model, F.concat(F.lit("ev-"), k, F.lit("-1; ev-"), k, F.lit("-2;;ev-"), F.when(k % 11 == 0, k + 1).otherwise(k), F.lit("-3"))).alias("evidence_ids"),
        F.when(model & (k % 2 == 0), "a;b").alias("search_queries"), F.when(model & (k % 2 == 0), F.when(k % 47 == 0, "web").otherwise("scientific;industry")).alias("search_source_classes"),
        F.when(model & (k % 2 == 0) & (k % 5 != 0), "2026-01-02").alias("searched_at"), F.when(k % 59 != 0, "found").alias("search_notes"),
    )
    candidates = t.table(spark, sf, "customer").select(F.concat(F.lit("cust-"), "c_custkey").alias("candidate_id"))
    noise = t.table(spark, sf, "supplier").select(F.concat(F.lit("supp-"), "s_suppkey").alias("noise_id"))
    lines = t.table(spark, sf, "lineitem").join(t.table(spark, sf, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    evidence = lines.groupBy("l_orderkey", "l_linenumber").agg(F.min("o_custkey").alias("c"), F.min("l_returnflag").alias("flag")).select(
        F.concat(F.lit("ev-"), "l_orderkey", F.lit("-"), "l_linenumber").alias("evidence_id"), F.concat(F.lit("cust-"), "c").alias("candidate_id"),
        F.when(F.col("flag") == "R", "draft").otherwise("verified").alias("status"), F.col("flag").alias("kind"),
    )
    return sheet, candidates, noise, evidence


def references(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    sheet, candidates, noise, evidence = decision_input(spark, sf)
    return rec.decision_references(rec.typed_decisions(sheet), candidates, noise, evidence), candidates, noise, evidence


def broken_decisions(spark: SparkSession, sf: str) -> DataFrame:
    return rec.typed_decisions(decision_input(spark, sf)[0]).where(F.col("violation").isNotNull()).select("decision_id", "violation")


def dangling_decisions(spark: SparkSession, sf: str) -> DataFrame:
    return references(spark, sf)[0].where(F.col("resolution") != "resolved")


def linked_evidence(spark: SparkSession, sf: str) -> DataFrame:
    found, _, _, evidence = references(spark, sf)
    return rec.linked_evidence(found, evidence)


def undecided_subjects(spark: SparkSession, sf: str) -> DataFrame:
    found, candidates, noise, _ = references(spark, sf)
    return rec.undecided(stored(found, "references"), candidates, noise)


# Evidence input


def evidence_input_tables(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Orders declare, lines show. Lines are ranked by number; some values are spoilt by number."""
    n, s = F.col("l_linenumber"), F.col("l_suppkey")
    science = F.col("l_returnflag") == "A"
    lines = t.table(spark, sf, "lineitem")
    documents = lines.select(
        F.concat(F.lit("order-"), "l_orderkey").alias("candidate_id"), F.concat(F.lit("part-"), "l_partkey").alias("document_id"), F.when(science, "scientific").otherwise("industry").alias("source_class"),
        F.when(science, "openalex").when(s % 9 == 4, "gdelt").otherwise("exa").alias("connector"), (s % 31 != 0).alias("evidence_text_available"), F.when(s % 17 != 0, "text").otherwise("").alias("excerpt"),
        F.when(s % 23 != 0, "title").alias("title"), F.lit("o").alias("origin_id"), F.lit("term").alias("matched_term"), F.when(s % 19 == 0, "ftp://x").otherwise("https://x.example/a").alias("url"),
        (s * 3 % 110).alias("relevance_score"), F.when(s % 13 == 0, "none").otherwise("strong").alias("relevance_class"), F.lit("A").alias("trust_tier"), F.col("l_shipdate").cast("date").alias("published_at"), n.alias("final_rank"),
    )
    shown = lines.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.count_if(science).alias("a"))
    k = F.col("o_orderkey")
    n, a = F.coalesce("n", F.lit(0)), F.coalesce("a", F.lit(0))
    coverage = t.table(spark, sf, "orders").where(k % 83 != 0).join(shown, k == F.col("l_orderkey"), "left").select(
        F.concat(F.lit("order-"), k).alias("candidate_id"), F.when(k % 7 == 0, n == 0).otherwise(n > 0).alias("has_evidence_input"), (n + (k % 11 == 0).cast("int")).alias("final_evidence_input_count"),
        (a + (k % 13 == 0).cast("int")).alias("scientific_selected"), F.when(k % 61 == 0, -1).otherwise(n - a).alias("media_selected"),
        F.when(k % 67 == 0, F.array(F.lit("web"))).otherwise(F.array_compact(F.array(F.when(a > 0, "scientific"), F.when((n > a) & (k % 17 != 0), "industry")))).alias("source_classes_present"),
    )
    return coverage, documents


def broken_evidence_documents(spark: SparkSession, sf: str) -> DataFrame:
    return rec.broken_documents(evidence_input_tables(spark, sf)[1], "2001-11-04")


def broken_evidence_input(spark: SparkSession, sf: str) -> DataFrame:
    return rec.broken_input(*evidence_input_tables(spark, sf))


# Identities


def identity_tables(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(selected, identities, decisions): parts with returned lines are selected; lines pair a part with a part of their supplier's number."""
    p = F.col("p_partkey")
    name = F.concat(F.lit("part-"), p)
    parts = t.table(spark, sf, "part").select(p, "p_name")
    lines = t.table(spark, sf, "lineitem")
    returned = lines.where(F.col("l_returnflag") == "R").select(F.col("l_partkey").alias("p_partkey"))
    selected = parts.join(returned, "p_partkey", "left_semi").select(name.alias("candidate_id"), F.col("p_name").alias("canonical_name"))
    identities = parts.where(p % 41 != 0).select(
        name.alias("candidate_id"), F.when(p % 31 == 0, "draft").otherwise("reviewed").alias("identity_status"), F.when(p % 37 == 0, "x").otherwise(F.col("p_name")).alias("canonical_name"),
        F.when(p % 43 == 0, "group-1").otherwise(digest_id("cross-corpus-", F.col("p_name"))).alias("group_id"),
    )
    decisions = lines.select(
        F.concat(F.lit("part-"), "l_partkey").alias("left_candidate_id"), F.concat(F.lit("part-"), F.col("l_suppkey") * 7).alias("right_candidate_id"),
        F.when(F.col("l_quantity") < 10, "same_candidate").when(F.col("l_quantity") < 20, "same_family").otherwise("distinct").alias("relation"),
    )
    return selected, identities, decisions


def selected_identities(spark: SparkSession, sf: str) -> DataFrame:
    return rec.selected_identities(*identity_tables(spark, sf)[:2])


def selection_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    selected, _, decisions = identity_tables(spark, sf)
    return rec.selection_conflicts(decisions, selected)


def selection_readiness(spark: SparkSession, sf: str) -> DataFrame:
    return rec.selection_readiness(selection_conflicts(spark, sf))


QUERIES = {
    name: globals()[name]
    for name in (
        "duplicate_pool", "duplicate_drops", "duplicate_overflow", "grounded_members", "grounded_proposals", "broken_decisions", "dangling_decisions", "linked_evidence", "undecided_subjects",
        "broken_evidence_documents", "broken_evidence_input", "selected_identities", "selection_conflicts", "selection_readiness",
    )
}

_DUP = pl._G.rstrip() + """,
queued AS (SELECT group_id, slot_id AS candidate_id FROM pl JOIN sn USING (domain, position)),
docs AS (SELECT 'run-' || (o_custkey % 4) AS run_id, o_orderkey, 'https://o.example/' || o_orderkey AS url FROM orders WHERE o_custkey % 4 < 2),
addr AS (SELECT group_id, arg_min(url, o_orderkey) AS url FROM g JOIN (SELECT DISTINCT 'part-' || l_partkey AS group_id, l_orderkey FROM lineitem) USING (group_id) JOIN docs ON l_orderkey = o_orderkey AND docs.run_id = g.run_id GROUP BY 1),
dup AS (SELECT qd.*, q.candidate_id, addr.url, CASE WHEN q.candidate_id IS NULL THEN 'primary_not_queued' WHEN addr.url IS NULL THEN 'no_url' ELSE 'moved' END AS outcome
 FROM qd LEFT JOIN queued q ON q.group_id = primary_group_id LEFT JOIN addr ON addr.group_id = qd.group_id WHERE qd.group_id <> primary_group_id)
"""
_GROUNDED = """WITH r AS (SELECT 'part-' || l_partkey AS candidate_id, 'order-' || l_orderkey AS document_id, p_name AS term, CASE WHEN l_linestatus = 'O' THEN 'title' ELSE 'excerpt' END AS location, l_linenumber AS s,
 'cust-' || o_custkey AS origin_id, o_orderpriority AS connector, CASE WHEN o_orderkey % 2 = 0 THEN '10.1/' ELSE 'https://y.example/' END || lower(o_orderstatus) || '/' || (o_custkey % 20) AS identity
 FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag <> 'R'),
k AS (SELECT * FROM r QUALIFY document_id = min(document_id) OVER (PARTITION BY candidate_id, identity)),
mem AS (SELECT DISTINCT 'proposal-' || substr(sha256('scope-1|' || candidate_id), 1, 16) AS proposal_id, candidate_id, unnest(['mention', 'document', 'origin', 'connector', 'source_kind']) AS set,
 unnest(['mention-' || substr(sha256(document_id || '|' || location || '[' || s || ':' || (s + 5) || ']|' || term), 1, 16), document_id, origin_id, connector, location]) AS member FROM k)
"""
_DEC = """WITH d AS (SELECT *, o_orderkey AS k, o_orderkey % 3 <> 0 AS model, o_orderkey % 2 = 0 AND o_orderkey % 3 <> 0 AS searched,
 'dec-' || CASE WHEN o_orderkey % 97 = 0 THEN 0 ELSE o_orderkey END AS decision_id FROM orders),
v AS (SELECT *, CASE WHEN k % 37 = 0 THEN 'blank_cell' WHEN k % 43 = 0 THEN 'bad_date' WHEN count(*) OVER (PARTITION BY decision_id) > 1 THEN 'repeated_decision' WHEN k % 53 = 0 THEN 'unknown_subject_type'
 WHEN k % 31 = 0 THEN 'unknown_round' WHEN model AND k % 41 = 0 THEN 'noise_type_of_model' WHEN searched AND k % 5 = 0 THEN 'missing_searched_at' WHEN searched AND k % 47 = 0 THEN 'unknown_search_class'
 WHEN searched AND k % 59 = 0 THEN 'missing_search_notes' END AS violation FROM d),
good AS (SELECT *, CASE WHEN model THEN 'cust-' || CASE WHEN k % 29 = 0 THEN -1 ELSE o_custkey END ELSE 'supp-' || (k % 12) END AS subject_id FROM v WHERE violation IS NULL),
ev AS (SELECT 'ev-' || l_orderkey || '-' || l_linenumber AS evidence_id, 'cust-' || min(o_custkey) AS owner, min(l_returnflag) AS kind FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_orderkey, l_linenumber HAVING min(l_returnflag) <> 'R'),
ref AS (SELECT decision_id, 'candidate' AS target, subject_id AS target_id, NULL AS subject_id FROM good WHERE model UNION ALL SELECT decision_id, 'noise', subject_id, NULL FROM good WHERE NOT model
 UNION ALL SELECT decision_id, 'evidence', unnest(['ev-' || k || '-1', 'ev-' || k || '-2', 'ev-' || CASE WHEN k % 11 = 0 THEN k + 1 ELSE k END || '-3']), subject_id FROM good WHERE model),
res AS (SELECT decision_id, target, target_id, CASE WHEN target = 'candidate' THEN CASE WHEN target_id IN (SELECT 'cust-' || c_custkey FROM customer) THEN 'resolved' ELSE 'unknown' END
 WHEN target = 'noise' THEN CASE WHEN target_id IN (SELECT 'supp-' || s_suppkey FROM supplier) THEN 'resolved' ELSE 'unknown' END
 WHEN owner IS NULL THEN 'unknown' WHEN owner <> subject_id THEN 'foreign' ELSE 'resolved' END AS resolution, kind FROM ref LEFT JOIN ev ON target = 'evidence' AND evidence_id = target_id)
"""
_INPUT = """WITH l AS (SELECT l_orderkey AS o, count(*) AS n, count(*) FILTER (l_returnflag = 'A') AS a, count(*) FILTER (l_linenumber NOT BETWEEN 1 AND 6) AS bad, bit_or(CASE WHEN l_linenumber BETWEEN 1 AND 6 THEN 1 << (l_linenumber - 1) ELSE 0 END) AS bits FROM lineitem GROUP BY 1),
c AS (SELECT o_orderkey AS k, coalesce(n, 0) AS n0, coalesce(a, 0) AS a0 FROM orders LEFT JOIN l ON o = o_orderkey WHERE o_orderkey % 83 <> 0),
d AS (SELECT k, CASE WHEN k % 7 = 0 THEN n0 = 0 ELSE n0 > 0 END AS has, n0 + CAST(k % 11 = 0 AS INT) AS f, a0 + CAST(k % 13 = 0 AS INT) AS s, CASE WHEN k % 61 = 0 THEN -1 ELSE n0 - a0 END AS m,
 CASE WHEN k % 67 = 0 THEN 'web' ELSE concat_ws(',', CASE WHEN n0 > a0 AND k % 17 <> 0 THEN 'industry' END, CASE WHEN a0 > 0 THEN 'scientific' END) END AS cl FROM c),
j AS (SELECT coalesce(k, o) AS k, d.k IS NOT NULL AS known, has, f, s, m, cl, coalesce(n, 0) AS n, coalesce(a, 0) AS a, bad, bits, d.k IS NOT NULL AND m >= 0 AS valid, concat_ws(',', CASE WHEN n > a THEN 'industry' END, CASE WHEN a > 0 THEN 'scientific' END) AS real FROM d FULL JOIN l ON k = o)
"""

ORACLES = {
    "duplicate_pool": _DUP + """SELECT 'alias ' || p_partkey AS text, 'https://a.example/' || p_partkey AS url, p_brand AS domain, 'part-' || p_partkey AS pos, 'alias_suggestion' AS origin_kind, candidate_id AS duplicate_of
 FROM part LEFT JOIN queued ON group_id = 'part-' || (p_partkey * 3)
UNION ALL SELECT canonical_name, url, domain, group_id, 'candidate_duplicate', candidate_id FROM dup WHERE outcome = 'moved'
UNION ALL SELECT lower(canonical_name), url, domain, group_id, 'candidate_alias', candidate_id FROM g JOIN addr USING (group_id) JOIN queued USING (group_id)""",
    "duplicate_drops": _DUP + "SELECT group_id, primary_group_id, outcome FROM dup WHERE outcome <> 'moved'",
    "duplicate_overflow": _DUP + """SELECT 'candidate' AS kind, group_id AS key, run_id FROM pl LEFT JOIN sn USING (domain, position) WHERE slot_id IS NULL
UNION ALL SELECT 'candidate_duplicate', group_id, run_id FROM dup WHERE outcome <> 'moved'""",
    "grounded_members": _GROUNDED + "SELECT proposal_id, candidate_id, set, member FROM mem",
    "grounded_proposals": _GROUNDED + """, h AS (SELECT proposal_id, candidate_id, set, count(*) AS n, sha256(count(*) || '|' || CAST(sum(CAST('0x' || substr(sha256(member), 1, 15) AS HUGEINT)) AS VARCHAR)) AS x FROM mem GROUP BY ALL)
SELECT proposal_id, candidate_id, p_name AS canonical_name, p_name AS normalized_name, max(n) FILTER (set = 'mention') AS mentions, max(n) FILTER (set = 'document') AS documents, max(n) FILTER (set = 'origin') AS origins,
 max(n) FILTER (set = 'connector') AS connectors, max(n) FILTER (set = 'source_kind') AS source_kinds, max(x) FILTER (set = 'mention') AS mentions_digest, max(x) FILTER (set = 'document') AS documents_digest, max(x) FILTER (set = 'origin') AS origins_digest
FROM h JOIN part ON candidate_id = 'part-' || p_partkey GROUP BY 1, 2, 3""",
    "broken_decisions": _DEC + "SELECT decision_id, violation FROM v WHERE violation IS NOT NULL",
    "dangling_decisions": _DEC + "SELECT decision_id, target, target_id, resolution FROM res WHERE resolution <> 'resolved'",
    "linked_evidence": _DEC + "SELECT evidence_id, decision_id, owner AS candidate_id, ev.kind FROM res JOIN ev ON evidence_id = target_id WHERE target = 'evidence' AND resolution = 'resolved'",
    "undecided_subjects": _DEC + """SELECT 'candidate' AS target, 'cust-' || c_custkey AS target_id FROM customer WHERE 'cust-' || c_custkey NOT IN (SELECT target_id FROM res WHERE target = 'candidate')
UNION ALL SELECT 'noise', 'supp-' || s_suppkey FROM supplier WHERE 'supp-' || s_suppkey NOT IN (SELECT target_id FROM res WHERE target = 'noise')""",
    "broken_evidence_documents": """WITH d AS (SELECT 'order-' || l_orderkey AS candidate_id, 'part-' || l_partkey AS document_id, l_suppkey AS s, l_returnflag = 'A' AS a, CAST(l_shipdate AS DATE) AS day FROM lineitem)
SELECT candidate_id, document_id, violation FROM (SELECT *, CASE WHEN NOT a AND s % 9 = 4 THEN 'connector_differs' WHEN s % 31 = 0 THEN 'text_not_available' WHEN s % 17 = 0 THEN 'blank_excerpt' WHEN s % 23 = 0 THEN 'blank_text'
 WHEN s % 19 = 0 THEN 'bad_url' WHEN s * 3 % 110 > 100 THEN 'bad_score' WHEN s % 13 = 0 THEN 'bad_relevance_class' WHEN day > DATE '2001-11-04' THEN 'after_cutoff' END AS violation FROM d) WHERE violation IS NOT NULL
UNION ALL SELECT candidate_id, document_id, 'repeated_pair' FROM d GROUP BY 1, 2 HAVING count(*) > 1""",
    "broken_evidence_input": _INPUT + """SELECT 'order-' || k AS candidate_id, violation FROM (SELECT k, unnest(list_filter([
 CASE WHEN NOT known THEN 'unknown_candidate' END, CASE WHEN known AND NOT valid THEN 'bad_declaration' END, CASE WHEN valid AND s + m <> f THEN 'counts_disagree' END, CASE WHEN valid AND (f > 0) <> has THEN 'flag_disagrees' END,
 CASE WHEN valid AND cl = 'web' THEN 'bad_classes' END, CASE WHEN valid AND NOT has AND n > 0 THEN 'documents_without_input' END, CASE WHEN valid AND has AND n = 0 THEN 'input_without_documents' END,
 CASE WHEN valid AND NOT has AND (f <> 0 OR s <> 0 OR m <> 0 OR cl <> '') THEN 'no_input_not_empty' END, CASE WHEN valid AND has AND f NOT BETWEEN 1 AND 6 THEN 'count_out_of_range' END,
 CASE WHEN valid AND has AND n > 0 AND f <> n THEN 'count_differs' END, CASE WHEN valid AND has AND n > 0 AND (s <> a OR m <> n - a) THEN 'class_counts_differ' END, CASE WHEN valid AND has AND n > 0 AND cl <> real THEN 'classes_differ' END,
 CASE WHEN n > 6 THEN 'too_many_documents' END, CASE WHEN known AND n BETWEEN 1 AND 6 AND (bad > 0 OR bits <> (1 << n) - 1) THEN 'ranks_broken' END], lambda x: x IS NOT NULL)) AS violation FROM j)""",
    "selected_identities": """SELECT 'part-' || p AS candidate_id, CASE WHEN v IS NULL THEN 'cross-corpus-' || substr(sha256(p_name), 1, 16) END AS group_id, v AS violation FROM (
 SELECT p_partkey AS p, p_name, CASE WHEN p_partkey % 41 = 0 THEN 'missing_identity' WHEN p_partkey % 31 = 0 THEN 'not_reviewed' WHEN p_partkey % 37 = 0 THEN 'name_differs' WHEN p_partkey % 43 = 0 THEN 'bad_group' END AS v
 FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R'))""",
    "selection_conflicts": """WITH s AS (SELECT DISTINCT l_partkey AS p FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_returnflag = 'R')
SELECT 'part-' || l_partkey AS left_candidate_id, 'part-' || (l_suppkey * 7) AS right_candidate_id FROM lineitem WHERE l_quantity < 10 AND l_partkey IN (SELECT p FROM s) AND l_suppkey * 7 IN (SELECT p FROM s)""",
    "selection_readiness": """WITH s AS (SELECT DISTINCT l_partkey AS p FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_returnflag = 'R')
SELECT count(*) AS conflicts, count(*) = 0 AS ready FROM lineitem WHERE l_quantity < 10 AND l_partkey IN (SELECT p FROM s) AND l_suppkey * 7 IN (SELECT p FROM s)""",
}
