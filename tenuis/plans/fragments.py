"""Parts of responses, texts and explanations: timelines, taxonomies, broken payloads, windows, coverage of fields."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenuis.functions import crosswalk
from tenuis.operators import evidence as ev
from tenuis.operators import identity as idn
from tenuis.operators import results as ro
from tenuis.plans import entities as pe
from tenuis.plans import sources as ps
from tenuis.plans import tables as t
from tenuis.sources import news, quarantine, scholarly


def media_timeline(spark: SparkSession, sf: str) -> DataFrame:
    """One response per event type with its daily counts; the first day comes twice."""
    events = t.table(spark, sf, "events").select(F.col("ts").cast("date").cast("string").alias("date"), "event_type", "value")
    daily = events.groupBy("event_type", "date").agg(F.count_if(F.col("value") > 10).cast("string").alias("count"), F.count(F.lit(1)).cast("string").alias("total_count"))
    counts = daily.groupBy("event_type").agg(F.sort_array(F.collect_list(F.struct("date", "count", "total_count"))).alias("counts"))
    twice = counts.select("event_type", F.concat("counts", F.slice("counts", 1, 1)).alias("counts"))
    raw = twice.select(F.col("event_type").alias("snapshot_id"), F.to_json(F.struct(F.struct("counts").alias("count_over_time"))).alias("payload"))
    return news.mediacloud_timeline(raw, dt.date(2024, 1, 25)).select("snapshot_id", "interval_start", "matched", "monitored", "issue")


def taxonomy_rows(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("p_partkey")
    record = F.struct(
        F.concat(F.lit("https://openalex.example/fields/F"), n).alias("id"), F.when(n % 9 == 0, "  ").otherwise(F.concat(F.lit(" "), "p_name")).alias("display_name"), F.col("p_type").alias("description"),
        F.when(n % 4 != 0, n * 2).alias("works_count"),
    )
    return scholarly.taxonomy_rows(ps.responses(t.table(spark, sf, "part"), "p_partkey", record, "results"), "field")


def broken_payloads(spark: SparkSession, sf: str) -> DataFrame:
    """Every customer is a response; some are not JSON, some lack the list, some have it empty."""
    k = F.col("c_custkey")
    payload = F.when(k % 5 == 0, "oops").when(k % 7 == 0, '{"other":[]}').when(k % 11 == 0, '{"results":null}').when(k % 13 == 0, '{"results":[]}').otherwise('{"results":[{"id":"x"}]}')
    raw = t.table(spark, sf, "customer").select(F.concat(F.lit("snap-"), k).alias("snapshot_id"), payload.alias("payload"))
    return quarantine.broken_payloads(raw, scholarly.TAXONOMY, "results")


def field_coverage(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("doc_id")
    rows = t.table(spark, sf, "documents").select("doc_id", ev.field_coverage(F.when(d % 6 != 0, F.col("text")), 1500).alias("f"))
    return rows.select("doc_id", "f.*")


_SMALL = "abcdefghijklmnopqrstuvwxyz"


def excerpt_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Windows of the texts around a word from their middle, in capitals, or their start where it is missing."""
    word = F.translate(F.split_part(F.substring("text", F.floor(F.length("text") / 2).cast("int") + 1, F.length("text")), F.lit(" "), F.lit(2)), _SMALL, _SMALL.upper())
    names = F.array(F.when(F.col("doc_id") % 4 == 0, "¤¤").otherwise(F.when(F.length(word) > 2, word).otherwise("¤¤")), F.lit("¤"))
    return t.table(spark, sf, "documents").select("doc_id", F.sha2(ev.excerpt_window(F.col("text"), names), 256).alias("window"))


# Openings about the quote itself, as plain_explanation takes them off.
_OPENINGS = ["Цитата прямо подтверждает, что ", "Цитата сообщает о ", "цитата показывает ", "", "Цитата "]


def plain_explanations(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("p_partkey")
    text = F.concat(F.lit(" "), t.pick(_OPENINGS, p % 5), F.col("p_name"))
    return t.table(spark, sf, "part").select("p_partkey", ro.plain_explanation(text).alias("explanation"))


def benefit_claims(spark: SparkSession, sf: str) -> DataFrame:
    """Lines as claims; one in eleven states a benefit."""
    s = F.col("l_suppkey")
    rows = t.table(spark, sf, "lineitem").select(
        F.concat(F.lit("part-"), "l_partkey").alias("candidate_id"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("claim_id"),
        F.when(s % 11 == 0, "Метод ускоряет расчёт").otherwise("Метод описан").alias("explanation_ru"), F.when(s % 22 == 1, "It is MORE EFFICIENT").alias("quote"),
    )
    return ro.benefit_claim(rows)


_REASONS = [*crosswalk.NOISE_TYPE, "other_reason"]


def noise_types(spark: SparkSession, sf: str) -> DataFrame:
    reason = t.pick(_REASONS, F.col("p_size") % len(_REASONS))
    return t.table(spark, sf, "part").groupBy(crosswalk.renamed(reason, crosswalk.NOISE_TYPE).alias("noise_type")).agg(F.count(F.lit(1)).alias("proposals"))


def paired_triggers(spark: SparkSession, sf: str) -> DataFrame:
    """Every part paired with the next one: the best suggestion over their forms, or manual."""
    p = F.col("p_partkey")
    pairs = t.table(spark, sf, "part").select(F.concat(F.lit("part-"), p).alias("left_candidate_id"), F.concat(F.lit("part-"), p + 1).alias("right_candidate_id"))
    return idn.best_trigger(pairs, pe.corpora(spark, sf).select("candidate_id", "form"), pe.identity_suggestions(spark, sf))


QUERIES = {
    name: globals()[name]
    for name in ("media_timeline", "taxonomy_rows", "broken_payloads", "field_coverage", "excerpt_windows", "plain_explanations", "benefit_claims", "noise_types", "paired_triggers")
}

ORACLES = {
    "media_timeline": """WITH d AS (SELECT event_type, CAST(ts AS DATE) AS day, count(*) FILTER (value > 10) AS m, count(*) AS n, min(CAST(ts AS DATE)) = min(min(CAST(ts AS DATE))) OVER (PARTITION BY event_type) AS first FROM events GROUP BY 1, 2),
r AS (SELECT *, unnest(range(CASE WHEN first THEN 2 ELSE 1 END)) FROM d)
SELECT event_type AS snapshot_id, day AS interval_start, m AS matched, n AS monitored, CASE WHEN day > DATE '2024-01-25' THEN 'after_cutoff' WHEN first THEN 'duplicate_interval' END AS issue FROM r""",
    "taxonomy_rows": "SELECT 'F' || p_partkey AS taxonomy_id, 'field' AS level, trim(p_name) AS name, p_type AS description, CASE WHEN p_partkey % 4 <> 0 THEN p_partkey * 2 ELSE 0 END AS works_count FROM part WHERE p_partkey % 9 <> 0",
    "broken_payloads": "SELECT 'snap-' || c_custkey AS snapshot_id FROM customer WHERE c_custkey % 5 = 0 OR c_custkey % 7 = 0 OR c_custkey % 11 = 0",
    "field_coverage": """SELECT doc_id, doc_id % 6 <> 0 AND text IS NOT NULL AS available, CASE WHEN doc_id % 6 <> 0 THEN least(length(text), 1500) ELSE 0 END AS used_chars, CASE WHEN doc_id % 6 <> 0 THEN greatest(length(text) - 1500, 0) ELSE 0 END AS truncated_chars FROM documents""",
    "excerpt_windows": """WITH w AS (SELECT doc_id, text, translate(split_part(substr(text, CAST(floor(length(text) / 2) AS BIGINT) + 1), ' ', 2), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS word FROM documents),
n AS (SELECT *, CASE WHEN doc_id % 4 = 0 OR length(word) <= 2 THEN '¤¤' ELSE word END AS name FROM w), h AS (SELECT *, list_min(list_filter([strpos(lower(text), lower(name)), strpos(lower(text), '¤')], lambda x: x > 0)) AS hit FROM n)
SELECT doc_id, sha256(substr(text, greatest(1, coalesce(hit, 1) - 160), 700)) AS "window" FROM h""",
    "plain_explanations": """SELECT p_partkey, CASE p_partkey % 5 WHEN 1 THEN 'Есть сведения о ' || p_name ELSE upper(substr(p_name, 1, 1)) || substr(p_name, 2) END AS explanation FROM part""",
    "benefit_claims": "SELECT 'part-' || l_partkey AS candidate_id, min(l_orderkey || '-' || l_linenumber) AS claim_id FROM lineitem WHERE l_suppkey % 11 = 0 OR l_suppkey % 22 = 1 GROUP BY 1",
    "noise_types": f"""SELECT CASE p_size % {len(_REASONS)} {' '.join(f"WHEN {i} THEN '{kind}'" for i, kind in enumerate(crosswalk.NOISE_TYPE.values()))} END AS noise_type, count(*) AS proposals FROM part GROUP BY 1""",
    "paired_triggers": f"""WITH {pe._CORP.strip()},
b AS (SELECT l.candidate_id AS left_candidate_id, r.candidate_id AS right_candidate_id, s.trigger, s.token_jaccard FROM corp l JOIN corp r ON r.candidate_id = 'part-' || (CAST(substr(l.candidate_id, 6) AS BIGINT) + 1)
 JOIN sug s ON s.left_form = l.form AND s.right_form = r.form AND s.trigger IS NOT NULL)
SELECT 'part-' || p_partkey AS left_candidate_id, 'part-' || (p_partkey + 1) AS right_candidate_id, coalesce(b.trigger, 'manual') AS trigger, b.token_jaccard FROM part LEFT JOIN b ON b.left_candidate_id = 'part-' || p_partkey""",
}
