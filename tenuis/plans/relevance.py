"""Which documents support each candidate: scoring, copies, shortlists, coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenuis.operators import relevance as rel
from tenuis.operators import selection as sel
from tenuis.plans import tables as t
from tenuis.session import stored

PLAN_CYCLE = ("previous", "recent", "unknown_date")
EVIDENCE_CYCLE = ("recent", "previous", "unknown_date")
_DOC_COLUMNS = (
    "document_id", "connector", "trust_tier", "published_at", "publisher", "excerpt_length",
    "origin_id", "url", "time_window", "document_identity",
)


def scored(spark: SparkSession, sf: str, docs: DataFrame | None = None) -> DataFrame:
    docs = t.stored_documents(spark, sf) if docs is None else docs
    cands = t.candidates(spark, sf)
    return rel.score_links(t.links(spark, sf, docs, cands), docs, rel.term_rows(cands))


def ranked(spark: SparkSession, sf: str, docs: DataFrame | None = None) -> DataFrame:
    docs = t.stored_documents(spark, sf) if docs is None else docs
    return scored(spark, sf, docs).join(docs.select(*_DOC_COLUMNS), "document_id")


def kept(spark: SparkSession, sf: str, docs: DataFrame | None = None) -> DataFrame:
    return rel.best_copy(ranked(spark, sf, docs))


def relevance_scores(spark: SparkSession, sf: str) -> DataFrame:
    return scored(spark, sf).select(
        "candidate_id", "document_id", F.col("term").alias("matched_term"), "score", "reason",
        F.concat_ws(",", "matched_tokens").alias("matched"),
        F.concat_ws(",", "term_tokens").alias("wanted"), "relevance_class",
    )


def best_document_copies(spark: SparkSession, sf: str) -> DataFrame:
    return kept(spark, sf).select(
        "candidate_id", "document_identity", "document_id", "score", "relevance_class",
        "connector", "time_window",
    )


def dropped_document_copies(spark: SparkSession, sf: str) -> DataFrame:
    rows = stored(ranked(spark, sf).select("candidate_id", "score", *_DOC_COLUMNS), "ranked")
    return rel.dropped_copies(rows, rel.best_copy(rows))


def evidence_documents(spark: SparkSession, sf: str) -> DataFrame:
    rows = kept(spark, sf).withColumn(
        "source_class",
        F.when(F.col("connector") == "openalex", "scientific").otherwise("industry"),
    )
    return sel.evidence_documents(rows).select(
        "candidate_id", "source_class", "document_id", "score", "final_rank"
    )


def science_shortlist(spark: SparkSession, sf: str) -> DataFrame:
    return sel.science_shortlist(kept(spark, sf), PLAN_CYCLE)


def media_fetch_queue(spark: SparkSession, sf: str) -> DataFrame:
    return sel.media_fetch_queue(kept(spark, sf), PLAN_CYCLE)


def relevance_coverage(spark: SparkSession, sf: str) -> DataFrame:
    rows = stored(ranked(spark, sf).select("candidate_id", "score", "relevance_class", *_DOC_COLUMNS), "ranked")
    best = stored(rel.best_copy(rows), "kept")
    science = sel.science_shortlist(best, PLAN_CYCLE)
    media = sel.media_fetch_queue(best, PLAN_CYCLE)
    return rel.relevance_coverage(t.candidates(spark, sf), rows, best, science, media)


def media_scores(spark: SparkSession, sf: str) -> DataFrame:
    docs, cands = t.stored_documents(spark, sf), t.candidates(spark, sf)
    news = docs.where(F.col("connector") == "mediacloud")
    rows = rel.score_media(t.links(spark, sf, news, cands), news, rel.term_rows(cands))
    return rel.media_admission(rows).select(
        "candidate_id", "document_id", F.col("term").alias("matched_term"), "score", "reason",
        "width", "relevance_class", "admitted", "exclusion",
    )


def science_admission(spark: SparkSession, sf: str) -> DataFrame:
    docs = t.stored_documents(spark, sf)
    rows = kept(spark, sf, docs).where((F.col("connector") == "openalex") & (F.col("excerpt_length") > 0))
    return rel.science_admission(stored(rows, "kept"), docs).select(
        "candidate_id", "document_id", "score", "relevance_class", "title_matches",
        "excerpt_window", "admitted", "exclusion",
    )


def evidence_input(spark: SparkSession, sf: str) -> DataFrame:
    """Admitted science, then admitted media up to the room science leaves, interleaved to six."""
    docs, cands = t.stored_documents(spark, sf), t.candidates(spark, sf)
    rows = stored(kept(spark, sf, docs), "kept")
    science_rows = rel.science_admission(
        rows.where((F.col("connector") == "openalex") & (F.col("excerpt_length") > 0)), docs
    ).where("admitted")
    science = sel.science_shortlist(science_rows, EVIDENCE_CYCLE)
    media_rows = (
        rel.media_admission(
            rel.score_media(
                rows.where(F.col("connector") == "mediacloud").select("candidate_id", "document_id"),
                docs, rel.term_rows(cands),
            )
        )
        .where("admitted")
        .join(docs.select(*_DOC_COLUMNS), "document_id")
    )
    filled = science.groupBy("candidate_id").agg(F.count(F.lit(1)).alias("n"))
    media_rows = media_rows.join(filled, "candidate_id", "left").withColumn(
        "room", sel.media_capacity(F.coalesce(F.col("n"), F.lit(0)))
    )
    media = sel.select_diverse(
        media_rows, ("strong", "weak"), EVIDENCE_CYCLE, 4, by_publisher=True, capacity="room"
    )
    return sel.interleave(science, media, 6)


QUERIES = {
    "relevance_scores": relevance_scores,
    "best_document_copies": best_document_copies,
    "dropped_document_copies": dropped_document_copies,
    "evidence_documents": evidence_documents,
    "science_shortlist": science_shortlist,
    "media_fetch_queue": media_fetch_queue,
    "relevance_coverage": relevance_coverage,
    "media_scores": media_scores,
    "science_admission": science_admission,
    "evidence_input": evidence_input,
}

_COUNTS = ", ".join(
    f"count(*) FILTER (connector = '{c}' AND relevance_class = '{k}') AS {c}_{k}"
    for c in ("openalex", "mediacloud") for k in ("strong", "weak", "none")
) + ", " + ", ".join(
    f"count(*) FILTER (time_window = '{w}') AS window_{w}"
    for w in ("previous", "recent", "unknown_date")
)
_ZEROS = ", ".join(
    f"coalesce({name}, 0) AS {name}"
    for name in [f"{c}_{k}" for c in ("openalex", "mediacloud") for k in ("strong", "weak", "none")]
    + [f"window_{w}" for w in ("previous", "recent", "unknown_date")] + ["openalex_with_excerpt"]
)

ORACLES = {
    "relevance_scores": f"""{t.BASE_SQL}
SELECT candidate_id, document_id, term AS matched_term, score, reason,
       array_to_string(matched, ',') AS matched, array_to_string(toks, ',') AS wanted, relevance_class
FROM scored""",
    "best_document_copies": f"""{t.BASE_SQL}
SELECT candidate_id, document_identity, document_id, score, relevance_class, connector, time_window FROM kept""",
    "dropped_document_copies": f"""{t.BASE_SQL}
SELECT r.candidate_id, r.document_identity, r.document_id, k.document_id AS kept_document_id
FROM ranked r JOIN kept k USING (candidate_id, document_identity) WHERE r.document_id <> k.document_id""",
    "evidence_documents": f"""{t.BASE_SQL},
src AS (SELECT *, CASE WHEN connector = 'openalex' THEN 'scientific' ELSE 'industry' END AS source_class,
        list_position(['A','B','C','D'], trust_tier) AS tr FROM kept WHERE score >= 30),
one AS (SELECT * FROM src QUALIFY row_number() OVER (PARTITION BY candidate_id, source_class, origin_id
   ORDER BY score DESC, coalesce(tr, 5), published_at DESC NULLS LAST, document_id) = 1),
rk AS (SELECT *, row_number() OVER (PARTITION BY candidate_id, source_class
   ORDER BY score DESC, coalesce(tr, 5), published_at DESC NULLS LAST, document_id) AS r FROM one),
sel AS (SELECT * FROM rk WHERE (score >= 40 AND r <= 3) OR (score < 40 AND r <= 2))
SELECT candidate_id, source_class, document_id, score,
       row_number() OVER (PARTITION BY candidate_id ORDER BY r, source_class DESC) AS final_rank FROM sel""",
    "relevance_coverage": f"""{t.BASE_SQL},
agg AS (SELECT candidate_id, count(*) AS links_kept, {_COUNTS},
   count(*) FILTER (connector = 'openalex' AND excerpt_length > 0) AS openalex_with_excerpt,
   least(4, count(*) FILTER (connector = 'openalex' AND excerpt_length > 0 AND relevance_class <> 'none')) AS science_selected,
   least(4, count(*) FILTER (connector = 'mediacloud' AND trim(url) <> '')) AS media_selected
   FROM kept GROUP BY candidate_id),
fnd AS (SELECT candidate_id, count(*) AS links_found FROM ranked GROUP BY candidate_id),
j AS (SELECT c.candidate_id, coalesce(links_found, 0) AS links_found, coalesce(links_kept, 0) AS links_kept, {_ZEROS},
   coalesce(science_selected, 0) AS science_selected, coalesce(media_selected, 0) AS media_selected
   FROM cands c LEFT JOIN fnd USING (candidate_id) LEFT JOIN agg USING (candidate_id))
SELECT *, concat_ws(',',
   CASE WHEN openalex_strong + openalex_weak + openalex_none = 0 THEN 'scientific:no_openalex_links'
        WHEN openalex_with_excerpt = 0 THEN 'scientific:no_openalex_with_excerpt'
        WHEN science_selected = 0 THEN 'scientific:no_strong_or_weak_openalex' END,
   CASE WHEN mediacloud_strong + mediacloud_weak + mediacloud_none = 0 THEN 'media:no_media_links'
        WHEN media_selected = 0 THEN 'media:no_media_with_url' END) AS empty_reasons FROM j""",
}
