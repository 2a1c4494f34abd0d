"""Raw responses built from documents and pages, parsed back into documents and issue rows."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tenuis.functions import ids, urls
from tenuis.functions import text as tx
from tenuis.operators.ranking import first_row
from tenuis.plans import tables as t
from tenuis.sources import news, pages, quarantine, scholarly

RETRIEVED = dt.datetime(2026, 9, 16, 12, 0)
BATCH = 25
_SHOWN = ("document_id", "external_id", "title", "url", "canonical_url", "source_type", "language", "trust_tier", "origin_id", "published_at", "publisher")


def responses(rows: DataFrame, number: str, record: Column, root: str) -> DataFrame:
    """Responses of 25 records each, as JSON text."""
    batch = F.floor(F.col(number) / BATCH)
    packed = rows.groupBy(batch.alias("b")).agg(
        F.sort_array(F.collect_list(F.struct(F.col(number).alias("n"), F.to_json(record).alias("r")))).alias("rows")
    )
    records = F.array_join(F.transform("rows", lambda x: x["r"]), ",")
    return packed.select(
        F.concat(F.lit("snap-"), "b").alias("snapshot_id"), F.lit(RETRIEVED).alias("retrieved_at"),
        F.concat(F.lit('{"' + root + '":['), records, F.lit("]}")).alias("payload"),
    )


def openalex_raw(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("doc_id")
    rows = t.spread(t.table(spark, sf, "documents"), "doc_id").withColumn("title", F.split_part("text", F.lit("\n"), F.lit(1)))
    w = F.filter(F.split("title", " "), lambda x: x != "")
    places = rows.select("doc_id", F.posexplode(w).alias("i", "word")).groupBy("doc_id", "word").agg(F.collect_list("i").alias("at"))
    inverted = places.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("word", "at"))).alias("inverted"))
    rows = rows.join(inverted, "doc_id", "left")
    node = lambda kind: F.struct(F.concat(F.lit(f"https://openalex.org/{kind}s/"), n % 7).alias("id"), F.lit(kind).alias("display_name"))
    topic = F.struct(
        F.concat(F.lit("https://openalex.org/T"), n % 97).alias("id"), F.concat(F.lit("Topic "), n % 97).alias("display_name"),
        ((n % 11) / 10).alias("score"), node("subfield").alias("subfield"), node("field").alias("field"), node("domain").alias("domain"),
    )
    keyword = F.struct(
        F.concat(F.lit("https://openalex.org/keywords/k"), n % 31).alias("id"), F.get(w, F.lit(0)).alias("display_name"),
        F.when(n % 7 == 0, 1.5).otherwise(0.5).alias("score"),
    )
    record = F.struct(
        F.concat(F.when(n % 13 == 0, "https://openalex.org/X").otherwise("https://openalex.org/w"), n).alias("id"),
        F.when(n % 19 != 0, F.col("title")).alias("title"),
        F.when(n % 11 == 0, "2030-01-01").otherwise(F.date_add(F.lit(dt.date(2024, 9, 15)), (n % 700).cast("int")).cast("string")).alias("publication_date"),
        F.when(n % 3 == 0, F.concat(F.lit("https://doi.org/10.1000/ABC"), n)).alias("doi"),
        F.when(n % 2 == 0, "article").otherwise("dataset").alias("type"), F.upper("lang").alias("language"),
        F.array(
            F.struct(F.struct(F.col("source").alias("display_name")).alias("author"), F.array(F.struct(F.concat(F.lit(" Lab "), "lang").alias("display_name"))).alias("institutions")),
            F.struct(F.struct(F.upper("source").alias("display_name")).alias("author"), F.array(F.struct(F.concat(F.lit("LAB "), F.upper("lang")).alias("display_name"))).alias("institutions")),
        ).alias("authorships"),
        F.struct(F.concat(F.lit("https://journal.example.org/"), n).alias("landing_page_url"), F.struct(F.col("source").alias("display_name")).alias("source")).alias("primary_location"),
        F.col("inverted").alias("abstract_inverted_index"),
        F.array(topic).alias("topics"), topic.alias("primary_topic"), F.array(keyword).alias("keywords"),
    )
    return responses(rows, "doc_id", record, "results")


def openalex(spark: SparkSession, sf: str) -> DataFrame:
    return scholarly.openalex_records(openalex_raw(spark, sf), t.CUTOFF)


def openalex_documents(spark: SparkSession, sf: str) -> DataFrame:
    return quarantine.documents(openalex(spark, sf)).select(
        *_SHOWN, "doi", F.concat_ws("|", "authors").alias("authors"), F.concat_ws("|", "organizations").alias("organizations"), "excerpt"
    )


def openalex_issues(spark: SparkSession, sf: str) -> DataFrame:
    return quarantine.issues(openalex(spark, sf))


def openalex_hints(spark: SparkSession, sf: str) -> DataFrame:
    return scholarly.kept_hints(scholarly.openalex_hints(openalex(spark, sf)))


def openalex_hint_issues(spark: SparkSession, sf: str) -> DataFrame:
    return scholarly.hint_issues(scholarly.openalex_hints(openalex(spark, sf)))


def crossref(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("doc_id")
    rows = t.spread(t.table(spark, sf, "documents"), "doc_id")
    title = F.concat(F.lit("<i>"), F.split_part("text", F.lit("\n"), F.lit(1)), F.lit("</i> &amp; more"))
    day = F.array(F.array((F.lit(2020) + n % 9).cast("int"), (n % 14 + 1).cast("int"), F.lit(3)))
    record = F.struct(
        F.when(n % 13 == 0, "none").otherwise(F.concat(F.lit("DOI:10.1234/Z-"), n)).alias("DOI"),
        F.when(n % 17 == 0, F.array().cast("array<string>")).otherwise(F.array(title)).alias("title"),
        t.pick(["standard", "report", "journal-article", "component"], n % 4).alias("type"), F.col("lang").alias("language"),
        F.concat(F.lit("House "), "source").alias("publisher"), F.struct(day.alias("date-parts")).alias("published"),
        F.array(F.struct(F.lit("Ada").alias("given"), F.col("source").alias("family"), F.array(F.struct(F.concat(F.lit("Lab "), "lang").alias("name"))).alias("affiliation"))).alias("author"),
    )
    raw = responses(rows, "doc_id", record, "items").withColumn("payload", F.concat(F.lit('{"message":'), "payload", F.lit("}")))
    return scholarly.crossref_records(raw, t.CUTOFF)


def crossref_documents(spark: SparkSession, sf: str) -> DataFrame:
    return quarantine.documents(crossref(spark, sf)).select(*_SHOWN, F.concat_ws("|", "authors").alias("authors"), F.concat_ws("|", "organizations").alias("organizations"))


def crossref_issues(spark: SparkSession, sf: str) -> DataFrame:
    return quarantine.issues(crossref(spark, sf))


def gdelt(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("page_id")
    seen = F.when(n % 11 == 0, "20300101T000000Z").when(n % 4 == 0, "20260101T120000Z").when(n % 4 == 1, "2026-02-03T04:05:06Z").when(n % 4 == 2, "20260304050607").otherwise("yesterday")
    record = F.struct("url", F.concat(F.lit(" Page "), n).alias("title"), seen.alias("seendate"), F.when(n % 2 == 0, "News.Example").alias("domain"), t.pick(["English", "fr", "Klingon"], n % 3).alias("language"))
    return news.gdelt_records(responses(t.table(spark, sf, "pages"), "page_id", record, "articles"), t.CUTOFF)


def gdelt_documents(spark: SparkSession, sf: str) -> DataFrame:
    return quarantine.documents(gdelt(spark, sf)).select(*_SHOWN, F.col("observed_at").cast("date").alias("observed_on"))


def gdelt_issues(spark: SparkSession, sf: str) -> DataFrame:
    return quarantine.issues(gdelt(spark, sf)).groupBy("code").agg(F.count(F.lit(1)).alias("records"))


def mediacloud(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("page_id")
    day = F.when(n % 5 == 0, "").when(n % 7 == 0, "2027-01-01").when(n % 23 == 0, "soon").otherwise("2026-03-04")
    record = F.struct(
        F.when(n % 13 != 0, F.concat(F.lit("story-"), n)).alias("id"), "url", F.concat(F.lit("Page "), n).alias("title"), day.alias("publish_date"),
        F.when(n % 10 == 0, "2026-09-20T00:00:00Z").otherwise("2026-01-02T03:04:05Z").alias("indexed_date"), F.lit("Daily Example").alias("media_name"), F.lit("EN").alias("language"),
    )
    return news.mediacloud_records(responses(t.table(spark, sf, "pages"), "page_id", record, "stories"), t.CUTOFF)


def mediacloud_documents(spark: SparkSession, sf: str) -> DataFrame:
    return quarantine.documents(mediacloud(spark, sf)).select(*_SHOWN)


def mediacloud_issues(spark: SparkSession, sf: str) -> DataFrame:
    return quarantine.issues(mediacloud(spark, sf))


def exa(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("page_id")
    record = F.struct(
        F.concat(F.lit("exa-"), n).alias("id"), F.when(n % 9 != 0, F.col("url")).otherwise("ftp://x").alias("url"), F.concat(F.lit("Page "), n).alias("title"),
        F.when(n % 8 == 0, "2029-05-05T00:00:00Z").otherwise("2026-05-06T07:08:09.000Z").alias("publishedDate"), F.lit(" Ann ").alias("author"),
        F.array(F.lit(" one "), F.lit(" "), F.concat(F.lit("two "), n)).alias("highlights"),
    )
    return news.exa_records(responses(t.table(spark, sf, "pages"), "page_id", record, "results"), t.CUTOFF)


def exa_documents(spark: SparkSession, sf: str) -> DataFrame:
    return quarantine.documents(exa(spark, sf)).select(*_SHOWN, "excerpt")


def exa_issues(spark: SparkSession, sf: str) -> DataFrame:
    return quarantine.issues(exa(spark, sf))


def news_timeline(spark: SparkSession, sf: str) -> DataFrame:
    """One response per event type with its daily points."""
    events = t.table(spark, sf, "events").select(F.col("ts").cast("date").alias("day"), "event_type", "value")
    daily = events.groupBy("event_type", "day").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") > 10).alias("m"))
    points = daily.groupBy("event_type").agg(
        F.sort_array(F.collect_list(F.struct(F.date_format("day", "yyyyMMdd'T'000000'Z'").alias("date"), F.col("m").alias("value"), F.col("n").cast("string").alias("norm")))).alias("data")
    )
    raw = points.select(F.col("event_type").alias("snapshot_id"), F.lit(RETRIEVED).alias("retrieved_at"),
        F.to_json(F.struct(F.array(F.struct(F.lit("volume").alias("series"), "data")).alias("timeline"))).alias("payload"))
    rows = news.gdelt_timeline(raw, dt.date(2024, 1, 25))
    return rows.select("snapshot_id", F.col("interval_start").cast("date").alias("day"), "matched", "monitored", "issue")


def canonical_urls(spark: SparkSession, sf: str) -> DataFrame:
    glue = F.when(F.contains("url", F.lit("?")), "&").otherwise("?")
    base = F.regexp_replace("url", "#.*$", "")
    variant = F.concat(F.replace(base, F.lit("http://"), F.lit("HTTP://")), glue, F.lit("utm_medium=x&gclid=1&b=2&a=1"))
    return t.table(spark, sf, "pages").select("page_id", urls.canonical_url(F.col("url")).alias("canonical"), urls.canonical_url(variant).alias("variant"))


def source_policy(spark: SparkSession, sf: str) -> DataFrame:
    """Pages typed by host and path; every fourth host is swapped for a known one."""
    n = F.col("page_id")
    known = t.pick(["arxiv.org", "blog.nvidia.com", "www.prnewswire.com", "someone.medium.com", "www.nature.com"], n % 5)
    url = F.when(n % 4 == 0, F.concat(F.lit("https://"), known, F.lit("/articles/"), n)).otherwise(F.col("url"))
    return t.table(spark, sf, "pages").select("page_id", urls.source_policy(url).alias("p")).select("page_id", "p.*")


def best_web_copies(spark: SparkSession, sf: str) -> DataFrame:
    """Longest excerpt per candidate and canonical address of the web results that the policy takes; hosts as in source_policy."""
    n = F.col("page_id")
    known = t.pick(["arxiv.org", "blog.nvidia.com", "www.prnewswire.com", "someone.medium.com", "www.nature.com"], n % 5)
    url = F.when(n % 4 == 0, F.concat(F.lit("https://"), known, F.lit("/articles/"), F.floor(n / 100))).otherwise(F.col("url"))
    rows = t.table(spark, sf, "pages").select(
        F.concat(F.lit("cand-"), n % 7).alias("candidate_id"), F.concat(F.lit("page-"), n).alias("document_id"), urls.canonical_url(url).alias("address"), F.length("html").alias("excerpt_length"),
    )
    taken = rows.where(F.col("address").isNotNull() & urls.source_policy(F.col("address"))["eligible"]).withColumn("address", F.lower("address"))
    return first_row(taken, ["candidate_id", "address"], [F.col("excerpt_length").desc(), F.col("document_id").asc()])


def page_texts(spark: SparkSession, sf: str) -> DataFrame:
    return pages.page_texts(t.spread(t.table(spark, sf, "pages"), "page_id")).select("page_id", "status", "source", "truncated", F.length("text").alias("n_chars"), F.sha2("text", 256).alias("digest"))


def page_fetch_issues(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("page_id")
    rows = t.table(spark, sf, "pages").select(
        "page_id",
        pages.fetch_issue(
            F.when(n % 9 == 0, "kept text"), F.when(n % 8 != 0, F.when(n % 7 == 0, 404).otherwise(200)),
            F.octet_length("html") * F.when(n % 11 == 0, 1000).otherwise(1), F.when(n % 5 == 0, "application/pdf").otherwise("text/html; charset=utf-8"),
        ).alias("issue"),
        pages.charset(F.lit(None).cast("string"), F.substring("html", 1, 4096)).alias("charset"),
    )
    return rows


def dois(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("p_partkey")
    raw = F.concat(t.pick(["https://doi.org/", "http://dx.doi.org/", "DOI: ", "", "urn:"], n % 5), F.lit("10.5555/Part "), n)
    raw = F.when(n % 2 == 0, F.replace(raw, F.lit("Part "), F.lit("Part(A)+"))).otherwise(raw)
    doi = ids.normalize_doi(raw)
    return t.table(spark, sf, "part").select("p_partkey", doi.alias("doi"), ids.doi_url(doi).alias("doi_url"))


# Words that say nothing about a field.
GENERIC_QUERY_WORDS = ["application", "applications", "area", "areas", "domain", "domains", "research", "technology", "technologies"]


def taxonomy_scores(df: DataFrame, query: Column, name: Column) -> DataFrame:
    """Zero unless the name covers the query; one for equal words; else by the covered share."""
    q, c = tx.taxonomy_words(query, GENERIC_QUERY_WORDS), tx.taxonomy_words(name, GENERIC_QUERY_WORDS)
    out = df.withColumns({"_q": q, "_c": c})
    covered = (F.size("_q") > 0) & (F.size(F.array_except("_q", "_c")) == 0)
    score = F.when(~covered, 0.0).when(F.size("_q") == F.size("_c"), 1.0).otherwise(0.75 + 0.25 * F.size("_q") / F.size("_c"))
    return out.withColumn("score", score).drop("_q", "_c")


def taxonomy_match(spark: SparkSession, sf: str) -> DataFrame:
    """Every part name scored against the first word of the name plus a word to be ignored."""
    rows = t.table(spark, sf, "part").select("p_partkey", F.concat_ws(" ", F.split_part("p_name", F.lit(" "), F.lit(1)), F.lit("technology")).alias("query"), "p_name")
    return taxonomy_scores(rows, F.col("query"), F.col("p_name")).select("p_partkey", F.round("score", 6).alias("score"))


def taxonomy_pick(spark: SparkSession, sf: str) -> DataFrame:
    """Per query word the best name, if it reaches 0.82 and is 0.03 ahead of the runner-up."""
    parts = t.table(spark, sf, "part")
    names = parts.groupBy("p_name").agg(F.count(F.lit(1)).alias("works_count"))
    queries = parts.select(F.concat_ws(" ", "p_name", F.when(F.col("p_size") > 25, "research")).alias("query"), F.split_part("p_name", F.lit(" "), F.lit(1)).alias("w")).distinct()
    named = names.where(F.contains("p_name", F.lit(" "))).withColumn("w", F.split_part("p_name", F.lit(" "), F.lit(1)))
    pairs = queries.join(named, "w")
    scored = taxonomy_scores(pairs, F.col("query"), F.col("p_name"))
    order = W.partitionBy("query").orderBy(F.col("score").desc(), F.col("works_count").desc(), F.col("p_name"))
    best = scored.withColumns({"runner_up": F.lead("score").over(order), "place": F.row_number().over(order)}).where(F.col("place") == 1)
    sure = (F.col("score") >= 0.82) & (F.col("runner_up").isNull() | (F.col("score") - F.col("runner_up") >= 0.03))
    return best.where(sure).select("query", "p_name", "score")


QUERIES = {
    name: globals()[name]
    for name in (
        "openalex_documents", "openalex_issues", "openalex_hints", "openalex_hint_issues", "crossref_documents", "crossref_issues",
        "gdelt_documents", "gdelt_issues", "mediacloud_documents", "mediacloud_issues", "exa_documents", "exa_issues", "news_timeline",
        "canonical_urls", "source_policy", "best_web_copies", "page_texts", "page_fetch_issues", "dois", "taxonomy_match", "taxonomy_pick",
    )
}

_OA = """WITH w AS (SELECT *, 'snap-' || CAST(floor(doc_id / 25) AS BIGINT) AS snapshot_id, doc_id % 25 AS record_index, split_part(text, chr(10), 1) AS t0,
  CASE WHEN doc_id % 13 = 0 THEN 'X' ELSE 'W' END || doc_id AS external_id,
  CASE WHEN doc_id % 11 = 0 THEN DATE '2030-01-01' ELSE CAST(DATE '2024-09-15' + CAST(doc_id % 700 AS INT) AS DATE) END AS published_at FROM documents),
v AS (SELECT *, CASE WHEN doc_id % 13 = 0 THEN 'invalid_identifier' WHEN doc_id % 19 = 0 OR trim(t0) = '' THEN 'missing_title' WHEN doc_id % 11 = 0 THEN 'after_cutoff' END AS issue,
  'document-openalex-' || substr(sha256(snapshot_id || '|openalex|' || lower(external_id)), 1, 16) AS document_id FROM w)
"""
_URL = """CASE WHEN regexp_matches({u}, '^(?i)https?://') THEN lower(regexp_extract({u}, '^([^:]+)', 1)) || '://' || lower(regexp_extract({u}, '^[^:]+://([^/?#]*)', 1))
 || CASE WHEN regexp_extract({u}, '^[^:]+://[^/?#]*([^?#]*)', 1) IN ('', '/') THEN '/' ELSE regexp_replace(regexp_extract({u}, '^[^:]+://[^/?#]*([^?#]*)', 1), '/+$', '') END
 || CASE WHEN array_to_string(list_sort(list_filter(string_split(regexp_extract({u}, '\\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT starts_with(p, 'utm_') AND NOT starts_with(p, 'gclid='))), '&') = '' THEN ''
    ELSE '?' || array_to_string(list_sort(list_filter(string_split(regexp_extract({u}, '\\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT starts_with(p, 'utm_') AND NOT starts_with(p, 'gclid='))), '&') END END"""


def _url(expr: str) -> str:
    return _URL.replace("{u}", expr)


_PAGES = f"""WITH p AS (SELECT *, 'snap-' || CAST(floor(page_id / 25) AS BIGINT) AS snapshot_id, {_url('url')} AS canonical_url, lower(regexp_replace(regexp_extract(url, '^[^:]+://([^/?#]*)', 1), ':[0-9]+$', '')) AS h FROM pages)
"""

ORACLES = {
    "openalex_documents": _OA + """SELECT document_id, external_id, trim(t0) AS title, 'https://journal.example.org/' || doc_id AS url,
 CASE WHEN doc_id % 3 = 0 THEN 'https://doi.org/10.1000/abc' || doc_id ELSE 'https://journal.example.org/' || doc_id END AS canonical_url,
 CASE WHEN doc_id % 2 = 0 THEN 'scientific_publication' ELSE 'other' END AS source_type, lang AS language, CASE WHEN doc_id % 2 = 0 THEN 'A' ELSE 'unknown' END AS trust_tier,
 CASE WHEN doc_id % 3 = 0 THEN 'doi:10.1000/abc' || doc_id ELSE 'url:https://journal.example.org/' || doc_id END AS origin_id, published_at, source AS publisher,
 CASE WHEN doc_id % 3 = 0 THEN '10.1000/abc' || doc_id END AS doi, source AS authors, 'Lab ' || lang AS organizations, trim(regexp_replace(t0, ' +', ' ', 'g')) AS excerpt FROM v WHERE issue IS NULL""",
    "openalex_issues": _OA + "SELECT snapshot_id, record_index, external_id, issue AS code FROM v WHERE issue IS NOT NULL",
    "openalex_hints": _OA + """SELECT document_id, 'topic' AS kind, 'T' || (doc_id % 97) AS term_id, 'Topic ' || (doc_id % 97) AS name, (doc_id % 11) / 10 AS score, true AS primary_topic FROM v WHERE issue IS NULL AND doc_id % 7 <> 0
 UNION ALL SELECT document_id, 'keyword', 'k' || (doc_id % 31), split_part(ltrim(t0), ' ', 1), 0.5, false FROM v WHERE issue IS NULL AND doc_id % 7 <> 0""",
    "openalex_hint_issues": _OA + "SELECT document_id, external_id FROM v WHERE issue IS NULL AND doc_id % 7 = 0",
    "crossref_issues": """SELECT 'snap-' || CAST(floor(doc_id / 25) AS BIGINT) AS snapshot_id, doc_id % 25 AS record_index, CASE WHEN doc_id % 13 <> 0 THEN '10.1234/z-' || doc_id END AS external_id, code FROM (
 SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN 'invalid_identifier' WHEN doc_id % 17 = 0 THEN 'missing_title' WHEN doc_id % 14 + 1 > 12 THEN 'invalid_record'
  WHEN (2020 + doc_id % 9) * 100 + doc_id % 14 + 1 > 202609 THEN 'after_cutoff' END AS code FROM documents) WHERE code IS NOT NULL""",
    "gdelt_issues": "SELECT code, count(*) AS records FROM (SELECT CASE WHEN page_id % 11 = 0 THEN 'after_cutoff' WHEN page_id % 4 = 3 THEN 'invalid_observation_time' END AS code FROM pages) WHERE code IS NOT NULL GROUP BY 1",
    "gdelt_documents": _PAGES + """, g AS (SELECT *, substr(sha256(canonical_url), 1, 24) AS external_id FROM p WHERE page_id % 11 <> 0 AND page_id % 4 <> 3)
SELECT 'document-gdelt-' || substr(sha256(snapshot_id || '|gdelt|' || external_id), 1, 16) AS document_id, external_id, 'Page ' || page_id AS title, url, canonical_url, 'other' AS source_type,
 (['en','fr','und'])[page_id % 3 + 1] AS language, 'unknown' AS trust_tier, 'url:' || canonical_url AS origin_id, CAST(NULL AS DATE) AS published_at,
 CASE WHEN page_id % 2 = 0 THEN 'news.example' ELSE h END AS publisher,
 CASE page_id % 4 WHEN 0 THEN DATE '2026-01-01' WHEN 1 THEN DATE '2026-02-03' ELSE DATE '2026-03-04' END AS observed_on FROM g""",
    "mediacloud_issues": """SELECT 'snap-' || CAST(floor(page_id / 25) AS BIGINT) AS snapshot_id, page_id % 25 AS record_index, CASE WHEN page_id % 13 <> 0 THEN 'story-' || page_id END AS external_id, code FROM (SELECT page_id,
 CASE WHEN page_id % 13 = 0 THEN 'invalid_identifier' WHEN page_id % 5 <> 0 AND page_id % 7 = 0 THEN 'after_cutoff' WHEN page_id % 5 <> 0 AND page_id % 23 = 0 THEN 'invalid_publication_date'
  WHEN page_id % 10 = 0 THEN 'after_cutoff' END AS code FROM pages) WHERE code IS NOT NULL""",
    "mediacloud_documents": _PAGES + """SELECT 'document-mediacloud-' || substr(sha256(snapshot_id || '|mediacloud|story-' || page_id), 1, 16) AS document_id, 'story-' || page_id AS external_id, 'Page ' || page_id AS title, url, canonical_url,
 'other' AS source_type, 'en' AS language, 'unknown' AS trust_tier, 'url:' || canonical_url AS origin_id, CASE WHEN page_id % 5 <> 0 THEN DATE '2026-03-04' END AS published_at, 'daily example' AS publisher
 FROM p WHERE page_id % 13 <> 0 AND NOT (page_id % 5 <> 0 AND (page_id % 7 = 0 OR page_id % 23 = 0)) AND page_id % 10 <> 0""",
    "exa_documents": _PAGES + """SELECT 'document-exa-' || substr(sha256(snapshot_id || '|exa|exa-' || page_id), 1, 16) AS document_id, 'exa-' || page_id AS external_id, 'Page ' || page_id AS title, url, canonical_url,
 'industry_media' AS source_type, 'und' AS language, 'unknown' AS trust_tier, 'url:' || canonical_url AS origin_id, DATE '2026-05-06' AS published_at, h AS publisher, 'one' || chr(10) || chr(10) || 'two ' || page_id AS excerpt
 FROM p WHERE page_id % 9 <> 0 AND page_id % 8 <> 0""",
    "exa_issues": "SELECT 'snap-' || CAST(floor(page_id / 25) AS BIGINT) AS snapshot_id, page_id % 25 AS record_index, 'exa-' || page_id AS external_id, CASE WHEN page_id % 9 = 0 THEN 'invalid_identifier' ELSE 'after_cutoff' END AS code FROM pages WHERE page_id % 9 = 0 OR page_id % 8 = 0",
    "news_timeline": "SELECT event_type AS snapshot_id, CAST(ts AS DATE) AS day, count(*) FILTER (value > 10) AS matched, count(*) AS monitored, CASE WHEN CAST(ts AS DATE) > DATE '2024-01-25' THEN 'after_cutoff' END AS issue FROM events GROUP BY ALL",
    "canonical_urls": f"""WITH v AS (SELECT page_id, url, replace(regexp_replace(url, '#.*$', ''), 'http://', 'HTTP://') || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'utm_medium=x&gclid=1&b=2&a=1' AS u2 FROM pages)
SELECT page_id, {_url('url')} AS canonical, {_url('u2')} AS variant FROM v""",
    "source_policy": """SELECT page_id, CASE WHEN page_id % 4 = 0 THEN page_id % 5 IN (1, 2, 3) ELSE true END AS eligible,
 CASE WHEN page_id % 4 <> 0 THEN 'industry_media' ELSE (['scientific_publication','company_technical','press_release','social_or_blog','scientific_publication'])[page_id % 5 + 1] END AS source_type,
 CASE WHEN page_id % 4 <> 0 THEN 'web_news_or_trade_source' ELSE (['academic_domain','company_domain','press_release_domain','social_or_blog_domain','journal_article_path'])[page_id % 5 + 1] END AS reason FROM pages""",
    "best_web_copies": f"""WITH raw AS (SELECT page_id, length(html) AS excerpt_length, CASE WHEN page_id % 4 = 0
 THEN 'https://' || (['arxiv.org','blog.nvidia.com','www.prnewswire.com','someone.medium.com','www.nature.com'])[page_id % 5 + 1] || '/articles/' || CAST(floor(page_id / 100) AS BIGINT) ELSE url END AS u FROM pages),
w AS (SELECT 'cand-' || (page_id % 7) AS candidate_id, 'page-' || page_id AS document_id, lower({_url('u')}) AS address, excerpt_length FROM raw WHERE page_id % 4 <> 0 OR page_id % 5 IN (1, 2, 3))
SELECT * FROM w WHERE address IS NOT NULL QUALIFY row_number() OVER (PARTITION BY candidate_id, address ORDER BY excerpt_length DESC, document_id) = 1""",
    "page_fetch_issues": """SELECT page_id, CASE WHEN page_id % 9 = 0 THEN 'existing_excerpt' WHEN page_id % 8 = 0 THEN 'not_fetched' WHEN page_id % 7 = 0 THEN 'http_error'
 WHEN strlen(html) * CASE WHEN page_id % 11 = 0 THEN 1000 ELSE 1 END > 2000000 THEN 'too_large' WHEN page_id % 5 = 0 THEN 'not_html' END AS issue,
 coalesce(nullif(lower(regexp_extract(substr(html, 1, 4096), '(?i)charset\\s*=\\s*[''"]?([a-zA-Z0-9._-]+)', 1)), ''), 'utf-8') AS charset FROM pages""",
    "dois": """SELECT p_partkey, CASE WHEN p_partkey % 5 <> 4 AND p_partkey % 2 = 0 THEN '10.5555/part(a)+' || p_partkey END AS doi,
 CASE WHEN p_partkey % 5 <> 4 AND p_partkey % 2 = 0 THEN 'https://doi.org/10.5555/part(a)%2B' || p_partkey END AS doi_url FROM part""",
    "crossref_documents": """WITH c AS (SELECT doc_id, source, lang, 'snap-' || CAST(floor(doc_id / 25) AS BIGINT) AS snapshot_id, '10.1234/z-' || doc_id AS doi, CASE WHEN doc_id % 14 < 12 THEN make_date(CAST(2020 + doc_id % 9 AS BIGINT), CAST(doc_id % 14 + 1 AS BIGINT), 3) END AS published_at,
 trim(regexp_replace(split_part(text, chr(10), 1) || ' & more', '\\s+', ' ', 'g')) AS title FROM documents WHERE doc_id % 13 <> 0 AND doc_id % 17 <> 0 AND doc_id % 14 < 12)
SELECT 'document-crossref-' || substr(sha256(snapshot_id || '|crossref|' || doi), 1, 16) AS document_id, doi AS external_id, title, 'https://doi.org/' || doi AS url, 'https://doi.org/' || doi AS canonical_url,
 (['standard','analytical_report','scientific_publication','other'])[doc_id % 4 + 1] AS source_type, lang AS language, (['A','B','A','unknown'])[doc_id % 4 + 1] AS trust_tier, 'doi:' || doi AS origin_id, published_at, 'House ' || source AS publisher,
 'Ada ' || source AS authors, 'Lab ' || lang AS organizations FROM c WHERE published_at <= DATE '2026-09-15'""",
    "taxonomy_pick": """WITH n AS (SELECT p_name, count(*) AS works FROM part GROUP BY 1),
q AS (SELECT DISTINCT p_name || CASE WHEN p_size > 25 THEN ' research' ELSE '' END AS query, split_part(p_name, ' ', 1) AS w FROM part),
words AS (SELECT q.query, n.p_name, works, list_distinct(list_filter(regexp_extract_all(lower(q.query), '[a-z0-9]+'), lambda x: x <> 'research')) AS qw, list_distinct(regexp_extract_all(lower(n.p_name), '[a-z0-9]+')) AS cw
 FROM q JOIN n ON contains(n.p_name, ' ') AND split_part(n.p_name, ' ', 1) = w),
s AS (SELECT query, p_name, works, CASE WHEN len(qw) = 0 OR NOT list_has_all(cw, qw) THEN 0.0 WHEN len(qw) = len(cw) THEN 1.0 ELSE 0.75 + 0.25 * len(qw) / len(cw) END AS score FROM words),
r AS (SELECT *, lead(score) OVER o AS second, row_number() OVER o AS place FROM s WINDOW o AS (PARTITION BY query ORDER BY score DESC, works DESC, p_name))
SELECT query, p_name, CAST(score AS DOUBLE) AS score FROM r WHERE place = 1 AND score >= 0.82 AND (second IS NULL OR score - second >= 0.03)""",
    "taxonomy_match": "SELECT p_partkey, CASE WHEN contains(p_name, ' ') THEN 0.875 ELSE 1.0 END AS score FROM part",
}
