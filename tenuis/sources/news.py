"""News and web responses to documents and timelines."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenuis.functions import ids
from tenuis.functions.dates import news_timestamp, whole_count
from tenuis.functions.urls import canonical_url, host
from tenuis.sources.quarantine import after, explode_records, first_issue, leaks

GDELT = "articles ARRAY<STRUCT<url: STRING, title: STRING, seendate: STRING, domain: STRING, language: STRING>>"
GDELT_TIMELINE = "timeline ARRAY<STRUCT<series: STRING, data: ARRAY<STRUCT<date: STRING, value: STRING, norm: STRING>>>>"
MEDIACLOUD = """stories ARRAY<STRUCT<id: STRING, url: STRING, title: STRING, publish_date: STRING, indexed_date: STRING,
 media_name: STRING, media_url: STRING, language: STRING>>"""
MEDIACLOUD_TIMELINE = "count_over_time STRUCT<counts: ARRAY<STRUCT<date: STRING, count: STRING, total_count: STRING>>>"
EXA = "results ARRAY<STRUCT<id: STRING, url: STRING, title: STRING, publishedDate: STRING, author: STRING, highlights: ARRAY<STRING>>>"

# Language names of article feeds.
LANGUAGES = {
    "arabic": "ar", "chinese": "zh", "english": "en", "french": "fr", "german": "de", "italian": "it",
    "japanese": "ja", "korean": "ko", "portuguese": "pt", "russian": "ru", "spanish": "es",
}


def language_code(value: Column, names: dict[str, str]) -> Column:
    text = F.lower(ids.filled(value))
    out = F.when(text.rlike(r"^\p{L}{2,3}$"), text)
    for name, code in names.items():
        out = out.when(text == name, code)
    return F.coalesce(out, F.lit("und"))


def _web(rows: DataFrame, connector: str, external: Column, url: Column, title: Column) -> DataFrame:
    rows = rows.withColumns({"external_id": external, "canonical_url": canonical_url(url)})
    return rows.withColumns(
        {
            "title": ids.filled(title), "url": ids.filled(url), "connector_id": F.lit(connector),
            "document_id": ids.digest_id(f"document-{connector}-", F.col("snapshot_id"), F.lit(connector), F.col("external_id")),
            "origin_id": F.concat(F.lit("url:"), F.col("canonical_url")), "origin_method": F.lit("canonical_url"),
            "source_type": F.lit("other"), "trust_tier": F.lit("unknown"),
        }
    )


def gdelt_records(raw: DataFrame, cutoff: dt.date) -> DataFrame:
    """Articles carry only a first-seen time, never a publication date."""
    r = F.col("r")
    rows = explode_records(raw, GDELT, "articles").withColumn("observed_at", news_timestamp(r["seendate"]))
    external = F.substring(F.sha2(canonical_url(r["url"]), 256), 1, 24)
    rows = _web(rows, "gdelt", external, r["url"], r["title"])
    return rows.withColumns(
        {
            "issue": first_issue(
                (F.col("canonical_url").isNull(), "invalid_identifier"),
                (F.col("title").isNull(), "missing_title"),
                (F.col("observed_at").isNull(), "invalid_observation_time"),
                (after(F.col("observed_at").cast("date"), cutoff), "after_cutoff"),
            ),
            "language": language_code(r["language"], LANGUAGES),
            "publisher": F.coalesce(F.lower(ids.filled(r["domain"])), host(r["url"])),
        }
    )


def mediacloud_records(raw: DataFrame, cutoff: dt.date) -> DataFrame:
    """The indexing time dates a story only when no publication date is known."""
    r = F.col("r")
    given = ids.filled(r["publish_date"])
    rows = explode_records(raw, MEDIACLOUD, "stories").withColumns(
        {
            "published_at": F.try_to_date(F.substring(given, 1, 10), "yyyy-MM-dd"),
            "observed_at": ids.filled(r["indexed_date"]).try_cast("timestamp"),
        }
    )
    rows = _web(rows, "mediacloud", ids.filled(r["id"]), r["url"], r["title"])
    return rows.withColumns(
        {
            "issue": first_issue(
                (F.col("external_id").isNull() | F.col("canonical_url").isNull(), "invalid_identifier"),
                (F.col("title").isNull(), "missing_title"),
                (given.isNotNull() & F.col("published_at").isNull(), "invalid_publication_date"),
                (after(F.col("published_at"), cutoff), "after_cutoff"),
                (F.col("observed_at").isNull(), "invalid_observation_time"),
                (leaks(F.col("published_at"), F.col("observed_at"), cutoff), "after_cutoff"),
            ),
            "language": language_code(r["language"], {}),
            "publisher": F.lower(F.coalesce(ids.filled(r["media_name"]), ids.filled(r["media_url"]))),
        }
    )


def exa_records(raw: DataFrame, cutoff: dt.date) -> DataFrame:
    r = F.col("r")
    given = F.nullif(r["publishedDate"], F.lit(""))
    rows = explode_records(raw, EXA, "results").withColumn(
        "published_at", F.try_to_date(F.substring(F.trim(given), 1, 10), "yyyy-MM-dd")
    )
    rows = _web(rows, "exa", ids.filled(r["id"]), r["url"], r["title"])
    parts = F.filter(F.transform(r["highlights"], ids.filled), lambda h: h.isNotNull())
    return rows.withColumns(
        {
            "issue": first_issue(
                (F.col("external_id").isNull() | F.col("canonical_url").isNull(), "invalid_identifier"),
                (F.col("title").isNull(), "missing_title"),
                (given.isNotNull() & F.col("published_at").isNull(), "invalid_publication_date"),
                (after(F.col("published_at"), cutoff), "after_cutoff"),
            ),
            "source_type": F.lit("industry_media"), "language": F.lit("und"), "observed_at": F.col("retrieved_at"),
            "publisher": F.nullif(host(F.col("canonical_url")), F.lit("")),
            "authors": F.when(ids.filled(r["author"]).isNotNull(), F.array(F.trim(r["author"]))),
            "excerpt": F.nullif(F.array_join(parts, "\n\n"), F.lit("")),
        }
    )


def timeline_points(points: DataFrame, cutoff: dt.date) -> DataFrame:
    """Interval counts with the first failed rule: bad date or count, after the cutoff, repeated."""
    repeated = points.groupBy("snapshot_id", "interval_start").agg(F.count(F.lit(1)).alias("_n"))
    rows = points.join(repeated, ["snapshot_id", "interval_start"], "left")
    return rows.withColumn(
        "issue",
        first_issue(
            (F.col("interval_start").isNull(), "invalid_interval"),
            (after(F.col("interval_start").cast("date"), cutoff), "after_cutoff"),
            (F.col("matched").isNull() | F.col("monitored").isNull(), "invalid_count"),
            (F.col("_n") > 1, "duplicate_interval"),
        ),
    ).drop("_n")


def gdelt_timeline(raw: DataFrame, cutoff: dt.date) -> DataFrame:
    """Only the first series of a response counts."""
    parsed = raw.select("snapshot_id", F.get(F.from_json("payload", GDELT_TIMELINE)["timeline"], F.lit(0)).alias("s"))
    points = parsed.select("snapshot_id", F.explode("s.data").alias("p")).select(
        "snapshot_id", news_timestamp(F.col("p.date")).alias("interval_start"),
        whole_count(F.col("p.value")).alias("matched"), whole_count(F.col("p.norm")).alias("monitored"),
    )
    return timeline_points(points, cutoff)


def mediacloud_timeline(raw: DataFrame, cutoff: dt.date) -> DataFrame:
    parsed = raw.select("snapshot_id", F.explode(F.from_json("payload", MEDIACLOUD_TIMELINE)["count_over_time"]["counts"]).alias("p"))
    points = parsed.select(
        "snapshot_id", F.try_to_date(F.substring(F.trim("p.date"), 1, 10), "yyyy-MM-dd").alias("interval_start"),
        whole_count(F.col("p.count")).alias("matched"), whole_count(F.col("p.total_count")).alias("monitored"),
    )
    return timeline_points(points, cutoff)
