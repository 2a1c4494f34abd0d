"""Publication responses to documents: works with inverted abstracts and works with date parts."""

from __future__ import annotations

import datetime as dt
import html

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenuis.functions import ids
from tenuis.functions.dates import iso_date
from tenuis.functions.text import first_spelling
from tenuis.functions.urls import is_http
from tenuis.sources.quarantine import after, explode_records, first_issue

_NODE = "STRUCT<id: STRING, display_name: STRING>"
_TOPIC = f"STRUCT<id: STRING, display_name: STRING, score: DOUBLE, subfield: {_NODE}, field: {_NODE}, domain: {_NODE}>"
OPENALEX = f"""results ARRAY<STRUCT<id: STRING, title: STRING, display_name: STRING, publication_date: STRING, doi: STRING,
 type: STRING, language: STRING,
 authorships: ARRAY<STRUCT<author: STRUCT<display_name: STRING>, institutions: ARRAY<STRUCT<display_name: STRING>>>>,
 primary_location: STRUCT<landing_page_url: STRING, source: STRUCT<display_name: STRING>>,
 abstract_inverted_index: MAP<STRING, ARRAY<INT>>, topics: ARRAY<{_TOPIC}>, primary_topic: {_TOPIC},
 keywords: ARRAY<STRUCT<id: STRING, display_name: STRING, score: DOUBLE>>>>"""
_PARTS = "STRUCT<`date-parts`: ARRAY<ARRAY<INT>>>"
CROSSREF = f"""message STRUCT<items: ARRAY<STRUCT<DOI: STRING, title: ARRAY<STRING>, subtitle: ARRAY<STRING>, URL: STRING,
 type: STRING, language: STRING, publisher: STRING, abstract: STRING, published: {_PARTS}, `published-online`: {_PARTS},
 `published-print`: {_PARTS}, issued: {_PARTS},
 author: ARRAY<STRUCT<name: STRING, given: STRING, family: STRING, affiliation: ARRAY<STRUCT<name: STRING>>>>>>>"""

# Work types that count as scientific publications.
OPENALEX_SCIENTIFIC = [
    "article", "book", "book-chapter", "dissertation", "editorial", "letter", "peer-review", "preprint", "report", "review",
]
CROSSREF_SCIENTIFIC = [
    "book", "book-chapter", "book-part", "book-section", "book-series", "dissertation", "edited-book",
    "journal-article", "monograph", "peer-review", "posted-content", "proceedings", "proceedings-article",
    "reference-book", "reference-entry",
]


def abstract_text(index: Column) -> Column:
    """Words of an inverted index in the order of their positions."""
    pairs = F.flatten(
        F.transform(
            F.map_entries(index),
            lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("position"), e["key"].alias("word"))),
        )
    )
    return ids.filled(F.array_join(F.transform(F.array_sort(pairs), lambda p: p["word"]), " "))


def abstract_invalid(index: Column) -> Column:
    """Repeated or negative positions, or blank words."""
    places = F.flatten(F.map_values(index))
    return (
        (F.size(F.array_distinct(places)) != F.size(places))
        | F.exists(places, lambda p: p.isNull() | (p < 0))
        | F.exists(F.map_keys(index), lambda w: F.trim(w) == "")
    )


def _last_part(url: Column) -> Column:
    return F.regexp_extract(url, r"([^/]+)/*$", 1)


def _names(values: Column) -> Column:
    return first_spelling(F.filter(F.transform(values, ids.filled), lambda n: n.isNotNull()))


def openalex_records(raw: DataFrame, cutoff: dt.date) -> DataFrame:
    rows = explode_records(raw, OPENALEX, "results")
    r = F.col("r")
    title = F.coalesce(ids.filled(r["title"]), ids.filled(r["display_name"]))
    external = F.upper(_last_part(r["id"]))
    published = iso_date(r["publication_date"])
    doi = ids.normalize_doi(r["doi"])
    landing = F.when(is_http(r["primary_location"]["landing_page_url"]), r["primary_location"]["landing_page_url"])
    url = F.coalesce(landing, r["id"])
    canonical = F.when(doi.isNotNull(), ids.doi_url(doi)).otherwise(url)
    index = r["abstract_inverted_index"]
    people = F.coalesce(r["authorships"], F.array())
    scientific = F.coalesce(F.lower(r["type"]).isin(OPENALEX_SCIENTIFIC), F.lit(False))
    return rows.withColumns(
        {
            "external_id": F.nullif(external, F.lit("")),
            "issue": first_issue(
                (~(is_http(r["id"]) & external.rlike("^W[0-9]+$")) | r["id"].isNull(), "invalid_identifier"),
                (title.isNull(), "missing_title"),
                (r["publication_date"].isNotNull() & published.isNull(), "invalid_record"),
                (after(published, cutoff), "after_cutoff"),
                (r["doi"].isNotNull() & doi.isNull(), "invalid_record"),
                (index.isNotNull() & abstract_invalid(index), "invalid_record"),
            ),
            "connector_id": F.lit("openalex"),
            "document_id": ids.digest_id("document-openalex-", F.col("snapshot_id"), F.lit("openalex"), F.lower(external)),
            "title": title,
            "url": url,
            "canonical_url": canonical,
            "source_type": F.when(scientific, "scientific_publication").otherwise("other"),
            "trust_tier": F.when(scientific, "A").otherwise("unknown"),
            "language": F.coalesce(F.lower(ids.filled(r["language"])), F.lit("und")),
            "origin_id": F.coalesce(F.concat(F.lit("doi:"), doi), F.concat(F.lit("url:"), F.lower(canonical))),
            "origin_method": F.when(doi.isNotNull(), "doi").otherwise("canonical_url"),
            "doi": doi,
            "authors": _names(F.transform(people, lambda a: a["author"]["display_name"])),
            "organizations": _names(
                F.flatten(F.transform(people, lambda a: F.transform(F.coalesce(a["institutions"], F.array()), lambda i: i["display_name"])))
            ),
            "published_at": published,
            "publisher": ids.filled(r["primary_location"]["source"]["display_name"]),
            "excerpt": abstract_text(index),
        }
    )


def openalex_hints(records: DataFrame) -> DataFrame:
    """Scored topics (the primary one marked) and keywords of the accepted works.

    A work with one bad hint keeps no hints at all and is listed by ``hint_issues``.
    """
    good = records.where(F.col("issue").isNull())
    primary = _last_part(F.col("r.primary_topic.id"))
    topics = F.coalesce(F.col("r.topics"), F.array())
    listed = F.exists(topics, lambda t: _last_part(t["id"]) == primary)
    every = F.when(
        F.col("r.primary_topic").isNotNull() & ~F.coalesce(listed, F.lit(False)),
        F.concat(F.array(F.col("r.primary_topic")), topics),
    ).otherwise(topics)

    def hint(kind: str, item: Column, pattern: str) -> Column:
        valid = is_http(item["id"]) & item["id"].rlike(pattern) & (F.trim(item["display_name"]) != "") & item["score"].between(0.0, 1.0)
        return F.struct(
            F.lit(kind).alias("kind"), _last_part(item["id"]).alias("term_id"), F.trim(item["display_name"]).alias("name"),
            item["score"].alias("score"),
            (F.lit(kind == "topic") & F.coalesce(_last_part(item["id"]) == primary, F.lit(False))).alias("primary_topic"),
            F.coalesce(valid, F.lit(False)).alias("valid"),
        )

    hints = F.concat(
        F.transform(every, lambda t: hint("topic", t, r"/T[0-9]+/*$")),
        F.transform(F.coalesce(F.col("r.keywords"), F.array()), lambda k: hint("keyword", k, r"/keywords/[^/]+/*$")),
    )
    return good.select("document_id", "external_id", hints.alias("hints"))


def kept_hints(hints: DataFrame) -> DataFrame:
    fine = hints.where(F.forall("hints", lambda h: h["valid"]))
    return fine.select("document_id", F.explode("hints").alias("h")).select(
        "document_id", "h.kind", "h.term_id", "h.name", "h.score", "h.primary_topic"
    )


def hint_issues(hints: DataFrame) -> DataFrame:
    return hints.where(F.exists("hints", lambda h: ~h["valid"])).select("document_id", "external_id")


@F.pandas_udf(T.StringType())
def _unescape(values: pd.Series) -> pd.Series:
    return values.map(html.unescape, na_action="ignore")


def clean_markup(value: Column) -> Column:
    """Tags become spaces, entities characters, runs of spaces one space."""
    bare = F.regexp_replace(value, "<[^>]+>", " ")
    text = F.coalesce(_unescape(F.when(F.contains(bare, F.lit("&")), bare)), bare)
    return F.trim(F.regexp_replace(text, r"[\s\p{Z}]+", " "))


def _parts_date(value: Column) -> Column:
    first = F.get(value["date-parts"], F.lit(0))
    return F.when(F.size(first) >= 3, first)


def crossref_records(raw: DataFrame, cutoff: dt.date) -> DataFrame:
    rows = explode_records(raw, CROSSREF, "message.items")
    r = F.col("r")
    doi = ids.normalize_doi(r["DOI"])
    options = F.concat(F.coalesce(r["title"], F.array()), F.coalesce(r["subtitle"], F.array()))
    title = clean_markup(F.get(F.filter(options, lambda t: F.trim(t) != ""), F.lit(0)))
    parts = F.coalesce(
        _parts_date(r["published"]), _parts_date(r["published-online"]), _parts_date(r["published-print"]), _parts_date(r["issued"])
    )
    published = F.try_to_date(
        F.format_string("%04d-%02d-%02d", F.get(parts, F.lit(0)), F.get(parts, F.lit(1)), F.get(parts, F.lit(2))), "yyyy-MM-dd"
    )
    people = F.coalesce(r["author"], F.array())
    kind = F.lower(r["type"])
    rows = rows.withColumns({"_doi": doi, "_published": published, "_parts": parts, "title": title, "excerpt": clean_markup(ids.filled(r["abstract"])), "publisher": clean_markup(ids.filled(r["publisher"]))})
    canonical = ids.doi_url(F.col("_doi"))
    full_name = lambda a: F.coalesce(ids.filled(a["name"]), ids.filled(F.concat_ws(" ", ids.filled(a["given"]), ids.filled(a["family"]))))
    return rows.withColumns(
        {
            "external_id": F.col("_doi"),
            "issue": first_issue(
                (F.col("_doi").isNull(), "invalid_identifier"),
                (F.col("title").isNull() | (F.col("title") == ""), "missing_title"),
                (F.col("_parts").isNotNull() & F.col("_published").isNull(), "invalid_record"),
                (after(F.col("_published"), cutoff), "after_cutoff"),
            ),
            "connector_id": F.lit("crossref"),
            "document_id": ids.digest_id("document-crossref-", F.col("snapshot_id"), F.lit("crossref"), F.col("_doi")),
            "url": F.when(is_http(r["URL"]), r["URL"]).otherwise(canonical),
            "canonical_url": canonical,
            "source_type": F.when(kind == "standard", "standard").when(kind == "report", "analytical_report")
            .when(kind.isin(CROSSREF_SCIENTIFIC), "scientific_publication").otherwise("other"),
            "trust_tier": F.when(kind == "standard", "A").when(kind == "report", "B")
            .when(kind.isin(CROSSREF_SCIENTIFIC), "A").otherwise("unknown"),
            "language": F.coalesce(F.lower(ids.filled(r["language"])), F.lit("und")),
            "origin_id": F.concat(F.lit("doi:"), F.col("_doi")),
            "origin_method": F.lit("doi"),
            "doi": F.col("_doi"),
            "authors": _names(F.transform(people, full_name)),
            "organizations": _names(F.flatten(F.transform(people, lambda a: F.transform(F.coalesce(a["affiliation"], F.array()), lambda x: x["name"])))),
            "published_at": F.col("_published"),
        }
    )


TAXONOMY = "results ARRAY<STRUCT<id: STRING, display_name: STRING, description: STRING, works_count: BIGINT>>"


def taxonomy_rows(raw: DataFrame, level: str) -> DataFrame:
    rows = explode_records(raw, TAXONOMY, "results")
    return rows.where(F.trim("r.display_name") != "").select(
        _last_part(F.col("r.id")).alias("taxonomy_id"), F.lit(level).alias("level"), F.trim("r.display_name").alias("name"),
        F.col("r.description").alias("description"), F.coalesce("r.works_count", F.lit(0)).alias("works_count"),
    )
