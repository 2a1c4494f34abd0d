"""Record-level quarantine: one parsed table splits into documents and issue rows."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DOCUMENT_COLUMNS = (
    "document_id", "connector_id", "external_id", "snapshot_id", "title", "url", "canonical_url", "source_type",
    "language", "trust_tier", "origin_id", "doi", "authors", "organizations", "published_at", "observed_at",
    "retrieved_at", "publisher", "excerpt", "automatic_translation", "generated_summary", "origin_method",
    "origin_confidence",
)
_OPTIONAL = {
    "doi": "string", "authors": "array<string>", "organizations": "array<string>", "published_at": "date",
    "observed_at": "timestamp", "publisher": "string", "excerpt": "string", "origin_method": "string",
}


def explode_records(raw: DataFrame, schema: str, records: str) -> DataFrame:
    """One row per record of every response (snapshot_id, retrieved_at, payload), with its index."""
    parsed = raw.withColumn("_p", F.from_json("payload", schema))
    return parsed.select("snapshot_id", "retrieved_at", F.posexplode(f"_p.{records}").alias("record_index", "r"))


def broken_payloads(raw: DataFrame, schema: str, records: str) -> DataFrame:
    """Responses that are not JSON or have no record list."""
    parsed = raw.withColumn("_p", F.from_json("payload", schema))
    return parsed.where(F.col(f"_p.{records}").isNull()).select("snapshot_id")


def documents(rows: DataFrame) -> DataFrame:
    missing = {n: F.lit(None).cast(t) for n, t in _OPTIONAL.items() if n not in rows.columns}
    missing |= {n: F.lit(False) for n in ("automatic_translation", "generated_summary") if n not in rows.columns}
    missing["origin_confidence"] = F.lit(1.0)
    good = rows.where(F.col("issue").isNull()).withColumns(missing)
    return good.select(*DOCUMENT_COLUMNS)


def issues(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("issue").isNotNull()).select(
        "snapshot_id", "record_index", "external_id", F.col("issue").alias("code")
    )


def first_issue(*checks: tuple[Column, str]) -> Column:
    """Code of the first failed check."""
    out = F.lit(None).cast("string")
    for failed, code in reversed(checks):
        out = F.when(F.coalesce(failed, F.lit(False)), code).otherwise(out)
    return out


def after(day: Column, cutoff: dt.date) -> Column:
    return F.coalesce(day > F.lit(cutoff), F.lit(False))


def leaks(published: Column, observed: Column, cutoff: dt.date) -> Column:
    """A document from after the cutoff: published later, or undated and first seen later."""
    return after(published, cutoff) | (published.isNull() & after(observed.cast("date"), cutoff))
