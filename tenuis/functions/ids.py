"""Stable ids and document identity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest_id(prefix: str, *parts: Column, length: int = 16) -> Column:
    """``prefix`` plus the first hex digits of SHA-256 over the parts joined by ``|``."""
    texts = [F.coalesce(part.cast("string"), F.lit("")) for part in parts]
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("|", *texts), 256), 1, length))


def filled(value: Column) -> Column:
    """Trimmed text, null when blank."""
    return F.nullif(F.trim(value), F.lit(""))


def document_identity(
    doi: Column, canonical_url: Column, url: Column, connector: Column, external_id: Column
) -> Column:
    return F.coalesce(
        F.replace(F.lower(filled(doi)), F.lit("ß"), F.lit("ss")),
        filled(canonical_url),
        filled(url),
        F.concat(connector, F.lit(":"), external_id),
    )


def normalize_doi(value: Column) -> Column:
    """Bare lower-case DOI; null when the text is not a DOI."""
    bare = F.trim(F.regexp_replace(F.lower(F.trim(value)), r"^(https?://(dx\.)?doi\.org/|doi:)", ""))
    return F.when(bare.rlike(r"^10\.[0-9]{4,9}/\S+$"), bare)


def doi_url(doi: Column) -> Column:
    """Resolver URL; characters outside the safe set are percent-encoded."""
    encoded = F.replace(F.url_encode(doi), F.lit("+"), F.lit("%20"))
    encoded = F.replace(encoded, F.lit("*"), F.lit("%2A"))
    for char, code in (("/", "%2F"), (":", "%3A"), (";", "%3B"), ("(", "%28"), (")", "%29"), ("~", "%7E")):
        encoded = F.replace(encoded, F.lit(code), F.lit(char))
    return F.concat(F.lit("https://doi.org/"), encoded)
