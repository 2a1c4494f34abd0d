"""Names of one vocabulary in terms of another."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Kinds of claims as kinds of evidence, types of sources, reasons of noise.
EVIDENCE_KIND = {
    "standard": "standard_adoption",
    "adoption": "serial_deployment",
    "market": "established_market",
    "pilot": "pilot",
    "research": "technical_validation",
    "patent": "technical_validation",
    "prototype": "technical_validation",
    "novelty": "technical_validation",
    "investment": "publicity_wave",
    "growth": "publicity_wave",
    "promotional_claim": "publicity_wave",
}
EVIDENCE_SOURCE = {
    "scientific_publication": "research",
    "patent": "patent",
    "standard": "standard",
    "regulator": "regulator",
    "university": "official_technical",
    "company_technical": "official_technical",
    "analytical_report": "analytical_report",
    "industry_media": "industry_media",
    "press_release": "press_release",
    "social_or_blog": "social",
    "other": "other",
}
NOISE_TYPE = {
    "scope_term": "broad_concept",
    "generic_area": "broad_concept",
    "organization": "not_technology",
    "promotional_claim": "not_technology",
    "irrelevant": "irrelevant",
    "invalid_name": "extraction_error",
}


def renamed(name: Column, names: dict[str, str]) -> Column:
    """The other name; null for a name that has none."""
    pairs = [part for old, new in names.items() for part in (F.lit(old), F.lit(new))]
    return F.try_element_at(F.create_map(*pairs), name)
