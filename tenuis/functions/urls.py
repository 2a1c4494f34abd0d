"""Article addresses and source typing as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tracking parameters without effect on the content.
TRACKING = ["fbclid", "gclid", "mc_cid", "mc_eid"]
_PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"

# Hosts of the source policy.
ACADEMIC_HOSTS = [
    "arxiv.org", "alphaxiv.org", "dl.acm.org", "ieeexplore.ieee.org", "link.springer.com", "mdpi.com",
    "onlinelibrary.wiley.com", "opg.optica.org", "pith.science", "proceedings.mlr.press",
    "pubmed.ncbi.nlm.nih.gov", "pubs.rsc.org", "researchgate.net", "sciencedirect.com",
    "semanticscholar.org", "tandfonline.com",
]
ACADEMIC_FRAGMENT = "iopscience.iop.org"
PRESS_HOSTS = ["businesswire.com", "eurekalert.org", "globenewswire.com", "prnewswire.com"]
COMPANY_HOSTS = [
    "amazon.com", "apple.com", "arm.com", "aws.amazon.com", "cloud.google.com", "cloudflare.com",
    "developers.googleblog.com", "developer.nvidia.com", "googleblog.com", "huggingface.co", "ibm.com",
    "machinelearning.apple.com", "meta.ai", "microsoft.com", "newsroom.arm.com", "nvidia.com",
    "openai.com", "research.ibm.com", "salesforce.com",
]
SOCIAL_HOSTS = ["linkedin.com", "medium.com", "substack.com"]


def url_part(url: Column, group: int) -> Column:
    return F.regexp_extract(F.trim(url), _PARTS, group)


def host(url: Column) -> Column:
    """Lower-case host without user and port."""
    return F.lower(F.regexp_replace(F.regexp_replace(url_part(url, 2), r"^.*@", ""), r":\d*$", ""))


def _encoded(value: Column) -> Column:
    plain = F.replace(F.url_encode(value), F.lit("*"), F.lit("%2A"))
    return F.replace(plain, F.lit("%7E"), F.lit("~"))


def canonical_url(url: Column) -> Column:
    """Lower-case scheme and host, no default port, trailing slash, fragment or tracking
    parameter; parameters sorted. Null for anything but an HTTP address without credentials."""
    scheme, authority, path = F.lower(url_part(url, 1)), url_part(url, 2), url_part(url, 3)
    port = F.regexp_extract(authority, r":(\d+)$", 1)
    default = (port == "") | ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443"))
    netloc = F.when(default, host(url)).otherwise(F.concat(host(url), F.lit(":"), port))
    trimmed = F.when(path.isin("", "/"), "/").otherwise(F.regexp_replace(path, "/+$", ""))
    pairs = F.transform(
        F.filter(F.split(url_part(url, 4), "&"), lambda item: item != ""),
        lambda item: F.struct(
            F.try_url_decode(F.regexp_extract(item, "^([^=]*)", 1)).alias("name"),
            F.try_url_decode(F.regexp_extract(item, "^[^=]*=(.*)$", 1)).alias("value"),
        ),
    )
    kept = F.filter(
        pairs,
        lambda p: ~F.startswith(F.lower(p["name"]), F.lit("utm_")) & ~F.lower(p["name"]).isin(TRACKING),
    )
    query = F.array_join(
        F.transform(F.array_sort(kept), lambda p: F.concat(_encoded(p["name"]), F.lit("="), _encoded(p["value"]))), "&"
    )
    full = F.concat(scheme, F.lit("://"), netloc, trimmed, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    valid = scheme.isin("http", "https") & (host(url) != "") & ~F.contains(authority, F.lit("@"))
    return F.when(valid, full)


def is_http(url: Column) -> Column:
    return url_part(url, 1).isin("http", "https") & (url_part(url, 2) != "")


def _on(name: Column, hosts: list[str]) -> Column:
    pattern = "(^|\\.)(" + "|".join(h.replace(".", "\\.") for h in hosts) + ")$"
    return name.rlike(pattern)


def source_policy(url: Column) -> Column:
    """(eligible, source_type, reason) of a web result from its host and path."""
    name, path = host(url), F.lower(url_part(url, 3))

    def row(eligible: bool, kind: str, reason: str) -> Column:
        return F.struct(F.lit(eligible).alias("eligible"), F.lit(kind).alias("source_type"), F.lit(reason).alias("reason"))

    paper = "scientific_publication"
    return (
        F.when(name == "", row(False, "other", "invalid_host"))
        .when((name == "exa.ai") & F.startswith(path, F.lit("/library/publication")), row(False, paper, "exa_publication_proxy"))
        .when(_on(name, ACADEMIC_HOSTS) | F.contains(name, F.lit(ACADEMIC_FRAGMENT)), row(False, paper, "academic_domain"))
        .when(_on(name, ["nature.com"]) & F.startswith(path, F.lit("/articles/")), row(False, paper, "journal_article_path"))
        .when(_on(name, PRESS_HOSTS), row(True, "press_release", "press_release_domain"))
        .when(_on(name, COMPANY_HOSTS), row(True, "company_technical", "company_domain"))
        .when(_on(name, SOCIAL_HOSTS), row(True, "social_or_blog", "social_or_blog_domain"))
        .otherwise(row(True, "industry_media", "web_news_or_trade_source"))
    )
