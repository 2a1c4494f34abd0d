"""Coverage, presence features, temporal counts and the assembled feature table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenuis.functions.dates import Windows
from tenuis.functions.ids import digest_id
from tenuis.functions.text import fold_native

SOURCE_CLASSES = ("scientific", "industry")
COUNT_KEYS = ("candidate_previous", "candidate_recent", "scope_previous", "scope_recent")
PRESENCE = (
    "scientific_previous_present", "scientific_recent_present", "industry_previous_present",
    "industry_recent_present", "unknown_date_present", "trust_ab_present",
    "multiple_origins_present", "multiple_organizations_present", "multiple_source_types_present",
)
NUMERIC = (
    "scientific_previous_count_log1p", "scientific_recent_count_log1p", "scientific_count_log_growth",
    "scientific_scope_share_previous", "scientific_scope_share_recent", "scientific_scope_share_delta",
)
STRUCTURED = (
    "scientific_coverage_complete", "industry_coverage_complete", *PRESENCE,
    "temporal_count_coverage_complete",
)
MEDIA = ("industry_coverage_complete", "industry_previous_present", "industry_recent_present")


def source_class(connector: Column) -> Column:
    return F.when(connector == "openalex", "scientific").when(
        connector.isin("mediacloud", "exa"), "industry"
    )


def request_coverage(planned: DataFrame, results: DataFrame) -> DataFrame:
    """Planned requests against their results per (candidate, source class): complete when all
    succeeded, partial when some did, unknown when none did. A request never tried is counted
    as missing, not as empty."""
    rows = planned.join(results, "request_id", "left")
    ok, tried = F.col("status") == "success", F.col("status").isNotNull()
    out = rows.groupBy("candidate_id", "source_class").agg(
        F.count(F.lit(1)).alias("planned_requests"),
        F.count_if(ok).alias("successful_requests"),
        F.count_if(tried & ~ok).alias("failed_requests"),
        F.count_if(~tried).alias("missing_requests"),
        F.coalesce(F.sum(F.when(ok, F.col("records"))), F.lit(0)).alias("returned_records"),
    )
    return out.withColumn(
        "status",
        F.when(F.col("successful_requests") == F.col("planned_requests"), "complete")
        .when(F.col("successful_requests") > 0, "partial")
        .otherwise("unknown"),
    )


def filled_coverage(candidates: DataFrame, coverage: DataFrame) -> DataFrame:
    """Both source classes for every candidate; a missing class is unknown."""
    roster = candidates.select(
        "candidate_id", F.explode(F.array(*[F.lit(c) for c in SOURCE_CLASSES])).alias("source_class")
    )
    return roster.join(
        coverage.select("candidate_id", "source_class", "status"), ["candidate_id", "source_class"], "left"
    ).withColumn("status", F.coalesce("status", F.lit("unknown")))


def coverage_flags(coverage: DataFrame) -> DataFrame:
    done = F.col("status") == "complete"
    return coverage.groupBy("candidate_id").agg(
        *[
            F.coalesce(F.bool_or(done & (F.col("source_class") == name)), F.lit(False)).alias(
                f"{name}_coverage_complete"
            )
            for name in SOURCE_CLASSES
        ]
    )


def outside_windows(documents: DataFrame, windows: Windows) -> DataFrame:
    day = F.col("published_at")
    return documents.where(
        day.isNotNull() & ~day.between(F.lit(windows.previous), F.lit(windows.cutoff))
    )


def inside_windows(documents: DataFrame, windows: Windows) -> DataFrame:
    day = F.col("published_at")
    return documents.where(day.isNull() | day.between(F.lit(windows.previous), F.lit(windows.cutoff)))


def presence_features(documents: DataFrame, windows: Windows) -> DataFrame:
    """Nine booleans per candidate in one aggregation.

    "At least two distinct values" is min <> max, which combines on the map side; organizations
    of a document are reduced to their smallest and largest first.
    """
    window = windows.of(F.col("published_at"))
    kind = source_class(F.col("connector"))

    def seen(name: str, period: str) -> Column:
        return F.bool_or((kind == name) & F.col("published_at").isNotNull() & (window == period)).alias(
            f"{name}_{period}_present"
        )

    def several(low: Column, high: Column, name: str) -> Column:
        return F.coalesce(F.min(low) != F.max(high), F.lit(False)).alias(name)

    filled = F.filter(
        F.transform(F.coalesce("organizations", F.array().cast("array<string>")), fold_native),
        lambda name: name != "",
    )
    origin, kind_of = F.nullif("origin_id", F.lit("")), F.nullif("source_type", F.lit(""))
    rows = documents.withColumn("_orgs", filled)
    return rows.groupBy("candidate_id").agg(
        seen("scientific", "previous"), seen("scientific", "recent"),
        seen("industry", "previous"), seen("industry", "recent"),
        F.bool_or(F.col("published_at").isNull()).alias("unknown_date_present"),
        F.bool_or(F.coalesce(F.col("trust_tier").isin("A", "B"), F.lit(False))).alias("trust_ab_present"),
        several(origin, origin, "multiple_origins_present"),
        several(F.array_min("_orgs"), F.array_max("_orgs"), "multiple_organizations_present"),
        several(kind_of, kind_of, "multiple_source_types_present"),
    )


def count_tasks(candidates: DataFrame, windows: Windows) -> DataFrame:
    """Count tasks: candidate and scope, each in the two windows, with stable ids."""
    import datetime as dt

    spans = [
        ("previous", windows.previous, windows.recent - dt.timedelta(1)),
        ("recent", windows.recent, windows.cutoff),
    ]
    window = F.explode(
        F.array(*[
            F.struct(F.lit(n).alias("window"), F.lit(a).alias("published_from"), F.lit(b).alias("published_until"))
            for n, a, b in spans
        ])
    ).alias("w")
    own = candidates.select(
        F.lit("candidate").alias("entity_type"), F.col("candidate_id").alias("entity_id"),
        F.col("canonical_name").alias("search_text"),
    )
    scope = candidates.select(
        F.lit("scope").alias("entity_type"), F.col("scope_key").alias("entity_id"),
        F.col("scope_key").alias("search_text"),
    ).distinct()
    rows = own.unionByName(scope).select("*", window).select("entity_type", "entity_id", "search_text", "w.*")
    return rows.withColumn(
        "count_id",
        digest_id("count-", *[F.col(c) for c in ("entity_type", "entity_id", "search_text", "window", "published_from", "published_until")], length=20),
    )


def search_tasks(candidates: DataFrame, windows: Windows) -> DataFrame:
    """Requests of the enrichment plan: science per term and language, industry per term."""
    groups = [("scientific", "openalex", "en"), ("scientific", "openalex", "ru"), ("industry", "mediacloud", "en,ru")]
    group = F.explode(
        F.array(*[
            F.struct(F.lit(a).alias("source_class"), F.lit(b).alias("connector"), F.lit(c).alias("languages"))
            for a, b, c in groups
        ])
    ).alias("g")
    rows = candidates.select("candidate_id", F.posexplode("search_terms").alias("term_pos", "search_text")).select(
        "*", group
    ).select("candidate_id", "term_pos", "search_text", "g.*")
    rows = rows.withColumns({"published_from": F.lit(windows.previous), "published_until": F.lit(windows.cutoff)})
    return rows.withColumn(
        "request_id",
        digest_id("request-", *[F.col(c) for c in ("candidate_id", "connector", "search_text", "languages", "published_from", "published_until")]),
    )


def temporal_features(candidates: DataFrame, counts: DataFrame) -> DataFrame:
    """Counts of a candidate and of its scope in both windows; complete only with all four.

    Shares are given where the scope counts cover the candidate counts; a missing count leaves
    everything unknown, never zero.
    """
    own = counts.where(F.col("entity_type") == "candidate").groupBy("entity_id").pivot(
        "window", ["previous", "recent"]
    ).agg(F.first("count"))
    scope = counts.where(F.col("entity_type") == "scope").groupBy("entity_id").pivot(
        "window", ["previous", "recent"]
    ).agg(F.first("count"))
    rows = candidates.select("candidate_id", "scope_key").join(
        own.select(F.col("entity_id").alias("candidate_id"), F.col("previous").alias("candidate_previous"), F.col("recent").alias("candidate_recent")),
        "candidate_id", "left",
    ).join(
        scope.select(F.col("entity_id").alias("scope_key"), F.col("previous").alias("scope_previous"), F.col("recent").alias("scope_recent")),
        "scope_key", "left",
    )
    complete = F.lit(True)
    for key in COUNT_KEYS:
        complete = complete & F.col(key).isNotNull()
    rows = rows.withColumn("temporal_count_coverage_complete", complete)

    def known(value: Column) -> Column:
        return F.when(F.col("temporal_count_coverage_complete"), value)

    def share(window: str) -> Column:
        return known(F.try_divide(F.col(f"candidate_{window}").cast("double"), F.col(f"scope_{window}").cast("double")))

    previous, recent = F.log1p("candidate_previous"), F.log1p("candidate_recent")
    return rows.withColumns(
        {
            "scientific_previous_count_log1p": known(previous),
            "scientific_recent_count_log1p": known(recent),
            "scientific_count_log_growth": known(recent - previous),
            "scientific_scope_share_previous": share("previous"),
            "scientific_scope_share_recent": share("recent"),
            "scientific_scope_share_delta": share("recent") - share("previous"),
        }
    )


def timeline_share(points: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Share of matched among monitored articles; null without monitored ones."""
    total = points.groupBy(*keys) if keys else points.groupBy()
    return total.agg(
        F.sum("matched").alias("matched"), F.sum("monitored").alias("monitored")
    ).withColumn("share", F.try_divide(F.col("matched").cast("double"), F.col("monitored").cast("double")))


def feature_table(
    candidates: DataFrame, coverage: DataFrame, presence: DataFrame, temporal: DataFrame, groups: DataFrame
) -> DataFrame:
    """One row per candidate; every input is already one row per candidate."""
    rows = (
        candidates.join(coverage_flags(coverage), "candidate_id", "left")
        .join(presence, "candidate_id", "left")
        .join(temporal.select("candidate_id", "temporal_count_coverage_complete", *NUMERIC), "candidate_id", "left")
        .join(groups, "candidate_id")
    )
    return rows.na.fill(False, list(STRUCTURED))


def table_counts(features: DataFrame, wanted: int = 50) -> DataFrame:
    """Corpus counts, deficits and whether the negative corpus is large enough."""
    out = features.agg(
        F.count_if(F.col("target") == 1).alias("positives"),
        F.count_if(F.col("negative_class") == "mature").alias("mature"),
        F.count_if(F.col("negative_class") == "marketing_hype").alias("marketing_hype"),
        F.countDistinct("group_id").alias("groups"),
        F.count_if("temporal_count_coverage_complete").alias("temporal_complete"),
    )
    for name in ("mature", "marketing_hype"):
        out = out.withColumns(
            {
                f"{name}_deficit": F.greatest(F.lit(wanted) - F.col(name), F.lit(0)),
                f"{name}_surplus": F.greatest(F.col(name) - F.lit(wanted), F.lit(0)),
            }
        )
    return out.withColumn(
        "qualified", (F.col("mature") == wanted) & (F.col("marketing_hype") == wanted)
    )
