"""Results of repeated requests and of several providers brought together without losing a row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenuis.functions.urls import source_policy
from tenuis.session import stored
from tenuis.sources.quarantine import first_issue


def _content_digest(columns: Sequence[str]) -> Column:
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"}), 256)


def least_provenance(rows: DataFrame, keys: Sequence[str], provenance: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(chosen, conflicts) of rows that several requests returned under the same keys.

    The row with the least provenance (compared in order, null as blank) stands for its key. All other columns are
    content and must agree: the least and the largest content digest of a key are then equal. Keys whose copies differ are
    conflicts and give no row. Both come from one aggregation, whose partial results are one row for each key and
    task, so a key that holds a third of all rows moves no more than that.
    """
    content = [c for c in rows.columns if c not in (*keys, *provenance)]
    order = F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in provenance])
    marked = rows.select(*keys, order.alias("_order"), _content_digest(content).alias("_digest"), F.struct(*provenance, *content).alias("_row"))
    found = stored(
        marked.groupBy(*keys).agg(
            F.min_by("_row", F.struct("_order", "_digest")).alias("_row"), F.count(F.lit(1)).alias("copies"),
            F.min("_digest").alias("_least"), F.max("_digest").alias("_most"),
        ),
        "copies",
    )
    agree = F.col("_least") == F.col("_most")
    chosen = found.where(agree).select(*keys, "_row.*", "copies")
    return chosen.select(*rows.columns, "copies"), found.where(~agree).select(*keys, "copies")


def typed_union(candidates: DataFrame, science: DataFrame, web: DataFrame) -> DataFrame:
    """Every science and web row once, with its outcome.

    science: candidate_id, document_id, connector, canonical_url, source_type, excerpt_length. web: the same without
    connector and type. A row is `science` or `web` (kept, typed by the policy), or it is left out with a reason: an
    unknown candidate, another connector, a repeated science document, a missing address or id, a source that the policy
    excludes, or `superseded` by the best copy of its address (longest excerpt, then smallest document id). Outcomes are
    disjoint and add up to the input.

    Rows are numbered and stored once; the best copy of an address and the first copy of a document are minima, which
    combine before the shuffle, so that a common address is not sorted in one task.
    """
    known = candidates.select("candidate_id", F.lit(True).alias("_known")).distinct()
    policy = F.when(F.col("canonical_url").isNotNull(), source_policy(F.col("canonical_url")))
    columns = ["candidate_id", "document_id", "connector", "canonical_url", "source_type", "excerpt_length"]
    parts = science.select(*columns, F.lit(False).alias("_web"), F.lit(None).cast("boolean").alias("_eligible"), F.lit(None).cast("string").alias("_policy")).unionByName(
        web.withColumn("_p", policy).select(
            "candidate_id", "document_id", F.lit("exa").alias("connector"), "canonical_url", F.col("_p.source_type").alias("source_type"), "excerpt_length",
            F.lit(True).alias("_web"), F.col("_p.eligible").alias("_eligible"), F.col("_p.reason").alias("_policy"),
        )
    )
    is_web = F.col("_web")
    outcome = first_issue(
        (F.col("_known").isNull(), "unknown_candidate"),
        (~is_web & ~F.col("connector").eqNullSafe("openalex"), "other_connector"),
        (F.coalesce(F.trim("document_id"), F.lit("")) == "", "no_document_id"),
        (is_web & F.col("canonical_url").isNull(), "no_address"),
        (is_web & ~F.col("_eligible"), "excluded"),
    )
    rows = parts.join(known, "candidate_id", "left").withColumns({"outcome": outcome, "_row": F.monotonically_increasing_id()})
    rows = stored(rows.drop("_known"), "typed")
    open_ = rows.where(F.col("outcome").isNull())
    identity = F.when(is_web, F.lower("canonical_url")).otherwise(F.col("document_id"))
    better = F.struct((-F.when(is_web, F.coalesce("excerpt_length", F.lit(0))).otherwise(0)).alias("n"), "document_id", "_row")
    first = open_.groupBy("candidate_id", "_web", identity.alias("_identity")).agg(F.min(better).alias("_best"))
    first = stored(first.select("_best._row", F.lit(True).alias("_first")), "first")
    lost = F.when(is_web, "superseded").otherwise("repeated")
    merged = rows.join(first, "_row", "left")
    kept = F.when(is_web, "web").otherwise("science")
    return merged.select(
        *columns, F.coalesce("outcome", F.when(F.col("_first"), kept).otherwise(lost)).alias("outcome"), F.col("_policy").alias("reason")
    )


def kept_documents(typed: DataFrame) -> DataFrame:
    return typed.where(F.col("outcome").isin("science", "web")).drop("outcome", "reason")


def excluded_documents(typed: DataFrame) -> DataFrame:
    """What the source policy leaves out, with the type it saw and why."""
    return typed.where(F.col("outcome") == "excluded").select("candidate_id", "document_id", "canonical_url", "reason", F.col("source_type").alias("classified_source_type"))


def left_out(typed: DataFrame) -> DataFrame:
    """Rows left out for any other reason."""
    return typed.where(~F.col("outcome").isin("science", "web", "excluded")).select("candidate_id", "document_id", "connector", "outcome")


def enrichment_totals(candidates: DataFrame, typed: DataFrame, coverage: DataFrame) -> DataFrame:
    """Kept, excluded and left-out documents and complete coverage by class, in all and by connector class.

    coverage: candidate_id, source_class, status. One pass over the typed rows and one over the coverage."""
    side = F.when(F.col("connector") == "exa", "industry").otherwise("scientific")
    documents = typed.select(side.alias("source_class"), "outcome").groupBy("source_class").agg(
        F.count_if(F.col("outcome").isin("science", "web")).alias("documents"), F.count_if(F.col("outcome") == "excluded").alias("excluded"),
        F.count_if(~F.col("outcome").isin("science", "web", "excluded")).alias("left_out"),
    )
    complete = coverage.groupBy("source_class").agg(F.count_if(F.col("status") == "complete").alias("coverage_complete"))
    rows = documents.join(complete, "source_class", "full").na.fill(0)
    total = candidates.agg(F.countDistinct("candidate_id")).scalar()
    sums = [F.sum(c).alias(c) for c in ("documents", "excluded", "left_out", "coverage_complete")]
    return rows.rollup("source_class").agg(*sums).select(F.coalesce("source_class", F.lit("all")).alias("source_class"), "documents", "excluded", "left_out", "coverage_complete", total.alias("candidates"))


def budget_usage(log: DataFrame, keys: Sequence[str] = ("connector", "run_id")) -> DataFrame:
    """Usage of a request log by run, by connector and in all, from one scan.

    log: one row per request with connector, run_id, returned, accepted, rejected and the origin_id of the accepted
    record (null where none). Unique documents are distinct origins within each level, so the
    duplicates of a connector include those across its runs."""
    out = log.rollup(*keys).agg(
        F.count(F.lit(1)).alias("requests"), F.sum("returned").alias("returned_records"), F.sum("accepted").alias("accepted_records"),
        F.sum("rejected").alias("rejected_records"), F.countDistinct("origin_id").alias("unique_documents"), F.count("origin_id").alias("_documents"),
    )
    return out.withColumn("duplicate_documents", F.col("_documents") - F.col("unique_documents")).drop("_documents")


def grounding_totals(rows: DataFrame) -> DataFrame:
    """Totals and histograms of gate rows: all, by decision and by promotion status, from one scan.

    rows: candidate_id, groundings, canonical_grounded, gate_decision (null: not called), promotion_status, issues."""
    called = rows.withColumn("decision", F.coalesce("gate_decision", F.lit("not_called")))
    d, s = F.col("decision"), F.col("promotion_status")
    out = called.groupingSets([[], [d], [s]], d, s).agg(
        F.grouping_id().alias("_level"), F.count(F.lit(1)).alias("candidates"), F.sum("groundings").alias("groundings"), F.count_if(F.col("groundings") > 0).alias("grounded"),
        F.count_if(F.col("groundings") == 0).alias("ungrounded"), F.count_if("canonical_grounded").alias("canonical_grounded"), F.sum("issues").alias("issues"),
    )
    # Bits of the level: 2 without decision, 1 without status.
    kind = F.when(F.col("_level") == 3, "total").when(F.col("_level") == 1, "decision").otherwise("status")
    return out.select(kind.alias("kind"), F.coalesce("decision", "promotion_status").alias("value"), "candidates", "groundings", "grounded", "ungrounded", "canonical_grounded", "issues")
