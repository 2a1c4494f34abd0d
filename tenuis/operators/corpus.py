"""The labelled corpus: which candidates become rows, and how much of a run was looked at."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tenuis.operators.ranking import full_rank

LABELS = ("mature", "hype")


def training_rows(positives: DataFrame, negatives: DataFrame, decisions: DataFrame) -> DataFrame:
    """Positives and accepted negatives as one table: candidate_id, target, negative_class, identity_reviewed.

    A proposed label is no target: negatives count only with an accepted decision of a known label.
    """
    accepted = decisions.where((F.col("decision_status") == "accepted") & F.col("proposed_label").isin(*LABELS))
    named = F.when(F.col("proposed_label") == "hype", "marketing_hype").otherwise("mature")
    yes = positives.select("candidate_id", F.lit(1).alias("target"), F.lit(None).cast("string").alias("negative_class"), (F.col("identity_status") == "reviewed").alias("identity_reviewed"))
    no = negatives.join(accepted.select("candidate_id", "proposed_label"), "candidate_id").select(
        "candidate_id", F.lit(0).alias("target"), named.alias("negative_class"), F.lit(False).alias("identity_reviewed")
    )
    return yes.unionByName(no)


def unusable_decisions(decisions: DataFrame) -> DataFrame:
    """Accepted decisions whose label is none of LABELS."""
    known = F.coalesce(F.col("proposed_label").isin(*LABELS), F.lit(False))
    return decisions.where((F.col("decision_status") == "accepted") & ~known).select("candidate_id", "proposed_label")


def gate_coverage(proposals: DataFrame, checked: DataFrame) -> DataFrame:
    """One row: how many proposals a gate has checked, and whether that is all of them."""
    seen = checked.select("proposal_id", F.lit(1).alias("_seen")).distinct()
    totals = proposals.select("proposal_id").distinct().join(seen, "proposal_id", "left").agg(
        F.count(F.lit(1)).alias("total_proposals"), F.count("_seen").alias("checked_proposals")
    )
    skipped = F.col("total_proposals") - F.col("checked_proposals")
    return totals.withColumn("skipped_proposals", skipped).withColumn("status", F.when(skipped == 0, "complete").otherwise("partial"))


def skipped_proposals(proposals: DataFrame, checked: DataFrame) -> DataFrame:
    return proposals.select("proposal_id").distinct().join(checked.select("proposal_id"), "proposal_id", "left_anti")


def relevance_ranks(ranked: DataFrame) -> DataFrame:
    """Rank of every kept document of a candidate: score, then newer, then id. A hot candidate spans partitions."""
    order = [F.col("score").desc(), F.col("published_at").desc_nulls_last(), F.col("document_id").asc()]
    rows = ranked.select("candidate_id", "document_id", "score", "published_at")
    return full_rank(rows, ["candidate_id"], order).select("candidate_id", "document_id", "score", "rank")


def mentions_over_limit(mentions: DataFrame, most: int) -> DataFrame:
    """Mentions beyond the `most` first ones of a document, by position."""
    place = F.row_number().over(W.partitionBy("document_id").orderBy("position", "mention_id"))
    return mentions.withColumn("place", place).where(F.col("place") > most).select("document_id", "mention_id", "place")
