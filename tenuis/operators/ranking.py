"""Ranking windows shared by the other operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tenuis.session import cut_lineage


def top_k(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank"
) -> DataFrame:
    """First k rows of every group.

    Catalyst turns the rank filter into a group limit below the shuffle, so a group that holds
    a third of the rows still sends at most k rows per map task.
    """
    window = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)


def first_row(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return top_k(df, keys, order, 1, "_first").drop("_first")


def ranked_head(df: DataFrame, order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """Global top k with ranks; the rank window sees only the k rows that survive the limit."""
    head = df.orderBy(*order).limit(k)
    return head.withColumn(rank, F.row_number().over(W.orderBy(*order)))


def round_robin(
    df: DataFrame,
    strata: Column,
    order: Sequence[Column],
    k: int,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Take the first of every stratum, then the second of every stratum, up to k rows per key.

    Each stratum can give at most k rows, so the strata are cut before the final order.
    """
    staged = top_k(df.withColumn("_stratum", strata), [*keys, "_stratum"], order, k, "_turn")
    final = [F.col("_turn"), F.col("_stratum")]
    if keys:
        picked = top_k(staged, keys, final, k, "position")
    else:
        picked = ranked_head(staged, final, k, "position")
    return picked.drop("_stratum", "_turn")


def trust_rank(tier: Column) -> Column:
    return (
        F.when(tier == "A", 0).when(tier == "B", 1).when(tier == "C", 2).when(tier == "D", 3)
        .otherwise(4)
    )


def full_rank(df: DataFrame, keys: Sequence[str], order: Sequence[Column], rank: str = "rank") -> DataFrame:
    """Rank of every row in its group without one task per group.

    Rows are range-partitioned by group and order, so a hot group spans many partitions; ranks
    inside a partition are shifted by the sizes of the partitions before it.
    """
    ranged = cut_lineage(
        df.repartitionByRange(*[F.col(k).asc() for k in keys], *order).withColumn("_part", F.spark_partition_id())
    )
    before = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = ranged.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n")).withColumn(
        "_before", F.coalesce(F.sum("_n").over(before), F.lit(0))
    )
    inside = F.row_number().over(W.partitionBy(*keys, "_part").orderBy(*order))
    placed = ranged.withColumn("_inside", inside).join(offsets.drop("_n"), [*keys, "_part"])
    return placed.withColumn(rank, F.col("_before") + F.col("_inside")).drop("_part", "_before", "_inside")


def full_round_robin(
    df: DataFrame, keys: Sequence[str], stratum: str, order: Sequence[Column], position: str = "position"
) -> DataFrame:
    """Place of every row when the strata of a key take turns; empty strata are skipped."""
    turned = full_rank(df, [*keys, stratum], order, "_turn")
    return full_rank(turned, keys, [F.col("_turn").asc(), F.col(stratum).asc()], position).drop("_turn")
