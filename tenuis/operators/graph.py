"""Connected components by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenuis.functions.ids import digest_id
from tenuis.session import cut_lineage


def shared_key_edges(keys: DataFrame, node: str, key: str) -> DataFrame:
    """Edges between nodes that share a key, as a star around the smallest node of the key.

    A key held by a third of all nodes gives one edge per node, not all pairs.
    """
    hubs = keys.groupBy(key).agg(F.min(node).alias("v"))
    return (
        keys.select(F.col(node).alias("u"), key)
        .join(hubs, key)
        .where(F.col("u") != F.col("v"))
        .select("u", "v")
        .distinct()
    )


#: Rows of a task in the rounds of `components`, whose rows are two short keys each.
ROWS_PER_TASK = 1_000_000


def _pair(u: str, v: str):
    return F.struct(F.col(u).alias("u"), F.col(v).alias("v"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.explode(F.array(_pair("u", "v"), _pair("v", "u"))).alias("e")).select("e.*")
    lowest = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return (
        both.where(F.col("v") > F.col("u"))
        .join(lowest, "u")
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    lowest = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = F.when(F.col("v") != F.col("m"), F.array(_pair("v", "m"), _pair("u", "m"))).otherwise(F.array(_pair("u", "m")))
    return edges.join(lowest, "u").select(F.explode(moved).alias("e")).select("e.*").distinct()


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")
    ).first()
    return row["n"], row["h"]


def components(nodes: DataFrame, node: str, edges: DataFrame) -> DataFrame:
    """Smallest node of the component of every node, in a logarithmic number of rounds.

    Every step joins on a node and aggregates with map-side minima; each round is checkpointed
    in the shared folder, so the plan stays short and lost executors cost one round at most. The
    counted rows of a round set the number of its tasks, so a small graph makes no empty ones.
    """
    current = cut_lineage(
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    mark = _fingerprint(current)
    while mark[0]:
        current = current.coalesce(-(-mark[0] // ROWS_PER_TASK))
        current = cut_lineage(_small_star(_large_star(current)))
        after = _fingerprint(current)
        if after == mark:
            break
        mark = after
    roots = current.select(F.col("u").alias(node), F.col("v").alias("root"))
    return (
        nodes.select(node).distinct().join(roots, node, "left")
        .withColumn("root", F.coalesce("root", node))
    )


def identity_groups(nodes: DataFrame, node: str, edges: DataFrame) -> DataFrame:
    """Group id from the smallest member, which names a component without gathering it."""
    return components(nodes, node, edges).select(
        node, digest_id("cross-corpus-", F.col("root")).alias("group_id")
    )
