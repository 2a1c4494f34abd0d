"""Approximate nearest neighbours with a forest of random-projection trees.

Each tree splits by the median of a random projection. A search keeps one priority queue for all trees: a node's
priority is the least signed margin on its way, so the queue always opens the leaf, of any tree, that the query is
least far from. The queue is followed until its best priority falls below a radius. The rows of the opened leaves are
ranked exactly, by cosine in double precision on the original vectors.

Rows are dealt out once, in groups of bounded bytes, and the queries meet every group; which leaves a query opens and in
which a row lies is found where they meet. So no vector is copied per leaf, and Spark has no join whose sides it could
take for small.

Trees and radius are fitted on a sample of at most `SAMPLE_ROWS` vectors drawn by a hash of their ids (and at most
`SAMPLE_BYTES`): the radius is the one at which `RECALL` of the true neighbours of sample vectors are found. Vectors
without any structure make it large, clustered ones small. Every row is indexed; no leaf has a cap.

Equal vectors are thinned first, exactly: of one vector only the k + 1 smallest ids can be among the k nearest of any
query, ties going to the smaller id. So a vector that a third of all rows share fills no leaf.

Defined results: vectors that are null, empty, zero, of another length than most of the sample, or that hold a null
or non-finite component take no part, and neither do rows without an id. Rows of one id count as one row, whose best
pair counts; a query never finds its own id. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tenuis.llm.common import share

NEAREST = 5
TREES = 6
LEAF_ROWS = 300
SAMPLE_ROWS = 20_000
SAMPLE_BYTES = 64 << 20
SAMPLE_QUERIES = 400
LEAST_LEAF_SAMPLE = 16
RECALL = 0.97
ROW_BLOCK = 8192
QUERY_BLOCK = 256
#: Bytes of vectors that a group of rows or of queries has at most on average, and rows below which no more groups are made.
GROUP_BYTES = 64 << 20
LEAST_GROUP = 2048


@dataclass(frozen=True)
class Forest:
    """`directions[t]` and `thresholds[t]` list the inner nodes of tree t by level; all trees have one depth."""

    directions: np.ndarray
    thresholds: np.ndarray
    depth: int
    radius: float

    @property
    def size(self) -> int:
        return self.directions.shape[-1]

    def leaves(self, unit: np.ndarray, tree: int) -> np.ndarray:
        node = np.zeros(len(unit), dtype=np.int64)
        for _ in range(self.depth):
            right = np.einsum("ij,ij->i", unit, self.directions[tree][node]) > self.thresholds[tree][node]
            node = 2 * node + 1 + right
        return node - (2**self.depth - 1)

    def opened(self, unit: np.ndarray) -> list[np.ndarray]:
        """Per tree, for every row as a query, whether its queue opens each leaf before its best priority falls below the radius.

        A leaf's priority is the least signed margin on its way, and the queue opens exactly the leaves whose priority
        reaches the radius; `search` gives them one after another, this for many queries at once."""
        out = []
        for directions, thresholds in zip(self.directions, self.thresholds, strict=True):
            far = np.full((len(unit), 1), -np.inf)
            margins = unit @ directions.T - thresholds
            for level in range(self.depth):
                here = margins[:, 2**level - 1 : 2 ** (level + 1) - 1]
                far = np.stack([np.maximum(far, here), np.maximum(far, -here)], axis=2).reshape(len(unit), -1)
            out.append(far <= self.radius)
        return np.stack(out)

    def search(self, margins: np.ndarray) -> list[tuple[float, int, int]]:
        """(priority, tree, leaf) in the order in which one query opens leaves; margins[t][node] are its own."""
        first_leaf = 2**self.depth - 1
        queue = [(-np.inf, tree, 0) for tree in range(len(margins))]
        heapq.heapify(queue)
        opened = []
        while queue:
            far, tree, node = heapq.heappop(queue)
            if far > self.radius:
                break
            if node >= first_leaf:
                opened.append((-far, tree, node - first_leaf))
                continue
            margin = margins[tree][node]
            heapq.heappush(queue, (max(far, margin), tree, 2 * node + 1))
            heapq.heappush(queue, (max(far, -margin), tree, 2 * node + 2))
        return opened


def grown(sample: np.ndarray, trees: int, depth: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    inner = 2**depth - 1
    directions = rng.standard_normal((trees, inner, sample.shape[1]))
    directions /= np.linalg.norm(directions, axis=2, keepdims=True)
    thresholds = np.zeros((trees, inner))
    for tree in range(trees):
        node = np.zeros(len(sample), dtype=np.int64)
        for level in range(depth):
            projected = np.einsum("ij,ij->i", sample, directions[tree][node])
            for at in range(2**level - 1, 2 ** (level + 1) - 1):
                mine = projected[node == at]
                thresholds[tree][at] = np.median(mine) if len(mine) else 0.0
            node = 2 * node + 1 + (projected > thresholds[tree][node])
    return directions, thresholds


def _nearest_of_sample(unit: np.ndarray, queries: np.ndarray, nearest: int) -> np.ndarray:
    score = unit[queries] @ unit.T
    score[np.arange(len(queries)), queries] = -np.inf
    return np.argsort(-score, axis=1, kind="stable")[:, :nearest]


def fitted(sample: np.ndarray, rows: int, nearest: int = NEAREST, trees: int = TREES, recall: float = RECALL, seed: int = 11) -> Forest:
    """Trees of leaves of about LEAF_ROWS of all rows, and the radius that reaches `recall` on the sample."""
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    most = max(0, int(np.log2(max(1, len(unit) / LEAST_LEAF_SAMPLE))))
    depth = min(most, max(0, int(np.ceil(np.log2(max(1.0, rows / LEAF_ROWS))))))
    directions, thresholds = grown(unit, trees, depth, seed)
    forest = Forest(directions, thresholds, depth, np.inf)
    queries = np.random.default_rng(seed).choice(len(unit), min(SAMPLE_QUERIES, len(unit)), replace=False)
    near = np.concatenate([_nearest_of_sample(unit, queries[i : i + 25], min(nearest, len(unit) - 1)) for i in range(0, len(queries), 25)])
    best = np.full(near.shape, -np.inf)
    for tree in range(trees):
        margins = unit[queries] @ directions[tree].T - thresholds[tree]
        priority = np.full((len(queries), 1), np.inf)
        for level in range(depth):
            here = margins[:, 2**level - 1 : 2 ** (level + 1) - 1]
            priority = np.stack([np.minimum(priority, -here), np.minimum(priority, here)], axis=2).reshape(len(queries), -1)
        leaf = forest.leaves(unit, tree)
        best = np.maximum(best, np.take_along_axis(priority, leaf[near], axis=1))
    radius = max(0.0, float(-np.quantile(best, 1 - recall))) if best.size else 0.0
    return Forest(directions, thresholds, depth, radius)


def usable(table: DataFrame, key: str, vector: str) -> DataFrame:
    """id and v of the rows that take part. v is the vector by a power of two that brings its largest component near one:
    no digit and no cosine changes, and no square overflows or vanishes."""
    value = F.col(vector).cast("array<double>")
    good = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = (
        table.select(F.col(key).cast("long").alias("id"), value.alias("v"))
        .where(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & good)
        .where(F.exists("v", lambda x: x != 0))
    )
    power = F.least(F.floor(F.log2(F.array_max(F.transform("v", lambda x: F.abs(x))))), F.lit(1022))
    scaled = rows.withColumn("_scale", F.pow(F.lit(2.0), power.cast("double")))
    return scaled.select("id", F.transform("v", lambda x: x / F.col("_scale")).alias("v"))


def _matrix(column: pa.ChunkedArray, size: int) -> np.ndarray:
    return np.concatenate([np.empty(0), *(c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks)]).reshape(-1, size)


def _sample(rows: DataFrame, total: int, bound: int) -> pa.ChunkedArray:
    """Vectors of the `bound` least hashes of ids. Only rows under a hash that about twice as many stay below are sorted;
    ids may be too uneven for that, then all are."""
    place = F.xxhash64("id")
    share_of_all = 2 * bound / total
    under = [rows.where(place < int(-(2**63) + share_of_all * 2**64))] if share_of_all < 0.9 else []
    for some in (*under, rows):
        drawn = some.orderBy(place, "id").limit(bound).select("v").toArrow().column(0)
        if len(drawn) == bound:
            break
    return drawn


def exact_scores(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Cosine of one query with rows; the same two vectors give the same number wherever they meet."""
    return (rows * query).sum(axis=1) / (np.sqrt((query * query).sum()) * np.sqrt((rows * rows).sum(axis=1)))


def _opened_pairs(forest: Forest, q_ids, queries, r_ids, rows, leaf, nearest: int) -> list[np.ndarray]:
    """(query id, row id, exact score) of the nearest rows, of those whose leaf is opened in any tree, for a block of queries.

    The quick scores of one matrix product may differ in their last digits, so all near the edge are scored again. The
    edge of a query is the best so far of its nearest-th quick scores in one chunk of rows; no row below it can be nearest."""
    trees = range(len(forest.directions))
    unit_q = queries / np.linalg.norm(queries, axis=1, keepdims=True)
    opened = forest.opened(unit_q)
    wanted = opened.any(axis=1)
    some = np.flatnonzero(np.logical_or.reduce([wanted[t][leaf[t]] for t in trees]))
    edge = np.full(len(q_ids), -np.inf)
    best = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
    for start in range(0, len(some), ROW_BLOCK):
        at = some[start : start + ROW_BLOCK]
        vectors, ids = rows[at], r_ids[at]
        quick = unit_q @ (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)).T
        inside = opened[0][:, leaf[0][at]]
        for t in trees[1:]:
            inside |= opened[t][:, leaf[t][at]]
        quick[~inside | (q_ids[:, None] == ids[None, :])] = -np.inf
        k = min(nearest, len(ids))
        edge = np.maximum(edge, np.partition(quick, len(ids) - k, axis=1)[:, len(ids) - k]) if k == nearest else edge
        query, row = np.nonzero((quick >= edge[:, None] - 1e-9) & (quick > -np.inf))
        one, two = queries[query], vectors[row]
        scores = (one * two).sum(axis=1) / (np.sqrt((one * one).sum(axis=1)) * np.sqrt((two * two).sum(axis=1)))
        best = _best(*(np.concatenate(c) for c in zip(best, (q_ids[query], ids[row], scores), strict=True)), nearest)
    return best


def _best(query: np.ndarray, row: np.ndarray, score: np.ndarray, nearest: int) -> list[np.ndarray]:
    """The nearest rows of each query, each row once with its best score."""
    order = np.lexsort((-score, row, query))
    query, row, score = query[order], row[order], score[order]
    first = np.concatenate([[True], (query[1:] != query[:-1]) | (row[1:] != row[:-1])])[: len(query)]
    query, row, score = query[first], row[first], score[first]
    order = np.lexsort((row, -score, query))
    query, row, score = query[order], row[order], score[order]
    starts = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1]])[: len(query)])
    place = np.arange(len(query)) - np.repeat(starts, np.diff(np.append(starts, len(query))))
    return [query[place < nearest], row[place < nearest], score[place < nearest]]


def nearest_rows(
    table: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", nearest: int = NEAREST, recall: float = RECALL
) -> DataFrame:
    """The `nearest` rows of `table` found for each row of `queries`: query_id, rank, vec_id, score."""
    spark = table.sparkSession
    rows = usable(table, key, vector)
    total = rows.count()
    schema = "query_id long, rank int, vec_id long, score double"
    if not total:
        return spark.createDataFrame([], schema)
    width = rows.select(F.size("v")).orderBy(F.xxhash64("id"), "id").limit(1000).groupBy("size(v)").count().orderBy(F.desc("count"), "size(v)").first()[0]
    rows = rows.where(F.size("v") == width)
    drawn = _sample(rows, total, max(1, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * width))))
    shared = share(spark, fitted(_matrix(drawn, width), total, nearest, recall=recall))

    same = W.partitionBy("v").orderBy("id")
    kept = rows.withColumn("place", F.row_number().over(same)).where(F.col("place") <= nearest + 1).select("id", "v")
    asked = usable(queries, key, vector).where(F.size("v") == width)
    most = max(1, GROUP_BYTES // (8 * width))
    parts = max(-(-total // most), min(-(-total // LEAST_GROUP), 2 * spark.sparkContext.defaultParallelism))
    turns = -(-max(1, asked.count()) // most)

    def rank(ours, theirs):
        forest = shared.value
        r_ids, rows = ours.column("id").to_numpy(), _matrix(ours.column("v"), width)
        leaf = np.empty((len(forest.directions), len(r_ids)), dtype=np.int32)
        for start in range(0, len(r_ids), ROW_BLOCK):
            part = rows[start : start + ROW_BLOCK]
            unit = part / np.linalg.norm(part, axis=1, keepdims=True)
            for tree in range(len(leaf)):
                leaf[tree, start : start + ROW_BLOCK] = forest.leaves(unit, tree)
        q_ids, asking = theirs.column("id").to_numpy(), _matrix(theirs.column("v"), width)
        order = np.argsort(forest.leaves(asking / np.linalg.norm(asking, axis=1, keepdims=True), 0), kind="stable")
        found = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
        for start in range(0, len(order) if len(r_ids) else 0, QUERY_BLOCK):
            at = order[start : start + QUERY_BLOCK]
            mine = _opened_pairs(forest, q_ids[at], asking[at], r_ids, rows, leaf, nearest)
            found = [np.concatenate(c) for c in zip(found, mine, strict=True)]
        return pa.table([pa.array(c) for c in found], names=["query_id", "vec_id", "score"])

    def dealt(frame: DataFrame, part, turn) -> DataFrame:
        return frame.withColumns({"part": part, "turn": turn}).repartition(parts * turns, "part", "turn").groupBy("part", "turn")

    def number(count: int, *columns: str):
        return F.pmod(F.xxhash64(*columns), F.lit(count)).cast("int")

    def every(count: int):
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    ours = dealt(kept.withColumn("turn", every(turns)), number(parts, "id", "v"), F.col("turn"))
    theirs = dealt(asked.withColumn("part", every(parts)), F.col("part"), number(turns, "id"))
    met = ours.cogroup(theirs).applyInArrow(rank, "query_id long, vec_id long, score double")
    found = met.repartition("query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= nearest).select("query_id", "rank", "vec_id", "score")
    )


def report(embeddings: DataFrame) -> DataFrame:
    """The five nearest of every row whose id is divisible by 50."""
    return nearest_rows(embeddings, embeddings.where(F.col("vec_id") % 50 == 0))
