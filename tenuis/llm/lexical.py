"""Ranked lexical search of many items at once, with the common parts of the items evaluated once.

An item is a sum of weighted term contributions. Items share terms, so their sums share parts: the terms of each item
are put in one order (most shared first), neighbours that stand side by side in two or more items become a node, and
that is repeated on the shortened items until no neighbours are shared. The result is a graph without cycles: leaves
are terms with their multiplicity, inner nodes are sums of two nodes, and each item is a list of nodes. A document's
accumulator of a node is made once, by one addition of whole arrays for a slice of documents, and every item above it
reads it.

Spark does three things. One scan of the texts counts the terms of the items (`postings`, stored once in the shared
folder: ids and counts only). Sums over it give the corpus size, its length and the document frequencies. A second scan,
of the stored counts, evaluates the graph by slices of documents and keeps the best of each item; partial lists meet by
(item, bucket), then by item.

The items are taken in blocks of bounded size. A block's terms and graph are broadcast, with their size checked; the
texts are scanned once for each block. All arithmetic but the logarithm is in whole numbers.

Defined results: a null or empty text, or one without terms, is no document of the corpus (it counts neither in N nor in
L) and ranks nowhere; texts are read whole; an item without terms, or whose terms occur nowhere, has no rows; equal
scores are ordered by doc_id, those without an id last; repeated documents rank one after another; repeated rows of an
item (same id and text) count once, rows with the same id and other texts are ranked each by itself; an empty table gives
no rows; other columns are never read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tenuis.llm.common import lists, share
from tenuis.session import stored

BEST = 10
#: Bytes of item texts in a block.
BLOCK_BYTES = 8 << 20
#: Bytes of accumulators in a slice of documents.
SLICE_BYTES = 24 << 20
#: Buckets of an item's partial lists.
BUCKETS = 64

#: Bytes outside terms become spaces, A-Z become a-z. Bytes from 0x80 on belong to terms.
_TERM_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


def terms_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TERM_BYTES).split() if text else []


@dataclass(frozen=True)
class Graph:
    """Leaf i is `leaves[i]` = (term number, multiplicity); node len(leaves) + j is the sum of left[j] and right[j]. Level
    k of the nodes ends at ends[k] and needs only what comes before it. `roots` has the nodes of each item."""

    leaves: list[tuple[int, int]]
    left: np.ndarray
    right: np.ndarray
    ends: list[int]
    roots: list[list[int]]

    @property
    def size(self) -> int:
        return len(self.leaves) + len(self.left)


def shared_graph(items: list[dict[int, int]]) -> Graph:
    """The sharing graph of items given as {term number: multiplicity}."""
    support = Counter(leaf for item in items for leaf in item.items())
    leaves = sorted(support, key=lambda leaf: (-support[leaf], leaf))
    number = {leaf: n for n, leaf in enumerate(leaves)}
    rows = [sorted(number[leaf] for leaf in item.items()) for item in items]
    left: list[int] = []
    right: list[int] = []
    ends: list[int] = []
    while True:
        pairs = Counter(pair for row in rows for pair in zip(row, row[1:], strict=False))
        good = {pair for pair, times in pairs.items() if times > 1}
        if not good:
            return Graph(leaves, np.array(left, np.int64), np.array(right, np.int64), ends, rows)
        made: dict[tuple[int, int], int] = {}
        taken: Counter = Counter()
        for row in rows:
            taken.update(_chosen(row, good, pairs))
        rows = [_shortened(row, good, pairs, taken, made, len(leaves) + len(left)) for row in rows]
        if not made:
            return Graph(leaves, np.array(left, np.int64), np.array(right, np.int64), ends, rows)
        left += [a for a, _ in made]
        right += [b for _, b in made]
        ends.append(len(left))


def _chosen(row: list[int], good: set, pairs: Counter) -> list[tuple[int, int]]:
    """Pairs of neighbours that don't overlap, the most shared ones first."""
    places = sorted((p for p in range(len(row) - 1) if (row[p], row[p + 1]) in good), key=lambda p: (-pairs[row[p], row[p + 1]], p))
    used: set[int] = set()
    out = []
    for p in places:
        if p not in used and p + 1 not in used:
            used |= {p, p + 1}
            out.append((row[p], row[p + 1]))
    return out


def _shortened(row: list[int], good: set, pairs: Counter, taken: Counter, made: dict, first: int) -> list[int]:
    """The row with its chosen pairs replaced, where at least two rows chose the same pair."""
    chosen = {pair for pair in _chosen(row, good, pairs) if taken[pair] > 1}
    out, p = [], 0
    while p < len(row):
        pair = (row[p], row[p + 1]) if p + 1 < len(row) else None
        if pair in chosen:
            out.append(made.setdefault(pair, first + len(made)))
            p += 2
        else:
            out.append(row[p])
            p += 1
    return out


def accumulators(graph: Graph, contributions: np.ndarray) -> np.ndarray:
    """Scores (items x documents) from the contributions (terms x documents): every node is summed once."""
    count = len(graph.leaves)
    sums = np.empty((graph.size, contributions.shape[1]), np.int64)
    numbers = np.array([t for t, _ in graph.leaves], np.int64)
    times = np.array([m for _, m in graph.leaves], np.int64)
    np.multiply(contributions[numbers], times[:, None], out=sums[:count])
    start = 0
    for end in graph.ends:
        np.add(sums[graph.left[start:end]], sums[graph.right[start:end]], out=sums[count + start : count + end])
        start = end
    return np.stack([sums[nodes].sum(axis=0) for nodes in graph.roots])


def blocks_of(items: Iterable[tuple], most: int = BLOCK_BYTES) -> Iterator[list[tuple]]:
    """(id, text) rows in blocks of at most `most` bytes, or of a single longer item."""
    block, size = [], 0
    for item in items:
        more = len((item[1] or "").encode("utf-8", "surrogatepass"))
        if block and size + more > most:
            yield block
            block, size = [], 0
        block.append(item)
        size += more
    if block:
        yield block


def postings(docs: DataFrame, vocabulary: dict[bytes, int], key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n (terms with repeats) of the documents with terms; numbers and counts of those in the vocabulary."""
    shared = share(docs.sparkSession, vocabulary)

    def run(batches):
        known = shared.value
        for batch in batches:
            keep, totals, numbers, counts, sizes = [], [], [], [], []
            for row, value in enumerate(batch.column(1)):
                terms = terms_of(value.as_py())
                if not terms:
                    continue
                tally = Counter(terms)
                found = [(known[t], tally[t]) for t in tally.keys() & known.keys()]
                keep.append(row)
                totals.append(len(terms))
                sizes.append(len(found))
                for number, count in sorted(found):
                    numbers.append(number)
                    counts.append(count)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(keep, pa.int64())), pa.array(totals, pa.int64()),
                    lists(np.array(numbers, np.int32), sizes, pa.int32()), lists(np.array(counts, np.int64), sizes, pa.int64()),
                ],
                names=["doc_id", "n", "terms", "counts"],
            )

    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, n long, terms array<int>, counts array<long>")


class _Best:
    """The best rows of each item so far. Rows that can't be among them are left out before they are kept."""

    def __init__(self, items: int, best: int):
        self.best, self.edge = best, np.ones(items, np.int64)
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, scores: np.ndarray, ids: np.ndarray, named: np.ndarray) -> None:
        item, doc = np.nonzero(scores >= self.edge[:, None])
        self.parts.append((item, scores[item, doc], ids[doc], named[doc]))
        self.size += len(item)
        if self.size > 4 * self.best * len(self.edge) + 10_000:
            self.cut()

    def cut(self) -> tuple[np.ndarray, ...]:
        item, score, ids, named = (np.concatenate(c) for c in zip(*self.parts, strict=True))
        order = np.lexsort((ids, ~named, -score, item))
        item, score, ids, named = item[order], score[order], ids[order], named[order]
        starts = np.flatnonzero(np.concatenate([[True], item[1:] != item[:-1]])[: len(item)])
        place = np.arange(len(item)) - np.repeat(starts, np.diff(np.append(starts, len(item))))
        last = place == self.best - 1
        self.edge[item[last]] = score[last]
        keep = place < self.best
        kept = item[keep], score[keep], ids[keep], named[keep]
        self.parts, self.size = [kept], int(keep.sum())
        return kept


def _ranked(stored_counts: DataFrame, weights: np.ndarray, graph: Graph, documents: int, length: int, best: int) -> DataFrame:
    """item (number in the block), score, doc_id: the best of each partition."""
    shared = share(stored_counts.sparkSession, (weights, graph))

    def run(batches):
        weights, graph = shared.value
        state = _Best(len(graph.roots), best)
        step = max(8, SLICE_BYTES // (8 * (graph.size + len(weights))))
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                # Python's numbers don't overflow in 75 * n * N.
                m = np.array([25 + (75 * n * documents) // length for n in part.column(1).to_pylist()], np.int64)
                sizes = part.column(2).value_lengths().to_numpy(zero_copy_only=False)
                doc = np.repeat(np.arange(part.num_rows), sizes)
                term = part.column(2).flatten().to_numpy()
                tf = part.column(3).flatten().to_numpy()
                table = np.zeros((len(weights), part.num_rows), np.int64)
                table[term, doc] = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))
                ids = part.column(0)
                named = ids.is_valid().to_numpy(zero_copy_only=False)
                state.add(accumulators(graph, table), ids.fill_null(0).to_numpy(), named)
        if state.parts:
            item, score, ids, named = state.cut()
            yield pa.RecordBatch.from_arrays(
                [pa.array(item, pa.int32()), pa.array(score, pa.int64()), pa.array(ids, pa.int64(), mask=~named)], names=["item", "score", "doc_id"]
            )

    return stored_counts.mapInArrow(run, "item int, score long, doc_id long")


def weight(documents: int, frequency: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * frequency + 1)))


def search(
    docs: DataFrame, items: DataFrame, best: int = BEST, key: str = "doc_id", text: str = "text", item: str = "item_id",
    item_text: str = "text", block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """item, rank, doc_id, score of the best documents for each item."""
    spark = docs.sparkSession
    kind = items.schema[item].dataType
    rows = items.select(F.col(item).alias("item_id"), F.col(item_text).cast("string").alias("text")).distinct().orderBy("item_id", "text")
    found = [_block(docs, block, kind, best, key, text) for block in blocks_of(map(tuple, rows.toLocalIterator()), block_bytes)]
    empty = spark.createDataFrame([], f"item_id {kind.simpleString()}, rank int, doc_id long, score long")
    if len(found) > 1:
        found = [stored(part, "ranks") for part in found]
    out = found[0] if found else empty
    for part in found[1:]:
        out = out.unionByName(part)
    return out


def _block(docs: DataFrame, block: list[tuple], kind, best: int, key: str, text: str) -> DataFrame:
    spark = docs.sparkSession
    tallies = [Counter(terms_of(value)) for _, value in block]
    vocabulary = {term: number for number, term in enumerate(sorted(set().union(*tallies)))}
    graph = shared_graph([{vocabulary[t]: m for t, m in tally.items()} for tally in tallies])
    counts = stored(postings(docs, vocabulary, key, text), "postings")
    total = counts.agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("length")).first()
    # At most one row for each term of the block.
    frequency = dict(counts.select(F.explode("terms").alias("term")).groupBy("term").count().collect())
    weights = np.array([weight(total["documents"], frequency[t]) if t in frequency else 0 for t in range(len(vocabulary))], np.int64)
    ranked = _ranked(counts, weights, graph, total["documents"], total["length"], best)
    names = spark.createDataFrame([(number, row[0]) for number, row in enumerate(block)], f"item int, item_id {kind.simpleString()}")

    def cut(rows: DataFrame, *group) -> DataFrame:
        order = W.partitionBy(*group).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)

    merged = ranked.withColumn("bucket", F.spark_partition_id() % BUCKETS)
    merged = cut(cut(merged, "item", "bucket").drop("rank", "bucket"), "item")
    return merged.join(names, "item").select("item_id", "rank", "doc_id", "score")


def report(docs: DataFrame, items: DataFrame) -> DataFrame:
    return search(docs, items)


ORACLE_SQL = r"""
WITH words AS (
  SELECT row_number() OVER () AS d, doc_id,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), docs AS (SELECT d, doc_id, terms, CAST(len(terms) AS BIGINT) AS n FROM words WHERE len(terms) > 0
), total AS (SELECT CAST(count(*) AS BIGINT) AS all_docs, CAST(sum(n) AS BIGINT) AS all_terms FROM docs
), tf AS (SELECT d, term, count(*) AS tf FROM (SELECT d, unnest(terms) AS term FROM docs) GROUP BY ALL
), item_terms AS (
  SELECT item_id, text, term, count(*) AS times FROM (
    SELECT item_id, text, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY ALL
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * any_value(all_docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w
  FROM tf, total WHERE term IN (SELECT term FROM item_terms) GROUP BY term
), scored AS (
  SELECT item_id, text, docs.d, any_value(doc_id) AS doc_id,
    CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * n * all_docs) // all_terms))))) AS BIGINT) AS score
  FROM item_terms JOIN tf USING (term) JOIN weights USING (term) JOIN docs USING (d), total GROUP BY item_id, text, docs.d
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS LAST) AS place FROM scored WHERE score > 0
)
SELECT item_id, CAST(place AS INTEGER) AS rank, doc_id, score FROM ranked WHERE place <= 10
"""
