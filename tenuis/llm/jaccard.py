"""N-gram Jaccard join with signature trees.

A document is the set of its distinct word shingles; documents of one set are one node. Two nodes link when their
Jaccard similarity is THRESHOLD percent or more. The join gives the components of the link graph: every link between
different components is looked for, links inside a component that is already known are pruned.

1. *Prefix filter.* Shingles are ordered by their hash. Linked sets share at least `_reach(n)` of their first
   n - ceil(0.75 n) + _reach(n) shingles, so a node with fewer shared ones has no partner. What is left are candidates.
2. *Cells.* Linked candidates share a shingle of their first n - ceil(0.75 n) + 1, in any order that is the same for
   all; here the shingles that most candidates share come last, so that a shared passage makes no cell. The candidates
   of one such shingle are a cell; a cell is cut into blocks of at most BLOCK rows, and blocks meet in pairs.
3. *Signature trees.* The rows of a cell are the leaves of a tree. A tree node holds the OR of its token bitmaps, its
   range of set sizes and its component, if it has only one. A dual traversal starts with the pair of the root with
   itself and drops a pair of nodes when the greatest possible overlap is below the least one needed, when the size
   ranges are too far apart, or when both are of one component. All cells of a batch go down level by level together.
4. *Rounds.* In each of the first rounds a candidate proposes its PARTNERS most promising partners of few cells, which
   are others each time; verified links give components, and later rounds take only cells that still hold several. In the
   last round all such cells are traversed, and all pairs that cannot be ruled out are verified on the full sets. In a
   cell whose rows are mostly of one component, only the others meet all blocks. A pair meets in the cells of all shingles
   it shares: it is given only where none of the last BEFORE ones of both is shared, for it met there already.

Sizes: rows of a cell or of a hot shingle spread over blocks; pairs are only proposed between components, so a group of
copies costs rows in proportion to its size. Components contract by stars, with a durable checkpoint each round.

Defined results: a null or empty text, or one without words, has an empty set (n_shingles 0) and is alone; fewer words
than a shingle give one shingle of all; a row without an id gets component null and links nothing; repeated rows give
repeated results; rows of one id with different texts are different documents with one id; other columns are not read.
Sets are compared by 64-bit hashes of their shingles.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_64_intdigest

from tenuis.llm.common import lists, share, with_text_columns
from tenuis.operators.graph import components
from tenuis.session import cut_lineage

WORDS = 5
THRESHOLD = 75
BITS = 2048
BLOCK = 256
FANOUT = 8
FIRST_CELLS = 4
PARTNERS = 4
#: Rounds of few cells, and how many earlier cells a row of the last round knows.
FEW_ROUNDS = 2
BEFORE = 4
#: Stored sets and prefix rows that one task reads.
SETS_PER_TASK = 5_000
ROWS_PER_TASK = 250_000
#: Up to so many ids of candidates are broadcast to the texts, and pairs to the sets.
BROADCAST_IDS = 4_000_000
#: Bound of the list of frequent shingles, and from how many sets on one is frequent.
HOT_MOST = 200_000
HOT_LEAST = 16

_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_MIX = [np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def shingles(text: str | None, size: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text."""
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []
    if len(words) < size:
        return np.array([xxh3_64_intdigest(b" ".join(words), seed=1)] if words else [], dtype=np.uint64).view(np.int64)
    hashed = np.fromiter(map(xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    count = len(words) - size + 1
    out = np.zeros(count, dtype=np.uint64)
    for at in range(size):
        out = (out ^ hashed[at : at + count]) * _MIX[at % len(_MIX)]
        out ^= out >> np.uint64(29)
    return np.unique(out.view(np.int64))


def _reach(n):
    """How many shared prefix shingles step 1 asks for."""
    return n // 10 + 1


def _least(n: int) -> int:
    """The least overlap a set of n can have with a linked one."""
    return -(-THRESHOLD * n // 100)


def node_of(hashes: np.ndarray) -> int:
    return int(np.uint64(xxh3_64_intdigest(hashes.tobytes())).view(np.int64))


def node_table(documents: DataFrame, key: str, text: str, prefix: bool) -> DataFrame:
    """key, n, node (null for an empty set) and, if asked for, the prefix of step 1, per row."""
    fields = [T.StructField("n", T.LongType()), T.StructField("node", T.LongType())]
    if prefix:
        fields.append(T.StructField("prefix", T.ArrayType(T.LongType())))

    def work():
        def compute(texts):
            numbers, nodes, prefixes = [], [], []
            for value in texts:
                hashes = shingles(value)
                n = len(hashes)
                numbers.append(n)
                nodes.append(node_of(hashes) if n else None)
                if prefix:
                    prefixes.append(hashes[: n - _least(n) + _reach(n)])
            if not prefix:
                return [numbers, nodes]
            flat = np.concatenate(prefixes) if prefixes else np.zeros(0, np.int64)
            return [numbers, nodes, lists(flat, [len(p) for p in prefixes], pa.int64())]

        return compute

    return with_text_columns(documents, [key], text, fields, work)


def set_table(documents: DataFrame, text: str) -> DataFrame:
    """node, n, hashes (sorted) and sig (the token bitmap) of the texts."""
    fields = [
        T.StructField("node", T.LongType()), T.StructField("n", T.LongType()),
        T.StructField("hashes", T.ArrayType(T.LongType())), T.StructField("sig", T.BinaryType()),
    ]

    def work():
        def compute(texts):
            sets = [shingles(t) for t in texts]
            flat = np.concatenate(sets) if sets else np.zeros(0, np.int64)
            return [
                [node_of(s) for s in sets], [len(s) for s in sets], lists(flat, [len(s) for s in sets], pa.int64()),
                [signature(s).tobytes() for s in sets],
            ]

        return compute

    return with_text_columns(documents, [], text, fields, work)


def signature(hashes: np.ndarray) -> np.ndarray:
    bits = np.zeros(BITS, dtype=bool)
    bits[hashes & (BITS - 1)] = True
    return np.packbits(bits, bitorder="little").view(np.uint64)


class Forest:
    """The signature trees of several cells, all levels in flat arrays. Rows must be sorted by cell."""

    def __init__(self, cell: np.ndarray, size: np.ndarray, sig: np.ndarray, label: np.ndarray):
        spare = size - np.bitwise_count(sig).sum(axis=1, dtype=np.int64)
        self.levels = [(cell, size, size, sig, label, spare, np.ones(len(cell), dtype=bool))]
        self.starts: list[np.ndarray] = []
        while True:
            cell, low, high, sig, label, spare, pure = self.levels[-1]
            first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
            counts = np.diff(np.append(first, len(cell)))
            if counts.max(initial=1) == 1:
                break
            within = np.arange(len(cell)) - np.repeat(first, counts)
            start = np.flatnonzero(within % FANOUT == 0)
            self.starts.append(start)
            same = np.minimum.reduceat(label, start) == np.maximum.reduceat(label, start)
            self.levels.append((
                cell[start], np.minimum.reduceat(low, start), np.maximum.reduceat(high, start), np.bitwise_or.reduceat(sig, start, axis=0),
                label[start], np.maximum.reduceat(spare, start), same & np.logical_and.reduceat(pure, start),
            ))

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row pairs (a < b) of one cell and different components that may link, and their greatest possible overlap."""
        left = right = np.arange(len(self.levels[-1][0]))
        for depth in range(len(self.levels) - 1, -1, -1):
            left, right, most = self._alive(depth, left, right)
            if depth:
                left, right = self._children(depth - 1, left, right)
        return left, right, most

    def _alive(self, depth: int, left: np.ndarray, right: np.ndarray):
        _, low, high, sig, label, spare, pure = self.levels[depth]
        keep = (100 * high[left] >= THRESHOLD * low[right]) & (100 * high[right] >= THRESHOLD * low[left])
        keep &= ~(pure[left] & pure[right] & (label[left] == label[right]))
        left, right = left[keep], right[keep]
        most = np.empty(len(left), dtype=np.int64)
        for at in range(0, len(left), 50_000):
            a, b = left[at : at + 50_000], right[at : at + 50_000]
            if depth:
                # Shared tokens have their bits in both bitmaps; a bit stands for several only as far as sets have spare tokens.
                common = np.bitwise_count(sig[a] & sig[b]).sum(axis=1, dtype=np.int64)
                most[at : at + 50_000] = common + np.minimum(spare[a], spare[b])
            else:
                only_a = np.bitwise_count(sig[a] & ~sig[b]).sum(axis=1, dtype=np.int64)
                only_b = np.bitwise_count(sig[b] & ~sig[a]).sum(axis=1, dtype=np.int64)
                most[at : at + 50_000] = np.minimum(low[a] - only_a, low[b] - only_b)
        most = np.minimum(most, np.minimum(high[left], high[right]))
        # overlap >= t * union is the same as (100 + t) * overlap >= t * (sum of sizes)
        keep = (100 + THRESHOLD) * most >= THRESHOLD * (low[left] + low[right])
        return left[keep], right[keep], most[keep]

    def _children(self, depth: int, left: np.ndarray, right: np.ndarray):
        start = self.starts[depth]
        count = np.diff(np.append(start, len(self.levels[depth][0])))
        times = count[left] * count[right]
        pair = np.repeat(np.arange(len(left)), times)
        place = np.arange(len(pair)) - np.repeat(np.cumsum(times) - times, times)
        wide = count[right][pair]
        a, b = start[left][pair] + place // wide, start[right][pair] + place % wide
        # Below a node paired with itself each pair of children counts once; two rows always differ.
        keep = (a <= b) if depth else (a < b)
        keep |= left[pair] != right[pair]
        return a[keep], b[keep]


_BEFORE = [f"before{i}" for i in range(1, BEFORE + 1)]


def first_meeting(n: np.ndarray, at: np.ndarray, before: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """False for the row pairs (a, b) of a cell that met in a cell before, and for those that can't link if they didn't:
    then all they share comes from this place on."""
    most = np.minimum(n[a] - at[a], n[b] - at[b])
    new = (100 + THRESHOLD) * most >= THRESHOLD * (n[a] + n[b])
    for one in before:
        for other in before:
            new &= one[a] != other[b]
    return new


def _with_before(rows: DataFrame) -> DataFrame:
    """Each row of a node once, with the tokens of its BEFORE rows before; where there is none, the node itself stands."""
    order = W.partitionBy("node").orderBy("at")
    once = rows.withColumn("_last", F.lag("at").over(order)).where(F.col("_last").isNull() | (F.col("_last") != F.col("at"))).drop("_last")
    return once.withColumns({name: F.coalesce(F.lag("token", i).over(order), "node") for i, name in enumerate(_BEFORE, 1)})


def _with_partner(rows: DataFrame) -> DataFrame:
    """The rows of cells of different labels that have a row of a size in the cell with which they could link, if their
    shingle is the first that both share."""
    order = W.partitionBy("token").orderBy("n", "node")
    # At most n - at are shared, so a partner's size m has (100 + THRESHOLD) * (n - at) >= THRESHOLD * (n + m).
    smaller = F.lag("n").over(order) * 100 >= F.col("n") * THRESHOLD
    larger = (F.lead("n").over(order) + F.col("n")) * THRESHOLD <= (F.col("n") - F.col("at")) * (100 + THRESHOLD)
    kept = rows.withColumn("_near", F.coalesce(smaller, F.lit(False)) | F.coalesce(larger, F.lit(False))).where("_near").drop("_near")
    return _shared(kept, "label")


def _proposals(cells: DataFrame, partners: int | None) -> DataFrame:
    """Pairs (a, b) of nodes from cells with columns cell (any type), node, n, sig, label: the most promising
    `partners` of each node, or all. For all, cells also have the place `at` of their shingle in the prefix and the cells
    `before` it."""
    before = [] if partners else ["at", *_BEFORE]
    columns = ["cell", "node", "n", "sig", "label", *before]
    sorted_cells = (
        cells.withColumn("cell", F.xxhash64("cell")).select(*columns).repartition("cell").sortWithinPartitions("cell", "n", "node")
    )

    def traverse(rows: list[np.ndarray]):
        cell, node, n, sig, label, *seen = rows
        out = []
        edges = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1], [True]]))
        at = 0
        while at < len(edges) - 1:
            # Some cells at a time, so that the frontier of pairs stays small.
            to = max(at + 1, int(np.searchsorted(edges, edges[at] + 2048, side="right")) - 1)
            part = slice(edges[at], edges[to])
            at = to
            a, b, most = Forest(cell[part], n[part], sig[part], label[part]).pairs()
            names = node[part]
            if not len(a):
                continue
            if seen:
                new = first_meeting(n[part], seen[0][part], [s[part] for s in seen[1:]], a, b)
                a, b, most = a[new], b[new], most[new]
            likeness = most / (n[part][a] + n[part][b] - most)
            if partners:
                a, b, likeness = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([likeness, likeness])
                order = np.lexsort((names[b], -likeness, a))
                a, b, likeness = a[order], b[order], likeness[order]
                starts = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
                few = np.arange(len(a)) - np.repeat(starts, np.diff(np.append(starts, len(a)))) < partners
                a, b, likeness = a[few], b[few], likeness[few]
            out.append((names[a], names[b], likeness))
        return out

    def run(batches):
        rest: list[np.ndarray] | None = None
        for batch in batches:
            rows = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(len(columns)) if i != 3]
            raw = b"".join(batch.column(3).to_pylist())
            rows.insert(3, np.frombuffer(raw, dtype=np.uint64).reshape(-1, BITS // 64))
            if not len(rows[0]):
                continue
            if rest is not None:
                rows = [np.concatenate([old, new]) for old, new in zip(rest, rows, strict=True)]
            # The last cell may go on in the next batch.
            before = np.flatnonzero(rows[0] != rows[0][-1])
            whole = int(before[-1]) + 1 if len(before) else 0
            rest = [r[whole:] for r in rows]
            if whole:
                yield from batch_of(traverse([r[:whole] for r in rows]))
        if rest is not None:
            yield from batch_of(traverse(rest))

    def batch_of(found):
        for a, b, likeness in found:
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(likeness)], names=["a", "b", "likeness"])

    pairs = sorted_cells.select(*columns).mapInArrow(run, "a long, b long, likeness double")
    if partners:
        # The same pair may come from several cells.
        pairs = pairs.groupBy("a", "b").agg(F.max("likeness").alias("likeness"))
        order = W.partitionBy("a").orderBy(F.desc("likeness"), "b")
        pairs = pairs.withColumn("place", F.row_number().over(order)).where(F.col("place") <= partners)
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _beside(pairs: DataFrame, rows: DataFrame, what: str) -> DataFrame:
    """a, b and `what` of both, as left and right. Counted, few pairs go to the rows, which then need no shuffle."""
    few = F.broadcast(pairs) if pairs.count() <= BROADCAST_IDS else pairs
    left = rows.select(F.col("node").alias("a"), F.col(what).alias("left")).join(few, "a")
    right = rows.select(F.col("node").alias("b"), F.col(what).alias("right")).join(few, "b")
    return left.join(right, ["a", "b"]).select("a", "b", "left", "right")


def wide_bitmap(hashes: np.ndarray) -> bytes:
    """Bits of the hashes of a set, eight or more for each; its first eight bytes are the size of the set."""
    size = 64 << max(0, len(hashes) - 1).bit_length() >> 3
    bits = np.zeros(max(64, size), dtype=bool)
    bits[hashes & (len(bits) - 1)] = True
    return len(hashes).to_bytes(8, "little") + np.packbits(bits, bitorder="little").tobytes()


def may_link(left: bytes, right: bytes) -> bool:
    """Whether sets with these wide bitmaps can be similar enough: a bit of one alone is a token of it alone."""
    (n, a), (m, b) = ((int.from_bytes(w[:8], "little"), np.frombuffer(w, np.uint64, offset=8)) for w in (left, right))
    while len(a) != len(b):
        a, b = (np.bitwise_or(*w.reshape(2, -1)) if len(w) == max(len(a), len(b)) else w for w in (a, b))
    most = min(n - int(np.bitwise_count(a & ~b).sum()), m - int(np.bitwise_count(b & ~a).sum()))
    return (100 + THRESHOLD) * most >= THRESHOLD * (n + m)


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) whose full sets are similar enough. Wide bitmaps, an eighth of the sets, rule out most others first."""

    def widen(batches):
        for batch in batches:
            made = [wide_bitmap(h.values.to_numpy()) for h in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["node", "wide"])

    def rule_out(batches):
        for batch in batches:
            keep = [may_link(one, two) for one, two in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    wide = sets.select("node", "hashes").mapInArrow(widen, "node long, wide binary")
    near = cut_lineage(_beside(cut_lineage(pairs), wide, "wide").mapInArrow(rule_out, "a long, b long"))
    both = F.size(F.array_intersect("left", "right"))
    return (
        _beside(near, sets, "hashes")
        .where((100 + THRESHOLD) * both >= THRESHOLD * (F.size("left") + F.size("right")))
        .select(F.col("a").alias("u"), F.col("b").alias("v"))
    )


def _shared(tokens: DataFrame, what: str) -> DataFrame:
    """The rows whose token is held by rows with different values of `what`."""
    group = W.partitionBy("token")
    return (
        tokens.withColumns({"_low": F.min(what).over(group), "_high": F.max(what).over(group)})
        .where(F.col("_low") != F.col("_high")).drop("_low", "_high")
    )


def _ceil_share(n: Column) -> Column:
    return F.ceil(n * F.lit(THRESHOLD) / 100)


def frequent_shingles(sets: DataFrame) -> list[int]:
    """At most HOT_MOST shingles that candidates share most, the rarest first. They only order prefixes."""
    early = F.slice("hashes", 1, F.ceil(F.col("n") * 0.4).cast("int"))
    counted = sets.select(F.explode(early).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= HOT_LEAST)
    return [r["token"] for r in reversed(counted.orderBy(F.desc("c"), "token").limit(HOT_MOST).collect())]


def prefix_rows(sets: DataFrame, frequent: list[int]) -> DataFrame:
    """node, n, at and token of the prefix of each set: shingles by hash, then frequent ones from the rarest on."""
    hot = np.array(frequent, dtype=np.int64)
    by_hash = np.argsort(hot, kind="stable")
    shared = share(sets.sparkSession, (hot[by_hash], by_hash))

    def run(batches):
        tokens, ranks = shared.value
        for batch in batches:
            out: list[list[np.ndarray]] = [[], [], [], []]
            for node, n, hashes in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                own = hashes.values.to_numpy()
                if len(tokens):
                    near = np.minimum(np.searchsorted(tokens, own), len(tokens) - 1)
                    rank = np.where(tokens[near] == own, ranks[near], -1)
                    own = own[np.argsort(rank, kind="stable")]
                size = n - _least(n) + 1
                out[0].append(np.full(size, node))
                out[1].append(np.full(size, n))
                out[2].append(np.arange(size))
                out[3].append(own[:size])
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in out], names=["node", "n", "at", "token"])

    return sets.select("node", "n", "hashes").mapInArrow(run, "node long, n long, at long, token long")


def _sized(stored: DataFrame, most: int) -> DataFrame:
    """The stored rows in as many tasks as their count asks for, however many partitions they came from."""
    return stored.coalesce(max(1, -(-stored.count() // most)))


def roots_of_candidates(documents: DataFrame, nodes: DataFrame, key: str, text: str) -> DataFrame:
    """node and root of the nodes that may have a partner, after both rounds. `nodes` has key, n and node of all rows.

    Texts are shingled again where that is cheaper than to keep what was made of them.
    """
    named = documents.where(F.col(key).isNotNull())
    distinct = node_table(named, key, text, True).where(F.col("node").isNotNull()).dropDuplicates(["node"])
    tokens = distinct.select("node", F.explode("prefix").alias("token"))
    held = _shared(tokens, "node").groupBy("node").agg(F.count(F.lit(1)).alias("held"))
    one = nodes.where(F.col("node").isNotNull() & F.col(key).isNotNull()).groupBy("node").agg(F.min(key).alias(key), F.first("n").alias("n"))
    # A partner may be smaller, and then asks for less.
    asked = F.floor(_ceil_share(F.col("n")) / 10) + 1
    wanted = cut_lineage(held.join(one, "node").where(F.col("held") >= asked).select(key).distinct())
    # Ids of a counted, small number go to the texts; more of them meet the texts in a shuffle.
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted
    # A repeated row gives a repeated set here, which only repeats links.
    sets = _sized(cut_lineage(set_table(named.join(wanted, key, "left_semi"), text)), SETS_PER_TASK)

    rows = _sized(cut_lineage(_shared(prefix_rows(sets, frequent_shingles(sets)), "node")), ROWS_PER_TASK)
    bitmaps = sets.select("node", "sig").dropDuplicates(["node"])
    held = cut_lineage(sets.select("node").distinct())
    mixed, found = rows.withColumn("label", F.col("node")), None
    for turn in range(FEW_ROUNDS):
        # Similar sets have the same shingles first, in any order that is the same for all.
        first = W.partitionBy("node").orderBy(F.xxhash64("token", F.lit(turn)) if turn else "at")
        few = mixed.withColumn("place", F.row_number().over(first)).where(F.col("place") <= FIRST_CELLS)
        place = F.row_number().over(W.partitionBy("token").orderBy("n", "node"))
        near = few.withColumn("block", F.floor((place - 1) / BLOCK)).select(F.struct("token", "block").alias("cell"), "node", "n", "label")
        new = cut_lineage(_verified(_proposals(near.join(bitmaps, "node"), PARTNERS), sets))
        found = found.unionByName(new) if found else new
        labels = cut_lineage(components(held, "node", found))
        mixed = cut_lineage(_shared(rows.join(labels.withColumnRenamed("root", "label"), "node"), "label"))

    mixed = _with_partner(_with_before(mixed))
    counts = mixed.groupBy("token", "label").agg(F.count(F.lit(1)).alias("c"))
    main = counts.groupBy("token").agg(F.max_by("label", F.struct("c", "label")).alias("main"), F.max("c").alias("mains"), F.sum("c").alias("all"))
    order = W.partitionBy("token").orderBy(F.col("label") == F.col("main"), "n", "node")
    numbered = mixed.join(main, "token").withColumn("block", F.floor((F.row_number().over(order) - 1) / BLOCK))
    others = F.ceil((F.col("all") - F.col("mains")) / BLOCK)
    last = F.floor((F.col("all") - 1) / BLOCK)
    meets = F.when(F.col("block") < others, F.sequence(F.lit(0).cast("long"), last)).otherwise(F.sequence(F.lit(0).cast("long"), others - 1))
    paired = numbered.withColumn("with", F.explode(meets)).select(
        F.struct("token", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j")).alias("cell"), "node", "n", "label", "at", *_BEFORE
    )
    more = _verified(_proposals(paired.join(bitmaps, "node"), None), sets)
    return components(held, "node", cut_lineage(found.unionByName(more)))


def joined(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: `key`, n_shingles, component_id (the smallest `key` reachable by links)."""
    nodes = cut_lineage(node_table(documents, key, text, False))
    roots = roots_of_candidates(documents, nodes, key, text)
    smallest = nodes.where(F.col("node").isNotNull() & F.col(key).isNotNull()).groupBy("node").agg(F.min(key).alias("least"))
    rooted = smallest.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    names = cut_lineage(rooted.join(named, "root").select("node", "component_id"))
    return nodes.select(key, "n", "node").join(names, "node", "left").select(
        key,
        F.col("n").alias("n_shingles"),
        F.when(F.col(key).isNotNull(), F.coalesce("component_id", key)).alias("component_id"),
    )


def without_near_copies(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows, with all columns, of one document of each component: the one with the smallest id. Rows without an
    id stay; of repeated rows of one id the first by text stays."""
    kept = joined(documents, key, text).where(F.col(key) == F.col("component_id")).select(key).distinct()
    first = W.partitionBy(key).orderBy(text)
    named = documents.join(kept, key, "left_semi").withColumn("__place", F.row_number().over(first)).where(F.col("__place") == 1)
    return named.select(*documents.columns).unionByName(documents.where(F.col(key).isNull()))


def report(documents: DataFrame) -> DataFrame:
    return joined(documents)


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) END AS s FROM w),
t AS (SELECT doc_id, unnest(s) AS token FROM s),
shared AS (SELECT token FROM t GROUP BY token HAVING count(*) > 1),
ts AS (SELECT doc_id, token FROM t JOIN shared USING (token)),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM ts a JOIN ts b ON a.token = b.token AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (
  SELECT a, b FROM o JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b
  WHERE 100 * c >= 75 * (len(x.s) + len(y.s) - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS found FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.found = e.a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, g.c AS component_id
FROM s JOIN (SELECT doc_id, min(found) AS c FROM r GROUP BY doc_id) g USING (doc_id)
"""
