"""Language-model scoring by masked pseudo-likelihood.

A small network predicts the class of a word from the two words before it and the two behind it: position-dependent
embeddings are summed, pass a tanh and give a softmax over word classes, in two levels. A document's score is the sum, over
all its words, of log P(class | two words on each side) + log P(word | class).

Word classes: the most frequent words of the whole corpus have a class each, all other words share classes by a hash
of their last two letters. Counts cover all words of all documents. The number of frequent words follows the number V
of distinct words: the square root of V, rounded up to a multiple of SLOTS, and at least FREQUENT; words that occur once
have no class of their own. A frequent word has probability 1 in its class. In a shared class of N tokens a word that was counted n times has n / (N + 1), and the 1 / (N + 1)
left is the mass of all words that were never counted.

The counts of all words meet the documents by word in Spark: a scan cuts the documents of a partition into blocks of about
BLOCK_WORDS words or BLOCK_DISTINCT distinct ones, with the distinct words of a block and the documents as numbers in that
list; the lists are joined with the counts, packed by block, and meet the blocks in one shuffle. Words that occur once are
only tallied by class: a word of a block that the counts don't hold is one of them. No table of words is broadcast but the
frequent ones.

Training, in numpy: in each round every partition starts from the shared weights and descends on the round's positions
of all its documents. A hash of document and place deals all positions out over the rounds, so every position trains
exactly once. The weights are then averaged by the number of positions. What one partition sends is the size of the
network; the sums are made by chunk in a shuffle, so nothing grows at the driver. The class sequences are written once
to the shared folder, as rounds and scoring read them again.

Defined results: a null or empty text, or one without words, has no words, score 0 and no mean; words are read whole,
whatever the length of a text; repeated rows get equal scores; ties of frequency go to the smaller word; an empty
table gives no rows. Averages depend on how the rows are partitioned, so scores agree only roughly between layouts.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass
from math import isqrt
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenuis.llm.common import share
from tenuis.session import cut_lineage

#: Least number of frequent words.
FREQUENT = 448
SUFFIX_CLASSES = 64
WIDTH = 24
OFFSETS = (-2, -1, 1, 2)
ROUNDS = 3
MASK_EVERY = 16
BATCH = 512
RATE = 0.15
#: Words scored at a time.
BLOCK = 16_384
CHUNK = 4096
#: Words and distinct words in a block of documents, which ends with the document that reaches either; what travels by word
#: goes with the distinct words of the blocks, so fewer, larger blocks move less.
BLOCK_WORDS = 1 << 21
BLOCK_DISTINCT = 1 << 18
#: Counts that are packed by block at a time.
PACKED_ROWS = 1 << 20
#: Classes in a group of the two-level softmax.
SLOTS = 32

_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []


def frequent_size(distinct: int) -> int:
    """How many words have a class of their own: the root of the number of distinct words in whole groups, FREQUENT at least."""
    return max(FREQUENT, -(-isqrt(distinct) // SLOTS) * SLOTS)


def suffix_class(word: bytes) -> int:
    return crc32(word[-2:]) % SUFFIX_CLASSES


def class_type(classes: int) -> type:
    return np.uint16 if classes < 1 << 16 else np.uint32


@dataclass(frozen=True)
class Classes:
    """The frequent words, and how many tokens each shared class has."""

    frequent: dict[bytes, int]
    tokens: tuple[int, ...] = (0,) * SUFFIX_CLASSES

    @property
    def count(self) -> int:
        return len(self.frequent) + SUFFIX_CLASSES

    def of(self, words: list[bytes]) -> np.ndarray:
        get, base = self.frequent.get, len(self.frequent)
        return np.array([c if (c := get(w)) is not None else base + suffix_class(w) for w in words], dtype=class_type(self.count))

    def inside(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """log P(word | class) of words of these classes that were counted so often; 0 stands for words never counted."""
        base = len(self.frequent)
        totals = np.concatenate([np.zeros(base), self.tokens])[ids]
        return np.where(ids < base, 0.0, np.log(np.maximum(counts, 1)) - np.log(totals + 1.0))


class Network:
    """Weights in one flat float32 vector: embeddings by offset (with a class for the edge), bias, and the softmax in two
    levels, the group of a class and its slot in the group, which takes far fewer exponentials than one over all. In both
    levels the biases are the last row of the weights, as the hidden units end with a 1."""

    def __init__(self, classes: int, flat: np.ndarray | None = None, shares: np.ndarray | None = None):
        self.classes, self.groups = classes, -(-classes // SLOTS)
        shapes = [(len(OFFSETS), classes + 1, WIDTH), (WIDTH,), (WIDTH + 1, self.groups), (self.groups, WIDTH + 1, SLOTS)]
        sizes = [int(np.prod(s)) for s in shapes]
        start = flat is None
        if start:
            flat = (np.random.default_rng(17).standard_normal(sum(sizes)) * 0.1).astype(np.float32)
        self.flat = flat
        cuts = np.cumsum([0, *sizes])
        self.embed, self.bias, self.group_all, self.out_all = (flat[a:b].reshape(s) for a, b, s in zip(cuts, cuts[1:], shapes, strict=False))
        self.cells, self.middle = self.embed.reshape(-1, WIDTH), flat[cuts[1] : cuts[3]]
        self.group_out, self.group_bias = self.group_all[:-1], self.group_all[-1]
        self.out, self.out_bias = self.out_all[:, :-1], self.out_all[:, -1]
        if start:
            # The first network knows how frequent classes are; slots without a class are as good as impossible.
            full = np.full(self.groups * SLOTS, 1e-9)
            full[:classes] = 1.0 / classes if shares is None else shares
            full = full.reshape(self.groups, SLOTS)
            self.group_bias[:] = np.log(full.sum(axis=1))
            self.out_bias[:] = np.log(full / full.sum(axis=1, keepdims=True))

    def edged(self, documents: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The documents one after another with the edge class around each, and the places of their words in that."""
        sizes = [len(ids) for ids in documents]
        at = np.arange(sum(sizes)) + np.repeat(np.arange(2, 2 * len(sizes) + 2, 2), sizes)
        around = np.full(len(at) + 2 * len(sizes) + 2, self.classes, dtype=np.int64)
        around[at] = np.concatenate(documents)
        return around, at

    def contexts(self, ids: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Classes around the places, with the edge class beyond the ends."""
        around, at = self.edged([ids])
        return _contexts_at(around, at[places])

    def cells_of(self, context: np.ndarray) -> np.ndarray:
        """The embeddings of the contexts by offset, as rows of `cells`."""
        return context.T + np.arange(len(OFFSETS))[:, None] * (self.classes + 1)

    def hidden(self, cells: np.ndarray) -> np.ndarray:
        """One row by context, which ends with a 1."""
        out = np.ones((cells.shape[1], WIDTH + 1), dtype=np.float32)
        total = self.cells.take(cells[0], axis=0)
        for own in cells[1:]:
            total += self.cells.take(own, axis=0)
        total += self.bias
        np.tanh(total, out=out[:, :WIDTH])
        return out

    def log_probability(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        out = np.empty(len(target), dtype=np.float64)
        for at in range(0, len(target), 8192):
            part = slice(at, at + 8192)
            wanted = target[part]
            group, slot = np.divmod(wanted, SLOTS)
            h = self.hidden(self.cells_of(context[part]))
            picked = _log_softmax_at(self.group_all.T @ h.T, group, 0)
            # Rows in the order of their groups: one product per group, and the softmax over all rows at once.
            order, groups, starts, counts = _by_group(group)
            sorted_h, inner = h.take(order, axis=0), np.empty((len(wanted), SLOTS), dtype=np.float32)
            for own, start, end in zip(groups.tolist(), starts.tolist(), (starts + counts).tolist(), strict=True):
                np.matmul(sorted_h[start:end], self.out_all[own], out=inner[start:end])
            picked[order] += _log_softmax_at(inner, slot[order], 1)
            out[part] = picked
        return out

    def slopes(self, cells: np.ndarray, target: np.ndarray) -> tuple[float, np.ndarray, tuple, tuple]:
        """Mean loss and its gradient: by `middle`, and for `cells` and `out_all` the rows that have one with theirs."""
        # Rows are taken by the size of their group in the batch. Groups of a few rows are filled up with rows of zeros to
        # the next power of two, so that those of a size are one stacked product; larger groups have one each.
        size, group = len(target), target // SLOTS
        order, groups, starts, counts = _by_group(group)
        full = _FILLED[np.minimum(counts, len(_FILLED) - 1)]
        full = np.where(full, full, counts)
        by_size = np.argsort(full, kind="stable")
        groups, counts, full = groups[by_size], counts[by_size], full[by_size]
        within = np.arange(size) - np.repeat(np.cumsum(counts) - counts, counts)
        order, ends = order[np.repeat(starts[by_size], counts) + within], np.cumsum(full)
        taken, tiers, at, first = np.repeat(ends - full, counts) + within, [], 0, 0
        many_of = np.bincount(full)
        for each in np.flatnonzero(many_of).tolist():
            many = int(many_of[each])
            tiers.append((slice(first, first + many), slice(at, at + each * many), (many, each, -1)))
            first, at = first + many, at + each * many
        cells, group, slot = cells[:, order], group[order], target[order] % SLOTS
        h = self.hidden(cells)
        loss, p = _softmax_error(self.group_all.T @ h.T, group, np.arange(size), 0)
        back = p.T @ self.group_out.T
        middle = np.empty_like(self.middle)
        np.matmul(h.T, p.T, out=middle[WIDTH:].reshape(self.group_all.shape))
        filled, weights = np.zeros((at, WIDTH + 1), np.float32), self.out_all.take(groups, axis=0)
        filled[taken] = h
        inner, inner_back, grown = np.empty((at, SLOTS), np.float32), np.empty((at, WIDTH), np.float32), np.empty_like(weights)
        for own, span, shape in tiers:
            np.matmul(filled[span].reshape(shape), weights[own], out=inner[span].reshape(shape))
        more, q = _softmax_error(inner, taken, slot, 1)
        for own, span, shape in tiers:
            errors = q[span].reshape(shape)
            np.matmul(errors, weights[own, :-1].transpose(0, 2, 1), out=inner_back[span].reshape(shape))
            np.matmul(filled[span].reshape(shape).transpose(0, 2, 1), errors, out=grown[own])
        back += inner_back.take(taken, axis=0)
        h = h[:, :WIDTH]
        back *= 1.0 - h * h
        middle[:WIDTH] = back.sum(axis=0)
        return loss + more, middle, _sums_by(cells, back, len(self.cells)), (groups, grown)

    def gradient(self, context: np.ndarray, target: np.ndarray) -> tuple[float, np.ndarray]:
        """Mean loss and its gradient as a flat vector."""
        whole = Network(self.classes, np.zeros_like(self.flat))
        loss, whole.middle[:], (cells, by_cell), (groups, by_group) = self.slopes(self.cells_of(context), target)
        whole.cells[cells], whole.out_all[groups] = by_cell, by_group
        return loss, whole.flat

    def descend(self, squares: Network, cells: np.ndarray, target: np.ndarray) -> float:
        """One step down the gradient, by the squares of all so far, and the mean loss before it. Weights without a gradient stay."""
        loss, middle, by_cell, by_group = self.slopes(cells, target)
        squares.middle[:] += middle * middle
        self.middle[:] -= np.float32(RATE) * (middle / np.sqrt(squares.middle))
        for weights, own, (at, grown) in ((self.cells, squares.cells, by_cell), (self.out_all, squares.out_all, by_group)):
            held = own.take(at, axis=0)
            held += grown * grown
            own[at] = held
            np.divide(grown, np.sqrt(held, out=held), out=held)
            held *= np.float32(RATE)
            weights[at] -= held
        return loss


def _contexts_at(around: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.stack([around[at + o] for o in OFFSETS], axis=1)


#: The next power of two, 2 at least, of the sizes of groups that are filled up.
_FILLED = np.array([max(2, 1 << max(n - 1, 0).bit_length()) for n in range(33)] + [0])


def _sums_by(cells: np.ndarray, rows: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The cells that there are, below `most`, and the sums of their rows; a row belongs to all cells of its column."""
    flat = cells.ravel().astype(class_type(most))
    order = np.argsort(flat, kind="stable")
    flat, order = flat[order], order % len(rows)
    bounds = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1], [True]]))
    starts, counts = bounds[:-1], bounds[1:] - bounds[:-1]
    sums, several = rows.take(order[starts], axis=0), counts > 1
    if several.any():
        # Pairs of floats are added as complex numbers: the sums are the same, and numpy goes through half as many columns.
        shared, sizes = rows.take(order[np.repeat(several, counts)], axis=0), counts[several]
        sums[several] = np.add.reduceat(shared.view(np.complex64), np.cumsum(sizes) - sizes, axis=0).view(np.float32)
    return flat[starts].astype(np.int64), sums


def _by_group(group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The rows in the order of their groups, the groups that there are, and where each starts in that order and its size."""
    counts = np.bincount(group)
    groups = np.flatnonzero(counts)
    counts, order = counts[groups], np.argsort(group.astype(class_type(len(counts))), kind="stable")
    return order, groups, np.cumsum(counts) - counts, counts


def _lowered(logits: np.ndarray, axis: int) -> np.ndarray:
    """Logits whose exponentials can be summed along the axis; those between -60 and 60 stay as they are."""
    if logits.size and (logits.max() > 60 or logits.min() < -60):
        logits -= logits.max(axis=axis, keepdims=True)
    return logits


def _log_softmax_at(logits: np.ndarray, at: np.ndarray, axis: int) -> np.ndarray:
    """One value for each of the softmaxes along the axis: the logarithm at its own place."""
    logits, own = _lowered(logits, axis), np.arange(len(at))
    picked = logits[at, own] if axis == 0 else logits[own, at]
    return (picked - np.log(np.exp(logits, out=logits).sum(axis=axis))).astype(np.float64)


def _softmax_error(logits: np.ndarray, first: np.ndarray, second: np.ndarray, axis: int) -> tuple[float, np.ndarray]:
    """Mean loss at the targets, of softmaxes along the axis, and its gradient by logits."""
    p = np.exp(_lowered(logits, axis), out=logits)
    sums = p.sum(axis=0) if axis == 0 else (p @ np.ones(p.shape[1], np.float32))[:, None]
    total = np.float32(len(first))
    p *= np.float32(1.0) / (sums * total)
    picked = p[first, second]
    p[first, second] = picked - np.float32(1.0) / total
    return float(-np.log(np.maximum(picked * total, 1e-30)).mean()), p


def in_turn(numbers: np.ndarray, turn: int, rounds: int) -> np.ndarray:
    """Which of the numbers a round takes: a hash deals them out over MASK_EVERY parts, and each part belongs to one round."""
    mixed = numbers * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xA0761D6478BD642F)
    mixed >>= np.uint64(60)
    return (np.arange(16) % rounds == turn).take(mixed.astype(np.uint8))


def masked_places(size: int, seed: int, turn: int, rounds: int = MASK_EVERY) -> np.ndarray:
    """The places of a round in a document: its seed and the place are hashed together."""
    return np.flatnonzero(in_turn(np.arange(size, dtype=np.uint64) + np.uint64(seed), turn, rounds))


def listed(documents, words: int):
    """Lists of documents with so many words in all, or a longer one at the end."""
    held, size = [], 0
    for ids in documents:
        held.append(ids)
        size += len(ids)
        if size >= words:
            yield held
            held, size = [], 0
    if held:
        yield held


def packed(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpacked(raw: bytes) -> bytes:
    return pa.decompress(raw[8:], decompressed_size=int.from_bytes(raw[:8], "little"), codec="zstd", asbytes=True)


def blocks(documents: DataFrame, key: str | None, text: str) -> DataFrame:
    """block (in the order of the rows), keys and sizes of its documents, their words as numbers, the distinct words in the
    order of the numbers and how often each occurs. Words have no white space, so they are kept as one text."""
    chosen = documents.select(
        F.col(key).alias("key") if key else F.lit(None).cast("int").alias("key"), F.col(text).cast("string").alias("text"), F.spark_partition_id().alias("part")
    )
    kind = chosen.schema["key"].dataType.simpleString()

    def cut(batches):
        made = 0
        for batch in batches:
            texts, part = batch.column(1), batch.column(2)
            at = 0
            while at < batch.num_rows:
                start, held, numbers = at, 0, []
                seen: defaultdict = defaultdict()
                seen.default_factory = seen.__len__
                while at < batch.num_rows and held < BLOCK_WORDS and len(seen) < BLOCK_DISTINCT:
                    words = words_of(texts[at].as_py())
                    numbers.append(np.fromiter(map(seen.__getitem__, words), np.uint32, len(words)))
                    held += len(words)
                    at += 1
                flat = np.concatenate(numbers)
                own = np.bincount(flat, minlength=len(seen)).astype(np.uint32)
                small = flat.astype(np.uint16) if len(seen) < 1 << 16 else flat
                keys = batch.column(0).slice(start, at - start)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([(part[0].as_py() << 33) + made], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys),
                        pa.array([np.array([len(n) for n in numbers], dtype=np.int64).tobytes()], pa.binary()), pa.array([packed(small.tobytes())], pa.binary()),
                        pa.array([packed(b" ".join(seen))], pa.binary()), pa.array([packed(own.tobytes())], pa.binary()),
                    ],
                    names=["block", "keys", "sizes", "numbers", "words", "own"],
                )
                made += 1

    return chosen.mapInArrow(cut, f"block long, keys array<{kind}>, sizes binary, numbers binary, words binary, own binary")


def word_counts(cut: DataFrame) -> DataFrame:
    """word, n: how often every word occurs in all blocks."""

    def listed(batches):
        for batch in batches:
            for words, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(unpacked(words).split(), pa.binary()), pa.array(np.frombuffer(unpacked(own), np.uint32).astype(np.int64))], names=["word", "n"])

    return cut.select("words", "own").mapInArrow(listed, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _most_frequent(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    return [(bytes(r["word"]), r["n"]) for r in counts.orderBy(F.desc("n"), "word").limit(most).collect()]


def frequent_words(documents: DataFrame, text: str, most: int = FREQUENT) -> tuple[list[tuple[bytes, int]], int]:
    """The most frequent words of all documents with their counts, and the number of all words."""
    counts = cut_lineage(word_counts(blocks(documents, None, text)))
    return _most_frequent(counts, most), counts.agg(F.sum("n")).first()[0] or 0


def folded(counts: DataFrame) -> DataFrame:
    """word, n, class: the words that occur more than once with their counts and the class they would share, and by class,
    without a word, the number of words that occur once."""

    def fold(batches):
        once = np.zeros(SUFFIX_CLASSES, dtype=np.int64)
        for batch in batches:
            n = batch.column(1).to_numpy()
            at = np.array([suffix_class(w) for w in batch.column(0).to_pylist()], dtype=np.int32)
            once += np.bincount(at[n == 1], minlength=SUFFIX_CLASSES)
            kept = pa.array(n > 1)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(kept), batch.column(1).filter(kept), pa.array(at).filter(kept)], names=["word", "n", "class"])
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(SUFFIX_CLASSES, pa.binary()), pa.array(once), pa.array(range(SUFFIX_CLASSES), pa.int32())], names=["word", "n", "class"]
        )

    return counts.mapInArrow(fold, "word binary, n long, class int")


def shared_tokens(counts: DataFrame, frequent: list[tuple[bytes, int]]) -> np.ndarray:
    """The tokens of each shared class: those of all words less those of the frequent words."""
    total = np.zeros(SUFFIX_CLASSES, dtype=np.int64)
    for row in counts.groupBy("class").agg(F.sum("n").alias("n")).collect():
        total[row["class"]] = row["n"]
    for word, n in frequent:
        total[suffix_class(word)] -= n
    return total


def by_block(held: list) -> pa.RecordBatch:
    """block, found: the places and counts in arrays of (block, at, n) packed by block, one row for each."""
    block, at, n = (np.concatenate(c) for c in zip(*held, strict=True))
    order = np.lexsort((at, block))
    block, at, n = block[order], at[order].astype(np.int32), n[order].astype(np.int64)
    starts = np.flatnonzero(np.concatenate([[True], np.diff(block) != 0]))
    spans = zip(starts.tolist(), [*starts[1:].tolist(), len(block)], strict=True)
    found = [packed(np.diff(at[a:b], prepend=np.int32(0)).tobytes() + n[a:b].tobytes()) for a, b in spans]
    return pa.RecordBatch.from_arrays([pa.array(block[starts], pa.int64()), pa.array(found, pa.binary())], names=["block", "found"])


def found_counts(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """at and n from one packed value of `by_block`."""
    raw = unpacked(raw)
    size = len(raw) // 12
    return np.cumsum(np.frombuffer(raw, np.int32, size)), np.frombuffer(raw, np.int64, size, 4 * size)


def sequences(cut: DataFrame, counts: DataFrame, classes: Classes, key: str) -> DataFrame:
    """For every row, in the given order: key, the classes of its words as bytes, and the sum of log P(word | class)."""
    shared = share(cut.sparkSession, classes)
    kind = cut.schema["keys"].dataType.elementType.simpleString()

    def rare(batches):
        known = shared.value.frequent
        for batch in batches:
            for block, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                kept = [(at, w) for at, w in enumerate(unpacked(words).split()) if w not in known]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block] * len(kept), pa.int64()), pa.array([at for at, _ in kept], pa.int32()), pa.array([w for _, w in kept], pa.binary())],
                    names=["block", "at", "word"],
                )

    def pack(batches):
        held, size = [], 0
        for batch in batches:
            held.append([c.to_numpy() for c in batch.columns])
            size += batch.num_rows
            if size >= PACKED_ROWS:
                yield by_block(held)
                held, size = [], 0
        if size:
            yield by_block(held)

    def rows(batches):
        own, pieces = shared.value, []
        for batch in batches:
            for number in range(batch.num_rows):
                # The counts of a block come before the block itself.
                if batch.column(0)[number].is_valid:
                    pieces.append(batch.column(0)[number].as_py())
                    continue
                sizes = np.frombuffer(batch.column(2)[number].as_py(), np.int64)
                words = unpacked(batch.column(4)[number].as_py()).split()
                flat = np.frombuffer(unpacked(batch.column(3)[number].as_py()), np.uint16 if len(words) < 1 << 16 else np.uint32)
                ids, seen = own.of(words), np.ones(len(words), dtype=np.int64)
                for at, n in map(found_counts, pieces):
                    seen[at] = n
                pieces = []
                inside = own.inside(ids.astype(np.int64), seen)
                ends = np.cumsum(sizes)
                parts = [flat[b - n : b] for b, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1)[number].values, pa.array([ids[p].tobytes() for p in parts], pa.binary()), pa.array([float(inside[p].sum()) for p in parts], pa.float64())],
                    names=[key, "ids", "__inside"],
                )

    listed = cut.select("block", "words").mapInArrow(rare, "block long, at int, word binary").join(
        # Each word is there once, so a task's share of the words is hashed rather than both sides sorted.
        counts.where("word IS NOT NULL").select("word", "n").hint("shuffle_hash"), "word"
    )
    found = listed.select("block", "at", "n").mapInArrow(pack, "block long, found binary")
    whole = found.unionByName(cut.select("block", "keys", "sizes", "numbers", "words"), allowMissingColumns=True)
    # By the block alone, so that all rows of a block meet; in the order of the blocks, which is that of the documents.
    ordered = whole.repartitionByRange("block").sortWithinPartitions("block", F.col("found").isNull())
    return ordered.select("found", "keys", "sizes", "numbers", "words").mapInArrow(rows, f"`{key}` {kind}, ids binary, __inside double")


def descended(network: Network, documents, turn: int, rounds: int) -> tuple[Network, int, float]:
    """Weights after one pass over the round's places in the class sequences, the number of places and the loss sum."""
    network = Network(network.classes, network.flat.copy())
    squares = Network(network.classes, np.full_like(network.flat, 1e-6))
    places, losses = 0, 0.0
    cells, target = np.empty((len(OFFSETS), 0), dtype=np.int64), np.empty(0, dtype=np.int64)

    def step(least):
        nonlocal cells, target, places, losses
        while len(target) >= least:
            own = target[:BATCH]
            losses += network.descend(squares, cells[:, :BATCH], own) * len(own)
            places += len(own)
            cells, target = cells[:, BATCH:], target[BATCH:]

    for some in listed(documents, BLOCK):
        sizes, flat = np.array([len(ids) for ids in some]), np.concatenate(some)
        seeds = np.array([crc32(ids.tobytes()) for ids in some]) - (np.cumsum(sizes) - sizes)
        chosen = np.flatnonzero(in_turn((np.arange(len(flat)) + np.repeat(seeds, sizes)).astype(np.uint64), turn, rounds))
        around, at = network.edged(some)
        cells = np.concatenate([cells, network.cells_of(_contexts_at(around, at[chosen]))], axis=1)
        target = np.concatenate([target, flat[chosen].astype(np.int64)])
        step(BATCH)
    step(1)
    return network, places, losses


def trained(rows: DataFrame, network: Network, rounds: int = ROUNDS) -> tuple[Network, list[float]]:
    """The network after averaging rounds, which together take every place of all rows once, and the mean loss seen in each round."""
    history: list[float] = []
    for turn in range(rounds):
        shared = share(rows.sparkSession, (network.classes, network.flat))

        def descend(batches, turn=turn, shared=shared):
            start = Network(*shared.value)
            ids = (np.frombuffer(raw, dtype=class_type(start.classes)) for batch in batches for raw in batch.column(0).to_pylist())
            own, places, losses = descended(start, ids, turn, rounds)
            if not places:
                return
            parts = [own.flat[at : at + CHUNK] for at in range(0, len(own.flat), CHUNK)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(range(len(parts)), pa.int32()), pa.array([places] * len(parts), pa.int64()), pa.array([losses] * len(parts), pa.float64()),
                    pa.array([p.tobytes() for p in parts], pa.binary()),
                ],
                names=["chunk", "n", "loss", "weights"],
            )

        def add(batches):
            sums: dict[int, list] = {}
            for batch in batches:
                for chunk, n, loss, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    mine = sums.setdefault(chunk, [0, 0.0, 0.0])
                    mine[0] += n
                    mine[1] += loss
                    mine[2] = mine[2] + n * np.frombuffer(raw, dtype=np.float32).astype(np.float64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(list(sums), pa.int32()), pa.array([s[0] for s in sums.values()], pa.int64()), pa.array([s[1] for s in sums.values()], pa.float64()),
                    pa.array([(s[2] / s[0]).astype(np.float32).tobytes() for s in sums.values()], pa.binary()),
                ],
                names=["chunk", "n", "loss", "weights"],
            )

        schema = "chunk int, n long, loss double, weights binary"
        # One row for each chunk of the network, whose size goes with the number of classes.
        parts = rows.select("ids").mapInArrow(descend, schema).repartition("chunk").mapInArrow(add, schema).orderBy("chunk").collect()
        if not parts:
            break
        network = Network(network.classes, np.concatenate([np.frombuffer(p["weights"], dtype=np.float32) for p in parts]).copy())
        history.append(parts[0]["loss"] / parts[0]["n"])
    return network, history


def scored(rows: DataFrame, network: Network, key: str) -> DataFrame:
    """key, n_words, score (sum of log-probabilities), mean_score."""
    shared = share(rows.sparkSession, (network.classes, network.flat))
    key_type = rows.schema[key].dataType.simpleString()

    def score(batches):
        own = Network(*shared.value)
        for batch in batches:
            documents = [np.frombuffer(raw, dtype=class_type(own.classes)) for raw in batch.column(1).to_pylist()]
            sizes = np.array([len(d) for d in documents], dtype=np.int64)
            sums, at = np.zeros(len(documents)), 0
            # Words are scored in blocks, which hold several documents or a part of a long one.
            for some in listed(documents, BLOCK):
                (around, words), owners = own.edged(some), np.repeat(np.arange(len(some)), [len(d) for d in some])
                for first in range(0, len(words), BLOCK):
                    places = words[first : first + BLOCK]
                    found = own.log_probability(_contexts_at(around, places), around[places])
                    sums[at : at + len(some)] += np.bincount(owners[first : first + BLOCK], found, len(some))
                at += len(some)
            sums += batch.column(2).to_numpy()
            means = [s / n if n else None for s, n in zip(sums.tolist(), sizes.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes), pa.array(sums), pa.array(means, pa.float64())], names=[key, "n_words", "score", "mean_score"]
            )

    return rows.select(key, "ids", "__inside").mapInArrow(score, f"`{key}` {key_type}, n_words long, score double, mean_score double")


def pseudo_likelihood(documents: DataFrame, key: str = "doc_id", text: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """Train on all documents and score all of them."""
    cut = cut_lineage(blocks(documents, key, text))
    counts = cut_lineage(folded(word_counts(cut)))
    distinct = counts.agg(F.sum(F.when(F.col("word").isNull(), F.col("n")).otherwise(1))).first()[0] or 0
    frequent = _most_frequent(counts.where("word IS NOT NULL"), frequent_size(distinct))
    tokens = shared_tokens(counts, frequent)
    classes = Classes({word: number for number, (word, _) in enumerate(frequent)}, tuple(tokens.tolist()))
    shares = np.concatenate([[n for _, n in frequent], tokens]) + 1.0
    rows = cut_lineage(sequences(cut, counts, classes, key))
    network, _ = trained(rows, Network(classes.count, shares=shares / shares.sum()), rounds)
    return scored(rows, network, key)


def report(documents: DataFrame) -> DataFrame:
    return pseudo_likelihood(documents)
