"""Alignment of two tokenizers by an inverted index of token pairs.

Both tokenizers cut the bytes of the same text, space + document. Where a token of A and a token of B end at the same
byte the two are linked; the places where both end cut the text into groups. Three steps on Spark:

`index` encodes every document once. A run of documents of a partition is a container; for each pair of ids linked in
it, the container has a compressed bitmap of its documents, kept as bit planes: plane k holds the documents whose number
of links of this pair has bit k set. A plane is a sorted list of 16-bit places, or a bitset where that is smaller.

`pair_scores` gives for each pair how many documents hold it (the planes OR-merged and popcounted) and how many links
(plane k popcounted, times 2 to the k), summed over all containers, and whether it is the most frequent one of its B id.

`document_sums` sends the scores back along the postings: index rows meet the score of their pair, then come together by
container, where they are added to one array for each sum. No row is made for a (pair, document) posting.

A space between two characters that aren't white space is a cut of both tokenizers: A's words start with such a space,
and no piece of B has a space behind another character. The texts are therefore taken apart at these spaces, and a part
met before is not encoded again. The memory of parts is bounded in bytes and is only a matter of speed; the result is
that of encoding the whole text. `Coders.read` checks what the cut relies on.

Defined results: a text that is null, empty, or whose bytes a tokenizer doesn't give back (a literal U+2581 becomes a
space in B) has no tokens: all counts are 0, the digest is ''. Strings of special tokens are plain text. Texts are
encoded whole. A document's rows are kept apart even if its id repeats or is null. Ties for the most frequent pair of a B
id all count as best. An empty table gives no rows. Other columns are never read.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenuis.session import stored

BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.json"
PIECE_BPE = "/opt/tokenizers/piece_bpe_32k.model"
#: Bytes of parts that a worker remembers.
MEMORY_BYTES = 96 << 20
#: Bytes of text in a slice, and characters of new parts encoded as one text.
SLICE_BYTES = 2 << 20
RUN_CHARACTERS = 32_768
#: Postings in a container, which ends with the slice that reaches them, and its most documents.
CONTAINER_POSTINGS = 1_500_000
CONTAINER_DOCUMENTS = 1 << 16
#: Bytes of a bitset over the documents of a container; shorter planes are lists of places.
BITSET = CONTAINER_DOCUMENTS // 8

_INDEX = (
    "container long, place int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
    "a int, b int, planes array<binary>"
)

#: Fixed value: how the byte-level vocabulary cuts a text into words.
WORDS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_between = re.compile(r"(?<=\S) (?=\S)")


def _byte_alphabet() -> dict[str, int]:
    """Character -> byte of byte-level vocabularies: printable bytes stand for themselves, the others follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}


@dataclass
class Coders:
    """Both tokenizers with the bytes of each id.

    A's merges are its vocabulary in the order of the ids, which `read` checks; the coder of such ranks is faster than one
    that reads the file's merge list, and a test compares them."""

    a: object
    b: object
    a_bytes: list[bytes]
    b_bytes: list[bytes]

    def __post_init__(self):
        self.a_length = np.array(list(map(len, self.a_bytes)), np.int64)
        self.b_length = np.array(list(map(len, self.b_bytes)), np.int64)
        # A group is written as A's ids, '|', B's ids, ';': each id with what follows it.
        self.written = [f"{n}{after}" for count, mark in ((len(self.a_bytes), "|"), (len(self.b_bytes), ";")) for after in (",", mark) for n in range(count)]
        self.written_length = np.array(list(map(len, self.written)), np.int64)

    @staticmethod
    def read(a_path: str = BYTE_BPE, b_path: str = PIECE_BPE) -> Coders:
        import tiktoken
        from sentencepiece import SentencePieceProcessor

        with open(a_path, encoding="utf-8") as file:
            stored_form = json.load(file)
        alphabet = _byte_alphabet()
        special = {token["content"] for token in stored_form["added_tokens"] if token["special"]}
        vocabulary = stored_form["model"]["vocab"]
        a_bytes = [b""] * len(vocabulary)
        for token, number in vocabulary.items():
            a_bytes[number] = token.encode() if token in special else bytes(alphabet[c] for c in token)
        ranks = {a_bytes[number]: number for token, number in vocabulary.items() if token not in special}
        merges = [m.split(" ") if isinstance(m, str) else m for m in stored_form["model"]["merges"]]
        if [vocabulary[x + y] for x, y in merges] != list(range(256, 256 + len(merges))):
            raise ValueError("the ids of A are not in the order of its merges")
        b = SentencePieceProcessor(model_file=b_path)
        b_bytes = []
        for number in range(b.get_piece_size()):
            piece = b.id_to_piece(number)
            b_bytes.append(bytes([int(piece[3:-1], 16)]) if b.is_byte(number) else piece.replace("▁", " ").encode())
            if not (b.is_control(number) or b.is_unknown(number) or b.is_byte(number)) and re.search(r"[^▁]▁", piece):
                raise ValueError(f"piece {number} has a space behind another character")
        if not all(a_bytes) or not all(b_bytes):
            raise ValueError("a token without bytes")
        return Coders(tiktoken.Encoding("a", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={}), b, a_bytes, b_bytes)

    def encode(self, text: str) -> tuple[list[int], list[int]] | None:
        """Ids of A and B of a text that starts with a space; None if a tokenizer doesn't give its bytes back."""
        raw = text.encode("utf-8", "surrogatepass")
        ours, theirs = self.a.encode_ordinary(text), self.b.encode(text[1:])
        same = b"".join(map(self.a_bytes.__getitem__, ours)) == raw and b"".join(map(self.b_bytes.__getitem__, theirs)) == raw
        return (ours, theirs) if same else None


def parts_of(text: str) -> list[str]:
    """The parts of space + text; each starts with a space."""
    return [" " + part for part in _between.split(text)]


class Parts:
    """Encoded parts by number. Forgets all of them at once when they take more than `most` bytes."""

    def __init__(self, coders: Coders, most: int = MEMORY_BYTES):
        self.coders, self.most = coders, most
        self._clear()

    def _clear(self) -> None:
        self.number: dict[str, int] = {}
        self.groups: list[str] = []  # of each part, each group followed by ;
        empty = np.zeros(0, np.int64)
        self.n_a, self.n_b, self.n_groups, self.pairs = empty, empty, empty, empty
        self.bad = np.zeros(0, bool)
        self.held = 0

    def learn(self, texts: list[list[str]]) -> None:
        if self.held > self.most:
            self._clear()
        known = self.number
        new = list(dict.fromkeys([p for parts in texts for p in parts if p not in known]))
        good, a_ids, b_ids, bad = [], [], [], []
        for run in self._runs(new):
            found = self.coders.encode("".join(run))
            if found is None and len(run) > 1:
                single = [(part, self.coders.encode(part)) for part in run]
            else:
                single = [(None, found)]
            for part, ids in single:
                members = run if part is None else [part]
                if ids is None:
                    bad += members
                else:
                    good += members
                    a_ids += ids[0]
                    b_ids += ids[1]
        self._add(good, np.array(a_ids, np.int64), np.array(b_ids, np.int64))
        for part in bad:
            known[part] = len(self.groups)
            self.groups.append("")
        none = np.zeros(len(bad), np.int64)
        self.n_a, self.n_b, self.n_groups = (np.concatenate([x, none]) for x in (self.n_a, self.n_b, self.n_groups))
        self.bad = np.concatenate([self.bad, np.ones(len(bad), bool)])
        self.held += sum(300 + 2 * len(p) for p in bad)

    @staticmethod
    def _runs(parts: list[str]) -> Iterator[list[str]]:
        """Parts that may be encoded as one text: between two of them is a cut of both tokenizers."""
        run, size = [], 0
        for part in parts:
            if part[1:2].isspace() or part[-1].isspace():
                yield [part]
                continue
            run.append(part)
            size += len(part)
            if size > RUN_CHARACTERS:
                yield run
                run, size = [], 0
        if run:
            yield run

    def _add(self, parts: list[str], a_ids: np.ndarray, b_ids: np.ndarray) -> None:
        """Groups and links of parts from the ids of their texts, one behind the other."""
        if not parts:
            return
        coders = self.coders
        a_end, b_end = np.cumsum(coders.a_length[a_ids]), np.cumsum(coders.b_length[b_ids])
        part_end = np.cumsum([len(p.encode("utf-8", "surrogatepass")) for p in parts])
        at = np.searchsorted(b_end, a_end)
        a_cut = b_end[np.minimum(at, len(b_end) - 1)] == a_end
        b_cut = np.zeros(len(b_ids), bool)
        b_cut[at[a_cut]] = True
        a_group, b_group = np.cumsum(a_cut) - a_cut, np.cumsum(b_cut) - b_cut
        item = np.concatenate([a_ids + a_cut * len(coders.a_bytes), 2 * len(coders.a_bytes) + b_ids + b_cut * len(coders.b_bytes)])
        order = np.argsort(np.concatenate([2 * a_group, 2 * b_group + 1]), kind="stable")
        item = item[order]
        text = "".join(map(coders.written.__getitem__, item.tolist()))
        ends_group = np.concatenate([np.zeros(len(a_ids), bool), b_cut])[order]
        group_end = np.cumsum(coders.written_length[item])[ends_group]
        groups = np.searchsorted(a_end[a_cut], part_end, "right")
        stop = group_end[groups - 1].tolist()
        first = len(self.groups)
        self.groups += [text[x:y] for x, y in zip([0, *stop], stop, strict=False)]
        self.number.update(zip(parts, range(first, first + len(parts)), strict=True))

        def more(have: np.ndarray, ends: np.ndarray) -> np.ndarray:
            return np.concatenate([have, np.diff(ends, prepend=0)])

        self.n_a, self.n_b = more(self.n_a, np.searchsorted(a_end, part_end, "right")), more(self.n_b, np.searchsorted(b_end, part_end, "right"))
        self.n_groups = more(self.n_groups, groups)
        self.bad = np.concatenate([self.bad, np.zeros(len(parts), bool)])
        self.pairs = np.concatenate([self.pairs, a_ids[a_cut] << 32 | b_ids[at[a_cut]]])
        self.held += 300 * len(parts) + 2 * int(part_end[-1]) + len(text) + 8 * len(group_end)


class _Container:
    """Postings of a run of documents."""

    def __init__(self):
        self.documents = self.postings = 0
        self.rows: list[tuple] = []
        self.found: list[tuple[np.ndarray, ...]] = []

    def full(self) -> bool:
        return self.postings >= CONTAINER_POSTINGS or self.documents >= CONTAINER_DOCUMENTS

    def add(self, parts: Parts, ids: list, texts: list[str | None]) -> None:
        """Documents of a slice, at most as many as there is room for."""
        cut = [parts_of(t) if t else [] for t in texts]
        parts.learn(cut)
        sizes = np.array(list(map(len, cut)), np.int64)
        numbers = [list(map(parts.number.__getitem__, words)) for words in cut]
        at = np.fromiter((n for row in numbers for n in row), np.int64, int(sizes.sum()))
        ends = np.cumsum(sizes)

        def by_document(values: np.ndarray) -> np.ndarray:
            total = np.concatenate([[0], np.cumsum(values[at])])
            return total[ends] - total[ends - sizes]

        whole = (sizes > 0) & (by_document(parts.bad) == 0)
        counts = [np.where(whole, by_document(v), 0).tolist() for v in (parts.n_a, parts.n_b, parts.n_groups)]
        text_of = parts.groups.__getitem__
        digests = [hashlib.sha256("".join(map(text_of, row))[:-1].encode()).hexdigest() if good else "" for row, good in zip(numbers, whole.tolist(), strict=True)]
        self.rows += zip(ids, *counts, digests, strict=True)
        place = np.repeat(np.arange(len(ids)), sizes)
        keep = whole[place]
        place, at = place[keep], at[keep]
        if len(at):
            key, times = np.unique(place * len(parts.groups) + at, return_counts=True)
            place, at = np.divmod(key, len(parts.groups))
            size = parts.n_groups[at]
            begin = np.concatenate([[0], np.cumsum(parts.n_groups)])[at]
            offset = np.repeat(begin - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
            pair, place, times = _summed(parts.pairs[offset], np.repeat(place, size), np.repeat(times, size))
            self.found.append((pair, (place + self.documents).astype(np.int32), times.astype(np.int32)))
            self.postings += len(pair)
        self.documents += len(ids)

    def batches(self, container: int) -> Iterator[pa.RecordBatch]:
        count = len(self.rows)
        if count:
            doc, n_a, n_b, n_groups, digest = zip(*self.rows, strict=True)
            yield _batch(
                [container] * count, list(range(count)), doc, n_a, n_b, n_groups, n_groups, digest, pa.nulls(count, pa.int32()),
                pa.nulls(count, pa.int32()), pa.nulls(count, pa.list_(pa.binary())),
            )
        if not self.found:
            return
        pair, place, times = _summed(*(np.concatenate(c) for c in zip(*self.found, strict=True)))
        pairs, planes = bit_planes(pair, place, times)
        step = 100_000
        for start in range(0, len(pairs), step):
            some = pairs[start : start + step]
            none = pa.nulls(len(some), pa.int64())
            yield _batch(
                np.full(len(some), container), pa.nulls(len(some), pa.int32()), none, none, none, none, none, pa.nulls(len(some), pa.string()),
                (some >> 32).astype(np.int32), (some & 0xFFFFFFFF).astype(np.int32), planes.slice(start, step),
            )


def _batch(*columns) -> pa.RecordBatch:
    long, text = pa.int64(), pa.string()
    kinds = [long, pa.int32(), long, long, long, long, long, text, pa.int32(), pa.int32(), pa.list_(pa.binary())]
    names = [field.split()[0] for field in _INDEX.split(", ")]
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names=names)


def _summed(pair: np.ndarray, place: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One posting for each (pair, place), by pair and place."""
    if not len(pair):
        return pair, place, times
    order = np.lexsort((place, pair))
    pair, place, times = pair[order], place[order], times[order]
    first = np.flatnonzero(np.concatenate([[True], (pair[1:] != pair[:-1]) | (place[1:] != place[:-1])]))
    return pair[first], place[first], np.add.reduceat(times, first)


def bit_planes(pair: np.ndarray, place: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, pa.ListArray]:
    """The pairs and the bit planes of each, from postings ordered by pair and place."""
    first = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
    row = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(pair))))
    depth = np.frexp(np.maximum.reduceat(times, first).astype(np.float64))[1]  # bits of the largest number
    begin = np.concatenate([[0], np.cumsum(depth)])
    cells, places = [], []
    for bit in range(int(depth.max())):
        has = (times >> bit) & 1 == 1
        cells.append(begin[row[has]] + bit)
        places.append(place[has])
    cell, place = np.concatenate(cells), np.concatenate(places)
    order = np.argsort(cell, kind="stable")
    cell, place = cell[order], place[order].astype("<u2")
    count = np.bincount(cell, minlength=begin[-1])
    dense = 2 * count >= BITSET
    offsets = np.concatenate([[0], np.cumsum(np.where(dense, BITSET, 2 * count))])
    data = np.zeros(offsets[-1] // 2, "<u2")
    start = np.concatenate([[0], np.cumsum(count)])
    sparse = ~dense[cell]
    data[offsets[cell[sparse]] // 2 + np.arange(len(cell))[sparse] - start[cell[sparse]]] = place[sparse]
    for one in np.flatnonzero(dense):
        bits = np.zeros(CONTAINER_DOCUMENTS, np.uint8)
        bits[place[start[one] : start[one + 1]]] = 1
        data[offsets[one] // 2 : offsets[one + 1] // 2] = np.packbits(bits, bitorder="little").view("<u2")
    values = pa.Array.from_buffers(pa.binary(), int(begin[-1]), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])
    return pair[first], pa.ListArray.from_arrays(pa.array(begin, pa.int32()), values)


def places_of(planes: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, bit) of every set bit of the planes."""
    sizes = planes.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    cells = planes.flatten()
    row = np.repeat(np.arange(len(planes)), sizes)
    bit = np.arange(len(cells)) - np.repeat(np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
    offsets = np.frombuffer(cells.buffers()[1], np.int32)[cells.offset : cells.offset + len(cells) + 1].astype(np.int64)
    data = np.frombuffer(cells.buffers()[2], "<u2", count=offsets[-1] // 2) if len(cells) and offsets[-1] else np.zeros(0, "<u2")
    length = np.diff(offsets) // 2
    dense = length == BITSET // 2
    cell = np.repeat(np.arange(len(cells)), length)
    keep = ~dense[cell]
    cell, place = cell[keep], data[offsets[0] // 2 :][keep].astype(np.int64)
    for one in np.flatnonzero(dense):
        bits = np.unpackbits(data[offsets[one] // 2 : offsets[one + 1] // 2].view(np.uint8), bitorder="little")
        found = np.flatnonzero(bits)
        cell, place = np.append(cell, np.full(len(found), one)), np.append(place, found)
    return row[cell], place, bit[cell]


def index(docs: DataFrame, key: str = "doc_id", text: str = "text", a_path: str = BYTE_BPE, b_path: str = PIECE_BPE) -> DataFrame:
    """One row for each document (place in its container, counts, digest) and one for each pair in a container (planes).

    Stored once in the shared folder: both kinds come from the same run of a task, so their places agree."""

    def run(batches):
        parts = Parts(Coders.read(a_path, b_path))
        base, made, current = TaskContext.get().partitionId() << 32, 0, _Container()
        for batch in batches:
            start, ids, texts = 0, batch.column(0).to_pylist(), batch.column(1)
            while start < batch.num_rows:
                stop, size = start, 0
                room = CONTAINER_DOCUMENTS - current.documents
                while stop < batch.num_rows and stop - start < room and (stop == start or size < SLICE_BYTES):
                    size += len(texts[stop].as_buffer()) if texts[stop].is_valid else 0
                    stop += 1
                current.add(parts, ids[start:stop], texts.slice(start, stop - start).to_pylist())
                start = stop
                if current.full():
                    yield from current.batches(base + made)
                    made, current = made + 1, _Container()
        yield from current.batches(base + made)

    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return stored(source.mapInArrow(run, _INDEX), "alignment")


def pair_scores(rows: DataFrame) -> DataFrame:
    """a, b, docs, links, best: in how many documents and links each pair is, and whether it is its B id's most frequent."""

    def count(batches):
        for batch in batches:
            planes = batch.column(2)
            row, place, bit = places_of(planes)
            links = np.zeros(len(planes), np.int64)
            np.add.at(links, row, np.int64(1) << bit)
            merged = np.unique(row * CONTAINER_DOCUMENTS + place)  # the planes of a pair as one bitmap
            docs = np.bincount(merged // CONTAINER_DOCUMENTS, minlength=len(planes))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(docs, pa.int64()), pa.array(links)], names=["a", "b", "docs", "links"])

    postings = rows.where(F.col("place").isNull()).select("a", "b", "planes")
    totals = postings.mapInArrow(count, "a int, b int, docs long, links long").groupBy("a", "b").agg(F.sum("docs").alias("docs"), F.sum("links").alias("links"))
    totals = stored(totals, "pairs")
    most = totals.groupBy("b").agg(F.max("links").alias("most"))
    return totals.join(most, "b").select("a", "b", "docs", "links", (F.col("links") == F.col("most")).alias("best"))


def document_sums(rows: DataFrame, scores: DataFrame) -> DataFrame:
    """container, place, n_best, count_sum of the documents with links."""

    def add(batches):
        container, best, total = None, None, None
        for batch in batches:
            owner = batch.column(0).to_numpy()
            planes = batch.column(3)
            cuts = [0, *(np.flatnonzero(np.diff(owner)) + 1).tolist(), len(owner)] if len(owner) else [0]
            for start, stop in zip(cuts, cuts[1:], strict=False):
                if owner[start] != container:
                    if container is not None:
                        yield _sums(container, best, total)
                    container, best, total = owner[start], np.zeros(CONTAINER_DOCUMENTS, np.int64), np.zeros(CONTAINER_DOCUMENTS, np.int64)
                row, place, bit = places_of(planes.slice(start, stop - start))
                times = np.int64(1) << bit
                np.add.at(total, place, times * batch.column(1).slice(start, stop - start).to_numpy()[row])
                np.add.at(best, place, times * batch.column(2).slice(start, stop - start).to_numpy(zero_copy_only=False)[row])
        if container is not None:
            yield _sums(container, best, total)

    postings = rows.where(F.col("place").isNull()).select("container", "a", "b", "planes")
    met = postings.join(scores.select("a", "b", "links", "best"), ["a", "b"]).select("container", "links", "best", "planes")
    return met.repartition("container").sortWithinPartitions("container").mapInArrow(add, "container long, place int, n_best long, count_sum long")


def _sums(container: int, best: np.ndarray, total: np.ndarray) -> pa.RecordBatch:
    place = np.flatnonzero(total)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(place), container)), pa.array(place, pa.int32()), pa.array(best[place]), pa.array(total[place])],
        names=["container", "place", "n_best", "count_sum"],
    )


def report(docs: DataFrame, **options) -> DataFrame:
    """Counts, digest of the groups and sums over the links of every document."""
    rows = index(docs, **options)
    sums = document_sums(rows, stored(pair_scores(rows), "scores"))
    zero = F.lit(0).cast("long")
    return rows.where(F.col("place").isNotNull()).join(sums, ["container", "place"], "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"),
        F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256",
    )
