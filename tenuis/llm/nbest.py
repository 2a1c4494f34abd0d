"""SentencePiece encoding and decoding with N-best segmentation.

For a chunk of text, a forward Viterbi pass gives the best score of every prefix. Those scores are exact estimates of
what is left for a search from the end to the start, so the A-star search over the lattice pops complete
segmentations in falling order of score.

The best N segmentations of a whole text follow from its chunks: the score is a sum over chunks, and the best N
need no chunk but the N - 1 whose second segmentation costs least. Only these are searched; all others keep their
best one. The result stores the best ids once and each further segmentation as its changed pieces.

Defined results: a null text gives null ids; an empty text is one chunk with the leading space and decodes to itself;
equal scores are ordered by the earlier changed chunk, then by the search; rows are independent of each other.
"""

from __future__ import annotations

import heapq
import itertools
from collections import defaultdict
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tenuis.llm.common import lists, share, with_text_columns
from tenuis.llm.pieces import VOCABULARY, Steps, Vocabulary, chunks, covered, matcher

BEST = 4
#: Bytes of each of the two generations of chunks that a worker remembers (chunks in use move to the younger one), and of
#: the searched chunks. Chunks over LONGEST characters are not remembered.
CACHE_BYTES = 72 << 20
SEARCHED_BYTES = 24 << 20
#: The same behind other stages, which leave less of the executor's memory to the workers.
SHARED_CACHE_BYTES = 16 << 20
SHARED_SEARCHED_BYTES = 6 << 20
LONGEST = 64
#: Chunks whose best segmentations are found side by side; fewer than LEAST are taken one at a time.
TOGETHER = 2048
LEAST = 64
#: Bytes of texts that are segmented at a time; a longer text is alone. Behind other stages lists are short and chunks are
#: taken one at a time, without the table of 16 MB.
AT_ONCE = 1 << 20
SHARED_AT_ONCE = 1 << 16
_LOW = float("-inf")


class Segmenter:
    def __init__(self, vocabulary: Vocabulary, best: int = BEST, memory: tuple[int, int] | None = None):
        self.vocabulary, self.best, self.together = vocabulary, best, memory is None
        self.cache_bytes, self.searched_bytes = memory or (CACHE_BYTES, SEARCHED_BYTES)
        self.pieces_in, self.covered = matcher(vocabulary).iter, covered(vocabulary)
        self.cache: dict[str, tuple[tuple[int, ...], float, float]] = {}
        self.older: dict[str, tuple[tuple[int, ...], float, float]] = {}
        self.searched: dict[str, list[tuple[float, tuple[int, ...]]]] = {}
        self.held = self.searched_held = 0

    @cached_property
    def steps(self) -> Steps:
        return Steps.of(self.vocabulary)

    def viterbi(self, chunk: str) -> tuple[tuple[int, ...], float, float]:
        """Ids and score of the best segmentation, and what the second one loses against it."""
        if self.covered.issuperset(chunk):
            return self._viterbi_covered(chunk)
        get, unknown, size = self.vocabulary.known.get, self.vocabulary.unknown, len(chunk)
        first, second = [_LOW] * (size + 1), [_LOW] * (size + 1)
        back: list = [None] * (size + 1)
        first[0] = 0.0
        for start in range(size):
            one, two, single = first[start], second[start], False
            for end in range(start + 1, size + 1):
                hit = get(chunk[start:end])
                if hit is None:
                    break
                number, score = hit
                if number < 0:
                    continue
                if end == start + 1:
                    single = True
                value, other = one + score, two + score
                if value > first[end]:
                    other = max(other, first[end])
                    first[end], back[end] = value, (start, number)
                elif value > other:
                    other = value
                if other > second[end]:
                    second[end] = other
            if not single:
                end = start + 1
                value, other = one + unknown, two + unknown
                if value > first[end]:
                    other = max(other, first[end])
                    first[end], back[end] = value, (start, -1)
                elif value > other:
                    other = value
                if other > second[end]:
                    second[end] = other
        ids, end = [], size
        while end:
            start, number = back[end]
            ids.append(number) if number >= 0 else ids.extend(reversed(self.vocabulary.bytes_of(chunk[start])))
            end = start
        return tuple(reversed(ids)), first[size], first[size] - second[size]

    def _viterbi_covered(self, chunk: str) -> tuple[tuple[int, ...], float, float]:
        """The same for a chunk without unknown characters: its pieces come from the automaton."""
        size = len(chunk)
        first, second = [_LOW] * (size + 1), [_LOW] * (size + 1)
        first[0] = 0.0
        back = [(0, 0)] * (size + 1)
        for end, (number, length, score) in self.pieces_in(chunk):
            end += 1
            start = end - length
            value, other = first[start] + score, second[start] + score
            if value > first[end]:
                if first[end] > other:
                    other = first[end]
                first[end], back[end] = value, (start, number)
            elif value > other:
                other = value
            if other > second[end]:
                second[end] = other
        ids, end = [], size
        while end:
            end, number = back[end]
            ids.append(number)
        ids.reverse()
        return tuple(ids), first[size], first[size] - second[size]

    def viterbi_of(self, found: list[str]) -> list[tuple[tuple[int, ...], float, float]]:
        """The same for each of many chunks. Those of up to LONGEST letters of the table are taken side by side."""
        if len(found) < LEAST or not self.together:
            return list(map(self.viterbi, found))
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        letters = self.steps.letter.take(np.frombuffer("".join(found).encode("utf-32-le", "surrogatepass"), np.uint32))
        starts = np.cumsum(sizes) - sizes
        fit = (sizes <= LONGEST) & (np.minimum.reduceat(letters, starts) > 0)
        out: list = [None] * len(found)
        for at in np.flatnonzero(~fit).tolist():
            out[at] = self.viterbi(found[at])
        # Chunks of like lengths share a batch.
        fitting = np.flatnonzero(fit)
        fitting = fitting[np.argsort(sizes[fitting], kind="stable")]
        for first in range(0, len(fitting), TOGETHER):
            own = fitting[first : first + TOGETHER]
            for at, hit in zip(own.tolist(), self._viterbi_together(letters, starts[own], sizes[own]), strict=True):
                out[at] = hit
        return out

    def _viterbi_together(self, letters: np.ndarray, starts: np.ndarray, sizes: np.ndarray):
        """The same for chunks given by their letters, one a column, with the same sums in the same order."""
        steps, width, many = self.steps, int(sizes.max()), len(sizes)
        column = np.arange(many)
        place = np.arange(width)[:, None]
        rows = np.where(place < sizes, letters.take(np.minimum(starts + place, len(letters) - 1)), 0)
        # nodes[n - 1][start] is the node of the n letters from a start.
        nodes, table, letter_count = [], steps.table.ravel(), steps.table.shape[1]
        node = np.full(rows.shape, steps.root, dtype=np.int32)
        for length in range(1, min(width, steps.longest) + 1):
            node = node[: width - length + 1]
            node = table.take(np.where(node < len(steps.table), node, 0) * letter_count + rows[length - 1 :])
            if not node.any():
                break
            nodes.append(node)
        first, second = np.full((width + 1, many), _LOW), np.full((width + 1, many), _LOW)
        first[0] = 0.0
        last = np.zeros((width + 1, many), dtype=np.int64)
        for end in range(1, width + 1):
            one, two, own = first[end], second[end], last[end]
            # Of equal sums the longest piece wins, as it comes first.
            for length in range(min(end, len(nodes)), 0, -1):
                score = steps.score.take(nodes[length - 1][end - length])
                value = first[end - length] + score
                score += second[end - length]
                np.copyto(own, length, where=value > one)
                np.maximum(score, np.minimum(value, one), out=score)
                np.maximum(two, score, out=two)
                np.maximum(one, value, out=one)
        best, cost = first[sizes, column], first[sizes, column] - second[sizes, column]
        ids, counts, end, going = np.empty((many, width), dtype=np.int32), np.zeros(many, dtype=np.int64), sizes.copy(), column
        while len(going):
            length = last[end[going], going]
            end[going] -= length
            counts[going] += 1
            for own in np.unique(length).tolist():
                some = going[length == own]
                ids[some, width - counts[some]] = steps.number[nodes[own - 1][end[some], some]]
            going = going[end[going] > 0]
        return [
            (tuple(row[width - n :]), value, lost)
            for row, n, value, lost in zip(ids.tolist(), counts.tolist(), best.tolist(), cost.tolist(), strict=True)
        ]

    def search(self, chunk: str, best: int) -> list[tuple[float, tuple[int, ...]]]:
        """The best segmentations by backward A-star search: (score, ids), best first."""
        known, unknown, size = self.vocabulary.known, self.vocabulary.unknown, len(chunk)
        into: list[list[tuple[int, int, float]]] = [[] for _ in range(size + 1)]
        ahead = [_LOW] * (size + 1)
        ahead[0] = 0.0
        for start in range(size):
            single = False
            for end in range(start + 1, size + 1):
                hit = known.get(chunk[start:end])
                if hit is None:
                    break
                if hit[0] >= 0:
                    single |= end == start + 1
                    into[end].append((start, *hit))
                    ahead[end] = max(ahead[end], ahead[start] + hit[1])
            if not single:
                into[start + 1].append((start, -1, unknown))
                ahead[start + 1] = max(ahead[start + 1], ahead[start] + unknown)
        found: list[tuple[float, tuple[int, ...]]] = []
        order = itertools.count()
        agenda = [(-ahead[size], size, next(order), 0.0, None)]
        while agenda and len(found) < best:
            _, at, _, done, path = heapq.heappop(agenda)
            if at == 0:
                ids = []
                while path:
                    (start, number), path = path
                    ids.append(number) if number >= 0 else ids.extend(self.vocabulary.bytes_of(chunk[start]))
                found.append((done, tuple(ids)))
                continue
            for start, number, score in into[at]:
                heapq.heappush(agenda, (-(done + score + ahead[start]), start, next(order), done + score, ((start, number), path)))
        return found

    def _recall(self, parts: list[str]) -> list[tuple[tuple[int, ...], float, float]]:
        """Ids, score and cost of different chunks; what isn't remembered is found for all of them at once."""
        found = list(map(self.cache.get, parts))
        missing = {part: self.older.get(part) for part, hit in zip(parts, found, strict=True) if hit is None}
        new = [part for part, hit in missing.items() if hit is None]
        missing.update(zip(new, self.viterbi_of(new), strict=True))
        for part, hit in missing.items():
            if len(part) <= LONGEST:
                if self.held >= self.cache_bytes:
                    self.older, self.cache, self.held = self.cache, {}, 0
                self.held += 350 + len(part) + 8 * len(hit[0])
                self.cache[part] = hit
        return [hit or missing[part] for hit, part in zip(found, parts, strict=True)]

    def _options(self, chunk: str) -> list[tuple[float, tuple[int, ...]]]:
        options = self.searched.get(chunk)
        if options is None:
            options = self.search(chunk, self.best)
            if len(chunk) <= LONGEST:
                if self.searched_held >= self.searched_bytes:
                    self.searched, self.searched_held = {}, 0
                self.searched_held += 200 + len(chunk) + sum(130 + 8 * len(ids) for _, ids in options)
                self.searched[chunk] = options
        return options

    def encode(self, text: str) -> tuple[list[int], float, list[tuple[float, list[tuple[int, int, tuple[int, ...]]]]]]:
        """Ids and score of the best segmentation, and for each further one its score and edits (at, count, ids)."""
        ids, total, others = next(self.encoded([text]))
        return ids.tolist(), total, others

    def encoded(self, texts: list[str]) -> Iterator[tuple[np.ndarray, float, list]]:
        """The same for each text, with the ids as an array. Each different chunk of the texts is looked up once."""
        cut, number = [chunks(" " + text) for text in texts], defaultdict()
        number.default_factory = number.__len__
        sizes = np.fromiter(map(len, cut), np.int64, len(cut))
        at = np.fromiter(map(number.__getitem__, itertools.chain.from_iterable(cut)), np.int64, sizes.sum())
        found = self._recall(list(number))
        counts = np.fromiter((len(hit[0]) for hit in found), np.int64, len(found))
        ids = np.fromiter(itertools.chain.from_iterable([hit[0] for hit in found]), np.int32, counts.sum())
        scores, costs = np.array([hit[1] for hit in found]), np.array([hit[2] for hit in found])
        starts, counts = (np.cumsum(counts) - counts)[at], counts[at]
        ends = np.concatenate([[0], np.cumsum(counts)])
        ids = ids.take(np.repeat(starts - ends[:-1], counts) + np.arange(ends[-1]))
        first = 0
        for parts, size in zip(cut, sizes.tolist(), strict=True):
            own = at[first : first + size]
            yield self._joined(parts, ids[ends[first] : ends[first + size]], sum(scores[own].tolist()), costs[own], counts[first : first + size])
            first += size

    def _joined(self, parts: list[str], ids: np.ndarray, total: float, costs: np.ndarray, counts: np.ndarray):
        chosen, costs = sorted(_smallest(costs, self.best - 1)), costs.tolist()
        chosen_options: dict[int, list[tuple[float, tuple[int, ...]]]] = {}
        sums: list[tuple[float, tuple]] = [(0.0, ())]
        for place in chosen:
            if costs[place] == float("inf"):
                continue
            options = chosen_options[place] = self._options(parts[place])
            top = options[0][0]
            # A choice is kept as a negative place, so that at equal cost the earlier change comes first.
            more = [
                (loss + top - score, (*picks, (-place, number)) if number else picks)
                for loss, picks in sums
                for number, (score, _) in enumerate(options)
            ]
            more.sort(key=lambda m: (m[0], [(-p, n) for p, n in m[1]]))
            sums = more[: self.best]
        others = []
        if len(sums) > 1:
            starts, counts = (np.cumsum(counts) - counts).tolist(), counts.tolist()
            for loss, picks in sums[1:]:
                edits = [(starts[-p], counts[-p], chosen_options[-p][n][1]) for p, n in picks]
                others.append((total - loss, edits))
        return ids, total, others

    def decode(self, ids) -> str:
        return self.vocabulary.decode(ids)[1:]


def _smallest(values: np.ndarray, most: int) -> list[int]:
    """The places of the smallest values, of equal ones the first."""
    if most < 1:
        return []
    places = np.arange(len(values)) if len(values) <= most else np.flatnonzero(values <= np.partition(values, most - 1)[most - 1])
    return places[np.argsort(values[places], kind="stable")][:most].tolist()


def edited(ids: list[int], edits) -> list[int]:
    """The ids of a further segmentation."""
    out, at = [], 0
    for start, count, new in edits:
        out += [*ids[at:start], *new]
        at = start + count
    return out + list(ids[at:])


#: Segmenters of this worker, by the vocabulary's path, N and bounds: later tasks find its memory filled.
_OWN: dict[tuple, Segmenter] = {}

_EDIT = T.StructType(
    [T.StructField("at", T.LongType()), T.StructField("count", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))]
)
_OTHER = T.ArrayType(T.StructType([T.StructField("score", T.DoubleType()), T.StructField("edits", T.ArrayType(_EDIT))]))
FIELDS = [
    T.StructField("n_pieces", T.LongType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("ids", T.ArrayType(T.IntegerType())),
    T.StructField("alternatives", _OTHER),
    T.StructField("round_trip", T.BooleanType()),
]
_ARROW_OTHER = pa.list_(
    pa.struct([("score", pa.float64()), ("edits", pa.list_(pa.struct([("at", pa.int64()), ("count", pa.int64()), ("ids", pa.list_(pa.int32()))])))])
)


def segmented(
    documents: DataFrame, key: str = "doc_id", text: str = "text", best: int = BEST, path: str = VOCABULARY,
    memory: tuple[int, int] | None = None,
) -> DataFrame:
    """Per row: `key`, n_pieces, score, ids, alternatives (2nd to N-th segmentation), round_trip (ids and all
    alternatives decode to the text). `memory` bounds what a worker remembers, in the order of CACHE_BYTES and
    SEARCHED_BYTES; results don't depend on it."""
    shared = share(documents.sparkSession, Vocabulary.read(path))

    def work():
        own = (path, best, memory)
        segmenter = _OWN.get(own) or _OWN.setdefault(own, Segmenter(shared.value, best, memory))
        decode = segmenter.vocabulary.decode

        def compute(texts):
            numbers, scores, flat, sizes, others, exact = [], [], [], [], [], []
            encoded = segmenter.encoded([text for text in texts if text is not None])
            for text in texts:
                if text is None:
                    numbers.append(None), scores.append(None), sizes.append(0), others.append(None), exact.append(None)
                    continue
                ids, score, more = next(encoded)
                numbers.append(len(ids)), scores.append(score), sizes.append(len(ids))
                flat.append(ids)
                others.append(
                    [{"score": s, "edits": [{"at": a, "count": c, "ids": list(new)} for a, c, new in edits]} for s, edits in more]
                )
                ids = ids.tolist()
                exact.append(
                    segmenter.decode(ids) == text
                    and all(decode(new) == decode(ids[a : a + c]) for _, edits in more for a, c, new in edits)
                )
            values = lists(np.concatenate(flat) if flat else [], sizes, pa.int32())
            if None in numbers:
                values = pa.ListArray.from_arrays(values.offsets, values.values, mask=pa.array([n is None for n in numbers]))
            return [numbers, scores, values, pa.array(others, _ARROW_OTHER), exact]

        return compute

    return with_text_columns(documents, [key], text, FIELDS, work, AT_ONCE if memory is None else min(AT_ONCE, SHARED_AT_ONCE))
