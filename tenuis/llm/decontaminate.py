"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The alphabet is the word: a pattern is a window of `WINDOW` consecutive benchmark words (a shorter item is one
window), a block is two adjacent words. For the patterns of one length m, the shift table tells how far a window of
the text may move on from the block at its end; an unknown block allows the full m - 1. A shift of zero leads to the
bucket of that suffix block, whose test strings are compared word by word.

The patterns are cut into blocks of at most `max_words` words, so each search table has a bounded size however large
the benchmark grows; every document is searched against all blocks, one pass each, without any shuffle of texts.

Defined results: a null text has no words and an empty text none either (n_words 0, not contaminated); a null item
text has no window; the windows of an item without an id mark words but name no item; repeated items count once and
repeated documents give repeated rows; an empty benchmark hits nothing; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenuis.llm.common import share, where_text, with_text_columns

WINDOW = 10
MAX_WORDS = 1_000_000

#: Bytes outside words become spaces, A-Z become a-z. Bytes from 0x80 on belong to words.
_WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split() if text else []


def windows_of(words: list[bytes], size: int = WINDOW) -> Iterator[tuple[bytes, ...]]:
    if 0 < len(words) <= size:
        yield tuple(words)
    for start in range(len(words) - size + 1 if len(words) > size else 0):
        yield tuple(words[start : start + size])


class WuManber:
    """Search tables for windows of one length."""

    def __init__(self, length: int, windows: dict[tuple[bytes, ...], set]):
        self.length, self.block = length, min(2, length)
        self.free = length - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.bucket: dict[tuple[bytes, ...], list] = {}
        for window, ids in windows.items():
            for end in range(self.block, length + 1):
                block = window[end - self.block : end]
                self.shift[block] = min(self.shift.get(block, self.free), length - end)
            self.bucket.setdefault(window[length - self.block :], []).append((window[0], window, ids))

    def search(self, words: list[bytes]) -> Iterator[tuple[int, set]]:
        """(start, item ids) of each occurrence, from left to right."""
        m, wide, free, shift = self.length, self.block == 2, self.free, self.shift.get
        end, n = m - 1, len(words)
        while end < n:
            block = (words[end - 1], words[end]) if wide else (words[end],)
            step = shift(block, free)
            if step:
                end += step
                continue
            start = end - m + 1
            first = words[start]
            for head, window, ids in self.bucket[block]:
                if head == first and tuple(words[start : end + 1]) == window:
                    yield start, ids
            end += 1


def search_tables(windows: Iterable[tuple[tuple[bytes, ...], object]]) -> list[WuManber]:
    by_length: dict[int, dict[tuple[bytes, ...], set]] = {}
    for window, item in windows:
        by_length.setdefault(len(window), {}).setdefault(window, set()).add(item)
    return [WuManber(length, found) for length, found in sorted(by_length.items())]


def find(tables: list[WuManber], words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
    """Merged spans of hit words (end exclusive) and the ids of the items found."""
    spans, items = [], set()
    for machine in tables:
        for start, ids in machine.search(words):
            spans.append((start, start + machine.length))
            items |= ids
    return merged(spans), items


def merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def pattern_blocks(benchmark: DataFrame, item: str, text: str, size: int, max_words: int) -> list[list]:
    """Broadcast blocks of (window words, item id), each of at most about `max_words` words.

    Items are cut into overlapping pieces on the executors, so one huge item spreads over blocks too; the driver
    holds one block at a time.
    """
    step = max(size, 2000)

    def cut(batches):
        for batch in batches:
            ids, pieces = [], []
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(value)
                for start in range(0, max(len(words) - size + 1, min(1, len(words))), step):
                    ids.append(key)
                    pieces.append(words[start : start + step + size - 1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(pieces, pa.list_(pa.binary())), pa.array([len(p) for p in pieces], pa.int64())],
                names=["id", "words", "n"],
            )

    pieces = (
        benchmark.select(F.col(item).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
        .mapInArrow(cut, "id long, words array<binary>, n long")
        .distinct()
    )
    total = pieces.agg(F.sum("n")).first()[0] or 0
    count = -(-total // max_words)
    shared = []
    for number in range(count):
        mine = pieces.where(F.pmod(F.xxhash64("words"), F.lit(count)) == number) if count > 1 else pieces
        shared.append(
            share(benchmark.sparkSession, [(row["id"], [bytes(w) for w in row["words"]]) for row in mine.select("id", "words").collect()])
        )
    return shared


def _tables(block, size: int) -> list[WuManber]:
    return search_tables((w, key) for key, words in block.value for w in windows_of(words, size))


def contamination(
    documents: DataFrame,
    benchmark: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    size: int = WINDOW,
    max_words: int = MAX_WORDS,
) -> DataFrame:
    """Per document row: `key`, n_words, spans (hit words, as [start, end) word numbers), items (ids found, sorted), hit."""
    fields = [
        T.StructField("n_words", T.LongType()),
        T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))),
        T.StructField("items", T.ArrayType(T.LongType())),
    ]
    blocks = pattern_blocks(benchmark, item, item_text, size, max_words)

    def search(block):
        def work():
            tables = _tables(block, size) if block is not None else []

            def compute(texts):
                numbers, spans, items = [], [], []
                for value in texts:
                    words = words_of(value)
                    found, ids = find(tables, words)
                    numbers.append(len(words))
                    spans.append([list(s) for s in found])
                    items.append(sorted(i for i in ids if i is not None))
                return [numbers, spans, items]

            return compute

        return work

    if len(blocks) <= 1:
        found = with_text_columns(documents, [key], text, fields, search(blocks[0] if blocks else None))
    else:
        # Further blocks pass over the same rows, which keep the text and what was found before.
        found = documents.select(F.col(key), F.col(text).cast("string").alias("__doc"))
        for number, block in enumerate(blocks):
            more = [T.StructField(f"{f.name}_{number}", f.dataType) for f in fields]
            found = with_text_columns(found, found.columns, "__doc", more, search(block))
        numbers = range(len(blocks))
        found = found.select(
            key,
            F.col("n_words_0").alias("n_words"),
            _merged_spans(F.flatten(F.array(*[f"spans_{n}" for n in numbers]))).alias("spans"),
            F.array_sort(F.array_distinct(F.flatten(F.array(*[f"items_{n}" for n in numbers])))).alias("items"),
        )
    return found


def _merged_spans(spans):
    """Union of spans as a fold over the sorted array."""
    empty = F.array().cast("array<array<bigint>>")
    last = lambda done: F.element_at(done, -1)
    return F.aggregate(
        F.array_sort(spans),
        empty,
        lambda done, s: F.when(
            (F.size(done) > 0) & (s[0] <= F.coalesce(F.try_element_at(done, F.lit(-1))[1], F.lit(-1))),
            F.concat(
                F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))),
                F.array(F.array(F.try_element_at(done, F.lit(-1))[0], F.greatest(F.try_element_at(done, F.lit(-1))[1], s[1]))),
            ),
        ).otherwise(F.concat(done, F.array(s))),
    )


def without_contaminated(
    documents: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
    size: int = WINDOW, max_words: int = MAX_WORDS,
) -> DataFrame:
    """The rows of `documents`, with all columns, in which no window of the benchmark occurs."""
    for block in pattern_blocks(benchmark, item, item_text, size, max_words):

        def work(block=block):
            tables = _tables(block, size)

            def clean(texts):
                return [not any(next(t.search(words), None) for t in tables) for words in map(words_of, texts)]

            return clean

        documents = where_text(documents, text, work)
    return documents


def report(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document with counts and the digest of the items found."""
    found = contamination(documents, benchmark)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s[1] - s[0])
    names = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


_WORDS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE_SQL = rf"""
WITH dw AS (SELECT doc_id, {_WORDS_SQL} AS w FROM documents),
iw AS (SELECT item_id, {_WORDS_SQL} AS w FROM benchmark WHERE text IS NOT NULL),
items AS (
  SELECT item_id, least(len(w), 10) AS m, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p, w FROM iw WHERE len(w) > 0),
wins AS (SELECT DISTINCT item_id, m, array_to_string(w[p : p + m - 1], ' ') AS s FROM items),
sizes AS (SELECT DISTINCT m FROM wins),
places AS (
  SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS p FROM dw, sizes WHERE len(w) >= m),
hits AS (
  SELECT doc_id, p, places.m, item_id FROM places JOIN wins ON places.m = wins.m AND array_to_string(w[p : p + places.m - 1], ' ') = s),
hitwords AS (SELECT DISTINCT doc_id, unnest(range(p, p + m)) AS at FROM hits),
counts AS (SELECT doc_id, count(*) AS n_hit FROM hitwords GROUP BY doc_id),
found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN counts USING (doc_id) LEFT JOIN found USING (doc_id)
"""
