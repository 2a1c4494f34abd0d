"""Rows judged beside the texts of their document: each text moves once and is split once."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenuis.functions.matching import narrowest_span


class Words:
    """A normalized key (null: empty) with its distinct words."""

    def __init__(self, key: str | None):
        self.key = key or ""
        self.words = set(self.key.split())

    def has(self, phrase: str) -> bool:
        """Whole-word phrase test, as in ``tx.has_phrase``."""
        parts = phrase.split()
        return bool(parts) and self.words.issuperset(parts) and (len(parts) == 1 or f" {phrase} " in f" {self.key} ")

    def width(self, tokens: Sequence[str]) -> int | None:
        return narrowest_span(self.key, set(tokens)) if tokens else None


@lru_cache(maxsize=100_000)
def distinct_words(key: str) -> tuple[str, ...]:
    return tuple(dict.fromkeys(key.split()))


def beside_texts(asked: DataFrame, texts: DataFrame, out: T.StructType, read: Callable, judge: Callable) -> DataFrame:
    """judge(read(text rows of the document), rows of the link) for every (document_id, candidate_id) of `asked`.

    asked: document_id, candidate_id and further columns; texts: document_id and further columns, any number of rows of a
    document. `read` and `judge` get the further columns as tuples; judge returns the columns of `out` behind the two ids.
    Both tables move once, by document; the rows of `asked` stream past the texts in sorted order, so a document with
    many links costs no copies of its text. Links of unknown documents and null ids give nothing, as in an inner join.
    """
    keys = ["document_id", "_kind", "candidate_id"]
    more = [c for c in asked.columns if c not in keys]
    parts = [c for c in texts.columns if c not in keys]
    rows = texts.withColumn("_kind", F.lit(0)).unionByName(
        asked.where(F.col("candidate_id").isNotNull()).withColumn("_kind", F.lit(1)), allowMissingColumns=True
    )
    rows = rows.where(F.col("document_id").isNotNull()).select(*keys, *more, *parts)
    ordered = rows.repartition("document_id").sortWithinPartitions(*keys)
    full = T.StructType([asked.schema["candidate_id"], asked.schema["document_id"], *out.fields])
    width = len(keys) + len(more)

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(full)
        document, held, state, link, waiting, done = None, [], None, None, [], []

        def close():
            nonlocal state, waiting
            if waiting and held:
                state = read(held) if state is None else state
                done.append((link, document, *judge(state, waiting)))
            waiting = []

        def batch():
            columns = zip(zip(*done, strict=True), schema, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in columns], schema=schema)

        for part in batches:
            for row in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if row[0] != document:
                    close()
                    document, held, state, link = row[0], [], None, None
                if row[1] == 0:
                    held.append(row[width:])
                    continue
                if row[2] != link:
                    close()
                    link = row[2]
                waiting.append(row[len(keys) : width])
            if len(done) >= 10_000:
                yield batch()
                done = []
        close()
        if done:
            yield batch()

    return ordered.mapInArrow(run, full)
