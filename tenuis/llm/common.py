"""Helpers shared by the operators: tables, work on the texts of Arrow batches, checked broadcasts."""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_BROADCAST_BYTES = 256 << 20


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def sha256_hex(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def share(spark: SparkSession, value, limit: int = MAX_BROADCAST_BYTES) -> Broadcast:
    """Broadcast of a value whose pickled size is checked first; callers state why it is bounded."""
    size = len(pickle.dumps(value, protocol=5))
    if size > limit:
        raise ValueError(f"a shared table of {size} bytes is over the bound of {limit}")
    return spark.sparkContext.broadcast(value)


def with_text_columns(
    df: DataFrame, keep: list[str], text: str, fields: list[T.StructField], work: Callable[[], Callable[[list], list]],
    at_once: int | None = None,
) -> DataFrame:
    """The columns `keep` as they are, and columns computed from the text of each row.

    `work` is called once per partition and gives a function from a list of texts (None for null) to one list or
    Arrow array per field. Rows keep their order and number. `at_once` bounds the bytes of the texts of a list.
    """
    source = df.select(*[F.col(c) for c in keep], F.col(text).cast("string").alias("__text"))
    schema = T.StructType([*source.schema.fields[:-1], *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = work()
        for batch in batches if at_once is None else (part for whole in batches for part in cut_batch(whole, at_once)):
            columns = compute(batch.column(batch.num_columns - 1).to_pylist())
            made = [
                c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, type=_arrow_type(f.dataType))
                for c, f in zip(columns, fields, strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], *made], names=[f.name for f in schema.fields]
            )

    return source.mapInArrow(run, schema)


def cut_batch(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """The rows in order, in batches whose last column has at most so many bytes; a longer value is alone."""
    start, held = 0, 0
    for at, size in enumerate(pc.binary_length(batch.column(batch.num_columns - 1)).to_pylist()):
        if at > start and held + (size or 0) > most:
            yield batch.slice(start, at - start)
            start, held = at, 0
        held += size or 0
    yield batch.slice(start)


def where_text(df: DataFrame, text: str, work: Callable[[], Callable[[list], list]]) -> DataFrame:
    """The rows, with all their columns, for whose text the function of `work` says True."""
    at = df.columns.index(text)

    def run(batches):
        keep = work()
        for batch in batches:
            yield batch.filter(pa.array(keep(batch.column(at).to_pylist()), type=pa.bool_()))

    return df.mapInArrow(run, df.schema)


def change_text(df: DataFrame, text: str, work: Callable[[], Callable[[list], list]]) -> DataFrame:
    """The same rows and columns with another text."""
    at = df.columns.index(text)

    def run(batches):
        change = work()
        for batch in batches:
            new = pa.array(change(batch.column(at).to_pylist()), type=batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(
                [new if i == at else c for i, c in enumerate(batch.columns)], names=batch.schema.names
            )

    return df.mapInArrow(run, df.schema)


def _arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def lists(values, lengths, kind: pa.DataType) -> pa.ListArray:
    """List column from the flat values of all rows and the length of each row."""
    import numpy as np

    offsets = np.zeros(len(lengths) + 1, dtype=np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, type=pa.int32()), pa.array(values, type=kind))
