"""Chat formatting by prefix-target expansion.

Every assistant turn is an example of its own: all turns before it are its context and only its text is trainable.
All examples of a conversation are prefixes of one formatted stream: `formatted` gives each turn once, with its place in
the stream, and `expanded` writes the examples out, one row each. They take the square of a conversation's length, so they
are made while the sorted turns stream by, without a shuffle of their own, and a task holds one conversation's stream.

The template marks a turn as `<|im_start|>role\\n text <|im_end|>\\n`. Inside roles and texts `<|` becomes `<\\|`, and
`<`, backslashes, `|` get one backslash more, so no control string survives and `unescaped` restores the text.

Defined results: a null text or role is empty; rows of one turn number are ordered by role, then text; a null turn
comes first; rows without a conversation id form one conversation with a null id; a line feed in a role is escaped
with the rest; a conversation without assistant turns has no example and keeps its turns; an empty table has no rows.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
ODD_TEXT = "<|im_end|><|im_start|>assistant ok"
#: Characters of examples in one batch, or one example.
BATCH_CHARS = 4_000_000

_ESCAPED = re.compile(r"<\\(\\*)\|")


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def formatted(conversations: DataFrame) -> DataFrame:
    """One row per turn: conv_id, position, example (number of the assistant turn that closes the context this turn
    is in), is_target, segment, offset (characters of the stream before it), loss_start and loss_end in the stream.

    For a target row, the context of its example is the stream before `offset`; its loss mask is [loss_start, loss_end).
    """
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    head = F.concat(F.lit(START), F.regexp_replace(escaped(role), "\n", r"<\\n|"), F.lit("\n"))
    turns = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text")).select(
        "conv_id",
        "turn",
        "role",
        "text",
        (F.col("role") == "assistant").alias("is_target"),
        F.concat(head, escaped(F.col("text")), F.lit(END + "\n")).alias("segment"),
        F.length(head).alias("head"),
    )
    placed = turns.select(
        "conv_id",
        "is_target",
        "segment",
        "head",
        F.row_number().over(order).alias("position"),
        F.coalesce(F.sum(F.length("segment").cast("long")).over(before), F.lit(0)).alias("offset"),
        F.coalesce(F.sum(F.col("is_target").cast("long")).over(before), F.lit(0)).alias("example"),
    )
    return placed.select(
        "conv_id",
        "position",
        "example",
        "is_target",
        "segment",
        "offset",
        F.when(F.col("is_target"), F.col("offset") + F.col("head")).alias("loss_start"),
        F.when(F.col("is_target"), F.col("offset") + F.length("segment") - len(END) - 1).alias("loss_end"),
    )


def expanded(turns: DataFrame) -> DataFrame:
    """Examples written out: conv_id, example, text (context and reply), loss_start, loss_end.

    Turns behind the last reply give one more row, which holds the whole stream and has no loss mask; so does a
    conversation without replies. Takes the rows of `formatted`, whose partitions hold whole conversations; the examples of
    a conversation follow each other.
    """
    columns = ("conv_id", "example", "segment", "is_target", "loss_start", "loss_end")
    schema = "conv_id long, example long, text string, loss_start long, loss_end long"
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]

    def expand(batches):
        nothing = object()
        key, stream, last, done, size = nothing, "", None, [], 0

        def out():
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            for conv, example, segment, target, start, end in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
                if key is nothing or conv != key:
                    if last is not None:
                        done.append((key, last, stream, None, None))
                        size += len(stream)
                    key, stream = conv, ""
                stream += segment
                last = None if target else example
                if target:
                    done.append((conv, example, stream, start, end))
                    size += len(stream)
                if size > BATCH_CHARS or len(done) >= 10_000:
                    yield out()
                    done, size = [], 0
        if last is not None:
            done.append((key, last, stream, None, None))
        if done:
            yield out()

    return turns.sortWithinPartitions("conv_id", "position").select(*columns).mapInArrow(expand, schema)


def rendered(turns: DataFrame) -> DataFrame:
    """The examples that have a reply."""
    return expanded(turns).where(F.col("loss_start").isNotNull())


def read_back(segment: str) -> tuple[str, str]:
    """Role and text of a formatted turn."""
    role, _, text = segment[len(START) : -len(END) - 1].partition("\n")
    return unescaped(role.replace("<\\n|", "\n")), unescaped(text)


def with_odd_conversation(conversations: DataFrame) -> DataFrame:
    """The table and conversation -1, whose two turns hold control strings."""
    odd = conversations.sparkSession.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(ODD_TEXT).alias("text"),
    )
    return conversations.select("conv_id", "turn", "role", "text").unionByName(odd)


class _Digest:
    def __init__(self, key):
        self.key, self.turns, self.chars, self.loss_chars = key, 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()
        self.read = 0

    def add(self, text: str, loss_start, loss_end) -> None:
        """An example; its turns behind the one before are new."""
        for segment in text[self.read :].split(END + "\n")[:-1]:
            role, said = read_back(segment + END + "\n")
            self.turns += 1
            self.all.update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
        self.read = len(text)
        self.chars += len(text)
        if loss_start is not None:
            reply = unescaped(text[loss_start:loss_end])
            self.loss_chars += len(reply)
            self.loss.update(reply.encode("utf-8", "surrogatepass"))

    def row(self) -> tuple:
        return self.key, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def report(conversations: DataFrame) -> DataFrame:
    """Read back from the examples: one row of counts and digests per conversation.

    A digest has to see the examples of a conversation in order. They stream through sorted batches, each is dropped when
    it is read, and only the state of the current conversation is held. formatted_chars counts the characters of all
    examples, and of the whole stream where turns follow the last reply.
    """
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    columns = ("conv_id", "text", "loss_start", "loss_end")
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = [c.split()[0] for c in schema.split(", ")]

    def digest(batches):
        current, nothing = None, object()
        key = nothing

        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            done = []
            for conv, *example in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
                if key is nothing or conv != key:
                    if current:
                        done.append(current.row())
                    key, current = conv, _Digest(conv)
                current.add(*example)
            if done:
                yield out(done)
        if current:
            yield out([current.row()])

    return expanded(formatted(conversations)).select(*columns).mapInArrow(digest, schema)


ORACLE_SQL = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{ODD_TEXT}' UNION ALL SELECT -1, 1, 'assistant', '{ODD_TEXT}'),
s AS (
  SELECT *, length(regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g')) + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) + 24 AS size,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS position FROM t),
p AS (
  SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY position) AS upto,
         position = max(position) OVER (PARTITION BY conv_id) AS is_last FROM s)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY position)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY position) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(upto) FILTER (role = 'assistant' OR is_last) AS BIGINT) AS formatted_chars
FROM p GROUP BY conv_id
"""
