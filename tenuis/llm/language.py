"""Language identification by segmentation-marginalised unigrams.

Each language has probabilities over the pieces of a fixed public vocabulary. The probability of a text is the sum,
over all its segmentations into pieces, of the products of their probabilities; a forward pass over the lattice gives
it. The lattice falls apart at chunks, so a text's log-probability is the sum over its chunks, and a chunk is scored
once per worker for all languages together.

The probabilities are learned by expectation-maximisation from at most `DOCS_PER_LANGUAGE` labelled documents of each
language, drawn by a hash of their ids. That bound is the only sample of documents; of the
drawn ones, chunks over `LONG` characters teach nothing, so a language written without spaces learns little, and one with long chunks
only is never predicted. Every document is scored over its whole text.

Defined results: a null text, or one without a letter, is `und` with score 0; without any labelled document all are;
equal probabilities go to the first language in order; documents without an id or a language teach nothing; repeated
rows are scored alike.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenuis.llm.common import share, where_text, with_text_columns
from tenuis.llm.pieces import VOCABULARY, Vocabulary, chunks, edges, packed_matcher
from tenuis.session import cut_lineage

DOCS_PER_LANGUAGE = 1000
ROUNDS = 2
SMOOTHING = 0.05
UNKNOWN = 1e-7
#: Chunks up to this length are scored side by side; longer ones one by one, with rescaling.
LONG = 40
CACHE = 300_000
LEAST_SCORE = 0.5


@dataclass(frozen=True)
class Model:
    vocabulary: Vocabulary
    languages: list[str]
    #: One row per piece id and one for an unknown character (the last), one column per language.
    probability: np.ndarray


def forward(known, pieces_in, probability: np.ndarray, words: list[str]) -> np.ndarray:
    """Log-probability of each chunk in each language, over all segmentations.

    Short chunks are scored side by side: `pieces_in` finds the pieces of all of them in one text, joined by line
    feeds, which no piece holds; then the sums move on from place to place for all chunks at once.
    """
    out = np.empty((len(words), probability.shape[1]))
    short = [i for i, w in enumerate(words) if len(w) <= LONG]
    for i, w in enumerate(words):
        if len(w) > LONG:
            out[i] = _forward_long(known, probability, w)
    if not short:
        return out
    sizes = np.array([len(words[i]) for i in short])
    begins = np.concatenate([[0], np.cumsum(sizes + 1)])
    joined = "\n".join([words[i].replace("\n", "\0") for i in short])
    packed = np.fromiter(((last << 24) + piece for last, piece in pieces_in(joined)), dtype=np.int64)
    ends, numbers, lengths = (packed >> 24) + 1, (packed >> 5) & 0x7FFFF, packed & 31
    # Places that no one-character piece covers get an edge for an unknown character.
    bare = np.ones(len(joined) + 2, dtype=bool)
    bare[ends[lengths == 1]] = False
    bare[begins] = False
    unknown = np.flatnonzero(bare[: len(joined) + 1])
    ends = np.concatenate([ends, unknown])
    numbers = np.concatenate([numbers, np.full(len(unknown), -1)])
    lengths = np.concatenate([lengths, np.ones(len(unknown), dtype=np.int64)])
    owner = np.repeat(np.arange(len(short)), sizes + 1)
    row = owner[ends - 1]
    end = ends - begins[row]
    key = (end << 5 | lengths).astype(np.uint16)
    order = np.argsort(key, kind="stable")
    row, end, number, length, key = row[order], end[order], numbers[order], lengths[order], key[order]
    cuts = np.flatnonzero(np.diff(key)) + 1
    alpha = np.zeros((int(sizes.max()) + 1, len(short), probability.shape[1]))
    alpha[0] = 1.0
    # One group holds one edge per chunk at most, so its sums don't meet.
    for a, b in zip([0, *cuts], [*cuts, len(key)] if len(key) else [0], strict=False):
        at, rows = end[a], row[a:b]
        alpha[at, rows] += alpha[at - length[a], rows] * probability[number[a:b]]
    out[short] = np.log(alpha[sizes, np.arange(len(short))])
    return out


def _forward_long(known, probability, word) -> np.ndarray:
    """One chunk of any length, with a logarithmic scale for each place."""
    size = len(word)
    alpha = np.zeros((size + 1, probability.shape[1]))
    scale = np.zeros((size + 1, probability.shape[1]))
    alpha[0] = 1.0
    for start in range(size):
        if start:
            top = np.maximum(alpha[start], 1e-300)
            scale[start] += np.log(top)
            alpha[start] = 1.0
        single = False
        for end in range(start + 1, size + 1):
            hit = known.get(word[start:end])
            if hit is None:
                break
            if hit[0] >= 0:
                single |= end == start + 1
                _add(alpha, scale, end, scale[start], probability[hit[0]])
        if not single:
            _add(alpha, scale, start + 1, scale[start], probability[-1])
    return np.log(alpha[size]) + scale[size]


def _add(alpha, scale, end, base, p) -> None:
    """alpha[end] * exp(scale[end]) += p * exp(base)."""
    if not alpha[end].any():
        alpha[end], scale[end] = p, base
        return
    top = np.maximum(scale[end], base)
    alpha[end] = alpha[end] * np.exp(scale[end] - top) + p * np.exp(base - top)
    scale[end] = top


def expected_counts(known, probability: np.ndarray, word: str) -> dict[int, float]:
    """How often each piece is used in the chunk, in expectation over all segmentations (one language)."""
    lattice, size = edges(known, word), len(word)
    alpha, beta = [0.0] * (size + 1), [0.0] * (size + 1)
    alpha[0] = beta[size] = 1.0
    for start, found in enumerate(lattice):
        for end, number, _ in found:
            alpha[end] += alpha[start] * probability[number]
    for start in range(size - 1, -1, -1):
        beta[start] = sum(probability[number] * beta[end] for end, number, _ in lattice[start])
    total = alpha[size]
    counts: dict[int, float] = {}
    if total > 0:
        for start, found in enumerate(lattice):
            for end, number, _ in found:
                if number >= 0:
                    counts[number] = counts.get(number, 0.0) + alpha[start] * probability[number] * beta[end] / total
    return counts


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(
    documents: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang",
    per_language: int = DOCS_PER_LANGUAGE, rounds: int = ROUNDS, path: str = VOCABULARY,
) -> Model:
    """Learn from the labelled documents that are not held out; at most `per_language` of each language."""
    spark = documents.sparkSession
    vocabulary = Vocabulary.read(path)
    known = share(spark, vocabulary.known)
    labelled = documents.select(F.col(key).alias("key"), F.col(lang).alias("lang"), F.col(text).cast("string").alias("text"))
    labelled = labelled.where(F.col("key").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("key")))
    drawn = (
        labelled.select("key", "lang")
        .withColumn("place", F.row_number().over(W.partitionBy("lang").orderBy(F.xxhash64("key"), "key")))
        .where(F.col("place") <= per_language)
        .select("key", "lang")
        .distinct()
    )

    def counted(batches):
        for batch in batches:
            found: Counter = Counter()
            for language, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if value:
                    found.update((language, c) for c in chunks(" " + value) if len(c) <= LONG)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.string()), pa.array(list(found.values()), pa.int64())],
                names=["lang", "chunk", "n"],
            )

    # The drawn ids are few by their bound, so Spark broadcasts them if it finds them small; texts stay in place then.
    words = cut_lineage(
        labelled.join(drawn, ["key", "lang"], "left_semi")
        .select("lang", "text")
        .mapInArrow(counted, "lang string, chunk string, n long")
        .groupBy("lang", "chunk")
        .agg(F.sum("n").alias("n"))
    )
    languages = [r["lang"] for r in words.select("lang").distinct().orderBy("lang").collect()]
    size = len(vocabulary.surface)
    probability = np.full((size + 1, len(languages)), 1.0 / size)
    probability[-1] = UNKNOWN
    for _ in range(rounds if languages else 0):
        current = share(spark, (languages, probability))

        def expect(batches, current=current):
            names, p = current.value
            columns = {name: np.ascontiguousarray(p[:, i]).tolist() for i, name in enumerate(names)}
            sums: Counter = Counter()
            for batch in batches:
                for language, chunk, n in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                    for number, count in expected_counts(known.value, columns[language], chunk).items():
                        sums[language, number] += n * count
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in sums], pa.string()), pa.array([k[1] for k in sums], pa.int64()), pa.array(list(sums.values()), pa.float64())],
                names=["lang", "piece", "n"],
            )

        # At most one row for each language and piece of the fixed vocabulary.
        sums = words.mapInArrow(expect, "lang string, piece long, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).collect()
        counts = np.full((size, len(languages)), SMOOTHING)
        for row in sums:
            counts[row["piece"], languages.index(row["lang"])] += row["n"]
        probability = np.vstack([counts / counts.sum(axis=0), np.full(len(languages), UNKNOWN)])
    return Model(vocabulary, languages, probability)


class Scorer:
    def __init__(self, model: Model):
        self.model, self.rows = model, {}
        self.pieces_in = packed_matcher(model.vocabulary).iter
        self.table = np.zeros((0, len(model.languages)))

    def _learn(self, parts: set[str]) -> None:
        new = [p for p in parts if p not in self.rows]
        if len(self.rows) + len(new) > CACHE:
            self.rows, self.table, new = {}, self.table[:0], list(parts)
        if new:
            start = len(self.rows)
            self.rows.update((p, start + i) for i, p in enumerate(new))
            known, probability = self.model.vocabulary.known, self.model.probability
            fresh = [forward(known, self.pieces_in, probability, new[i : i + 20_000]) for i in range(0, len(new), 20_000)]
            self.table = np.vstack([self.table, *fresh])

    def score(self, texts: list[str | None], at_once: int = 256) -> tuple[list[str], list[float]]:
        names, values = [], []
        for first in range(0, len(texts), at_once):
            parts = [
                chunks(" " + t) if t and self.model.languages and any(map(str.isalpha, t)) else None
                for t in texts[first : first + at_once]
            ]
            self._learn({c for p in parts if p for c in p})
            for p in parts:
                if p is None:
                    names.append("und"), values.append(0.0)
                    continue
                total = self.table[[self.rows[c] for c in p]].sum(axis=0)
                weights = np.exp(total - total.max())
                best = int(total.argmax())
                names.append(self.model.languages[best]), values.append(float(weights[best] / weights.sum()))
        return names, values


def languages(documents: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """The columns `keep`, lang_pred and score of every row."""
    shared = share(documents.sparkSession, model)

    def work():
        scorer = Scorer(shared.value)
        return lambda texts: list(scorer.score(texts))

    return with_text_columns(
        documents, keep, text, [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())], work
    )


def with_known_language(documents: DataFrame, model: Model, text: str = "text", least: float = LEAST_SCORE) -> DataFrame:
    """The rows, with all columns, whose text is of a learned language by a score of `least` or more."""
    shared = share(documents.sparkSession, model)

    def work():
        scorer = Scorer(shared.value)

        def keep(texts):
            names, values = scorer.score(texts)
            return [n != "und" and v >= least for n, v in zip(names, values, strict=True)]

        return keep

    return where_text(documents, text, work)


def report(documents: DataFrame) -> DataFrame:
    found = languages(documents, fit(documents), ["doc_id"])
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
