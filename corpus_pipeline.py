"""The corpus pipeline: language, near copies, benchmark passages, personal data, segmentation.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and returns a DataFrame; all but
the last return the columns of `documents`, with any further columns as they are. Rows are dropped for three reasons
only: no learned language gets a posterior of language.LEAST_SCORE, a document with a smaller id is linked to it by near
copies, or a benchmark window occurs in it. The posterior is one among the learned languages: it rejects texts without
letters and very short texts that fit several languages, not long texts of a language that was never learned.

Nulls and repeats: a null, empty or letterless text is dropped by the first stage; rows without an id are never near copies
of others and stay; of repeated rows of one id the near-copy stage keeps the first by text; personal data and segments of a
null text are null. Equal texts are near copies, of which the smallest id stays. Texts of any length are read whole. Empty tables
give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenuis.llm import decontaminate, jaccard, language, nbest, pii
from tenuis.llm.common import table
from tenuis.session import cut_lineage


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows whose text is null, has no letter, or gets no posterior of language.LEAST_SCORE among the learned languages."""
    return language.with_known_language(docs, language.fit(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near copies."""
    return jaccard.without_near_copies(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item."""
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts by its kind; n_chars follows the text."""
    masked = pii.mask(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns) if "n_chars" in docs.columns else masked


def segment(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of the best segmentation and the changes of the further ones."""
    return nbest.segmented(docs, memory=(nbest.SHARED_CACHE_BYTES, nbest.SHARED_SEARCHED_BYTES))


STAGES = [
    ("language_id", keep_known_languages),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("personal_data", mask_personal_data),
    ("segmentation", segment),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        # Later stages read their rows more than once, so each stage is written before the next one.
        docs = cut_lineage(docs) if number else docs
        docs = stage(spark, docs, sf_dir)
    return docs


#: SQL has no expression for learned languages, trees or lattices; tests/llm compares with brute force.
ORACLE_SQL = None

QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
