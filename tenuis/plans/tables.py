"""Input tables derived from the benchmark tables, with the same derivations as SQL.

A production run reads these tables from its own sources; here every one is a fixed expression
over whole given tables, so Spark and SQL compute the same rows.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tenuis.functions import text as tx
from tenuis.functions.dates import Windows
from tenuis.functions.ids import digest_id, document_identity
from tenuis.session import stored

CUTOFF = dt.date(2026, 9, 15)
WINDOWS = Windows.ending(CUTOFF)
ITEM_CUTOFF = dt.date(2001, 11, 4)
ITEM_WINDOWS = Windows.ending(ITEM_CUTOFF)
#: Rows that a task gets where rows are dealt out by number, so that what it sorts doesn't grow with the table.
ROWS_A_TASK = 1 << 18


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def parts(df: DataFrame) -> int:
    """So many partitions that all cores have one and a partition has about ROWS_A_TASK rows at most."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // ROWS_A_TASK))


def spread(df: DataFrame, key: str) -> DataFrame:
    """Use all cores for a table stored in fewer files than there are cores; else leave it."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(parts(df), key) if len(df.inputFiles()) < cores else df


def row_count(df: DataFrame) -> Column:
    """Number of rows as a scalar subquery."""
    return df.agg(F.count(F.lit(1))).scalar()


def pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """Source documents: title is the first line, connector and trust follow the source number."""
    number = F.substring("source", 4, 10).cast("int")
    base = spread(table(spark, sf, "documents"), "doc_id").select(
        F.col("doc_id"),
        F.concat(F.lit("doc-"), F.col("doc_id")).alias("document_id"),
        F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"),
        F.col("text").alias("excerpt"),
        F.when(number % 2 == 0, "openalex").otherwise("mediacloud").alias("connector"),
        pick(["A", "B", "C", "D", "unknown"], number % 5).alias("trust_tier"),
        F.when(
            F.col("doc_id") % 17 != 0,
            F.date_add(F.lit(dt.date(2024, 9, 15)), (F.col("doc_id") % 731).cast("int")),
        ).alias("published_at"),
        F.col("source").alias("publisher"),
        F.col("lang").alias("language"),
        F.length("text").alias("excerpt_length"),
    )
    keyed = base.withColumns(
        {
            "title_key": tx.identity_key(F.col("title")),
            "excerpt_key": tx.identity_key(F.col("excerpt")),
        }
    )
    copy = F.substring(F.sha2("excerpt_key", 256), 1, 16)
    url = F.concat(F.lit("https://news.example.org/"), F.col("language"), F.lit("/"), copy)
    doi = F.when(F.col("connector") == "openalex", F.concat(F.lit("10.1000/"), copy))
    return keyed.withColumns(
        {
            "origin_id": digest_id("origin-", F.col("title_key")),
            "url": url,
            "time_window": WINDOWS.of(F.col("published_at")),
            "document_identity": document_identity(
                doi, url, url, F.col("connector"), F.col("document_id")
            ),
        }
    )


def texts(spark: SparkSession, sf: str) -> DataFrame:
    """Whole texts by document id, straight from the table."""
    return spread(table(spark, sf, "documents"), "doc_id").select(
        F.concat(F.lit("doc-"), F.col("doc_id")).alias("document_id"), F.col("text").alias("excerpt")
    )


def stored_documents(spark: SparkSession, sf: str) -> DataFrame:
    """`documents` without the raw text, normalized once and stored for plans that read it several times."""
    return stored(documents(spark, sf).drop("excerpt"), "documents")


def candidates(spark: SparkSession, sf: str) -> DataFrame:
    """One candidate per benchmark item; its search terms are words 3-6 and 7-10 of the text."""
    tokens = tx.words(tx.identity_key(F.col("text")))
    items = table(spark, sf, "benchmark").select("item_id", tokens.alias("w"))
    regions = table(spark, sf, "region").select(
        F.col("r_regionkey").cast("bigint").alias("_r"), F.col("r_name").alias("domain")
    )
    return (
        items.withColumn("_r", F.col("item_id") % 5)
        .join(regions, "_r")
        .select(
            "item_id",
            F.concat(F.lit("cand-"), F.col("item_id")).alias("candidate_id"),
            F.array_join(F.slice("w", 3, 3), " ").alias("canonical_name"),
            F.array(
                F.array_join(F.slice("w", 3, 4), " "), F.array_join(F.slice("w", 7, 4), " ")
            ).alias("search_terms"),
            "domain",
        )
    )


def links(spark: SparkSession, sf: str, docs: DataFrame, cands: DataFrame) -> DataFrame:
    """Candidate-document links: a document is linked when it holds two adjacent words of a
    search term, and to one more candidate by its number.

    The pairs of the terms are stored, so that Spark knows their size: while they are few, the many pairs of the texts
    meet them without a shuffle."""
    pairs = docs.select(
        "document_id",
        F.explode(F.array_distinct(tx.bigrams(tx.words(F.col("excerpt_key")), " "))).alias("pair"),
    )
    term_pairs = cands.select(
        "candidate_id", F.explode("search_terms").alias("term")
    ).select("candidate_id", F.explode(tx.bigrams(F.split("term", " "), " ")).alias("pair")).distinct()
    term_pairs = stored(term_pairs, "term-pairs")
    found = pairs.join(term_pairs, "pair").select("candidate_id", "document_id")
    total = row_count(table(spark, sf, "benchmark"))
    numbered = docs.select(
        F.concat(F.lit("cand-"), (F.col("doc_id") * 7 + 3) % total).alias("candidate_id"), "document_id"
    )
    return found.unionByName(numbered).distinct()


NORM = "trim(regexp_replace(replace(lower({0}), 'ß', 'ss'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


def norm(expr: str) -> str:
    return NORM.format(expr)


DOCS_SQL = f"""
docs0 AS (
  SELECT doc_id, 'doc-' || doc_id AS document_id, split_part(text, chr(10), 1) AS title,
         text AS excerpt,
         CASE WHEN CAST(substr(source, 4) AS INT) % 2 = 0 THEN 'openalex' ELSE 'mediacloud' END AS connector,
         (['A','B','C','D','unknown'])[CAST(substr(source, 4) AS INT) % 5 + 1] AS trust_tier,
         CASE WHEN doc_id % 17 <> 0 THEN CAST(DATE '2024-09-15' + CAST(doc_id % 731 AS INT) AS DATE) END AS published_at,
         source AS publisher, lang AS language, length(text) AS excerpt_length,
         {norm("split_part(text, chr(10), 1)")} AS title_key, {norm("text")} AS excerpt_key
  FROM documents),
docs AS (
  SELECT *, 'origin-' || substr(sha256(title_key), 1, 16) AS origin_id,
         'https://news.example.org/' || language || '/' || substr(sha256(excerpt_key), 1, 16) AS url,
         CASE WHEN published_at >= DATE '2024-09-15' AND published_at < DATE '2025-09-15' THEN 'previous'
              WHEN published_at >= DATE '2025-09-15' AND published_at <= DATE '2026-09-15' THEN 'recent'
              ELSE 'unknown_date' END AS time_window,
         CASE WHEN connector = 'openalex' THEN '10.1000/' || substr(sha256(excerpt_key), 1, 16)
              ELSE 'https://news.example.org/' || language || '/' || substr(sha256(excerpt_key), 1, 16) END AS document_identity
  FROM docs0)"""

CANDS_SQL = f"""
items AS (SELECT item_id, string_split({norm("text")}, ' ') AS w FROM benchmark),
cands AS (
  SELECT item_id, 'cand-' || item_id AS candidate_id, array_to_string(w[3:5], ' ') AS canonical_name,
         [array_to_string(w[3:6], ' '), array_to_string(w[7:10], ' ')] AS search_terms, r_name AS domain
  FROM items JOIN region ON r_regionkey = item_id % 5)"""

LINKS_SQL = """
docpairs AS (
  SELECT DISTINCT document_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i+1])) AS pair
  FROM (SELECT document_id, string_split(excerpt_key, ' ') AS w FROM docs)),
terms AS (
  SELECT candidate_id, p - 1 AS term_pos, search_terms[p] AS term
  FROM (SELECT candidate_id, search_terms, unnest(range(1, len(search_terms) + 1)) AS p FROM cands)),
termpairs AS (
  SELECT DISTINCT candidate_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i+1])) AS pair
  FROM (SELECT candidate_id, string_split(term, ' ') AS w FROM terms)),
links AS (
  SELECT candidate_id, document_id FROM docpairs JOIN termpairs USING (pair)
  UNION
  SELECT 'cand-' || ((doc_id * 7 + 3) % (SELECT count(*) FROM benchmark)), document_id FROM docs)"""

SCORED_SQL = """
laddered AS (
  SELECT *, len(toks) AS n, len(list_filter(toks, lambda t: contains(' ' || title_key || ' ', ' ' || t || ' '))) AS nt,
         list_filter(toks, lambda t: contains(' ' || title_key || ' ', ' ' || t || ' ')
                                OR contains(' ' || excerpt_key || ' ', ' ' || t || ' ')) AS matched
  FROM (SELECT l.candidate_id, l.document_id, t.term, t.term_pos, d.title_key, d.excerpt_key,
               list_sort(list_distinct(string_split(t.term, ' '))) AS toks
        FROM links l JOIN terms t USING (candidate_id) JOIN docs d USING (document_id))),
termscores AS (
  SELECT candidate_id, document_id, term, term_pos, matched, toks,
         CASE WHEN contains(' ' || title_key || ' ', ' ' || term || ' ') THEN 100
              WHEN nt = n THEN 80
              WHEN contains(' ' || excerpt_key || ' ', ' ' || term || ' ') THEN 70
              WHEN len(matched) = n THEN 60
              ELSE CAST(round_even(40.0 * len(matched) / n, 0) AS INT) END AS score,
         CASE WHEN contains(' ' || title_key || ' ', ' ' || term || ' ') THEN 'exact_title_phrase'
              WHEN nt = n THEN 'all_tokens_in_title'
              WHEN contains(' ' || excerpt_key || ' ', ' ' || term || ' ') THEN 'exact_excerpt_phrase'
              WHEN len(matched) = n THEN 'all_tokens_in_combined'
              WHEN len(matched) = 0 THEN 'no_token_overlap'
              ELSE 'partial_token_overlap' END AS reason
  FROM laddered),
scored AS (
  SELECT candidate_id, document_id, term, score, reason, matched, toks,
         CASE WHEN score >= 60 THEN 'strong' WHEN score >= 20 THEN 'weak' ELSE 'none' END AS relevance_class
  FROM termscores
  QUALIFY row_number() OVER (PARTITION BY candidate_id, document_id ORDER BY score DESC, term_pos) = 1),
ranked AS (
  SELECT s.*, d.connector, d.trust_tier, d.published_at, d.publisher, d.excerpt_length, d.origin_id,
         d.url, d.time_window, d.document_identity
  FROM scored s JOIN docs d USING (document_id)),
kept AS (
  SELECT * FROM ranked
  QUALIFY row_number() OVER (PARTITION BY candidate_id, document_identity
    ORDER BY score DESC, CASE WHEN excerpt_length = 0 THEN 1 ELSE 0 END, excerpt_length DESC, document_id) = 1)"""

BASE_SQL = f"WITH {DOCS_SQL.strip()}, {CANDS_SQL.strip()}, {LINKS_SQL.strip()}, {SCORED_SQL.strip()}"
