"""Write-once bundles of tables with a digest manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

POSITIVE_SCHEMA = "number INT, name STRING, domain STRING, score INT, rationale STRING, _bad STRING"


def file_digests(spark: SparkSession, folder: str) -> DataFrame:
    """Size and SHA-256 of every data file of a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.where(~F.col("path").rlike(r"/[_.][^/]*$|/manifest/")).select(
        F.regexp_extract("path", r"/([^/]+/[^/]+)$", 1).alias("file"), F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256")
    )


def write_bundle(tables: dict[str, DataFrame], folder: str, version: str) -> None:
    """All tables, then the manifest. An existing target is refused, and a bundle without a
    manifest is not a bundle, so a job that dies half way leaves nothing readable."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode("errorifexists").json(f"{folder}/{name}")
    digests = file_digests(spark, folder).withColumn("schema_version", F.lit(version))
    digests.write.mode("errorifexists").json(f"{folder}/manifest")


def broken_files(spark: SparkSession, folder: str, version: str) -> DataFrame:
    """Files that are missing, unlisted, changed or of another version."""
    listed = spark.read.schema("file STRING, size_bytes BIGINT, sha256 STRING, schema_version STRING").json(f"{folder}/manifest")
    actual = file_digests(spark, folder).select("file", F.col("size_bytes").alias("size"), F.col("sha256").alias("digest"))
    rows = listed.join(actual, "file", "full")
    violation = (
        F.when(F.col("digest").isNull(), "missing").when(F.col("sha256").isNull(), "unlisted")
        .when((F.col("digest") != F.col("sha256")) | (F.col("size") != F.col("size_bytes")), "changed")
        .when(F.col("schema_version") != version, "version_differs")
    )
    return rows.select("file", violation.alias("violation")).where(F.col("violation").isNotNull())


def read_table(spark: SparkSession, folder: str, name: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, bad lines) of one bundle table under a fixed schema."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    lines = spark.read.text(f"{folder}/{name}").where(F.trim("value") != "")
    rows = lines.select("value", F.from_json("value", f"{schema}, _bad STRING", options).alias("r"))
    bad = F.col("r").isNull() | F.col("r._bad").isNotNull()
    return rows.where(~bad).select("r.*").drop("_bad"), rows.where(bad).select("value")


def json_lines(df: DataFrame, order: list[str]) -> DataFrame:
    """Canonical text lines: columns by name, rows by key. For sinks only."""
    line = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
    return df.orderBy(*order).select(line.alias("value"))


def content_digest(df: DataFrame) -> DataFrame:
    """Digest of a table that depends neither on row order nor on partitioning: row digests are
    added up, so nothing is gathered."""
    row: Column = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    part = F.conv(F.substring(row, 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sum(part).cast("string").alias("total")).select(
        "rows", F.sha2(F.concat_ws("|", "rows", "total"), 256).alias("digest")
    )


def read_positives(spark: SparkSession, path: str, domains: list[str]) -> tuple[DataFrame, DataFrame]:
    """(model rows, violations) of the labelled positives: numbers in sequence from one, names
    given, domains known, scores three to seven. The rationale stays out of the model rows."""
    rows = spark.read.schema(POSITIVE_SCHEMA).option("header", "true").option("columnNameOfCorruptRecord", "_bad").csv(path)
    seen = rows.groupBy(F.col("number").alias("_number")).agg(F.count(F.lit(1)).alias("_n"))
    total = rows.agg(F.count(F.lit(1))).scalar()
    checked = rows.join(seen, F.col("number").eqNullSafe(F.col("_number"))).withColumn(
        "violation",
        F.when(F.col("_bad").isNotNull(), "bad_line")
        .when(F.col("number").isNull() | ~F.col("number").between(1, total) | (F.col("_n") > 1), "bad_number")
        .when(F.coalesce(F.trim("name"), F.lit("")) == "", "blank_name")
        .when(~F.coalesce(F.col("domain").isin(domains), F.lit(False)), "unknown_domain")
        .when(~F.coalesce(F.col("score").between(3, 7), F.lit(False)), "bad_score"),
    )
    good = checked.where(F.col("violation").isNull()).select(
        F.format_string("organizer-%03d", "number").alias("record_id"), F.trim("name").alias("canonical_name"), "domain"
    )
    return good, checked.where(F.col("violation").isNotNull()).select("number", "violation")


def positive_annotations(spark: SparkSession, path: str) -> DataFrame:
    """Expert fields of the positives, kept apart from the model rows."""
    rows = spark.read.schema(POSITIVE_SCHEMA).option("header", "true").csv(path)
    return rows.select(F.format_string("organizer-%03d", "number").alias("record_id"), "score", "rationale")
