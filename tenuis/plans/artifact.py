"""Model tables spoilt by number, checked by themselves and against the feature table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenuis.operators import artifact as art
from tenuis.operators.features import NUMERIC, STRUCTURED
from tenuis.plans import features as pf
from tenuis.plans import tables as t


def model_rows(spark: SparkSession, sf: str) -> DataFrame:
    """A feature per part: an intercept, then text, numeric and domain features in turn, some spoilt by number."""
    p = F.col("p_partkey")
    grp = F.when(p == 1, "intercept").when(p % 101 == 0, "image").otherwise(t.pick(["text", "numeric", "domain"], p % 3))
    nan = F.lit(float("nan"))
    return t.table(spark, sf, "part").select(
        grp.alias("grp"), F.when(p % 67 == 0, " ").otherwise(F.concat("p_name", F.lit(" "), F.floor(p / F.when(p % 59 < 2, 6).otherwise(1)))).alias("name"), (p - F.when(p % 97 == 0, 2).otherwise(1)).cast("int").alias("idx"),
        F.when(p % 61 != 0, F.lit(1.5)).alias("idf"), F.when(p % 71 == 0, nan).otherwise(0.5).alias("mean"), F.when(p % 73 == 0, 0.0).when(p % 79 == 0, F.lit(None)).otherwise(2.0).alias("scale"),
        F.when(p % 83 == 0, nan).when(p % 89 == 0, float("inf")).otherwise(p / 10).alias("coefficient"),
    )


def broken_model_features(spark: SparkSession, sf: str) -> DataFrame:
    return art.broken_features(model_rows(spark, sf))


def model_compatibility(spark: SparkSession, sf: str) -> DataFrame:
    """A model of the last version without one boolean and with one foreign number, that knows two domains, against the feature table of the parts."""
    names = [("structured", n) for n in STRUCTURED[1:]] + [("numeric", n) for n in NUMERIC] + [("numeric", "age"), ("domain", "ASIA"), ("domain", "EUROPE"), ("text", "pump")]
    features = spark.createDataFrame([(g, n, i, 1.0, 0.0, 1.0, 0.1) for i, (g, n) in enumerate(names, 1)], art.COLUMNS)
    header = spark.createDataFrame([(art.SCHEMA_VERSION, "feature-table-v0", 1.5, STRUCTURED, NUMERIC)], "schema_version string, feature_version string, threshold double, structured array<string>, numeric array<string>")
    return art.incompatible(features, header, pf.table(spark, sf))


QUERIES = {"broken_model_features": broken_model_features, "model_compatibility": model_compatibility}

ORACLES = {
    "broken_model_features": """WITH f AS (SELECT p_partkey AS p, CASE WHEN p_partkey = 1 THEN 'intercept' WHEN p_partkey % 101 = 0 THEN 'image' ELSE (['text','numeric','domain'])[p_partkey % 3 + 1] END AS grp,
 CASE WHEN p_partkey % 67 = 0 THEN ' ' ELSE p_name || ' ' || CAST(floor(p_partkey / CASE WHEN p_partkey % 59 < 2 THEN 6 ELSE 1 END) AS BIGINT) END AS name, p_partkey - CASE WHEN p_partkey % 97 = 0 THEN 2 ELSE 1 END AS idx FROM part),
w AS (SELECT count(*) AS n, count(DISTINCT idx) AS places, min(idx) AS a, max(idx) AS b FROM f)
SELECT grp, name, violation FROM (SELECT *, CASE WHEN grp = 'image' THEN 'unknown_group' WHEN p % 67 = 0 THEN 'blank_name' WHEN p % 83 = 0 OR p % 89 = 0 THEN 'coefficient_not_finite' WHEN grp = 'text' AND p % 61 = 0 THEN 'idf_not_finite'
 WHEN grp = 'numeric' AND (p % 71 = 0 OR (p % 79 = 0 AND p % 73 <> 0)) THEN 'scaling_not_finite' WHEN grp = 'numeric' AND p % 73 = 0 THEN 'scale_not_positive' WHEN (grp = 'intercept') <> (idx = 0) THEN 'intercept_misplaced' END AS violation FROM f) WHERE violation IS NOT NULL
UNION ALL SELECT grp, name, 'repeated_feature' FROM f GROUP BY 1, 2 HAVING count(*) > 1
UNION ALL SELECT NULL, NULL, 'places_broken' FROM w WHERE n <> places OR a <> 0 OR b <> n - 1""",
    "model_compatibility": f"""SELECT CAST(NULL AS VARCHAR) AS grp, CAST(NULL AS VARCHAR) AS name, unnest(['feature_version_differs', 'threshold_outside']) AS violation
UNION ALL SELECT 'structured', '{STRUCTURED[0]}', 'feature_missing' UNION ALL SELECT 'numeric', 'age', 'feature_unknown'
UNION ALL SELECT DISTINCT 'domain', r_name, 'unknown_domain' FROM part JOIN region ON r_regionkey = p_partkey % 5 WHERE r_name NOT IN ('ASIA', 'EUROPE')""",
}
