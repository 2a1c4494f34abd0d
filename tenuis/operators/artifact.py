"""The fitted model as a stored, versioned table, and its check against a feature table before it scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenuis.operators import model as ml
from tenuis.operators.features import NUMERIC, STRUCTURED
from tenuis.sources.quarantine import first_issue

SCHEMA_VERSION = "model-table-v1"
FEATURE_VERSION = "feature-table-v1"
GROUPS = ["intercept", "text", "structured", "numeric", "domain"]
COLUMNS = "grp string, name string, idx int, idf double, mean double, scale double, coefficient double"


def save_model(model: DataFrame, path: str, threshold: float = ml.THRESHOLD) -> None:
    """One model of a coefficient table with its versions; an existing target is refused. The header is written last: a
    job that dies half way leaves no model."""
    names = [field.split()[0] for field in COLUMNS.split(", ")]
    model.select(*names).write.mode("errorifexists").parquet(f"{path}/features")
    header = [(SCHEMA_VERSION, FEATURE_VERSION, threshold, *map(list, (STRUCTURED, NUMERIC)))]
    kind = "schema_version string, feature_version string, threshold double, structured array<string>, numeric array<string>"
    model.sparkSession.createDataFrame(header, kind).write.mode("errorifexists").parquet(f"{path}/header")


def load_model(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(features, header) of a stored model."""
    return spark.read.schema(COLUMNS).parquet(f"{path}/features"), spark.read.parquet(f"{path}/header")


def broken_features(features: DataFrame) -> DataFrame:
    """grp, name, violation of model features that can't be right by themselves, and of the table as a whole (null name).

    Features are distinct by (group, name) and by place; places are 0..N without gaps, 0 is the only intercept; numbers that
    a group uses are finite and scales positive; there is text."""
    finite = lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))
    grp = F.col("grp")
    own = first_issue(
        (~F.coalesce(grp.isin(GROUPS), F.lit(False)), "unknown_group"), (F.coalesce(F.trim("name"), F.lit("")) == "", "blank_name"), (~finite("coefficient"), "coefficient_not_finite"),
        ((grp == "text") & ~finite("idf"), "idf_not_finite"), ((grp == "numeric") & ~(finite("mean") & finite("scale")), "scaling_not_finite"), ((grp == "numeric") & (F.col("scale") <= 0), "scale_not_positive"),
        ((grp == "intercept") != (F.col("idx") == 0), "intercept_misplaced"),
    )
    rows = features.withColumn("violation", own).where(F.col("violation").isNotNull()).select("grp", "name", "violation")
    repeated = features.groupBy("grp", "name").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select("grp", "name", F.lit("repeated_feature").alias("violation"))
    whole = features.agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("idx").alias("places"), F.min("idx").alias("first"), F.max("idx").alias("last"), F.count_if(grp == "intercept").alias("intercepts"), F.count_if(grp == "text").alias("texts")
    )
    gaps = (F.col("n") != F.col("places")) | (F.coalesce("first", F.lit(-1)) != 0) | (F.coalesce("last", F.lit(-1)) != F.col("n") - 1)
    found = F.array_compact(F.array(F.when(gaps, "places_broken"), F.when(F.col("intercepts") != 1, "not_one_intercept"), F.when(F.col("texts") == 0, "no_text")))
    none = F.lit(None).cast("string")
    return rows.unionByName(repeated).unionByName(whole.select(none.alias("grp"), none.alias("name"), F.explode(found).alias("violation")))


def incompatible(features: DataFrame, header: DataFrame, table: DataFrame) -> DataFrame:
    """grp, name, violation: where a model and a feature table don't fit each other.

    Versions and threshold of the header; structured and numeric features against the agreed lists and the columns of the
    table with their types; domains of the table that the model has never seen."""
    spark = table.sparkSession
    spoilt = header.select(
        F.explode(F.array_compact(F.array(
            F.when(~F.col("schema_version").eqNullSafe(SCHEMA_VERSION), "schema_version_differs"), F.when(~F.col("feature_version").eqNullSafe(FEATURE_VERSION), "feature_version_differs"),
            F.when(~F.coalesce(F.col("threshold").between(0, 1), F.lit(False)), "threshold_outside"), F.when(~F.col("structured").eqNullSafe(F.array(*[F.lit(n) for n in STRUCTURED])), "structured_list_differs"),
            F.when(~F.col("numeric").eqNullSafe(F.array(*[F.lit(n) for n in NUMERIC])), "numeric_list_differs"),
        ))).alias("violation")
    )
    none = F.lit(None).cast("string")
    types = {field.name: field.dataType for field in table.schema}
    columns = [("structured", n, T.BooleanType) for n in STRUCTURED] + [("numeric", n, T.NumericType) for n in NUMERIC]
    wanted = spark.createDataFrame(
        [(grp, name, "column_missing" if name not in types else "column_type_differs" if not isinstance(types[name], kind) else None) for grp, name, kind in columns], "grp string, name string, column_violation string"
    )
    fixed = features.where(F.col("grp").isin("structured", "numeric")).select("grp", "name", F.lit(True).alias("there")).distinct()
    lists = wanted.join(fixed, ["grp", "name"], "full").select(
        "grp", "name", F.when(F.col("there").isNull(), "feature_missing").when(~F.exists(F.array(*[F.lit(n) for _, n, _ in columns]), lambda n: n == F.col("name")), "feature_unknown").otherwise(F.col("column_violation")).alias("violation")
    ).where(F.col("violation").isNotNull())
    known = features.where(F.col("grp") == "domain").select("name")
    domains = table.select(F.col("domain").alias("name")).distinct().join(known, "name", "left_anti") if "domain" in types else spark.createDataFrame([("domain",)], "name string")
    code = "unknown_domain" if "domain" in types else "column_missing"
    return spoilt.select(none.alias("grp"), none.alias("name"), "violation").unionByName(lists).unionByName(domains.select(F.lit("domain").alias("grp"), "name", F.lit(code).alias("violation")))


def checked_model(spark: SparkSession, path: str, table: DataFrame) -> DataFrame:
    """The coefficient table of a stored model, for `model.score` with the model name 'stored'. A model that is broken or
    does not fit the table is refused, with the first violations named."""
    features, header = load_model(spark, path)
    wrong = broken_features(features).unionByName(incompatible(features, header, table)).orderBy("violation", "grp", "name").limit(5).collect()
    if wrong:
        raise ValueError("the model does not fit: " + ", ".join(f"{r['violation']} {r['grp'] or ''} {r['name'] or ''}".strip() for r in wrong))
    return features.withColumn("model", F.lit("stored"))
