"""Checks return the rows that break a rule; an empty result means the rule holds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenuis.operators.ranking import first_row
from tenuis.sources.quarantine import first_issue


def bad_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Blank or repeated keys."""
    blank = F.lit(False)
    for key in keys:
        blank = blank | F.col(key).isNull() | (F.trim(F.col(key).cast("string")) == "")
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).withColumn(
        "violation", F.when(blank, "blank_key").when(F.col("rows") > 1, "repeated_key")
    ).where(F.col("violation").isNotNull())


def roster_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys that only one of two tables has."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("left_only")).unionByName(
        b.join(a, key, "left_anti").withColumn("side", F.lit("right_only"))
    )


def dangling(rows: DataFrame, target: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose reference has no target."""
    return rows.join(target.select(*keys).distinct(), list(keys), "left_anti")


def differing(rows: DataFrame, target: DataFrame, keys: Sequence[str], attributes: Sequence[str]) -> DataFrame:
    """References whose copied attributes differ from the target, with the first such attribute."""
    named = target.select(*keys, *[F.col(a).alias(f"_{a}") for a in attributes])
    joined = rows.join(named, list(keys))
    first = first_issue(*[(~F.col(a).eqNullSafe(F.col(f"_{a}")), a) for a in attributes])
    return joined.withColumn("attribute", first).where(F.col("attribute").isNotNull()).select(*keys, "attribute")


def later_wins(earlier: DataFrame, later: DataFrame, key: str) -> DataFrame:
    return later.unionByName(earlier.join(later.select(key), key, "left_anti"))


def input_columns(df: DataFrame, required: Sequence[str], forbidden: Sequence[str]) -> list[str]:
    """Missing required and present forbidden columns: labels must never reach the model input."""
    return [f"missing:{c}" for c in required if c not in df.columns] + [f"forbidden:{c}" for c in forbidden if c in df.columns]


def incomplete_coverage(candidates: DataFrame, coverage: DataFrame, classes: Sequence[str]) -> DataFrame:
    """Candidates without complete coverage in every source class."""
    done = coverage.where((F.col("status") == "complete") & F.col("source_class").isin(*classes)).groupBy("candidate_id").agg(
        F.countDistinct("source_class").alias("complete_classes")
    )
    rows = candidates.select("candidate_id").join(done, "candidate_id", "left").na.fill(0)
    return rows.where(F.col("complete_classes") < len(classes))


def coverage_mismatch(coverage: DataFrame, documents: DataFrame, count: str) -> DataFrame:
    """Candidates whose stated document count differs from their documents."""
    actual = documents.groupBy("candidate_id").agg(F.count(F.lit(1)).alias("actual"))
    rows = coverage.select("candidate_id", F.col(count).alias("stated")).join(actual, "candidate_id", "left").na.fill(0, ["actual"])
    return rows.where(F.col("stated") != F.col("actual"))


def assessment_violations(results: DataFrame) -> DataFrame:
    """Cards that contradict their own status."""
    main = F.col("status") == "main"
    return results.withColumn(
        "violation",
        first_issue(
            (~F.col("status").isin("main", "watchlist", "excluded"), "unknown_status"),
            (main & (F.col("independent_origins") < 2), "main_without_origins"),
            (main & (F.col("independent_actors") < 2), "main_without_actors"),
            (main & ~F.col("grounded_ab_support"), "main_without_trusted_support"),
            (main & (F.col("score").isNull() | (F.col("score") < F.col("threshold"))), "main_below_threshold"),
            (F.col("score").isNotNull() & ~F.col("score").between(0, 1), "score_out_of_range"),
        ),
    ).where(F.col("violation").isNotNull()).select("candidate_id", "violation")


def schema_violations(df: DataFrame, text: Sequence[str], enums: dict[str, Sequence[str]], ratios: Sequence[str]) -> DataFrame:
    """Blank text, values outside an enumeration, ratios outside 0..1 or not finite."""
    checks: list[tuple[Column, str]] = [(F.coalesce(F.trim(c), F.lit("")) == "", f"blank:{c}") for c in text]
    checks += [(~F.coalesce(F.col(c).isin(*v), F.lit(False)), f"enum:{c}") for c, v in enums.items()]
    checks += [(F.isnan(c) | ~F.col(c).between(0, 1), f"ratio:{c}") for c in ratios]
    return df.withColumn("violation", first_issue(*checks)).where(F.col("violation").isNotNull())


def flatten_runs(runs: DataFrame, sections: Sequence[str], key: str) -> DataFrame:
    """Documents of nested runs: sections in order, first copy of an id wins."""
    parts = None
    for rank, section in enumerate(sections):
        rows = runs.select("run_id", F.lit(rank).alias("_rank"), F.posexplode(section).alias("_pos", "_d")).select("run_id", "_rank", "_pos", "_d.*")
        parts = rows if parts is None else parts.unionByName(rows)
    return first_row(parts, [key], [F.col("_rank").asc(), F.col("run_id").asc(), F.col("_pos").asc()]).withColumn(
        "section", F.element_at(F.array(*[F.lit(s) for s in sections]), F.col("_rank") + 1)
    ).drop("_rank", "_pos")
