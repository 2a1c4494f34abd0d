"""Feature table of parts as candidates, orders as documents, suppliers as organizations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenuis.functions import text as tx
from tenuis.functions.ids import digest_id
from tenuis.operators import features as feat
from tenuis.plans import tables as t


def candidates(spark: SparkSession, sf: str) -> DataFrame:
    regions = t.table(spark, sf, "region").select(F.col("r_regionkey").cast("bigint").alias("_r"), F.col("r_name").alias("domain"))
    negative = F.when(F.col("p_size") > 25, F.when(F.col("p_size") % 2 == 0, "mature").otherwise("marketing_hype"))
    return t.table(spark, sf, "part").withColumn("_r", F.col("p_partkey") % 5).join(regions, "_r").select(
        F.concat(F.lit("part-"), "p_partkey").alias("candidate_id"),
        F.concat_ws(" ", "p_name", "p_brand").alias("canonical_name"),
        F.array(F.concat_ws(" ", "p_name", "p_brand"), F.col("p_name")).alias("search_terms"),
        "domain", F.col("p_type").alias("scope_key"),
        F.when(negative.isNull(), 1).otherwise(0).alias("target"), negative.alias("negative_class"),
        tx.identity_key(F.concat_ws(" ", "p_name", "p_brand", "p_size")).alias("form"),
    )


def documents(spark: SparkSession, sf: str) -> DataFrame:
    items = t.spread(t.table(spark, sf, "lineitem"), "l_orderkey")
    orders = t.table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    suppliers = t.table(spark, sf, "supplier").select("s_suppkey", "s_name")
    return items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(
        suppliers, F.col("l_suppkey") == F.col("s_suppkey")
    ).select(
        F.concat(F.lit("part-"), "l_partkey").alias("candidate_id"),
        F.concat(F.lit("order-"), "l_orderkey").alias("document_id"),
        t.pick(["openalex", "mediacloud", "exa"], F.ascii("l_returnflag") % 3).alias("connector"),
        F.when(F.col("l_linenumber") != 7, F.col("l_shipdate").cast("date")).alias("published_at"),
        t.pick(["A", "B", "C", "D", "unknown"], F.col("l_suppkey") % 5).alias("trust_tier"),
        F.concat(F.lit("cust-"), "o_custkey").alias("origin_id"),
        F.array("s_name").alias("organizations"),
        F.concat_ws("-", "l_returnflag", "l_linestatus").alias("source_type"),
    )


def requests(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Every line is a planned request; lines with a discount under 0.09 were tried, and those
    of an even quantity or an open line succeeded."""
    rows = t.table(spark, sf, "lineitem").select(
        F.concat(F.lit("part-"), "l_partkey").alias("candidate_id"),
        F.when(F.col("l_returnflag") == "A", "scientific").otherwise("industry").alias("source_class"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int"), F.round(F.col("l_extendedprice") * 100).cast("bigint")).alias("request_id"),
        F.col("l_discount"), F.col("l_quantity").cast("bigint").alias("records"), "l_linestatus",
    ).dropDuplicates(["request_id"])
    ok = (F.col("records") % 2 == 0) | (F.col("l_linestatus") == "O")
    results = rows.where(F.col("l_discount") < 0.09).select("request_id", F.when(ok, "success").otherwise("failed").alias("status"), "records")
    return rows.select("candidate_id", "source_class", "request_id"), results


def request_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return feat.request_coverage(*requests(spark, sf))


def filled_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return feat.filled_coverage(candidates(spark, sf), request_coverage(spark, sf))


def presence_features(spark: SparkSession, sf: str) -> DataFrame:
    return feat.presence_features(feat.inside_windows(documents(spark, sf), t.ITEM_WINDOWS), t.ITEM_WINDOWS)


def outside_windows(spark: SparkSession, sf: str) -> DataFrame:
    return feat.outside_windows(documents(spark, sf), t.ITEM_WINDOWS).groupBy("candidate_id").agg(F.count(F.lit(1)).alias("rejected"))


def counts(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct orders per part and per part type in each window."""
    docs = documents(spark, sf).withColumn("window", t.ITEM_WINDOWS.of(F.col("published_at"))).where(F.col("window") != "unknown_date")
    own = docs.groupBy(F.col("candidate_id").alias("entity_id"), "window").agg(F.countDistinct("document_id").alias("count"))
    scope = docs.join(candidates(spark, sf).select("candidate_id", "scope_key"), "candidate_id").groupBy(
        F.col("scope_key").alias("entity_id"), "window"
    ).agg(F.countDistinct("document_id").alias("count"))
    return own.withColumn("entity_type", F.lit("candidate")).unionByName(scope.withColumn("entity_type", F.lit("scope")))


def temporal_features(spark: SparkSession, sf: str) -> DataFrame:
    rows = feat.temporal_features(candidates(spark, sf), counts(spark, sf))
    return rounded(rows, feat.NUMERIC)


def rounded(df: DataFrame, names) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def count_tasks(spark: SparkSession, sf: str) -> DataFrame:
    return feat.count_tasks(candidates(spark, sf), t.ITEM_WINDOWS)


def search_tasks(spark: SparkSession, sf: str) -> DataFrame:
    return feat.search_tasks(candidates(spark, sf), t.ITEM_WINDOWS)


def timeline_share(spark: SparkSession, sf: str) -> DataFrame:
    points = t.table(spark, sf, "events").select(
        F.col("ts").cast("date").alias("day"),
        (F.col("event_type") == "view").cast("int").alias("matched"), F.lit(1).alias("monitored"),
    )
    return rounded(feat.timeline_share(points, ["day"]), ["share"])


def groups(spark: SparkSession, sf: str) -> DataFrame:
    return candidates(spark, sf).select("candidate_id", digest_id("cross-corpus-", F.col("form")).alias("group_id"))


def table(spark: SparkSession, sf: str) -> DataFrame:
    cands = candidates(spark, sf)
    return feat.feature_table(
        cands.drop("search_terms", "form"), filled_coverage(spark, sf), presence_features(spark, sf),
        feat.temporal_features(cands, counts(spark, sf)), groups(spark, sf),
    )


def feature_table(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(table(spark, sf), feat.NUMERIC)


def feature_counts(spark: SparkSession, sf: str) -> DataFrame:
    return feat.table_counts(table(spark, sf))


QUERIES = {
    "request_coverage": request_coverage,
    "filled_coverage": filled_coverage,
    "presence_features": presence_features,
    "outside_windows": outside_windows,
    "temporal_features": temporal_features,
    "count_tasks": count_tasks,
    "search_tasks": search_tasks,
    "timeline_share": timeline_share,
    "feature_table": feature_table,
    "feature_counts": feature_counts,
}

_W = "CASE WHEN published_at >= DATE '1999-11-05' AND published_at < DATE '2000-11-04' THEN 'previous' WHEN published_at >= DATE '2000-11-04' AND published_at <= DATE '2001-11-04' THEN 'recent' ELSE 'unknown_date' END"

FEATURES_SQL = f"""WITH cand AS (
  SELECT 'part-' || p_partkey AS candidate_id, p_name || ' ' || p_brand AS canonical_name, p_name, r_name AS domain, p_type AS scope_key,
    CASE WHEN p_size > 25 THEN 0 ELSE 1 END AS target,
    CASE WHEN p_size > 25 THEN CASE WHEN p_size % 2 = 0 THEN 'mature' ELSE 'marketing_hype' END END AS negative_class,
    'cross-corpus-' || substr(sha256({t.norm("p_name || ' ' || p_brand || ' ' || p_size")}), 1, 16) AS group_id
  FROM part JOIN region ON r_regionkey = p_partkey % 5),
fdocs AS (
  SELECT *, {_W} AS win, CASE WHEN connector = 'openalex' THEN 'scientific' ELSE 'industry' END AS cls FROM (
  SELECT 'part-' || l_partkey AS candidate_id, 'order-' || l_orderkey AS document_id,
    (['openalex','mediacloud','exa'])[ascii(l_returnflag) % 3 + 1] AS connector,
    CASE WHEN l_linenumber <> 7 THEN CAST(l_shipdate AS DATE) END AS published_at,
    (['A','B','C','D','unknown'])[l_suppkey % 5 + 1] AS trust_tier, 'cust-' || o_custkey AS origin_id, s_name AS org,
    l_returnflag || '-' || l_linestatus AS source_type
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey)),
reqs AS (
  SELECT DISTINCT ON (request_id) * FROM (SELECT 'part-' || l_partkey AS candidate_id, CASE WHEN l_returnflag = 'A' THEN 'scientific' ELSE 'industry' END AS source_class,
   concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS INT), CAST(round(l_extendedprice * 100) AS BIGINT)) AS request_id,
   CASE WHEN l_discount < 0.09 THEN CASE WHEN CAST(l_quantity AS BIGINT) % 2 = 0 OR l_linestatus = 'O' THEN 'success' ELSE 'failed' END END AS status,
   CAST(l_quantity AS BIGINT) AS records FROM lineitem)),
cov AS (SELECT candidate_id, source_class, count(*) AS planned_requests, count(*) FILTER (status = 'success') AS successful_requests,
   count(*) FILTER (status = 'failed') AS failed_requests, count(*) FILTER (status IS NULL) AS missing_requests,
   CAST(coalesce(sum(records) FILTER (status = 'success'), 0) AS BIGINT) AS returned_records FROM reqs GROUP BY ALL),
cov2 AS (SELECT *, CASE WHEN successful_requests = planned_requests THEN 'complete' WHEN successful_requests > 0 THEN 'partial' ELSE 'unknown' END AS status FROM cov),
fill AS (SELECT candidate_id, source_class, coalesce(status, 'unknown') AS status FROM (SELECT candidate_id, unnest(['scientific', 'industry']) AS source_class FROM cand) LEFT JOIN cov2 USING (candidate_id, source_class)),
inw AS (SELECT * FROM fdocs WHERE published_at IS NULL OR published_at BETWEEN DATE '1999-11-05' AND DATE '2001-11-04'),
pres AS (SELECT candidate_id,
   bool_or(cls = 'scientific' AND win = 'previous') AS scientific_previous_present, bool_or(cls = 'scientific' AND win = 'recent') AS scientific_recent_present,
   bool_or(cls = 'industry' AND win = 'previous') AS industry_previous_present, bool_or(cls = 'industry' AND win = 'recent') AS industry_recent_present,
   bool_or(published_at IS NULL) AS unknown_date_present, bool_or(trust_tier IN ('A', 'B')) AS trust_ab_present,
   count(DISTINCT origin_id) >= 2 AS multiple_origins_present, count(DISTINCT lower(org)) >= 2 AS multiple_organizations_present,
   count(DISTINCT source_type) >= 2 AS multiple_source_types_present FROM inw GROUP BY 1),
own AS (SELECT candidate_id, nullif(count(DISTINCT document_id) FILTER (win = 'previous'), 0) AS candidate_previous,
   nullif(count(DISTINCT document_id) FILTER (win = 'recent'), 0) AS candidate_recent FROM fdocs GROUP BY 1),
sco AS (SELECT scope_key, nullif(count(DISTINCT document_id) FILTER (win = 'previous'), 0) AS scope_previous,
   nullif(count(DISTINCT document_id) FILTER (win = 'recent'), 0) AS scope_recent FROM fdocs JOIN cand USING (candidate_id) GROUP BY 1),
tmp0 AS (SELECT candidate_id, scope_key, candidate_previous, candidate_recent, scope_previous, scope_recent,
   candidate_previous IS NOT NULL AND candidate_recent IS NOT NULL AND scope_previous IS NOT NULL AND scope_recent IS NOT NULL AS k
   FROM cand LEFT JOIN own USING (candidate_id) LEFT JOIN sco USING (scope_key)),
tmp AS (SELECT candidate_id, scope_key, candidate_previous, candidate_recent, scope_previous, scope_recent, k AS temporal_count_coverage_complete,
   CASE WHEN k THEN round(ln(1 + candidate_previous), 6) END AS scientific_previous_count_log1p, CASE WHEN k THEN round(ln(1 + candidate_recent), 6) END AS scientific_recent_count_log1p,
   CASE WHEN k THEN round(ln(1 + candidate_recent) - ln(1 + candidate_previous), 6) END AS scientific_count_log_growth,
   CASE WHEN k THEN round(candidate_previous / scope_previous, 6) END AS scientific_scope_share_previous, CASE WHEN k THEN round(candidate_recent / scope_recent, 6) END AS scientific_scope_share_recent,
   CASE WHEN k THEN round(candidate_recent / scope_recent - candidate_previous / scope_previous, 6) END AS scientific_scope_share_delta FROM tmp0),
cf AS (SELECT candidate_id, bool_or(status = 'complete' AND source_class = 'scientific') AS scientific_coverage_complete,
   bool_or(status = 'complete' AND source_class = 'industry') AS industry_coverage_complete FROM fill GROUP BY 1),
feat AS (SELECT candidate_id, canonical_name, domain, c.scope_key, target, negative_class, group_id, {', '.join(f'coalesce({n}, false) AS {n}' for n in feat.STRUCTURED)}, {', '.join(feat.NUMERIC)}
   FROM cand c LEFT JOIN cf USING (candidate_id) LEFT JOIN pres USING (candidate_id) LEFT JOIN tmp USING (candidate_id))
"""

ORACLES = {
    "request_coverage": FEATURES_SQL + "SELECT * FROM cov2",
    "filled_coverage": FEATURES_SQL + "SELECT * FROM fill",
    "presence_features": FEATURES_SQL + "SELECT * FROM pres",
    "outside_windows": FEATURES_SQL + "SELECT candidate_id, count(*) AS rejected FROM fdocs WHERE published_at NOT BETWEEN DATE '1999-11-05' AND DATE '2001-11-04' GROUP BY 1",
    "temporal_features": FEATURES_SQL + "SELECT * FROM tmp",
    "count_tasks": FEATURES_SQL + """, e AS (SELECT 'candidate' AS entity_type, candidate_id AS entity_id, canonical_name AS search_text FROM cand UNION SELECT 'scope', scope_key, scope_key FROM cand),
w AS (SELECT * FROM (VALUES ('previous', DATE '1999-11-05', DATE '2000-11-03'), ('recent', DATE '2000-11-04', DATE '2001-11-04')) v("window", published_from, published_until))
SELECT entity_type, entity_id, search_text, "window", published_from, published_until,
 'count-' || substr(sha256(concat_ws('|', entity_type, entity_id, search_text, "window", published_from, published_until)), 1, 20) AS count_id FROM e CROSS JOIN w""",
    "search_tasks": FEATURES_SQL + """, s AS (SELECT candidate_id, 0 AS term_pos, canonical_name AS search_text FROM cand UNION ALL SELECT candidate_id, 1, p_name FROM cand),
g AS (SELECT * FROM (VALUES ('scientific', 'openalex', 'en'), ('scientific', 'openalex', 'ru'), ('industry', 'mediacloud', 'en,ru')) v(source_class, connector, languages))
SELECT candidate_id, term_pos, search_text, source_class, connector, languages, DATE '1999-11-05' AS published_from, DATE '2001-11-04' AS published_until,
 'request-' || substr(sha256(concat_ws('|', candidate_id, connector, search_text, languages, '1999-11-05', '2001-11-04')), 1, 16) AS request_id FROM s CROSS JOIN g""",
    "timeline_share": "SELECT CAST(ts AS DATE) AS day, count(*) FILTER (event_type = 'view') AS matched, count(*) AS monitored, round(count(*) FILTER (event_type = 'view') / count(*), 6) AS share FROM events GROUP BY 1",
    "feature_table": FEATURES_SQL + "SELECT * FROM feat",
    "feature_counts": FEATURES_SQL + """SELECT count(*) FILTER (target = 1) AS positives, count(*) FILTER (negative_class = 'mature') AS mature, count(*) FILTER (negative_class = 'marketing_hype') AS marketing_hype,
 count(DISTINCT group_id) AS groups, count(*) FILTER (temporal_count_coverage_complete) AS temporal_complete,
 greatest(50 - mature, 0) AS mature_deficit, greatest(mature - 50, 0) AS mature_surplus, greatest(50 - marketing_hype, 0) AS marketing_hype_deficit, greatest(marketing_hype - 50, 0) AS marketing_hype_surplus,
 mature = 50 AND marketing_hype = 50 AS qualified FROM feat""",
}
