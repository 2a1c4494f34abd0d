"""From mentions to proposals, gate batch, aliases, origins and identity groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenuis.functions import text as tx
from tenuis.operators import entities as ent
from tenuis.operators import graph, identity
from tenuis.operators.ranking import ranked_head
from tenuis.plans import tables as t
from tenuis.session import stored

SCOPE = "scope-parts"
SCOPE_TERMS = ["red widget mk1 1"]


def found_mentions(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as mentions of a part name in an order, in four spellings; a mention may be found twice.

    Orders and parts grow with the line items, and their files are far smaller than their rows in memory: they are hashed
    by partition, not broadcast by the size of their files.
    """
    items = t.spread(t.table(spark, sf, "lineitem"), "l_orderkey")
    parts = t.table(spark, sf, "part").select("p_partkey", "p_name", "p_brand").hint("shuffle_hash")
    orders = t.table(spark, sf, "orders").select("o_orderkey", "o_custkey").hint("shuffle_hash")
    tail = F.concat(F.replace("p_brand", F.lit("Brand#"), F.lit("mk")), F.lit(" "), F.col("l_quantity").cast("int"))
    variant = F.col("p_partkey") % 4
    spelled = (
        F.when(variant == 1, F.replace("p_name", F.lit(" "), F.lit("-")))
        .when(variant == 2, F.upper("p_name"))
        .when(variant == 3, F.concat("p_name", F.lit("s")))
        .otherwise(F.col("p_name"))
    )
    rows = (
        items.join(orders, items["l_orderkey"] == orders["o_orderkey"])
        .join(parts, items["l_partkey"] == parts["p_partkey"])
        .select(
            F.concat(F.lit("order-"), "l_orderkey").alias("document_id"),
            F.concat(F.lit("cust-"), "o_custkey").alias("origin_id"),
            t.pick(["openalex", "mediacloud", "exa"], F.ascii("l_returnflag") % 3).alias("connector"),
            F.when(F.col("l_linestatus") == "F", "title").otherwise("excerpt").alias("kind"),
            F.concat_ws(":", "l_linenumber", "l_partkey", "l_suppkey", F.unix_date(F.col("l_shipdate").cast("date"))).alias("locator"),
            F.concat(spelled, F.lit(" "), tail).alias("text"),
            F.when(F.col("l_linenumber") != 1, F.round(F.col("l_discount") * 10, 2)).alias("provider_score"),
            (F.col("l_linenumber") == 2).alias("primary_topic"),
            F.col("p_name"),
        )
        .where(F.col("document_id").isNotNull())  # no row goes; later joins infer it, and their branches share one shuffle
    )
    return rows.withColumn("key", tx.orthographic_key(F.col("text")))


def mentions(spark: SparkSession, sf: str) -> DataFrame:
    keyed = found_mentions(spark, sf).withColumn("name_key", tx.name_key(F.col("text")))
    return ent.unique_mentions(
        keyed.withColumn(
            "mention_id",
            ent.mention_id(F.col("document_id"), F.col("kind"), F.col("locator"), F.lit("line"), F.lit(""), F.col("name_key")),
        ),
        parts=t.parts(t.table(spark, sf, "lineitem")),
    )


def organizations(spark: SparkSession, sf: str) -> DataFrame:
    """The name of every part with its own size stands for an organization name."""
    parts = t.table(spark, sf, "part")
    name = F.concat("p_name", F.lit(" "), F.replace("p_brand", F.lit("Brand#"), F.lit("mk")), F.lit(" "), F.col("p_size"))
    return parts.select(tx.orthographic_key(name).alias("key")).distinct()


def groups(spark: SparkSession, sf: str, rows: DataFrame) -> DataFrame:
    return ent.name_groups(rows, SCOPE_TERMS, organizations(spark, sf))


def candidate_proposals(spark: SparkSession, sf: str) -> DataFrame:
    return ent.proposals(groups(spark, sf, mentions(spark, sf)), SCOPE)


def proposal_exclusions(spark: SparkSession, sf: str) -> DataFrame:
    rows = mentions(spark, sf)
    return ent.exclusions(rows, groups(spark, sf, rows)).select("mention_id", "key", "connector", "reason")


def proposal_members(spark: SparkSession, sf: str) -> DataFrame:
    """Mentions are stored once with the columns that members are made of: two steps read them."""
    rows = found_mentions(spark, sf).select("key", "text", "document_id", "origin_id", "provider_score")
    return ent.proposal_members(stored(rows, "mentions"), SCOPE, SCOPE_TERMS, organizations(spark, sf))


def gate_batch(spark: SparkSession, sf: str) -> DataFrame:
    return ent.gate_batch(candidate_proposals(spark, sf), 200).select(
        "position", "proposal_id", "key", "origins", "documents", "connectors"
    )


def top_proposals(spark: SparkSession, sf: str) -> DataFrame:
    return ranked_head(candidate_proposals(spark, sf), ent.proposal_order(), 500).select("rank", "proposal_id", "canonical_name")


def grounded_hints(spark: SparkSession, sf: str) -> DataFrame:
    """Excerpt-side names as provider hints, kept where the title side of the order has the name."""
    rows = mentions(spark, sf).withColumn("name_key", tx.name_key(F.col("p_name")))
    hints = rows.where(F.col("kind") == "excerpt").select("mention_id", "document_id", "name_key", "provider_score")
    return ent.grounded_hints(hints, rows.where(F.col("kind") == "title"))


def mention_violations(spark: SparkSession, sf: str) -> DataFrame:
    rows = mentions(spark, sf)
    docs = rows.groupBy("document_id").agg(F.min("connector").alias("connector"))
    return ent.mention_violations(rows, docs).groupBy("violation", "connector").agg(F.count(F.lit(1)).alias("mentions"))


def acronym_groups(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    items = t.table(spark, sf, "lineitem").select("l_orderkey", "l_partkey")
    parts = t.table(spark, sf, "part").select("p_partkey", "p_name", "p_type")
    orders = t.table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    full = F.concat("p_type", F.lit(" "), "p_name")
    name = F.when(F.col("p_partkey") % 4 == 2, tx.acronym_of(full)).otherwise(full)
    rows = items.join(parts.select("p_partkey", name.alias("name")), F.col("l_partkey") == F.col("p_partkey")).join(
        orders, F.col("l_orderkey") == F.col("o_orderkey")
    ).select("name", F.concat(F.lit("cust-"), "o_custkey").alias("origin_id")).distinct()
    rows = rows.withColumn("group_id", F.concat(F.lit("group-"), tx.name_key(F.col("name"))))
    return rows.select("group_id", "name").distinct(), rows.select("group_id", "origin_id").distinct()


def acronym_suggestions(spark: SparkSession, sf: str) -> DataFrame:
    return ent.acronym_suggestions(*acronym_groups(spark, sf))


def linked_documents(spark: SparkSession, sf: str) -> DataFrame:
    docs, cands = t.documents(spark, sf), t.candidates(spark, sf)
    rows = t.links(spark, sf, docs, cands).join(docs.drop("excerpt", "excerpt_key"), "document_id")
    return rows.withColumn("origin_id", F.concat(F.lit("site:"), "publisher", F.lit("|"), "title_key"))


def origin_groups(spark: SparkSession, sf: str) -> DataFrame:
    return ent.origin_groups(linked_documents(spark, sf))


def echo_links(spark: SparkSession, sf: str) -> DataFrame:
    """News echoes; publication days are folded to 40 so that copies fall near each other."""
    rows = linked_documents(spark, sf).withColumn("title_key", tx.title_key(F.col("title"))).where(
        (F.col("connector") == "mediacloud") & F.col("published_at").isNotNull() & (F.col("title_key") != "")
    )
    day = F.date_add(F.lit(t.WINDOWS.previous), (F.unix_date("published_at") % 40).cast("int"))
    return ent.echo_links(rows.withColumn("published_at", day))


def hint_merge(spark: SparkSession, sf: str) -> DataFrame:
    rows = mentions(spark, sf).select("origin_id", "kind", F.col("p_name").alias("term"), F.col("provider_score").alias("score"), "primary_topic")
    return ent.merge_hints(rows)


def first_discovery(spark: SparkSession, sf: str) -> DataFrame:
    """First line of every origin in page order."""
    items = t.table(spark, sf, "lineitem").join(t.table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = items.select("o_custkey", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return ent.first_by_position(rows, ["o_custkey"], ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])


def part_names(spark: SparkSession, sf: str) -> DataFrame:
    p = t.table(spark, sf, "part")
    a = tx.identity_key(F.concat_ws(" ", "p_name", "p_brand", "p_type"))
    b = tx.identity_key(F.concat_ws(" ", "p_brand", "p_size", "p_type"))
    return p.select(F.concat(F.lit("part-"), "p_partkey").alias("candidate_id"), F.explode(F.array(a, b)).alias("name"))


def identity_groups(spark: SparkSession, sf: str) -> DataFrame:
    names = part_names(spark, sf)
    return graph.identity_groups(names, "candidate_id", graph.shared_key_edges(names, "candidate_id", "name"))


def corpora(spark: SparkSession, sf: str) -> DataFrame:
    return t.table(spark, sf, "part").select(
        F.concat(F.lit("part-"), "p_partkey").alias("candidate_id"),
        tx.identity_key(F.concat_ws(" ", "p_name", "p_brand", "p_size")).alias("form"),
        (F.col("p_retailprice") % 2 < 1).alias("positive"),
    )


def identity_suggestions(spark: SparkSession, sf: str) -> DataFrame:
    names = corpora(spark, sf)
    return identity.form_suggestions(names.where("positive"), names.where("not positive"))


def identity_decisions(spark: SparkSession, sf: str) -> DataFrame:
    """Review decisions on the smallest candidates of every suggested pair of forms."""
    names = corpora(spark, sf)
    found = identity_suggestions(spark, sf)
    least = names.groupBy("form", "positive").agg(F.min("candidate_id").alias("c"))
    pairs = found.join(least.where("positive").select(F.col("form").alias("left_form"), F.col("c").alias("left_candidate_id")), "left_form").join(
        least.where("not positive").select(F.col("form").alias("right_form"), F.col("c").alias("right_candidate_id")), "right_form"
    )
    relation = F.when(F.col("trigger") == "exact", "same_candidate").when(F.col("token_jaccard") > 0.6, "same_family").otherwise("distinct")
    return pairs.withColumn("relation", relation)


def identity_review_totals(spark: SparkSession, sf: str) -> DataFrame:
    return identity.review_totals(identity_decisions(spark, sf))


def reviewed_identity_groups(spark: SparkSession, sf: str) -> DataFrame:
    decisions = identity_decisions(spark, sf).where(F.col("relation").isin("same_candidate", "same_family"))
    edges = decisions.select(F.col("left_candidate_id").alias("u"), F.col("right_candidate_id").alias("v"))
    return graph.identity_groups(corpora(spark, sf), "candidate_id", edges)


def verified_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Linked documents in which a search term of the candidate occurs at word boundaries."""
    docs, cands = t.documents(spark, sf), t.candidates(spark, sf)
    names = cands.select(F.col("candidate_id").alias("group_id"), F.explode("search_terms").alias("phrase"))
    links = t.links(spark, sf, docs, cands).withColumnRenamed("candidate_id", "group_id")
    fields = docs.select("document_id", tx.phrase_key(F.col("excerpt")).alias("field"))
    return ent.verified_documents(names, links, fields)


def scope_queries(spark: SparkSession, sf: str) -> DataFrame:
    """One scope per part: name, upper-case name, quoted brand, blank."""
    rows = t.table(spark, sf, "part").select(
        F.concat(F.lit("part-"), "p_partkey").alias("scope_key"),
        F.array(F.replace("p_name", F.lit(" "), F.lit("  ")), F.upper("p_name"), F.concat(F.lit('"'), "p_brand", F.lit('" ')), F.lit(" ")).alias("search_texts"),
    )
    return ent.scope_rows(rows)


QUERIES = {
    "scope_queries": scope_queries,
    "candidate_proposals": candidate_proposals,
    "proposal_exclusions": proposal_exclusions,
    "proposal_members": proposal_members,
    "gate_batch": gate_batch,
    "top_proposals": top_proposals,
    "grounded_hints": grounded_hints,
    "mention_violations": mention_violations,
    "acronym_suggestions": acronym_suggestions,
    "origin_groups": origin_groups,
    "echo_links": echo_links,
    "hint_merge": hint_merge,
    "first_discovery": first_discovery,
    "identity_groups": identity_groups,
    "identity_suggestions": identity_suggestions,
    "identity_review_totals": identity_review_totals,
    "reviewed_identity_groups": reviewed_identity_groups,
    "verified_documents": verified_documents,
}


def _ortho(expr: str) -> str:
    base = f"trim(regexp_replace(regexp_replace(replace(lower({expr}), 'ß', 'ss'), '[-‐‑‒–—−_]+', ' ', 'g'), '\\s+', ' ', 'g'))"
    return (
        f"array_to_string(list_transform(string_split({base}, ' '), lambda w: CASE WHEN regexp_full_match(w, '[a-z]{{2,}}[a-hj-rtv-z]s') "
        "THEN w[1:len(w)-1] ELSE w END), ' ')"
    )


_NAME = "trim(regexp_replace(lower({0}), '\\s+', ' ', 'g'))"

MENTIONS_SQL = f"""WITH m0 AS (
  SELECT DISTINCT 'order-' || l_orderkey AS document_id, 'cust-' || o_custkey AS origin_id,
    (['openalex','mediacloud','exa'])[ascii(l_returnflag) % 3 + 1] AS connector,
    CASE WHEN l_linestatus = 'F' THEN 'title' ELSE 'excerpt' END AS kind,
    l_linenumber || ':' || l_partkey || ':' || l_suppkey || ':' || date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS locator,
    CASE p_partkey % 4 WHEN 1 THEN replace(p_name, ' ', '-') WHEN 2 THEN upper(p_name) WHEN 3 THEN p_name || 's' ELSE p_name END
      || ' ' || replace(p_brand, 'Brand#', 'mk') || ' ' || CAST(l_quantity AS INT) AS text,
    CASE WHEN l_linenumber <> 1 THEN round(l_discount * 10, 2) END AS provider_score,
    l_linenumber = 2 AS primary_topic, p_name
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey),
m1 AS (SELECT *, {_ortho('text')} AS key, {_NAME.format('text')} AS name_key FROM m0),
mentions AS (SELECT DISTINCT ON (mention_id) * FROM (
  SELECT *, 'mention-' || substr(sha256(document_id || '|' || kind || '|' || locator || '|line||' || name_key), 1, 16) AS mention_id FROM m1)),
orgs AS (SELECT DISTINCT {_ortho("p_name || ' ' || replace(p_brand, 'Brand#', 'mk') || ' ' || p_size")} AS key FROM part),
spell AS (SELECT key, text, max(provider_score) AS score, count(*) AS n FROM mentions GROUP BY ALL),
nm AS (SELECT key, arg_min(text, (-coalesce(score, -1), lower(text), text)) AS canonical_name, max(score) AS max_score,
   CAST(sum(n) AS BIGINT) AS mentions, count(*) - 1 AS aliases FROM spell GROUP BY key),
cn AS (SELECT key, count(DISTINCT document_id) AS documents, count(DISTINCT origin_id) AS origins,
   count(DISTINCT connector) AS connectors, bool_or(primary_topic) AS primary_topic FROM mentions GROUP BY key),
grp AS (SELECT *, CASE WHEN length(key) < 2 OR NOT regexp_matches(key, '[\\p{{L}}\\p{{N}}]') THEN 'invalid_name'
   WHEN key IN ('red widget mk1 1') THEN 'scope_term'
   WHEN key IN (SELECT key FROM orgs) THEN 'organization' END AS reason FROM nm JOIN cn USING (key)),
prop AS (SELECT * EXCLUDE (reason), 'proposal-' || substr(sha256('{SCOPE}|' || key), 1, 16) AS proposal_id FROM grp WHERE reason IS NULL)
"""

_LINKED = t.BASE_SQL + """,
ld AS (SELECT l.candidate_id, d.* REPLACE ('site:' || publisher || '|' || title_key AS origin_id) FROM links l JOIN docs d USING (document_id))"""

_PN = """WITH RECURSIVE pn AS (SELECT 'part-' || p_partkey AS c, unnest([
   {0}, {1}]) AS name FROM part),
e AS (SELECT DISTINCT a.c AS u, b.c AS v FROM pn a JOIN pn b USING (name)),
reach AS (SELECT u, v FROM e UNION SELECT r.u, e.v FROM reach r JOIN e ON r.v = e.u)
SELECT u AS candidate_id, 'cross-corpus-' || substr(sha256(min(v)), 1, 16) AS group_id FROM reach GROUP BY u""".format(
    t.norm("p_name || ' ' || p_brand || ' ' || p_type"), t.norm("p_brand || ' ' || p_size || ' ' || p_type")
)

_CORP = f"""corp AS (SELECT 'part-' || p_partkey AS candidate_id, {t.norm("p_name || ' ' || p_brand || ' ' || p_size")} AS form,
   p_retailprice % 2 < 1 AS positive FROM part),
lf AS (SELECT form AS left_form, count(DISTINCT candidate_id) AS left_candidates, min(candidate_id) AS left_candidate_id FROM corp WHERE positive GROUP BY form),
rf AS (SELECT form AS right_form, count(DISTINCT candidate_id) AS right_candidates, min(candidate_id) AS right_candidate_id FROM corp WHERE NOT positive GROUP BY form),
px AS (SELECT *, string_split(left_form, ' ') AS a, string_split(right_form, ' ') AS b FROM lf CROSS JOIN rf),
py AS (SELECT *, len(list_intersect(a, b)) AS c, len(list_filter(list_intersect(a, b), lambda w: w NOT IN ('ai','model','models','system','systems','technology','technologies'))) AS g,
   len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) AS j FROM px),
sug AS (SELECT *, CASE WHEN left_form = right_form THEN 'exact'
   WHEN (g >= 2 AND j >= 0.5) OR (least(length(left_form), length(right_form)) >= 5 AND (contains(left_form, right_form) OR contains(right_form, left_form))) THEN 'fuzzy' END AS trigger,
   round(j, 6) AS token_jaccard FROM py),
dec AS (SELECT *, CASE WHEN trigger = 'exact' THEN 'same_candidate' WHEN token_jaccard > 0.6 THEN 'same_family' ELSE 'distinct' END AS relation FROM sug WHERE trigger IS NOT NULL)"""

_PROP_ORDER = "origins DESC, documents DESC, coalesce(max_score, -1) DESC, key"

ORACLES = {
    "scope_queries": """SELECT 'part-' || p_partkey AS scope_key, 'scope-' || substr(sha256(p_name || '|' || p_brand), 1, 16) AS scope_id,
 '"' || p_name || '" OR "' || p_brand || '"' AS scope_query FROM part""",
    "candidate_proposals": MENTIONS_SQL + "SELECT * FROM prop",
    "proposal_exclusions": MENTIONS_SQL + "SELECT mention_id, m.key, connector, reason FROM mentions m JOIN grp g USING (key) WHERE reason IS NOT NULL",
    "proposal_members": MENTIONS_SQL + """SELECT DISTINCT proposal_id, role, member FROM (
 SELECT key, 'alias' AS role, text AS member FROM mentions UNION ALL SELECT key, 'document', document_id FROM mentions
 UNION ALL SELECT key, 'origin', origin_id FROM mentions) JOIN prop USING (key) WHERE role <> 'alias' OR member <> canonical_name""",
    "gate_batch": MENTIONS_SQL + f""", st AS (SELECT *, CASE WHEN connectors > 1 THEN 0 WHEN origins BETWEEN 2 AND 3 THEN 1 WHEN origins <= 1 THEN 2 ELSE 3 END AS s FROM prop),
r AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY {_PROP_ORDER}) AS turn FROM st)
SELECT row_number() OVER (ORDER BY turn, s) AS position, proposal_id, key, origins, documents, connectors FROM r QUALIFY position <= 200""",
    "top_proposals": MENTIONS_SQL + f"SELECT row_number() OVER (ORDER BY {_PROP_ORDER}) AS rank, proposal_id, canonical_name FROM prop QUALIFY rank <= 500",
    "grounded_hints": MENTIONS_SQL + f""", h AS (SELECT mention_id, document_id, kind, provider_score, {_NAME.format('p_name')} AS name_key FROM mentions)
SELECT mention_id, document_id, name_key, provider_score FROM h WHERE kind = 'excerpt'
AND (document_id, name_key) IN (SELECT (document_id, name_key) FROM h WHERE kind = 'title')""",
    "mention_violations": MENTIONS_SQL + """, d AS (SELECT document_id, min(connector) AS dc FROM mentions GROUP BY 1)
SELECT 'connector_differs' AS violation, connector, count(*) AS mentions FROM mentions JOIN d USING (document_id) WHERE dc <> connector GROUP BY 2""",
    "acronym_suggestions": """WITH p AS (SELECT p_partkey, p_type || ' ' || p_name AS full_name FROM part),
pn AS (SELECT p_partkey, CASE WHEN p_partkey % 4 = 2 THEN upper(array_to_string(list_transform(string_split(full_name, ' '), lambda w: w[1]), '')) ELSE full_name END AS name FROM p),
r AS (SELECT DISTINCT name, 'cust-' || o_custkey AS origin_id, 'group-' || lower(name) AS group_id
  FROM lineitem JOIN pn ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey),
s AS (SELECT DISTINCT group_id, origin_id, name AS acronym FROM r WHERE regexp_full_match(name, '[A-Z0-9]{3,8}')),
l AS (SELECT DISTINCT group_id, origin_id, upper(array_to_string(list_transform(string_split(name, ' '), lambda w: w[1]), '')) AS acronym FROM r WHERE contains(name, ' '))
SELECT DISTINCT least(s.group_id, l.group_id) AS left_group_id, greatest(s.group_id, l.group_id) AS right_group_id, origin_id AS shared_origin_id
FROM s JOIN l USING (acronym, origin_id) WHERE s.group_id <> l.group_id""",
    "origin_groups": _LINKED + """ SELECT candidate_id, origin_id, count(DISTINCT document_id) AS documents, count(DISTINCT url) AS urls,
min(document_id) AS first_document_id FROM ld GROUP BY ALL""",
    "echo_links": _LINKED + """, o AS (SELECT DISTINCT candidate_id,
  trim(regexp_replace(replace(lower(title), 'ß', 'ss'), '[^\\p{L}\\p{N}_]+', ' ', 'g')) AS title_key, origin_id,
  CAST(DATE '2024-09-15' + CAST(date_diff('day', DATE '1970-01-01', published_at) % 40 AS INT) AS DATE) AS published_at
  FROM ld WHERE connector = 'mediacloud' AND published_at IS NOT NULL),
k AS (SELECT * FROM o WHERE title_key <> ''),
h AS (SELECT candidate_id, title_key, published_at, min(origin_id) AS hub FROM k GROUP BY ALL)
SELECT candidate_id, title_key, origin_id, published_at, hub AS echo_origin_id, published_at AS echo_published_at, 0 AS gap_days
FROM k JOIN h USING (candidate_id, title_key, published_at) WHERE origin_id <> hub
UNION ALL
SELECT a.candidate_id, a.title_key, a.hub, a.published_at, b.hub, b.published_at, CAST(date_diff('day', a.published_at, b.published_at) AS INT)
FROM h a JOIN h b USING (candidate_id, title_key) WHERE date_diff('day', a.published_at, b.published_at) BETWEEN 1 AND 3""",
    "hint_merge": MENTIONS_SQL + "SELECT origin_id, kind, p_name AS term, max(provider_score) AS score, bool_or(primary_topic) AS primary_topic FROM mentions GROUP BY ALL",
    "first_discovery": """SELECT o_custkey, l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) = 1""",
    "identity_groups": _PN,
    "identity_suggestions": f"WITH {_CORP} SELECT left_form, right_form, trigger, token_jaccard, left_candidates, right_candidates FROM sug WHERE trigger IS NOT NULL",
    "identity_review_totals": f"""WITH {_CORP} SELECT count(*) AS pairs, count(*) FILTER (trigger = 'exact') AS exact, count(*) FILTER (trigger = 'fuzzy') AS fuzzy, 0 AS manual,
count(*) FILTER (relation = 'same_candidate') AS same_candidate, count(*) FILTER (relation = 'same_family') AS same_family,
count(*) FILTER (relation = 'distinct') AS distinct, count(*) FILTER (relation = 'same_candidate') = 0 AS ready_for_model FROM dec""",
    "reviewed_identity_groups": f"""WITH RECURSIVE {_CORP},
e AS (SELECT left_candidate_id AS u, right_candidate_id AS v FROM dec WHERE relation <> 'distinct'
   UNION SELECT right_candidate_id, left_candidate_id FROM dec WHERE relation <> 'distinct' UNION SELECT candidate_id, candidate_id FROM corp),
reach AS (SELECT u, v FROM e UNION SELECT r.u, e.v FROM reach r JOIN e ON r.v = e.u)
SELECT u AS candidate_id, 'cross-corpus-' || substr(sha256(min(v)), 1, 16) AS group_id FROM reach GROUP BY u""",
    "verified_documents": t.BASE_SQL + """ SELECT DISTINCT candidate_id AS group_id, document_id FROM links JOIN terms USING (candidate_id)
JOIN (SELECT document_id, trim(regexp_replace(regexp_replace(replace(lower(excerpt), 'ß', 'ss'), '[-‐‑‒–—−_]+', ' ', 'g'), '\\s+', ' ', 'g')) AS f FROM docs) USING (document_id)
WHERE regexp_matches(f, '(^|[^\\p{L}\\p{N}_])' || term || '($|[^\\p{L}\\p{N}_])')""",
}
