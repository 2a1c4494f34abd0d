"""Evidence summary, decision policy, duplicates, ranking and summary of the result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenuis.functions import text as tx
from tenuis.operators import graph
from tenuis.operators.evidence import MATURITY_KINDS, SUPPORT_KINDS
from tenuis.operators.ranking import first_row, ranked_head
from tenuis.session import cut_lineage

# Words too general to tie a document to a query.
GENERIC_SCOPE_WORDS = [
    "artificial", "intelligence", "machine", "learning", "technology", "technologies", "system", "systems",
    "application", "applications", "using", "with", "from", "into", "and", "the", "для", "технологии", "система", "системы",
]
# Cues of a stated benefit.
BENEFIT_CUES = (
    "(?i)ускор|повыш|сниж|уменьш|улучш|эффектив|точност|производ|эконом|энергосбереж|безопас|масштаб|преимуществ|"
    "faster|lower|reduce|improv|efficien|accur|scalab|saving|performance"
)
MIRROR_WORDS = 6


def origin_key(title_key: Column, origin_id: Column) -> Column:
    """Normalized title, else the origin."""
    return F.coalesce(
        F.concat(F.lit("title:"), F.nullif(title_key, F.lit(""))),
        F.concat(F.lit("origin:"), tx.fold_native(F.nullif(F.trim(origin_id), F.lit("")))),
    )


def _mirror_edges(docs: DataFrame) -> DataFrame:
    """Pairs of documents of a candidate where one title of six words or more is a run of words
    of the other. They meet on the first six words of the shorter title."""
    tokens = tx.words(F.col("title_key"))
    long = docs.withColumn("_w", tokens).where(F.size("_w") >= MIRROR_WORDS)
    heads = long.select("candidate_id", "place", "title_key", F.array_join(F.slice("_w", 1, MIRROR_WORDS), " ").alias("run"))
    starts = F.sequence(F.lit(1), F.size("_w") - MIRROR_WORDS + 1)
    runs = long.select(
        "candidate_id", F.col("place").alias("other"), F.col("title_key").alias("other_title"),
        F.explode(F.array_distinct(F.transform(starts, lambda i: F.array_join(F.slice(F.col("_w"), i, F.lit(MIRROR_WORDS)), " ")))).alias("run"),
    )
    pairs = heads.join(runs, ["candidate_id", "run"]).where(
        (F.col("place") != F.col("other")) & tx.has_phrase(F.col("other_title"), F.col("title_key"))
    )
    return pairs.select(
        "candidate_id", F.least("place", "other").alias("earlier"), F.greatest("place", "other").alias("later")
    ).distinct()


def independent_origins(documents: DataFrame) -> DataFrame:
    """Number of independent origins per candidate (candidate_id, place, title_key, origin_id).

    Documents are taken in place order; one is a mirror when it shares the key of a counted
    document or its title holds, or is held by, the title of one. Copies of a key fall away
    first. The rest is settled in rounds: a document counts once all earlier relatives are
    mirrors, and is a mirror once an earlier relative counts.
    """
    keyed = documents.withColumn("_k", F.coalesce(origin_key(F.col("title_key"), F.col("origin_id")), F.concat(F.lit("row:"), "place")))
    unique = first_row(keyed, ["candidate_id", "_k"], [F.col("place").asc()]).select("candidate_id", "place", "title_key")
    unique = cut_lineage(unique)
    edges = cut_lineage(_mirror_edges(unique))
    mirrors = edges.select("candidate_id", "later").limit(0)
    left = edges
    while left.limit(1).count():
        waiting = left.select("candidate_id", F.col("later").alias("earlier")).distinct()
        settled = left.join(waiting, ["candidate_id", "earlier"], "left_anti").select("candidate_id", "later").distinct()
        settled = cut_lineage(settled)
        mirrors = mirrors.unionByName(settled)
        gone = settled.select("candidate_id", F.col("later").alias("earlier"))
        left = cut_lineage(
            left.join(settled, ["candidate_id", "later"], "left_anti").join(gone, ["candidate_id", "earlier"], "left_anti")
        )
    kept = unique.join(mirrors.withColumnRenamed("later", "place"), ["candidate_id", "place"], "left_anti")
    return kept.groupBy("candidate_id").agg(F.count(F.lit(1)).alias("independent_origins"))


def scope_terms(query: str) -> list[str]:
    words = "".join(c if c.isalnum() else " " for c in query.casefold()).split()
    return sorted({w for w in words if len(w) >= 3 and w not in GENERIC_SCOPE_WORDS})


def in_scope(key: Column, terms: list[str]) -> Column:
    """A text names a query term; long terms also as the start of a word."""
    padded = F.concat(F.lit(" "), key, F.lit(" "))
    hit = F.lit(not terms)
    for term in terms:
        hit = hit | F.contains(padded, F.lit(f" {term}" if len(term) >= 5 else f" {term} "))
    return hit


def is_support() -> Column:
    return (F.col("scope") == "full_candidate") & (F.col("direction") == "support") & F.col("kind").isin(SUPPORT_KINDS)


def evidence_summary(claims: DataFrame) -> DataFrame:
    """Counts of full claims by role, distinct actors and trusted support per candidate.

    ``claims`` carry the columns of their document. An actor is an organization, else the
    publisher.
    """
    full = F.col("scope") == "full_candidate"
    mature, promo = F.col("kind").isin(MATURITY_KINDS), F.col("kind") == "promotional_claim"
    organizations = F.filter(
        F.transform(F.coalesce("organizations", F.array().cast("array<string>")), lambda o: tx.fold_native(F.trim(o))), lambda o: o != ""
    )
    publisher = F.nullif(tx.fold_native(F.trim("publisher")), F.lit(""))
    named = F.when(F.size(organizations) > 0, organizations).when(publisher.isNotNull(), F.array(publisher))
    actors = claims.where(is_support()).select("candidate_id", F.explode(named).alias("actor")).groupBy("candidate_id").agg(
        F.countDistinct("actor").alias("independent_actors")
    )
    counts = claims.groupBy("candidate_id").agg(
        F.count_if(full).alias("full_candidate_claims"),
        F.count_if(is_support()).alias("support_claims"),
        F.count_if(full & mature).alias("maturity_claims"),
        F.count_if(full & promo).alias("promotion_claims"),
        F.count_if(full & ((F.col("direction") == "counter") | mature | promo)).alias("counter_claims"),
        F.coalesce(F.bool_or(is_support() & F.col("trust_tier").isin("A", "B")), F.lit(False)).alias("grounded_ab_support"),
        F.coalesce(F.bool_or(is_support() & F.col("document_in_scope")), F.lit(False)).alias("documents_in_scope"),
    )
    return counts.join(actors, "candidate_id", "left").na.fill(0, ["independent_actors"])


def decision(gate: str = "gate_decision") -> tuple[Column, Column]:
    """(status, reason): the first rule that applies."""
    rules = [
        (F.col(gate) == "reject", "excluded", "gate_reject"),
        (F.col("duplicate"), "excluded", "duplicate"),
        (~F.col("substantive"), "excluded", "not_substantive"),
        (F.col(gate) == "review", "watchlist", "gate_review"),
        (~F.col("evidence_review_complete"), "watchlist", "evidence_review_incomplete"),
        (F.col("mature"), "excluded", "mature"),
        (F.col("marketing_hype"), "excluded", "marketing_hype"),
        (~F.col("temporal_coverage_complete"), "watchlist", "temporal_coverage_incomplete"),
        (F.col("independent_origins") < 2, "watchlist", "insufficient_origins"),
        (F.col("independent_actors") < 2, "watchlist", "insufficient_actors"),
        (~F.col("grounded_ab_support"), "watchlist", "insufficient_trusted_evidence"),
        (F.col("score").isNull(), "watchlist", "model_unavailable"),
        (F.col("score") < F.col("threshold"), "excluded", "model_below_threshold"),
    ]
    status, reason = F, F
    for condition, outcome, name in rules:
        status, reason = status.when(condition, outcome), reason.when(condition, name)
    return status.otherwise("main"), reason.otherwise("passed")


def assess(candidates: DataFrame, summary: DataFrame, origins: DataFrame) -> DataFrame:
    """Policy input and outcome of every candidate. ``candidates``: candidate_id, name_in_scope,
    evidence_review_complete, temporal_coverage_complete, score, threshold and names."""
    rows = candidates.join(summary, "candidate_id", "left").join(origins, "candidate_id", "left")
    numbers = ["full_candidate_claims", "support_claims", "maturity_claims", "promotion_claims", "counter_claims", "independent_actors", "independent_origins"]
    rows = rows.na.fill(0, numbers).na.fill(False, ["grounded_ab_support", "documents_in_scope"])
    rows = rows.withColumns(
        {
            "gate_decision": F.lit("accept"),
            "duplicate": F.lit(False),
            "substantive": F.col("name_in_scope") | F.col("documents_in_scope"),
            "mature": F.col("maturity_claims") > 0,
            "marketing_hype": (F.col("promotion_claims") > 0) & ((F.col("independent_origins") < 2) | ~F.col("grounded_ab_support")),
        }
    )
    status, reason = decision()
    return rows.withColumns({"status": status, "reason": reason})


def _status_rank() -> Column:
    return F.when(F.col("status") == "main", 0).when(F.col("status") == "watchlist", 1).otherwise(2)


def mark_duplicates(results: DataFrame, names: DataFrame) -> DataFrame:
    """Cards that share a spelling key form one topic; the most conservative, then best
    supported card stays and the others are excluded as its duplicates.

    ``names``: candidate_id, name.
    """
    keys = names.select("candidate_id", tx.card_key(F.col("name")).alias("key")).where(F.col("key") != "").distinct()
    roots = graph.components(results, "candidate_id", graph.shared_key_edges(keys, "candidate_id", "key"))
    rows = results.join(roots, "candidate_id")
    order = [
        (~F.col("reason").isin("mature", "marketing_hype")).asc(), _status_rank().asc(), F.col("independent_origins").desc(),
        F.col("score").desc(), tx.fold_native(F.col("canonical_name")).asc(), F.col("candidate_id").asc(),
    ]
    primary = first_row(rows, ["root"], order).select("root", F.col("candidate_id").alias("primary_id"))
    marked = rows.join(primary, "root")
    other = F.col("candidate_id") != F.col("primary_id")
    return marked.withColumns(
        {
            "duplicate_of": F.when(other, F.col("primary_id")),
            "status": F.when(other, "excluded").otherwise(F.col("status")),
            "reason": F.when(other, "duplicate").otherwise(F.col("reason")),
        }
    ).drop("root", "primary_id")


def top_results(results: DataFrame, size: int = 15) -> DataFrame:
    """Main candidates with a complete review at or above the threshold, best first."""
    eligible = results.where(
        (F.col("status") == "main") & F.col("evidence_review_complete") & (F.col("score") >= F.col("threshold"))
    )
    order = [
        (F.col("support_claims") > 0).desc(), F.bround(F.col("score") * 100, 0).desc(), F.col("independent_origins").desc(),
        F.col("full_candidate_claims").desc(), F.col("score").desc(), tx.fold_native(F.col("canonical_name")).asc(), F.col("candidate_id").asc(),
    ]
    return ranked_head(eligible, order, size, "top_rank")


def summary_counts(results: DataFrame) -> DataFrame:
    """Candidates by status and reason with the number of high scores."""
    return results.groupBy("status", "reason").agg(
        F.count(F.lit(1)).alias("candidates"), F.count_if(F.col("score") > 0.75).alias("score_above_075")
    )


def document_totals(documents: DataFrame) -> DataFrame:
    return documents.agg(
        F.count(F.lit(1)).alias("relations"), F.countDistinct("document_id").alias("documents"), F.countDistinct("origin_id").alias("origins")
    )


def best_claim(claims: DataFrame, kinds: list[str]) -> DataFrame:
    """Claim of the most preferred kind per candidate, else the first claim."""
    rank = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(k) for k in kinds]), F.col("kind")), F.lit(0)), F.lit(len(kinds) + 1))
    return claims.groupBy("candidate_id").agg(F.min(F.struct(rank.alias("r"), "claim_id", "kind")).alias("b")).select(
        "candidate_id", "b.claim_id", "b.kind"
    )


def benefit_claim(claims: DataFrame) -> DataFrame:
    """First claim that states a benefit."""
    stated = claims.where(F.concat_ws(" ", "explanation_ru", "quote").rlike(BENEFIT_CUES))
    return stated.groupBy("candidate_id").agg(F.min("claim_id").alias("claim_id"))


def plain_explanation(value: Column) -> Column:
    """Explanation without its opening about the quote, first letter upper."""
    text = F.trim(value)
    steps = [
        (r"(?iu)^Цитата\s+(прямо\s+)?(подтверждает(,?\s+что)?|показывает|определяет|называет|описывает)\s+", ""),
        (r"(?iu)^Цитата\s+(прямо\s+)?сообщает\s+об\s+", "Есть сведения об "),
        (r"(?iu)^Цитата\s+(прямо\s+)?сообщает\s+о\s+", "Есть сведения о "),
        (r"(?iu)^Цитата\s+", ""),
    ]
    cleaned = text
    for pattern, replacement in steps:
        cleaned = F.regexp_replace(cleaned, pattern, replacement)
    return F.when(cleaned == "", text).otherwise(F.concat(F.upper(F.substring(cleaned, 1, 1)), F.substring(cleaned, F.lit(2), F.length(cleaned))))


def shortlist(predictions: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """Candidates by model score with ranks, a page at a time."""
    order = [F.col("score").desc(), F.col("candidate_id").asc()]
    return ranked_head(predictions, order, offset + limit, "shortlist_rank").where(F.col("shortlist_rank") > offset)
