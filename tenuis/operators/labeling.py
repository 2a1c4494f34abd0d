"""Labelling queue, review decisions, rubric audit and corpus readiness."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tenuis.functions import text as tx
from tenuis.operators.evidence import MATURITY_KINDS, maturity_cues
from tenuis.operators.ranking import first_row, full_rank, full_round_robin, ranked_head, top_k
from tenuis.sources.quarantine import first_issue

NEWS = ["mediacloud", "gdelt"]


# Queue of candidate groups

def merge_runs(groups: DataFrame) -> DataFrame:
    """First run that found a group wins per (domain, key)."""
    return first_row(groups, ["domain", "key"], [F.col("run_id").asc(), F.col("group_id").asc()])


def queue_order() -> list[Column]:
    return [
        F.col("origins").desc(), F.col("documents").desc(), tx.fold_native(F.col("canonical_name")).asc(), F.col("group_id").asc(),
    ]


def spelling_duplicates(groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped with their primary group): first group per domain and queue key."""
    keyed = groups.withColumn("queue_key", tx.queue_key(F.col("canonical_name")))
    named = keyed.where(F.col("queue_key") != "")
    primary = first_row(named, ["domain", "queue_key"], queue_order()).select(
        "domain", "queue_key", F.col("group_id").alias("primary_group_id")
    )
    marked = keyed.join(primary, ["domain", "queue_key"], "left")
    own = F.col("primary_group_id").isNull() | (F.col("primary_group_id") == F.col("group_id"))
    return marked.where(own).drop("primary_group_id", "queue_key"), marked.where(~own).select("group_id", "primary_group_id", "run_id", "domain")


def queue_stratum() -> Column:
    return (
        F.when(F.col("has_scientific") & F.col("has_media"), 0).when(F.col("has_media"), 1)
        .when(F.col("origins") >= 2, 2).otherwise(3)
    )


def fill_slots(groups: DataFrame, slots: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(filled, overflow, deficits): strata of a domain take turns for the slots of that domain."""
    placed = full_round_robin(groups.withColumn("stratum", queue_stratum()), ["domain"], "stratum", queue_order())
    numbered = full_rank(slots, ["domain"], [F.col("slot_id").asc()], "position")
    filled = numbered.join(placed, ["domain", "position"])
    overflow = placed.join(numbered.select("domain", "position"), ["domain", "position"], "left_anti")
    empty = numbered.join(placed.select("domain", "position"), ["domain", "position"], "left_anti")
    return filled, overflow, empty.groupBy("domain").agg(F.count(F.lit(1)).alias("missing"))


def fill_selected(groups: DataFrame, selection: DataFrame) -> DataFrame:
    """Explicit selection (slot_id, domain, group_id) with the first rule a row breaks."""
    uses = selection.groupBy("group_id").agg(F.count(F.lit(1)).alias("_uses"))
    known = groups.select("group_id", F.col("domain").alias("group_domain"))
    rows = selection.join(uses, "group_id").join(known, "group_id", "left")
    return rows.withColumn(
        "violation",
        first_issue(
            (F.col("_uses") > 1, "group_repeated"), (F.col("group_domain").isNull(), "unknown_group"),
            (F.col("group_domain") != F.col("domain"), "domain_differs"),
        ),
    ).drop("_uses")


# Noise

def noise_pool(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usable, dropped): blank texts and missing addresses leave, first of equal texts stays."""
    reason = F.when(F.coalesce(F.trim("text"), F.lit("")) == "", "blank_text").when(F.coalesce(F.trim("url"), F.lit("")) == "", "no_url")
    rows = items.withColumns({"reason": reason, "text": F.trim("text"), "url": F.trim("url")})
    usable = rows.where(F.col("reason").isNull()).drop("reason").withColumn("_t", tx.fold_native(F.col("text")))
    return first_row(usable, ["noise_type", "_t"], [F.col("pos").asc()]).drop("_t"), rows.where(F.col("reason").isNotNull()).select("noise_type", "pos", "reason")


def fill_noise(pool: DataFrame, slots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(filled, deficits): the domains of a noise type take turns for the slots of that type."""
    placed = full_round_robin(pool, ["noise_type"], "domain", [F.col("pos").asc()])
    numbered = full_rank(slots, ["noise_type"], [F.col("slot_id").asc()], "position")
    filled = numbered.join(placed, ["noise_type", "position"])
    empty = numbered.join(placed.select("noise_type", "position"), ["noise_type", "position"], "left_anti")
    return filled, empty.groupBy("noise_type").agg(F.count(F.lit(1)).alias("missing"))


def first_url(items: DataFrame, documents: DataFrame) -> DataFrame:
    """First document of a noise item that has an address; items: one row per document (noise_id, pos, document_id)."""
    found = items.join(documents.where(F.trim("url") != ""), "document_id")
    return found.groupBy("noise_id").agg(F.min_by("url", "pos").alias("url"))


def control_matches(controls: DataFrame, names: DataFrame) -> DataFrame:
    """Noise controls matched with proposals by normalized name; a match must be unique.

    Proposals of one name are counted before the join, so many controls and proposals of a name make no pairs."""
    proposals = names.select(tx.identity_key(F.col("name")).alias("k"), "proposal_id").distinct()
    named = proposals.groupBy("k").agg(F.count("proposal_id").alias("n"), F.min("proposal_id").alias("proposal_id"))
    rows = controls.withColumn("k", tx.identity_key(F.col("text"))).join(named, "k", "left")
    return rows.groupBy("noise_id").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("matches"), F.min("proposal_id").alias("proposal_id")
    ).withColumn("proposal_id", F.when(F.col("matches") == 1, F.col("proposal_id")))


def noise_report(rows: DataFrame) -> DataFrame:
    """Coverage, rejection, false accepts and containment of noise controls."""
    expected = F.col("gate_expected")
    seen = expected & F.col("gate_decision").isNotNull()
    out = rows.agg(
        F.count(F.lit(1)).alias("controls"), F.count_if(expected).alias("expected"), F.count_if(seen).alias("observed"),
        *[F.count_if(seen & (F.col("gate_decision") == d)).alias(d) for d in ("reject", "review", "accept")],
        F.count_if(F.col("contained")).alias("contained_controls"),
    )
    ratio = lambda a, b: F.round(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), 6)
    return out.withColumns(
        {
            "gate_coverage": ratio("observed", "expected"), "rejection_rate": ratio("reject", "observed"),
            "false_accept_rate": ratio("accept", "observed"), "containment_rate": ratio("contained_controls", "controls"),
        }
    )


# Evidence queues

def evidence_queue(entries: DataFrame, most: int = 400) -> DataFrame:
    """Support and counter entries of a candidate in pairs, then what is left, up to ``most``.

    ``entries``: candidate_order, candidate_id, pos, direction.
    """
    ranked = full_rank(entries, ["candidate_order", "candidate_id", "direction"], [F.col("pos").asc()], "n")
    sides = entries.groupBy("candidate_id").agg(
        F.count_if(F.col("direction") == "support").alias("s"), F.count_if(F.col("direction") == "counter").alias("c")
    )
    rows = ranked.join(sides, "candidate_id").withColumn("rest", F.col("n") > F.least("s", "c"))
    order = [F.col("candidate_order").asc(), F.col("rest").asc(), F.col("n").asc(), F.col("direction").desc()]
    return ranked_head(rows, order, most, "evidence_number").drop("n", "s", "c", "rest")


def evidence_budget(documents: DataFrame, per_group: int = 6, most: int = 60) -> DataFrame:
    """Documents per group with their status: unusable source, same origin, over budget, or
    selected; the groups take turns for the overall budget.

    ``documents``: group_id, document_id, origin_id, connector, excerpt_length, trust_rank,
    source_issue.
    """
    news = F.col("connector").isin(NEWS)
    best = [news.asc(), F.col("excerpt_length").desc(), F.col("document_id").asc()]
    usable = documents.where(F.col("source_issue").isNull())
    chosen = first_row(usable, ["group_id", "origin_id"], best)
    source = [F.col("trust_rank").asc(), F.col("excerpt_length").desc(), F.col("document_id").asc()]
    turn = top_k(chosen.withColumn("is_news", news), ["group_id", "is_news"], source, per_group, "_turn")
    balanced = top_k(turn, ["group_id"], [F.col("_turn").asc(), F.col("is_news").asc()], per_group, "place")
    head = ranked_head(balanced, [F.col("place").asc(), F.col("group_id").asc()], most, "budget_rank")
    keys = ["group_id", "document_id"]
    flags = documents.select(*keys, "source_issue").join(chosen.select(*keys, F.lit(True).alias("_c")), keys, "left").join(
        head.select(*keys, "budget_rank"), keys, "left"
    )
    status = (
        F.when(F.col("source_issue").isNotNull(), F.col("source_issue")).when(F.col("budget_rank").isNotNull(), "selected")
        .when(F.col("_c"), "budget").otherwise("same_origin")
    )
    return flags.select(*keys, status.alias("status"), "budget_rank")


def source_issue(generated: Column, connector: Column, news_status: Column, excerpt_length: Column) -> Column:
    """Why a source text cannot be evidence."""
    return first_issue(
        (generated, "generated_text"),
        (connector.isin(NEWS) & ~news_status.eqNullSafe(F.lit("article_text")), "news_text_unavailable"),
        (F.coalesce(excerpt_length, F.lit(0)) == 0, "no_source_text"),
    )


def maturity_queue(ranked: DataFrame, documents: DataFrame, k: int = 4) -> DataFrame:
    """Strong or weak publications with maturity cues, 15 points per cue, one per origin.

    Cues are looked up once per document, and links meet the cues instead of the texts."""
    cues = maturity_cues(F.concat_ws("\n", "title", "excerpt"))
    cued = documents.where(F.trim("excerpt") != "").select("document_id", cues.alias("cues")).where(F.size("cues") > 0)
    rows = ranked.where((F.col("connector") == "openalex") & F.col("relevance_class").isin("strong", "weak")).join(cued, "document_id")
    rows = rows.withColumn("maturity_score", F.col("score") + 15 * F.size("cues"))
    order = [
        F.col("maturity_score").desc(), (F.col("trust_tier") != "A").asc(), F.col("published_at").asc_nulls_last(), F.col("document_id").asc(),
    ]
    one = first_row(rows, ["candidate_id", "origin_id"], order)
    return top_k(one, ["candidate_id"], order, k, "selection_rank")


def publicity_input(media: DataFrame, science: DataFrame, gate: DataFrame) -> DataFrame:
    """Up to four strong recent media documents of accepted candidates with three documents from
    two publishers, then science up to six."""
    ready = gate.where(F.col("promotion_status") == "evidence_review_required").select("candidate_id")
    head = media.where(F.col("media_rank") <= 4)
    enough = head.groupBy("candidate_id").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct(F.coalesce("publisher", F.lit(""))).alias("publishers")
    ).where((F.col("n") >= 3) & (F.col("publishers") >= 2))
    both = head.select("candidate_id", "document_id", F.lit(0).alias("class"), F.col("media_rank").alias("r")).unionByName(
        science.select("candidate_id", "document_id", F.lit(1).alias("class"), F.col("science_rank").alias("r"))
    )
    rows = both.join(ready, "candidate_id", "left_semi").join(enough, "candidate_id", "left_semi")
    return top_k(rows, ["candidate_id"], [F.col("class").asc(), F.col("r").asc()], 6, "final_rank")


def broken_ranks(rows: DataFrame, rank: str) -> DataFrame:
    """Candidates whose ranks are not 1..N."""
    return rows.groupBy("candidate_id").agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct(rank).alias("ranks"), F.min(rank).alias("low"), F.max(rank).alias("high")
    ).where((F.col("low") != 1) | (F.col("high") != F.col("rows")) | (F.col("ranks") != F.col("rows")))


# Rubric

def rubric_audit(candidates: DataFrame, claims: DataFrame, media: DataFrame, recent: dt.date, cutoff: dt.date) -> DataFrame:
    """Facts for a label decision from full claims and recent media; no label is assigned.

    Distinct origins are needed only up to two or three, and are counted in one pass.
    """
    full = F.col("scope") == "full_candidate"
    trusted = full & F.col("trust_tier").isin("A", "B")
    technical = F.col("kind").isin(*MATURITY_KINDS, "pilot", "prototype", "research")
    inside = F.col("published_at").between(F.lit(recent), F.lit(cutoff))
    publicity = full & F.col("kind").isin("investment", "growth", "promotional_claim") & (F.col("source_class") == "industry") & F.coalesce(inside, F.lit(False))
    origin = lambda cond: F.countDistinct(F.when(cond, F.col("origin_id")))
    facts = claims.groupBy("candidate_id").agg(
        F.count(F.lit(1)).alias("claim_count"), F.count_if(full).alias("full_claims"),
        origin(trusted & F.col("kind").isin(MATURITY_KINDS)).alias("maturity_origins"), origin(trusted & technical).alias("technical_origins"),
        origin(trusted & (F.col("kind") == "pilot")).alias("pilot_origins"),
        F.count_if(publicity).alias("publicity_items"), origin(publicity).alias("publicity_origins"),
    )
    seen = media.where((F.col("connector") == "mediacloud") & F.col("relevance_class").isin("strong", "weak") & inside).groupBy("candidate_id").agg(
        F.countDistinct("origin_id").alias("media_origins")
    )
    rows = candidates.join(facts, "candidate_id", "left").join(seen, "candidate_id", "left").na.fill(0)
    covered = F.col("search_coverage_complete")
    rows = rows.withColumns(
        {
            "mature_eligible": F.col("maturity_origins") > 0,
            "hype_eligible": covered & (F.col("publicity_items") >= 3) & (F.col("publicity_origins") >= 2)
            & (F.col("technical_origins") < 2) & (F.col("pilot_origins") == 0),
        }
    )
    deficits = F.concat_ws(
        ",",
        F.when(F.col("maturity_origins") == 0, "missing_ab_standard_deployment_or_market"),
        F.when(~covered, "incomplete_candidate_search_coverage"),
        F.when(F.col("publicity_items") < 3, "fewer_than_three_verified_recent_publicity_items"),
        F.when(F.col("publicity_origins") < 2, "fewer_than_two_verified_publicity_origins"),
        F.when(F.col("technical_origins") >= 2, "two_or_more_ab_technical_origins"),
        F.when(F.col("pilot_origins") > 0, "confirmed_ab_pilot"),
    )
    status = (
        F.when(F.col("mature_eligible") & F.col("hype_eligible"), "conflict").when(F.col("mature_eligible"), "mature_ready")
        .when(F.col("hype_eligible"), "marketing_hype_ready").when(F.col("media_origins") >= 3, "needs_verified_publicity")
        .otherwise("insufficient_evidence")
    )
    return rows.withColumns({"deficits": deficits, "status": status})


def evidence_contract(candidates: DataFrame, evidence: DataFrame, start: dt.date, cutoff: dt.date) -> DataFrame:
    """Why the publicity rows of a candidate do not carry its label, in fixed order."""
    key = tx.identity_key
    rows = evidence.join(candidates.select(
            "candidate_id", F.col("canonical_name").alias("_own"), F.transform("names", lambda n: tx.alnum_words(tx.fold_native(n))).alias("_names")
        ), "candidate_id")
    quote, headline = key(F.coalesce("quote", F.lit(""))), key(F.coalesce("headline", F.lit("")))
    rows = rows.withColumns({"_q": quote, "_h": headline})
    named = F.exists("_names", lambda n: (n != "") & (F.contains("_q", n) | F.contains("_h", n)))
    head_only = F.col("content_status").isin("title_only", "not_fetched")
    facts = rows.groupBy("candidate_id").agg(
        F.count(F.lit(1)).alias("rows_total"), F.count_if(~head_only).alias("substantive_rows"),
        F.countDistinct(key(F.col("origin_id"))).alias("origins"), F.countDistinct(key(F.col("publisher"))).alias("publishers"),
        F.bool_or(~F.coalesce(F.col("published_at").between(F.lit(start), F.lit(cutoff)), F.lit(False))).alias("bad_date"),
        F.bool_or(~F.coalesce(F.col("url").rlike("^https?://[^/?#]+"), F.lit(False))).alias("bad_url"),
        F.bool_or(~F.col("canonical_name").eqNullSafe(F.col("_own"))).alias("foreign_candidate"),
        F.bool_or((F.col("_q") == "") & (F.col("_h") == "")).alias("empty_text"), F.bool_or(~named).alias("name_absent"),
    )
    out = candidates.select("candidate_id").join(facts, "candidate_id", "left").na.fill(0).na.fill(False)
    reasons = F.concat_ws(
        ",",
        F.when(F.col("rows_total") < 3, "insufficient_rows"), F.when(F.col("foreign_candidate"), "foreign_candidate"),
        F.when(F.col("bad_date"), "bad_date"), F.when(F.col("bad_url"), "bad_url"),
        F.when(F.col("empty_text"), "empty_text"), F.when(F.col("name_absent"), "name_absent"), F.when(F.col("origins") < 2, "single_origin"),
        F.when(F.col("publishers") < 2, "single_publisher"), F.when(F.col("substantive_rows") < 1, "no_substantive_evidence"),
    )
    return out.select("candidate_id", "rows_total", "substantive_rows", "origins", "publishers", reasons.alias("reasons"))


def label_readiness(candidates: DataFrame, contract: DataFrame) -> DataFrame:
    """Accepted mature labels are ready; accepted hype labels need a clean contract."""
    rows = candidates.join(contract.select("candidate_id", "reasons"), "candidate_id", "left")
    accepted = F.col("decision_status") == "accepted"
    reason = F.when(~accepted, "proposed_not_accepted").when(F.col("proposed_label") == "mature", "").otherwise(F.coalesce("reasons", F.lit("insufficient_rows")))
    return rows.withColumns({"reason": reason, "label_ready": accepted & (reason == "")}).drop("reasons")


def readiness_by_domain(ready: DataFrame, quotas: DataFrame) -> DataFrame:
    counts = ready.groupBy("domain", "proposed_label").agg(
        F.count(F.lit(1)).alias("candidates"), F.count_if("label_ready").alias("ready")
    )
    return quotas.join(counts, ["domain", "proposed_label"], "left").na.fill(0).withColumn("quota_met", F.col("ready") >= F.col("quota"))


# Review decisions

def final_decisions(decisions: DataFrame) -> DataFrame:
    """Final label per subject from primary, secondary and adjudication rounds, or the rule its
    history breaks."""
    at = lambda name, column: F.max(F.when(F.col("review_round") == name, F.col(column)))
    n = lambda name: F.count_if(F.col("review_round") == name)
    rows = decisions.groupBy("subject_id").agg(
        n("primary").alias("n1"), n("secondary").alias("n2"), n("adjudication").alias("n3"),
        *[at(r, c).alias(f"{c}_{r}") for r in ("primary", "secondary", "adjudication") for c in ("label", "reviewer_id")],
        F.count_if(F.col("review_round").isin("primary", "secondary") & (F.col("status") != "reviewed")).alias("unreviewed"),
    )
    differs = (F.col("n2") == 1) & (F.col("label_secondary") != F.col("label_primary"))
    third = F.col("reviewer_id_adjudication")
    issue = first_issue(
        ((F.col("n1") != 1) | (F.col("n2") > 1) | (F.col("n3") > 1), "invalid_history"),
        (F.col("unreviewed") > 0, "not_reviewed"),
        (F.col("reviewer_id_primary") == F.col("reviewer_id_secondary"), "same_reviewer"),
        ((third == F.col("reviewer_id_primary")) | (third == F.col("reviewer_id_secondary")), "adjudicator_not_third"),
        (differs & (F.col("n3") == 0), "needs_adjudication"),
        (~differs & (F.col("n3") > 0), "adjudication_without_disagreement"),
    )
    label = F.when(differs, F.col("label_adjudication")).otherwise(F.col("label_primary"))
    return rows.select("subject_id", issue.alias("issue"), F.when(issue.isNull(), label).alias("label"), (F.col("n2") > 0).alias("second_review"))


def second_review_quota(final: DataFrame) -> DataFrame:
    """A fifth of the subjects of every label needs a second review."""
    return final.where(F.col("label").isNotNull()).groupBy("label").agg(
        F.count(F.lit(1)).alias("total"), F.count_if("second_review").alias("reviewed"), F.ceil(F.count(F.lit(1)) * 0.2).alias("required")
    ).withColumn("met", F.col("reviewed") >= F.col("required"))


def rubric_violations(decisions: DataFrame, evidence: DataFrame, recent: dt.date, cutoff: dt.date) -> DataFrame:
    """First rule a reviewed label breaks, from its supporting evidence (decision_id, kind,
    direction, trust_level, origin_id, published_at)."""
    support = F.col("direction") == "support"
    trusted = support & F.col("trust_level").isin("A", "B")
    mature = F.col("kind").isin("standard_adoption", "serial_deployment", "established_market", "infrastructure_adoption")
    wave = support & (F.col("kind") == "publicity_wave") & F.col("published_at").between(F.lit(recent), F.lit(cutoff))
    technical = trusted & F.col("kind").isin("technical_validation", "pilot")
    facts = evidence.groupBy("decision_id").agg(
        F.count_if(trusted & mature).alias("mature"), F.count_if(wave).alias("wave"),
        F.countDistinct(F.when(wave, F.col("origin_id"))).alias("wave_origins"),
        F.countDistinct(F.when(technical, F.col("origin_id"))).alias("technical_origins"),
        F.count_if(support & F.col("kind").isin("pilot", "serial_deployment")).alias("pilots"),
        F.count_if(F.col("published_at") > F.lit(cutoff)).alias("future"),
    )
    rows = decisions.join(facts, "decision_id", "left").na.fill(0)
    hype = F.col("label") == "marketing_hype"
    return rows.select(
        "decision_id", "label",
        first_issue(
            (F.col("future") > 0, "evidence_after_cutoff"),
            (~hype & (F.col("mature") == 0), "mature_without_trusted_evidence"),
            (hype & ((F.col("wave") < 3) | (F.col("wave_origins") < 2)), "no_publicity_wave"),
            (hype & ~(F.col("searched_scientific") & F.col("searched_industry")), "search_incomplete"),
            (hype & (F.col("technical_origins") >= 2), "technical_origins"),
            (hype & (F.col("pilots") > 0), "pilot_or_deployment"),
            (hype & (F.col("mature") > 0), "maturity_evidence"),
        ).alias("violation"),
    )


def search_notes(runs: DataFrame) -> DataFrame:
    """Source classes a run really searched, with status and stop reasons; a class without an
    executed request never counts."""
    good = F.col("status").isin("complete", "partial") & (F.col("requests") > 0)
    stops = F.concat_ws(",", F.array_sort(F.collect_set(F.nullif(F.trim("stop_reason"), F.lit("")))))
    per = runs.groupBy("run_id", "source_class", "status").agg(F.sum("requests").alias("requests"), stops.alias("stops")).where(good)
    note = F.concat(F.col("source_class"), F.lit("="), F.col("status"), F.when(F.col("stops") != "", F.concat(F.lit("("), "stops", F.lit(")"))).otherwise(""))
    noted = per.groupBy("run_id").agg(F.concat_ws(";", F.array_sort(F.collect_set(note))).alias("notes"))
    return runs.select("run_id").distinct().join(noted, "run_id", "left").na.fill("", ["notes"])


def with_fallback(documents: DataFrame, log: DataFrame) -> DataFrame:
    """Documents of the primary provider of a run if it had a success, else of the fallback; then
    the first document of every origin."""
    worked = log.where((F.col("provider") == "primary") & F.col("success")).select("run_id").distinct().withColumn("_p", F.lit(True))
    rows = documents.join(worked, "run_id", "left")
    wanted = F.when(F.col("_p"), "primary").otherwise("fallback")
    kept = rows.where(F.col("provider") == wanted).drop("_p")
    return first_row(kept, ["run_id", "origin_id"], [F.col("request_pos").asc(), F.col("record_index").asc()])


def run_domains(runs: DataFrame, overrides: DataFrame, allowed: list[str]) -> DataFrame:
    """Stored domain if controlled, else the override, else a violation."""
    rows = runs.join(overrides, "run_id", "left")
    chosen = F.when(F.col("domain").isin(allowed), F.col("domain")).when(F.col("override").isin(allowed), F.col("override"))
    return rows.select("run_id", chosen.alias("domain"), chosen.isNull().alias("violation"))
