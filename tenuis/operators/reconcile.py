"""Tables held against one another: duplicates against the queue, decisions against their targets, declared evidence input
against its documents, reviewed identities against a selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenuis.functions.ids import digest_id
from tenuis.functions.text import identity_key
from tenuis.session import stored
from tenuis.sources.quarantine import first_issue


# Duplicates as noise

def first_addresses(group_documents: DataFrame, documents: DataFrame) -> DataFrame:
    """group_id, url: of the first document of a group (group_id, run_id, pos, document_id) whose address isn't blank."""
    named = documents.where(F.coalesce(F.trim("url"), F.lit("")) != "").select("run_id", "document_id", F.trim("url").alias("url"))
    found = group_documents.join(named, ["run_id", "document_id"])
    return found.groupBy("group_id").agg(F.min_by("url", F.struct("pos", "document_id")).alias("url"))


def duplicate_outcomes(proposals: DataFrame, queued: DataFrame, addresses: DataFrame, noise_slots: DataFrame) -> DataFrame:
    """Every spelling duplicate with what becomes of it.

    proposals: group_id, canonical_name, primary_group_id, run_id, domain; queued: group_id, candidate_id. A duplicate is
    `moved` to the noise pool if its primary group got a candidate, its name isn't blank, one of its documents has an
    address, and there is a duplicate slot at all. Else it is dropped with the first reason that holds, or `waits` where
    only the slot is missing. Each proposal has one outcome."""
    primary = queued.select(F.col("group_id").alias("primary_group_id"), "candidate_id").dropDuplicates(["primary_group_id"])
    any_slot = noise_slots.agg(F.coalesce(F.bool_or(F.col("noise_type") == "duplicate"), F.lit(False))).scalar()
    rows = proposals.join(primary, "primary_group_id", "left").join(addresses, "group_id", "left")
    blank = F.coalesce(F.trim("canonical_name"), F.lit("")) == ""
    reason = first_issue((F.col("candidate_id").isNull(), "primary_not_queued"), (blank, "blank_text"), (F.col("url").isNull(), "no_url"))
    return rows.withColumn("outcome", F.coalesce(reason, F.when(any_slot, "moved").otherwise("waits")))


def duplicate_pool(outcomes: DataFrame, suggestions: DataFrame, queued: DataFrame, aliases: DataFrame, addresses: DataFrame) -> DataFrame:
    """The pool of duplicate controls from its three sources, each with the candidate it doubles.

    Alias suggestions (text, url, domain, pos, primary_group_id) keep their place even if their primary is not queued; moved
    duplicates; aliases (group_id, alias, pos, domain) of queued groups with an address."""
    primary = queued.select(F.col("group_id").alias("primary_group_id"), "candidate_id").dropDuplicates(["primary_group_id"])
    columns = ["text", "url", "domain", "pos", "origin_kind", "duplicate_of"]
    suggested = suggestions.join(primary, "primary_group_id", "left").withColumns({"origin_kind": F.lit("alias_suggestion"), "duplicate_of": F.col("candidate_id")})
    moved = outcomes.where(F.col("outcome") == "moved").withColumns(
        {"text": F.trim("canonical_name"), "pos": F.col("group_id"), "origin_kind": F.lit("candidate_duplicate"), "duplicate_of": F.col("candidate_id")}
    )
    named = aliases.join(addresses, "group_id").join(primary.withColumnRenamed("primary_group_id", "group_id"), "group_id").withColumns(
        {"text": F.col("alias"), "origin_kind": F.lit("candidate_alias"), "duplicate_of": F.col("candidate_id")}
    )
    return suggested.select(*columns).unionByName(moved.select(*columns)).unionByName(named.select(*columns))


def remaining_overflow(overflow: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Overflow (kind, key, run_id) without the duplicates that moved to the pool."""
    moved = outcomes.where(F.col("outcome") == "moved").select(F.lit("candidate_duplicate").alias("kind"), F.col("group_id").alias("key"), "run_id")
    return overflow.join(moved, ["kind", "key", "run_id"], "left_anti")


# Proposals from groundings

def grounded_members(groundings: DataFrame, documents: DataFrame, scope_id: str) -> DataFrame:
    """proposal_id, candidate_id, set, member: the mentions, documents, origins, connectors and source kinds of a candidate.

    groundings: candidate_id, document_id, term_role, term, location, start, end; only canonical matches count. Of the
    documents of a candidate with one identity (DOI, else address) the smallest id stands for all. Members are distinct
    rows, never arrays, so a candidate of any size is spread over tasks."""
    canonical = groundings.where(F.col("term_role") == "canonical")
    identity = F.lower(F.trim(F.coalesce("doi", "canonical_url")))
    about = documents.select("document_id", identity.alias("_identity"), "origin_id", "connector")
    rows = stored(canonical.join(about, "document_id"), "grounded")
    kept = rows.groupBy("candidate_id", "_identity").agg(F.min("document_id").alias("document_id")).select("candidate_id", "document_id").distinct()
    locator = F.concat("location", F.lit("["), "start", F.lit(":"), "end", F.lit("]"))
    values = {
        "mention": digest_id("mention-", F.col("document_id"), locator, F.col("term")), "document": F.col("document_id"), "origin": F.col("origin_id"),
        "connector": F.col("connector"), "source_kind": F.when(F.col("location") == "title", "title").otherwise("excerpt"),
    }
    pairs = F.explode(F.array(*[F.struct(F.lit(name).alias("set"), value.alias("member")) for name, value in values.items()])).alias("m")
    members = rows.join(stored(kept, "kept"), ["candidate_id", "document_id"], "left_semi").select("candidate_id", pairs).select("candidate_id", "m.*")
    return members.where(F.col("member").isNotNull()).distinct().select(digest_id("proposal-", F.lit(scope_id), F.col("candidate_id")).alias("proposal_id"), "candidate_id", "set", "member")


_SETS = ("mention", "document", "origin", "connector", "source_kind")


def grounded_proposals(candidates: DataFrame, members: DataFrame) -> DataFrame:
    """One row per candidate with canonical groundings: sizes of its sets, and their digests as sums of member digests."""
    part = F.conv(F.substring(F.sha2("member", 256), 1, 15), 16, 10).cast("decimal(38,0)")
    out = []
    for name in _SETS:
        own = F.col("set") == name
        out += [F.count_if(own).alias(f"{name}s"), F.sum(F.when(own, part)).cast("string").alias(f"_{name}")]
    sums = members.groupBy("proposal_id", "candidate_id").agg(*out)
    digests = [F.sha2(F.concat_ws("|", F.col(f"{n}s"), F.col(f"_{n}")), 256).alias(f"{n}s_digest") for n in ("mention", "document", "origin")]
    return sums.join(candidates, "candidate_id").select(
        "proposal_id", "candidate_id", "canonical_name", identity_key(F.col("canonical_name")).alias("normalized_name"), *[f"{n}s" for n in _SETS], *digests
    )


# Review decisions

# What a decision may say.
MODEL_LABELS = ["mature", "marketing_hype"]
NOISE_TYPES = ["broad_concept", "irrelevant", "not_technology", "extraction_error", "duplicate"]
REVIEW_ROUNDS = ["primary", "secondary", "adjudication"]
REVIEW_STATUSES = ["draft", "reviewed", "adjudicated"]
SEARCH_CLASSES = ["scientific", "official", "industry"]


def _listed(value: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(value, F.lit("")), ";"), lambda v: F.trim(v)), lambda v: v != "")


def typed_decisions(rows: DataFrame) -> DataFrame:
    """Raw rows of a decision sheet as typed decisions, with the first rule each breaks.

    All cells are text: decision_id, subject_type, subject_id, review_round, status, model_label, noise_type, rationale,
    reviewer_id, annotated_at, cutoff_date, evidence_ids, search_queries, search_source_classes, searched_at, search_notes."""
    cell = {name: F.nullif(F.trim(F.col(name)), F.lit("")) for name in rows.columns}
    lists = {name: _listed(F.col(name)) for name in ("evidence_ids", "search_queries", "search_source_classes")}
    dates = {name: F.try_to_date(name, "yyyy-MM-dd") for name in ("annotated_at", "cutoff_date", "searched_at")}
    typed = rows.withColumns(cell | lists | {f"_{name}": value for name, value in dates.items()})
    uses = typed.groupBy("decision_id").agg(F.count(F.lit(1)).alias("_uses")).where(F.col("_uses") > 1).select("decision_id", F.lit(True).alias("_repeated"))
    model = F.col("subject_type") == "model_candidate"
    noise = F.col("subject_type") == "noise_control"
    needed = ["decision_id", "subject_type", "subject_id", "review_round", "status", "rationale", "reviewer_id", "annotated_at", "cutoff_date"]
    missing = [F.col(name).isNull() for name in needed]
    blank = missing[0]
    for one in missing[1:]:
        blank = blank | one
    bad_date = F.col("_annotated_at").isNull() | F.col("_cutoff_date").isNull() | (F.col("searched_at").isNotNull() & F.col("_searched_at").isNull())
    outside = lambda name, values: ~F.coalesce(F.col(name).isin(values), F.lit(False))
    searched = (F.size("search_queries") > 0) | (F.size("search_source_classes") > 0) | F.col("searched_at").isNotNull()
    unknown_class = F.exists("search_source_classes", lambda c: ~c.isin(SEARCH_CLASSES))
    out = typed.join(stored(uses, "uses"), "decision_id", "left").withColumn(
        "violation",
        first_issue(
            (blank, "blank_cell"), (bad_date, "bad_date"), (F.col("_repeated"), "repeated_decision"), (~model & ~noise, "unknown_subject_type"),
            (outside("review_round", REVIEW_ROUNDS), "unknown_round"), (outside("status", REVIEW_STATUSES), "unknown_status"),
            (model & F.col("noise_type").isNotNull(), "noise_type_of_model"), (model & outside("model_label", MODEL_LABELS), "unknown_label"),
            (model & searched & F.col("searched_at").isNull(), "missing_searched_at"), (model & unknown_class, "unknown_search_class"), (model & searched & F.col("search_notes").isNull(), "missing_search_notes"),
            (noise & F.col("model_label").isNotNull(), "label_of_noise"), (noise & (F.size("evidence_ids") > 0), "evidence_of_noise"), (noise & outside("noise_type", NOISE_TYPES), "unknown_noise_type"),
        ),
    )
    return out.select(*[c for c in rows.columns if c not in dates], *[F.col(f"_{name}").alias(name) for name in dates], "violation")


def decision_references(decisions: DataFrame, candidates: DataFrame, noise: DataFrame, evidence: DataFrame) -> DataFrame:
    """Every reference of valid decisions, resolved or dangling: decision_id, target, target_id, resolution.

    Three target tables are one tagged table and three kinds of references one list of rows, so one join resolves all. A
    reference is `resolved`, `unknown` (no such row; for evidence: not verified) or `foreign` (evidence of another candidate).
    candidates: candidate_id; noise: noise_id; evidence: evidence_id, candidate_id, status."""
    kind = F.when(F.col("subject_type") == "model_candidate", "candidate").otherwise("noise")
    good = decisions.where(F.col("violation").isNull()).select("decision_id", kind.alias("kind"), "subject_id", "evidence_ids")
    references = good.select("decision_id", F.col("kind").alias("target"), F.col("subject_id").alias("target_id"), F.lit(None).cast("string").alias("subject_id")).unionByName(
        good.select("decision_id", F.lit("evidence").alias("target"), F.explode("evidence_ids").alias("target_id"), "subject_id")
    )
    targets = candidates.select(F.lit("candidate").alias("target"), F.col("candidate_id").alias("target_id"), F.lit(None).cast("string").alias("owner")).unionByName(
        noise.select(F.lit("noise").alias("target"), F.col("noise_id").alias("target_id"), F.lit(None).cast("string").alias("owner"))
    ).unionByName(evidence.where(F.col("status") == "verified").select(F.lit("evidence").alias("target"), F.col("evidence_id").alias("target_id"), F.col("candidate_id").alias("owner")))
    unique = stored(targets.groupBy("target", "target_id").agg(F.min("owner").alias("owner")).withColumn("there", F.lit(True)), "targets")
    joined = references.join(unique, ["target", "target_id"], "left")
    foreign = (F.col("target") == "evidence") & (F.col("owner") != F.col("subject_id"))
    resolution = F.when(F.col("there").isNull(), "unknown").when(foreign, "foreign").otherwise("resolved")
    return joined.select("decision_id", "target", "target_id", resolution.alias("resolution"))


def linked_evidence(references: DataFrame, evidence: DataFrame) -> DataFrame:
    """Resolved evidence of decisions with its attributes."""
    found = references.where((F.col("target") == "evidence") & (F.col("resolution") == "resolved")).select("decision_id", F.col("target_id").alias("evidence_id"))
    return found.join(evidence.where(F.col("status") == "verified").drop("status"), "evidence_id")


def undecided(references: DataFrame, candidates: DataFrame, noise: DataFrame) -> DataFrame:
    """Candidates and noise controls that no valid decision is about."""
    every = candidates.select(F.lit("candidate").alias("target"), F.col("candidate_id").alias("target_id")).unionByName(
        noise.select(F.lit("noise").alias("target"), F.col("noise_id").alias("target_id"))
    )
    return every.distinct().join(references.where(F.col("resolution") == "resolved"), ["target", "target_id"], "left_anti")


# Evidence input

# Connectors by source class.
CLASS_CONNECTORS = {"scientific": ["openalex"], "industry": ["mediacloud", "exa"]}
MOST_DOCUMENTS = 6


def broken_documents(documents: DataFrame, cutoff: str) -> DataFrame:
    """candidate_id, document_id, violation: rows of the evidence input that break a rule of their own, and repeated pairs."""
    text = lambda name: F.coalesce(F.trim(name), F.lit("")) == ""
    outside = lambda name, values: ~F.coalesce(F.col(name).isin(values), F.lit(False))
    wrong_connector = F.lit(False)
    for source_class, connectors in CLASS_CONNECTORS.items():
        wrong_connector = wrong_connector | ((F.col("source_class") == source_class) & outside("connector", connectors))
    rules = [
        (text("candidate_id") | text("document_id"), "blank_key"), (outside("source_class", list(CLASS_CONNECTORS)), "unknown_class"), (wrong_connector, "connector_differs"),
        (~F.coalesce("evidence_text_available", F.lit(False)), "text_not_available"), (text("excerpt"), "blank_excerpt"), (text("title") | text("origin_id") | text("matched_term"), "blank_text"),
        (~F.coalesce(F.trim("url").rlike("^https?://[^ ]+$"), F.lit(False)), "bad_url"), (~F.coalesce(F.col("relevance_score").between(0, 100), F.lit(False)), "bad_score"),
        (outside("relevance_class", ["strong", "weak"]), "bad_relevance_class"), (outside("trust_tier", ["A", "B", "C", "D", "unknown"]), "bad_trust_tier"),
        (F.col("published_at") > F.lit(cutoff).cast("date"), "after_cutoff"),
    ]
    own = documents.withColumn("violation", first_issue(*rules)).where(F.col("violation").isNotNull()).select("candidate_id", "document_id", "violation")
    repeated = documents.groupBy("candidate_id", "document_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    return own.unionByName(repeated.select("candidate_id", "document_id", F.lit("repeated_pair").alias("violation")))


def broken_input(coverage: DataFrame, documents: DataFrame) -> DataFrame:
    """candidate_id, violation: what coverage declares, against what its documents show, one row per broken rule.

    coverage: candidate_id, has_evidence_input, final_evidence_input_count, scientific_selected, media_selected,
    source_classes_present. Both sides are aggregated to one row per candidate and compared by a full outer join. Ranks 1..N
    without gaps or repeats are a bit pattern (at most MOST_DOCUMENTS of them are legal), so nothing is gathered or sorted."""
    rank = F.col("final_rank")
    legal = F.coalesce(rank.between(1, MOST_DOCUMENTS), F.lit(False))
    shown = documents.groupBy("candidate_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("source_class") == "scientific").alias("n_scientific"), F.count_if(F.col("source_class") == "industry").alias("n_industry"),
        F.bit_or(F.when(legal, F.call_function("shiftleft", F.lit(1), (rank - 1).cast("int"))).otherwise(0)).alias("bits"), F.count_if(~legal).alias("bad_ranks"),
    )
    numbers = ["final_evidence_input_count", "scientific_selected", "media_selected"]
    classes = F.array_sort("source_classes_present")
    declared = coverage.withColumn("_row", F.struct("has_evidence_input", *[F.col(n).cast("long").alias(n) for n in numbers], classes.alias("classes"))).groupBy("candidate_id").agg(
        F.count(F.lit(1)).alias("rows"), F.min("_row").alias("r")
    ).select("candidate_id", "rows", "r.*")
    both = declared.join(shown, "candidate_id", "full")
    known, has, final = F.col("rows").isNotNull(), F.col("has_evidence_input"), F.col("final_evidence_input_count")
    n = F.coalesce("n", F.lit(0))
    science, media = F.col("scientific_selected"), F.col("media_selected")
    actual = F.array_compact(F.array(F.when(F.col("n_industry") > 0, "industry"), F.when(F.col("n_scientific") > 0, "scientific")))
    valid = has.isNotNull() & (final >= 0) & (science >= 0) & (media >= 0) & F.col("classes").isNotNull()
    valid = known & F.coalesce(valid, F.lit(False))
    rules = [
        (~known, "unknown_candidate"), (F.col("rows") > 1, "repeated_candidate"), (known & ~valid, "bad_declaration"),
        (valid & (science + media != final), "counts_disagree"), (valid & ((final > 0) != has), "flag_disagrees"),
        (valid & (F.exists("classes", lambda c: F.coalesce(~c.isin(list(CLASS_CONNECTORS)), F.lit(True))) | (F.size(F.array_distinct("classes")) < F.size("classes"))), "bad_classes"),
        (valid & ~has & (n > 0), "documents_without_input"), (valid & has & (n == 0), "input_without_documents"),
        (valid & ~has & ((final != 0) | (science != 0) | (media != 0) | (F.size("classes") > 0)), "no_input_not_empty"),
        (valid & has & ~final.between(1, MOST_DOCUMENTS), "count_out_of_range"), (valid & has & (n > 0) & (final != n), "count_differs"),
        (valid & has & (n > 0) & ((science != F.col("n_scientific")) | (media != F.col("n_industry"))), "class_counts_differ"),
        (valid & has & (n > 0) & (F.col("classes") != actual), "classes_differ"),
        ((n > MOST_DOCUMENTS), "too_many_documents"), (known & (n.between(1, MOST_DOCUMENTS)) & ((F.col("bad_ranks") > 0) | (F.col("bits") != F.call_function("shiftleft", F.lit(1), n.cast("int")) - 1)), "ranks_broken"),
    ]
    found = F.array_compact(F.array(*[F.when(F.coalesce(rule, F.lit(False)), code) for rule, code in rules]))
    return both.select("candidate_id", F.explode(found).alias("violation"))


# Reviewed identities

def selected_identities(selected: DataFrame, identities: DataFrame) -> DataFrame:
    """candidate_id, group_id, violation of selected candidates (candidate_id, canonical_name): the reviewed identity, or the
    first rule it breaks. identities: candidate_id, identity_status, canonical_name, group_id."""
    one = identities.groupBy("candidate_id").agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct("identity_status", F.col("canonical_name").alias("name"), "group_id")).alias("i"))
    rows = selected.join(one, "candidate_id", "left")
    issue = first_issue(
        (F.col("i").isNull(), "missing_identity"), (F.col("_n") > 1, "repeated_identity"), (~F.col("i.identity_status").eqNullSafe("reviewed"), "not_reviewed"),
        (~F.col("i.name").eqNullSafe(F.col("canonical_name")), "name_differs"), (~F.coalesce(F.startswith("i.group_id", F.lit("cross-corpus-")), F.lit(False)), "bad_group"),
    )
    return rows.withColumn("violation", issue).select("candidate_id", F.when(F.col("violation").isNull(), F.col("i.group_id")).alias("group_id"), "violation")


def selection_conflicts(decisions: DataFrame, selected: DataFrame, ends: Sequence[str] = ("left_candidate_id", "right_candidate_id")) -> DataFrame:
    """Pairs decided to be the same candidate of which both are selected. The selection is stored once for both semi-joins."""
    ids = stored(selected.select("candidate_id").distinct(), "selected")
    same = decisions.where(F.col("relation") == "same_candidate")
    for end in ends:
        same = same.join(ids.withColumnRenamed("candidate_id", end), end, "left_semi")
    return same.select(*ends)


def selection_readiness(conflicts: DataFrame) -> DataFrame:
    return conflicts.agg(F.count(F.lit(1)).alias("conflicts")).withColumn("ready", F.col("conflicts") == 0)
