"""Review suggestions between two corpora of names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tenuis.functions import text as tx

# Words too general to count as common.
GENERIC_WORDS = ["ai", "model", "models", "system", "systems", "technology", "technologies"]


def _forms(names: DataFrame, side: str) -> DataFrame:
    return names.groupBy("form").agg(
        F.countDistinct("candidate_id").alias(f"{side}_candidates")
    ).withColumnRenamed("form", f"{side}_form")


def _word_pairs(forms: DataFrame, column: str, weights: DataFrame, generic: Sequence[str]) -> DataFrame:
    """Pairs of the rarest specific words of a form, for every size its partner may have.

    Jaccard of at least one half between sizes a and b needs t = ceil((a + b) / 3) common words, of which all but the
    form's own generic ones are specific, and at least two. The two rarest of the common specific words are then among the
    first s - m + 2 of a form's s specific words, where m is the larger of 2 and t less its generic words.
    """
    tokens = forms.select(column, F.explode(F.array_distinct(tx.words(F.col(column)))).alias("token"))
    own = tokens.join(weights, "token").groupBy(column).agg(
        F.sort_array(F.collect_list(F.when(~F.col("token").isin(list(generic)), F.struct("weight", "token")))).alias("w"), F.count(F.lit(1)).cast("int").alias("own")
    )
    words = own.select(column, "own", F.transform("w", lambda x: x["token"]).alias("words"))
    sized = words.select(
        column, "own", "words", F.explode(F.sequence(F.ceil(F.col("own") / 2).cast("int"), F.col("own") * 2)).alias("other")
    )
    needed = F.greatest(F.lit(2), F.ceil((F.col("own") + F.col("other")) / 3).cast("int") - (F.col("own") - F.size("words")))
    head = sized.where(F.size("words") >= needed).withColumn("head", F.slice("words", F.lit(1), F.size("words") - needed + 2))
    second = F.explode(F.sequence(F.lit(2), F.size("head"))).alias("second")
    first = head.select(column, "own", "other", "words", "head", second)
    return first.select(
        column, "own", "other", "words", F.explode(F.transform(F.slice("head", F.lit(1), F.col("second") - 1), lambda w: F.concat(w, F.lit(" "), F.element_at("head", F.col("second"))))).alias("pair")
    )


def form_suggestions(left: DataFrame, right: DataFrame, generic: Sequence[str] = GENERIC_WORDS) -> DataFrame:
    """Pairs of normalized forms that are equal, share half of their words (two of them not
    generic), or contain each other.

    Equal forms meet by equality, overlapping forms on the two rarest of their common specific words, where their overlap is
    checked at once, so that each pair is made once; containment uses the rarest five-letter piece of the shorter form.
    Candidates with equal forms are counted, not multiplied out.
    """
    lf, rf = _forms(left, "left"), _forms(right, "right")
    exact = lf.join(rf, F.col("left_form") == F.col("right_form")).select("left_form", "right_form")

    every = lf.select(F.col("left_form").alias("form")).unionByName(
        rf.select(F.col("right_form").alias("form"))
    )
    weights = every.select(F.explode(F.array_distinct(tx.words(F.col("form")))).alias("token")).groupBy(
        "token"
    ).agg(F.count(F.lit(1)).alias("weight"))
    lt = _word_pairs(lf, "left_form", weights, generic).withColumnsRenamed({"own": "ln", "other": "rn", "words": "lw"})
    rt = _word_pairs(rf, "right_form", weights, generic).withColumnsRenamed({"own": "rn", "other": "ln", "words": "rw"})
    both = F.array_intersect("lw", "rw")
    rarest = F.concat(F.get(both, F.lit(0)), F.lit(" "), F.get(both, F.lit(1))) == F.col("pair")
    overlap = lt.join(rt, ["pair", "ln", "rn"]).where((F.size(both) >= 2) & rarest).select("left_form", "right_form")

    contained = _contained(lf, "left_form", rf, "right_form").unionByName(
        _contained(rf, "right_form", lf, "left_form")
    )
    pairs = exact.unionByName(overlap).unionByName(contained).distinct()
    a, b = tx.words(F.col("left_form")), tx.words(F.col("right_form"))
    common = F.array_intersect(a, b)
    jaccard = F.size(common) / F.size(F.array_union(a, b))
    specific = F.size(F.filter(common, lambda word: ~word.isin(list(generic))))
    shorter = F.least(F.length("left_form"), F.length("right_form"))
    inside = (shorter >= 5) & (
        F.contains("left_form", F.col("right_form")) | F.contains("right_form", F.col("left_form"))
    )
    trigger = F.when(F.col("left_form") == F.col("right_form"), "exact").when(
        ((specific >= 2) & (jaccard >= 0.5)) | inside, "fuzzy"
    )
    return (
        pairs.withColumns({"trigger": trigger, "token_jaccard": F.round(jaccard, 6)})
        .where(F.col("trigger").isNotNull())
        .join(lf, "left_form")
        .join(rf, "right_form")
    )


def _pieces(forms: DataFrame, column: str) -> DataFrame:
    starts = F.sequence(F.lit(1), F.length(column) - 4)
    return forms.where(F.length(column) >= 5).select(
        column,
        F.explode(F.array_distinct(F.transform(starts, lambda i: F.substring(F.col(column), i, F.lit(5))))).alias("piece"),
    )


def _contained(short: DataFrame, inner: str, long: DataFrame, outer: str) -> DataFrame:
    pieces = _pieces(long, outer)
    frequency = pieces.groupBy("piece").agg(F.count(F.lit(1)).alias("n"))
    rarest = (
        _pieces(short, inner)
        .join(frequency, "piece")
        .groupBy(inner)
        .agg(F.min_by("piece", F.struct("n", "piece")).alias("piece"))
    )
    return (
        rarest.join(pieces, "piece")
        .where(F.contains(F.col(outer), F.col(inner)))
        .select("left_form", "right_form")
    )


def best_trigger(pairs: DataFrame, names: DataFrame, suggestions: DataFrame) -> DataFrame:
    """Best suggestion of given candidate pairs over all their forms; none means manual."""
    l = names.select(F.col("candidate_id").alias("left_candidate_id"), F.col("form").alias("left_form"))
    r = names.select(F.col("candidate_id").alias("right_candidate_id"), F.col("form").alias("right_form"))
    scored = (
        pairs.join(l, "left_candidate_id").join(r, "right_candidate_id")
        .join(suggestions, ["left_form", "right_form"])
    )
    best = scored.groupBy("left_candidate_id", "right_candidate_id").agg(
        F.max(F.struct((F.col("trigger") == "exact").cast("int").alias("p"), "token_jaccard", "left_form", "right_form", "trigger")).alias("b")
    )
    return pairs.join(best, ["left_candidate_id", "right_candidate_id"], "left").withColumn(
        "trigger", F.coalesce("b.trigger", F.lit("manual"))
    ).withColumn("token_jaccard", F.col("b.token_jaccard")).drop("b")


def review_totals(decisions: DataFrame) -> DataFrame:
    out = [F.count(F.lit(1)).alias("pairs")]
    out += [F.count_if(F.col("trigger") == name).alias(name) for name in ("exact", "fuzzy", "manual")]
    out += [
        F.count_if(F.col("relation") == name).alias(name)
        for name in ("same_candidate", "same_family", "distinct")
    ]
    return decisions.agg(*out).withColumn("ready_for_model", F.col("same_candidate") == 0)
