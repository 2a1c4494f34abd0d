"""Quotes of claims looked up in their documents."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenuis.session import stored
from tenuis.sources.quarantine import first_issue

#: Claims of one document looked up by one task; more are dealt over several copies of its text.
SLICE = 50_000
#: Characters of quotes in one automaton.
BLOCK_CHARACTERS = 8_000_000


class _Lookup:
    """Places of quotes in one text, by one pass over it for each block of quotes."""

    def __init__(self, text: str | None):
        self.text, self.waiting, self.size = text, {}, 0

    def add(self, quote: str, row: tuple) -> bool:
        """True when the block is full."""
        rows = self.waiting.setdefault(quote, [])
        if not rows:
            self.size += len(quote)
        rows.append(row)
        return self.size >= BLOCK_CHARACTERS or len(self.waiting) >= SLICE

    def flush(self) -> Iterator[tuple]:
        """The waiting rows with the first place of their quote; -1 where the text lacks it, None without a text."""
        import ahocorasick

        found: dict[str, int] = {}
        if self.text is not None and self.waiting:
            machine = ahocorasick.Automaton()
            for quote in self.waiting:
                machine.add_word(quote, quote)
            machine.make_automaton()
            for end, quote in machine.iter(self.text):
                if quote not in found:
                    found[quote] = end + 1 - len(quote)
                    if len(found) == len(self.waiting):
                        break
        missing = None if self.text is None else -1
        for quote, rows in self.waiting.items():
            for row in rows:
                yield (*row, found.get(quote, missing))
        self.waiting, self.size = {}, 0


def located(claims: DataFrame, documents: DataFrame, keys: Sequence[str], claim: str = "claim_id", quote: str = "quote", text: str = "excerpt") -> DataFrame:
    """claim and keys of every claim, and `start`: the first place of its quote in its document's text, in characters.

    Null where there is no document (or quote), -1 where the text does not hold the quote. Each text moves once and is
    read once for all quotes of its document. A document with more than SLICE claims is dealt over copies of its text, by
    a hash of the claim, so no task gets an unbounded number of claims; claims stream past the text in sorted order and
    are never gathered. A key that several documents share takes the longest text, then the first in order.
    """
    keys = list(keys)
    asked = claims.select(*keys, F.col(claim).alias("_claim"), F.col(quote).alias("_value"))
    many = asked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SLICE)
    slices = stored(many.select(*keys, F.ceil(F.col("n") / SLICE).cast("int").alias("_slices")), "slices")
    dealt = asked.join(slices, keys, "left").withColumn("_slice", F.pmod(F.xxhash64("_claim", "_value"), F.coalesce("_slices", F.lit(1))).cast("int"))
    longest = documents.groupBy(*keys).agg(F.max_by(text, F.struct(F.length(text), text)).alias("_value"))
    copies = longest.join(slices, keys, "left").withColumn("_slice", F.explode(F.sequence(F.lit(0), F.coalesce("_slices", F.lit(1)) - 1)))
    columns = [*keys, "_slice", "_kind", "_claim", "_value"]
    texts = copies.withColumns({"_kind": F.lit(0), "_claim": F.lit(None).cast(claims.schema[claim].dataType)}).select(*columns)
    rows = texts.unionByName(dealt.withColumn("_kind", F.lit(1)).select(*columns))
    group = [*keys, "_slice"]
    ordered = rows.repartition(*group).sortWithinPartitions(*group, "_kind")
    out = T.StructType([*[claims.schema[k] for k in keys], T.StructField("_claim", claims.schema[claim].dataType), T.StructField("start", T.LongType())])
    width = len(keys)

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(out)
        current, lookup, done = None, _Lookup(None), []

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)

        for part in batches:
            for row in zip(*(c.to_pylist() for c in part.columns), strict=True):
                key, kind, name, value = row[: width + 1], row[width + 1], row[width + 2], row[width + 3]
                if key != current:
                    done += lookup.flush()
                    current, lookup = key, _Lookup(value if kind == 0 else None)
                if kind == 1:
                    if not value:
                        done.append((*key[:width], name, None))
                    elif lookup.add(value, (*key[:width], name)):
                        done += lookup.flush()
            if len(done) >= 10_000:
                yield batch()
                done = []
        done += lookup.flush()
        if done:
            yield batch()

    return ordered.mapInArrow(run, out).withColumnRenamed("_claim", claim)


def checked_claims(candidates: DataFrame, claims: DataFrame, documents: DataFrame) -> DataFrame:
    """Every claim with its locator, or the first rule it breaks: identity, a quote that its document holds word for word,
    scope, direction, kind, explanation. claims: claim_id, candidate_id, document_id, quote, scope, direction, kind,
    explanation_ru; documents: candidate_id, document_id, excerpt. Repeated claim ids are all invalid."""
    keys = ["candidate_id", "document_id"]
    rows = claims.withColumn("_n", F.monotonically_increasing_id())
    rows = stored(rows, "claims")
    repeated = rows.groupBy("claim_id").agg(F.count(F.lit(1)).alias("_uses")).where(F.col("_uses") > 1).select("claim_id", F.lit(True).alias("_repeated"))
    known = candidates.select("candidate_id", F.lit(True).alias("_known")).distinct()
    places = located(rows, documents, keys, "_n").select("_n", "start")
    full = rows.join(places, "_n").join(stored(repeated, "repeated"), "claim_id", "left").join(known, "candidate_id", "left")
    blank = lambda name: F.coalesce(F.col(name), F.lit("")) == ""
    outside = lambda name, *values: ~F.coalesce(F.col(name).isin(*values), F.lit(False))
    issue = first_issue(
        (F.col("_known").isNull(), "unknown_candidate"), (blank("claim_id") | F.col("_repeated") | blank("quote") | F.col("document_id").isNull(), "invalid_identity"),
        (F.col("start").isNull(), "unknown_document"), (F.col("start") < 0, "not_verbatim"), (outside("scope", "full_candidate", "core_only"), "invalid_scope"),
        (outside("direction", "support", "counter"), "invalid_direction"), (F.col("kind").isNull(), "invalid_kind"), (F.col("explanation_ru").isNull(), "no_explanation"),
    )
    return full.withColumn("violation", issue).select(
        "claim_id", *keys, "violation", F.when(F.col("violation").isNull(), excerpt_locator(F.col("start"), F.col("quote"))).alias("locator")
    )


def excerpt_locator(start: Column, quote: Column) -> Column:
    return F.concat(F.lit("excerpt["), start, F.lit(":"), start + F.length(quote), F.lit("]"))


# Discovery answers

# Kinds and directions of a discovery claim, and the bounds of an answer.
DISCOVERY_KINDS = [
    "novelty", "growth", "research", "patent", "prototype", "pilot", "investment", "adoption", "standard", "market", "promotional_claim",
]
DIRECTIONS = ["support", "counter"]
MAX_CLAIMS = 3
MAX_DOCUMENTS = 4
_CLAIM_NAMES = ["quote", "kind", "direction"]
_RECORD_NAMES = ["alias_group_id", "document_id", "claims"]


def _names_are(text: Column, names: Sequence[str]) -> Column:
    found = F.json_object_keys(text)
    return F.coalesce((F.size(found) == len(names)) & (F.size(F.array_except(found, F.array(*[F.lit(n) for n in names]))) == 0), F.lit(False))


def _is_string(text: Column, name: str) -> Column:
    """The value is a JSON string: as a variant it has that type."""
    return F.coalesce(F.schema_of_variant(F.try_variant_get(F.try_parse_json(text), f"$.{name}", "variant")) == "STRING", F.lit(False))


def discovery_answers(asked: DataFrame, answers: DataFrame, kinds: Sequence[str] = DISCOVERY_KINDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(claims, coverage, issues) of answers about batches of (candidate group, document) pairs.

    asked: batch_id, alias_group_id, document_id, origin_id, canonical_url, excerpt. answers: batch_id, payload. An answer that
    is not of the agreed form (JSON, one `documents` list of at most MAX_DOCUMENTS records with exactly the agreed fields
    and at most MAX_CLAIMS claims) is void as a whole: `invalid_response`, and all its pairs have failed. In a valid
    answer unknown pairs and repeated ones are issues, pairs left out have failed, and each claim of a pair's first record
    is valid or names its issue: fields, kind, direction, a quote of 20 to 500 characters that the excerpt holds, not
    given before. The verdict on an answer is one row per batch, joined back; claims are never gathered.
    """
    keys = ["batch_id", "alias_group_id", "document_id"]
    one = answers.groupBy("batch_id").agg(F.min("payload").alias("payload"))
    doc = F.try_parse_json("payload")
    listed = F.try_variant_get(doc, "$.documents", "array<variant>")
    parsed = asked.select("batch_id").distinct().join(one, "batch_id", "left").select(
        "batch_id", F.when(_names_are(F.col("payload"), ["documents"]), listed).alias("records")
    )
    records = stored(
        parsed.select("batch_id", F.col("records").isNull().alias("broken"), F.size("records").alias("n"), F.posexplode_outer("records").alias("place", "record")).select(
            "batch_id", "broken", "n", "place", F.to_json("record").alias("record")
        ),
        "records",
    )
    claims_of = F.try_variant_get(F.try_parse_json("record"), "$.claims", "array<variant>")
    fields = records.where(F.col("record").isNotNull()).select(
        "batch_id", "place", _names_are(F.col("record"), _RECORD_NAMES).alias("named"), (_is_string(F.col("record"), "alias_group_id") & _is_string(F.col("record"), "document_id")).alias("ids"),
        F.get_json_object("record", "$.alias_group_id").alias("alias_group_id"), F.get_json_object("record", "$.document_id").alias("document_id"),
        F.transform(claims_of, lambda c: F.to_json(c)).alias("claims"),
    )
    bad = ~F.col("named") | ~F.col("ids") | F.coalesce(F.size("claims") > MAX_CLAIMS, F.lit(True))
    bad_records = fields.where(F.col("claims").isNull() | bad).select("batch_id").distinct().withColumn("bad", F.lit(True))
    verdict = records.groupBy("batch_id").agg(F.bool_or("broken").alias("broken"), F.max("n").alias("n")).join(bad_records, "batch_id", "left")
    valid = verdict.select("batch_id", (~F.col("broken") & (F.col("n") <= MAX_DOCUMENTS) & F.col("bad").isNull()).alias("valid"))
    valid = stored(valid, "verdicts")
    good = fields.join(valid.where("valid"), "batch_id", "left_semi").drop("named", "ids")

    first = good.groupBy(*keys).agg(F.min("place").alias("_first"))
    places = good.join(first, keys).join(asked.select(*keys, F.lit(True).alias("_asked")).distinct(), keys, "left")
    places = stored(places, "places")
    read = places.where(F.col("_asked") & (F.col("place") == F.col("_first")))
    wrong = places.select(*keys, F.when(F.col("_asked").isNull(), "unknown_document").when(F.col("place") > F.col("_first"), "duplicate_document").alias("code"))
    covered = asked.select(*keys).distinct().join(read.select(*keys, F.lit(True).alias("_read")), keys, "left")
    coverage = covered.select(*keys, F.when(F.col("_read"), "processed").otherwise("model_failed").alias("status"))
    missing = covered.where(F.col("_read").isNull()).join(valid.where("valid"), "batch_id", "left_semi").select(*keys, F.lit("missing_document").alias("code"))
    void = valid.where(~F.col("valid")).select("batch_id", F.lit(None).cast("string").alias("alias_group_id"), F.lit(None).cast("string").alias("document_id"), F.lit("invalid_response").alias("code"))

    c = F.col("claim")
    given = read.select(*keys, "place", F.posexplode("claims").alias("position", "claim")).select(
        *keys, "place", "position", (_names_are(c, _CLAIM_NAMES) & F.get_json_object(c, "$.kind").isin(*kinds) & F.get_json_object(c, "$.direction").isin(*DIRECTIONS) & _is_string(c, "quote")).alias("formed"),
        F.get_json_object(c, "$.quote").alias("quote"), F.get_json_object(c, "$.kind").alias("kind"), F.get_json_object(c, "$.direction").alias("direction"),
    ).withColumn("_n", F.monotonically_increasing_id())
    given = stored(given, "given")
    fits = F.coalesce(F.col("formed"), F.lit(False)) & F.length("quote").between(20, 500)
    found = located(given.where(fits), asked, keys, "_n").select("_n", "start")
    digest = F.concat(F.lit("claim-"), F.substring(F.sha2(F.concat_ws("|", "alias_group_id", "document_id", "kind", "direction", "quote"), 256), 1, 20))
    judged = given.join(found, "_n", "left").withColumn(
        "code", F.when(~fits, "invalid_claim").when(F.coalesce(F.col("start"), F.lit(-1)) < 0, "non_verbatim")
    ).withColumn("claim_id", F.when(F.col("code").isNull(), digest))
    judged = stored(judged, "judged")
    earliest = judged.where(F.col("code").isNull()).groupBy("claim_id").agg(F.min(F.struct("batch_id", "place", "position")).alias("_e"))
    ranked = judged.join(earliest, "claim_id", "left")
    again = F.col("code").isNull() & (F.struct("batch_id", "place", "position") != F.col("_e"))
    ranked = ranked.withColumn("code", F.when(again, "duplicate_claim").otherwise(F.col("code")))
    about = asked.select(*keys, "origin_id", "canonical_url").dropDuplicates(keys)
    claims = ranked.where(F.col("code").isNull()).join(about, keys).select(
        *keys, "claim_id", "origin_id", "canonical_url", "kind", "direction", "quote", excerpt_locator(F.col("start"), F.col("quote")).alias("locator")
    )
    issues = wrong.where(F.col("code").isNotNull()).unionByName(missing).unionByName(void).unionByName(ranked.where(F.col("code").isNotNull()).select(*keys, "code"))
    return claims, coverage, issues
