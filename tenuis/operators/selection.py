"""Diversity-aware selection of a few documents per candidate.

The choice itself is sequential, but only a bounded kernel of every group can ever be chosen.
The kernel is cut exactly with ranking windows, first inside salted slices of a group and then
over what the slices left, so neither a task nor the selection step sees a whole hot group.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tenuis.operators.ranking import top_k, trust_rank

SALTS = 32
_SCHEMA = "candidate_id string, document_id string, selection_rank int, selection_reason string"


def document_order() -> list[Column]:
    """Score, trust tier, dated before undated, newest first, identity, id."""
    return [
        F.col("score").desc(),
        trust_rank(F.col("trust_tier")).asc(),
        F.col("published_at").desc_nulls_last(),
        F.col("document_identity").asc(),
        F.col("document_id").asc(),
    ]


def _kernel(df: DataFrame, keys: Sequence[str], k: int, by_publisher: bool) -> DataFrame:
    """Rows that any run of at most k diverse picks per bucket could take.

    With fewer than k origins and publishers already used, a pick is among: the first k rows;
    the first rows of the first k origins; the first rows of the first k publishers; or, for a
    row new in both, pairs ranked at most k inside their origin and inside their publisher, of
    which at most 2k(k-1)+1 can come first.
    """
    order = document_order()
    bucket = [*keys, "relevance_class", "time_window"]
    running = W.partitionBy(*bucket).orderBy(*order)
    upto = running.rowsBetween(W.unboundedPreceding, 0)

    def first_of(*extra: str) -> Column:
        return F.row_number().over(W.partitionBy(*bucket, *extra).orderBy(*order)) == 1

    out = df.withColumns({"_rn": F.row_number().over(running), "_fo": first_of("origin_id")})
    out = out.withColumn("_ro", F.sum(F.col("_fo").cast("int")).over(upto))
    keep = (F.col("_rn") <= k) | (F.col("_fo") & (F.col("_ro") <= k))
    helper = ["_rn", "_fo", "_ro"]
    if by_publisher:
        out = out.withColumns(
            {"_fp": first_of("publisher"), "_fb": first_of("origin_id", "publisher")}
        )

        def pair_rank(column: str) -> Column:
            inside = W.partitionBy(*bucket, column).orderBy(*order)
            return F.sum(F.col("_fb").cast("int")).over(
                inside.rowsBetween(W.unboundedPreceding, 0)
            )

        out = out.withColumns({"_bo": pair_rank("origin_id"), "_bp": pair_rank("publisher")})
        out = out.withColumn("_pair", F.col("_fb") & (F.col("_bo") <= k) & (F.col("_bp") <= k))
        out = out.withColumns(
            {
                "_rp": F.sum(F.col("_fp").cast("int")).over(upto),
                "_rb": F.sum(F.col("_pair").cast("int")).over(upto),
            }
        )
        keep = keep | (F.col("_fp") & (F.col("_rp") <= k))
        keep = keep | (F.col("_pair") & (F.col("_rb") <= 2 * k * (k - 1) + 1))
        helper += ["_fp", "_fb", "_bo", "_bp", "_pair", "_rp", "_rb"]
    return out.where(keep).drop(*helper)


def diverse_kernel(df: DataFrame, k: int, by_publisher: bool) -> DataFrame:
    salted = df.withColumn("_salt", F.pmod(F.xxhash64("document_id"), F.lit(SALTS)))
    sliced = _kernel(salted, ["candidate_id", "_salt"], k, by_publisher).drop("_salt")
    return _kernel(sliced, ["candidate_id"], k, by_publisher)


def pick_diverse(
    rows: list[dict], classes: Sequence[str], cycle: Sequence[str], k: int, by_publisher: bool
) -> list[tuple[str, str]]:
    """Take the buckets of each class in turn; in a bucket prefer a new origin, then a new
    publisher, then the better row. ``rows`` must be in document order."""
    left = [dict(row, place=place) for place, row in enumerate(rows)]
    origins: set[str] = set()
    publishers: set[str] = set()
    chosen: list[tuple[str, str]] = []
    for name in classes:
        idle = False
        while not idle and len(chosen) < k:
            idle = True
            for window in cycle:
                bucket = [
                    r for r in left if r["relevance_class"] == name and r["time_window"] == window
                ]
                if not bucket or len(chosen) == k:
                    continue
                best = min(
                    bucket,
                    key=lambda r: (
                        r["origin_id"] in origins,
                        by_publisher and r["publisher"] in publishers,
                        r["place"],
                    ),
                )
                left.remove(best)
                parts = [name, window, _novelty("origin", best["origin_id"], origins)]
                if by_publisher:
                    parts.append(_novelty("publisher", best["publisher"], publishers))
                chosen.append((best["document_id"], "|".join(parts)))
                idle = False
    return chosen


def _novelty(label: str, value: str, used: set[str]) -> str:
    state = "repeat" if value in used else "new"
    used.add(value)
    return f"{state}_{label}"


def select_diverse(
    df: DataFrame,
    classes: Sequence[str],
    cycle: Sequence[str],
    k: int,
    by_publisher: bool,
    capacity: str | None = None,
) -> DataFrame:
    """Up to k documents per candidate; ``capacity`` names a column that lowers k per candidate.

    Only the kernel, whose size depends on k alone, is gathered per candidate.
    """
    rows = df.where(F.col("relevance_class").isin(*classes)).withColumn(
        "publisher", F.coalesce(F.col("publisher"), F.lit(""))
    )
    kernel = diverse_kernel(rows, k, by_publisher)
    place = F.struct(
        (-F.col("score")).alias("a"),
        trust_rank(F.col("trust_tier")).alias("b"),
        F.col("published_at").isNull().alias("c"),
        (-F.coalesce(F.unix_date("published_at"), F.lit(0))).alias("d"),
        F.col("document_identity").alias("e"),
        "document_id",
        "relevance_class",
        "time_window",
        "origin_id",
        "publisher",
    )
    limit = F.max(capacity) if capacity else F.lit(k)
    grouped = kernel.groupBy("candidate_id").agg(
        F.sort_array(F.collect_list(place)).alias("rows"), limit.cast("int").alias("room")
    )

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for candidate, members, room in zip(
                batch["candidate_id"], batch["rows"], batch["room"], strict=True
            ):
                members = [m if isinstance(m, dict) else m.asDict() for m in members]
                picks = pick_diverse(members, classes, cycle, int(room), by_publisher)
                out += [(candidate, doc, n, why) for n, (doc, why) in enumerate(picks, 1)]
            yield pd.DataFrame(
                out, columns=["candidate_id", "document_id", "selection_rank", "selection_reason"]
            )

    return grouped.mapInPandas(choose, _SCHEMA)


def science_shortlist(ranked: DataFrame, cycle: Sequence[str], k: int = 4) -> DataFrame:
    eligible = ranked.where((F.col("connector") == "openalex") & (F.col("excerpt_length") > 0))
    return select_diverse(eligible, ("strong", "weak"), cycle, k, by_publisher=False)


def media_fetch_queue(ranked: DataFrame, cycle: Sequence[str], k: int = 4) -> DataFrame:
    eligible = ranked.where((F.col("connector") == "mediacloud") & (F.trim("url") != ""))
    return select_diverse(eligible, ("strong", "weak", "none"), cycle, k, by_publisher=True)


def media_capacity(science_count: Column) -> Column:
    return F.least(F.lit(4), F.greatest(F.lit(2), F.lit(6) - science_count))


def interleave(science: DataFrame, industry: DataFrame, k: int) -> DataFrame:
    """Alternate science and industry by rank, at most k rows per candidate."""
    both = science.withColumn("source_class", F.lit("scientific")).unionByName(
        industry.withColumn("source_class", F.lit("industry"))
    )
    order = [F.col("selection_rank").asc(), F.col("source_class").desc()]
    return top_k(both, ["candidate_id"], order, k, "final_rank")


def evidence_documents(ranked: DataFrame, primary: int = 40, most: int = 3, fill: int = 2, fallback: int = 30) -> DataFrame:
    """Per candidate and source class: documents of distinct origins, up to ``most`` at or above
    the primary score, else filled with lower scores of ``fallback`` or more up to ``fill``; classes alternate."""
    order = [
        F.col("score").desc(),
        trust_rank(F.col("trust_tier")).asc(),
        F.col("published_at").desc_nulls_last(),
        F.col("document_id").asc(),
    ]
    keys = ["candidate_id", "source_class"]
    enough = ranked.where(F.col("score") >= fallback)
    distinct = top_k(enough, [*keys, "origin_id"], order, 1, "_first").drop("_first")
    ranks = top_k(distinct, keys, order, most, "selection_rank")
    high = F.col("score") >= primary
    kept = ranks.where(high | (F.col("selection_rank") <= fill))
    final = [F.col("selection_rank").asc(), F.col("source_class").desc()]
    return top_k(kept, ["candidate_id"], final, 2 * most, "final_rank")
