import datetime as dt
import random

from pyspark.sql import functions as F

from tenuis.functions.matching import narrowest_span
from tenuis.operators import ranking, selection

SCHEMA = (
    "candidate_id string, document_id string, score int, trust_tier string, published_at date, document_identity string, "
    "relevance_class string, time_window string, origin_id string, publisher string"
)
CYCLE = ("previous", "recent", "unknown_date")


def pool(seed, n, origins, publishers):
    rng = random.Random(seed)
    return [
        (
            f"c{rng.randrange(3) if rng.random() < 0.5 else 0}", f"d{i:04d}", rng.choice([100, 60, 40, 13]), rng.choice("ABCD"),
            rng.choice([None, dt.date(2025, 1, 1) + dt.timedelta(rng.randrange(30))]), f"i{rng.randrange(n)}",
            rng.choice(["strong", "weak", "none"]), rng.choice(CYCLE), f"o{rng.randrange(origins)}", f"p{rng.randrange(publishers)}",
        )
        for i in range(n)
    ]


def greedy(rows, classes, k, by_publisher):
    """Straight pass over full buckets, written as nested loops."""
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    rows = [dict(zip(names, r, strict=True)) for r in rows]
    tier = {"A": 0, "B": 1, "C": 2, "D": 3}
    key = lambda r: (
        -r["score"], tier[r["trust_tier"]], r["published_at"] is None, -(r["published_at"] or dt.date(1970, 1, 1)).toordinal(),
        r["document_identity"], r["document_id"],
    )
    out = set()
    for candidate in {r["candidate_id"] for r in rows}:
        own = sorted((r for r in rows if r["candidate_id"] == candidate), key=key)
        used_o, used_p, picked = set(), set(), []
        for name in classes:
            while len(picked) < k:
                before = len(picked)
                for window in CYCLE:
                    bucket = [r for r in own if r not in picked and r["relevance_class"] == name and r["time_window"] == window]
                    if not bucket or len(picked) >= k:
                        continue
                    tests = [lambda r: r["origin_id"] not in used_o, lambda r: True]
                    if by_publisher:
                        tests = [
                            lambda r: r["origin_id"] not in used_o and r["publisher"] not in used_p,
                            lambda r: r["origin_id"] not in used_o, lambda r: r["publisher"] not in used_p, lambda r: True,
                        ]
                    row = next(r for test in tests for r in bucket if test(r))
                    used_o.add(row["origin_id"])
                    used_p.add(row["publisher"])
                    picked.append(row)
                if len(picked) == before:
                    break
        out |= {(candidate, r["document_id"], n) for n, r in enumerate(picked, 1)}
    return out


def test_diverse_selection_equals_full_pass(spark):
    for seed, (origins, publishers) in enumerate([(3, 2), (40, 5), (5, 40), (200, 200), (2, 1), (12, 12)]):
        rows = pool(seed, 400, origins, publishers)
        df = spark.createDataFrame(rows, SCHEMA)
        for by_publisher, classes in ((False, ("strong", "weak")), (True, ("strong", "weak", "none"))):
            got = selection.select_diverse(df, classes, CYCLE, 4, by_publisher).collect()
            assert {(r[0], r[1], r[2]) for r in got} == greedy(rows, classes, 4, by_publisher)


def test_kernel_is_bounded(spark):
    rows = [("c0", f"d{i:05d}", 60, "A", None, f"i{i}", "strong", "recent", f"o{i}", f"p{i}") for i in range(5000)]
    kept = selection.diverse_kernel(spark.createDataFrame(rows, SCHEMA), 4, True).count()
    assert kept <= 4 * 3 + 25


def test_narrowest_span_by_brute_force():
    rng = random.Random(5)
    for _ in range(300):
        words = [rng.choice("abcde") for _ in range(rng.randrange(1, 14))]
        wanted = set(rng.sample("abcd", rng.randrange(1, 4)))
        spans = [j - i for i in range(len(words)) for j in range(i + 1, len(words) + 1) if wanted <= set(words[i:j])]
        assert narrowest_span(" ".join(words), wanted) == (min(spans) if spans else None)


def test_round_robin_and_full_rank(spark):
    rng = random.Random(9)
    rows = [(rng.choice("ab"), rng.randrange(4), i) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, s int, i int").repartition(7)
    got = {r["i"]: r["position"] for r in ranking.full_round_robin(df, ["k"], "s", [F.col("i").asc()]).collect()}
    for key in "ab":
        queues = [[i for k, s, i in rows if k == key and s == n] for n in range(4)]
        order = []
        while any(queues):
            order += [q.pop(0) for q in queues if q]
        assert [i for i in sorted((i for k, _, i in rows if k == key), key=got.get)] == order
    head = ranking.round_robin(df.where("k = 'a'"), F.col("s"), [F.col("i").asc()], 20)
    assert {r["i"]: r["position"] for r in head.collect()} == {i: p for i, p in got.items() if p <= 20 and i in {x for k, _, x in rows if k == "a"}}
