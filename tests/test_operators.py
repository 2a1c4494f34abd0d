import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tenuis.operators import evidence as ev
from tenuis.operators import features as feat
from tenuis.operators import graph, identity, results
from tenuis.operators import model as ml
from tenuis.sources import bundles, pages


def test_components_equal_union_find(spark):
    rng = random.Random(2)
    for edges in ([(i, i + 1) for i in range(60)], [(rng.randrange(80), rng.randrange(80)) for _ in range(50)], [(0, i) for i in range(1, 70)]):
        pairs = [(f"n{a:03d}", f"n{b:03d}") for a, b in edges if a != b]
        nodes = [f"n{i:03d}" for i in range(90)]
        label = {n: n for n in nodes}
        for _ in nodes:
            for a, b in pairs:
                label[a] = label[b] = min(label[a], label[b])
        got = graph.components(spark.createDataFrame([(n,) for n in nodes], "id string"), "id", spark.createDataFrame(pairs, "u string, v string"))
        assert {r["id"]: r["root"] for r in got.collect()} == label


def test_form_suggestions_equal_all_pairs(spark):
    rng = random.Random(4)
    words = ["edge", "chip", "model", "neural", "net", "graph", "systems", "ai", "lidar"]
    make = lambda: " ".join(rng.sample(words, rng.randrange(1, 5)))
    left, right = [make() for _ in range(60)], [make() for _ in range(60)]
    frame = lambda forms: spark.createDataFrame([(f"c{i}", f) for i, f in enumerate(forms)], "candidate_id string, form string")
    want = set()
    for a in set(left):
        for b in set(right):
            x, y = set(a.split()), set(b.split())
            near = len((x & y) - set(identity.GENERIC_WORDS)) >= 2 and len(x & y) / len(x | y) >= 0.5
            inside = min(len(a), len(b)) >= 5 and (a in b or b in a)
            if a == b or near or inside:
                want.add((a, b, "exact" if a == b else "fuzzy"))
    got = identity.form_suggestions(frame(left), frame(right)).select("left_form", "right_form", "trigger").collect()
    assert {tuple(r) for r in got} == want


def test_independent_origins_equal_sequential_pass(spark):
    rng = random.Random(7)
    base = [f"w{i}" for i in range(30)]
    rows = []
    for c in range(25):
        for p in range(rng.randrange(1, 12)):
            start, size = rng.randrange(6), rng.choice([0, 3, 6, 7, 9, 14])
            rows.append((f"c{c}", f"p{p:02d}", " ".join(base[start : start + size]), f"o{rng.randrange(4)}"))
    want = {}
    for c in {r[0] for r in rows}:
        known = []
        for _, _, title, origin in sorted(r for r in rows if r[0] == c):
            key = f"title:{title}" if title else f"origin:{origin}"
            pad = f" {title} "
            mirror = any(
                key == k or (len(title.split()) >= 6 and len(t.split()) >= 6 and (pad in f" {t} " or f" {t} " in pad)) for k, t in known
            )
            if not mirror:
                known.append((key, title))
        want[c] = len(known)
    df = spark.createDataFrame(rows, "candidate_id string, place string, title_key string, origin_id string")
    assert {r[0]: r[1] for r in results.independent_origins(df).collect()} == want


POLICY = [
    ({}, "main", "passed"),
    ({"gate_decision": "reject", "duplicate": True}, "excluded", "gate_reject"),
    ({"duplicate": True, "substantive": False}, "excluded", "duplicate"),
    ({"substantive": False, "gate_decision": "review"}, "excluded", "not_substantive"),
    ({"gate_decision": "review", "evidence_review_complete": False}, "watchlist", "gate_review"),
    ({"evidence_review_complete": False, "mature": True}, "watchlist", "evidence_review_incomplete"),
    ({"mature": True, "marketing_hype": True}, "excluded", "mature"),
    ({"marketing_hype": True, "temporal_coverage_complete": False}, "excluded", "marketing_hype"),
    ({"temporal_coverage_complete": False, "independent_origins": 0}, "watchlist", "temporal_coverage_incomplete"),
    ({"independent_origins": 1, "independent_actors": 1}, "watchlist", "insufficient_origins"),
    ({"independent_actors": 1, "grounded_ab_support": False}, "watchlist", "insufficient_actors"),
    ({"grounded_ab_support": False, "score": None}, "watchlist", "insufficient_trusted_evidence"),
    ({"score": None}, "watchlist", "model_unavailable"),
    ({"score": 0.49}, "excluded", "model_below_threshold"),
]


def test_policy_precedence(spark):
    base = dict(
        gate_decision="accept", duplicate=False, substantive=True, evidence_review_complete=True, mature=False, marketing_hype=False,
        temporal_coverage_complete=True, independent_origins=2, independent_actors=2, grounded_ab_support=True, score=0.9, threshold=0.5,
    )
    rows = [tuple({**base, **change}.values()) for change, _, _ in POLICY]
    schema = "gate_decision string, duplicate boolean, substantive boolean, evidence_review_complete boolean, mature boolean, marketing_hype boolean, temporal_coverage_complete boolean, independent_origins int, independent_actors int, grounded_ab_support boolean, score double, threshold double"
    status, reason = results.decision()
    got = spark.createDataFrame(rows, schema).select(status, reason).collect()
    assert [tuple(r) for r in got] == [(s, r) for _, s, r in POLICY]


SCOPE_CASES = [
    ("edge computing chips are used", "edge computing chip", "full_candidate", [], "full_candidate", []),
    ("edge computing chips are used", "edge computing chip", "core_only", ["chip"], "core_only", ["chip"]),
    ("edge computing is used a lot", "edge computing chip", "full_candidate", [], "core_only", ["chip"]),
    ("a chip for the computing edge", "edge computing chip", "full_candidate", [], "core_only", None),
    ("nothing here at all", "edge computing chip", "full_candidate", [], None, None),
]


def test_claim_scope(spark):
    rows = [(q, t, s, m, "general") for q, t, s, m, _, _ in SCOPE_CASES]
    df = spark.createDataFrame(rows, "quote string, matched_term string, scope string, missing array<string>, purpose string")
    got = [tuple(r) for r in ev.with_claim_scope(df).select("final_scope", "final_missing").collect()]
    assert got[0] == ("full_candidate", []) and got[1] == ("core_only", ["chip"]) and got[2] == ("core_only", ["chip"])
    assert got[4][0] is None
    assert got[3][0] is None  # all three words, but nothing is missing and the order differs


def test_missing_components(spark):
    rows = [("", "full_candidate"), ("edge", "full_candidate"), ("edge; computing", "core_only"), ("chip edge", "core_only"), ("edge;edge", "core_only"), (";", "core_only"), ("", "core_only")]
    df = spark.createDataFrame(rows, "v string, s string")
    got = [r[0] for r in df.select(ev.missing_components(F.col("v"), F.col("s"), F.lit("edge computing chip"))).collect()]
    assert got == [[], None, ["edge", "computing"], None, None, None, []]


@pytest.mark.parametrize(
    ("quote", "stated"),
    [
        ("Edge chips were widely used in factories", True),
        ("Edge chips help; other systems were deployed", False),
        ("The successful edge chips implementation ended", True),
        ("Robots are deployed", False),
        ("Edge chips has emerged as the leading accelerator", True),
    ],
)
def test_adoption_relation(spark, quote, stated):
    row = spark.createDataFrame([(quote, "edge chips")], "q string, t string")
    assert row.select(ev.adoption_stated(F.col("q"), F.col("t"))).first()[0] is stated


def test_adoption_names_of_a_term(spark):
    rows = [
        ("GPU was deployed", "Graphics Units (GPUs)", True), ("one edge chip is used here", "edge chips", True),
        ("a deployed network of edge chips", "edge chips", False), ("used a b c d e f edge chips", "edge chips", True),
        ("used a b c d e f g edge chips", "edge chips", False), ("edge chips grew and its market uptake rose", "edge chips", True),
        ("edge chips play a critical role in modern life", "edge chips", True), ("anything deployed", "()", False),
        ("The deployment platform is blue.", "deployment platform", True), ("the blue platform", "blue platform", False), ("a platform for deployment systems", "platform systems", False),
        ("it is widely used pumps", "used pumps", True), ("blue adopted pump", "pump adopted", False), ("the pump adoption index", "pump adoption", True),
    ]
    got = spark.createDataFrame(rows, "q string, t string, want boolean").select("want", ev.adoption_stated(F.col("q"), F.col("t"))).collect()
    assert [g[1] for g in got] == [g[0] for g in got]


def test_answer_repair_and_failures(spark):
    passage = lambda n: f"passage number {n} has enough text for a quote"
    tasks = [(t, f"c-{t}", f"{t}-d{n}", passage(n), 0, "passage number", "general") for t in ("t1", "t2", "t3", "t4") for n in (1, 2)]
    claim = lambda q: f'{{"quote":"{q}","kind":"research","direction":"support","scope":"full_candidate","explanation_ru":"Цитата подтверждает","missing_components":""}}'
    doc = lambda d, q: f'{{"document_id":"{d}","claims":[{claim(q)}]}}'
    answers = [
        ("t1", f'{{"candidate_id":"c-t1","documents":[{doc("t1-d1", passage(1))},{doc("lost", passage(2))}]}}'),
        ("t2", f'{{"candidate_id":"c-x","documents":[{doc("t2-d1", passage(1))},{doc("t2-d2", passage(2))}]}}'),
        ("t3", f'{{"candidate_id":"c-t3","documents":[{doc("t3-d1", passage(1))},{doc("lost", "absent text that is long enough")}]}}'),
        ("t4", "not json"),
    ]
    asked = spark.createDataFrame(tasks, "task_id string, candidate_id string, document_id string, passage string, passage_start int, matched_term string, purpose string")
    given = spark.createDataFrame(answers, "task_id string, payload string")
    records, failures = ev.answer_records(asked, given)
    assert {r["task_id"]: r["failure"] for r in failures.collect()} == {"t2": "candidate_differs", "t3": "documents_differ", "t4": "invalid_json"}
    claims = ev.validate_claims(asked, records).collect()
    assert {(r["document_id"], r["issue"], r["final_scope"]) for r in claims} == {("t1-d1", None, "full_candidate"), ("t1-d2", None, "full_candidate")}


def test_fit_reaches_the_optimum(spark):
    rng = np.random.default_rng(3)
    n = 120
    flags = rng.integers(0, 2, (n, len(feat.STRUCTURED))).astype(bool)
    numbers = rng.normal(size=(n, len(feat.NUMERIC)))
    target = ((flags[:, 3].astype(int) + numbers[:, 0] + rng.normal(size=n)) > 0.8).astype(int)
    rows = [
        (f"r{i:03d}", f"g{i % 40}", "ab"[i % 2], None, int(target[i]), "word other" if i % 3 else "word", *map(bool, flags[i]), *map(float, numbers[i]))
        for i in range(n)
    ]
    schema = "candidate_id string, group_id string, domain string, negative_class string, target int, model_text string, "
    schema += ", ".join(f"{c} boolean" for c in feat.STRUCTURED) + ", " + ", ".join(f"{c} double" for c in feat.NUMERIC)
    df = spark.createDataFrame(rows, schema).persist()
    counts, pairs = ml.term_counts(df), ml.whole_set(df)
    table = ml.fit(pairs, df, counts)
    index = {(r["grp"], r["name"]): r["coefficient"] for r in table.collect()}
    names = sorted(k for k in index if k[0] != "intercept")
    long = {(r["candidate_id"], r["grp"], r["name"]): r["value"] for r in ml.long_features(pairs, df, counts, table.where("grp <> 'intercept'").drop("coefficient")).collect()}
    x = np.array([[1.0] + [long.get((r[0], *k), 0.0) for k in names] for r in rows])
    w = np.array([n / (2 * (target == t).sum()) for t in target])
    theta = np.zeros(x.shape[1])
    for _ in range(20000):
        g = x.T @ (w * (1 / (1 + np.exp(-x @ theta)) - target)) / w.sum()
        g[1:] += ml.L2 * theta[1:]
        theta -= 0.2 * g
    got = np.array([index[("intercept", "intercept")]] + [index[k] for k in names])
    assert np.abs(got - theta).max() < 1e-4
    parts = ml.contributions(pairs, df, counts, table).groupBy("candidate_id").agg(F.sum("contribution").alias("z")).collect()
    z = {r["candidate_id"]: r["z"] for r in parts}
    assert max(abs(z[r[0]] - float(v)) for r, v in zip(rows, x @ got, strict=True)) < 1e-9


def test_folds_keep_groups_and_both_targets(spark):
    rows = [(f"g{i % 37}", int(i % 3 == 0)) for i in range(300)]
    folds = {r["group_id"]: r["fold"] for r in ml.fold_of_group(spark.createDataFrame(rows, "group_id string, target int")).collect()}
    again = ml.fold_of_group(spark.createDataFrame(rows[::-1], "group_id string, target int")).collect()
    assert folds == {r["group_id"]: r["fold"] for r in again} and len(folds) == 37
    for fold in range(5):
        assert {t for g, t in rows if folds[g] == fold} == {0, 1}


def test_metrics_without_cases(spark):
    row = ml.metrics(spark.createDataFrame([(0, 0), (0, 0)], "target int, prediction int")).first()
    assert (row["precision"], row["recall"], row["f1"], row["accuracy"], row["specificity"]) == (0.0, 0.0, 0.0, 1.0, 1.0)


def test_page_text_branches():
    long = "word " * 30
    ld = '<script type="application/ld+json">{"@graph":[{"articleBody":"' + long + '"}]}</script>'
    assert pages.page_text(ld + f"<article><p>{long}x</p></article>")[1:3] == ("article_text", "json_ld.articleBody")
    assert pages.page_text(f"<nav><p>{long}</p></nav><article><p>{long}</p></article>")[2] == "html.article_paragraphs"
    assert pages.page_text(f"<p>{long}a</p><p>{long}b</p>")[2] == "html.paragraphs"
    assert pages.page_text(f"<p>{long}</p><meta name=description content='{long}'>")[1] == "meta_description"
    assert pages.page_text("<p>short</p>") == (None, "title_only", None)
    assert pages.page_text(f"<p>{long}lost<p>{long}a</p><p><nav>menu</nav>{long}b</p>")[0].split() == (long + "a " + long + "b").split()


def test_page_texts_are_whole(spark):
    long = "word " * 6000
    rows = spark.createDataFrame([(1, f"<article><p>{long}</p></article>"), (2, None)], "page_id long, html string")
    whole, none = pages.page_texts(rows).orderBy("page_id").collect()
    assert whole["text"] == long.strip() and whole["excerpt"] == long[:11_999] and whole["truncated"] is True
    assert (none["text"], none["status"], none["truncated"]) == (None, "title_only", False)


def test_bundle_is_write_once_and_verified(spark, tmp_path):
    folder = str(tmp_path / "bundle")
    df = spark.range(50).withColumn("name", F.concat(F.lit("n"), "id"))
    bundles.write_bundle({"rows": df}, folder, "v1")
    assert bundles.broken_files(spark, folder, "v1").count() == 0
    assert bundles.broken_files(spark, folder, "v2").count() > 0
    good, bad = bundles.read_table(spark, folder, "rows", "id BIGINT, name STRING")
    assert (good.count(), bad.count()) == (50, 0)
    part = next((tmp_path / "bundle" / "rows").glob("part-*.json"))
    part.write_text(part.read_text().replace("n1", "m1"))
    (part.parent / f".{part.name}.crc").unlink(missing_ok=True)
    assert [r["violation"] for r in bundles.broken_files(spark, folder, "v1").collect()] == ["changed"]
    with pytest.raises(Exception, match="(?i)exist"):
        bundles.write_bundle({"rows": df}, folder, "v1")


def test_digest_ignores_order(spark):
    df = spark.range(1000).withColumn("x", F.col("id") % 7)
    assert bundles.content_digest(df.repartition(9)).first() == bundles.content_digest(df.orderBy(F.desc("id"))).first()
    assert bundles.content_digest(df).first() != bundles.content_digest(df.where("id > 0")).first()


def test_positives(spark, tmp_path):
    path = tmp_path / "positives.csv"
    path.write_text("number,name,domain,score,rationale\n1,Edge AI,A,5,why\n2, ,A,5,x\n3,Net,Z,5,x\n3,Net,A,9,x\n")
    good, bad = bundles.read_positives(spark, str(path), ["A"])
    assert [tuple(r) for r in good.collect()] == [("organizer-001", "Edge AI", "A")]
    assert bad.count() == 3
    assert bundles.positive_annotations(spark, str(path)).where("score = 5").count() == 3


def test_growth_needs_all_counts(spark):
    cands = spark.createDataFrame([("a", "s"), ("b", "s")], "candidate_id string, scope_key string")
    counts = [("candidate", "a", "previous", 3), ("candidate", "a", "recent", 7), ("scope", "s", "previous", 10), ("scope", "s", "recent", 0), ("candidate", "b", "recent", 1)]
    got = {r["candidate_id"]: r for r in feat.temporal_features(cands, spark.createDataFrame(counts, "entity_type string, entity_id string, window string, count bigint")).collect()}
    assert math.isclose(got["a"]["scientific_count_log_growth"], math.log1p(7) - math.log1p(3))
    assert got["a"]["scientific_scope_share_recent"] is None and got["a"]["scientific_scope_share_delta"] is None
    assert not got["b"]["temporal_count_coverage_complete"] and got["b"]["scientific_recent_count_log1p"] is None


def test_echo_links_give_all_pairs_and_groups(spark):
    import datetime as dt

    from tenuis.operators import entities

    rng = random.Random(6)
    rows = [(f"c{rng.randrange(2)}", f"t{rng.randrange(3)}", f"o{rng.randrange(6)}", dt.date(2025, 1, 1 + rng.randrange(25))) for _ in range(90)]
    rows += [("c9", "t", name, dt.date(2025, 1, day)) for name, day in (("A", 1), ("B", 2), ("C", 4), ("D", 5))]
    want = {}
    for c, t, o, d in rows:
        for c2, t2, o2, d2 in rows:
            if (c, t) == (c2, t2) and o < o2 and abs((d - d2).days) <= 3:
                want[c, t, o, o2] = min(want.get((c, t, o, o2), 9), abs((d - d2).days))
    links = entities.echo_links(spark.createDataFrame(rows, "candidate_id string, title_key string, origin_id string, published_at date")).collect()
    days, origins = {}, {}
    for r in links:
        group = (r["candidate_id"], r["title_key"])
        origins.setdefault((*group, r["published_at"]), set()).add(r["origin_id"])
        origins.setdefault((*group, r["echo_published_at"]), set()).add(r["echo_origin_id"])
        days[(*group, r["published_at"]), (*group, r["echo_published_at"])] = r["gap_days"]
        days[(*group, r["published_at"]), (*group, r["published_at"])] = 0
    got = {}
    for (a, b), gap in days.items():
        for o in origins[a]:
            for o2 in origins[b]:
                if o != o2:
                    key = (*a[:2], *sorted((o, o2)))
                    got[key] = min(got.get(key, 9), gap)
    assert got == want and ("c9", "t", "B", "C") in got


def test_long_cue_sentences_get_a_maturity_passage(spark):
    long = "filler words " * 250 + "edge chip is widely used here " + "more words " * 250
    docs = [("d1", long), ("d2", "Some start. Edge chip is widely used. An end."), ("d3", "filler words " * 250 + "is widely used")]
    links = spark.createDataFrame([("c", d, "edge chip") for d, _ in docs], "candidate_id string, document_id string, term string")
    texts = dict(docs)
    got = {r["document_id"]: r for r in ev.maturity_passages(links, spark.createDataFrame(docs, "document_id string, excerpt string")).collect()}
    assert set(got) == {"d1", "d2"} and got["d2"]["weight"] == 10 and got["d1"]["weight"] is None
    assert "edge chip" in texts["d1"][got["d1"]["start"] : got["d1"]["end"]] and got["d1"]["end"] - got["d1"]["start"] <= ev.PASSAGE_CHARS


def test_fit_tells_a_missed_tolerance(spark):
    rows = [
        (f"r{i}", f"g{i}", "a", None, i % 2, "word", *[i % 3 == 0] * len(feat.STRUCTURED), *[float(i)] * len(feat.NUMERIC)) for i in range(12)
    ]
    schema = "candidate_id string, group_id string, domain string, negative_class string, target int, model_text string, "
    schema += ", ".join(f"{c} boolean" for c in feat.STRUCTURED) + ", " + ", ".join(f"{c} double" for c in feat.NUMERIC)
    df = spark.createDataFrame(rows, schema)
    with pytest.warns(RuntimeWarning, match="over the tolerance"):
        ml.fit(ml.whole_set(df), df, ml.term_counts(df), steps=1)
