import random

from tenuis.llm import licenses as lic


def slow(scanner, text):
    """All windows of all classes against all templates, without hashing into bands."""
    hashes = lic.shingles(text)
    windows = []
    for number, own in enumerate(scanner.sets):
        half = lic.half_width(len(own))
        windows += [(number, start, 2 * half) for start in range(0, len(hashes), half)]
    return scanner.verified(hashes, windows) if len(hashes) else []


def test_bands_find_what_all_windows_hold():
    rng = random.Random(8)
    scanner = lic.Scanner(lic.TEMPLATES)
    texts = [t for group in lic.TEMPLATES.values() for t in group]
    for _ in range(150):
        words = []
        for _ in range(rng.randint(0, 5)):
            words += [f"w{rng.randrange(99)}" for _ in range(rng.randint(0, 60))]
            own = rng.choice(texts).split()
            for _ in range(rng.randint(0, 2)):
                own[rng.randrange(len(own))] = "changed"
            words += own
        text = " ".join(words)
        assert scanner.scan(text) == slow(scanner, text)


def test_a_whole_template_always_lies_in_a_window():
    for size in range(1, 300):
        half = lic.half_width(size)
        assert size <= half < 2 * size + 1
        part = -(-3 * size // 4)
        missed = (1 - part / (2 * half + size - part)) ** lic.bands_for(size) if part < 2 * half else 0.0
        assert missed <= lic.MISS


def test_every_template_is_found_at_every_place():
    scanner = lic.Scanner(lic.TEMPLATES)
    for name, group in lic.TEMPLATES.items():
        for template in group:
            for before in (0, 1, 7, 30):
                hits = scanner.scan(" ".join(["x"] * before) + " " + template + " y z")
                assert name in {h[0] for h in hits if h[3] == 1.0}, (name, before)


def test_rows(spark):
    rows = [(1, None), (2, ""), (3, "Released under the MIT License."), (3, "Released under the MIT License."), (4, "MIT License"),
            (None, "x " * 100_000 + lic.TEMPLATES["Unlicense"][0])]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, hits int")
    got = [(r["doc_id"], r["n_hits"], r["licenses"]) for r in lic.report(docs).collect()]
    assert got == [(1, 0, ""), (2, 0, ""), (3, 1, "MIT"), (3, 1, "MIT"), (4, 0, ""), (None, 1, "Unlicense")]
    assert lic.report(docs.where("false")).count() == 0
    assert lic.scanned(docs, templates={"own": ["MIT License"]}).where("doc_id = 4").first()["hits"][0]["license"] == "own"
