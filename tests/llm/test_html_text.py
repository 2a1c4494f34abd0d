import html
import itertools
import random
import re

from tenuis.llm import html_text as ht

SF = "/root/testdata/sf0.01"
WEIGHTS = {"#word": 1.0, "#skipped": -1.0, "#tag": -1.0, "p": -0.1, "article": -0.1}

PAGE = """<html><body><header><h1>Site</h1></header><nav><a>x</a> <a>y</a></nav><main><article><header><h1>Ti&eacute;tle</h1></header>
<p>One <b>bo</b>ld &lt;tag&gt; text here is long enough.
 more</p><aside>side bar words here</aside><div class="ad-slot">Buy now this thing</div><p>Second<br>line</p><ul><li>item one<li>item two</ul>
<form><input><label>mail</label></form><section id="comments"><article><p>I agree very much with this text a lot of it</p></article></section>
</article></main><div class="cookie-notice">We use cookies</div><footer>c 2020</footer></body></html>"""


def slow_best(values):
    sums = [(sum(values[a : b + 1]), -a, -b) for a in range(len(values)) for b in range(a, len(values))]
    top = max(sums, default=(0, 0, 0))
    return top[0] if top[0] > 0 else None


def test_run_has_the_greatest_sum():
    rng = random.Random(4)
    for _ in range(300):
        source = "".join(rng.choice(["<p>", "a b ", "<nav>", "c ", "</nav>", "<i>", "d e f g ", "<td>"]) for _ in range(rng.randint(0, 14)))
        page = ht.parsed(source)
        values = [WEIGHTS.get(t.name, -1.0) if t.name else (-1.0 if t.skip else 1.0) * len(t.text.split()) for t in page.tokens]
        run = ht.best_run(page, WEIGHTS)
        want = slow_best(values)
        assert (run is None) == (want is None)
        if run:
            assert abs(sum(values[run[0] : run[1] + 1]) - want) < 1e-9


def test_parts_of_a_page():
    assert ht.main_text(PAGE, WEIGHTS) == "Tiétle\nOne bold <tag> text here is long enough. more\nSecond line\nitem one\nitem two"
    assert ht.main_text("plain words only", WEIGHTS) == "plain words only"
    assert ht.main_text("<nav>a b c", WEIGHTS) == "" and ht.main_text(None, WEIGHTS) == "" and ht.main_text("", WEIGHTS) == ""
    assert ht.main_text("<div class=ad>buy<article><p>a &amp b &am", WEIGHTS) == "a & b &am"
    assert ht.main_text('<p title="a>b">x < y</p><script>var a="</p>";</script><p', WEIGHTS) == "x < y"


def test_long_and_broken_markup_is_linear():
    for part in ("<a href='x ", "<script>", "<div>", "<p><b>", "<!--", "<i>", "<nav>"):
        ht.main_text(part * 20_000 + "x", WEIGHTS)


def test_pages_against_their_template(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r["page_id"]: r for r in ht.report(pages).collect()}
    for row in pages.collect():
        body = re.search(r"<article>(.*?)(</article>|\Z)", row["html"], re.S).group(1)
        body = re.sub(r"<[^>]*\Z", "", re.sub(r"<br>|</?b>", "", body))
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", body))
        want = "\n".join(b for b in blocks if b)
        assert got[row["page_id"]]["text"] == want and got[row["page_id"]]["n_chars"] == len(want)


def test_rows(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "v", PAGE), (3, "v", PAGE), (None, "w", "<p>a b</p>")]
    pages = spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, n_chars int")
    got = ht.report(pages).collect()
    assert [(r["page_id"], r["n_chars"] > 0) for r in got] == [(1, False), (2, False), (3, True), (3, True), (None, True)]
    assert ht.report(pages.where("false")).count() == 0
    assert list(itertools.islice(ht.weights_of(ht.Counter()), 3)) == ["#word", "#skipped", "#tag"]
