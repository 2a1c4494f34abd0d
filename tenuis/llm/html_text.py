"""Main text of web pages by the maximum-scoring subsequence of a page's tokens.

A page is a sequence of text and tag tokens. Each word of plain text adds a positive weight, each tag a negative one
by its name, words inside boilerplate elements a negative one. A linear scan finds the contiguous run with the
greatest sum. The content is the container that holds this run: the outermost `article` or `main` around it, else the
smallest element around its first and last token. Of the container all blocks are kept but those in boilerplate
elements.

The weights are log-odds of tokens inside and outside of the content of labelled pages: pages whose markup names its
content with one `article` or `main` element, at most `LABELLED_PAGES` of them, drawn by a hash of their ids. That
bound is the only sample; every page is read whole.

A block ends where a block element starts or ends. Inside a block character references are decoded and white space
becomes one space; a line break element counts as white space. Blocks are joined by one line feed.

Defined results: a null or empty page, or one without words outside of boilerplate, has an empty text; markup that is
cut off at the end of a page is dropped, text before it stays; a lone `<` is text; equal sums go to the earlier and
shorter run; repeated pages give repeated rows.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenuis.llm.common import share, with_text_columns

LABELLED_PAGES = 2000

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|textarea|title|noscript|iframe|svg|template)\b[^>]*(?:>.*?</(?P=raw)\s*>|\Z|>.*\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attributes>(?>\"[^\"<]*\"|'[^'<]*'|[^<>])*+)>"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|(?P<cut></?[a-zA-Z][^<>]*\Z)"
    r"|(?P<text>[^<]+|<)",
    re.S | re.I,
)
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)

BLOCKS = frozenset(
    "address article aside blockquote body caption dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " head header hr html legend li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINERS = frozenset("html body main article section div td".split())
BOILERPLATE = frozenset("head nav aside footer form button select menu dialog".split())
#: Words in a class, id or role that mark an element as boilerplate.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice"
    " notices alert popup modal overlay comment comments discussion replies disqus sidebar complementary menu nav navbar navigation"
    " breadcrumb breadcrumbs footer contentinfo masthead related recommended share sharing social newsletter subscribe"
    " subscription signup login widget toolbar pagination".split()
)
#: Elements without content, which never stay open.
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_TRACKED = BLOCKS | BOILERPLATE | frozenset("a span b i em strong u small".split())
_OPEN_PARAGRAPH_ENDS = BLOCKS - {"body", "html", "head"}


@dataclass
class Token:
    """One text or tag. `inside` is the container it stands in, `skip` tells that it is in boilerplate."""

    name: str
    text: str
    inside: int
    skip: bool


@dataclass
class Page:
    tokens: list[Token]
    #: For each container: name, parent, first and last token (exclusive).
    containers: list[list]


def _boilerplate(name: str, attributes: str, in_article: bool) -> bool:
    if name in BOILERPLATE or name == "header" and not in_article:
        return True
    if name in ("html", "body", "main") or "=" not in attributes:
        return False
    for groups in _NAMED.findall(attributes):
        if not MARKS.isdisjoint(re.split(r"[^a-z0-9]+", "".join(groups).lower())):
            return True
    return False


def parsed(source: str) -> Page:
    tokens: list[Token] = []
    containers: list[list] = [["page", -1, 0, 0]]
    # Open elements: name, container number or -1, skipped.
    stack: list[tuple[str, int, bool]] = []
    inside, skips, articles = 0, 0, 0
    opened: Counter = Counter()
    seen = False

    def close() -> None:
        nonlocal inside, skips, articles
        name, number, skipped = stack.pop()
        opened[name] -= 1
        skips -= skipped
        articles -= name in ("article", "main")
        if number >= 0:
            containers[number][3] = len(tokens)
            inside = containers[number][1]

    for match in _TOKEN.finditer(source):
        name = match["name"]
        if name is None:
            if match["text"]:
                tokens.append(Token("", html.unescape(match["text"]), inside, skips > 0))
            continue
        name = name.lower()
        if match["end"]:
            if opened[name]:
                while stack[-1][0] != name:
                    close()
                tokens.append(Token(name, "", inside, skips > 0))
                close()
            elif name in BLOCKS:
                tokens.append(Token(name, "", inside, skips > 0))
            continue
        if name in _OPEN_PARAGRAPH_ENDS and opened["p"]:
            while stack[-1][0] != "p" and stack[-1][1] < 0 and not stack[-1][2]:
                close()
            if stack[-1][0] == "p":
                close()
        if name == "body" or name in ("article", "main") and not seen:
            # The content never lies in boilerplate that someone forgot to close.
            while skips:
                close()
        tokens.append(Token(name, "", inside, skips > 0))
        attributes = match["attributes"] or ""
        if name in _VOID or attributes.endswith("/") or name not in _TRACKED:
            continue
        skipped = _boilerplate(name, attributes, articles > 0)
        number = -1
        if name in CONTAINERS:
            number = len(containers)
            containers.append([name, inside, len(tokens) - 1, 0])
            inside = number
        stack.append((name, number, skipped))
        opened[name] += 1
        skips += skipped
        articles += name in ("article", "main")
        seen |= articles > 0
    while stack:
        close()
    containers[0][3] = len(tokens)
    return Page(tokens, containers)


def content_of(page: Page, number: int) -> int:
    """The outermost article or main around a container, else the container itself."""
    found, at = number, number
    while at >= 0:
        if page.containers[at][0] in ("article", "main"):
            found = at
        at = page.containers[at][1]
    return found


def counts(source: str) -> Counter:
    """(token, inside the content?) counts of a page that names its content with one element; else nothing."""
    page = parsed(source)
    named = [i for i, c in enumerate(page.containers) if c[0] in ("article", "main")]
    if len(named) != 1:
        return Counter()
    first, last = page.containers[named[0]][2:]
    found: Counter = Counter()
    for at, token in enumerate(page.tokens):
        key = token.name or ("#skipped" if token.skip else "#word")
        found[key, first <= at < last] += 1 if token.name else len(token.text.split())
    return found


def weights_of(found: Counter) -> dict[str, float]:
    """Log-odds by token, positive for words and negative for tags and for words in boilerplate."""
    within = sum(n for (_, inside), n in found.items() if inside) + 1.0
    without = sum(n for (_, inside), n in found.items() if not inside) + 1.0
    odds = {key: math.log(((found[key, True] + 1.0) / within) / ((found[key, False] + 1.0) / without)) for key, _ in found}
    weights = {key: min(value, -0.1) for key, value in odds.items() if not key.startswith("#")}
    weights["#word"] = max(odds.get("#word", 0.0), 0.5)
    weights["#skipped"] = min(odds.get("#skipped", 0.0), -0.5)
    weights["#tag"] = -1.0
    return weights


def best_run(page: Page, weights: dict[str, float]) -> tuple[int, int] | None:
    """First and last token of the run with the greatest positive sum."""
    best, run, start, found = 0.0, 0.0, 0, None
    for at, token in enumerate(page.tokens):
        if token.name:
            value = weights.get(token.name, weights["#tag"])
        else:
            value = weights["#skipped" if token.skip else "#word"] * len(token.text.split())
        if run <= 0.0:
            run, start = 0.0, at
        run += value
        if run > best:
            best, found = run, (start, at)
    return found


def main_text(source: str | None, weights: dict[str, float]) -> str:
    if not source:
        return ""
    page = parsed(source)
    run = best_run(page, weights)
    if run is None:
        return ""
    around = []
    for at in run:
        up, number = [], page.tokens[at].inside
        while number >= 0:
            up.append(number)
            number = page.containers[number][1]
        around.append(up)
    shared = set(around[1])
    common = next(n for n in around[0] if n in shared)
    first, last = page.containers[content_of(page, common)][2:]
    blocks, open_block = [], []

    def end_block() -> None:
        text = " ".join("".join(open_block).split())
        open_block.clear()
        if text:
            blocks.append(text)

    for token in page.tokens[first:last]:
        if token.name in BLOCKS:
            end_block()
        elif token.name == "br":
            open_block.append(" ")
        elif token.text and not token.skip:
            open_block.append(token.text)
    end_block()
    return "\n".join(blocks)


def learned(pages: DataFrame, key: str = "page_id", source: str = "html", most: int = LABELLED_PAGES) -> dict[str, float]:
    """Weights from at most `most` labelled pages."""
    rows = pages.select(F.col(key).alias("key"), F.col(source).cast("string").alias("html"))
    labelled = rows.where(F.col("html").rlike(r"(?i)<(article|main)\b"))
    drawn = labelled.select("key").where(F.col("key").isNotNull()).distinct().orderBy(F.xxhash64("key"), "key").limit(most)

    def count(batches):
        for batch in batches:
            found: Counter = Counter()
            for value in batch.column(0).to_pylist():
                found.update(counts(value))
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.bool_()), pa.array(list(found.values()), pa.int64())],
                names=["token", "inside", "n"],
            )

    sums = (
        labelled.join(drawn, "key", "left_semi").select("html").mapInArrow(count, "token string, inside boolean, n long")
        .groupBy("token", "inside").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "token").limit(2000).collect()
    )
    return weights_of(Counter({(r["token"], r["inside"]): r["n"] for r in sums}))


def texts(pages: DataFrame, keep: list[str], source: str = "html", weights: dict[str, float] | None = None) -> DataFrame:
    """The columns `keep`, text and n_chars of every page."""
    shared = share(pages.sparkSession, weights or learned(pages, keep[0], source))

    def work():
        def compute(sources):
            found = [main_text(s, shared.value) for s in sources]
            return [found, [len(t) for t in found]]

        return compute

    return with_text_columns(pages, keep, source, [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())], work)


def report(pages: DataFrame) -> DataFrame:
    return texts(pages, ["page_id", "url"])
