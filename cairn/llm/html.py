"""Main text of web pages: flat text blocks, classified by a decision tree.

A page becomes a flat list of text blocks, cut at block-level tags. Each block has its words and
its link density (the share of words inside links), the same of both neighbours, whether it stands
in an article or main element (and whether the page has one), whether it is a heading, and whether its
container hints at boilerplate by its tag, class, id or role. A decision tree, trained on the labelled table below,
keeps or drops each block; kept blocks are joined in page order.

Edge cases: null or empty html, and pages without content blocks, give an empty text. Unclosed and
stray tags are tolerated: an unclosed comment, script or style runs to the end of the page, another unclosed
element without page text (a button, say) to the next block, a head to the first tag that can't be in one, an unclosed quote to the
end of its tag, and a tag that never ends is dropped. Time is linear in the page. Repeated pages are each extracted;
extra columns are ignored; an empty table gives no rows; ties of the tree count as boilerplate.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Callable
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from cairn.llm import tree
from cairn.llm.common import mapped, small_batches, table

# Tags and hints.
BLOCK = set("address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html label legend li link main menu meta nav ol option p pre search section select summary table tbody td textarea tfoot th thead title tr ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template textarea svg iframe title select button".split())
IN_HEAD = set("title meta link script style base noscript template".split())
BOILERPLATE = set("nav footer aside form menu dialog head header fieldset".split())
#: Parts of names that hint at boilerplate wherever they stand.
CLEAR = re.compile(r"ads?|advert.*|adsense|sponsor.*|promo.*|cookies?|consent|gdpr|popup|modal|overlay|disqus|side-?bar|sidebars?|widgets?|navbar|navigation|breadcrumbs?|pagination|pager|masthead|subscribe|newsletter|signup|login|sharing|copyright|disclaimer|complementary|contentinfo")
#: Parts that hint at it beside parts of these two kinds only, so "related-links" does and "related-work" does not.
VAGUE = set("nav navi menu menus header footer foot banner comment comments reply replies respond related recommended recommendations share social search skip tag tags meta byline legal notice notices alert alerts".split())
BESIDE = set("section box bar list area container wrapper wrap block post posts article articles entry link links content story stories news item items top bottom main site page global primary secondary button buttons icon icons form thread count info cloud module panel inner outer left right side to the and js".split())
_ARTICLE = re.compile(r"(?i)(?:^|[\s_-])(?:main|articlebody)(?:$|[\s_-])")
#: After "=" a value may be quoted; elsewhere quotes are ordinary characters.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|))*+)>", re.S)
_ATTRIBUTE = re.compile(r"(?i)(?:^|[\s\"'/])(?:class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_HIDDEN = re.compile(r"(?i)(?:^|\s)hidden(?:$|[\s=/])|display\s*:\s*none")
_TAG_LIKE = re.compile(r"<[a-zA-Z/!?]")

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "article", "has_article", "heading", "hint")
#: Labelled blocks: FEATURES, then 1 for content.
LABELLED = [
    # a page with an article element: paragraphs long and short, headings, lists with links
    (80, 0.0, 12, 0.0, 60, 0.0, 1, 1, 0, 0, 1), (3, 0.0, 80, 0.0, 60, 0.0, 1, 1, 0, 0, 1), (12, 0.0, 9, 0.0, 80, 0.0, 1, 1, 1, 0, 1), (1, 0.0, 40, 0.0, 0, 0.0, 1, 1, 0, 0, 1),
    (25, 0.3, 40, 0.0, 35, 0.0, 1, 1, 0, 0, 1), (7, 0.0, 3, 0.0, 4, 0.0, 1, 1, 0, 0, 1), (6, 0.4, 50, 0.0, 8, 0.2, 1, 1, 0, 0, 1), (150, 0.1, 0, 0.0, 12, 0.0, 1, 1, 0, 0, 1),
    (4, 0.0, 20, 0.5, 90, 0.0, 1, 1, 1, 0, 1), (5, 1.0, 60, 0.0, 70, 0.0, 1, 1, 0, 0, 1), (2, 1.0, 3, 1.0, 4, 1.0, 1, 1, 0, 0, 1), (9, 0.0, 1, 1.0, 1, 1.0, 1, 1, 0, 0, 1), (1, 1.0, 0, 0.0, 0, 0.0, 1, 1, 0, 0, 1),
    # the same page outside its article
    (1, 1.0, 0, 0.0, 1, 1.0, 0, 1, 0, 1, 0), (1, 1.0, 1, 1.0, 9, 0.0, 0, 1, 0, 0, 0), (9, 0.0, 1, 1.0, 12, 0.0, 0, 1, 0, 0, 0), (14, 0.0, 60, 0.0, 0, 0.0, 0, 1, 0, 1, 0), (30, 0.0, 1, 1.0, 12, 0.0, 0, 1, 0, 0, 0),
    (90, 0.0, 80, 0.0, 20, 0.2, 0, 1, 0, 0, 0), (2, 0.0, 0, 0.0, 5, 1.0, 0, 1, 1, 0, 0), (40, 0.1, 20, 0.0, 40, 0.0, 0, 1, 0, 0, 0), (5, 0.0, 30, 0.0, 30, 0.0, 0, 1, 0, 0, 0), (70, 0.0, 60, 0.0, 90, 0.0, 0, 1, 0, 1, 0),
    # boilerplate that stands inside the article
    (20, 0.0, 60, 0.0, 70, 0.0, 1, 1, 0, 1, 0), (6, 0.0, 40, 0.0, 12, 0.0, 1, 1, 0, 1, 0), (60, 0.0, 90, 0.0, 50, 0.0, 1, 1, 0, 1, 0), (3, 1.0, 5, 1.0, 5, 1.0, 1, 1, 0, 1, 0), (4, 0.0, 80, 0.0, 30, 0.0, 1, 1, 1, 1, 0),
    (110, 0.0, 4, 0.0, 100, 0.0, 1, 1, 0, 1, 0), (2, 0.0, 0, 0.0, 3, 0.0, 1, 1, 0, 1, 0),
    # a page without an article element: text whose neighbours have few links, however short
    (80, 0.0, 60, 0.0, 70, 0.0, 0, 0, 0, 0, 1), (45, 0.05, 5, 0.0, 60, 0.0, 0, 0, 0, 0, 1), (25, 0.0, 40, 0.0, 30, 0.0, 0, 0, 0, 0, 1), (18, 0.1, 70, 0.0, 2, 1.0, 0, 0, 0, 0, 1), (12, 0.0, 60, 0.0, 55, 0.0, 0, 0, 0, 0, 1),
    (6, 0.0, 50, 0.0, 80, 0.0, 0, 0, 0, 0, 1), (8, 0.0, 2, 1.0, 60, 0.0, 0, 0, 1, 0, 1), (3, 0.0, 40, 0.0, 60, 0.0, 0, 0, 1, 0, 1), (200, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 0, 1), (30, 0.2, 2, 1.0, 2, 1.0, 0, 0, 0, 0, 1),
    (1, 0.0, 0, 0.0, 2, 0.0, 0, 0, 1, 0, 1), (2, 0.0, 1, 0.0, 0, 0.0, 0, 0, 0, 0, 1), (3, 0.0, 0, 0.0, 4, 0.0, 0, 0, 0, 0, 1), (4, 0.0, 3, 0.0, 0, 0.0, 0, 0, 0, 0, 1), (2, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 0, 1), (20, 0.3, 2, 0.0, 3, 0.0, 0, 0, 0, 0, 1),
    (4, 0.0, 1, 1.0, 0, 0.0, 0, 0, 0, 0, 1), (4, 0.0, 2, 1.0, 5, 0.0, 0, 0, 0, 0, 1), (2, 0.0, 3, 1.0, 2, 0.0, 0, 0, 1, 0, 1), (9, 0.0, 1, 1.0, 3, 0.0, 0, 0, 0, 0, 1),
    (4, 0.0, 9, 0.0, 2, 1.0, 0, 0, 0, 0, 1), (2, 0.0, 0, 0.0, 3, 1.0, 0, 0, 0, 0, 1), (3, 0.0, 5, 0.0, 1, 1.0, 0, 0, 1, 0, 1), (1, 0.0, 6, 0.0, 4, 1.0, 0, 0, 0, 0, 1), (4, 0.0, 4, 0.0, 4, 1.0, 0, 0, 0, 0, 1),
    (3, 0.0, 1, 1.0, 9, 0.0, 0, 0, 1, 0, 1), (6, 0.0, 1, 1.0, 8, 0.1, 0, 0, 0, 0, 1), (5, 0.0, 9, 0.0, 2, 1.0, 0, 0, 0, 0, 1), (7, 0.4, 20, 0.0, 15, 0.0, 0, 0, 0, 0, 1), (35, 0.4, 50, 0.0, 3, 0.9, 0, 0, 0, 0, 1),
    # a list of links, and what stands among them
    (1, 1.0, 1, 1.0, 1, 1.0, 0, 0, 0, 0, 0), (2, 1.0, 0, 0.0, 60, 0.0, 0, 0, 0, 0, 0), (3, 1.0, 50, 0.0, 3, 1.0, 0, 0, 0, 0, 0), (12, 0.8, 2, 1.0, 3, 1.0, 0, 0, 0, 0, 0), (25, 0.7, 60, 0.0, 9, 0.0, 0, 0, 0, 0, 0), (3, 0.7, 40, 0.0, 50, 0.0, 0, 0, 0, 0, 0),
    (4, 0.0, 1, 1.0, 2, 1.0, 0, 0, 0, 0, 0), (4, 0.0, 2, 1.0, 3, 1.0, 0, 0, 1, 0, 0), (2, 0.0, 3, 1.0, 1, 0.9, 0, 0, 0, 0, 0), (8, 0.0, 2, 0.9, 4, 0.8, 0, 0, 0, 0, 0), (5, 0.3, 2, 1.0, 3, 0.7, 0, 0, 0, 0, 0), (60, 0.9, 2, 1.0, 50, 0.0, 0, 0, 0, 0, 0),
    # its boilerplate by name
    (60, 0.0, 50, 0.0, 40, 0.0, 0, 0, 0, 1, 0), (30, 0.0, 2, 1.0, 9, 0.0, 0, 0, 0, 1, 0), (2, 1.0, 2, 1.0, 2, 1.0, 0, 0, 0, 1, 0), (4, 0.0, 30, 0.0, 40, 0.0, 0, 0, 0, 1, 0), (1, 0.0, 0, 0.0, 1, 0.0, 0, 0, 1, 1, 0),
]


@cache
def model() -> tree.Node:
    return tree.grow([r[:-1] for r in LABELLED], [r[-1] for r in LABELLED])


def hints(names: str) -> bool:
    """Whether a class, id or role names boilerplate."""
    for name in names.lower().split():
        parts = [p for p in re.split(r"[-_:]+", name) if p]
        if any(CLEAR.fullmatch(p) for p in parts) or CLEAR.fullmatch(name):
            return True
        vague = sum(p in VAGUE for p in parts)
        if vague and all(p in VAGUE or p in BESIDE or p.isdigit() for p in parts):
            return True
    return False


_NOWHERE = ("", False, False, False)


def blocks(page: str) -> list[tuple[str, float, bool, bool, bool]]:
    """(text, link density, hint of boilerplate, in article, heading) of each block with text."""
    out: list[tuple[str, float, bool, bool, bool]] = []
    stack: list[tuple[str, bool, bool, bool]] = []  # tag, hint, article, heading
    text: list[str] = []
    linked: list[str] = []
    links = 0
    passing = False  # the last of the stack is an unclosed element that the next block ends
    closes: dict[str, int] = {}  # where each raw element's next end tag is
    state = _NOWHERE[1:]

    def flush() -> None:
        nonlocal text, linked
        if text:
            joined = " ".join(_html.unescape("".join(text)).split())
            if joined:
                n = joined.count(" ") + 1
                inside = len(_html.unescape(" ".join(linked)).split()) if linked else 0
                out.append((joined, min(1.0, inside / n), *state))
            text, linked = [], []

    def add(piece: str) -> None:
        nonlocal state
        if stack and stack[-1][0] == "head" and not piece.isspace():
            stack.pop()  # text ends an unclosed head
            state = stack[-1][1:] if stack else _NOWHERE[1:]
        text.append(piece)
        if links:
            linked.append(piece)

    at, skip_to, last, lower = 0, 0, page.rfind(">") + 1, None
    for m in _TOKEN.finditer(page, 0, last):
        if m.start() < skip_to:
            continue
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        block = tag in BLOCK or tag in RAW
        if passing and tag in ("option", "optgroup"):
            continue
        if passing and block:
            flush()
            stack.pop()
            passing, state = False, stack[-1][1:] if stack else _NOWHERE[1:]
        if stack and stack[-1][0] == "head" and not m[1] and tag not in IN_HEAD:
            flush()
            stack.pop()
            state = stack[-1][1:] if stack else _NOWHERE[1:]
        if tag in RAW and not m[1] and not m[3].endswith("/"):
            # its content is no text of the page, whatever tags it seems to hold
            lower = page.lower() if lower is None else lower
            if len(lower) != len(page):
                lower = re.sub("[A-Z]+", lambda x: x[0].lower(), page)
            close = closes.get(tag, 0)
            if 0 <= close < at:
                close = closes[tag] = lower.find(f"</{tag}", at)
            code = tag in ("script", "style")
            if close < 0 and code:
                at = skip_to = len(page)
            elif close < 0 or not code and tag != "svg" and lower.find(f"<{tag}", at, close) >= 0:
                flush()
                _, _, article, _ = stack[-1] if stack else _NOWHERE
                stack.append((tag, True, article, False))
                passing, state = True, stack[-1][1:]
            else:
                at = page.find(">", close) + 1 or len(page)
                skip_to = at
            continue
        if tag == "a":
            links = 0 if m[1] else 1
            continue
        names = " ".join(x for g in _ATTRIBUTE.findall(m[3]) for x in g if x) if m[3] and not m[1] else ""
        named = bool(names) and hints(names)
        if not block and not named:
            if m[1] and any(s[0] == tag for s in stack[-3:]):
                flush()
                while stack.pop()[0] != tag:
                    pass
                state = stack[-1][1:] if stack else _NOWHERE[1:]
            continue
        flush()
        if m[1]:
            if any(s[0] == tag for s in stack):
                while stack.pop()[0] != tag:
                    pass
        elif tag not in VOID:
            if stack and stack[-1][0] == "p" and tag in BLOCK:
                stack.pop()  # a block ends an open paragraph
            _, bad, article, _ = stack[-1] if stack else _NOWHERE
            main = tag in ("article", "main") or bool(names and _ARTICLE.search(names) and not named)
            bad = bad or tag in BOILERPLATE or bool(m[3] and _HIDDEN.search(m[3])) or (named and tag not in ("body", "html", "article", "main"))
            stack.append((tag, bad, article or main, tag in ("h1", "h2", "h3", "h4", "h5", "h6")))
        state = stack[-1][1:] if stack else _NOWHERE[1:]
    if at < len(page):
        rest = page[at:]
        broken = _TAG_LIKE.search(rest)  # a tag that never ends
        add(rest[: broken.start()] if broken else rest)
    flush()
    return out


def main_text(page: str | None) -> str:
    found = blocks(page) if page else []
    if not found:
        return ""
    root, has_article = model(), any(b[3] for b in found)
    sizes = [(b[0].count(" ") + 1, b[1]) for b in found]
    sizes.append((0, 0.0))  # also before the first
    kept = []
    for k, (text, _, bad, article, heading) in enumerate(found):
        row = (*sizes[k], *sizes[k - 1], *sizes[k + 1], article, has_article, heading, bad)
        if tree.share(root, row) > 0.5:
            kept.append(text)
    return " ".join(kept)


def extract(pages: DataFrame, column: str = "html") -> DataFrame:
    """page_id, url, text, n_chars."""

    def start() -> Callable:
        def each(batch: pa.RecordBatch) -> dict:
            text = [main_text(p) for p in batch.column(column).to_pylist()]
            return {"text": text, "n_chars": [len(t) for t in text]}

        return each

    return mapped(pages.select("page_id", "url", column), start, {"text": "string", "n_chars": "long"}, ["page_id", "url"])


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return extract(table(spark, sf_dir, "pages"))
