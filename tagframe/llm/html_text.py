"""Main text of web pages by tag-path ratios.

Every block of text has a tag path: the block elements from the root down to it, containers by tag and class. For each
path the characters and the punctuation of its blocks are added up and divided by their number. Along the page these two
ratios are smoothed over neighbouring blocks and fused into one value; a path's value is the mean of those of its blocks.
Words of class and id, links and article elements only weigh: they multiply the value. Paths whose value reaches the
page's threshold (`threshold_of`) are content, and their blocks are content blocks.

The text is all content blocks, the headings right before them, and what else lies in the element that holds most of
the content without a mark against it (short items of a list, say). Elements that are never article by tag or role
(navigation, scripts, forms and so on) are left out before the ratios are taken.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table

#: Share of the content's characters that the article's element holds, and weight of a block's own ratios beside those of
#: its two neighbours.
MOST, OWN = 0.8, 0.5
#: What a value is multiplied by inside article or main elements, and under telling words of class or id.
INSIDE, TELLING = 4.0, 0.1
#: The least value of content, and the share of link text from which a path is a list of links.
LEAST, LINKS = 1.0, 0.8

RAW = {"script", "style", "title", "textarea", "noscript", "iframe", "xmp", "noembed", "noframes", "template"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "mark", "nobr", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
ENDS_P = {"address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "table", "ul"}
#: Where looking for an open p stops.
KEEPS_P = {"button", "td", "th", "table", "li", "div", "article", "section", "main", "body"}
#: What an opening tag closes when it is the innermost open one of these, and where looking for it stops.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Containers, whose class or id is part of the path.
NAMED = {"div", "section", "table", "td", "ul", "ol", "dl"}
#: Elements that can be the article.
HOLDERS = {"article", "main", "section", "div", "body"}
NEVER = {"head", "nav", "footer", "aside", "form", "button", "select", "svg", "canvas", "object", "audio", "video", "menu", "dialog", "search", "fieldset", "label", "input"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "menu", "menubar", "toolbar", "alert", "dialog", "alertdialog", "status"}
#: Words of class and id that speak against an article.
WORDS = {
    "ad", "ads", "advert", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "copyright", "disclaimer", "footer", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter",
    "notice", "overlay", "pagination", "popup", "promo", "recommended", "related", "replies", "share", "sidebar", "social", "sponsor", "sponsored", "subscribe", "teaser", "toolbar", "trending", "widget",
}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_SPLIT = re.compile(r"[^a-z]+")
_PUNCTUATION = re.compile(r"[.,;:!?…。，、！？；：]")


def attributes_of(text: str) -> dict[str, str]:
    return {name.lower(): value.strip("\"'").lower() for name, value in _ATTRIBUTE.findall(text)} if text.strip() else {}


def refused(tag: str, attributes: dict[str, str], inside: bool) -> bool:
    """Whether tag, role or hiding say that an element is no article. inside: whether an article or main is open."""
    if tag in NEVER or tag == "header" and not inside:
        return True
    if not attributes or tag in ("html", "body", "article", "main"):
        return False
    return "hidden" in attributes or attributes.get("aria-hidden") == "true" or attributes.get("role") in ROLES


def telling(tag: str, attributes: dict[str, str], inside: bool) -> bool:
    """Whether words of class or id speak against an element."""
    if not attributes or tag in ("html", "body", "article", "main"):
        return False
    for name in ("class", "id"):
        words = set(_SPLIT.split(attributes.get(name, "")))
        if {"has", "with", "no"} & words:  # says what is beside it
            continue
        if words & WORDS or "header" in words and not inside:
            return True
    return False


@dataclass
class Page:
    """The block elements of a page, each with its parent and path, and its blocks of text in order.

    A path is a number; its parent, tag, depth and marks stand in lists, so deep nesting takes memory in proportion.
    """

    parent: list[int] = field(default_factory=lambda: [-1])
    path: list[int] = field(default_factory=lambda: [0])
    tag: list[str] = field(default_factory=lambda: [""])
    depth: list[int] = field(default_factory=lambda: [0])  # of paths, as are the next two
    against: list[int] = field(default_factory=lambda: [0])  # elements on it with telling words
    inside: list[bool] = field(default_factory=lambda: [False])  # article or main on it
    known: dict[tuple[int, str], int] = field(default_factory=dict)
    blocks: list[tuple[int, str, int]] = field(default_factory=list)  # element, text, characters in links

    def step(self, path: int, tag: str, attributes: dict[str, str]) -> int:
        marked = telling(tag, attributes, self.inside[path])
        name = re.sub(r"\d+", "", attributes.get("class") or attributes.get("id") or "") if tag in NAMED else ""
        key = path, f"{tag}.{name}{'!' * marked}"
        if key not in self.known:
            self.known[key] = len(self.depth)
            self.depth.append(self.depth[path] + 1)
            self.against.append(self.against[path] + marked)
            self.inside.append(self.inside[path] or tag in ("article", "main"))
        return self.known[key]


def read(source: str, wanted: frozenset[int] = frozenset()) -> Page:
    """A page's blocks. A form that holds an article or main element, or MOST of the text, is read like a div (wanted)."""
    page = Page()
    stack = [("", 0, 0)]  # tag, element, unwanted: 0 no, 1 yes, -k only as it is in the page's form k
    open_: Counter[str] = Counter()
    forms, inner, around = 0, defaultdict(int), set()  # forms so far, characters in each, and those around an article
    pieces: list[tuple[int, str, int, bool]] = []  # element, text, block, in a link
    block, at, size, link = 0, 0, len(source), 0  # link: height of the stack where an a was opened

    def pop() -> None:
        nonlocal link
        open_[stack.pop()[0]] -= 1
        if link > len(stack):
            link = 0

    def close(tags: set[str], stops: set[str]) -> None:
        if not any(open_[t] for t in tags):
            return
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in tags:
                while len(stack) > k:
                    pop()
                return
            if stack[k][0] in stops:
                return

    def judged(tag: str, attributes: dict[str, str]) -> int:
        outer = stack[-1][2]
        if outer > 0:
            return outer
        inside = open_["article"] + open_["main"] > 0
        if tag == "form":
            return 1 if refused("div", attributes, inside) else outer or (0 if forms in wanted else -forms)
        return 1 if refused(tag, attributes, inside) else outer

    while at <= size:
        m = _TOKEN.search(source, at)
        end = m.start() if m else size
        if end > at and not stack[-1][2]:
            pieces.append((stack[-1][1], source[at:end], block, link > 0))
        elif end > at and stack[-1][2] < 0:
            inner[-stack[-1][2]] += len(source[at:end].strip())
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag == "a":
                link = 0
            elif tag not in INLINE:
                block += 1
                close({tag}, set())
            continue
        if tag in RAW:
            ends = re.compile(f"</{tag}[\\s/>]", re.I).search(source, at)
            at = source.find(">", ends.start()) + 1 if ends else size
            at = at or size
            continue
        forms += tag == "form"
        attributes = attributes_of(m[3])
        if tag in INLINE:
            if tag == "br":
                pieces.append((stack[-1][1], " ", block, False)) if not stack[-1][2] else None
            elif tag not in VOID and not stack[-1][2] and judged(tag, attributes):  # ends where it is closed
                ends = re.compile(f"</{tag}\\s*>", re.I).search(source, at)
                at = ends.end() if ends else at
            elif tag == "a":
                link = len(stack)
            continue
        block += 1
        if tag in ENDS_P:
            close({"p"}, KEEPS_P)
        elif tag in CLOSES:
            close(*CLOSES[tag])
        unwanted = judged(tag, attributes)
        if tag in ("article", "main"):
            around.add(-unwanted)
        if tag in VOID or m[3].endswith("/") and tag not in ENDS_P:
            continue
        page.parent.append(stack[-1][1])
        page.path.append(page.step(page.path[stack[-1][1]], tag, attributes))
        page.tag.append(tag)
        stack.append((tag, len(page.parent) - 1, unwanted))
        open_[tag] += 1
    whole = sum(len(text.strip()) for _, text, _, _ in pieces) + sum(inner.values()) if inner else 0
    more = {k for k in inner if inner[k] >= MOST * whole > 0} | {k for k in around if k > 0}
    if more - wanted:
        return read(source, wanted | more)

    start = 0
    for k in range(1, len(pieces) + 1):
        if k == len(pieces) or pieces[k][2] != pieces[start][2]:
            text = " ".join(html.unescape("".join(p[1] for p in pieces[start:k])).split())
            if text:
                page.blocks.append((pieces[start][0], text, min(len(text), sum(len(p[1].strip()) for p in pieces[start:k] if p[3]))))
            start = k
    return page


def smoothed(values: list[float]) -> list[float]:
    side, last = (1 - OWN) / 2, len(values) - 1
    return [side * values[max(0, k - 1)] + OWN * x + side * values[min(last, k + 1)] for k, x in enumerate(values)]


def threshold_of(values: list[float], masses: list[float]) -> float:
    """From the paths' values, each counted by the mass of its characters: the mean less half a deviation, but between a quarter and 0.6 of the mean."""
    whole = sum(masses)
    mean = sum(v * m for v, m in zip(values, masses, strict=True)) / whole
    spread = math.sqrt(sum(m * (v - mean) ** 2 for v, m in zip(values, masses, strict=True)) / whole)
    return max(LEAST, mean / 4, min(0.6 * mean, mean - spread / 2))


def content_paths(page: Page) -> tuple[set[int], set[int], float]:
    """(paths of content, paths of links, threshold)."""
    chars, marks, count, links = (defaultdict(int) for _ in range(4))
    paths = [page.path[element] for element, _, _ in page.blocks]
    for p, (_, text, linked) in zip(paths, page.blocks, strict=True):
        chars[p] += len(text)
        marks[p] += len(_PUNCTUATION.findall(text))
        count[p] += 1
        links[p] += linked
    length = smoothed([chars[p] / count[p] for p in paths])
    dots = smoothed([1 + marks[p] / count[p] for p in paths])
    total = defaultdict(float)
    for p, a, b in zip(paths, length, dots, strict=True):
        total[p] += math.sqrt(a * b)
    weight = {p: (INSIDE if page.inside[p] else 1.0) * (TELLING if page.against[p] else 1.0) * max(0.05, 1 - links[p] / chars[p]) for p in count}
    value = {p: weight[p] * total[p] / count[p] for p in count}
    threshold = threshold_of(list(value.values()), [chars[p] * weight[p] for p in value])
    return {p for p in value if value[p] >= threshold}, {p for p in count if links[p] > LINKS * chars[p]}, threshold


def main_text(source: str | None) -> tuple[str, int, float]:
    """(text, number of blocks, threshold) of one page."""
    page = read(source or "")
    if not page.blocks:
        return "", 0, 0.0
    content, links, threshold = content_paths(page)
    # characters of content below each element; the deepest element with most of them, or the article around it
    held = [0] * len(page.parent)
    for element, text, _ in page.blocks:
        if page.path[element] in content:
            held[element] += len(text)
    for k in range(len(held) - 1, 0, -1):
        held[page.parent[k]] += held[k]
    if not held[0]:
        return "", 0, threshold
    article = max((k for k in range(len(held)) if held[k] >= MOST * held[0]), key=lambda k: (page.depth[page.path[k]], held[k]))
    while article and page.tag[article] not in HOLDERS:
        article = page.parent[article]
    above = article
    while above and page.tag[above] not in ("article", "main"):
        above = page.parent[above]
    article = above or article
    within = [k == article for k in range(len(held))]
    for k in range(1, len(held)):
        within[k] |= within[page.parent[k]]
    against = page.against[page.path[article]]

    keep = []
    for element, _, _ in page.blocks:
        p = page.path[element]
        keep.append(p in content or within[element] and page.against[p] == against and p not in links)
    for k in range(len(keep) - 2, -1, -1):  # headings of what is kept
        p = page.path[page.blocks[k][0]]
        keep[k] = keep[k] or keep[k + 1] and page.tag[page.blocks[k][0]] in HEADINGS and not page.against[p]
    kept = [text for (_, text, _), yes in zip(page.blocks, keep, strict=True) if yes]
    return "\n".join(kept), len(kept), threshold


def extracted(pages: DataFrame, source: str = "html") -> DataFrame:
    """pages(html, ...) with text, n_chars, n_blocks and threshold in the place of html; clashing columns are replaced.

    Null, empty and text-free pages have an empty text. Repeated rows stay, empty tables stay empty. Whole pages are
    read, however long; broken markup is read as far as it goes.
    """
    new = ("text", "n_chars", "n_blocks", "threshold")
    keep = [c for c in pages.columns if c != source and c not in new]
    rows = pages.select(*keep, F.col(source).alias("__page"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__page"):
            got = [main_text(p) for p in batch["__page"].to_pylist()]
            text = [t for t, _, _ in got]
            yield pa.RecordBatch.from_arrays(
                [*(batch[c] for c in keep), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64()), pa.array([n for _, n, _ in got], pa.int64()), pa.array([x for _, _, x in got], pa.float64())],
                [*keep, *new],
            )

    schema = rows.select(*keep, F.lit("").alias("text"), F.lit(0).cast("bigint").alias("n_chars"), F.lit(0).cast("bigint").alias("n_blocks"), F.lit(0.0).alias("threshold")).schema
    return rows.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extracted(pages).select("page_id", "url", "text", "n_chars")
