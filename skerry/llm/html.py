"""Main text of web pages by tag-path ratios.

A page is read as a run of text blocks, each under the path of block-level tags from the root to it (with the class and
id words that name a part of a page). Per path, the text length and the punctuation of its blocks are divided by the
number of blocks; both ratios are smoothed over neighbouring paths in page order, fused by their product and by the share of
text that is no link, and paths above a share of the best one are content nodes. Paths inside an article or main element weigh
more, as the page says so itself.

The innermost element that holds nine tenths of the text of the content nodes is the article: all its blocks are kept, short
ones, tables, captions and code included, with the headings right before it. If no element but the body does, the parts of the
page that hold content nodes are kept. Menus, headers, footers, sidebars, adverts, notices, forms, scripts, styles and comments
are no content wherever they are marked; inside an article or main element fewer words in a class or id count as such marks.
The mark that a class, an id or a form puts on all below it is void where that element holds most of the page's text, and some
of what is in an article or main element if the page has one.

Null and empty pages give an empty text, an empty table no rows. Broken markup (unclosed tags, a missing end) is read as browsers
do: a new block closes an open paragraph, and nothing but its own end tag ends a script or style. Whole pages are read,
whatever their length. Repeated rows give repeated results; of equal paths the first in page order leads. Other columns,
whatever their names, are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from math import exp
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

_TOKEN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|</?[A-Za-z](?:[^<>\"']|\"[^\"]*\"|'[^']*')*>|[^<]+|<", re.S)
_TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9:-]*)(.*?)/?>\Z", re.S)
_NAMED = re.compile(r"\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_WHITE = re.compile(r"\s+")
#: Elements whose content is no text, elements that stand in a line of text, and elements that are never content.
RAW = frozenset({"script", "style", "noscript", "template", "textarea", "title", "svg", "annotation", "annotation-xml", "iframe", "object", "canvas", "xmp", "noembed", "noframes"})
INLINE = frozenset({"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img", "picture", "source",
    "math", "mi", "mo", "mn", "ms", "mtext", "mrow", "msup", "msub", "msubsup", "mfrac", "msqrt", "mroot", "mover", "munder", "munderover", "mfenced", "mstyle", "mspace", "semantics"})
VOID = frozenset({"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"})
BOILERPLATE = frozenset({"nav", "header", "footer", "aside", "form", "button", "select", "option", "menu", "dialog", "head", "fieldset"})
PART = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|cookie\w*|consent|gdpr|notice|popup|modal|nav|navbar|navigation|menu|breadcrumbs?|header|masthead|footer|sidebar|aside|rail|widget|related|recommend\w*|share|sharing|social|subscribe|newsletter|signup|login|search|comments?|commentlist|disqus|replies|respond|tags|toc|pagination|pager|copyright|legal|disclaimer|toolbar|alert|skip)(?:$|[\s_-])", re.I)
#: The words among them that mark a part inside an article too.
PART_INSIDE = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|cookie\w*|consent|gdpr|popup|modal|nav|navbar|navigation|breadcrumbs?|footer|sidebar|related|recommend\w*|share|sharing|social|subscribe|newsletter|signup|comments?|commentlist|disqus|replies|respond|pagination|pager|toolbar)(?:$|[\s_-])", re.I)
#: Elements that hold other blocks but are no part of a text themselves: the article is one of them.
HOLDERS = frozenset({"html", "body", "div", "section", "article", "main", "center", "table", "tbody", "tr", "td", "form"})
ROLES = frozenset({"navigation", "banner", "contentinfo", "complementary", "search", "form", "menu", "menubar", "dialog", "alert", "alertdialog", "toolbar"})
#: Closed by any block that opens after them.
SHUT_BY_BLOCK = frozenset({"p", "h1", "h2", "h3", "h4", "h5", "h6"})
SIBLINGS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
_HEADING = re.compile(r"(?:^|/)h[1-6](?:\.[^/]*)?$")
_PUNCTUATION = re.compile(r"[,.;:!?，。；：！？、]")


class Block(NamedTuple):
    """A block of text: its path, whether it is boilerplate by name, whether it is in an article or main element, the numbers of
    the elements around it from the root on, and how many of its characters are links."""

    path: str
    bad: bool
    good: bool
    elements: tuple[int, ...]
    linked: int
    text: str


class Element(NamedTuple):
    label: str
    number: int
    bad: bool
    good: bool
    marks: tuple[int, ...]


def _ends(page: str, name: str, at: int) -> int:
    """Where the end tag of a raw element begins, or the page's end."""
    found = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
    return found.start() if found else len(page)


def text_blocks(page: str) -> list[Block]:
    """The blocks of a page, in page order."""
    stack: list[Element] = []
    out: list[tuple[Block, tuple[int, ...]]] = []
    n_marks = n_elements = at = anchors = linked = 0
    run: list[str] = []

    def flush() -> None:
        nonlocal linked
        if run:
            text = _WHITE.sub(" ", entities.unescape("".join(run))).strip()
            run.clear()
            if text:
                top = stack[-1] if stack else Element("", 0, False, False, ())
                out.append((Block("/".join(e.label for e in stack), top.bad, top.good, tuple(e.number for e in stack), min(linked, len(text)), text), top.marks))
        linked = 0

    while at < len(page):
        token = _TOKEN.match(page, at)[0]
        at += len(token)
        if token[0] != "<" or token == "<":
            run.append(token)
            linked += len(token) if anchors else 0
            continue
        t = _TAG.match(token)
        if not t:
            if token.startswith("<![CDATA["):
                run.append(entities.escape(token[9:].removesuffix("]]>")))
            continue
        closing, name, rest = t[1], t[2].lower(), t[3]
        if name in RAW:
            if not closing and not token.endswith("/>"):
                at = _ends(page, name, at)
            continue
        if name in INLINE:
            if name == "a":
                anchors = 0 if closing else 1
            continue
        flush()
        if name in VOID:
            continue
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].label.partition(".")[0] == name:
                    del stack[k:]
                    break
            continue
        while stack and stack[-1].label.partition(".")[0] in SHUT_BY_BLOCK:
            stack.pop()
        if name in SIBLINGS:
            for k in range(len(stack) - 1, -1, -1):
                label = stack[k].label.partition(".")[0]
                if label in SIBLINGS[name]:
                    break
                if label == name or (name in ("dt", "dd") and label in ("dt", "dd")) or (name in ("td", "th") and label in ("td", "th")):
                    del stack[k:]
                    break
        _, _, bad, good, marked = stack[-1] if stack else Element("", 0, False, False, ())
        named = {a[0].lower(): a[1] or a[2] or a[3] for a in _NAMED.findall(rest)} if rest else {}
        marks = " ".join(named.get(k, "") for k in ("class", "id")).strip()
        main = name in ("article", "main") or named.get("role", "").lower() in ("main", "article")
        hidden = "hidden" in named or named.get("aria-hidden", "").lower() == "true"
        # the heading of an article, and what it calls out, are part of it
        own = (name not in BOILERPLATE or name == "form") and named.get("role", "").lower() not in ROLES
        if hidden or not (own or good and (name == "header" or named.get("role", "").lower() == "alert")):
            bad = True
        if name == "form" or (marks and not main and name not in ("html", "body") and (PART_INSIDE if good else PART).search(marks)):
            marked = (*marked, n_marks)
            n_marks += 1
        n_elements += 1
        stack.append(Element(f"{name}.{'.'.join(marks.lower().split())}" if marks else name, n_elements, bad, good or main, marked))
    flush()
    if not n_marks:
        return [b for b, _ in out]
    held, mains = [0] * n_marks, [False] * n_marks
    for b, marked in out:
        for k in marked:
            held[k] += len(b.text)
            mains[k] |= b.good and not b.bad
    most = sum(len(b.text) for b, _ in out) / 2
    needed = any(b.good and not b.bad for b, _ in out)
    void = [h > most and (m or not needed) for h, m in zip(held, mains, strict=True)]
    return [b._replace(bad=b.bad or not all(void[k] for k in marked)) for b, marked in out]


def smooth(values: list[float], radius: int = 1) -> list[float]:
    """Weighted mean of each value and its neighbours, the weights falling as a bell curve."""
    weight = [exp(-(k * k) / (2 * max(radius, 1) ** 2)) for k in range(radius + 1)]
    out = []
    for i in range(len(values)):
        near = [(weight[abs(i - j)], values[j]) for j in range(max(0, i - radius), min(len(values), i + radius + 1))]
        out.append(sum(w * v for w, v in near) / sum(w for w, _ in near))
    return out


def path_scores(blocks: list[Block], weight: float) -> dict[str, float]:
    """The fused ratio of each path, in page order of the paths."""
    sums: dict[str, list[float]] = {}
    for b in blocks:
        s = sums.setdefault(b.path, [0, 0, 0, 0, 1.0])
        for k, x in enumerate((1, len(b.text), len(_PUNCTUATION.findall(b.text)), b.linked)):
            s[k] += x
        s[4] = weight if b.good else 1.0
    texts, marks = (smooth([s[k] / s[0] for s in sums.values()]) for k in (1, 2))
    return {p: s[4] * t * (1 + c) * (1 - s[3] / s[1]) for (p, s), t, c in zip(sums.items(), texts, marks, strict=True)}


def main_text(page: str | None, share: float = 0.25, weight: float = 4.0, most: float = 0.9) -> str:
    """The content blocks of a page, joined by line breaks; share: of the best path's ratio; weight: of paths in an article or
    main element; most: of the content nodes' text that the article holds."""
    blocks = [b for b in text_blocks(page or "") if not b.bad]
    if not blocks:
        return ""
    scores = path_scores(blocks, weight)
    best = max(scores.values())
    nodes = [b for b in blocks if scores[b.path] >= share * best]
    total = sum(len(b.text) for b in nodes)
    held: dict[int, int] = {}
    for b in nodes:
        for e in b.elements:
            held[e] = held.get(e, 0) + len(b.text)
    # elements are numbered in page order, so the last one that holds enough is the innermost
    kinds = {e: label.partition(".")[0] for b in blocks for e, label in zip(b.elements, b.path.split("/"), strict=True)}
    enough = [e for e, n in held.items() if n >= most * total and kinds[e] in HOLDERS]
    inmost = max(enough, default=0)
    outer = next((e for b in nodes if inmost in b.elements for e in b.elements if kinds[e] in ("article", "main") and e in enough), inmost)
    if outer and kinds[outer] not in ("html", "body"):
        kept = [outer in b.elements for b in blocks]
    else:
        # the parts below the body, or below nothing, that hold content nodes
        below = lambda b: b.elements[b.elements.index(outer) + 1 :][:1] if outer in b.elements else b.elements[:1]
        parts = {below(b) for b in nodes}
        kept = [below(b) in parts and (bool(below(b)) or scores[b.path] >= share * best) for b in blocks]
    # headings belong to the content that follows them
    for k in range(len(blocks) - 2, -1, -1):
        kept[k] |= kept[k + 1] and bool(_HEADING.search(blocks[k].path))
    return "\n".join(b.text for b, keep in zip(blocks, kept, strict=True) if keep)


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    schema = pages.select("page_id", "url").schema.simpleString()[7:-1] + ",text:string,n_chars:bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p.as_py()) for p in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, schema)
