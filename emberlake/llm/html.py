"""Operator 2, main text of web pages by tag-path ratios.

The text nodes of a page are grouped by their path of tags from the root. Each path has the mean text length
and the mean number of punctuation marks of its nodes; both series, in the order of the page, are smoothed,
and fused into a weight. Paths through parts that are something else than the article (menus, footers, forms,
comments and so on, by tag, role or class) weigh nothing, and those within a marked main part BOOST times as much. A class name that
may stand for a part of an article (`nav-lead`, `related-work`) lowers the weight of what it marks in a main part, and no more; its nodes stay if they
reach the threshold all the same. Where hardly any text is left beside what is aside, such class names and forms don't count on the elements
that hold most of the text, as they wrap the page. Nodes of paths whose weight reaches a threshold are content. The article is the outermost marked main parts, if they hold all content nodes;
else it is the lowest element that holds all of them and is no block of text. Its text is that of all its nodes with
weight, so that headings and short lines between content nodes stay.

Edge cases: null and empty pages, or pages without text, give the empty text; rows are read one by one, so
repeated rows give repeated results; pages of any size are read whole; markup that is broken off or badly
nested is read as browsers would, near enough; an empty table gives an empty table; only the id, the url and
the page are read. Nothing shuffles.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Share of the strongest weight that a path must reach; nodes at either side that the smoothing looks at.
LEAST, SIDES = 0.25, 1
#: How many times as much a path within a marked main part weighs.
BOOST = 2.0

_WORDS = lambda s: frozenset(s.split())
VOID = _WORDS("area base br col embed hr img input link meta param source track wbr")
RAW = _WORDS("script style textarea title noscript template iframe noembed noframes xmp svg object canvas")
INLINE = _WORDS("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img")
#: Elements that hold a piece of a text and never the whole.
PIECE = _WORDS("p h1 h2 h3 h4 h5 h6 pre blockquote address ul ol li dl dt dd table caption thead tbody tfoot tr td th figure figcaption details summary hgroup header center") | INLINE
#: Elements that are never part of an article.
ASIDE = _WORDS("nav aside footer form button select dialog menu head fieldset datalist")
ROLES = _WORDS("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form")
#: Words in class names and ids. The first tell what no article holds; the second may stand for a wrapper of it, or for a part of its text.
NEVER, RARELY = (
    re.compile(rf"(?:^|[\s_-])(?:{words})(?:$|[\s_-])", re.I)
    for words in (
        r"ads?|advert\w*|cookies?|consent|gdpr|notices?|alerts?|popup|comments?|disqus|respon[ds]\w*|repl(?:y|ies)|share\w*|sharing|social\w*|promo\w*|sponsor\w*|newsletter|subscri\w*|sign-?up|log-?in|breadcrumbs?|pagination|pager|footer",
        r"banner|menu\w*|nav\w*|sidebar\w*|modal|overlay|related\w*|recommend\w*|header|masthead|toolbar|widgets?|teasers?|skip",
    )
)
#: Elements that are aside for their tag, but wrap whole pages at times.
WRAPPERS = _WORDS("form fieldset")
#: Where what isn't aside has less than this share of a page's text, the marks of what holds most of it don't count. The weight's factor in a part of an article that is marked.
SCARCE, DOUBTED = 0.1, 0.5
CLOSES = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}
TOKEN = re.compile(r"<!--(?:.*?-->|.*$)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)", re.S)
#: The attributes of a tag, to its end.
END = re.compile(r"((?:\"[^\"]*\"|'[^']*'|[^'\">]+)*+)>", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style|itemprop)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
PUNCTUATION = re.compile(r"[.,;:!?，。；：！？、]")


def _flags(tag: str, attributes: str) -> tuple[bool, int, bool]:
    """Whether an element is certainly aside, marked as aside (1 rarely, 2 never an article's), marked as the main part."""
    aside, marked, main = tag in ASIDE, 0, tag in ("article", "main")
    if attributes and tag not in ("html", "body"):
        for m in ATTRIBUTE.finditer(attributes):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name in ("class", "id"):
                marked = max(marked, 2 if NEVER.search(value) else 1 if RARELY.search(value) else 0)
            elif name == "role":
                aside |= value.lower() in ROLES
                main |= value.lower() in ("main", "article")
            elif name == "itemprop":
                main |= value.lower() == "articlebody"
            elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
                aside = True
    return aside, 0 if main else marked, main


class Page:
    """Elements (parents before children) and text nodes of a page."""

    def __init__(self, html: str):
        self.parent, self.tag, self.aside, self.marked, self.main = [-1], [""], [False], [0], [False]
        self.nodes: list[tuple[int, int, str]] = []  # element, block, text
        stack, open_, block, at, n, whole = [0], Counter(), 0, 0, len(html), True

        def close(k: int) -> None:
            open_.subtract(self.tag[e] for e in stack[k:])
            del stack[k:]

        while at < n:
            m = TOKEN.search(html, at)
            attributes, after = "", m.end() if m else n
            if m and m[2]:
                # A quote that no quote closes: from there on a tag ends at the next ">", so no tag is scanned twice.
                found = END.match(html, after) if whole else None
                whole = found is not None
                end = found.end() if found else html.find(">", after) + 1
                m = m if end else None
                attributes, after = html[after : end - 1], end
            start = m.start() if m else n
            if start > at and not html[at:start].isspace():
                self.nodes.append((stack[-1], block, html[at:start]))
            elif start > at and self.nodes and self.nodes[-1][1] == block:
                self.nodes.append((stack[-1], block, " "))
            if not m:
                break
            at = after
            if m[2] is None:
                continue
            tag = m[2].lower()
            if tag not in INLINE:
                block += 1
            if m[1]:
                if open_[tag]:
                    close(next(k for k in range(len(stack) - 1, 0, -1) if self.tag[stack[k]] == tag))
                continue
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(html, at)
                if not attributes.endswith("/") or tag not in ("svg", "object", "canvas", "iframe"):
                    at = end.start() if end else n
                continue
            if tag in VOID:
                continue
            if tag in CLOSES:
                names, scope = CLOSES[tag]
                for k in range(len(stack) - 1, 0, -1) if any(open_[t] for t in names.split()) else ():
                    if (t := self.tag[stack[k]]) in scope:
                        break
                    if t in names.split():
                        close(k)
            elif tag not in INLINE and open_["p"]:
                for k in range(len(stack) - 1, 0, -1):
                    if (t := self.tag[stack[k]]) == "p":
                        close(k)
                        break
                    if t not in INLINE:
                        break
            aside, marked, main = _flags(tag, attributes)
            self.parent.append(stack[-1])
            stack.append(len(self.tag))
            open_[tag] += 1
            self.tag.append(tag)
            self.aside.append(aside)
            self.marked.append(marked)
            self.main.append(main)

    def places(self) -> tuple[list[bool], list[bool], list[bool]]:
        """Whether each element lies in a part that isn't article, in a marked main part, and in a part of it that is marked as aside in turn."""
        holds = list(self.main)  # or a first-level heading: a wrapper of the article isn't aside for its class
        for e in range(len(self.parent) - 1, 0, -1):
            holds[e] |= self.tag[e] == "h1"
            holds[self.parent[e]] |= holds[e]
        within, out, doubted = list(self.main), [False], [False]
        for e in range(1, len(self.parent)):
            up = self.parent[e]
            within[e] |= within[up]
            mark = 0 if holds[e] else self.marked[e]
            out.append(out[up] or self.aside[e] or mark == 2 or (mark == 1 and not within[e]) or (self.tag[e] == "header" and not within[e]))
            doubted.append(doubted[up] or mark == 1)
        return out, within, doubted

    def trust(self, sizes: list[int], out: list[bool]) -> bool:
        """Takes the marks from the elements that hold most of the text, where hardly any text is left beside what is aside; whether it took any."""
        held, left = [0] * len(self.parent), 0
        for (e, _, _), size in zip(self.nodes, sizes, strict=True):
            held[e] += size
            left += 0 if out[e] else size
        for e in range(len(held) - 1, 0, -1):
            held[self.parent[e]] += held[e]
        if left >= SCARCE * held[0]:
            return False
        took = False
        for e in range(1, len(held)):
            if 2 * held[e] > held[0] and (self.marked[e] == 1 or (self.aside[e] and self.tag[e] in WRAPPERS)):
                self.marked[e], self.aside[e], took = 0, False, True
        return took

    def paths(self, out: list[bool], within: list[bool]) -> list[int]:
        """The number of each element's path; a path is known by its parent's number, the tag and what it lies in."""
        numbers: dict[tuple, int] = {}
        path = [0]
        for e in range(1, len(self.parent)):
            path.append(numbers.setdefault((path[self.parent[e]], self.tag[e], out[e], within[e]), len(numbers) + 1))
        return path


def _smooth(values: list[float]) -> list[float]:
    """The geometric mean of each value and the mean around it: what borders on long text isn't lifted to its height."""
    return [(v * sum(part := values[max(0, i - SIDES) : i + SIDES + 1]) / len(part)) ** 0.5 for i, v in enumerate(values)]


def fused(lengths: list[float], marks: list[float], out: list[bool], within: list[bool], doubted: list[bool]) -> list[float]:
    """The weight of each node from its smoothed means and what it lies in."""
    return [0.0 if o else (n * (1 + p)) ** 0.5 * (BOOST if w else 1.0) * (DOUBTED if d else 1.0) for n, p, o, w, d in zip(lengths, marks, out, within, doubted, strict=True)]


def main_text(html: str) -> str:
    page = Page(html)
    nodes = [(e, b, unescape(t)) for e, b, t in page.nodes]
    sizes = [len(t.split()) and len(t.strip()) for _, _, t in nodes]
    out, within, doubted = page.places()
    if page.trust(sizes, out):
        out, within, doubted = page.places()
    path = page.paths(out, within)
    by_path: dict[int, list[int]] = {}
    for (e, _, t), size in zip(nodes, sizes, strict=True):
        if size:
            x = by_path.setdefault(path[e], [0, 0, 0])
            x[0], x[1], x[2] = x[0] + 1, x[1] + size, x[2] + len(PUNCTUATION.findall(t))
    lengths = _smooth([x[1] / x[0] for e, _, _ in nodes for x in [by_path.get(path[e], (1, 0, 0))]])
    marks = _smooth([x[2] / x[0] for e, _, _ in nodes for x in [by_path.get(path[e], (1, 0, 0))]])
    weights = fused(lengths, marks, [out[e] for e, _, _ in nodes], [within[e] for e, _, _ in nodes], [doubted[e] for e, _, _ in nodes])
    least = LEAST * max((w for w, size in zip(weights, sizes, strict=True) if size), default=0)
    if not least:
        return ""
    held = [0] * len(page.parent)
    for (e, _, _), w, size in zip(nodes, weights, sizes, strict=True):
        held[e] += size * (w >= least)
    for e in range(len(held) - 1, 0, -1):
        held[page.parent[e]] += held[e]
    outer = [e for e in range(1, len(held)) if page.main[e] and not out[e] and not within[page.parent[e]] and held[e]]
    if outer and sum(held[e] for e in outer) == held[0]:
        roots = set(outer)
    else:
        # Elements are numbered parents first, so the last that holds everything is the lowest.
        marked = [0] * len(held)
        for e in outer:
            marked[e] = 1
        block = [0]  # the lowest element about each that isn't inline
        for e in range(1, len(held)):
            block.append(block[page.parent[e]] if page.tag[e] in INLINE else e)
        own = [False] * len(held)
        for (e, _, _), size in zip(nodes, sizes, strict=True):
            own[block[e]] |= bool(size)
        for e in range(len(held) - 1, 0, -1):
            marked[page.parent[e]] += marked[e]
        article = max(e for e in range(len(held)) if held[e] == held[0] and marked[e] == len(outer))
        while article and (page.tag[article] in PIECE or own[article]):
            article = page.parent[article]
        roots = {article}
    inside = [e in roots for e in range(len(held))]
    for e in range(1, len(held)):
        inside[e] |= inside[page.parent[e]]
    blocks: dict[int, list[str]] = {}
    for (e, b, t), w in zip(nodes, weights, strict=True):
        if inside[e] and ((w >= least if doubted[e] else w) or t == " "):
            blocks.setdefault(b, []).append(t)
    return " ".join(x for b in blocks.values() if (x := " ".join("".join(b).split())))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars per row of pages."""

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for whole in batches:
            for start in range(0, max(whole.num_rows, 1), 500):
                batch = whole.slice(start, 500)
                texts = [main_text(h) if h else "" for h in batch.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    given = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return given.mapInArrow(work, f"page_id {given.schema['page_id'].dataType.simpleString()}, url {given.schema['url'].dataType.simpleString()}, text string, n_chars long")
