"""Main text of web pages by tag-path ratios.

A page becomes a sequence of text nodes, each with its root-to-leaf tag path (tags with their first class). For every
path the text length and the punctuation of its nodes are summed and divided by its number of nodes. The two ratios, laid out in
page order, are smoothed by a Gaussian window, fused (their product) and cut at a threshold drawn from their spread: paths whose nodes
pass in the mean are content. Content nodes choose the container that holds most of them; its text, that of content nodes
elsewhere, of all that lies between them and of headings right before them, outside
menus, headers, footers, sidebars, notices, adverts, forms, comments, scripts and styles is the page's text.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
SPLIT = re.compile(r"[^a-z0-9]+")
SPACES = re.compile(r"\s+")
PUNCTUATION = re.compile(r"[.,;:!?¡¿…。、，؛؟]")

# Fixed values of HTML and of page furniture.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe noembed noframes xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
DROPPED = frozenset("nav header footer aside form button select option script style noscript template textarea title head iframe object svg math canvas audio video dialog menu noembed noframes xmp".split())
FURNITURE = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar aside widget related recommended share sharing social cookie cookies consent notice gdpr popup modal overlay newsletter subscribe signup login comment comments commentlist disqus reply replies respond footer foot masthead pagination pager toolbar tags toc skip copyright search complementary contentinfo alert dialog".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
#: Tags that an opening tag of the same group ends where its end tag is left out, and where the search for it stops.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
SCOPE = frozenset("html body table td th article section main div aside nav header footer form ul ol blockquote".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PREFERRED = frozenset(("article", "main"))


def _furniture(tag: str, attributes: str) -> bool:
    if tag in DROPPED:
        return True
    if not attributes or tag in ("html", "body", "article", "main"):
        return bool(attributes and HIDDEN.search(attributes)) if tag not in ("html", "body") else False
    if HIDDEN.search(attributes):
        return True
    for m in NAMES.finditer(attributes):
        if FURNITURE.intersection(SPLIT.split((m[1] or m[2] or m[3] or "").lower())):
            return True
    return False


class Page:
    """Text nodes of one page in order: (path id, text, in furniture), None between blocks."""

    def __init__(self, source: str) -> None:
        self.paths: dict[tuple, int] = {}
        self.nodes: list[tuple[int, str, bool] | None] = []
        stack: list[tuple[str, str, bool]] = []  # tag, name in paths, furniture
        at, end = 0, len(source)
        while at < end:
            m = TOKEN.search(source, at)
            stop = m.start() if m else end
            if stop > at:
                self._text(source[at:stop], stack)
            if not m:
                break
            at = m.end()
            if m[1] is not None:
                self._text(html.escape(m[1], False), stack)
            tag = (m[3] or "").lower()
            if not tag:
                continue
            if tag not in INLINE:
                self.nodes.append(None)
            if m[2]:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == tag:
                        del stack[k:]
                        break
                    if tag in INLINE and stack[k][0] in SCOPE:
                        break
                continue
            self._implied(tag, stack)
            if tag in VOID:
                continue
            if m[4].endswith("/") and tag not in RAW:  # <div/> opens in HTML; a self-closing foreign element does not
                if tag in ("path", "g", "circle", "rect", "use", "line"):
                    continue
            inside = bool(stack) and stack[-1][2]
            name = tag
            if (c := NAMES.search(m[4])) is not None:
                first = (c[1] or c[2] or c[3] or "").split()
                name = f"{tag}.{first[0]}" if first else tag
            stack.append((tag, name, inside or _furniture(tag, m[4])))
            if tag in RAW:  # its text is not markup
                close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(source, at)
                self._text(source[at : close.start() if close else end], stack)
                stack.pop()
                at = close.end() if close else end

    def _implied(self, tag: str, stack: list) -> None:
        if tag in CLOSES_P:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p":
                    del stack[k:]
                    break
                if stack[k][0] in SCOPE:
                    break
        elif tag in ENDS:
            ended, scope = ENDS[tag]
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in ended:
                    del stack[k:]
                    break
                if stack[k][0] in scope:
                    break

    def _text(self, raw: str, stack: list) -> None:
        if raw:
            path = tuple(s[1] for s in stack)
            self.nodes.append((self.paths.setdefault(path, len(self.paths)), raw, bool(stack) and stack[-1][2]))


def _ratios(page: Page, sigma: float = 1.0, cut: float = 0.5) -> set[int]:
    """Paths whose smoothed and fused ratios pass the threshold."""
    size, marks, count = [0] * len(page.paths), [0] * len(page.paths), [0] * len(page.paths)
    order = []
    for node in page.nodes:
        if node is not None and not node[2] and (text := node[1].strip()):
            size[node[0]] += len(text)
            marks[node[0]] += len(PUNCTUATION.findall(text))
            count[node[0]] += 1
            order.append(node[0])
    if not order:
        return set()
    text_ratio, mark_ratio = [size[p] / count[p] for p in order], [(1 + marks[p]) / count[p] for p in order]
    window = [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(-2, 3)]

    def smooth(x: list[float]) -> list[float]:
        n = len(x)
        out = []
        for i in range(n):
            near = [(window[k + 2], x[i + k]) for k in range(-2, 3) if 0 <= i + k < n]
            out.append(sum(w * v for w, v in near) / sum(w for w, _ in near))
        return out

    fused = [a * b for a, b in zip(smooth(text_ratio), smooth(mark_ratio))]
    mean = sum(fused) / len(fused)
    spread = math.sqrt(sum((f - mean) ** 2 for f in fused) / len(fused))
    least = min(cut * spread, cut * max(fused))
    total: dict[int, float] = {}
    for p, f in zip(order, fused):
        total[p] = total.get(p, 0.0) + f
    return {p for p, f in total.items() if f / count[p] >= least}


def _container(page: Page, content: set[int]) -> tuple:
    """Path of the deepest element that holds nine tenths of the content's text, or of the article or main element around it."""
    weight: dict[tuple, int] = {}
    whole = 0
    names = {i: p for p, i in page.paths.items()}
    size: dict[int, int] = {}
    for node in page.nodes:
        if node is not None and not node[2] and node[0] in content:
            size[node[0]] = size.get(node[0], 0) + len(node[1].strip())
    for i, n in size.items():
        whole += n
        path = names[i]
        for k in range(len(path) + 1):
            weight[path[:k]] = weight.get(path[:k], 0) + n
    best: tuple = ()
    for path, n in weight.items():
        if n >= 0.9 * whole and len(path) > len(best):
            best = path
    for k in range(len(best), 0, -1):  # inline leaves and single paragraphs are no containers
        if best[k - 1].split(".")[0] in PREFERRED:
            return best[:k]
    while best and (best[-1].split(".")[0] in INLINE or best[-1].split(".")[0] in ("p", "h1", "h2", "h3", "li", "blockquote", "pre", "td")):
        best = best[:-1]
    return best


def main_text(source: str | None) -> str:
    """Main text of a page; empty for null, empty and text-free pages. No length is capped."""
    if not source:
        return ""
    page = Page(source)
    content = _ratios(page)
    if not content:
        return ""
    container = _container(page, content)
    inside = content | {i for p, i in page.paths.items() if p[: len(container)] == container}
    headings = {i for p, i in page.paths.items() if any(t.split(".")[0] in HEADINGS for t in p)}
    texts = [k for k, node in enumerate(page.nodes) if node is not None and not node[2] and node[1].strip()]
    chosen = [n for n, k in enumerate(texts) if page.nodes[k][0] in inside]
    first = chosen[0]
    while first and page.nodes[texts[first - 1]][0] in headings:
        first -= 1
    parts: list[str] = []
    for node in page.nodes[texts[first] : texts[chosen[-1]] + 1]:
        if node is None:
            parts.append(" ")
        elif not node[2]:
            parts.append(html.unescape(node[1]))
    return SPACES.sub(" ", "".join(parts)).strip()


def extract(pages: DataFrame, html_col: str = "html", name: str = "text") -> DataFrame:
    """Add the main text of every row; other columns and repeated rows stay, an empty table gives no rows."""
    small_batches(pages.sparkSession)

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for sources in batches:
            yield pd.Series([main_text(s) for s in sources], dtype=object)

    return pages.withColumn(name, text(F.col(html_col)))
