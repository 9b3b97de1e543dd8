"""Main text of web pages by tag-path ratios.

A page is read as a sequence of text nodes, each with its root-to-leaf path of tags (a tag with its
classes). Over the nodes of one path go the mean text length and the mean number of punctuation
marks. Along the page both means are smoothed with a Gaussian, fused into one value a node
(length ratio times one plus punctuation ratio, square root) and held against a threshold of so many
standard deviations. The nodes above it are content; the smallest element that has nearly all of
their text is the article, and all blocks in it come out whole: headings and short lines too.

What is no article by what it is called takes no part: scripts, styles, forms, navigation, footers,
asides, page headers and elements whose class, id or role names a menu, a notice, an advert or reader
comments. Names don't count on an element that holds the page's main heading or article.

A block ends where a block-level tag starts or ends. Character references are decoded, each run of
white space (as Unicode has it, `<br>` too) becomes one space, ends are trimmed, empty blocks vanish.

Defined cases: null html is empty and gives an empty text, and so does a page without text. Markup
that breaks off ends there. Unclosed paragraphs and list items end where the next one starts. Rows
that repeat come out as often; null ids are kept. Columns besides the html's play no part.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidemart.llm.common import byte_batches

#: Standard deviations of the smoothed values that a content node has at least.
THRESHOLD = 0.5
#: Gaussian weights of a node and its neighbours at distance 1 and 2.
SMOOTH = tuple(math.exp(-d * d / 2) for d in range(3))
#: Share of the content nodes' text that the article element holds at least.
SHARE = 0.95

# Element kinds of HTML.
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label "
                    "mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr "
                    "br".split())
_CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset "
                      "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav "
                      "ol p pre section summary table ul".split())
#: An open element of the same kind ends where one of these starts, up to the stated containers.
_SIBLINGS = {"li": ("li", {"ul", "ol", "menu"}), "dt": ("dt dd", {"dl"}), "dd": ("dt dd", {"dl"}),
             "tr": ("tr td th", {"table"}), "td": ("td th", {"tr", "table"}),
             "th": ("td th", {"tr", "table"}), "option": ("option", {"select"}),
             "thead": ("thead tbody tr td th", {"table"}),
             "tbody": ("thead tbody tr td th", {"table"}),
             "tfoot": ("thead tbody tr td th", {"table"})}
#: Elements that are never article text; `header` counts outside an article only.
_APART = frozenset("head script style noscript template nav footer aside form button select option "
                   "textarea input datalist dialog iframe object embed svg canvas audio video map "
                   "menu title xmp noembed noframes".split())
#: Words of classes, ids and roles that name what surrounds an article.
_NAMES = frozenset("ad ads adv advert adverts advertisement advertising adbox adsense banner "
                   "breadcrumb breadcrumbs comment comments commentlist consent contentinfo cookie "
                   "cookies copyright discussion disqus dropdown footer gdpr header login masthead "
                   "menu menubar modal nav navbar navigation newsletter notice notices overlay "
                   "pagination pager popup promo promoted promotion related replies reply search "
                   "share sharing sidebar signup skip social sponsor sponsored subscribe subscription "
                   "tags toolbar widget widgets complementary dialog alert".split())
_MAIN = frozenset(("article", "main"))
_HEADED = frozenset(("article", "main", "h1"))

_TAG = re.compile(r"<(?:!--|[!?]|(/?)([a-zA-Z][^\s/>]*))")
_REST = re.compile(r"""(?:[^>"']|"[^"]*"|'[^']*')*>""")
_NAMED = re.compile(r"""\s(class|id|role|itemprop|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""",
                    re.IGNORECASE)
_PARTS = re.compile(r"[a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Element:
    __slots__ = ("tag", "label", "parent", "path", "apart", "named", "headed", "weight", "article",
                 "block")

    def __init__(self, tag: str, names: str, apart: bool, named: bool, parent: Element | None):
        self.tag, self.parent = tag, parent
        self.label = f"{tag}.{names}" if names else tag
        self.path = f"{parent.path}/{self.label}" if parent else self.label
        self.article = tag in _MAIN or (parent is not None and parent.article)
        self.apart = apart or (tag == "header" and not self.article) or (
            parent is not None and parent.apart)
        self.named, self.headed, self.weight = named, False, 0
        self.block = tag not in _INLINE

    def out(self) -> bool:
        """No part of an article: by its kind, or by a name, also of an element around it."""
        at: Element | None = self
        while at is not None:
            if at.apart or (at.named and not at.headed):
                return True
            at = at.parent
        return False


def _attributes(text: str) -> tuple[str, bool, bool]:
    """Classes for the path, and whether the element is hidden or named as something apart."""
    classes, named, hidden = "", False, False
    for name, value in _NAMED.findall(text):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            hidden = True
            continue
        if name == "class":
            classes = ".".join(value.lower().split())
        named = named or not _NAMES.isdisjoint(_PARTS.findall(_CAMEL.sub("-", value).lower()))
    return classes, hidden, named


class Page:
    """Text nodes of a page as (element, text, block number)."""

    def __init__(self, source: str):
        self.nodes: list[tuple[Element, str, int]] = []
        self.block = 0
        self._read(source)

    def _text(self, stack: list[Element], raw: str) -> None:
        if raw:
            self.nodes.append((stack[-1], html.unescape(raw) if "&" in raw else raw, self.block))

    def _close(self, stack: list[Element], tags: set[str] | frozenset[str], stop) -> None:
        """Closes the nearest open element of these tags, unless a stop element is nearer."""
        for at in range(len(stack) - 1, 0, -1):
            if stack[at].tag in tags:
                del stack[at:]
                return
            if stack[at].tag in stop:
                return

    def _read(self, source: str) -> None:
        stack = [Element("", "", False, False, None)]
        at, size = 0, len(source)
        text_from = 0
        while at < size:
            start = source.find("<", at)
            if start < 0:
                break
            found = _TAG.match(source, start)
            if found is None:
                # a lone bracket is text; `</` and something else than a name is a comment
                if source.startswith("</", start) and start + 2 < size:
                    self._text(stack, source[text_from:start])
                    end = source.find(">", start)
                    at = text_from = size if end < 0 else end + 1
                else:
                    at = start + 1
                continue
            self._text(stack, source[text_from:start])
            name = found.group(2)
            if name is None:
                mark = "-->" if found.group().endswith("--") else ">"
                # the comments `<!-->` and `<!--->` end at once
                end = source.find(mark, start + 2 if mark == "-->" else start)
                at = text_from = size if end < 0 else end + len(mark)
                continue
            rest = _REST.match(source, found.end())
            if rest is not None:
                at = rest.end()
            else:  # an open quote: the tag ends at the next bracket, else the page does
                end = source.find(">", found.end())
                at = size if end < 0 else end + 1
                if end < 0:
                    text_from = size
                    break
            text_from = at
            tag = name.lower()
            if found.group(1):
                self._end(stack, tag)
            else:
                at = text_from = self._start(stack, tag, source[found.end():at - 1], source, at)
        self._text(stack, source[text_from:])

    def _end(self, stack: list[Element], tag: str) -> None:
        if tag in _VOID:
            if tag == "br":
                self._text(stack, " ")
            return
        if tag not in _INLINE:
            self.block += 1
            self._close(stack, {tag}, ())
        else:  # an inline end tag closes nothing beyond its block
            for place in range(len(stack) - 1, 0, -1):
                if stack[place].tag == tag:
                    del stack[place:]
                    break
                if stack[place].block:
                    break

    def _start(self, stack: list[Element], tag: str, attributes: str, source: str, at: int) -> int:
        """Opens an element; returns where reading goes on."""
        if tag == "br":
            self._text(stack, " ")
            return at
        if tag not in _INLINE:
            self.block += 1
        if tag in _VOID:
            return at
        if tag in _CLOSES_P:
            self._close(stack, {"p"}, {"button", "td", "th", "li", "div", "article", "section"})
        if tag in _SIBLINGS:
            kinds, stop = _SIBLINGS[tag]
            self._close(stack, set(kinds.split()), stop)
        classes, hidden, named = _attributes(attributes) if attributes else ("", False, False)
        parent = stack[-1]
        if tag in _RAW:
            end = re.compile(f"</{tag}(?=[\\s/>])", re.IGNORECASE).search(source, at)
            if end is None:
                return len(source)
            close = source.find(">", end.end())
            return len(source) if close < 0 else close + 1
        element = Element(tag, classes, hidden or tag in _APART,
                          named and tag not in ("html", "body"), parent)
        if tag in _HEADED and not (tag == "article" and named):
            up = parent
            while up is not None and not up.headed:
                up.headed = True
                up = up.parent
            if tag != "h1":
                element.headed = True
        if not (attributes.endswith("/") and tag in ("svg", "path")):
            stack.append(element)
        return at


def _marks(text: str) -> int:
    """Punctuation that prose has."""
    return sum(map(text.count, ".,;:!?'\"-…。，、！？；："))


def path_values(nodes: list[tuple[str, str]]) -> tuple[np.ndarray, np.ndarray]:
    """Of (path, text) in page order: each node's smoothed, fused value, and whether it is content."""
    numbers: dict[str, int] = {}
    path = np.array([numbers.setdefault(p, len(numbers)) for p, _ in nodes])
    chars = np.array([len(t) for _, t in nodes], float)
    marks = np.array([_marks(t) for _, t in nodes], float)
    count = np.bincount(path)
    length_ratio = (np.bincount(path, chars) / count)[path]
    mark_ratio = (np.bincount(path, marks) / count)[path]

    def smooth(values: np.ndarray) -> np.ndarray:
        kernel = np.array([*SMOOTH[:0:-1], *SMOOTH])
        weight = np.convolve(np.ones(len(values)), kernel)[2:-2]
        return np.convolve(values, kernel)[2:-2] / weight

    fused = np.sqrt(smooth(length_ratio) * (1 + smooth(mark_ratio)))
    return fused, fused >= min(THRESHOLD * fused.std(), fused.max())


def main_blocks(source: str | None) -> tuple[list[str], str]:
    """The article's blocks in page order, and the path of its element."""
    page = Page(source or "")
    nodes = [(element, text, block) for element, text, block in page.nodes if not element.out()]
    shown = [(e, " ".join(t.split())) for e, t, _ in nodes]
    told = [(e, t) for e, t in shown if t]
    if not told:
        return [], ""
    _, content = path_values([(e.path, t) for e, t in told])
    total = 0
    elements: list[Element] = []
    for (element, text), chosen in zip(told, content.tolist()):
        if not chosen:
            continue
        total += len(text)
        up: Element | None = element
        while up is not None:
            if not up.weight:
                elements.append(up)
            up.weight += len(text)
            up = up.parent
    # of the elements that hold the content the deepest, first in page order
    holding = [e for e in elements if e.weight >= SHARE * total]
    root = max(holding, key=lambda e: (e.block, e.path.count("/")))
    around: Element | None = root
    while around is not None:
        # one paragraph may hold all content; its article is what it stands in
        if around.tag in _MAIN:
            root = around
            break
        around = around.parent
    else:
        if root.tag not in ("", "html", "body", "div", "section", "td") and root.parent is not None:
            root = root.parent
    blocks: dict[int, list[str]] = {}
    for element, text, block in nodes:
        up = element
        while up is not None and up is not root:
            up = up.parent
        if up is not None:
            blocks.setdefault(block, []).append(text)
    joined = (" ".join("".join(parts).split()) for _, parts in sorted(blocks.items()))
    return [block for block in joined if block], root.path.strip("/")


def main_text(source: Column) -> Column:
    """A struct of the main text and the path of the element that holds it."""
    @F.arrow_udf("struct<text: string, root: string>")
    def extract(pages: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in pages:
            found = [main_blocks(page) for page in batch.to_pylist()]
            yield pa.StructArray.from_arrays(
                [pa.array(["\n".join(blocks) for blocks, _ in found], pa.string()),
                 pa.array([root for _, root in found], pa.string())], ["text", "root"])

    return extract(source)


def extract(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text, n_chars (code points), root (the article's tag path)."""
    byte_batches(pages.sparkSession)
    found = pages.select("page_id", "url", main_text(F.col("html")).alias("found"))
    return found.select("page_id", "url", F.col("found.text").alias("text"),
                        F.length("found.text").cast("bigint").alias("n_chars"),
                        F.col("found.root").alias("root"))
