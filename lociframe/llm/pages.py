"""Main text of web pages by tag-path ratios.

Text nodes are grouped by their path of tags from the root.  Each path has a ratio of text length to nodes and one of
punctuation to nodes; both are smoothed over neighbouring paths in page order and fused, and a threshold picks the
content paths.  The element that holds most of their text is the article; within it everything counts but what its
tags or names mark as a menu, advert, form, comment and the like.  Text on content paths elsewhere counts too.

A name or a form is a hint only: it does not hold for an element with most of the text on content paths, or around main.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/<>]*)((?>"[^"]*"|'[^']*'|[^"'<>])*+)>?|[^<]+|<""", re.S)
_NAMES = re.compile(r"""(?:^|[\s"'])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
#: Elements whose content is not markup.
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "math", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements inside a line of text.
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that are never part of the main text.
ASIDE = {"head", "nav", "header", "footer", "aside", "form", "button", "select", "option", "menu", "dialog", "object", "canvas", "audio", "video", "input"}
#: Words in class, id or role that mark such parts.
MARKS = set(
    "ad ads advert adverts advertisement advertisements advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu "
    "menubar breadcrumb breadcrumbs sidebar footer header masthead toolbar comment comments disqus respond reply replies share sharing social "
    "related recommended newsletter subscribe signup login cookie cookies consent notice notices alert popup modal overlay widget pagination "
    "pager search skip contentinfo complementary form".split()
)
#: Marks that are also topics and parts of layouts: they don't hold where most of the element's text is on content paths.
WEAK_MARKS = set("search notice notices alert widget overlay skip header banner promotion masthead toolbar pager form login subscribe signup reply share".split())
#: Marks of running text by others, which can be longer than the page's own.
OTHERS = set("comment comments disqus respond replies related recommended".split())
#: First words of names that tell of a mark elsewhere.
TELLING = {"has", "no", "with", "without"}
MARK_WORD = re.compile(r"[a-z]+")
#: Kinds of marks; HARD ones always hold.
NONE, WEAK, BOX, OTHER, HARD = range(5)
#: Where the text of an article may be held.
HOLDERS = ("article", "main")
#: Punctuation of running text.
PUNCTUATION = re.compile("[.,;:!?…。，、！？；：।؟،]")


def _kind(tag: str, attributes: str) -> int:
    if tag in ASIDE and tag != "form":
        return HARD
    kind = BOX if tag == "form" else NONE
    if "=" not in attributes and "hidden" not in attributes:
        return kind
    if _HIDDEN.search(attributes):
        return HARD
    if tag in ("body", "html", "article", "main"):
        return kind
    for name in " ".join(a or b or c for a, b, c in _NAMES.findall(attributes)).lower().split():
        words = MARK_WORD.findall(name)
        if words and words[0] not in TELLING:
            for word in MARKS.intersection(words):
                kind = max(kind, WEAK if word in WEAK_MARKS else OTHER if word in OTHERS else BOX)
    return NONE if kind == WEAK and tag in ("h1", "h2", "h3", "h4", "h5", "h6") else kind


class Page:
    """Elements with parent, path number, kind of mark and mark, and the text nodes of a page in order."""

    def __init__(self, source: str) -> None:
        self.parent, self.tag, self.kind, self.path = [-1], [""], [NONE], [0]
        self.texts: list[tuple[int, str, bool]] = []  # element, text, whether a block begins
        self.paths: dict[tuple[int, str], int] = {}
        self._read(source)
        self.mark(set())
        self._settle()

    def mark(self, ignored: set[int]) -> None:
        """Marks hold for an element and all in it, but for those of the kinds ``ignored``."""
        self.marked = [False] * len(self.parent)
        for element in range(1, len(self.parent)):
            kind = self.kind[element]
            self.marked[element] = self.marked[self.parent[element]] or (kind != NONE and kind not in ignored)

    def weights(self, nodes: Iterable[int]) -> list[int]:
        """Characters of the text nodes within each element."""
        weight = [0] * len(self.parent)
        for i in nodes:
            weight[self.texts[i][0]] += len(self.texts[i][1].strip())
        for element in range(len(weight) - 1, 0, -1):
            weight[self.parent[element]] += weight[element]
        return weight

    def unmarked(self) -> list[int]:
        return [i for i, (e, text, _) in enumerate(self.texts) if not self.marked[e] and text.strip()]

    def _settle(self) -> None:
        """Drops the marks that content paths contradict; marks of others' text only where there is next to no other."""
        kinds = set(self.kind)
        for kind, ignored, share in ((BOX, {BOX, WEAK}, 0.5), (OTHER, {OTHER, BOX, WEAK}, 0.9), (BOX, {BOX, WEAK}, 0.5), (WEAK, {WEAK}, 0.5)):
            if kind not in kinds:
                continue
            # Unmarked articles and mains with text, within and around each element: none apart from it may be left out.
            text = self.weights(self.unmarked())
            within = [int(t in HOLDERS and w > 0) for t, w in zip(self.tag, text)]
            around, main = list(within), [t == "main" for t in self.tag]
            for element in range(len(within) - 1, 0, -1):
                within[self.parent[element]] += within[element]
                main[self.parent[element]] |= main[element]
            for element in range(1, len(around)):
                around[element] += around[self.parent[element]]
            self.mark(ignored)
            weight, whole = self.weights(content_nodes(self)), self.weights(self.unmarked())
            for element in range(1, len(self.kind)):
                if self.kind[element] != kind:
                    continue
                most = weight[element] > 0 and weight[element] >= share * weight[0]
                running = kind == WEAK and weight[element] > 0 and 2 * weight[element] >= whole[element]
                apart = within[element] + around[element] < within[0]
                if main[element] or (most or running) and not apart:
                    self.kind[element] = NONE
            self.mark(set())

    def _open(self, tag: str, attributes: str, parent: int) -> int:
        self.parent.append(parent)
        self.tag.append(tag)
        self.kind.append(_kind(tag, attributes))
        self.path.append(self.paths.setdefault((self.path[parent], tag), len(self.paths) + 1))
        return len(self.parent) - 1

    def _read(self, source: str) -> None:
        stack, names, fresh, at = [0], {}, True, 0
        lower = None
        match = _TOKEN.match

        def pop_to(depth: int) -> None:
            while len(stack) > depth:
                names[self.tag[stack.pop()]].pop()

        while at < len(source):
            token = match(source, at)
            at = token.end()
            tag = token[2]
            if tag is None:
                text = token[0]
                if text[0] != "<" or text == "<":
                    self.texts.append((stack[-1], text, fresh))
                    fresh = False
                continue
            tag = tag.lower()
            fresh = fresh or tag not in INLINE
            if token[1]:
                places = names.get(tag)
                if places:
                    pop_to(places[-1])
                continue
            if tag in ("p", "li", "dd", "dt", "tr", "td", "th", "option") or tag in ("div", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "table", "section", "article", "footer", "header", "nav", "aside", "form", "blockquote", "pre", "main"):
                same = names.get(tag if tag not in ("dd", "dt", "tr", "td", "th", "li", "option") else tag) if tag in ("li", "dd", "dt", "tr", "td", "th", "option") else names.get("p")
                outer = max((names[x][-1] for x in ("ul", "ol", "dl", "table", "div", "section", "article", "blockquote") if names.get(x)), default=0)
                if same and same[-1] > outer:
                    pop_to(same[-1])
            if tag in VOID:
                continue
            element = self._open(tag, token[3] or "", stack[-1])
            if tag in RAW and not (token[3] or "").endswith("/"):
                if lower is None:
                    lower = source.lower()
                if len(lower) != len(source):  # some letters change length
                    found = re.compile("</" + tag, re.I).search(source, at)
                    at = found.start() if found else len(source)
                else:
                    found = lower.find("</" + tag, at)
                    at = found if found >= 0 else len(source)
                close = source.find(">", at)
                at = close + 1 if close >= 0 else len(source)
                continue
            names.setdefault(tag, []).append(len(stack))
            stack.append(element)


def _smooth(values: np.ndarray) -> np.ndarray:
    """Weighted means over a path and its two neighbours on either side."""
    weights = np.array([1.0, 4.0, 6.0, 4.0, 1.0])
    middle = slice(2, 2 + len(values))
    return np.convolve(values, weights)[middle] / np.convolve(np.ones(len(values)), weights)[middle]


def _most(chosen: set, length: dict) -> set:
    """The paths with most text that have to be added for the chosen ones to hold over half of all text."""
    held, whole = sum(length[p] for p in chosen), sum(length.values())
    added = set()
    for path in sorted((p for p in length if p not in chosen), key=lambda p: -length[p]):
        if 2 * held > whole:
            break
        added.add(path)
        held += length[path]
    return added


def _holder_paths(page: Page) -> set:
    """Paths of the elements in an unmarked article or main."""
    inside = [False] * len(page.parent)
    for element in range(1, len(inside)):
        inside[element] = not page.marked[element] and (inside[page.parent[element]] or page.tag[element] in HOLDERS)
    return {page.path[element] for element, within in enumerate(inside) if within}


def content_nodes(page: Page) -> set[int]:
    """Numbers of the text nodes on content paths.

    A path is one if its smoothed or its own ratio reaches the mean.  The paths chosen hold over half of the text of
    the page, and if an article or main has none of them, over half of the text in these as well.
    """
    length, marks, count, order = {}, {}, {}, []
    for element, text, _ in page.texts:
        bare = text.strip()
        if not bare or page.marked[element]:
            continue
        path = page.path[element]
        if path not in count:
            order.append(path)
            length[path] = marks[path] = count[path] = 0
        count[path] += 1
        length[path] += len(bare)
        marks[path] += len(PUNCTUATION.findall(bare))
    if not order:
        return set()
    n = np.array([count[p] for p in order], float)
    text_ratio, mark_ratio = np.array([length[p] for p in order]) / n, np.array([marks[p] for p in order]) / n
    chosen = set()
    for fused in (_smooth(text_ratio) * (1.0 + _smooth(mark_ratio)), text_ratio * (1.0 + mark_ratio)):  # smoothing can hide a path
        chosen |= {p for p, ratio in zip(order, fused) if ratio >= fused.mean() * (1 - 1e-9)}
    chosen |= _most(chosen, {p: length[p] for p in order})  # one long text on a path of its own must not outdo many paragraphs
    inside = _holder_paths(page) & count.keys()
    if inside and not chosen & inside:
        chosen |= _most(set(), {p: length[p] for p in order if p in inside})
    return {i for i, (e, text, _) in enumerate(page.texts) if page.path[e] in chosen and not page.marked[e] and text.strip()}


def _holders(page: Page, chosen: set[int], most: float = 0.7) -> set[int]:
    """Elements that are main text as a whole: the innermost one with most of the chosen text; each article or main with
    chosen text, of a main the article in it that has all of its chosen text, if there is one; and blocks that directly
    hold chosen text, when that is most of their text."""
    weight, whole = page.weights(chosen), page.weights(page.unmarked())
    lines = INLINE | {"p", "li", "ul", "ol", "h1", "h2", "h3", "blockquote", "pre", "dl", "dt", "dd", "figure"}

    def block(element: int) -> int:
        while element and page.tag[element] in lines:
            element = page.parent[element]
        return element

    best = block(max((e for e in range(len(weight)) if weight[e] >= most * weight[0]), default=0))
    out, top = {best}, {}  # top: of each element, the outermost article or main around it
    for element in range(1, len(weight)):
        outer = top.get(page.parent[element])
        if outer is None and page.tag[element] in HOLDERS and weight[element] and not page.marked[element]:
            outer = element
            out.add(element)
        elif outer and page.tag[outer] == "main" and page.tag[element] == "article" and weight[element] == weight[outer]:
            out.discard(outer)
            outer = element
            out.add(element)
        if outer:
            top[element] = outer
    if best in top:
        out.discard(best)
        out.add(top[best])
    for element in {block(page.texts[i][0]) for i in chosen}:
        if weight[element] >= most * whole[element]:
            out.add(element)
    return out


def main_text(source: str | None) -> str:
    """The main text of a page; empty for null, empty and contentless sources."""
    page = Page(source or "")
    chosen = content_nodes(page)
    if not chosen:
        return ""
    holders = _holders(page, chosen)
    inside = [False] * len(page.parent)
    for element in range(len(inside)):
        inside[element] = element in holders or (element > 0 and inside[page.parent[element]])
    out = []
    for i, (element, text, fresh) in enumerate(page.texts):
        if fresh:
            out.append(" ")
        if i in chosen or (inside[element] and not page.marked[element]):
            out.append(text)
    return " ".join(html.unescape("".join(out)).split())


def extract(df: DataFrame) -> DataFrame:
    """page_id, url, text (the main text of the whole ``html``; empty if none), n_chars (code points) of each row of
    ``df``.  Null and empty html give an empty text, a page of any length is read whole, tags that are never closed or
    never opened are closed and passed over as browsers do.  Equal rows give equal rows, an empty table none; other
    columns are not read, whatever their names."""
    schema = df.select("page_id", "url").schema.add("text", "string").add("n_chars", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [main_text(x.as_py()) for x in part.column("html")]
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    schema.names,
                )

    return df.select("page_id", "url", "html").mapInArrow(run, schema)
