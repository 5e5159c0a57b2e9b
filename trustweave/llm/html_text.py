"""Main text of web pages by tag-path ratios.

A page is read once into blocks: runs of text under one block element, with inline markup
left out. Each root-to-leaf path of block tags sums the text length, punctuation and link
text of its blocks. A path's ratio is text per block, times punctuation per block, less
what is link text; ratios are smoothed along the page, so that a heading gains from the
paragraphs beside it, fused with what the path's elements say (menus, headers, footers,
sidebars, notices, adverts, forms and reader comments speak against their text), and paths
from a share of the best one on are content. An article raises the values of its paths, the
more of the page's text it holds; so a teaser raises little.

The paths so chosen name the container: the deepest element that holds most of their text,
or the article if it holds most of the page's. Within it, lists, tables, preformatted text,
captions and paragraphs are content however short they are, such as a recipe's ingredients;
there the path decides only about what is almost all links, and about bare divisions, where
crumbs and labels stand.

Blocks keep page order and are joined by line ends; nothing else is dropped or cut.

Defined cases: a null or empty page, or one without content, gives the empty text; unclosed
elements end with their parent; an unclosed comment or script runs to the page's end; text
outside of any element counts as a block of the root; equal pages give equal rows.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from trustweave.llm.batches import with_text_columns

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<rest2>[^>]*)>|<[!?/][^>]*>", re.S,
)
ATTRIBUTE = re.compile(r"(?P<name>[^\s=\"'/>]+)(?:\s*=\s*(?:\"(?P<a>[^\"]*)\"|'(?P<b>[^']*)'|(?P<c>[^\s\"'>]+)))?")
PUNCTUATION = re.compile(r"[.,;:!?…。，、！？；：]")
NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

#: Fixed by HTML: elements whose content is no text, void elements and inline elements.
NO_TEXT = {"script", "style", "noscript", "template", "iframe", "textarea", "title", "svg", "math", "object", "select", "canvas", "audio", "video", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small",
    "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "nobr", "output", "picture",
}
#: A start tag of the key ends an open element of these tags.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead"}}
#: Elements whose text is told, not placed: in the content's container they are content.
TOLD = {"p", "li", "dt", "dd", "td", "th", "caption", "figcaption", "pre", "blockquote", "address", "summary", "h1", "h2", "h3", "h4", "h5", "h6"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
CONTENT = {"article", "main"}

#: What elements say against their text, by tag, by words of class and id, and by role.
AGAINST_TAG = {"nav", "header", "footer", "aside", "form", "button", "menu", "dialog", "fieldset", "head"}
AGAINST_WORD = {
    "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "footer", "sidebar", "aside", "ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "sponsor",
    "sponsored", "promo", "promotion", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "signup", "login", "share",
    "sharing", "social", "related", "recommended", "comment", "comments", "commentlist", "disqus", "respond", "reply", "replies", "pagination", "pager", "search", "widget", "toolbar", "masthead",
    "skip", "copyright", "legal", "header", "topbar", "form",
}
COMMENT_WORD = {"comment", "comments", "commentlist", "reply", "replies", "respond"}
AGAINST_ROLE = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar", "toolbar"}

#: A path is content from this share of the best path's fused ratio on.
SHARE = 0.2
#: So much of that share an article adds to its paths, if it holds all of the page's text.
RAISE = 0.9
#: Link text from this share on makes a path a list of links.
LINK_SHARE = 0.9
#: Weights of the blocks up to two places away.
SMOOTHING = np.array([0.1, 0.2, 0.4, 0.2, 0.1])


def _speaks_against(tag: str, rest: str, inside: bool) -> bool:
    """inside: the element stands in an article."""
    if tag in AGAINST_TAG and not (tag == "header" and inside):
        return True
    if not rest.strip():
        return False
    for m in ATTRIBUTE.finditer(rest):
        key = m["name"].lower()
        value = m["a"] or m["b"] or m["c"] or ""
        if key in ("class", "id") and tag not in ("html", "body", "main"):
            parts = {p.lower() for p in NAME_PARTS.findall(value)}
            if parts & (COMMENT_WORD if tag == "article" else AGAINST_WORD):
                return True
        elif key == "role" and value.lower() in AGAINST_ROLE or key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return True
        elif key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return False


class _Page:
    """Blocks of one page in order, with their paths."""

    def __init__(self, source: str):
        # open block elements: tag, path, against, inside an article, within an article's header
        self.open: list[tuple[str, int, bool, bool, bool]] = [("", 0, False, False, False)]
        self.depth: Counter[str] = Counter()  # how many of a tag are open
        self.paths: dict[tuple[int, str], int] = {}  # a path is its parent and its last element
        self.parent: list[int] = [0]
        self.parts: list[str] = []
        self.link_chars = self.links = 0
        self.blocks: list[tuple[str, str, int, bool, bool, int]] = []
        self._read(source)
        self._flush()

    def _flush(self) -> None:
        if self.parts:
            text = " ".join(entities.unescape("".join(self.parts)).split())
            if text:
                tag, path, against, inside, header = self.open[-1]
                self.blocks.append((text, tag, path, against or header and tag not in HEADINGS, inside, min(self.link_chars, len(text))))
        self.parts, self.link_chars = [], 0

    def _text(self, text: str) -> None:
        self.parts.append(text)
        if self.links:
            self.link_chars += len(text.strip())

    def _start(self, tag: str, rest: str) -> None:
        self._flush()
        ends = ENDS.get(tag)
        if self.open[-1][0] == "p" or self.open[-1][0] in HEADINGS or ends and self.open[-1][0] in ends:
            self._pop()
            while ends and self.open[-1][0] in ends:
                self._pop()
        _, path, against, inside, header = self.open[-1]
        own = _speaks_against(tag, rest, inside)
        known = len(self.paths)
        above, path = path, self.paths.setdefault((path, tag + "!" * own), known + 1)
        if len(self.paths) > known:
            self.parent.append(above)
        self.depth[tag] += 1
        self.open.append((tag, path, against or own, inside or tag in CONTENT, header or tag == "header" and inside))

    def _pop(self) -> str:
        tag = self.open.pop()[0]
        self.depth[tag] -= 1
        return tag

    def _end(self, tag: str) -> None:
        if self.depth[tag]:
            self._flush()
            while self._pop() != tag:
                pass

    def _read(self, source: str) -> None:
        at, last = 0, source.rfind(">")
        look = 0
        while 0 <= (sign := source.find("<", look)) and (sign < last or source.startswith("<!--", sign)):
            m = TOKEN.match(source, sign)
            if not m:
                look = sign + 1
                continue
            if sign > at:
                self._text(source[at:sign])
            at = look = m.end()
            tag = (m["tag"] or m["tag2"] or "").lower()
            if not tag:
                continue
            if m["end"] or m["end2"]:
                if tag == "a":
                    self.links = 0
                elif tag not in INLINE:
                    self._end(tag)
                continue
            if tag in NO_TEXT:
                close = re.compile(rf"</{re.escape(tag)}[^>]*>", re.I).search(source, at)
                at = look = close.end() if close else len(source)
                self._text(" ")
            elif tag == "br":
                self._text(" ")
            elif tag == "hr":
                self._flush()
            elif tag == "a":
                self.links = 1
            elif tag not in INLINE and tag not in VOID:
                self._start(tag, m["rest"] or m["rest2"] or "")
        if at < len(source):
            self._text(source[at:])


def _within(parent: list[int], paths: list[int], weight: np.ndarray) -> list[bool]:
    """Whether each block lies in the deepest element that holds more than half of the weight."""
    total = np.zeros(len(parent))
    for path, w in zip(paths, weight.tolist()):
        total[parent[path]] += w
    for path in range(len(parent) - 1, 0, -1):  # a parent comes before its children
        total[parent[path]] += total[path]
    depth = [0] * len(parent)
    inside = [False] * len(parent)
    for path in range(1, len(parent)):
        depth[path] = depth[parent[path]] + 1
    holder = max(np.flatnonzero(total * 2 > weight.sum()).tolist(), key=lambda p: depth[p], default=0)
    for path in range(len(parent)):
        inside[path] = path == holder or path > 0 and inside[parent[path]]
    return [inside[p] for p in paths]


def main_text(source: str | None) -> str:
    """Content blocks of a page, a line each."""
    page = _Page(source or "")
    blocks = page.blocks
    if not blocks:
        return ""
    number = {p: k for k, p in enumerate(dict.fromkeys(b[2] for b in blocks))}
    place = np.array([number[b[2]] for b in blocks])
    count = np.bincount(place)
    size, links = np.array([len(b[0]) for b in blocks], float), np.array([b[5] for b in blocks], float)
    marks = np.array([len(PUNCTUATION.findall(b[0])) for b in blocks], float)
    mean = lambda x: np.bincount(place, x) / count
    ratio = np.log1p(mean(size)) * (1 + np.log1p(mean(marks))) * (1 - np.bincount(place, links) / np.maximum(np.bincount(place, size), 1))
    smooth = np.convolve(np.pad(ratio[place], 2, mode="edge"), SMOOTHING, mode="valid")
    against, inside = np.array([b[3] for b in blocks]), np.array([b[4] for b in blocks])
    if against.all():
        return ""
    # how much of the text that nothing speaks against stands in articles
    held = size[inside & ~against].sum() / size[~against].sum()
    value = (mean(smooth) * ratio)[place] * (1 + held * inside)
    least = SHARE * value[~against].max()
    # short texts of an article with most of the page's text are raised, links are not
    text_share = (1 - np.bincount(place, links) / np.maximum(np.bincount(place, size), 1))[place]
    value += RAISE * held * least * inside * np.minimum(1, 2 * text_share)
    chosen = ~against & (value >= least)
    told = np.array([b[1] in TOLD for b in blocks]) & ~against & (text_share > 1 - LINK_SHARE)
    within = np.array(_within(page.parent, [b[2] for b in blocks], np.where(chosen, size, 0)))
    chosen = (chosen | told & (within | inside & (held > 0.5))).tolist()
    for k in range(len(blocks) - 2, -1, -1):  # a heading goes with what follows it
        if not chosen[k] and chosen[k + 1] and blocks[k][1] in HEADINGS and not against[k]:
            chosen[k] = True
    return "\n".join(b[0] for b, c in zip(blocks, chosen) if c)


def extract(pages: DataFrame, *, html: str = "html", text: str = "text", columns: Sequence[str] | None = None) -> DataFrame:
    """Append ``text`` and its ``n_chars`` to ``columns`` (default: all)."""

    def make():
        def compute(column: pa.Array) -> list[pa.Array]:
            out = [main_text(x) for x in column.to_pylist()]
            return [pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())]

        return compute

    return with_text_columns(pages, make, f"`{text}` string, n_chars long", text=html, columns=columns)
