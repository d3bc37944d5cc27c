"""Main text of web pages by the maximum-scoring contiguous region.

A page is read once, as a row of tokens: words, each under the kind of place it stands in, and tags. Every kind
has a weight, the log of how much more frequent it is inside the content than outside on labelled
pages: those whose markup names one content element (article or main). Words are positive, words of links less than
others; tags are negative, as far as their kind may cost: a cell or an item half a word, a link's tag one, a
division two and a half. One linear scan finds the contiguous region with the highest sum, the first on ties. So a
region reaches over tags to words that are worth it, and leaves out short or linked runs before and after.

Elements that are no part of an article are a single pair of tags to the scan, and their words weigh nothing, so that
they end a region but don't part one; inside the region they are left out of the text:

* menus, headers, footers, sidebars, forms and the like by the element's name, and whatever isn't displayed;
* what stands outside the content element of a page, where there is one (an only article, or an only main) and it has at
  least half of the words that are left; a heading of the first level stays;
* on other pages, structural elements of three links or more with at least 60 % of their words in links;
* elements whose class, id or role names an advert, comments and so on, by its whole or its last part; names are split at
  capitals too. Such an element is a wrapper, and counts as any other, if it has most of the page's words and no heading
  or content element stands outside all of them.

The rest of the region is the text: character references decoded, white space in a block one space, blocks parted by two
line ends.

Weights are counted over all labelled pages (a row for each kind and task is shuffled; kinds are a fixed
set of names) with prior counts for the usual names, so pages without any label still work.

A null or empty page, or one whose best region has no word, gives an empty text. Unclosed tags,
comments and scripts end where the page ends. Nothing is cut; repeated rows give repeated results.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from instructset.llm.common import prepare

# Element names of HTML by their part in a page.
RAW = {"script", "style", "template", "noscript", "iframe", "svg", "math", "object", "head", "title"}
BOILERPLATE = {"nav", "header", "footer", "aside", "form", "menu", "button", "select", "textarea", "dialog", "label", "input", "fieldset", "option"}
CONTENT = {"article", "main"}
TEXT = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "dd", "dt", "figcaption"}
BLOCK = BOILERPLATE | CONTENT | TEXT | {
    "html", "body", "div", "section", "ul", "ol", "li", "dl", "table", "thead", "tbody", "tfoot", "tr", "td", "th",
    "caption", "figure", "hr", "address", "details", "summary", "center",
}
VOID = {"br", "hr", "img", "input", "meta", "link", "wbr", "area", "base", "col", "embed", "source", "track"}
INLINE = {"a", "b", "i", "em", "strong", "span", "u", "s", "small", "sub", "sup", "code", "mark", "q", "cite", "abbr", "time", "font"}
#: Last parts of a class, id or role that mark an element as no part of the article.
MARKS = {
    "ad", "ads", "advert", "advertisement", "advertising", "banner", "sponsor", "sponsored", "promo", "promotion",
    "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "pagination", "pager", "toc",
    "header", "footer", "masthead", "topbar", "sidebar", "aside", "widget", "complementary", "contentinfo",
    "cookie", "cookies", "consent", "gdpr", "notice", "notices", "alert", "popup", "modal", "overlay", "newsletter",
    "subscribe", "subscription", "signup", "login", "search", "share", "sharing", "social", "related", "recommended",
    "comment", "comments", "reply", "replies", "respond", "disqus", "copyright", "legal", "disclaimer",
    "teaser", "teasers", "recommendations", "trending", "outbrain", "taboola", "thread", "discussion", "reactions",
    "werbung", "anzeige", "anzeigen", "publicite", "publicidad", "kommentar", "kommentare", "commentaire", "commentaires",
    "comentario", "comentarios", "commenti", "reklame",
}
#: First parts of a class, id or role that mark what is beside the article whatever follows.
LEADS = {"more", "related", "recommended", "sponsored", "trending"}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?:script|style|template|noscript|iframe|svg|math|object|title)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>",
    re.DOTALL,
)
_RAW_NAME = re.compile(r"<([a-zA-Z]+)")
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_NOT_SHOWN = re.compile(r"display\s*:\s*none", re.IGNORECASE)
#: Last parts of a name that only say what holds the thing, and first parts that say something of another element.
HOLDERS = {
    "area", "bar", "block", "box", "button", "buttons", "container", "content", "group", "inner", "item", "items", "link", "links", "list",
    "outer", "panel", "post", "posts", "row", "section", "slot", "unit", "wrap", "wrapper", "left", "right", "top", "bottom",
}
STATES = {"has", "have", "no", "not", "with", "without", "hide", "show", "is"}
#: Start tags that end open elements whose end tag may be left out.
_ENDS = {"li": {"p", "li"}, "dt": {"p", "dt", "dd"}, "dd": {"p", "dt", "dd"}, "tr": {"p", "tr", "td", "th"}, "td": {"p", "td", "th"}, "th": {"p", "td", "th"}}
#: Counts of kinds inside and outside before any page is seen.
_PRIOR = 20.0
#: The most that a tag costs, in words.
_COSTS = {"text": 0.25, "item": 0.5, "a": 1.0, "unwanted": 1.0, "other": 2.5}
_ITEMS = {"ul", "ol", "li", "dl", "dt", "dd", "table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption", "figure", "hr"}
#: Links, and share of words in links, from which on an element is a list of links.
_LINKS, _LINKED = 3, 0.6


def _marked(name: str) -> bool:
    """Whether a class, id or role names no part of the article, by its whole or by its last part."""
    parts = [p.lower() for p in _PART.findall(name)]
    if len(parts) > 1 and parts[0] in LEADS:
        return True
    while len(parts) > 1 and parts[-1] in HOLDERS:
        parts.pop()
    return bool(parts) and parts[-1] in MARKS and parts[0] not in STATES


def _unwanted(name: str, attributes: str) -> str:
    """Why an element is unwanted: "kind", "hidden", or "named" for what is so only if it isn't most of the page."""
    if name in BOILERPLATE and name != "form":
        return "kind"
    why = "named" if name == "form" else ""
    for found in _ATTRIBUTE.findall(attributes) if attributes else ():
        key, value = found[0].lower(), "".join(found[1:])
        if key == "hidden" or key == "aria-hidden" and value.strip().lower() == "true" or key == "style" and _NOT_SHOWN.search(value):
            return "hidden"
        if key in ("class", "id", "role") and name not in ("body", "html", "article", "main") and any(map(_marked, value.split())):
            why = "named"
    return why


class Page:
    """A page's tokens (kind, text or None for a tag, element) and elements, read in one pass.

    Element 0 is the page. For each element: the one around it, its name, why it may be unwanted, and, after reading,
    the words, words in links and links in it."""

    def __init__(self, html: str):
        self.tokens: list[tuple[str, str | None, int]] = []
        self.around, self.names, self.why = [0], [""], [""]
        self.words, self.linked, self.links, self.heads, self.contents = [0], [0], [0], [0], [0]
        self._read(html)
        self.own_words = list(self.words)
        for e in range(len(self.names) - 1, 0, -1):
            for column in (self.words, self.linked, self.links):
                column[self.around[e]] += column[e]

    def _open(self, name: str, why: str, around: int) -> int:
        self.around.append(around)
        self.names.append(name)
        self.why.append(why)
        for column in (self.words, self.linked, self.links, self.heads, self.contents):
            column.append(0)
        return len(self.names) - 1

    def _read(self, html: str) -> None:
        stack, in_link, place, at, n = [0], False, "none", 0, len(html)
        while at < n:
            found = _TOKEN.search(html, at)
            end = found.start() if found else n
            if end > at:
                text, element = html[at:end], stack[-1]
                count = len(text.split())
                self.words[element] += count
                self.linked[element] += count if in_link else 0
                self.tokens.append(("word:link" if in_link else "word:" + place, text, element))
            if not found:
                return
            at = found.end()
            name = found[2]
            if name is None:
                raw = _RAW_NAME.match(found[0])
                if raw and not found[0].endswith("/>"):
                    close = re.compile(rf"</{raw[1]}\s*>", re.IGNORECASE).search(html, at)
                    at = close.end() if close else n
                continue
            name = name.lower()
            closing = found[1] == "/"
            known = name in BLOCK or name in INLINE or name in VOID
            kind = ("/" if closing else "") + (name if known else "other")
            if name in INLINE or name == "br" or name not in BLOCK:
                if name == "a":
                    in_link = not closing
                    self.links[stack[-1]] += in_link
                self.tokens.append((kind, None, stack[-1]))
                continue
            in_link = False
            if closing:
                for i in range(len(stack) - 1, 0, -1):
                    if self.names[stack[i]] == name:
                        self.tokens.append((kind, None, stack[i]))
                        del stack[i:]
                        break
                else:
                    self.tokens.append((kind, None, stack[-1]))
                place = self.names[stack[-1]] or "none"
                continue
            while len(stack) > 1 and self.names[stack[-1]] in _ENDS.get(name, {"p"}):
                stack.pop()
            why = _unwanted(name, found[3])
            self.heads[stack[-1]] += name == "h1"
            self.contents[stack[-1]] += name in CONTENT
            element = stack[-1]
            if name not in VOID and (name not in TEXT or why):
                # A text element that is unwanted lasts until it is closed.
                element = self._open(name, why, stack[-1])
                stack.append(element)
            self.tokens.append((kind, None, element))
            place = "text" if name in TEXT else name

    def _wrappers(self) -> set[int]:
        """Elements that are unwanted by a name, but have most of the page's words, while no heading or content element
        stands outside all such elements."""
        n = len(self.names)
        guard, in_content = [-1] * n, [False] * n
        below: list[list[int]] = [[] for _ in range(n + 1)]
        # Headings and content elements by the innermost unwanted element around them; the last is for none.
        heads, contents = [0] * (n + 1), [0] * (n + 1)
        for e in range(n):
            outer = guard[self.around[e]] if e else -1
            guard[e] = e if self.why[e] else outer
            in_content[e] = in_content[self.around[e]] or self.names[e] in CONTENT
            if self.why[e] == "named":
                below[outer].append(e)
            heads[guard[e]] += self.heads[e]
            contents[guard[e]] += self.contents[e]
        spared: set[int] = set()
        top, clear_heads, clear_contents = below[-1], heads[-1], contents[-1]
        while top:
            most = max(top, key=lambda e: self.words[e])
            elsewhere = clear_heads + (0 if in_content[most] else clear_contents)
            if elsewhere or 2 * self.words[most] <= self.words[0]:
                break
            spared.add(most)
            top, clear_heads, clear_contents = below[most], heads[most], contents[most]
        return spared

    def left_out(self, labelled: bool = False) -> tuple[list[bool], set[int]]:
        """Whether each element is no part of the article, and the elements around the content element, of which only
        a heading is. Labelled pages are judged without their label."""
        n = len(self.names)
        spared = self._wrappers()
        out = [False] * n
        for e in range(1, n):
            out[e] = out[self.around[e]] or bool(self.why[e]) and e not in spared
        content = -1 if labelled else self._content(out)
        if content < 0:
            for e in range(1, n):
                linked = self.links[e] >= _LINKS and self.linked[e] >= _LINKED * max(self.words[e], 1)
                out[e] = out[e] or out[self.around[e]] or linked and 2 * self.words[e] <= self.words[0]
            return out, set()
        holders, e = {0}, self.around[content]
        while e:
            holders.add(e)
            e = self.around[e]
        inside = [False] * n
        for e in range(n):
            inside[e] = e == content or inside[self.around[e]]
            out[e] = out[e] or not inside[e] and e not in holders
        return out, holders

    def _content(self, out: list[bool]) -> int:
        """The only article, or else the only main element, if it has half of the words that are left; else -1."""
        left = [0] * len(out)
        for e in range(len(out) - 1, -1, -1):
            left[e] += 0 if out[e] else self.own_words[e]
            if e:
                left[self.around[e]] += left[e]
        for name in ("article", "main"):
            found = [e for e, x in enumerate(self.names) if x == name and not out[e]]
            if len(found) == 1:
                return found[0] if 2 * left[found[0]] >= left[0] else -1
        return -1

    def scored(self, labelled: bool = False) -> Iterator[tuple[str, str | None, int]]:
        """The tokens as the scan takes them: an element that is left out is one pair of tags, and what is in it is there
        under the kinds ``word:out`` and ``out``, which weigh nothing."""
        out, holders = self.left_out(labelled)
        last, block = -1, ""
        # The outermost element that is left out, at or around each.
        outermost = list(range(len(out)))
        for e in range(1, len(out)):
            if out[e] and out[self.around[e]]:
                outermost[e] = outermost[self.around[e]]
        for kind, text, e in self.tokens:
            if text is None and kind.strip("/") in BLOCK:
                block = kind
            now = outermost[e] if out[e] else -1
            if now != last:
                if last >= 0:
                    yield "/unwanted", None, last
                if now >= 0:
                    yield "unwanted", None, now
                last = now
            if out[e] or e in holders and block != "h1" and kind != "/h1":
                yield "out" if text is None else "word:out", text, e
            else:
                yield kind, text, e
        if last >= 0:
            yield "/unwanted", None, last


def counted(html: str) -> Counter:
    """Counts of (kind, inside) of a labelled page; empty for one with no or several content elements."""
    if len(re.findall(r"<(?:article|main)\b", html, re.IGNORECASE)) != 1:
        return Counter()
    page = Page(html)
    inside = [False] * len(page.names)
    for e in range(1, len(inside)):
        inside[e] = inside[page.around[e]] or page.names[e] in CONTENT
    out: Counter = Counter()
    for kind, text, e in page.scored(labelled=True):
        if kind not in ("out", "word:out"):
            out[kind, inside[e]] += 1 if text is None else len(text.split())
    return out


def _cost(kind: str) -> float:
    name = kind.strip("/")
    if name == "a" or name == "unwanted":
        return _COSTS[name]
    return _COSTS["text" if name in TEXT or name in INLINE or name == "br" else "item" if name in _ITEMS else "other"]


def weights(counts: dict[tuple[str, bool], int]) -> dict[str, float]:
    """The weight of every kind: words positive, those of links less than others, tags negative as far as they may cost."""
    kinds = {k for k, _ in counts}
    kinds |= {"word:text", "word:none", "word:link", "other", "/other", "unwanted", "/unwanted"}
    kinds |= {f"{s}{n}" for n in BLOCK | INLINE | VOID for s in ("", "/", "word:")}
    prior = {}
    for k in kinds:
        if k in ("word:text", "word:none"):
            prior[k] = (_PRIOR * 50, _PRIOR * 5)
        elif k.startswith("word:") and k != "word:link":
            prior[k] = (_PRIOR, _PRIOR)
        else:
            # A tag that may cost more is taken for rarer in content.
            prior[k] = (_PRIOR / (2 if _cost(k) <= 1 else 20), _PRIOR)
    inside = {k: counts.get((k, True), 0) + prior[k][0] for k in kinds}
    outside = {k: counts.get((k, False), 0) + prior[k][1] for k in kinds}
    total_in, total_out = sum(inside.values()), sum(outside.values())
    ratios = {k: math.log(inside[k] / total_in) - math.log(outside[k] / total_out) for k in kinds}
    plain = min(3.0, max(2.0, ratios["word:text"]))
    out = {}
    for k, ratio in ratios.items():
        if k == "word:link":
            ratio = min(plain, max(plain / 4, ratio))
        elif k.startswith("word:"):
            ratio = min(plain, max(plain / 2, ratio))
        else:
            ratio = max(-plain * _cost(k), min(-0.05, ratio))
        out[k] = round(ratio, 6)
    return out | {"out": 0.0, "word:out": 0.0}


def best_region(scores: list[float]) -> tuple[int, int]:
    """Start and end of the contiguous part with the highest positive sum, the first on ties."""
    best, found, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best + 1e-9:
            best, found = total, (start, i + 1)
    return found


def main_text(html: str, weight: dict[str, float]) -> str:
    row = list(Page(html).scored())
    scores = [weight.get(kind, weight["other"]) * (1 if text is None else len(text.split())) for kind, text, _ in row]
    start, end = best_region(scores)
    blocks, held = [], []
    for kind, text, _ in row[start:end]:
        if kind == "out" or kind == "word:out":
            continue
        if text is not None:
            held.append(unescape(text))
        elif kind == "br":
            held.append(" ")
        elif kind.strip("/") in BLOCK or kind.endswith("unwanted"):
            blocks.append(" ".join("".join(held).split()))
            held = []
    blocks.append(" ".join("".join(held).split()))
    return "\n\n".join(b for b in blocks if b)


def train(pages: DataFrame, html: str = "html") -> dict[str, float]:
    """Weights from all labelled pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for page in batch.column(0):
                if page.is_valid:
                    total.update(counted(page.as_py()))
        if total:
            kinds, inside = zip(*total, strict=True)
            columns = [pa.array(kinds, pa.string()), pa.array(inside), pa.array(total.values(), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["kind", "inside", "n"])

    prepare(pages.sparkSession)
    parts = pages.select(F.col(html).cast("string")).mapInArrow(run, "kind string, inside boolean, n long")
    rows = parts.groupBy("kind", "inside").agg(F.sum("n").alias("n")).collect()
    return weights({(r.kind, r.inside): r.n for r in rows})


def extract(pages: DataFrame, weight: dict[str, float] | None = None, html: str = "html") -> DataFrame:
    """``pages`` with ``text`` in place of ``html`` (and of any column text). Map only after training."""
    weight = weight or train(pages, html)
    names = [c for c in pages.columns if c not in (html, "text")]
    df = pages.select(*(F.col(f"`{c}`") for c in names), F.col(html).cast("string").alias("_page html"))
    schema = T.StructType([*(df.schema[c] for c in names), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 100):
                part = batch.slice(a, min(100, batch.num_rows - a))
                out = [main_text(p.as_py() or "", weight) for p in part.column(len(names))]
                columns = [*(part.column(c) for c in names), pa.array(out, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=[*names, "text"])

    return df.mapInArrow(run, schema)
