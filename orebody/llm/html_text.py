"""Main text of web pages by composite text density (operator 8).

A page becomes a tree of elements. Elements that never hold an article's text go first, by their kind (nav, footer,
aside, script, style and the like). Suspects are forms, and elements whose role, class or id names a menu, notice,
advert, sidebar, comments and so on: they go, unless an article or half of the text of the article around them (of the
page, where it marks none) is inside. Of a form that stays only the controls go. Readers' comments go however large,
as long as other text is left.

For every node, C is its characters, T its tags, LC and LT those of links. Its composite density is
    C / T * log_b(C / LC * T / LT),  b = ln(C / (C - LC) * LC + LCbody / Cbody * C + e)
with zero denominators taken as 1: characters per tag, lowered by the links' share. A node's density sum adds its
children's densities, a run of text directly in it counting as a child. The threshold is the least density on the
path from the body to the densest node; among nodes that reach it the one with the largest sum is taken (of equal
ones the first in the page), and its parent instead while it holds under SHARE of the remaining text. All text below is
returned.

A page is one row and one task's work, however long: its tree takes some hundred bytes a tag. Nothing is shared between
rows, and batches are cut by bytes. Null and empty html give an empty text. Rows with null or repeated ids get a row
each; an empty table none. Further columns, whatever their names, are not read.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_slices, table

SHARE = 0.6

_NAME = re.compile(r"<(/?)([a-z][a-z0-9:-]*)", re.IGNORECASE)
_SPAN = re.compile(r"[^>\"']*+")  # within a tag up to a quote or its end
#: Elements whose content is no markup.
RAW = frozenset("script style noscript template textarea title iframe".split())
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.IGNORECASE)

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
#: Block elements whose start ends an open paragraph.
ENDS_P = BLOCK - frozenset("body html td th tr tbody thead tfoot caption".split())
#: Not one of a paragraph around these.
P_WITHIN = frozenset("article section div td th li button".split())
#: Elements that end an open one of the same kind, up to the given container.
SIBLINGS = {k: frozenset(v.split()) for k, v in {"li": "ul ol menu", "dt": "dl", "dd": "dl", "tr": "table", "td": "tr table", "th": "tr table"}.items()}
NEVER = frozenset("nav footer aside menu dialog button label head audio video canvas svg math object select datalist".split())
#: Elements of another language in a page: a slash at the end of their tag closes them.
FOREIGN = frozenset(("svg", "math"))
SUSPECT = frozenset("header form fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies "
    "consent gdpr notice notices nav navbar navigation menu menus breadcrumb breadcrumbs sidebar footer header masthead "
    "comment comments disqus reply replies respond share sharing social newsletter subscribe subscription related popup "
    "modal widget toolbar pagination pager login signup form".split()
)
COMMENTS = frozenset("comment comments disqus replies respond".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
KEEP = frozenset("html body article main".split())


class _Finder:
    """str.find that remembers once a string does not occur further on: a page is scanned once for each, however often
    it is looked for in vain."""

    def __init__(self, source: str):
        self.source, self.none = source, set()

    def __call__(self, what: str, at: int) -> int:
        if what in self.none:
            return -1
        found = self.source.find(what, at)
        if found < 0:
            self.none.add(what)
        return found


def tags(source: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """(start, end, closing, name, attributes) of the tags in a page, in order, in time linear in its length. Comments,
    declarations, marked sections and elements whose content is no markup (RAW, with that content) have no name.
    Quotes in a tag hide >; where a quote does not end, the tag ends at its first >. A < that opens nothing is text."""
    find, at = _Finder(source), 0
    while (at := source.find("<", at)) >= 0:
        if source.startswith("<!--", at):
            end = find("-->", at + 4)
            end = len(source) if end < 0 else end + 3
            yield at, end, False, "", ""
        elif source.startswith("<![CDATA[", at) and (end := find("]]>", at + 9)) >= 0:
            yield at, (end := end + 3), False, "", ""
        elif source[at + 1 : at + 2] in ("!", "?"):
            if (end := find(">", at)) < 0:
                return
            yield at, (end := end + 1), False, "", ""
        elif m := _NAME.match(source, at):
            first = find(">", m.end())
            if first < 0:
                return  # no tag ends from here on
            end = _SPAN.match(source, m.end()).end()
            while end < len(source) and source[end] != ">":
                close = find(source[end], end + 1)
                if close < 0:
                    break
                end = _SPAN.match(source, close + 1).end()
            if end >= len(source) or source[end] != ">":
                end = first
            name, more = m[2].lower(), source[m.end() : end]
            end += 1
            if name in RAW and not m[1]:
                end = _raw_end(source, name, end)
                name = ""
            yield at, end, bool(m[1]), name, more
        else:
            end = at + 1
        at = end


def _raw_end(source: str, name: str, at: int) -> int:
    """Where the element's own closing tag ends, or the page: all behind an element that never closes is its content."""
    m = re.compile(rf"</{name}\s*>", re.IGNORECASE).search(source, at)
    return m.end() if m else len(source)


class Page:
    """The tree of a page: parallel lists over its nodes in page order, and the runs of text with their node."""

    def __init__(self, source: str):
        self.tag, self.parent, self.out, self.named = ["#page"], [-1], [False], [""]
        self.runs: list[tuple[int, int, str]] = []  # node, block number, text
        stack, block, at = [0], 0, 0
        depths: dict[str, list[int]] = {}  # where in the stack the open elements of a kind are

        def close(name: str, within: frozenset[str] = frozenset()) -> None:
            """Ends the innermost open element of the kind, with all inside it, unless one of `within` is inside it too."""
            if not depths.get(name):
                return
            k = depths[name][-1]
            if any(depths.get(w) and depths[w][-1] > k for w in within):
                return
            while len(stack) > k:
                depths[self.tag[stack.pop()]].pop()

        def text(piece: str) -> None:
            if piece:
                self.runs.append((stack[-1], block, entities.unescape(piece) if "&" in piece else piece))

        for begin, at_next, closing, name, more in tags(source):
            text(source[at:begin])
            at = at_next
            if not name:
                continue
            if name == "br":
                self.runs.append((stack[-1], block, "\n"))
                continue
            if name in BLOCK:
                block += 1
            if closing:
                close(name)
                continue
            if name in VOID:
                continue
            if name in FOREIGN and more.endswith("/"):
                continue
            if name in ENDS_P:
                close("p", P_WITHIN)
            if name in SIBLINGS:
                close(name, SIBLINGS[name])
            self.tag.append(name)
            self.parent.append(stack[-1])
            out, named = self._verdict(name, more)
            self.out.append(out)
            self.named.append(named)
            depths.setdefault(name, []).append(len(stack))
            stack.append(len(self.tag) - 1)
        text(source[at:])

    @staticmethod
    def _verdict(name: str, attributes: str) -> tuple[bool, str]:
        """Out by its kind; what it is suspected of: nothing (""), "comments" or "other"."""
        if name in KEEP:
            return False, ""
        named = "other" if name in SUSPECT else ""
        for m in _ATTRIBUTE.finditer(attributes):
            key, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
            if key in ("class", "id"):
                parts = re.split(r"[^a-z0-9]+", value)
                if not COMMENTS.isdisjoint(parts):
                    named = "comments"
                elif not NAMES.isdisjoint(parts):
                    named = named or "other"
            elif key == "role":
                named = named or ("other" if value in ROLES else "")
            elif key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display\s*:\s*none", value)):
                return True, ""
        return name in NEVER, named

    def prune(self) -> None:
        """Settles which nodes are out, with all below them."""
        n, size = len(self.tag), [0] * len(self.tag)
        for node, _, text in self.runs:
            size[node] += len(" ".join(text.split()))
        holds = [t in ("article", "main") for t in self.tag]
        around = [0] * n  # the nearest article or main that a node is in; 0, the page, if none
        for i in range(1, n):
            up = self.parent[i]
            around[i] = up if self.tag[up] in ("article", "main") else around[up]
            self.out[i] = self.out[i] or self.out[up]
        for i in range(n - 1, 0, -1):
            if not self.out[i]:
                size[self.parent[i]] += size[i]
                holds[self.parent[i]] = holds[self.parent[i]] or holds[i]
        for i in range(1, n):
            self.out[i] = self.out[i] or self.out[self.parent[i]]
            if self.out[i] or not self.named[i] or holds[i]:
                continue
            # An article has headings and a header of its own.
            if around[i] and (self.tag[i] in HEADINGS or self.tag[i] == "header"):
                continue
            whole = size[around[i]]
            if not around[i] and holds[0]:
                self.out[i] = True  # the page marks its article, and this is outside
            elif self.named[i] == "comments":
                self.out[i] = size[i] < whole
            else:
                self.out[i] = 2 * size[i] < whole

    def main_node(self) -> int:
        n = len(self.tag)
        chars, tags, link_chars, link_tags = ([0] * n for _ in range(4))
        direct = [0] * n
        linked = [False] * n
        for i in range(1, n):
            linked[i] = linked[self.parent[i]] or self.tag[i] == "a"
        for node, _, text in self.runs:
            if not self.out[node]:
                direct[node] += len(" ".join(text.split()))
        for i in range(n - 1, -1, -1):
            if self.out[i]:
                continue
            chars[i] += direct[i]
            if linked[i]:
                link_chars[i] = chars[i]
            if i:
                up = self.parent[i]
                chars[up] += chars[i]
                tags[up] += tags[i] + 1
                link_chars[up] += link_chars[i]
                link_tags[up] += link_tags[i] + (self.tag[i] == "a")
        body = next((i for i in range(n) if self.tag[i] == "body" and not self.out[i]), 0)
        share = link_chars[body] / max(1, chars[body])

        def density(c: int, t: int, lc: int, lt: int) -> float:
            if not c:
                return 0.0
            t = max(1, t)
            base = math.log(c / max(1, c - lc) * lc + share * c + math.e)
            return c / t * math.log(max(1.0, c / max(1, lc) * t / max(1, lt))) / max(0.1, math.log(base))

        dense = [0.0 if self.out[i] else density(chars[i], tags[i], link_chars[i], link_tags[i]) for i in range(n)]
        total = [0.0] * n
        for i in range(n):
            if direct[i]:
                total[i] += density(direct[i], 1, direct[i] if linked[i] else 0, 0)
            if i:
                total[self.parent[i]] += dense[i]
        below = [False] * n
        for i in range(body + 1, n):
            below[i] = self.parent[i] == body or below[self.parent[i]]
        inside = [i for i in range(n) if below[i] and chars[i]]
        if not inside:
            return body
        i = max(inside, key=lambda k: (dense[k], -k))
        least = dense[i]
        while i != body:
            least = min(least, dense[i])
            i = self.parent[i]
        best = max((k for k in inside if dense[k] >= least), key=lambda k: (total[k], -k))
        if direct[body] and total[body] > total[best]:
            best = body
        while best != body and chars[best] < SHARE * chars[body]:
            best = self.parent[best]
        return best

    def text(self) -> str:
        self.prune()
        best = self.main_node()
        inside = [False] * len(self.tag)
        inside[best] = True
        for i in range(best + 1, len(self.tag)):
            inside[i] = inside[self.parent[i]]
        blocks: list[str] = []
        last = None
        for node, block, text in self.runs:
            if inside[node] and not self.out[node]:
                if block != last:
                    blocks.append(text)
                    last = block
                else:
                    blocks[-1] += text
        return "\n\n".join(filter(None, (" ".join(b.split()) for b in blocks)))


def main_text(source: str) -> str:
    return Page(source).text() if source else ""


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars)"""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in byte_slices(batches, 2):
            texts = [main_text(t or "") for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op8_text_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
