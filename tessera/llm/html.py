"""Main text of web pages by a minimum cut.

A page is cut into text blocks. A fixed linear classifier over a block's elements, class names, length and links gives
the costs of calling it content or boilerplate; these are the capacities to the terminals. Blocks next to each other,
and consecutive blocks under one parent element, are joined by smoothness edges. A maximum flow separates the two sides;
what stays connected to the source is content. One narrow pass; a page's graph has some edges per block.

Defined results: null and blank pages give an empty text; a script, style, title or textarea that is never closed ends
with the page, of other elements without an end only the tag is dropped, and a head ends where its content does; repeated rows
are kept; other columns are ignored; an empty table gives none.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
#: Elements whose content is no text of the page.
RAW = ("script", "style", "title", "textarea", "noscript", "template", "iframe", "svg", "math", "object", "canvas", "head", "select", "button")
#: Those whose content is plain characters: without an end tag they end with the page.
CHARACTERS = ("script", "style", "title", "textarea")
#: What can stand in a head.
IN_HEAD = {"html", "head", "title", "base", "basefont", "bgsound", "link", "meta", "script", "style", "noscript", "noframes", "template"}
#: An attribute's value without quotes takes the slash before the end of a tag.
VALUE_SLASH = re.compile(r"=\s*[^\s\"'=]+/\Z")
#: Elements that leave the text around them in one block; all others end a block.
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark",
    "nobr", "q", "ruby", "rb", "rp", "rt", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
}
VOID = {"area", "base", "col", "embed", "hr", "input", "link", "meta", "param", "source", "track"}
#: What an opening element ends if it is open.
ENDS = {"li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("td", "th", "tr"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Evidence for boilerplate (negative) or content by an enclosing element or a word of its class, id or role.
ELEMENTS = {"nav": -9, "footer": -9, "header": -6, "aside": -9, "form": -9, "menu": -9, "dialog": -9, "address": -2, "article": 6, "main": 5, "ul": -1, "ol": 0}
NAMES = re.compile(
    r"(?P<bad>\b(?:ads?|adverts?|advertisements?|sponsor\w*|promo\w*|banner|nav\w*|menu|side-?bar|footer|header|masthead|breadcrumbs?|comments?|replies|respond"
    r"|cookies?|consent|notices?|alert|popup|modal|overlay|newsletter|subscribe|signup|login|share|sharing|social|related|recommend\w*|widget|toolbar|legal|copyright)\b)"
    r"|(?P<good>\b(?:article|content|entry|post|story|main|body|text)\b)",
    re.I,
)
ATTRIBUTE = re.compile(r"\b(?:class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)


@dataclass
class Block:
    text: str
    parent: int
    evidence: float
    linked: int  #: characters inside links
    tag: str


@dataclass
class _Element:
    tag: str
    number: int
    evidence: float = 0.0


@dataclass
class _Builder:
    stack: list[_Element] = field(default_factory=lambda: [_Element("", 0)])
    blocks: list[Block] = field(default_factory=list)
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    count: int = 0

    def flush(self) -> None:
        text = " ".join(unescape("".join(self.parts)).split())
        if text:
            top = self.stack[-1]
            parent = self.stack[-2].number if len(self.stack) > 1 else 0
            self.blocks.append(Block(text, parent, sum(e.evidence for e in self.stack), self.linked, top.tag))
        self.parts, self.linked = [], 0

    def open(self, tag: str, attributes: str) -> None:
        self.flush()
        for other in ENDS.get(tag, ("p",)):
            if self.stack[-1].tag == other:
                self.stack.pop()
        if tag in VOID:
            return
        evidence = float(ELEMENTS.get(tag, 0))
        if attributes:
            for values in ATTRIBUTE.findall(attributes):
                for m in NAMES.finditer("".join(values).replace("_", " ").replace("-", " ")):
                    evidence += -8 if m.lastgroup == "bad" else 2
        self.count += 1
        self.stack.append(_Element(tag, self.count, evidence))

    def close(self, tag: str) -> None:
        self.flush()
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].tag == tag:
                del self.stack[k:]
                return


def _end_tag(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}\s*>", re.I)


def _head_end(page: str, at: int) -> int:
    """Where the content of a head ends: after its end tag, or before the text or element that cannot stand in it."""
    while m := TAG.search(page, at):
        tag = (m[2] or "").lower()
        if page[at : m.start()].strip():
            return at
        if tag == "head" and m[1]:
            return m.end()
        if tag and (tag in ("body", "html") if m[1] else tag not in IN_HEAD):
            return m.start()
        at = m.end()
        if not m[1] and tag in ("title", "script", "style", "noscript", "noframes", "template"):
            end = _end_tag(tag).search(page, at)
            at = end.end() if end else len(page) if tag in CHARACTERS else at
    return at


def blocks(page: str) -> list[Block]:
    """Text blocks in page order."""
    out, at, in_link = _Builder(), 0, False
    endless: set[str] = set()

    def text(piece: str) -> None:
        out.parts.append(piece)
        if in_link:
            out.linked += len(piece)

    while m := TAG.search(page, at):
        if m.start() > at:
            text(page[at : m.start()])
        at, tag = m.end(), (m[2] or "").lower()
        if not tag:
            continue
        if tag in RAW and not m[1]:
            if tag not in ("textarea", "select", "button"):
                out.flush()
            if tag == "head":
                at = _head_end(page, at)
                continue
            if tag in ("svg", "math") and m[3].endswith("/") and not VALUE_SLASH.search(m[3]):
                continue
            end = None if tag in endless else _end_tag(tag).search(page, at)
            if end is None:
                endless.add(tag)
            elif tag in ("select", "button") and re.compile(rf"<{tag}[\s/>]", re.I).search(page, at, end.start()):
                continue  # the next one ends it
            at = end.end() if end else len(page) if tag in CHARACTERS else at
        elif tag == "a":
            in_link = not m[1]
        elif tag == "br":
            text(" ")
        elif tag in INLINE:
            continue
        elif m[1]:
            out.close(tag)
        else:
            out.open(tag, m[3])
    text(page[at:])
    out.flush()
    return out.blocks


def costs(block: Block) -> tuple[int, int]:
    """Costs of calling a block boilerplate and of calling it content, in hundredths."""
    size = len(block.text)
    share = min(1.0, block.linked / size)
    z = block.evidence - 4 * share - 1.0 + min(4.0, size / 60) * (1 - share)
    z += 0.5 * (block.text[-1] in ".!?…\"”") + 1.5 * (block.tag in ("h1", "h2", "h3", "p", "blockquote", "pre")) - 1.0 * (block.tag == "li") - 2.0 * (block.text[0] == "©")
    return (round(100 * z), 0) if z > 0 else (0, round(-100 * z))


def minimum_cut(terminals: list[tuple[int, int]], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Sides of the nodes in a minimum cut: True with the source. ``terminals``: capacities from the source and to the
    sink; ``edges``: two nodes and the capacity between them, either way. Shortest augmenting paths."""
    n = len(terminals)
    # what flows straight from the source through a node to the sink needs no search
    spare = [a - min(a, b) for a, b in terminals]
    sink = [b - min(a, b) for a, b in terminals]
    flow: list[dict[int, int]] = [{} for _ in range(n)]
    for a, b, c in edges:
        flow[a][b] = flow[a].get(b, 0) + c
        flow[b][a] = flow[b].get(a, 0) + c
    while True:
        before: dict[int, int] = {k: -1 for k in range(n) if spare[k]}
        queue, end = deque(before), -1
        while queue and end < 0:
            a = queue.popleft()
            for b, c in flow[a].items():
                if c and b not in before:
                    before[b] = a
                    if sink[b]:
                        end = b
                        break
                    queue.append(b)
        if end < 0:
            return [k in before for k in range(n)]
        path, k = [], end
        while before[k] >= 0:
            path.append((before[k], k))
            k = before[k]
        amount = min(spare[k], sink[end], *(flow[a][b] for a, b in path))
        spare[k] -= amount
        sink[end] -= amount
        for a, b in path:
            flow[a][b] -= amount
            flow[b][a] += amount


def main_text(page: str | None, near: int = 60, sibling: int = 120) -> str:
    """Content blocks of a page, joined by line feeds."""
    found = blocks(page or "")
    edges, last = [], {}
    for k, block in enumerate(found):
        if k:
            edges.append((k - 1, k, near))
        if block.parent in last:
            edges.append((last[block.parent], k, sibling))
        last[block.parent] = k
    sides = minimum_cut([costs(b) for b in found], edges)
    return "\n".join(b.text for b, content in zip(found, sides) if content)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                texts = [main_text(p.as_py()) for p in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", F.col("url").cast("string"), "html").mapInArrow(run, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars bigint")
