"""Main text of web pages by two-pass block rules.

A page is split into blocks. Pass one looks at link density, length and stop-word
density of every block: mostly links is dropped, long enough prose is kept, the
rest stays open. Outside of an article or main element a line that claims rights is
dropped. Pass two lets open blocks inherit the label of their nearest decided
neighbours in the same kind of container.

The innermost telling container (by tag, role, class or id) is one more input of pass
one. A name that says furniture as a whole (``sidebar``, ``site-footer``, ``comment-list``)
marks its container; a name of which that is only a part (``has-sidebar``,
``related-work``) raises the length and density that prose in it needs. What stands in a
marked container is dropped, but a container that holds most of a page's prose is no
furniture, whatever it is called: if its prose outweighs by ``MOST`` times all text but links
that stands outside of marked containers, the mark is void, and what the container stands in
decides. Reader comments may outweigh an article; their mark, and that of a short notice, is void
only where nothing stands outside.

A page is one row, so the operator is a map without a shuffle; its work is linear
in the page (but for sorting its containers).

Edge cases: null or empty html gives an empty text; unclosed or cut-off tags,
comments and scripts end with the page; repeated rows give repeated results;
clashing extra columns are not carried. ``br`` is white space inside a block.
A page whose blocks are all open is kept whole.
"""

from __future__ import annotations

import heapq
import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality import STOP_WORDS

# Element names and the class, id and role words of page furniture.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
FURNITURE = frozenset("nav header footer aside form menu head dialog button select textarea noscript iframe object svg canvas template fieldset".split())
CONTENT = frozenset(("article", "main"))
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
PUNCTUATION = ".,;:!?\"'()[]«»“”"
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "title", "textarea", "noscript", "template", "svg", "iframe")
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal "
    "overlay newsletter subscribe subscription signup comment comments commentlist disqus reply replies respond responses sidebar sidebars widget widgets "
    "menu menus nav navbar navigation breadcrumb breadcrumbs footer header masthead share sharing social related recommended pagination pager login search "
    "copyright legal skip toolbar".split()
)
#: Words of names that say nothing beside those above, and the names of reader comments.
NEUTRAL = frozenset(
    "site page main primary secondary content list box wrap wrapper container section area block bar inner outer item items link links text title body top bottom left right row col "
    "column group panel unit zone slot holder label button buttons btn icon icons form field modal js the post global local sticky mobile desktop small large".split()
)
COMMENTS = frozenset("comment comments commentlist disqus reply replies respond responses".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|title|textarea|noscript|template|svg|iframe)\b[^>]*(?:>.*?(?:</\1\s*>|\Z)|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']*(?:\"[^\"]*\"|'[^']*'))*[^<>\"']*|[^>]*)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

#: How a line of rights begins.
RIGHTS = re.compile(r"(?:©|\(c\)\s|copyright\b|all rights reserved)", re.I)
LONG = 140
SHORT = 70
MANY_STOP_WORDS = 0.2
SOME_STOP_WORDS = 0.1
MANY_LINKS = 0.5
_STOP = frozenset(STOP_WORDS)

KEEP, DROP, OPEN = 1, 0, -1
#: What the innermost telling container says; how often a container must outweigh the rest for its mark to be void.
ARTICLE, PLAIN, ASIDE = 1, 0, -1
MOST = 2


@dataclass
class Block:
    text: str
    links: float  # share of its characters inside links
    box: int  # number of the innermost telling container (-1: none)
    weak: bool = False  # a name around it says furniture in part
    hint: int = PLAIN


@dataclass
class Box:
    """A telling container: an article, or one that is marked as furniture."""

    parent: int
    article: bool
    comments: bool = False
    void: bool = False


#: What the attributes of an element say.
SILENT, WEAK, MARKED, REMARKS = range(4)


def _name_says(value: str) -> int:
    says = SILENT
    for token in value.split():
        parts = [part.lower() for part in NAME_PARTS.findall(token)]
        if any(part in COMMENTS for part in parts) and all(part in NAMES or part in NEUTRAL for part in parts):
            return REMARKS
        if any(part in NAMES for part in parts):
            says = max(says, MARKED if all(part in NAMES or part in NEUTRAL for part in parts) else WEAK)
    return says


def _marks(attributes: str) -> int:
    """Whether class, id, role or style call an element furniture or hidden."""
    says = SILENT
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id"):
            says = max(says, _name_says(value))
        elif name == "role":
            says = max(says, MARKED if value.lower() in ROLES else SILENT)
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            says = max(says, MARKED)
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            says = max(says, MARKED)
    return says


def blocks(page: str) -> list[Block]:
    """The non-empty blocks of a page in order, with what their containers say."""
    out: list[Block] = []
    boxes: list[Box] = []
    stack: list[tuple[str, int, bool]] = []  # open elements: name, telling container and weak name that hold inside
    held: Counter[str] = Counter()  # how many of each name are open
    pieces: list[str] = []
    linked: list[str] = []
    links = 0
    own: int | None = None  # the container of a paragraph, or of a heading in an article's header

    def box() -> int:
        return stack[-1][1] if stack else -1

    def flush() -> None:
        text = " ".join("".join(pieces).split())
        if text:
            inside = sum(len(x) for x in "".join(linked).split())
            out.append(Block(text, inside / max(1, len(text) - text.count(" ")), box() if own is None else own, bool(stack) and stack[-1][2]))
        pieces.clear()
        linked.clear()

    def take(text: str) -> None:
        text = html.unescape(text)
        pieces.append(text)
        if links:
            linked.append(text)

    def telling(parent: int, article: bool, comments: bool = False) -> int:
        boxes.append(Box(parent, article, comments))
        return len(boxes) - 1

    def push(name: str, where: int, weak: bool) -> None:
        stack.append((name, where, weak))
        held[name] += 1

    def pop(name: str) -> None:
        """Close the innermost open ``name`` and all inside it."""
        while held[name]:
            last = stack.pop()[0]
            held[last] -= 1
            if last == name:
                break

    at = 0
    for m in MARKUP.finditer(page):
        if m.start() > at:
            take(page[at : m.start()])
        at = m.end()
        name = (m[3] or "").lower()
        if not name:
            if m[1]:
                pieces.append(" ")
            continue
        if name == "a":
            links = max(0, links - 1) if m[2] else 1
        elif name == "br":
            pieces.append(" ")
        elif name in BLOCKS or name in FURNITURE:
            flush()
            links, own = 0, None
            if name == "body":  # a head that was never closed ends here
                pop("head")
            if m[2]:
                pop(name)
            elif name == "p":
                says = _marks(m[4])
                own = telling(box(), False, says == REMARKS) if says >= MARKED else None
            elif name not in VOID and name not in ("html", "body"):
                if name in ("li", "td", "th", "tr", "dd", "dt", "option") and stack and stack[-1][0] == name:
                    pop(name)
                if name in HEADINGS and len(stack) > 1 and stack[-1][0] == "header" and stack[-2][1] >= 0 and boxes[stack[-2][1]].article:
                    own = stack[-2][1]  # the article's own header
                if not m[4].rstrip().endswith("/"):
                    says = _marks(m[4])
                    if name in CONTENT:
                        push(name, telling(box(), True), False)
                    elif name in FURNITURE or says >= MARKED:
                        push(name, telling(box(), False, says == REMARKS), False)
                    else:
                        push(name, box() if own is None else own, says == WEAK or bool(stack) and stack[-1][2])
        elif not m[2] and name not in VOID and (says := _marks(m[4])) >= MARKED:  # inline furniture
            flush()
            push(name, telling(box(), False, says == REMARKS), False)
        elif m[2] and stack and stack[-1][0] == name:
            flush()
            pop(name)
    if at < len(page):
        take(page[at:])
    flush()
    void_marks(out, boxes)
    for b in out:
        k = b.box
        while k >= 0 and boxes[k].void:
            boxes[k].parent = k = _outside(boxes, k)
        b.hint = PLAIN if k < 0 else ARTICLE if boxes[k].article else ASIDE
    return out


def _outside(boxes: list[Box], k: int) -> int:
    """The container that a void one stands in, past further void ones."""
    parent = boxes[k].parent
    return boxes[parent].parent if parent >= 0 and boxes[parent].void else parent


def void_marks(found: list[Block], boxes: list[Box]) -> None:
    """Mark the boxes void that hold most of a page's prose, from the outermost in."""
    prose = [0] * (len(boxes) + 1)  # of each box with what it holds, the last for no box
    direct = [0] * (len(boxes) + 1)
    text = [0] * (len(boxes) + 1)  # what may be prose too
    for b in found:
        says = _densities(b)
        direct[b.box] += len(b.text) if says == KEEP else 0
        text[b.box] += len(b.text) if says != DROP else 0
    parts: dict[int, list[int]] = {}
    for k in range(len(boxes) - 1, -1, -1):  # a box stands after the one that holds it
        prose[k] += direct[k]
        if not boxes[k].article:  # an article's prose is its own, not that of what it stands in
            parts.setdefault(boxes[k].parent, []).append(k)
            prose[boxes[k].parent] += prose[k]
    outside = text[-1] + sum(text[k] for k, box in enumerate(boxes) if box.article)
    heap = [(-prose[k], k) for holder, inner in parts.items() if holder < 0 or boxes[holder].article for k in inner]
    heapq.heapify(heap)
    while heap:
        weight, k = heapq.heappop(heap)
        if -weight <= MOST * outside or outside and (boxes[k].comments or -weight < 2 * LONG):
            continue
        boxes[k].void = True
        outside += text[k]
        for inner in parts.get(k, ()):
            heapq.heappush(heap, (-prose[inner], inner))


def _densities(block: Block) -> int:
    """KEEP, DROP or OPEN by link density, length and stop-word density."""
    if block.links > MANY_LINKS:
        return DROP
    size = len(block.text)
    if size < SHORT:
        return OPEN
    tokens = block.text.lower().split()
    stop = sum(t.strip(PUNCTUATION) in _STOP for t in tokens) / len(tokens)
    if block.weak:
        return KEEP if stop >= (SOME_STOP_WORDS if size >= LONG else MANY_STOP_WORDS) else OPEN
    if size >= LONG and (stop >= MANY_STOP_WORDS or block.links == 0) or stop >= SOME_STOP_WORDS and block.links == 0:
        return KEEP
    return OPEN


def first_pass(block: Block) -> int:
    """KEEP, DROP or OPEN by densities and container."""
    if block.hint == ASIDE or len(block.text) < LONG and block.hint == PLAIN and RIGHTS.match(block.text):
        return DROP
    return _densities(block)


def second_pass(labels: list[int], hints: list[int]) -> list[int]:
    """Open labels take that of the nearest decided neighbour (kept on ties or without any).

    An article's open blocks do not look at what stands outside of it.
    """
    out = list(labels)
    for kind in (ARTICLE, PLAIN):
        seen = [i for i, h in enumerate(hints) if kind == PLAIN or h == kind]
        before = _last_decided(seen, labels)
        after = _last_decided(seen[::-1], labels)
        for i in seen:
            if labels[i] == OPEN and hints[i] == kind:
                near = [(abs(i - k), -labels[k], labels[k]) for k in (before[i], after[i]) if k is not None]
                out[i] = min(near)[2] if near else KEEP
    return out


def _last_decided(order: list[int], labels: list[int]) -> dict[int, int | None]:
    """For each block of ``order``, the last decided one up to it."""
    out, last = {}, None
    for i in order:
        last = i if labels[i] != OPEN else last
        out[i] = last
    return out


def main_text(page: str | None) -> str:
    """The main text of a page: kept blocks joined by line feeds."""
    found = blocks(page or "")
    labels = second_pass([first_pass(b) for b in found], [b.hint for b in found])
    return "\n".join(b.text for b, label in zip(found, labels, strict=True) if label == KEEP)


def extract_pages(df: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), page: str = "html") -> DataFrame:
    """The columns in ``keep``, text string and n_chars long of every page."""

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(len(keep))]
            columns = [batch.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[*keep, "text", "n_chars"])

    schema = df.select(*keep).schema.add("text", "string").add("n_chars", "long")
    return df.select(*keep, F.col(page).alias("_page")).mapInArrow(extracted, schema)
