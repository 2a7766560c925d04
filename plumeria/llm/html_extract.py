"""Main text of web pages by minimum-cut labelling of their text blocks.

Each block is tied to "content" and to "boilerplate" by what a classifier would pay for labelling it
otherwise: its containers' tags and class names, its length, how much of it is link text. Neighbouring
blocks, and blocks of one container, are tied to each other. The cheapest labelling of all blocks at
once is a minimum cut, found by maximum flow.
"""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The name of a tag, and what cannot end it: ``>`` does, and quotes are read in pairs.
OPENING = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
PLAIN = re.compile(r"[^>\"']*+")
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
NAME = re.compile(r"[a-z]+")
#: Elements by what they are for.
UNSEEN = frozenset("script style noscript template iframe object svg math canvas audio video head title textarea".split())
RAW = frozenset("script style textarea title iframe noscript".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FOREIGN = ("svg", "math")
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul button".split())
CLOSES_P = BLOCKS - frozenset("body html option".split())
ITEMS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
BOILERPLATE_TAGS = frozenset("nav footer aside form menu button select dialog header".split())
BOILERPLATE_NAMES = frozenset("ad ads adv advert advertisement adverts banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar side widget footer header masthead topbar cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup share sharing social related recommended comment comments disqus respond replies reply login search pagination pager toolbar copyright legal disclaimer contentinfo complementary".split())
CONTENT_TAGS = frozenset("article main".split())
CONTENT_NAMES = frozenset("article content post entry story main body text".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


@dataclass
class Costs:
    """What each sign adds to a block's tie to content (+) or boilerplate (-), and to ties between blocks."""

    container: float = 4.0
    boilerplate_inside: float = 12.0  #: a boilerplate element with no content element within it
    boilerplate_outside: float = 1.0  #: one around the content element
    length: float = 0.02  #: for each character
    longest: float = 3.0
    heading: float = 1.0
    links: float = 4.0  #: times the share of link text
    notice: float = 3.0  #: starts with a copyright sign
    bare: float = 1.0  #: outside the content elements of a page that has some, less the longer the text
    bare_length: float = 40.0  #: from which on it costs nothing
    neighbours: float = 0.5
    siblings: float = 1.0


COSTS = Costs()


@dataclass
class Element:
    """An open element: its number, and what its ancestors and itself say of what lies in it."""

    tag: str
    number: int
    content: bool  #: one of them is a content element
    around: int  #: boilerplate elements around the innermost content element
    inside: int  #: and within it
    heading: bool


@dataclass
class Block:
    """A text block: its holder, the number of the holder's parent, and how many elements lie between it and the block before."""

    text: str
    links: int  #: characters of link text
    holder: Element
    parent: int
    apart: int


def _sign(tag: str, attributes: str) -> int:
    names: set[str] = set()
    if "=" in attributes:
        for m in NAMES.finditer(attributes):
            names |= set(NAME.findall((m[1] or m[2] or m[3] or "").lower()))
    if tag in BOILERPLATE_TAGS or names & BOILERPLATE_NAMES:
        return -1
    return int(tag in CONTENT_TAGS or bool(names & CONTENT_NAMES))


class _Tags:
    """Ends of tags, in time linear in the page: no part of it is searched twice for the same thing."""

    def __init__(self, page: str):
        self._page, self._failed = page, set()
        self._last = {c: page.rfind(c) for c in ">\"'"}
        self._from = self._to = -1  # the last run without > and quotes

    def find(self, char: str, at: int) -> int:
        return self._page.find(char, at) if at <= self._last[char] else -1

    def end(self, at: int) -> int:
        """Where ``>`` ends the tag whose attributes begin at ``at``; -1 if none does. A quote that nothing closes is a character."""
        page, seen = self._page, []
        while True:
            if not self._from <= at <= self._to:
                self._from, self._to = at, PLAIN.match(page, at).end()
            at = self._to
            if at == len(page) or at in self._failed:
                self._failed.update(seen)
                return -1
            if page[at] == ">":
                return at
            seen.append(at)
            at = max(at, self.find(page[at], at + 1)) + 1


def blocks(page: str) -> list[Block]:
    """Text blocks in page order: character references decoded, white space (``<br>`` too) as one space, empty ones left out."""
    out: list[Block] = []
    stack = [Element("", 0, False, 0, 0, False)]
    opened: dict[str, list[int]] = {}  # places of open elements in the stack, by tag
    parts: list[str] = []
    links = count = at = anchors = unseen = 0
    low = 1  # how far the stack was taken down since the last block
    before = 0  # and how deep that block lay
    tags = _Tags(page)

    def flush() -> None:
        nonlocal links, low, before
        text = " ".join("".join(parts).split())
        if text:
            out.append(Block(text, links, stack[-1], stack[-2].number if len(stack) > 1 else 0, before + len(stack) - 2 * low))
            low = before = len(stack)
        parts.clear()
        links = 0

    def leave(index: int) -> None:
        """Close the elements from ``index`` on."""
        nonlocal anchors, unseen, low
        if any(e.tag in BLOCKS for e in stack[index:]):
            flush()
        while len(stack) > index:
            tag = stack.pop().tag
            opened[tag].pop()
            anchors -= tag == "a"
            unseen -= tag in UNSEEN
        low = min(low, len(stack))

    def innermost(tag: str, stops=()) -> int:
        place = lambda t: opened[t][-1] if opened.get(t) else -1
        found = place(tag)
        return found if found > max(map(place, stops), default=-1) else -1

    def read(text: str) -> None:
        nonlocal links
        if text and not unseen:
            text = html.unescape(text) if "&" in text else text
            parts.append(text)
            if anchors:
                links += len(text.strip())

    done = 0  # what has been read
    while (at := page.find("<", at)) >= 0:
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            read(page[done:at])
            done = at = end + 3 if end >= 0 else len(page)
            continue
        if page.startswith(("<!", "<?"), at):
            end = tags.find(">", at)
            if end >= 0:
                read(page[done:at])
                done = end + 1
            at = end + 1 if end >= 0 else at + 1
            continue
        m = OPENING.match(page, at)
        end = tags.end(m.end()) if m else -1
        if end < 0:
            at += 1
            continue
        read(page[done:at])
        attributes = page[m.end() : end]
        done = at = end + 1
        tag, closing = m[2].lower(), bool(m[1])
        if closing:
            if (k := innermost(tag)) >= 0:
                leave(k)
            elif tag == "p":
                flush()
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in BLOCKS:
            if tag in CLOSES_P and (k := innermost("p", ("table", "button", "object"))) >= 0:
                leave(k)
            if tag in ITEMS and (k := innermost(tag, ITEMS[tag])) >= 0:
                leave(k)
            flush()
        if tag == "body" and (k := innermost("head")) >= 0:
            leave(k)
        if tag in VOID or (attributes.endswith("/") and (tag in FOREIGN or any(opened.get(f) for f in FOREIGN))):
            continue  # elsewhere a slash closes nothing: it may end an address
        count += 1
        sign, up = _sign(tag, attributes), stack[-1]
        around, inside = (up.around + up.inside, 0) if sign > 0 else (up.around, up.inside + (sign < 0))
        opened.setdefault(tag, []).append(len(stack))
        stack.append(Element(tag, count, up.content or sign > 0, around, inside, up.heading or tag in HEADINGS))
        anchors += tag == "a"
        unseen += tag in UNSEEN
        if tag in RAW:
            end = re.compile(f"</{re.escape(tag)}", re.I).search(page, at)
            done = at = end.start() if end else len(page)
    read(page[done:])
    flush()
    return out


def terminals(block: Block, costs: Costs = COSTS, marked: bool = False) -> tuple[float, float]:
    """(tie to content, tie to boilerplate) of a block; ``marked`` if its page has content elements."""
    holder, size = block.holder, len(block.text)
    good = min(costs.longest, costs.length * size) + costs.container * holder.content + costs.heading * holder.heading
    bad = costs.boilerplate_inside * (holder.inside > 0) + costs.boilerplate_outside * holder.around + costs.links * min(1.0, block.links / size) + costs.notice * (block.text[0] in "©®")
    return good, bad + costs.bare * (marked and not holder.content) * max(0.0, 1 - size / costs.bare_length)


def minimum_cut(good: list[float], bad: list[float], ties: dict[tuple[int, int], float]) -> list[bool]:
    """Whether each node stays with the source (content).

    A node that one terminal holds more strongly than all its ties together goes there at once, and its ties
    then count for its neighbours; what is left is cut by maximum flow.
    """
    n = len(good)
    net = [g - b for g, b in zip(good, bad, strict=True)]  # the lesser of the two flows through at once
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for (i, j), w in ties.items():
        if w > 0:
            near[i][j] = near[i].get(j, 0.0) + w
            near[j][i] = near[j].get(i, 0.0) + w
    slack = [sum(t.values()) for t in near]
    kept: list[bool | None] = [None] * n
    todo = list(range(n))
    while todo:
        i = todo.pop()
        if kept[i] is None and abs(net[i]) > slack[i] + 1e-9:
            kept[i] = net[i] > 0
            for j, w in near[i].items():
                if kept[j] is None:
                    net[j] += w if kept[i] else -w
                    slack[j] -= w
                    todo.append(j)
    rest = [i for i in range(n) if kept[i] is None]
    if rest:
        place = {i: k for k, i in enumerate(rest)}
        inner = {(place[i], place[j]): w for i in rest for j, w in near[i].items() if i < j and j in place}
        for i, side in zip(rest, _flow([net[i] for i in rest], inner), strict=True):
            kept[i] = side
    return [bool(k) for k in kept]


def _flow(net: list[float], ties: dict[tuple[int, int], float]) -> list[bool]:
    """Maximum flow by shortest augmenting levels, then what the source still reaches."""
    n = len(net)
    source, sink = n, n + 1
    room: list[dict[int, float]] = [{} for _ in range(n + 2)]
    for k, x in enumerate(net):
        if x > 0:
            room[source][k], room[k][source] = x, 0.0
        elif x < 0:
            room[k][sink], room[sink][k] = -x, 0.0
    for (i, j), w in ties.items():
        room[i][j] = room[j][i] = w

    def levels() -> list[int]:
        level, todo = [-1] * (n + 2), deque([source])
        level[source] = 0
        while todo:
            x = todo.popleft()
            for y, r in room[x].items():
                if r > 1e-9 and level[y] < 0:
                    level[y] = level[x] + 1
                    todo.append(y)
        return level

    while (level := levels())[sink] >= 0:
        arcs = [list(r) for r in room]
        path = [source]
        while path:
            x = path[-1]
            if x == sink:
                steps = list(zip(path, path[1:], strict=False))
                flow = min(room[a][b] for a, b in steps)
                for a, b in steps:
                    room[a][b] -= flow
                    room[b][a] += flow
                path = path[: next(k for k, (a, b) in enumerate(steps) if room[a][b] <= 1e-9) + 1]
                continue
            while arcs[x] and not (room[x][arcs[x][-1]] > 1e-9 and level[arcs[x][-1]] == level[x] + 1):
                arcs[x].pop()
            if arcs[x]:
                path.append(arcs[x][-1])
            else:
                path.pop()
                if path:
                    arcs[path[-1]].pop()
    return [x >= 0 for x in level[:n]]


def main_text(page: str | None, costs: Costs = COSTS) -> str:
    """Blocks labelled content, joined by line feeds.

    A tie between two blocks weakens with the difference of their shares of link text, so a paragraph is not
    drawn to the links beside it.
    """
    found = blocks(page or "")
    marked = any(b.holder.content for b in found)
    good, bad = zip(*(terminals(b, costs, marked) for b in found), strict=True) if found else ((), ())
    share = [min(1.0, b.links / len(b.text)) for b in found]
    ties: dict[tuple[int, int], float] = {}
    last: dict[int, int] = {}

    def tie(i: int, j: int, weight: float) -> None:
        ties[i, j] = ties.get((i, j), 0.0) + weight * (1 - abs(share[i] - share[j]))

    for k, b in enumerate(found):
        if k:
            tie(k - 1, k, costs.neighbours / (1 + b.apart))
        if (j := last.get(b.parent)) is not None:
            tie(j, k, costs.siblings)
        last[b.parent] = k
    return "\n".join(b.text for b, keep in zip(found, minimum_cut(list(good), list(bad), ties), strict=True) if keep)


def extract_main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of each row of ``pages`` (page_id, url, html).

    Null and empty pages have an empty text. Rows are taken one by one, so repeated rows come back as
    often; an empty table gives no rows; other columns are ignored.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            text = [main_text(p) for p in batch["html"]]
            yield pd.DataFrame({"page_id": batch["page_id"].astype("Int64").array, "url": batch["url"].array, "text": text, "n_chars": list(map(len, text))})

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInPandas(run, "page_id long, url string, text string, n_chars long")
