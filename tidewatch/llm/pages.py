"""Main text of web pages by a minimum cut between content and boilerplate."""

from __future__ import annotations

import re
from collections import Counter, deque
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import arrow_schema, in_arrow

# HTML element names by role, and words in class, id and role that name a role.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = set("head script style template noscript iframe object svg math canvas audio video textarea select".split())
BLOCKS = set(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol "
    "optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
BOILER_TAGS = set("nav footer aside form menu dialog button fieldset search header".split())
CONTENT_TAGS = set("article main".split())
BOILER_WORDS = set(
    "ad ads adv advert advertisement adverts banner breadcrumb breadcrumbs byline captcha comment comments consent "
    "contentinfo cookie cookies copyright disclaimer disqus footer gdpr header masthead menu modal nav navbar "
    "navigation newsletter notice notification notifications overlay pager pagination popup privacy promo promoted "
    "promotion recommended related replies reply respond search share sharing sidebar signup skip social sponsor "
    "sponsored subscribe subscription tags toc toolbar topbar widget widgets alert complementary login".split()
)
CONTENT_WORDS = set("article articlebody content entry main post story text body".split())
#: An open element of the value's set is closed by the start tag of the key.
CLOSED_BY = {
    **{t: {"p"} for t in BLOCKS - {"body", "html", "button", "option", "optgroup", "summary", "caption"}},
    "li": {"li", "p"},
    "dt": {"dt", "dd", "p"},
    "dd": {"dt", "dd", "p"},
    "tr": {"tr", "td", "th", "p"},
    "td": {"td", "th", "p"},
    "th": {"td", "th", "p"},
    "option": {"option"},
    "body": {"head"},
}
#: Elements beyond which a start tag closes nothing.
FENCES = set("ul ol dl table body html div section article main td th button".split())
_CLOSED = {tag for tags in CLOSED_BY.values() for tag in tags}
#: A comment, a tag, another declaration, or what the end of the page cuts off.
_TAG = re.compile(
    r"""<!--(?:>|->|.*?--!?>|.*\Z)
    |<(/?)([a-zA-Z][^\s/>]*)((?:=\s*"[^"]*"|=\s*'[^']*'|[^>])*+)>
    |<[!?/][^>]*>
    |<[a-zA-Z/!?][^>]*+\Z""",
    re.S | re.X,
)
_NAMES = re.compile(r"""\b(class|id|role|aria-hidden|hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_WORDS = re.compile(r"[a-z]+")
_RIGHTS = re.compile(r"©|\(c\)\s*\d{4}|\ball rights reserved\b|\bcookies?\b.*\baccept\b", re.I)

#: Classifier weights (log odds of content) and smoothness weights.
OUTSIDE, INSIDE, IN_BOILER = -2.5, 3.0, -8.0
LONG, SENTENCE, SHORT, LINKS, RIGHTS, HEADING = 1.5, 0.5, -0.5, -3.0, -3.0, 1.0
NEXT, SIBLING, COUSIN = 0.4, 0.8, 0.3


class Element:
    """One element: its parent, depth, and what its name and attributes say of its role.

    What ancestors decide is handed down or up once, so that no depth of nesting costs more:
    ``block`` is the nearest block element, ``inside`` tells content around it, and ``costs`` fills
    in ``chars``, ``lead`` and ``bad`` (boilerplate around it, for plain text and for headings).
    """

    __slots__ = (
        "tag", "parent", "depth", "seen", "boiler_tag", "boiler_word", "content", "chars", "lead", "block", "inside", "bad"
    )

    def __init__(self, tag: str, parent: Element | None, attributes: str):
        self.tag, self.parent = tag, parent
        self.depth = parent.depth + 1 if parent else 0
        self.seen = (parent.seen if parent else True) and tag not in UNSEEN
        self.boiler_tag = tag in BOILER_TAGS
        self.boiler_word, self.content = False, tag in CONTENT_TAGS
        self.chars, self.lead = 0, False
        if attributes and not attributes.isspace():
            for name, value in _NAMES.findall(attributes):
                name, value = name.lower(), value.strip("\"'").lower()
                if name in ("class", "id", "role"):
                    words = set(_WORDS.findall(value))
                    self.boiler_word |= not words.isdisjoint(BOILER_WORDS)
                    self.content |= not words.isdisjoint(CONTENT_WORDS)
                elif name == "style":
                    self.seen &= re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value) is None
                else:
                    self.seen &= value == "false"
        if self.boiler_word:
            self.content = False
        self.block = self if tag in BLOCKS or not parent else parent.block
        self.inside = self.content or (parent is not None and parent.inside)
        self.bad = (False, False)


def blocks_of(html: str) -> list[tuple[Element, str, int]]:
    """The visible text blocks of a page in order: (element, text, characters inside links)."""
    return parsed(html)[0]


def parsed(html: str) -> tuple[list[tuple[Element, str, int]], list[Element]]:
    """The text blocks of a page, as ``blocks_of``, and all its elements, each after its parent."""
    here, blocks = Element("#page", None, ""), []
    elements = [here]
    pieces: list[str] = []
    linked, in_link = 0, 0
    owner = here
    # Open elements by name, and those that others close or that keep them from it.
    names: Counter = Counter()
    gates: list[Element] = []

    def flush() -> None:
        nonlocal linked, pieces
        text = " ".join("".join(pieces).split())
        if text:
            blocks.append((owner, text, linked))
        pieces, linked = [], 0

    def add(raw: str) -> None:
        nonlocal linked, owner
        if not raw or not here.seen:
            return
        if not pieces:
            owner = here.block
        text = unescape(raw) if "&" in raw else raw
        pieces.append(text)
        if in_link:
            linked += len(text.strip())

    def leave(to: Element) -> None:
        """Close all elements from the current one up to ``to``, with it."""
        nonlocal here
        while here is not to.parent:
            names[here.tag] -= 1
            if gates and gates[-1] is here:
                gates.pop()
            here = here.parent

    at, end = 0, len(html)
    while at < end:
        m = _TAG.search(html, at)
        if m is None:
            add(html[at:])
            break
        add(html[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag in BLOCKS:
                flush()
            if names[tag]:
                node = here
                while node.tag != tag:
                    node = node.parent
                leave(node)
                in_link -= tag == "a" and in_link > 0
            continue
        if tag in BLOCKS:
            flush()
            closes = CLOSED_BY.get(tag)
            if closes:
                last = None
                for node in reversed(gates):
                    if node.tag in closes:
                        last = node
                    elif node.tag in FENCES:
                        break
                if last is not None:
                    leave(last)
                    in_link = 0
        if tag == "br":
            if pieces:
                pieces.append(" ")
        elif tag not in VOID and not (m[3] or "").endswith("/"):
            here = Element(tag, here, m[3])
            elements.append(here)
            in_link += tag == "a"
            if tag in RAW:
                stop = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(html, at)
                if tag not in UNSEEN:
                    add(html[at : stop.start() if stop else end])
                here, at = here.parent, stop.end() if stop else end
                continue
            names[tag] += 1
            if tag in FENCES or tag in _CLOSED:
                gates.append(here)
    flush()
    return blocks, elements


def costs(blocks: list[tuple[Element, str, int]], elements: list[Element]) -> list[float]:
    """Log odds that each block is content: what its elements are called, its length and links."""
    total = 0
    for element, text, _ in blocks:
        total += len(text)
        element.chars += len(text)
        element.lead |= element.tag == "h1"
    for element in reversed(elements):
        if element.parent:
            element.parent.chars += element.chars
            element.parent.lead |= element.lead
    for element in elements:
        # A named element that holds the lead and most of the page is its frame, not a part of it.
        frame = (element.lead or element.content) and 2 * element.chars >= total
        named = element.boiler_word and not frame
        above = element.parent.bad if element.parent else (False, False)
        # The heading in an article's header is the article's.
        heads = element.tag == "header" and element.inside
        element.bad = (above[0] or named or element.boiler_tag, above[1] or named or (element.boiler_tag and not heads))
    framed = any(e.inside for e, _, _ in blocks)
    odds = []
    for element, text, linked in blocks:
        heading = element.tag in ("h1", "h2", "h3", "h4", "h5", "h6")
        score = IN_BOILER if element.bad[heading] else INSIDE if element.inside else OUTSIDE if framed else 0.0
        size = len(text)
        ended = text[-1] in ".!?\"'”»…:;"
        score += SHORT if size < 25 else LONG if ended and size >= 80 else SENTENCE if ended else 0.0
        if 2 * linked > size:
            score += LINKS
        if size < 300 and _RIGHTS.search(text):
            score += RIGHTS
        odds.append(score + (HEADING if heading else 0.0))
    return odds


def smoothness(blocks: list[tuple[Element, str, int]]) -> list[tuple[int, int, float]]:
    """Edges between blocks: each with the next, and with the next of the same parent, more firmly if
    both are the same kind of element."""
    edges, last = [], {}
    for i, (element, _, _) in enumerate(blocks):
        parent = element.parent or element
        if i:
            other = blocks[i - 1][0]
            a, b = element, other
            steps = 0
            while a is not b:
                if a.depth >= b.depth:
                    a = a.parent
                else:
                    b = b.parent
                steps += 1
            edges.append((i - 1, i, NEXT * 2.0 / max(2, steps)))
        if id(parent) in last:
            same = blocks[last[id(parent)]][0].tag == element.tag
            edges.append((last[id(parent)], i, SIBLING if same else COUSIN))
        last[id(parent)] = i
    return edges


def source_side(odds: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """The minimum cut: which blocks stay with the content terminal.

    Positive odds are capacities from the content terminal, negative ones to the boilerplate
    terminal; smoothness edges carry their weight both ways. Level graphs with blocking flows.
    """
    n, unit = len(odds), 1000
    source, sink = n, n + 1
    to: list[int] = []
    room: list[int] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def edge(a: int, b: int, there: int, back: int) -> None:
        out[a].append(len(to))
        out[b].append(len(to) + 1)
        to.extend((b, a))
        room.extend((there, back))

    for i, c in enumerate(odds):
        if c > 0:
            edge(source, i, round(c * unit), 0)
        elif c < 0:
            edge(i, sink, round(-c * unit), 0)
    for a, b, w in edges:
        edge(a, b, round(w * unit), round(w * unit))
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            v = queue.popleft()
            for e in out[v]:
                if room[e] and level[to[e]] < 0:
                    level[to[e]] = level[v] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [x >= 0 for x in level[:n]]
        turn, path, v = [0] * (n + 2), [], source
        while True:
            if v == sink:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                full = next(k for k, e in enumerate(path) if not room[e])
                path, v = path[:full], to[path[full] ^ 1]
                continue
            while turn[v] < len(out[v]):
                e = out[v][turn[v]]
                if room[e] and level[to[e]] == level[v] + 1:
                    break
                turn[v] += 1
            if turn[v] < len(out[v]):
                path.append(e)
                v = to[e]
            elif path:
                level[v] = -1
                v = to[path.pop() ^ 1]
            else:
                break


def main_text(html: str | None) -> str:
    """The text of the blocks on the content side, in page order, one a line."""
    blocks, elements = parsed(html or "")
    if not blocks:
        return ""
    kept = source_side(costs(blocks, elements), smoothness(blocks))
    return "\n".join(text for (_, text, _), keep in zip(blocks, kept) if keep)


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """Every row of ``pages`` without its html, with text (empty if there is none) and n_chars.

    Null and empty html give an empty text; repeated rows are treated alike; columns named text or
    n_chars are replaced. The whole page is read, whatever its length.
    """
    carried = [c for c in pages.columns if c not in (html, "text", "n_chars")]
    rows = pages.select(*carried, F.col(html).alias("__html"))
    schema = rows.select(*carried, F.lit("").alias("text"), F.lit(0).cast("long").alias("n_chars")).schema
    kind = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x.as_py()) for x in b.column("__html")]
            columns = [*(b.column(c) for c in carried), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, kind)], schema=kind)

    return rows.transform(in_arrow, run, schema)
