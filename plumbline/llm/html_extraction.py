"""Main text of web pages by minimum-cut labelling.

A page is cut into blocks of text.  A linear classifier over a block's tags, names, links and length gives the cost of
calling it content or boilerplate; these costs are the capacities to the two terminals.  Neighbouring blocks, and
blocks close in the element tree, are joined by smoothness edges.  The minimum cut, found by maximum flow,
is the cheapest labelling: weak evidence follows its surroundings, strong evidence does not.

Each page is labelled on its own in one narrow pass; a page's graph has a few edges per block.

Defined cases: a null html is empty and gives an empty text; broken markup is read as browsers read it (unclosed paragraphs
end at the next block, stray ends are skipped); a block is text between block-level tags, a line break is white space; tables
are read cell by cell; repeated rows are extracted alike; an empty table gives an empty result; other columns pass unread.
"""

from __future__ import annotations

import math
import re
from collections import deque
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# Kinds of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike "
    "strong sub sup time tt u var wbr img br input picture source".split())
RAW = "script|style|title|textarea|iframe|noembed|noframes|xmp"
ENDS_PARAGRAPH = "p"
BAD_TAGS = frozenset("nav footer aside form button fieldset dialog menu select option noscript template svg object audio video canvas".split())
GOOD_TAGS = frozenset("article main".split())
BAD_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
BAD_NAMES = re.compile(
    r"(?:^|[-_\s])(?:nav|navbar|navigation|menu|menus|header|masthead|topbar|footer|foot|side|sidebar|aside|rail|ad|ads|adv|advert|adverts|"
    r"advertisement|banner|sponsor|sponsored|promo|promotion|cookie|cookies|consent|gdpr|notice|notices|alert|announcement|comment|comments|"
    r"commentlist|disqus|reply|replies|respond|discussion|related|recommended|share|sharing|social|subscribe|subscription|newsletter|signup|"
    r"breadcrumb|breadcrumbs|crumbs|pagination|pager|login|search|form|widget|popup|modal|overlay|toolbar|copyright|skip|tags|toc)(?:$|[-_\s\d])", re.I)
GOOD_NAMES = re.compile(r"(?:^|[-_\s])(?:article|content|main|post|entry|story|body|text|page)(?:$|[-_\s])", re.I)

TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<({RAW})\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)|"
    r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.I | re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)

# Weights of the classifier.  Positive speaks for content.
BAD_PLACE, GOOD_PLACE, LINKED, BASE, LONG, HEADING, LIST_ITEM = -9.0, 3.0, -4.0, -0.5, 0.8, 0.6, -0.4
ADJACENT, SAME_PARENT, NEAR_PARENT = 0.8, 0.8, 0.3


class Block:
    __slots__ = ("text", "linked", "bad", "good", "tag", "parent", "grand")

    def __init__(self, text: str, linked: int, bad: bool, good: bool, tag: str, parent: int, grand: int):
        self.text, self.linked, self.bad, self.good, self.tag, self.parent, self.grand = text, linked, bad, good, tag, parent, grand


def _place(tag: str, attributes: str, in_good: bool) -> tuple[bool, bool]:
    """Whether an element speaks against or for its text."""
    bad, good = tag in BAD_TAGS, tag in GOOD_TAGS
    if tag == "header" and not in_good:
        bad = True
    if attributes:
        for name, a, b, c in ATTRIBUTE.findall(attributes):
            name, value = name.lower(), a or b or c
            if name in ("class", "id"):
                bad |= tag not in ("body", "html", "article", "main") and bool(BAD_NAMES.search(value))
                good |= bool(GOOD_NAMES.search(value))
            elif name == "role":
                bad |= value.lower() in BAD_ROLES
                good |= value.lower() in ("main", "article")
            elif name == "hidden" or (name == "aria-hidden" and value == "true"):
                bad = True
            elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                bad = True
    return bad, good


def page_blocks(html: str) -> list[Block]:
    """Blocks of text in page order, with what their places say."""
    found: list[Block] = []
    # Open elements: tag, bad place, good place, number.
    stack: list[tuple[str, bool, bool, int]] = [("", False, False, 0)]
    number, parts, linked, links = 0, [], 0, 0

    def close() -> None:
        nonlocal linked
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                place = len(stack) - 1
                while place and stack[place][0] in INLINE:
                    place -= 1
                tag, bad, good, own = stack[place]
                parent = stack[place - 1][3] if place else 0
                grand = stack[place - 2][3] if place > 1 else 0
                found.append(Block(text, linked, stack[-1][1], good, tag, parent if tag in ("p", "li", "td", "h1", "h2", "h3", "h4", "h5", "h6") else own, grand))
            parts.clear()
        linked = 0

    at = 0
    for match in TOKEN.finditer(html):
        if match.start() > at:
            piece = html[at:match.start()]
            parts.append(piece)
            if links:
                linked += len(piece.strip())
        at = match.end()
        raw, end, tag, attributes = match.groups()
        if tag is None:
            if match[0].startswith("<![CDATA["):
                parts.append(match[0][9:-3])
            elif raw:
                close()
            continue
        tag = tag.lower()
        if tag in INLINE:
            if tag == "br":
                parts.append(" ")
            elif tag == "a":
                links = 0 if end else 1
            elif tag not in VOID:
                if end:
                    if stack[-1][0] == tag:
                        stack.pop()
                elif attributes.strip():
                    bad, _ = _place(tag, attributes, stack[-1][2])
                    number += 1
                    stack.append((tag, stack[-1][1] or bad, stack[-1][2], number))
            continue
        close()
        if end:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
            continue
        if tag in VOID or attributes.rstrip().endswith("/") and tag not in ("p", "div"):
            continue
        # A block ends open inline elements and an open paragraph; an item ends the item before it.
        while len(stack) > 1 and (stack[-1][0] in INLINE or stack[-1][0] == ENDS_PARAGRAPH or tag == stack[-1][0] in ("li", "dt", "dd", "tr", "td", "option")):
            stack.pop()
        bad, good = _place(tag, attributes, stack[-1][2])
        number += 1
        stack.append((tag, stack[-1][1] or bad, stack[-1][2] or good, number))
        links = 0
    if at < len(html):
        parts.append(html[at:])
    close()
    return found


def evidence(block: Block) -> float:
    """Log odds that a block is content."""
    words = block.text.count(" ") + 1
    score = BASE + LONG * math.log(1 + words / 4)
    if block.bad:
        score += BAD_PLACE
    if block.good:
        score += GOOD_PLACE
    score += LINKED * min(1.0, block.linked / len(block.text))
    if block.tag in ("h1", "h2", "h3"):
        score += HEADING
    elif block.tag == "li":
        score += LIST_ITEM
    return score


def minimum_cut(to_content: list[float], to_boilerplate: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Sides of the minimum cut: True where a node stays with the content terminal.

    Blocking flows over breadth-first levels.  What both terminals would give the same node flows through it at once.
    """
    n = len(to_content)
    source, sink = n, n + 1
    heads: list[list[int]] = [[] for _ in range(n + 2)]
    target: list[int] = []
    room: list[float] = []

    def join(a: int, b: int, forward: float, back: float) -> None:
        heads[a].append(len(target))
        heads[b].append(len(target) + 1)
        target.extend((b, a))
        room.extend((forward, back))

    for i, (a, b) in enumerate(zip(to_content, to_boilerplate, strict=True)):
        if a > b:
            join(source, i, a - b, 0.0)
        elif b > a:
            join(i, sink, b - a, 0.0)
    for a, b, weight in edges:
        join(a, b, weight, weight)
    tiny = 1e-12
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in heads[a]:
                if room[e] > tiny and level[target[e]] < 0:
                    level[target[e]] = level[a] + 1
                    queue.append(target[e])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        following = [0] * (n + 2)
        path: list[int] = []
        a = source
        while True:
            if a == sink:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                first = next(i for i, e in enumerate(path) if room[e] <= tiny)
                a = target[path[first] ^ 1]
                del path[first:]
                continue
            while following[a] < len(heads[a]):
                e = heads[a][following[a]]
                if room[e] > tiny and level[target[e]] == level[a] + 1:
                    break
                following[a] += 1
            else:
                if a == source:
                    break
                level[a] = -1
                e = path.pop()
                a = target[e ^ 1]
                continue
            path.append(e)
            a = target[e]


def main_text(html: str | None) -> str:
    blocks = page_blocks(html or "")
    if not blocks:
        return ""
    odds = [evidence(b) for b in blocks]
    # Costs are negative log likelihoods: a node cut from content pays what calling it boilerplate costs.
    content = [math.log1p(math.exp(min(z, 30.0))) for z in odds]
    boilerplate = [math.log1p(math.exp(min(-z, 30.0))) for z in odds]
    edges = []
    last: dict[int, int] = {}
    for i, block in enumerate(blocks):
        if i:
            before = blocks[i - 1]
            near = SAME_PARENT if before.parent == block.parent else NEAR_PARENT if before.grand == block.grand else 0.0
            edges.append((i - 1, i, (ADJACENT if before.bad == block.bad else ADJACENT / 4) + near))
        j = last.get(block.parent)
        if j is not None and j < i - 1:
            edges.append((j, i, SAME_PARENT))
        last[block.parent] = i
    kept = minimum_cut(content, boilerplate, edges)
    return "\n".join(b.text for b, keep in zip(blocks, kept, strict=True) if keep)


def extract_main_text(pages: DataFrame) -> DataFrame:
    """``pages`` with ``text`` and ``n_chars`` in place of ``html``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) for h in batch["html"].to_pylist()]
            place = batch.schema.get_field_index("html")
            rest = [c for i, c in enumerate(batch.columns) if i != place]
            names = [c for i, c in enumerate(batch.schema.names) if i != place]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                             names=[*names, "text", "n_chars"])

    plain = pages.drop("text", "n_chars")
    return plain.mapInArrow(run, plain.drop("html").schema.add("text", "string").add("n_chars", "long"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
