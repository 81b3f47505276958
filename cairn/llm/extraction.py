"""Main text of web pages by tag-path ratios.

A page becomes a run of text blocks, each with its path of tags from the root. A step of a path says too
whether its element is marked: a menu, advert, form and the like, by element or by a word in class, id or role.
Per path, text length, punctuation and link text are summed over its blocks and divided by their number. The
ratios are smoothed along the page and fused into one score with a prior weight: MARKED for each marked step,
BONUS for a path within article or main. Paths whose score reaches a share of the page's best are content, on
every page alike; a page that lies in a marked element as a whole loses nothing, as all its paths share that
weight. The answer is all blocks of content paths, and of the others those that stand beside content in one
section or between two blocks of it in one element below body, unless they are links for the greater part or
more strongly marked than that content.

Words of class, id and role don't mark an article or main element that holds at least half of the text of all
such elements, nor an element around it.

Defined cases: null or empty html gives an empty text; so does a page without any block of text. Tags that are
left open, stray end tags, unknown character references and broken quotes are read as browsers read them, more
or less. Elements may be nested to any depth, pages are read whole. Rows are independent, so repeated rows give
repeated results; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .encoding import small_batches

# Elements and the words in class, id or role that mark what isn't main text.
RAW = frozenset("script style noscript textarea iframe title".split())
HIDDEN = frozenset("template svg select button object".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
OUTSIDE = frozenset("nav footer aside form menu dialog head".split())
OUTSIDE_WORDS = frozenset(
    "ad ads adv advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies discussion disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice pager pagination popup promo readers related replies reply respond responses share sharing sidebar signup social sponsor sponsored subscribe toolbar widget alert complementary contentinfo search".split()
)
HEADER_WORDS = frozenset("header masthead".split())
#: A name with one of these says something of the element's state or surroundings (has-sidebar, comments-open).
STATE_WORDS = frozenset("has no with without open closed results".split())
MAIN = frozenset("article main".split())
#: Elements that lie within a section of text but make none of their own.
WITHIN_SECTION = frozenset("p h1 h2 h3 h4 h5 h6 hgroup ul ol li dl dt dd blockquote pre figure figcaption table caption thead tbody tfoot tr td th".split())

#: A path is content if its score is at least this share of the best path's.
SHARE = 0.15
#: What the score of a path within article or main is multiplied by, and that of a path for each marked step.
BONUS = 2.0
MARKED = 0.02
LINK_SHARE = 0.5

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?][^>]*>",
    re.S | re.I,
)
_RAW_ENDS = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I) for tag in RAW}
_MARKS = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PUNCTUATION = re.compile(r"[.,;:!?…。，；：！？、]")
_PARTS = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[A-Z])")


class Node:
    """An element. marks counts the marked elements from the root to here, path numbers its tag path; both are set by mark_nodes."""

    __slots__ = ("tag", "parent", "top", "section", "main", "by_tag", "by_word", "holds_main", "marks", "path")

    def __init__(self, tag: str, parent: "Node | None", attributes: str = ""):
        self.tag, self.parent = tag, parent
        # The element below body that holds this one, and the element whose text a block here is part of: the
        # nearest that isn't a paragraph, heading, list or table.
        self.top = parent.top if parent and parent.top else None if tag in ("", "html", "body") else self
        self.section = parent.section if parent and tag in WITHIN_SECTION else self
        # The nearest article or main element.
        self.main = self if tag in MAIN else parent.main if parent else None
        self.holds_main, self.marks, self.path = False, 0, 0
        words: set[str] = set()
        if attributes:
            for m in _MARKS.finditer(attributes):
                for name in (m[1] or m[2] or m[3] or "").lower().split():
                    parts = _PARTS.split(name)
                    if STATE_WORDS.isdisjoint(parts):
                        words.update(parts)
        outside_main = not (parent and parent.main)
        self.by_tag = tag in OUTSIDE - {"form"} or (tag == "header" and outside_main)
        self.by_word = tag == "form" or (tag not in ("body", "html") and bool(words & OUTSIDE_WORDS)) or (outside_main and bool(words & HEADER_WORDS))


def tokens_of(html: str) -> list[tuple[int, int, str, bool, str]]:
    """(start, end, tag or an empty text, whether it ends the tag, attributes) of each mark-up piece; raw text counts to its piece.

    HIDDEN elements with an end tag of their own are one piece. Those without one hide nothing.
    """
    out: list[tuple[int, int, str, bool, str]] = []
    closes: dict[int, int] = {}
    opened: dict[str, list[int]] = {}
    endless: set[str] = set()
    at = 0
    while m := _TOKEN.search(html, at):
        at = m.end()
        tag, ends, attributes = (m[2] or m[5] or "").lower(), bool(m[1] or m[4]), m[3] or m[6] or ""
        if tag in RAW and not ends:
            end = None if tag in endless else _RAW_ENDS[tag].search(html, at)
            if end:
                at = end.end()
            elif tag in ("script", "style"):
                at = len(html)
            else:
                endless.add(tag)
            tag = ""
        elif tag in HIDDEN:
            stack = opened.setdefault(tag, [])
            if ends:
                if stack:
                    closes[stack.pop()] = len(out)
            elif not (tag == "svg" and attributes.endswith("/")):
                if tag in ("button", "select"):
                    stack.clear()
                stack.append(len(out))
            tag = ""
        out.append((m.start(), at, tag, ends, attributes))
    if not closes:
        return out
    whole: list[tuple[int, int, str, bool, str]] = []
    k = 0
    while k < len(out):
        last = closes.get(k, k)
        whole.append((out[k][0], out[last][1], *out[k][2:]))
        k = last + 1
    return whole


def blocks_of(html: str) -> tuple[list[Node], list[tuple[Node, str, int]]]:
    """The elements, and (element, text, characters of link text) of each block of text, in page order."""
    root = Node("", None)
    node, stack, nodes = root, [root], [root]
    open_tags: Counter[str] = Counter()
    out: list[tuple[Node, str, int]] = []
    held: list[str] = []
    links, in_link = 0, 0

    def close_block() -> None:
        nonlocal links
        if held:
            text = " ".join(unescape("".join(held)).split())
            if text:
                out.append((node, text, links))
            held.clear()
        links = 0

    def add(text: str) -> None:
        nonlocal links
        held.append(text)
        if in_link:
            links += len(text)

    def pop() -> str:
        gone = stack.pop().tag
        open_tags[gone] -= 1
        return gone

    at = 0
    for start, end, tag, ends, attributes in tokens_of(html):
        if start > at:
            add(html[at:start])
        at = end
        if not tag:
            continue
        if tag in INLINE:
            if tag == "a":
                in_link = 0 if ends else 1
            continue
        if tag in VOID:
            if tag == "hr":
                close_block()
            else:
                held.append(" ")
            continue
        close_block()
        in_link = 0
        if ends:
            if open_tags[tag]:
                while pop() != tag:
                    pass
        else:
            if tag in CLOSES_P and stack[-1].tag == "p" or tag == stack[-1].tag and tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
                pop()
            stack.append(Node(tag, stack[-1], attributes))
            nodes.append(stack[-1])
            open_tags[tag] += 1
        node = stack[-1]
    if at < len(html):
        add(html[at:])
    close_block()
    return nodes, out


def mark_nodes(nodes: list[Node], blocks: list[tuple[Node, str, int]]) -> None:
    """Sets marks and path of nodes, parents before their children."""
    weight: Counter[Node] = Counter()
    for node, text, links in blocks:
        if node.main:
            weight[node.main] += max(len(text) - links, 0)
    total = sum(weight.values())
    for node in reversed(nodes):  # inner elements add to the outer ones
        if node.tag in MAIN and weight[node]:
            if 2 * weight[node] >= total:
                up: Node | None = node
                while up and not up.holds_main:
                    up.holds_main = True
                    up = up.parent
            if node.parent and node.parent.main:
                weight[node.parent.main] += weight[node]
    paths: dict[tuple[int, str, bool], int] = {}
    for node in nodes:
        marked = node.by_tag or (node.by_word and not node.holds_main)
        above = node.parent
        node.marks = (above.marks if above else 0) + marked
        node.path = paths.setdefault((above.path if above else 0, node.tag, marked), len(paths) + 1)


def path_scores(blocks: list[tuple[Node, str, int]]) -> dict[int, float]:
    """The fused score of each path: smoothed text ratio times smoothed punctuation ratio, less its links, with its prior weight."""
    sums: dict[int, list[float]] = {}
    for node, text, links in blocks:
        s = sums.setdefault(node.path, [0, 0, 0, 0])
        s[0] += 1
        s[1] += len(text)
        s[2] += len(_PUNCTUATION.findall(text))
        s[3] += min(links, len(text))
    rows = [sums[node.path] for node, _, _ in blocks]
    text_ratio, marks_ratio = [s[1] / s[0] for s in rows], [s[2] / s[0] for s in rows]

    def smooth(x: list[float]) -> list[float]:
        wide = [x[0], *x, x[-1]]
        return [(wide[i] + 2 * wide[i + 1] + wide[i + 2]) / 4 for i in range(len(x))]

    least = min(node.marks for node, _, _ in blocks)
    scores: dict[int, list[float]] = {}
    for (node, _, _), s, t, p in zip(blocks, rows, smooth(text_ratio), smooth(marks_ratio)):
        prior = MARKED ** (node.marks - least) * (BONUS if node.main else 1)
        scores.setdefault(node.path, []).append(t * (1 + p) * (1 - s[3] / max(s[1], 1)) * prior)
    return {k: sum(v) / len(v) for k, v in scores.items()}


def content_and_beside(blocks: list[tuple[Node, str, int]], passes: list[bool]) -> list[bool]:
    """Per block: it passes, or has few links and is in a section with a passing one, or between two that share a section or an element in the body."""
    with_content: dict[Node, int] = {}
    for (node, _, _), ok in zip(blocks, passes):
        if ok:
            with_content[node.section] = max(with_content.get(node.section, 0), node.marks)
    out = list(passes)
    last = -1
    for at in [i for i, ok in enumerate(passes) if ok] + [len(blocks)]:
        if at > last + 1:
            a, b = (blocks[last][0] if last >= 0 else None), (blocks[at][0] if at < len(blocks) else None)
            inner = bool(a and b) and (a.section is b.section or a.top is b.top is not None)
            for i in range(last + 1, at):
                node, text, links = blocks[i]
                near = max(a.marks, b.marks) if inner else -1
                out[i] = links <= LINK_SHARE * len(text) and node.marks <= max(near, with_content.get(node.section, -1))
        last = at
    return out


def main_blocks(html: str) -> list[str]:
    nodes, blocks = blocks_of(html)
    if not blocks:
        return []
    mark_nodes(nodes, blocks)
    scores = path_scores(blocks)
    floor = SHARE * max(scores.values())
    passes = [scores[node.path] >= floor for node, _, _ in blocks]
    return [text for (_, text, _), ok in zip(blocks, content_and_beside(blocks, passes)) if ok]


def main_text(html: str | None) -> str:
    return "\n".join(main_blocks(html)) if html else ""


def _rows(batches):
    for batch in small_batches(batches, "html", 8_000_000):
        texts = [main_text(x) for x in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text and n_chars for each row of pages."""
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    return rows.mapInArrow(_rows, "page_id long, url string, text string, n_chars long")
