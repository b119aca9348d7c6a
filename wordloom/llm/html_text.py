"""Main text of web pages by tag-path ratios.

A page is read into text nodes, each with the path of tags from the root to it. For each path the text length (link
text not counted) and the punctuation of its nodes are added up and divided by the nodes. Each ratio is smoothed over
the nodes in page order, and both are fused with what they were before into one score. Two features weigh on it: paths
that lead through article or main tags count more, and nodes that a class or id calls an advert, a comment and the like
count less, and have a path of their own. The paths whose mean score reaches a part of the page's are the content.
Where one element below body holds most of what they select, the rest of that element is content too: short headings
and list items, and inside an article or main also blocks of links.

Elements that are no text of an article by the meaning of their tag or role (menus, forms, footers, headers outside
articles, scripts, what is hidden) are left out from the start.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from wordloom.llm.common import slices

NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
#: In a tag: its end, or a quoted value.
MARK = re.compile(r"=\s*[\"']|>")
#: One attribute, its value consumed whole, so that nothing inside a name or value is taken for another one.
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes template noscript svg annotation annotation-xml select button object audio video canvas".split())
DROPPED = frozenset("head nav footer header aside form dialog menu".split()) | RAW
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img"
    " math semantics mrow mi mo mn ms mtext mspace msup msub msubsup mfrac msqrt mroot mover munder munderover mstyle mpadded mphantom".split()
)
#: What may stand in a head; any other start tag ends it.
HEAD = frozenset("head html base basefont bgsound link meta noframes noscript script style template title".split())
#: A start tag that ends an open element: the new tag, what it ends.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Names of classes and ids, whole: what an element is, with a word of place or audience before it and words of layout after it.
HINT = re.compile(
    r"(?:(?:main|top|bottom|left|right|site|page|global|primary|secondary|header|body|user|reader|visitor|post|article|blog|social|cookie|mobile|desktop|inline|sticky|floating|google|sub|mega|wp|fb|js)[_-])*"
    r"(?:ads?|adverts?|advertisement|sponsor(?:ed)?|promo(?:tion)?|banner|cookies?|consent|gdpr|popup|modal|overlay|newsletter|subscribe|signup|sidebar|nav|navbar|navigation|menu"
    r"|breadcrumbs?|pagination|pager|footer|masthead|topbar|toolbar|share|sharing|related|recommended|comments?|replies|respond|disqus|widget|notices?|alert)"
    r"(?:[_-](?:box|bar|list|area|section|container|wrapper|wrap|holder|block|panel|unit|slot|strip|row|top|bottom|left|right|inner|main|item|content|form|body|text|title|header|thread|posts?|articles?|links?|news|stories|message|policy|buttons?|notice|banner|menu|\d+))*"
    r"|site-header|page-header|skip-\w+(?:-\w+)*|comment-\w+|advert\w*|adsby\w+|ad-?\d+",
    re.I,
)
REMARK = re.compile(r"comment|repl|related|promo|\bads?\b", re.I)
ROOT = frozenset(("", "html", "body"))
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
PUNCTUATION = re.compile(r"[.,;:!?…。，！？¿¡]")
#: Weights of the nodes around a node; the part of the text-weighted mean score that a content path must reach; the part of the selected text that one element must hold.
SMOOTHING, THRESHOLD, HOLDS = (1, 2, 3, 2, 1), 0.4, 0.8
#: What article and main tags, and names that hint at other things, multiply a score by.
MARKED, HINTED = 3.0, 0.1

OUT = T.StructType(
    [T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]
)


@dataclass
class Node:
    block: int
    element: int
    text: str
    in_link: bool


@dataclass
class Tree:
    """Text nodes in page order. Of each element: its parent, path (parent's path and tag, by number), whether article or main tags lead to it, and the outermost element with a hint that holds it, or -1."""

    nodes: list[Node] = field(default_factory=list)
    parent: list[int] = field(default_factory=lambda: [-1])
    path: list[int] = field(default_factory=lambda: [0])
    tag: list[str] = field(default_factory=lambda: [""])
    marked: list[bool] = field(default_factory=lambda: [False])
    hinted: list[int] = field(default_factory=lambda: [-1])
    paths: dict[tuple[int, str], int] = field(default_factory=dict)

    def add(self, parent: int, tag: str, hint: bool) -> int:
        number = len(self.parent)
        self.parent.append(parent)
        self.tag.append(tag)
        self.path.append(self.paths.setdefault((self.path[parent], tag), len(self.paths) + 1))
        self.marked.append(self.marked[parent] or tag in ("article", "main"))
        self.hinted.append(self.hinted[parent] if self.hinted[parent] >= 0 or not hint else number)
        return number


def _judge(tag: str, attributes: str) -> tuple[bool, bool]:
    """Whether an element is no text of an article for certain, and whether its names hint at that."""
    if tag in DROPPED:
        return True, False
    hint = False
    if attributes and tag not in ("html", "body", "main"):
        for name, *values in ATTRIBUTE.findall(attributes):
            name, value = name.lower(), next(filter(None, values), "")
            if name == "role" and value.strip().lower() in ROLES or name == "hidden" or name == "aria-hidden" and value.lower() == "true":
                return True, False
            if name == "style" and re.search(r"display\s*:\s*none", value, re.I):
                return True, False
            if name in ("class", "id") and any(map(HINT.fullmatch, value.split())) and (tag not in ("article", "section") or REMARK.search(value)):
                hint = True
    return False, hint


def tokens(page: str) -> Iterator[tuple[str, str | None, str, bool]]:
    """(text, None, "", False) or (tag's source, its name, its attributes, whether it is an end tag); comments, declarations and the insides of RAW elements are left out.

    Every place is looked at a bounded number of times: a tag that never ends is text, and so is all after it.
    """
    at, size, last, lower = 0, len(page), page.rfind(">"), None
    closed = {q: page.rfind(q) for q in "\"'"}
    while at < size:
        start = page.find("<", at)
        if start < 0 or start > last:
            yield page[at:], None, "", False
            return
        if start > at:
            yield page[at:start], None, "", False
        if page.startswith(("<!-->", "<!--->"), start):  # comments that end where they begin
            at = page.find(">", start) + 1
            continue
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = size if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), start):
            at = page.find(">", start) + 1
            continue
        name = NAME.match(page, start)
        if name is None:
            yield "<", None, "", False
            at = start + 1
            continue
        at = name.end()
        while (m := MARK.search(page, at)) and m[0] != ">":
            quote = m[0][-1]
            at = page.find(quote, m.end()) + 1 if closed[quote] >= m.end() else m.end()
        end = m.start() if m else page.find(">", name.end())
        tag = name[1].lower()
        yield page[start : end + 1], tag, page[name.end() : end], page[start + 1] == "/"
        at = end + 1
        if tag in RAW and page[start + 1] != "/":
            lower = lower or page.lower()
            if len(lower) != size:  # lower case that is longer than the letter would shift all places
                lower = "".join(c.lower() if len(c.lower()) == 1 else c for c in page)
            at = lower.find(f"</{tag}", at)
            at = size if at < 0 else page.find(">", at) + 1 or size


def tree_of(page: str) -> Tree:
    tree = Tree()
    stack: list[tuple[str, int, bool]] = [("", 0, False)]  # tag, element, whether it or what holds it is left out
    opened: dict[str, int] = {}
    block = 0

    def pop() -> None:
        opened[stack.pop()[0]] -= 1

    for source, tag, attributes, closing in tokens(page):
        if opened.get("head") and (source.strip() if tag is None else not closing and tag not in HEAD):
            while opened["head"]:
                pop()
        _, element, out = stack[-1]
        if tag is None:
            if not out:
                tree.nodes.append(Node(block, element, html.unescape(source), opened.get("a", 0) > 0))
            continue
        inline = tag in INLINE
        if not inline:
            block += 1
        elif tag == "br" and tree.nodes:
            tree.nodes.append(Node(block, tree.nodes[-1].element, " ", False))
        if closing:
            if opened.get(tag):
                while stack[-1][0] != tag:
                    pop()
                pop()
            continue
        if tag in VOID or tag in RAW or attributes.endswith("/") and inline:
            continue
        if not inline:
            ended = ENDS.get(tag, set()) | {"p"}
            while len(stack) > 1 and (stack[-1][0] in ended or stack[-1][0] in INLINE and any(opened.get(t) for t in ended)):
                pop()
        gone, hint = _judge(tag, attributes)
        gone = gone and not (tag == "header" and opened.get("article"))  # an article's own heading
        element = tree.add(stack[-1][1], tag, hint)
        opened[tag] = opened.get(tag, 0) + 1
        stack.append((tag, element, stack[-1][2] or gone))
    return tree


def path_scores(tree: Tree, told: list[Node]) -> tuple[np.ndarray, np.ndarray]:
    """Of each node: the mean fused score of its path, and the length of its text."""
    hinted = np.array([tree.hinted[n.element] >= 0 for n in told])
    path = np.unique([2 * tree.path[n.element] for n in told] + hinted, return_inverse=True)[1]
    sizes = np.array([len(n.text.strip()) for n in told], float)
    plain = np.array([0 if n.in_link else s for n, s in zip(told, sizes.tolist(), strict=True)], float)
    points = np.array([0 if n.in_link else len(PUNCTUATION.findall(n.text)) for n in told], float)
    number = np.bincount(path)
    ratios = [(np.bincount(path, x) / number)[path] for x in (plain, points)]
    weights = np.array(SMOOTHING, float)
    middle = len(weights) // 2
    around = lambda x: np.convolve(x, weights, "full")[middle : middle + len(x)]
    smooth = [around(x) / around(np.ones(len(x))) for x in ratios]
    fused = (ratios[0] * (1 + ratios[1]) * smooth[0] * (1 + smooth[1])) ** 0.5
    fused *= np.where([tree.marked[n.element] for n in told], MARKED, 1.0) * np.where(hinted, HINTED, 1.0)
    return (np.bincount(path, fused) / number)[path], sizes


def holder(tree: Tree, nodes: list[Node], chosen: list[Node]) -> int:
    """The innermost element that holds HOLDS of the chosen text and, where one below body does, more than one block of the page."""
    held = np.zeros(len(tree.parent))
    for n in chosen:
        held[n.element] += len(n.text.strip())
    first, last = np.full(len(held), np.inf), np.full(len(held), -1.0)
    for n in nodes:
        first[n.element], last[n.element] = min(first[n.element], n.block), max(last[n.element], n.block)
    for e in range(len(held) - 1, 0, -1):  # parents come before their children
        up = tree.parent[e]
        held[up] += held[e]
        first[up], last[up] = min(first[up], first[e]), max(last[up], last[e])
    top = int(np.flatnonzero(held >= HOLDS * held[0])[-1])
    while top and first[top] == last[top] and tree.tag[tree.parent[top]] not in ROOT:
        top = tree.parent[top]
    return top


def content_of(tree: Tree, threshold: float = THRESHOLD) -> list[Node]:
    """The nodes of the article."""
    nodes = tree.nodes
    told = [n for n in nodes if n.text.strip()]
    if not told:
        return []
    score, sizes = path_scores(tree, told)
    chosen = score >= threshold * float((score * sizes).sum() / sizes.sum())
    plain = {n.block for n in told if not n.in_link}  # blocks that are not links alone
    blocks = {n.block for n, c in zip(told, chosen.tolist(), strict=True) if c} & (plain or {n.block for n in told})
    top = holder(tree, told, [n for n, c in zip(told, chosen.tolist(), strict=True) if c])
    if tree.tag[top] not in ROOT:
        inside = [False] * len(tree.parent)
        inside[top] = True
        for e in range(top + 1, len(inside)):
            inside[e] = inside[tree.parent[e]]
        linked: dict[int, list[float]] = {}
        for n, size in zip(told, sizes.tolist(), strict=True):
            if inside[n.element] and tree.hinted[n.element] == tree.hinted[top]:
                sums = linked.setdefault(n.block, [0, 0])
                sums[n.in_link] += size
        blocks |= {b for b, (plain, links) in linked.items() if plain >= links or tree.marked[top]}
    return [n for n in nodes if n.block in blocks]


def main_text(page: str | None, threshold: float = THRESHOLD) -> str:
    """The article's blocks in page order with an empty line between them; "" if the page has none."""
    if not page:
        return ""
    blocks: dict[int, list[str]] = {}
    for n in content_of(tree_of(page), threshold):
        blocks.setdefault(n.block, []).append(n.text)
    return "\n\n".join(filter(None, (" ".join("".join(parts).split()) for parts in blocks.values())))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row of pages (page_id, url, html).

    One output row for each input row, repeated rows and null ids or urls included. Null or empty html, and pages
    without text, give "" and 0. An empty table gives no rows; further columns are ignored. A page of any length
    is read whole.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            texts = [main_text(h) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id").cast(pa.int64()), batch.column("url").cast(pa.string()), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=OUT.names,
            )

    return pages.select("page_id", "url", "html").mapInArrow(run, OUT)
