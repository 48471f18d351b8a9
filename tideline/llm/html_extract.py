"""Main text of web pages as a maximum-scoring run of words and tags."""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import as_bytes

#: A comment, a declaration or processing instruction, the name of a tag, and what ends a tag or begins a quoted value in it.
COMMENT, DECLARED = re.compile(r"<!--.*?(?:-->|\Z)", re.S), re.compile(r"<[!?][^>]*(?:>|\Z)")
NAME, SPECIAL = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)"), re.compile(r"[>\"']")
#: Fixed values of HTML: elements whose content is no markup.
RAW = frozenset("script style noscript template iframe svg textarea select title".split())
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
SPACE = re.compile(r"[ \t\n\r\f\v]+")

#: Fixed values of HTML: elements without content, elements that end a block, elements that an opening block closes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
SECTION = frozenset("article aside body div footer form header html li main nav ol section table td th tr ul dl dd dt blockquote figure details".split())
MAIN = frozenset(("tag:article", "tag:main"))
#: Elements that say nothing about what they hold, whatever the sample's pages use them for.
NEUTRAL = frozenset(f"tag:{t}" for t in "html body div section span center font table tbody tr td".split())
#: Prior knowledge of page parts that are never main text: elements and words in class, id or role.
ASIDE_TAGS = frozenset("nav header footer aside form button menu dialog search fieldset".split())
ASIDE_WORDS = frozenset(
    "ad ads advert advertisement advertisements banner promo sponsor sponsored cookie cookies consent notice alert gdpr modal popup overlay "
    "sidebar side aside nav navbar navigation menu breadcrumb breadcrumbs header footer masthead comment comments reply replies discussion "
    "disqus respond share sharing social related recommended newsletter subscribe subscription signup login form search widget pagination "
    "pager toolbar copyright legal complementary contentinfo".split()
)
#: In words: what the prior knowledge counts for, and what draws rare features to no evidence.
PRIOR, SMOOTHING = 50.0, 20.0
#: A word that nothing is known about, and the limits of the evidence of one container, of the elements of running text together and of a word.
PLAIN, CONTAINER, RUNNING, LEAST, MOST = 0.3, 4.0, 0.5, -3.0, 2.0
#: Limits of the cost of a tag.
COSTS = (0.05, 0.5)


class Node:
    """An open element as text sees it: its features and those of the elements around it, which are its parents.

    Elements of equal features in one parent are one node. ``new`` are the features that no parent
    has; ``main`` and ``apart`` say whether it is, or stands in, a marked article and a part known to be none.
    """

    __slots__ = ("parent", "own", "new", "main", "apart", "place", "children")

    def __init__(self, parent: Node | None, own: tuple[str, ...], new: tuple[str, ...], place: int):
        self.parent, self.own, self.new, self.place = parent, own, new, place
        self.main = (parent is not None and parent.main) or any(f in MAIN for f in own)
        self.apart = (parent is not None and parent.apart) or any(map(aside, own))
        self.children: dict[tuple[str, ...], Node] = {}


class Piece(NamedTuple):
    """A run of text, or a tag: the node that it stands in and its block number."""

    words: str
    tag: str
    node: Node
    block: int


@dataclass
class Weights:
    """Log-odds of content for each element feature, and the cost of each tag."""

    feature: dict[str, float] = field(default_factory=dict)
    tag: dict[str, float] = field(default_factory=dict)


def features(tag: str, rest: str) -> tuple[str, ...]:
    out = [f"tag:{tag}"]
    for m in ATTRIBUTE.finditer(rest):
        out += [f"part:{w}" for w in re.split(r"[^a-z0-9]+", (m[2] or m[3] or m[4] or "").lower()) if w]
    return tuple(out)


class Tags:
    """Finds where the tags of a page end: at the first > outside quotes, or with the page.

    A tag in which a quote stays open is none, and its < is text. Where a search outside quotes
    leads depends only on the quote that it meets first, so that quotes that led to an open one
    are remembered; all searches on a page take time in proportion to its length.
    """

    def __init__(self, page: str):
        self.page, self.low, self.at = page, 0, -1
        self.open: set[int] = set()

    def end(self, p: int) -> int | None:
        met = []
        while True:
            if not self.low <= p <= self.at:
                m = SPECIAL.search(self.page, p)
                self.low, self.at = p, m.start() if m else len(self.page)
            j = self.at
            if j == len(self.page):
                return j
            if self.page[j] == ">":
                return j + 1
            close = -1 if j in self.open else self.page.find(self.page[j], j + 1)
            met.append(j)
            if close < 0:
                self.open.update(met)
                return None
            p = close + 1


def tokens(page: str) -> Iterator[tuple[str, str, bool, str]]:
    """Text, and the name of each tag, whether it closes, and its attributes; comments, declarations and raw elements leave nothing."""
    tags, at, n, ended = Tags(page), 0, len(page), page.rfind(">")
    while at < n:
        if page[at] != "<":
            end = page.find("<", at)
            end = n if end < 0 else end
            yield page[at:end], "", False, ""
            at = end
            continue
        if page.startswith(("<!", "<?"), at):
            at = (COMMENT.match(page, at) or DECLARED.match(page, at)).end()
            continue
        m = NAME.match(page, at)
        name = m[2].lower() if m else ""
        if name in RAW and not m[1] and ended > at:
            close = re.compile(rf"</{name}\s*>", re.I).search(page, page.index(">", at) + 1)
            at = close.end() if close else n
            continue
        end = tags.end(m.end()) if m else None
        if end is None:
            yield "<", "", False, ""
            at += 1
        else:
            yield "", name, bool(m[1]), page[m.end() : end].removesuffix(">")
            at = end


class Open:
    """The open elements, and where each kind of them stands, so that no search goes through all of them."""

    def __init__(self) -> None:
        self.root = Node(None, (), (), 0)
        self.nodes = [self.root]
        self.stack: list[tuple[str, Node]] = []
        self.places: dict[str, list[int]] = {}
        self.sections: list[int] = []
        self.count: Counter = Counter()

    def node(self) -> Node:
        return self.stack[-1][1] if self.stack else self.root

    def last(self, tag: str) -> int:
        found = self.places.get(tag)
        return found[-1] if found else -1

    def push(self, tag: str, own: tuple[str, ...]) -> None:
        parent = self.node()
        node = parent.children.get(own)
        if node is None:
            node = Node(parent, own, tuple(f for f in dict.fromkeys(own) if not self.count[f]), len(self.nodes))
            parent.children[own] = node
            self.nodes.append(node)
        self.places.setdefault(tag, []).append(len(self.stack))
        if tag in SECTION:
            self.sections.append(len(self.stack))
        self.count.update(own)
        self.stack.append((tag, node))

    def cut(self, depth: int) -> None:
        """The element at this depth ends, with all that are open in it."""
        while len(self.stack) > depth:
            tag, node = self.stack.pop()
            self.places[tag].pop()
            if tag in SECTION:
                self.sections.pop()
            self.count.subtract(node.own)

    def close(self, tag: str) -> None:
        """The last open element of this name ends; one that is no section ends only within its section."""
        depth = self.last(tag)
        if depth >= 0 and (tag in SECTION or not self.sections or depth > self.sections[-1]):
            self.cut(depth)

    def end_paragraph(self) -> None:
        """A paragraph, with what is open in it, ends where a block begins."""
        depth = self.last("p")
        if depth >= 0 and (not self.sections or depth > self.sections[-1]):
            self.cut(depth)


def pieces(page: str) -> tuple[list[Piece], list[Node]]:
    """Words and tags of a page in order, and its nodes, parents first. Unclosed elements end with their parent."""
    out: list[Piece] = []
    held = Open()
    block = 0
    for words, tag, closes, rest in tokens(page):
        if not tag:
            out.append(Piece(words, "", held.node(), block))
            continue
        if tag in BLOCK:
            block += 1
        if closes:
            held.close(tag)
        elif tag not in VOID and not rest.rstrip().endswith("/"):
            if tag in BLOCK:
                held.end_paragraph()
            held.push(tag, features(tag, rest))
        out.append(Piece("", tag, held.node(), block))
    return out, held.nodes


def summed(nodes: list[Node], own: list[int]) -> list[int]:
    """What each node and all within it hold."""
    total = list(own)
    for node in reversed(nodes[1:]):
        total[node.parent.place] += total[node.place]
    return total


def evidence(parsed: list[Piece], nodes: list[Node]) -> Counter:
    """Words and tags of a labelled page inside and outside its marked article, by feature; nothing of unlabelled pages.

    A page is labelled if it marks its article. Text in parts that are known to be no main
    text counts as outside wherever they stand. Words count once for each feature around them.
    """
    out: Counter = Counter()
    if not any(node.main for node in nodes):
        return out
    held = {True: [0] * len(nodes), False: [0] * len(nodes)}
    for p in parsed:
        inside = p.node.main and not p.node.apart
        if p.tag:
            out["cost:" + p.tag, inside] += 1
        elif n := len(p.words.split()):
            out["words", inside] += n
            held[inside][p.node.place] += n
    for inside, own in held.items():
        for node, n in zip(nodes, summed(nodes, own), strict=True):
            for f in node.new if n else ():
                out[f, inside] += n
    return out


def aside(feature: str) -> bool:
    kind, _, name = feature.partition(":")
    return name in (ASIDE_TAGS if kind == "tag" else ASIDE_WORDS)


def learn(counts: dict[tuple[str, bool], int]) -> Weights:
    """Log-odds from counts, ``SMOOTHING`` words of no evidence added; known parts start with ``PRIOR`` words outside, the marked article with as many inside."""
    out = Weights()
    inside, outside = counts.get(("words", True), 0) + PRIOR, counts.get(("words", False), 0) + PRIOR
    names = {f for f, _ in counts if f != "words"} | {f"tag:{t}" for t in ASIDE_TAGS} | {f"part:{w}" for w in ASIDE_WORDS} | MAIN
    for f in names:
        a, b = counts.get((f, True), 0), counts.get((f, False), 0)
        if f.startswith("cost:"):
            out.tag[f[5:]] = limited(math.log((b + 1) / (a + 1)) + 0.5, *COSTS)
        else:
            a, b = a + PRIOR * (f in MAIN) + SMOOTHING * inside / (inside + outside), b + PRIOR * aside(f) + SMOOTHING * outside / (inside + outside)
            out.feature[f] = math.log(a / inside) - math.log(b / outside)
    return out


def limited(x: float, low: float, high: float) -> float:
    return min(max(x, low), high)


def word_weights(nodes: list[Node], w: Weights, silent: frozenset[Node] = frozenset()) -> tuple[list[float], list[float]]:
    """For the words of each node their weight in the scan, and that of their containers alone, which decides whether they stay.

    The log-odds of a container's features are summed; each container counts half as much as the
    one in it. Elements of running text (paragraphs, lists, links) count little and only in the
    scan, so that lists and links stay in an article. ``silent`` containers count nothing. A node's weight
    follows from its parent's.
    """
    containers, running = [0.0] * len(nodes), [0.0] * len(nodes)
    for node in nodes[1:]:
        own = [f for f in node.own if f.startswith("part:") or f in MAIN or aside(f)]
        around = node.parent.place
        running[node.place] = running[around] + sum(w.feature.get(f, 0.0) for f in node.own if f not in own and f not in NEUTRAL)
        odds = limited(sum(w.feature.get(f, 0.0) for f in own), -CONTAINER, CONTAINER)
        containers[node.place] = odds + containers[around] / 2 if odds and node not in silent else containers[around]
    keeps = [PLAIN + c for c in containers]
    return [limited(k + limited(r, -RUNNING, RUNNING), LEAST, MOST) for k, r in zip(keeps, running, strict=True)], keeps


def best_run(scores: list[float]) -> tuple[int, int]:
    """Bounds of the contiguous run with the largest sum, by one scan; the first of equals, empty if none is positive."""
    best, bounds, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, bounds = total, (start, i + 1)
    return bounds


def extract(page: str, w: Weights) -> str:
    """Main text: the best run without the parts in it whose containers speak against it.

    Where nothing on a page scores positive, containers that hold more than half of its words can
    be no asides, and are left out of account.
    """
    parsed, nodes = pieces(page)
    n = [0 if p.tag else len(p.words.split()) for p in parsed]
    a, b, keeps = scanned(parsed, nodes, n, w, frozenset())
    if a == b:
        own = [0] * len(nodes)
        for p, k in zip(parsed, n, strict=True):
            own[p.node.place] += k
        half = sum(n) / 2
        a, b, keeps = scanned(parsed, nodes, n, w, frozenset(node for node, k in zip(nodes[1:], summed(nodes, own)[1:], strict=True) if k > half))
    blocks: dict[int, list[str]] = {}
    for p in parsed[a:b]:
        if p.tag == "br":
            blocks.setdefault(p.block, []).append(" ")
        elif not p.tag and keeps[p.node.place] > 0:
            blocks.setdefault(p.block, []).append(html.unescape(p.words))
    texts = (SPACE.sub(" ", "".join(x)).strip(" ") for x in blocks.values())
    return "\n\n".join(t for t in texts if t)


def scanned(parsed: list[Piece], nodes: list[Node], n: list[int], w: Weights, silent: frozenset[Node]) -> tuple[int, int, list[float]]:
    """Bounds of the best run, and by node whether its words stay (above 0)."""
    weights, keeps = word_weights(nodes, w, silent)
    scores = []
    for p, k in zip(parsed, n, strict=True):
        if p.tag:
            scores.append(-w.tag.get(p.tag, 0.5))
        else:
            scores.append(weights[p.node.place] * k)
    return *best_run(scores), keeps


def train(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", fit_pages: int = 2000) -> Weights:
    """Weights from the ``fit_pages`` pages with the smallest id hash; pages that mark their article are the labelled ones."""

    def run(batches):
        for b in batches:
            seen: Counter = Counter()
            for raw in as_bytes(b.column(0)):
                seen.update(evidence(*pieces(raw.decode("utf-8", "replace"))))
            keys = list(seen)
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in keys], pa.string()), pa.array([i for _, i in keys], pa.bool_()), pa.array([seen[k] for k in keys], pa.int64())], names=["name", "inside", "n"])

    # The sample's ids number at most fit_pages, so they can be broadcast, and so can their features.
    own = pages.select(F.col(id_col).alias("page"), F.col(html_col).cast("string").alias("html"))
    picked = own.select(F.col("page").alias("picked")).orderBy(F.xxhash64("picked"), "picked").limit(fit_pages)
    sample = own.join(F.broadcast(picked), F.col("page").eqNullSafe(F.col("picked")), "left_semi").select("html")
    counts = sample.mapInArrow(run, "name string, inside boolean, n long").groupBy("name", "inside").agg(F.sum("n").alias("n"))
    return learn({(r["name"], r["inside"]): r["n"] for r in counts.collect()})


def main_text(pages: DataFrame, weights: Weights, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page, in one narrow pass over whole pages.

    Null and empty pages give the empty text, and so do pages without words. White space is
    the ASCII kind; a no-break space is a character of its text. Of runs that score the same the
    first is taken. Repeated rows repeat their result; other columns are ignored. Time and memory
    grow with the length of a page, however deep it is nested and whatever is left unclosed; a tag
    in which a quote stays open is text.
    """

    def run(batches):
        for b in batches:
            texts = [extract(raw.decode("utf-8", "replace"), weights) for raw in as_bytes(b.column(2))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")).mapInArrow(
        run, "page_id long, url string, text string, n_chars long"
    )
