"""HTML extraction: a minimum cut labels a page's text blocks as content or boilerplate.

A page becomes a row of blocks. A classifier, fitted on blocks whose markup says what they are, turns each block's
length, links, punctuation, element and place into two costs, the capacities from the source (content) and to the sink
(boilerplate); markup that names a block's role adds to them. Neighbouring blocks, and neighbours under one parent, are
joined by edges whose capacity falls with their distance in the DOM. The minimum cut is the labelling of least total
cost: found by augmenting paths (maximum flow), or, as these edges never cross, for pages of many blocks by
eliminating one block after the other in linear time.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuboid.llm.tables import add_columns

# a quote opens a value after an equals sign only; nothing is given back, so scanning is linear
_TAG = re.compile(r"(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?>\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+)?+)*+)>")
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*+)\s*+(?:=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s\"'>][^\s>]*+))?+")
# Names of HTML elements and usual words of class names.
_RAW = frozenset("script style template iframe textarea select".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody "
    "td tfoot th thead title tr ul".split()
)
_CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_STOPS = frozenset("article section div ul ol dl table body main aside nav header footer form blockquote".split())
_OFF_TAGS = frozenset("nav header footer aside form menu dialog button label legend fieldset head title search".split())
_OFF_WORDS = frozenset(
    "ad ads adv advert advertisement adverts advertising sponsor sponsored promo promotion promoted banner nav navbar navigation menu "
    "sidebar aside footer header masthead cookie cookies consent gdpr notice notices notification alert popup modal overlay toast "
    "share sharing social related recommended recommendations breadcrumb breadcrumbs subscribe newsletter signup login search widget "
    "toolbar pagination pager copyright legal disclaimer skip hidden tags meta".split()
)
_TALK_WORDS = frozenset("comment comments commentlist reply replies discussion disqus respond reactions thread".split())
#: Words that say where and how, not what: they may follow the word that a class name is about.
_PLAIN_WORDS = frozenset(
    "list item items box wrap wrapper container section block bar area panel region inner outer row col column group holder slot unit link "
    "links button buttons icon icons form field count info top bottom left right center middle first last posts articles stories".split()
)
_ON_WORDS = frozenset("article content post entry story main body text maincontent articlebody".split())


@dataclass(frozen=True)
class Cut:
    """sure: cost of going against a page's own markup. near: capacity between neighbours under one parent; it
    halves with every step of distance in the DOM. weights: of the classifier, fitted on sample pages at most, and on page_blocks blocks of
    each at most, evenly spread over the page. most: largest log-odds. blocks: pages of more are cut by elimination."""

    sure: float = 12.0
    near: float = 1.5
    weights: tuple[float, ...] = ()
    sample: int = 2000
    page_blocks: int = 1024
    most: float = 6.0
    blocks: int = 256


@dataclass
class _Node:
    tag: str
    parent: "_Node | None"
    depth: int
    verdict: int  # of the nearest element that says so: 1 content, -1 boilerplate, 0 unknown
    talk: bool  # inside reader comments
    hidden: bool
    block: "_Node | None" = None  # the nearest block element, itself included (None: itself)
    linked: bool = False  # inside a link that opens below that block


@lru_cache(maxsize=4096)
def _name_words(name: str) -> frozenset[str]:
    """The known words of one class, id or role, if it is about a known word: "site-header" and "ad-slot-3" are, "thread-safety"
    is not."""
    parts = [w for w in re.split(r"[^a-z0-9]+", name) if w]
    known = frozenset(w for w in parts if w in _OFF_WORDS or w in _TALK_WORDS or w in _ON_WORDS)
    for w in reversed(parts if known else ()):
        if w in known:
            return known
        if w not in _PLAIN_WORDS and not w.isdigit():
            break
    return frozenset()


def _open(tag: str, attributes: str, parent: _Node | None, first: bool = False) -> _Node:
    """The node of an opened element; first: nothing of the body's text came before it."""
    verdict = parent.verdict if parent else 0
    talk, hidden = (parent.talk, parent.hidden) if parent else (False, False)
    words: set[str] = set()
    talks = posts = False
    if "=" in attributes or "hidden" in attributes:
        for name, value in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), value.strip("\"'").lower()
            if name in ("class", "id", "role"):
                for said in map(_name_words, value.split()):
                    words |= said
                    talks = talks or bool(said & _TALK_WORDS)
                    posts = posts or bool(said) and said <= _ON_WORDS
            elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                hidden = True
    if tag not in ("html", "body"):
        off, on = bool(words & _OFF_WORDS), bool(words & _ON_WORDS)
        talk = talk or talks and not (posts and tag in ("article", "main"))  # a discussion that is itself the post
        if tag in ("h1", "h2", "h3", "h4", "h5", "h6") and not off:
            if parent and parent.tag in ("header", "hgroup") and parent.parent and parent.parent.verdict > 0:
                verdict = 1  # an article's own heading
        elif tag == "form" and first and parent and parent.tag in ("", "html", "body"):
            pass  # may hold the whole page
        elif tag in _OFF_TAGS or off and not on:
            verdict = -1
        elif tag in ("article", "main") or on and not off:
            verdict = 1
    if tag in _BLOCK or parent is None:
        return _Node(tag, parent, parent.depth + 1 if parent else 0, verdict, talk, hidden)
    return _Node(tag, parent, parent.depth + 1, verdict, talk, hidden, parent.block or parent, parent.linked or tag == "a")


def _tokens(page: str) -> Iterator[tuple[str, str, bool, str]]:
    """(text before, tag or "", closing, attributes) of a page's tags and, at last, of its end. Comments, declarations and
    the content of raw elements are skipped; what opens no tag is text."""
    at, done, ends, sections = 0, 0, page.rfind(">"), page.rfind("]]>")
    while True:
        k = page.find("<", at)
        if k < 0 or k > ends:
            yield page[done:], "", False, ""
            return
        at = k + 1
        if page.startswith("!--", at):
            end = page.find("-->", at + 3)
            stop = len(page) if end < 0 else end + 3
        elif page.startswith("![CDATA[", at) and at <= sections:
            stop = page.index("]]>", at) + 3
        elif page[at : at + 1] in ("!", "?"):
            stop = page.index(">", at) + 1
        elif m := _TAG.match(page, at):
            tag = m[2].lower()
            yield page[done:k], tag, bool(m[1]), m[3]
            done = at = m.end()
            if tag in _RAW and not m[1] and not m[3].endswith("/"):
                end = _raw_end(tag).search(page, at)
                done = at = end.end() if end else len(page)
            continue
        else:
            continue
        yield page[done:k], "", False, ""
        done = at = stop


@cache
def _raw_end(tag: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(tag)}\s*>", re.I)


def blocks(page: str) -> list[tuple[str, _Node, float]]:
    """(text, block element, share of characters within links) of a page's text blocks, in page order."""
    node, out = _Node("", None, 0, 0, False, False), []
    parts: list[str] = []
    linked = total = 0
    held: Counter[str] = Counter()  # open elements

    def flush() -> None:
        nonlocal linked, total
        text = " ".join(entities.unescape("".join(parts)).split()) if parts else ""
        if text:
            out.append((text, node.block or node, linked / max(total, 1)))
        parts.clear()
        linked = total = 0

    def leave(upto: _Node) -> _Node:
        n = node
        while n is not upto:
            held[n.tag] -= 1
            n = n.parent
        held[upto.tag] -= 1
        return upto.parent

    for text, tag, closing, attributes in _tokens(page):
        if text:
            parts.append(text)
            total += len(text)
            linked += len(text) if node.linked else 0
        if not tag or tag in _RAW or tag == "wbr":
            continue
        if tag in ("br", "img"):
            parts.append(" ")
            continue
        if tag in _BLOCK:
            flush()
        if tag in _VOID:
            continue
        if closing:
            if held[tag]:
                n = node
                while n.tag != tag:
                    n = n.parent
                node = leave(n)
            continue
        if tag in _BLOCK:
            ends = _CLOSES.get(tag, {"p"})
            if any(held[t] for t in ends):
                n = node
                while n.parent and n.tag not in ends and n.tag not in _STOPS:
                    n = n.parent
                if n.parent and n.tag in ends:
                    node = leave(n)
        node = _open(tag, attributes, node, len(out) < 2 and all(n.tag == "title" for _, n, _ in out))
        held[tag] += 1
    flush()
    return out


def _distance(a: _Node, b: _Node, most: int = 32) -> int:
    """Steps between two elements; beyond most no matter how many, as an edge's capacity is nothing then."""
    steps = 0
    while a is not b and steps < most:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return steps


def features(text: str, node: _Node, links: float) -> list[float]:
    """What the classifier sees of a block; names of classes and roles are not among it."""
    words = text.count(" ") + 1
    ends = text[-1] in ".!?…:;\"'»”"
    return [1.0, min(words, 40) / 20, float(ends), links * (words < 100), float(node.tag == "p"), float(node.tag in ("li", "td", "dd")), float(node.tag[:1] == "h" and node.tag[1:].isdigit()), min(node.depth, 12) / 12]


#: Weights of features() before anything is fitted: log-odds of content.
START = (-1.6, 1.6, 0.9, -5.0, 0.6, 0.0, 0.4, 0.0)


def role(node: _Node) -> int:
    """What a block's markup says: 1 content, -1 boilerplate, 0 nothing."""
    return -1 if node.hidden or node.talk else node.verdict


def fit(rows: np.ndarray, labels: np.ndarray, ridge: float = 4.0, least: int = 50) -> tuple[float, ...]:
    """Weights of a logistic regression that stays near START; START itself with fewer than least blocks of a label."""
    w = np.array(START)
    if min((labels == 1).sum(), (labels == 0).sum()) < least:
        return START
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(rows @ w, -30, 30)))
        slope = rows.T @ (p - labels) + ridge * (w - START)
        step = np.linalg.solve((rows * (p * (1 - p))[:, None]).T @ rows + ridge * np.eye(len(w)), slope)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return tuple(w.tolist())


def costs(text: str, node: _Node, links: float, cut: Cut) -> tuple[float, float]:
    """(cost of calling a block boilerplate, cost of calling it content)."""
    says = role(node)
    if says < 0:
        return 0.0, cut.sure
    score = max(-cut.most, min(cut.most, sum(a * b for a, b in zip(cut.weights, features(text, node, links), strict=True))))
    content, waste = math.log1p(math.exp(score)), math.log1p(math.exp(-score))
    return (cut.sure + content if says > 0 else content), waste


def minimum_cut(source: list[float], sink: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes stay with the source. Augmenting paths from breadth-first search, ended when none is left."""
    n = len(source)
    both = [min(a, b) for a, b in zip(source, sink, strict=True)]  # flow from source to sink over one node
    give, take = [a - c for a, c in zip(source, both, strict=True)], [b - c for b, c in zip(sink, both, strict=True)]
    room: list[dict[int, float]] = [{} for _ in range(n)]
    for i, j, w in edges:
        room[i][j] = room[i].get(j, 0.0) + w
        room[j][i] = room[j].get(i, 0.0) + w
    while True:
        before: list[int] = [-2] * n
        queue = deque(i for i in range(n) if give[i] > 1e-9)
        for i in queue:
            before[i] = -1
        end = -1
        while queue and end < 0:
            i = queue.popleft()
            for j, w in room[i].items():
                if w > 1e-9 and before[j] == -2:
                    before[j] = i
                    if take[j] > 1e-9:
                        end = j
                        break
                    queue.append(j)
        if end < 0:
            return [b != -2 for b in before]
        path, flow, j = [], take[end], end
        while before[j] >= 0:
            path.append((before[j], j))
            flow = min(flow, room[before[j]][j])
            j = before[j]
        flow = min(flow, give[j])
        give[j] -= flow
        take[end] -= flow
        for i, k in path:
            room[i][k] -= flow
            room[k][i] += flow


def eliminated_cut(source: list[float], sink: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """A minimum cut as of minimum_cut, in linear time, for edges (i, j, capacity), i < j, of which no two cross.

    Blocks are taken in order. An edge back to i closes all blocks between: each is eliminated, leaving between its
    neighbours the least cost for their four pairs of labels and, for the way back, its own best label."""
    n = len(source)
    own = [(a, b) for a, b in zip(source, sink, strict=True)]  # cost of label 0 (boilerplate), 1 (content)
    back: list[list[tuple[int, float]]] = [[] for _ in range(n)]
    for i, j, w in edges:
        back[j].append((i, w))
    stack: list[int] = []  # blocks that are left, and the costs between each and the one before
    between: list[list[list[float]]] = []
    order: list[tuple[int, int, int, list[list[int]]]] = []

    def eliminate() -> None:
        """Takes out the block before the last one."""
        v, w = stack[-2], stack[-1]
        u = stack[-3] if len(stack) > 2 else -1
        left, right = between[-2], between[-1]
        made, best = [[0.0, 0.0], [0.0, 0.0]], [[0, 0], [0, 0]]
        for a in (0, 1):
            for b in (0, 1):
                zero, one = left[a][0] + own[v][0] + right[0][b], left[a][1] + own[v][1] + right[1][b]
                made[a][b], best[a][b] = min(zero, one), int(one < zero)
        order.append((v, u, w, best))
        del stack[-2], between[-1]
        between[-1] = made

    for k in range(n):
        stack.append(k)
        between.append([[0.0, 0.0], [0.0, 0.0]])
        for i, w in sorted(back[k], reverse=True):
            while stack[-2] != i:
                eliminate()
            for a in (0, 1):
                between[-1][a][1 - a] += w
    while len(stack) > 1:
        eliminate()
    label = [0] * (n + 1)
    last = stack[0]
    label[last] = int(own[last][1] + between[0][0][1] < own[last][0] + between[0][0][0])
    for v, u, w, best in reversed(order):
        label[v] = best[label[u] if u >= 0 else 0][label[w]]
    return [x == 1 for x in label[:n]]


def main_text(page: str | None, cut: Cut = Cut(weights=START)) -> str:
    """The page's main text, a line a block; empty for null, empty and textless pages."""
    found = blocks(page or "")
    if not found:
        return ""
    pairs = [costs(t, n, links, cut) for t, n, links in found]
    edges, last = [], {}
    for k, (_, node, _) in enumerate(found):
        if k:
            edges.append((k - 1, k, cut.near * 0.5 ** _distance(found[k - 1][1].parent or node, node.parent or node)))
        mate = last.get(id(node.parent))
        if mate is not None and mate < k - 1:
            edges.append((mate, k, cut.near / 4))
        last[id(node.parent)] = k
    work = minimum_cut if len(found) <= cut.blocks else eliminated_cut
    keep = work([p[0] for p in pairs], [p[1] for p in pairs], edges)
    return "\n".join(t for (t, _, _), yes in zip(found, keep, strict=True) if yes)


def fitted(pages: DataFrame, html: str = "html", cut: Cut = Cut()) -> Cut:
    """cut with weights fitted on cut.sample different pages at most (those with the smallest hashes of their html): the
    label of a block is what its markup says of it, so a table without any such markup keeps the weights of START.

    Hashes are ordered without their pages; a task gives the blocks of a page once, however many copies it reads."""
    hashed = pages.select(F.col(html).alias("html"), F.xxhash64(F.col(html)).alias("h")).filter("html is not null")
    last = hashed.select("h").distinct().orderBy("h").limit(cut.sample).agg(F.max("h")).first()[0]
    if last is None:
        return replace(cut, weights=START)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # cut.sample hashes at most
        for batch in batches:
            for page, h in zip(batch.column("html"), batch.column("h").to_pylist(), strict=True):
                if h in seen:
                    continue
                seen.add(h)
                rows = [(features(t, n, x), int(role(n) > 0)) for t, n, x in blocks(page.as_py()) if role(n) and not n.hidden]
                rows = rows[:: max(1, -(-len(rows) // cut.page_blocks))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([h]), pa.array([[x for x, _ in rows]], pa.list_(pa.list_(pa.float64()))), pa.array([[y for _, y in rows]], pa.list_(pa.int32()))],
                    names=["h", "x", "y"])

    found = hashed.filter(F.col("h") <= last).mapInArrow(run, "h long, x array<array<double>>, y array<int>").dropDuplicates(["h"])
    got = found.select(F.explode(F.arrays_zip("x", "y")).alias("r")).groupBy("r.x", "r.y").agg(F.count("*").alias("n")).toArrow()
    x, n = np.array(got["x"].to_pylist()).reshape(-1, len(START)), got["n"].to_numpy()
    return replace(cut, weights=fit(np.repeat(x, n, axis=0), np.repeat(got["y"].to_numpy(), n)))


def extract_text(pages: DataFrame, html: str = "html", cut: Cut = Cut(), keep: list[str] | None = None) -> DataFrame:
    """pages with text and n_chars (its code points). The classifier is fitted on a bounded sample (cut.sample) unless
    cut has weights.

    Null, empty and textless pages have an empty text. Rows are worked on one by one, whole, in time linear in their
    length; equal pages get equal texts. New columns replace input columns of the same name. An empty table gives an
    empty result."""
    cut = cut if cut.weights else fitted(pages, html, cut)

    def work(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        texts = [main_text(x, cut) for x in batch.column(html).to_pylist()]
        return {"text": pa.array(texts, pa.string()), "n_chars": pa.array(np.array([len(t) for t in texts], dtype=np.int64))}

    return add_columns(pages, "text string, n_chars long", work, html, keep)
