"""HTML extraction by minimum-cut labelling.

A page becomes blocks of text. What a small linear classifier thinks of a block gives it two terminal capacities, one to
the source (content) and one to the sink (boilerplate). It looks at the form of a block (length, links, headings, ...) and at
signs: the elements around it and the names that pages give them. Its weights are fitted to the pages at hand: where a page
marks its article, what lies in it and what doesn't are labels, and the mark itself is hidden from the fit. No sign weighs more
than an edge does (``SMOOTH``), so neighbours can outvote it. Blocks that follow each other, or are neighbours under one parent
element, are joined by edges whose capacity falls with the steps between them in the element tree; an element that begins a part
of its own counts as several steps. Maximum flow finds the labelling of least cost, and the blocks still reachable from the source
are the main text. What a page doesn't show is no block.
"""

from __future__ import annotations

import html as entities
import json
import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SMOOTH = 4.0  # capacity between blocks of one element, and the most that one sign weighs
STRONG = 0.6 * SMOOTH  # a sign against that ends what elements further out say for a part
PART_STEPS = 10  # steps that an element counts as which begins a part of its own
SCHEMA = "page_id long, url string, text string, n_chars long"

# Elements by their part in a page, and words in class, id or role that tell a part.
RAW = {"script", "style", "template", "noscript", "iframe", "svg", "object", "canvas", "audio", "video", "head", "title", "textarea", "select", "datalist", "annotation", "annotation-xml", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure",
    "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "search", "section",
    "summary", "table", "caption", "tbody", "thead", "tfoot", "tr", "ul",
}
SPACED = {"br", "td", "th", "img", "wbr", "option", "input"} - {"wbr"}
APART = {"nav", "footer", "aside", "form", "menu", "dialog", "search", "fieldset", "header"}
MARKS = {"article", "main"}
SURE = set(
    "nav navbar navigation menubar breadcrumb breadcrumbs masthead topbar toolbar sidebar ad ads advert adverts advertisement adsense adsbygoogle sponsored "
    "cookie cookies gdpr newsletter disqus pagination pager comment comments tagcloud".split()
)
AGAINST = SURE | set(
    "menu footer header aside widget widgets advertising sponsor promo promotion promoted banner banners consent notice notices alert popup modal overlay "
    "subscribe subscription signup signin login share sharing social related recommended recommendations respond reply replies hidden complementary contentinfo".split()
)
# Words that as often name a part of the text.
PERHAPS = set("side search tag tags rail foot skip reviews review discussion copyright".split())
FOR = set("article articles content contents post entry story body main text prose hentry".split())
LAYOUT = set("wrap wrapper container layout page site with has no row grid outer inner col columns".split())
# Words that say where or how large a part is, not what is in it.
PLAIN = set(
    "header title left right top bottom primary secondary global mobile desktop sticky fixed inline list item items link links box block blocks section bar panel "
    "area button buttons form icon icons group meta info small large first last sub js is the and of for in to mod ui slot unit zone".split()
)
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^\"'>]|(?<==)\"[^\"]*\"|(?<==)'[^']*'|[\"'])*+)>", re.S
)
_NAMED = re.compile(r"""(?<![\w-])(class|id|role|style|aria-hidden|hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
MARK, LEAST = 3.0, -12.0  # a marked article; the least that signs come to together
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_CLOSES_P = BLOCK - {"html", "body"}
UNTOLD = {"html", "body", "div", "p", "center"} | MARKS  # elements that are no signs


def token_cost(token: str) -> float:
    """What one class name, id or role says. Most words against count in full only beside words that name parts of pages too."""
    words = {w.lower() for w in _PART.findall(token)}
    if words & LAYOUT or words <= {"header", "title"} | FOR and words & FOR:
        return 1.5 if words & FOR and not words & LAYOUT else 0.0
    if words & (AGAINST | PERHAPS):
        whole = words & SURE or words & AGAINST and words <= AGAINST | PERHAPS | FOR | PLAIN
        return -SMOOTH if whole else -2.0
    return 1.5 if words & FOR else 0.0


def before(sign: str) -> float:
    """What a sign is taken for before any page is seen: elements as ``<nav``, other signs are class names, ids and roles."""
    if sign.startswith("<"):
        return -SMOOTH if sign[1:] in APART else 0.0
    return token_cost(sign)


def read(attributes: str, named: bool) -> tuple[list[str], bool]:
    """Class names, ids and roles of an element (if they count), and whether it is hidden."""
    signs, hidden = [], False
    for name, value in _NAMED.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "style":
            hidden |= bool(_UNSEEN.search(value))
        elif name == "hidden" or name == "aria-hidden":
            hidden |= name == "hidden" and value.lower() != "until-found" or value.lower() == "true"
        elif named:
            signs.extend(value.split())
    return signs, hidden


def evidence(signs: list[str], learned: dict[str, float]) -> float:
    """What the signs of one element say: a strong one against counts alone, others are added up, within the size of an edge."""
    found = [learned[x] if x in learned else before(x) for x in signs]
    low = min(found, default=0.0)
    return max(-SMOOTH, low if low <= -STRONG else min(sum(found), 2.5))


class Block:
    """Text of a block with what the classifier looks at: what signs around it say, shares of link and button text, form."""

    __slots__ = ("text", "cost", "node", "links", "buttons", "heading", "item", "inside", "chain", "title", "ahead")

    def __init__(self, text: str, at: Element, node: int, links: float, buttons: float, names: list[str]):
        self.text, self.cost, self.node, self.links, self.buttons, self.inside = text, at.cost, node, links, buttons, at.inside
        self.chain, self.title, self.ahead = at.chain, "h1" in names, False
        self.heading, self.item = any(x in HEADINGS for x in names), "li" in names


class Element:
    """An open element; ``chain`` is (its signs, the chain of the element around it)."""

    __slots__ = ("name", "cost", "node", "inside", "hidden", "chain")

    def __init__(self, name: str, cost: float, node: int, inside: bool, hidden: bool, chain: tuple | None):
        self.name, self.cost, self.node, self.inside, self.hidden, self.chain = name, cost, node, inside, hidden, chain


class Tree:
    """Parent and depth of every element with text of its own level."""

    def __init__(self):
        self.parent, self.depth, self.width = [0], [0], [1]

    def add(self, parent: int, width: int) -> int:
        self.parent.append(parent)
        self.width.append(width)
        self.depth.append(self.depth[parent] + 1)
        return len(self.parent) - 1

    def steps(self, a: int, b: int) -> int:
        """Edges between two nodes, each as long as its element counts. For blocks that follow each other these are tags between them, so all sums are linear."""
        n = 0
        while a != b:
            if self.depth[a] < self.depth[b]:
                a, b = b, a
            n += self.width[a]
            a = self.parent[a]
        return n


def _end_of_head(page: str, at: int) -> re.Match | None:
    """Its end tag may be left out: then the head ends where the body or an element of the text begins."""
    while m := _HEAD_END.search(page, at):
        if m[1] is None:
            return m
        stop = re.compile(rf"</{m[1]}", re.I).search(page, m.end())
        at = stop.end() if stop else len(page)
    return None


_HEAD_END = re.compile(r"</head[\s>]|<body[\s>]|<(?:article|main|div|nav|p|h1)[\s>]|<(script|style|title)\b", re.I)


def blocks(page: str, tree: Tree | None = None, learned: dict[str, float] | None = None) -> list[Block]:
    """Text blocks in page order with what signs say of them; hidden text is left out, end tags without a start are ignored. Time is linear."""
    out: list[Block] = []
    tree, learned = tree or Tree(), learned or {}
    stack = [Element("", 0.0, 0, False, False, None)]
    open_: Counter[str] = Counter()
    parts, linked, pressed, in_link, in_button, at, n = [], 0, 0, False, False, 0, len(page)
    unclosed: set[str] = set()  # elements that have no end tag from here on

    def flush() -> None:
        nonlocal linked, pressed
        if parts:
            text = " ".join("".join(parts).split())
            if text and not stack[-1].hidden:
                out.append(Block(text, stack[-1], stack[-1].node, min(1.0, linked / len(text)), min(1.0, pressed / len(text)), [e.name for e in stack[-3:]]))
            parts.clear()
        linked = pressed = 0

    def begin(name: str, signs: list[str], hidden: bool) -> None:
        around = stack[-1]
        own, cost = evidence(signs, learned), around.cost
        if name in MARKS:
            cost = max(cost, -1.0) + MARK
        cost = max(LEAST, min(cost, 0.0) + own) if own <= -STRONG else max(LEAST, min(cost + own, SMOOTH))
        node = tree.add(around.node, PART_STEPS if abs(own) >= STRONG / 2 or name in APART else 1)
        chain = (signs, around.chain) if signs and name not in MARKS else around.chain
        stack.append(Element(name, cost, node, around.inside or name in MARKS, around.hidden or hidden, chain))
        open_[name] += 1

    def end() -> str:
        name = stack.pop().name
        open_[name] -= 1
        return name

    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            parts.append(entities.unescape(page[at:]))
            break
        if m.start() > at:
            piece = entities.unescape(page[at : m.start()])
            parts.append(piece)
            if in_link:
                linked += len(piece.strip())
            if in_button:
                pressed += len(piece.strip())
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                parts.append(m[0][9:].removesuffix("]]>"))
            continue
        name = m[2].lower()
        if not m[1]:
            if name in RAW and not m[3].endswith("/"):
                stop = None
                if name == "head":
                    stop = _end_of_head(page, at)
                elif name not in unclosed:
                    stop = re.compile(rf"</{re.escape(name)}[\s/>]", re.I).search(page, at)
                    if stop is None:
                        unclosed.add(name)
                at = stop.start() if stop else n if name in ("script", "style") else at
                if stop and page[at + 1] == "/":
                    at = page.find(">", at) + 1 or n
                continue
            if name in SPACED:
                parts.append(" ")
            if name == "a":
                in_link = True
            elif name == "button":
                in_button = True
            if name not in BLOCK:
                if name in ("span", "ins", "b", "i", "em", "font") and _NAMED.search(m[3]):
                    signs, hidden = read(m[3], True)
                    if hidden or evidence(signs, learned) <= -STRONG:
                        flush()
                        begin(name, signs, hidden)
                continue
            flush()
            in_link = in_button = False
            last = stack[-1].name
            if name in _CLOSES_P and last == "p" or name == "li" and last == "li" or name in ("dt", "dd") and last in ("dt", "dd") or name == "tr" and last == "tr":
                end()
            if name in ("hr",):
                continue
            signs, hidden = read(m[3], name not in ("html", "body"))
            if name not in UNTOLD and not (name == "header" and stack[-1].inside):
                signs.append("<" + name)
            begin(name, signs, hidden)
        elif name == "a":
            in_link = False
        elif name == "button":
            in_button = False
        elif name in BLOCK or stack[-1].name == name:
            flush()
            if open_[name]:
                while end() != name:
                    pass
    flush()
    title = next((k for k, b in enumerate(out) if b.title), 0)
    for b in out[:title]:
        b.ahead = not b.inside
    return out


HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}


class Weights(NamedTuple):
    """Of the form: constant, words (logarithm), links, list item, heading, end of a sentence, ahead of the title. Of signs: those that were learned."""

    form: tuple[float, ...]
    signs: dict[str, float]


PRIOR = Weights((-0.6, 0.55, -3.0, -0.8, 1.0, 0.6, -2.5), {})  # where the fit starts from and what it is drawn to
LINKS_INSIDE, BUTTON = -0.8, -SMOOTH
FIT_PAGES, FIT_BLOCKS = 400, 60  # pages of the sample (by a hash of the page), blocks of each (evenly spread)
FIT_SIGNS, SIGN_PAGES = 500, 3  # signs learned: those on most pages of the sample, on this many at least; others keep what they were taken for


def form(b: Block) -> tuple[float, ...]:
    """What the weights apply to."""
    words = b.text.count(" ") + 1
    return 1.0, math.log1p(words), b.links, float(b.item), float(b.heading), float(b.text[-1] in ".!?…。\"”»"), float(b.ahead)


def odds(b: Block, weights: Weights = PRIOR) -> float:
    """Log-odds that a block is main text, from its form and its signs. In an article links and lists say little."""
    x = list(form(b))
    z = min(b.cost, 0.0) + BUTTON if b.buttons > 0.8 else b.cost
    if b.inside:
        z += LINKS_INSIDE * x[2]
        x[2] = x[3] = 0.0
    return z + sum(w * v for w, v in zip(weights.form, x, strict=True))


def fit(x: np.ndarray, y: np.ndarray, prior: np.ndarray, loose: np.ndarray, most: float = 300.0) -> np.ndarray:
    """Weights of the likeliest logistic curve around ``prior``, from which they stray by about ``loose``. Classes count alike, and all blocks together as ``most``
    at most, so that pages of one make don't carry the weights away. Without blocks of both classes it is the prior."""
    if len(set(y.tolist())) < 2:
        return prior
    share = np.where(y > 0, 1 / max(1, (y > 0).sum()), 1 / max(1, (y <= 0).sum())) * min(most, len(y)) / 2
    tight = 1 / loose**2
    loss = lambda w: (share * np.logaddexp(0, np.where(y > 0, -1, 1) * (x @ w))).sum() + (tight * (w - prior) ** 2).sum() / 2
    w = prior.copy()
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (share * (p - y)) + tight * (w - prior)
        step = np.linalg.solve((x * (share * p * (1 - p))[:, None]).T @ x + np.diag(tight), gradient)
        size, now = 1.0, loss(w)
        while size > 1e-6 and loss(w - size * step) > now:
            size /= 2
        w = w - size * step
        if np.abs(step).max() < 1e-9:
            break
    return w


def marked(page: str, most: int = FIT_BLOCKS) -> list[tuple[tuple[float, ...], list[str], bool]]:
    """Form, signs and label of blocks of a page that marks its article: true inside, unless a sign speaks against it. The mark and
    what it is named are no signs."""
    found = blocks(page)
    if not any(b.inside for b in found):
        return []
    kept = [b for b in found if not b.inside or b.cost >= 1.0]
    out = []
    for k in sorted({round(k) for k in np.linspace(0, len(kept) - 1, min(most, len(kept)))}) if kept else []:
        b, signs, chain = kept[k], set(), kept[k].chain
        while chain:
            signs.update(chain[0])
            chain = chain[1]
        out.append((form(b), sorted(signs), b.inside))
    return out


def table(pages: list[list[tuple[tuple[float, ...], list[str], bool]]]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Features and labels of the blocks of ``marked`` pages, and the signs that columns behind the form stand for."""
    on = Counter(x for page in pages for x in {x for _, signs, _ in page for x in signs})
    names = sorted(sorted((x for x in on if on[x] >= SIGN_PAGES), key=lambda x: (-on[x], x))[:FIT_SIGNS])
    column = {x: len(PRIOR.form) + k for k, x in enumerate(names)}
    rows = [row for page in pages for row in page]
    x = np.zeros((len(rows), len(PRIOR.form) + len(names)))
    for k, (own, signs, _) in enumerate(rows):
        x[k, : len(own)] = own
        x[k, [column[s] for s in signs if s in column]] = 1.0
    return x, np.array([float(row[2]) for row in rows]), names


def spread(prior: np.ndarray) -> np.ndarray:
    """How far weights may stray: of the form little, of signs more, most of signs that nothing is known of."""
    own = np.arange(len(prior)) < len(PRIOR.form)
    return np.where(own, 0.2 * np.maximum(np.abs(prior), 0.4), 1.0)


def learn(pages: list[list[tuple[tuple[float, ...], list[str], bool]]]) -> Weights:
    """Weights from ``marked`` pages; a sign's weight stays within the size of an edge."""
    x, y, names = table(pages)
    own, prior = len(PRIOR.form), np.array([*PRIOR.form, *[before(s) for s in names]])
    w = fit(x, y, prior, spread(prior)).tolist()
    return Weights(tuple(w[:own]), {s: max(-SMOOTH, min(v, SMOOTH)) for s, v in zip(names, w[own:], strict=True) if v != before(s)})


def train(pages: DataFrame, fit_pages: int = FIT_PAGES) -> Weights:
    """Weights fitted to a bounded sample of pages; those without a marked article teach nothing. No table gives the prior."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([json.dumps(marked(p.as_py())) for p in batch.column(0)], pa.string())], names=["found"])

    sample = pages.where("length(html) > 0").select("html").orderBy(F.xxhash64("html"), F.xxhash64(F.reverse("html"))).limit(fit_pages)
    return learn([json.loads(found) for found in sorted(r.found for r in sample.mapInArrow(run, "found string").collect())])


def least_cut(terminals: list[tuple[float, float]], edges: list[tuple[int, int, float]]) -> list[bool]:
    """True for nodes on the source's side of a minimum cut; ties go to the sink's side. Edges bind both ways alike."""
    n = len(terminals)
    s, t = n, n + 1
    head: list[list[int]] = [[] for _ in range(n + 2)]
    to, room = [], []

    def join(a: int, b: int, there: float, back: float) -> None:
        head[a].append(len(to)), head[b].append(len(to) + 1)
        to.extend((b, a)), room.extend((there, back))

    for v, (one, two) in enumerate(terminals):
        even = min(one, two)  # flows through the node at once
        if one > even:
            join(s, v, one - even, 0.0)
        elif two > even:
            join(v, t, two - even, 0.0)
    for a, b, c in edges:
        join(a, b, c, c)
    while True:  # blocking flows over layered networks
        level, queue = [-1] * (n + 2), [s]
        level[s] = 0
        for v in queue:
            for e in head[v]:
                if room[e] > 1e-12 and level[to[e]] < 0:
                    level[to[e]] = level[v] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [x >= 0 for x in level[:n]]
        turn, path, v = [0] * (n + 2), [], s
        while True:
            if v == t:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                cut = next(k for k, e in enumerate(path) if room[e] <= 1e-12)
                v = to[path[cut] ^ 1]
                del path[cut:]
            elif turn[v] < len(head[v]):
                e = head[v][turn[v]]
                if room[e] > 1e-12 and level[to[e]] == level[v] + 1:
                    path.append(e)
                    v = to[e]
                else:
                    turn[v] += 1
            elif v == s:
                break
            else:
                v = to[path.pop() ^ 1]
                turn[v] += 1


def main_text(page: str, smooth: float = SMOOTH, weights: Weights = PRIOR) -> str:
    tree = Tree()
    found = blocks(page, tree, weights.signs)
    if not found:
        return ""
    terminals = []
    for b in found:
        p = 1 / (1 + math.exp(-max(-30.0, min(odds(b, weights), 30.0))))
        terminals.append((-math.log(max(1 - p, 1e-13)), -math.log(p)))
    edges, last = [], {}
    for i, b in enumerate(found):
        if i:
            begins = PART_STEPS if found[i - 1].ahead and not b.ahead else 0  # so does the title
            edges.append((i - 1, i, smooth / (1 + begins + tree.steps(found[i - 1].node, b.node))))
        parent = tree.parent[b.node]
        if tree.width[b.node] == 1:  # text on both sides of a part belongs together
            if parent in last and last[parent] != i - 1 and found[last[parent]].ahead == b.ahead:
                edges.append((last[parent], i, smooth / 3))
            last[parent] = i
    return "\n".join(b.text for b, keep in zip(found, least_cut(terminals, edges), strict=True) if keep)


def extract(pages: DataFrame, weights: Weights = PRIOR) -> DataFrame:
    """One row per page, see ``SCHEMA``, by the ``weights`` of ``train``: the article without menus, headers, footers, sidebars, notices, adverts, forms and comments.

    A null, empty or text-free page gives the empty text. Broken markup (missing end tags, stray ends, cut tails) is read
    as far as it goes; pages are read whole, in time linear in their length. A null page_id or url stays null; repeated rows, and
    rows of one page_id, come back each; a block whose costs are even on both sides is left out. Extra columns are ignored;
    an empty table gives an empty result. Narrow: no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p.as_py() or "", SMOOTH, weights) for p in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"]
            )

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html")).mapInArrow(run, SCHEMA)
