"""Page extraction against an independent parser and over kinds of pages; the cut against single verdicts; broken markup in linear time."""

import collections
import re
import time
from html.parser import HTMLParser

import numpy as np
import pyarrow.parquet as pq
import pytest

from docloom.llm import html, queries

DATA = "/root/testdata/sf0.001"


class Plain(HTMLParser):
    """Blocks of an <article>, without what no article holds; knows well-formed pages only."""

    BLOCKS = {"p", "h1", "h2", "h3", "li", "div", "ul", "ol", "blockquote", "article", "section", "header", "td", "tr", "table", "pre", "figure", "figcaption"}
    OUT = {"nav", "aside", "footer", "form", "script", "style"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.out, self.parts, self.found = 0, 0, [], []

    def flush(self):
        text = " ".join("".join(self.parts).split())
        if text:
            self.found.append(text)
        self.parts = []

    def handle_starttag(self, tag, attrs):
        if tag in self.BLOCKS:
            self.flush()
        if tag == "br":
            self.parts.append(" ")
        self.inside += tag == "article"
        self.out += tag in self.OUT

    def handle_endtag(self, tag):
        if tag in self.BLOCKS:
            self.flush()
        self.inside -= tag == "article"
        self.out -= tag in self.OUT

    def handle_data(self, data):
        if self.inside and not self.out:
            self.parts.append(data)


def plain(page: str) -> str:
    parser = Plain()
    parser.feed(page)
    parser.close()
    parser.flush()
    return "\n".join(parser.found)


def f1(got: str, want: str) -> float:
    a, b = collections.Counter(got.split()), collections.Counter(want.split())
    both = sum((a & b).values())
    return 1.0 if not a and not b else 2 * both / max(1, sum(a.values()) + sum(b.values()))


def test_query_against_an_independent_parser_on_the_whole_table(spark):
    rows = {r.page_id: r for r in queries.op10_html(spark, DATA).collect()}
    pages = pq.read_table(f"{DATA}/pages.parquet").to_pylist()
    assert len(rows) == len(pages)
    for page in pages:
        r = rows[page["page_id"]]
        want = plain(page["html"] or "")
        assert r.text == want and r.n_chars == len(want) and r.url == page["url"]


LONG = "This sentence is part of the text that a reader came for, and it is long enough to be told from a label."
KINDS = {
    "article": (f"<nav><ul><li><a href=/>Home</a></ul></nav><article><h1>Title</h1><p>{LONG}</p><p>Short.</p></article><footer>me</footer>", ["Title", LONG, "Short."]),
    "side effects": (f"<article><p>{LONG}</p><p class='side-effects'>Nausea.</p><section id='search-results'><p>{LONG}</p></section><p class='tags'>Words that the text explains here.</p></article>",
                     [LONG, "Nausea.", LONG, "Words that the text explains here."]),
    "list of links": (f"<article><h2>Sources</h2><p>{LONG}</p><ul><li><a href=1>First book</a></li><li><a href=2>Second book</a></li></ul><p>{LONG}</p></article>",
                      ["Sources", LONG, "First book", "Second book", LONG]),
    "formula and button": (f"<article><p>So <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> holds, and {LONG}</p><p>Press <button>Save</button> to keep it, then go on.</p><div><button>Share</button></div></article>",
                           [f"So x=2 holds, and {LONG}", "Press Save to keep it, then go on."]),
    "divisions only": (f"<div id=top><div class=menu><a href=a>One</a> <a href=b>Two</a></div></div><div class=content><div class=title><h1>Title</h1></div><div>{LONG}</div><div>{LONG}</div></div>"
                       f"<div class=sidebar><p>{LONG}</p></div><div id=footer>Some words.</div>", ["Title", LONG, LONG]),
    "comments": (f"<main><h1>Title</h1><p>{LONG}</p></main><section id=comments><h2>Comments</h2><div class=comment-body><p>{LONG}</p></div></section>", ["Title", LONG]),
    "notices": (f"<div class=cookie-banner><p>{LONG}</p></div><main><p>{LONG}</p><aside><p>{LONG}</p></aside><div class='ad'>{LONG}</div><form><p>{LONG}</p></form><p>{LONG}</p></main>", [LONG, LONG]),
    "no markup around": (f"<h1>Title</h1><p>{LONG}<p>{LONG}<script>var x = 1;</script><style>p{{}}</style>", ["Title", LONG, LONG]),
    "classes of layout": (f"<body class='has-sidebar'><div class='container with-sidebar'><div class='article-header'><h1>Title</h1></div><div class='post-content'><p>{LONG}</p></div></div>", ["Title", LONG]),
    "table": (f"<article><p>{LONG}</p><table><tr><th>Year<th>Sum<tr><td>1990<td>12</table></article>", [LONG, "Year Sum", "1990 12"]),
}


@pytest.fixture(scope="module")
def fitted(spark):
    return html.train(spark.read.parquet(f"{DATA}/pages.parquet"))


@pytest.mark.parametrize("kind", KINDS)
def test_kinds_of_pages(fitted, kind):
    page, want = KINDS[kind]
    assert html.main_text(page) == "\n".join(want) == html.main_text(page, weights=fitted)


def test_fit_against_plain_descent(spark, fitted):
    """Weights move towards the marked articles; a slow minimiser of the same loss finds the same."""
    x, y, names = html.table([html.marked(r["html"] or "") for r in pq.read_table(f"{DATA}/pages.parquet").to_pylist()])
    prior = np.array([*html.PRIOR.form, *[html.before(s) for s in names]])
    share = np.where(y > 0, 0.5 / (y > 0).mean(), 0.5 / (y <= 0).mean()) * min(300, len(y)) / len(y)
    tight = 1 / html.spread(prior) ** 2
    loss = lambda w: (share * np.logaddexp(0, np.where(y > 0, -1, 1) * (x @ w))).sum() + (tight * (w - prior) ** 2).sum() / 2
    w, step = prior.copy(), 0.5
    for k in range(800 * len(w)):  # one weight after the other, by halving steps
        i = k % len(w)
        for sign in (1, -1):
            other = w.copy()
            other[i] += sign * step
            if loss(other) < loss(w):
                w = other
        if i == len(w) - 1 and k // len(w) % 10 == 9:
            step *= 0.8
    own = len(html.PRIOR.form)
    assert loss(prior) > loss(w) and np.abs(w[:own] - np.array(fitted.form)).max() < 1e-2
    for sign, value in zip(names, np.clip(w[own:], -html.SMOOTH, html.SMOOTH), strict=True):
        assert abs(fitted.signs.get(sign, html.before(sign)) - value) < 1e-2


def stripped(page: str) -> str:
    """Without article marks and names."""
    return re.sub(r"""\s(class|id|role)=("[^"]*"|'[^']*'|[^\s>]+)""", "", re.sub(r"</?(article|main)\b[^>]*>", "", page))


def test_pages_without_marks_and_names(spark, fitted):
    """The fit hides the mark from itself and finds the article without it; no sign weighs more than an edge."""
    pages = [r["html"] or "" for r in pq.read_table(f"{DATA}/pages.parquet").to_pylist()]
    assert "article" not in "".join(fitted.signs) and max(map(abs, fitted.signs.values())) <= html.SMOOTH
    scores = [f1(html.main_text(stripped(p), weights=fitted), plain(p)) for p in pages]
    assert sum(scores) / len(scores) > 0.95


def test_names_are_learned():
    """A name that no list knows is learned from pages that mark their article, and used on one that doesn't."""
    page = "<div class=zq7><p>{0}</p></div>" + f"<article><h1>T</h1><p>{LONG}</p><p>{LONG}</p></article><div class=zq7><p>{LONG}</p></div>"
    learned = html.learn([html.marked(page.format(LONG + str(k))) for k in range(20)])
    assert learned.signs["zq7"] < -1 and "zq7" not in html.PRIOR.signs
    plainly = f"<div><p>{LONG}</p><p>{LONG}</p></div><div class=zq7><p>{LONG}</p></div>"
    assert html.main_text(plainly) == "\n".join([LONG] * 3) and html.main_text(plainly, weights=learned) == "\n".join([LONG] * 2)


def test_the_cut_flips_blocks_of_given_pages(spark, fitted):
    """All given pages without marks, names and elements of parts, with links of their own between the paragraphs: alone they look
    like a menu, the cut keeps them."""
    flipped, with_cut, without, n = collections.Counter(), 0.0, 0.0, 0
    for r in pq.read_table(f"{DATA}/pages.parquet").to_pylist():
        page = r["html"] or ""
        page = re.sub(r"</p>(?=<p>)", "</p><p><a href='/source'>See the whole source here</a></p>", page)
        if "See the whole" not in page:
            continue
        bare = re.sub(r"<(/?)(nav|footer|aside|header)\b", r"<\1div", stripped(page))
        got, alone = (html.main_text(bare, smooth, fitted).split("\n") for smooth in (html.SMOOTH, 0.0))
        for text, k in (collections.Counter(got) - collections.Counter(alone)).items():
            flipped["in", text] += k
        for text, k in (collections.Counter(alone) - collections.Counter(got)).items():
            flipped["out", text] += k
        want = plain(page)
        with_cut, without, n = with_cut + f1("\n".join(got), want), without + f1("\n".join(alone), want), n + 1
    kept, others = flipped.pop(("in", "See the whole source here")), sum(flipped.values())
    assert (n, kept, others) == (38, 247, 26)
    assert with_cut / n > without / n + 0.03
    assert with_cut / n > 0.95


def test_nothing_to_learn_from(spark):
    for rows in ([], [(None,), ("",), ("<p>no article marked</p>",), ("<article><p>only the article</p></article>",)]):
        assert html.train(spark.createDataFrame(rows, "html string")) == html.PRIOR


def test_the_cut_decides_what_the_costs_leave_open():
    """A short line that the classifier takes for boilerplate stays between paragraphs, and a long one alone among links goes."""
    short = "<p>ibid</p>"
    page = f"<div>{f'<p>{LONG}</p>' * 3}{short}{f'<p>{LONG}</p>' * 3}</div>"
    b = next(b for b in html.blocks(page) if b.text == "ibid")
    assert html.odds(b) < 0 and "ibid" in html.main_text(page).split("\n")
    assert "ibid" not in html.main_text(page, smooth=0.0).split("\n")
    links = "".join(f"<p><a href={i}>Page {i}</a></p>" for i in range(6))
    page = f"<div>{links}<p>More to see.</p>{links}</div>"
    b = next(b for b in html.blocks(page) if b.text == "More to see.")
    assert html.odds(b) > 0 and html.main_text(page) == "" and html.main_text(page, smooth=0.0) == "More to see."


@pytest.mark.parametrize("piece", ["<noscript><p>a b c", "<button>x<p>a", "<svg><p>a", "<head><p>a", "<div><p>a", "<!-- <p>a", "<a href='<p>a", "<title>", "</p></div>", "&amp;<"])
def test_unclosed_elements_cost_linear_time(piece):
    def seconds(n):
        page, began = piece * n, time.process_time()
        html.blocks(page)
        return time.process_time() - began

    seconds(100)
    for _ in range(5):  # other work on the machine can slow any one run
        if seconds(16_000) < 10 * max(seconds(4_000), 0.02):
            return
    pytest.fail("16,000 pieces took ten times as long as 4,000, five times over")
