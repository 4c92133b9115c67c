"""Page text: parsing, the network, held-out accuracy, the driver's pages."""

import html
import re

import numpy as np
import pytest

from tidemark.llm import html_text, html_train


def article(page):
    """What the driver's pages hold between the article tags."""
    inside = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    parts = re.split(r"</?(?:p|h1)>", inside)
    return "\n".join(x for x in (" ".join(html.unescape(re.sub(r"<[^>]+>", " ", p)).split()) for p in parts) if x)


def test_held_out_accuracy():
    assert html_train.accuracy(html_text.labeller().w, n_pages=300, seed=1234) > 0.995


def test_driver_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    want = {r.page_id: article(r.html) for r in pages.collect()}
    got = {r.page_id: r for r in html_text.main_text(pages).collect()}
    assert {k: r.text for k, r in got.items()} == want
    assert all(r.n_chars == len(r.text) for r in got.values())


@pytest.mark.parametrize(
    "page,blocks",
    [
        (None, []),
        ("", []),
        ("plain &amp; text", ["plain & text"]),
        ("<p>a<p>b<b>c</b> d", ["a", "bc d"]),
        ("<p>a<br>b</p>", ["a b"]),
        ("<head><title>t</title></head><body><script>var x='<p>no</p>'</script><style>p{}</style><p>x &lt;p&gt; &#233;</p><!-- <p>c</p> -->", ["x <p> é"]),
        ("<div class=\"a>b\">x</div><a href='q'>y", ["x", "y"]),
        ("<div title=\"open>z</div><p>w", ["z", "w"]),
        ("<script>never closed <p>x", []),
        ("<p>cut <a hre", ["cut"]),
        ("<li>1<li>2</ul>3 < 4", ["1", "2", "3 < 4"]),
        ("<p>\n a \t b c </p>", ["a b c"]),
    ],
)
def test_blocks(page, blocks):
    assert [b.text for b in html_text.blocks_of(page)] == blocks


@pytest.mark.parametrize(
    "page,blocks",
    [
        ("<p>a <svg-icon name='x'></svg-icon> b</p><p>c</p>", ["a b", "c"]),
        ("<object-viewer src=q></object-viewer><p>c", ["c"]),
        ("<p>a<svg class='i' href='a>b/'/>b</p><svg/><p>c</p><svg><text>no</text></svg>d", ["ab", "c", "d"]),
        ("<p>a<math/>b</p><p>so <math display='block'><mi>x</mi><mo>=</mo><mn>2</mn></math> holds</p>", ["ab", "so x=2 holds"]),
        ("<html><head><title>t</title><meta charset=x><link rel=y><p>a</p><p>b</p>", ["a", "b"]),
        ("<head><title>a <b>t</b></title><script>x</script>\n<a href='/'>link</a> and text<div>b</div>", ["link and text", "b"]),
        ("<head><title>t</title>bare text", ["bare text"]),
        ("<head><title>t</title><base href=x></head><body><p>a", ["a"]),
    ],
)
def test_blocks_that_were_lost(page, blocks):
    assert [b.text for b in html_text.blocks_of(page)] == blocks
    assert all("head" not in b.path for b in html_text.blocks_of(page))


def test_boilerplate_kinds_go():
    prose = "Over the hill the river bends and the old mill stands near it. Nobody has lived there for years."
    page = (
        "<html><body><header><div class='masthead'>My site</div></header><nav><ul><li><a href='/'>Home</a></li><li><a href='/n'>News</a></li></ul></nav><div class='cookie-notice'>We use cookies <button>Accept</button></div>"
        f"<main><article><h1>The river</h1><p>{prose}</p><p>{prose}</p><ul><li>One thing.</li></ul></article></main><aside class='sidebar'><h3>Related</h3><ul><li><a href='/a'>Other story</a></li></ul></aside>"
        "<form><label>Email</label><input><button>Sign up</button></form><section id='comments'><h3>Comments</h3><p>Nice story.</p></section><footer>&copy; 2024 All rights reserved</footer></body></html>"
    )
    assert html_text.labeller().texts([page]) == [f"The river\n{prose}\n{prose}\nOne thing."]


PROSE = "Over the hill the river bends and the old mill stands near it. Nobody has lived there for years."


@pytest.mark.parametrize(
    "page,want",
    [
        ("plain text with no tags at all", "plain text with no tags at all"),
        (f"<div class='wrap'><div class='x1'><p>{PROSE}</p><p>{PROSE}</p></div><div class='x2'><a href='/a'>Home</a> <a href='/b'>News</a> <a href='/c'>Contact</a></div></div>", f"{PROSE}\n{PROSE}"),
        (
            f"<html><body><div class='container'><div class='row'><div class='col-md-8'><h1>The river</h1><p>{PROSE}</p><p>{PROSE}</p></div>"
            "<div class='col-md-4'><h4>Recent posts</h4><ul><li><a href='/1'>One story</a></li><li><a href='/2'>Two stories</a></li></ul></div></div></div></body></html>",
            f"The river\n{PROSE}\n{PROSE}",
        ),
        (f"<main><h1>River</h1><table><tr><th>Length</th><td>100 km</td></tr><tr><th>Country</th><td>Nowhere</td></tr></table><p>{PROSE}</p></main>", f"River\nLength\n100 km\nCountry\nNowhere\n{PROSE}"),
    ],
)
def test_pages_written_by_hand(page, want):
    assert html_text.labeller().texts([page]) == [want]


def test_packed_network_is_the_plain_one():
    """Pages side by side give what each gives alone."""
    writer = html_train.Writer(5)
    pages = [writer.page() for _ in range(20)] + ["", None, "<p>x"]
    tool = html_text.labeller()
    assert tool.texts(pages) == [tool.texts([p])[0] for p in pages]


def test_gradients():
    rng = np.random.default_rng(0)
    w, u, b = (rng.normal(size=s).astype(np.float64) * 0.3 for s in ((html_text.INPUT, 64), (16, 64), (64,)))
    x, mask = rng.normal(size=(2, 4, html_text.INPUT)), np.array([[1, 1, 1, 1], [1, 1, 0, 0]], float)
    goal = rng.normal(size=(2, 4, 16))
    run = lambda w: (html_train._run(x, mask, w, u, b)[0] * goal).sum()
    out, kept = html_train._run(x, mask, w, u, b)
    dw = html_train._back(x, kept, goal, w, u)[0]
    for i, j in ((0, 0), (5, 20), (10, 40), (20, 60)):
        e = np.zeros_like(w)
        e[i, j] = 1e-3
        assert abs((run(w + e) - run(w - e)) / 2e-3 - dw[i, j]) < 1e-2 * max(1, abs(dw[i, j]))


def test_rows(spark):
    df = spark.createDataFrame([(1, "u", None, 5), (1, None, "<article><p>Hello there, this is a text.</p></article>", 6), (None, "v", "", 7)], "page_id bigint, url string, html string, text int")
    assert sorted(map(str, (tuple(r) for r in html_text.main_text(df).collect()))) == sorted(map(str, [(1, "u", "", 0), (1, None, "Hello there, this is a text.", 28), (None, "v", "", 0)]))
    assert html_text.main_text(df.limit(0)).count() == 0
    long = "<article>" + "<p>Word after word it goes.</p>" * 20000 + "</article>"
    assert html_text.labeller().texts([long])[0].count("\n") == 19999
