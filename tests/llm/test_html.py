import itertools

import numpy as np
import pytest

from parchmine.llm import html as H


@pytest.fixture(scope="module")
def model():
    return H.trained()


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header class=site-header><div class="logo">Site</div><nav><ul><li><a href=/>Home</a><li><a href=/b>About us</a></ul></nav></header>
<div class="cookie-banner">We use cookies to improve this site. <button>OK</button></div>
<article><h1>Title &amp; more</h1><p>First   paragraph, with&nbsp;<b>bold</b><br>and a second line of the same paragraph that is long enough.
<p>Second paragraph &lt;here&gt; with &eacute; and more words, so that it reads like text of an article.</p><!-- <p>no</p> -->
<div class="ad">Buy now</div><p>Third paragraph closes the article, and it also has a fair number of words in it.</p></article>
<aside class="sidebar"><h3>Recent</h3><ul><li><a href=/x>Other post</a></li></ul></aside>
<section id="comments"><h3>Comments</h3><div class="comment"><p>I disagree with this.</p></div><form><input name=q><textarea>say</textarea></form></section>
<footer>&copy; site</footer></body></html>"""


def test_main_text(model):
    assert H.main_text(PAGE, model).split("\n") == [
        "Title & more",
        "First paragraph, with bold and a second line of the same paragraph that is long enough.",
        "Second paragraph <here> with é and more words, so that it reads like text of an article.",
        "Third paragraph closes the article, and it also has a fair number of words in it.",
    ]


def test_held_out_pages(model):
    maker, wrong, lines = H.Pages(4321), 0, 0
    for _ in range(60):
        dom = H.Dom(maker.page())
        keep = H.decode(dom, model.logit(H.node_features(dom)))
        wrong += sum(keep[n.order] != bool(n.label) for n, *_ in dom.lines)
        lines += len(dom.lines)
    assert wrong < 0.02 * lines


def test_decoding_is_the_best_consistent_choice():
    rng = np.random.default_rng(2)
    for _ in range(40):
        dom = H.Dom("")
        for i in range(1, 9):
            dom.nodes.append(H.Node("div", frozenset(), dom.nodes[rng.integers(0, i)], i))
        z = rng.normal(size=9)
        fits = lambda k: k[0] and all(k[n.parent.order] or not k[n.order] for n in dom.nodes[1:])
        best = max((k for k in itertools.product([True, False], repeat=9) if fits(k)), key=lambda k: sum(z[i] for i in range(1, 9) if k[i]))
        assert H.decode(dom, z) == list(best)


def test_rows(spark, model):
    rows = [(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (None, "u", ""), (4, "u", "plain"), (5, "u", "<div>" * 3000 + "deep" + "</p></div>" * 10), (6, "u", "<p>" + "word " * 200000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    got = H.extract_main_text(df, model).collect()
    assert len(got) == 7 and all(r.n_chars == len(r.text) for r in got)
    by = {r.page_id: r.text for r in got}
    assert by[2] == "" and by[None] == "" and by[1].startswith("Title")
    assert H.extract_main_text(df.limit(0), model).count() == 0


ARTICLE = "<article><h1>Title</h1>" + "".join(f"<p>Paragraph {i} of the article has a fair number of words in it, as text has.</p>" for i in range(4)) + "</article>"


@pytest.mark.parametrize(
    "page",
    [
        f"<html><head><title>T</title><meta charset=utf-8>{ARTICLE}",
        f"<html><head><title>T</title></head><body><noscript>{ARTICLE}</body></html>",
        f"<html><body><button>{ARTICLE}</body></html>",
        f"<html><body><video/>{ARTICLE}</body></html>",
        f"<html><body><noscript>Enable scripts</noscript><video><p>No video</p></video>{ARTICLE}</body></html>",
        f"<html><head><noscript><style>x</style></noscript><title>T</title></head><body><NOSCRIPT>{ARTICLE}</body></html>",
    ],
)
def test_heads_and_silent_elements_without_end_tags(model, page):
    lines = H.main_text(page, model).split("\n")
    assert lines == ["Title", *(f"Paragraph {i} of the article has a fair number of words in it, as text has." for i in range(4))]


def test_text_ends_a_head():
    assert [line for _, line, _ in H.Dom("<head><title>T</title>loose words<p>more</p>").lines] == ["loose words", "more"]


def test_pages_with_many_siblings(model):
    """Each paragraph of a long article stays, in time in proportion to their number."""
    for n in (80, 300, 5000):
        words = [f"Paragraph {i} of the article has a fair number of words in it, as text has, {'and more of it ' * (i % 5)}here." for i in range(n)]
        page = PAGE.replace("<p>Second", "".join(f"<p>{w}</p>" for w in words) + "<p>Second")
        got = H.main_text(page, model).split("\n")
        assert got[2 : n + 2] == words and len(got) == n + 4


def test_lines_of_held_out_pages_match_their_truth(spark, model):
    """extract_main_text() against what a maker of pages meant, page by page."""
    maker, rows, want = H.Pages(99), [], []
    for i in range(40):
        page = maker.page()
        dom = H.Dom(page)
        rows.append((i, "u", page, "x"))
        want.append("\n".join(line for n, line, _ in dom.lines if n.label))
    df = spark.createDataFrame(rows + [(None, None, None, "x")], "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in H.extract_main_text(df).collect()}
    assert sum(got[i].text == w for i, w in enumerate(want)) >= 36 and (got[None].text, got[None].n_chars) == ("", 0)
