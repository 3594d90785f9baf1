"""Main text of odd pages: what is expected is written out; densities are checked against a recursive version."""

import math
import random
import time

import pytest

from folioforge.llm import html_density

WORDS = "word " * 60


def paras(n, first=0):
    return "".join(f"<p>p{i} {WORDS}</p>" for i in range(first, first + n))



ARTICLE = f"<article><h1>Head</h1>{paras(3)}</article>"
LINKS = "<div><ul>" + "".join(f"<li><a href='/{i}'>link {i}</a></li>" for i in range(9)) + "</ul></div>"
THREE = ["Head", "p0", "p1", "p2"]
PAGES = {
    "omitted end of head": ("<html><head><title>T</title><meta charset=x>" + ARTICLE, THREE),
    "form round the page": (f"<body><form action=x><input>{ARTICLE}<button>Go</button></form>", THREE),
    "form round a page of divisions": (f"<body><form><label>L</label><div><h1>Head</h1>{paras(3)}</div><select><option>o</select></form>", THREE),
    "layout class": (f'<body><div class="layout right-sidebar"><div class=sidebar><p>side</p></div>{ARTICLE}</div>', THREE),
    "layout class without article": (f'<body><div class="layout right-sidebar"><div class=sidebar><p>side</p></div><div><h1>Head</h1>{paras(3)}</div></div>', THREE),
    "no sidebar": (f'<body><div class="content no-sidebar">{ARTICLE}</div>', THREE),
    "unclosed button": ("<body><button>Menu " + ARTICLE, THREE),
    "unclosed advert": ("<body><div class=ad>Buy " + ARTICLE, THREE),
    "unclosed advert without article": (f"<body><div class=ad>Buy <div><h1>Head</h1>{paras(3)}</div>", THREE),
    "unclosed inline advert": ("<body><span class=ad>Buy " + ARTICLE, THREE),
    "unclosed notice": ('<body><p class="notice">Old' + ARTICLE, THREE),
    "unclosed share": ('<body><ul><li class="share">Old<li>x</ul>' + ARTICLE, THREE),
    "class with a weak word": (f'<body><article><h1>Head</h1><section class="social history">{paras(2)}</section>{paras(1, 2)}</article>', THREE),
    "share buttons": (f'<body><article><h1>Head</h1><div class="social share">Share this</div>{paras(3)}</article>', THREE),
    "camel case": (f'<body><div id="siteNotice">n</div><div class="commentList"><p>c {WORDS}</p></div>{ARTICLE}', THREE),
    "roles": (f'<body><div role="navigation">n</div><div role="main">{ARTICLE}</div><div role="contentinfo">f</div>', THREE),
    "two articles": (f"<body><article><h2>A</h2>{paras(3)}</article><article><h2>B</h2><p>short</p></article>", ["A", "p0", "p1", "p2", "B", "short"]),
    "teasers in an aside": (f"<body>{ARTICLE}<aside><article><p>teaser {WORDS}</p></article></aside>", THREE),
    "comments as articles": (f"<body><article><h1>Head</h1>{paras(3)}</article><section class=comments>" + f"<article><p>c {WORDS * 3}</p></article>" * 5 + "</section>", THREE),
    "long comments without article": (f"<body><div><h1>Head</h1>{paras(3)}</div><div class=comments>" + f"<div><p>c {WORDS * 3}</p></div>" * 5 + "</div>", THREE),
    "divisions side by side": (f"<body><h1>Head</h1><div>{paras(10)}</div><div>{paras(3, 10)}</div>", ["Head", *(f"p{i}" for i in range(13))]),
    "divisions of text": (f"<body><h1>Head</h1><div>x {WORDS * 5}</div><div>y {WORDS * 3}</div>", ["Head", "x", "y"]),
    "menus round divisions": (f"<body>{LINKS}<div><h1>Head</h1><div>{paras(3)}</div><h2>More</h2><div>{paras(2, 3)}</div></div>{LINKS}</body>", ["Head", "p0", "p1", "p2", "More", "p3", "p4"]),
    "paragraphs of the body": (f"<body>{LINKS}<h1>Head</h1>{paras(3)}<p>short</p>{paras(1, 3)}<p>End.</p>{LINKS}", ["Head", "p0", "p1", "p2", "short", "p3", "End."]),
    "menu inside of main": (f"<body><main><div><h1>Head</h1>{paras(3)}</div>{LINKS}</main>", THREE),
    "short paragraphs of an article": (f"<body><article><h1>Head</h1><p>a</p>{paras(1)}<p>b</p><ul><li>i<li>j</ul><blockquote>q</blockquote></article>", ["Head", "a", "p0", "b", "i", "j", "q"]),
    "references": (f"<body><article><h1>Head</h1>{paras(3)}<ul><li>First, <a href=x>a work</a>, 1901<li>Second, <a href=y>more</a>, 1902</ul></article>", [*THREE, "First,", "Second,"]),
    "table layout": (f"<body><table><tr><td>{LINKS}<td><h1>Head</h1>{paras(3)}</table>", THREE),
    "table of an article": (f"<body><article><h1>Head</h1>{paras(1)}<table><tr><th>k<th>v<tr><td>1<td>2</table></article>", ["Head", "p0", "k", "v", "1", "2"]),
    "header and footer of an article": (f"<body><header>Site</header><article><header><h1>Head</h1></header>{paras(3)}<footer>by</footer></article><footer>f</footer>", THREE),
    "notice, form and aside inside": (f'<body><article><h1>Head</h1><div class="notice">n</div>{paras(3)}<form><p>s</p></form><aside>as</aside></article>', THREE),
    "upper case": (f"<BODY><NAV>n</NAV><ARTICLE><H1>Head</H1>{paras(3).upper()}</ARTICLE>", ["Head", "P0", "P1", "P2"]),
    "text after the body": (f"<body>{ARTICLE}</body></html>", THREE),
    "script that holds tags": (f"<body><script>var a='<article><p>no</p></article>';</script>{ARTICLE}", THREE),
    "unclosed script": (f"<body>{ARTICLE}<script>var a='<p>", THREE),
    "comment that holds an article": (f"<body><!-- <article><p>no</p></article> -->{ARTICLE}", THREE),
    "unclosed comment": (f"<body>{ARTICLE}<!-- no", THREE),
    "quoted end of tag": (f"<body><div title='a > b'></div>{ARTICLE}", THREE),
    "unclosed quote": (f"<body><div title='a></div>{ARTICLE}", THREE),
    "unclosed title": (f"<title>T<body>{ARTICLE}", THREE),
    "navigation alone": ("<body><nav><a href=x>a</a> text</nav><footer>some text</footer>", [""]),
    "cookie notice alone": ("<body><div class=cookie><p>We use cookies</p></div>", [""]),
    "markup that isn't": (f"<article><p>a < b and 1 <2 {WORDS}<p>c</article>", ["a", "c"]),
    "hidden parts": (f"<body><noscript><p>on</p></noscript><template><p>t</p></template><article><h1>Head</h1><svg><text>s</text></svg>{paras(3)}</article>", THREE),
}


@pytest.mark.parametrize("name", PAGES)
def test_odd_pages(name):
    page, want = PAGES[name]
    assert [b.split(" ")[0] for b in html_density.main_text(page).split("\n\n")] == want


def test_blocks():
    assert html_density.main_text("<article><p>One &amp; two<b> bold<br>next<p>Three &lt;x&gt; &notacode; &#8364;&nbsp;5</article>") == "One & two bold next\n\nThree <x> ¬acode; € 5"
    assert html_density.main_text("<article><b><p>One</b> two</p>three <hr>four <i>fi</i>ve</article>") == "One two\n\nthree\n\nfour five"
    assert html_density.main_text("plain  text") == "plain text"
    assert html_density.main_text(None) == html_density.main_text("") == html_density.main_text("<div></div>") == ""
    assert html_density.main_text("<p>" + "long " * 50000).count("long") == 50000


BAD = {
    "deep": "<div>" * 20000 + "deep",
    "cut tags": "<a " * 20000,
    "quotes": "<p>text</p>" + "<a '>' " * 20000 + '"',
    "inline over blocks": "<b><div>" * 8000 + "x" + "</b>" * 8000,
    "paragraph outside of a cell": "<p><table><td>" + "<div>" * 20000,
    "lists": "<ul><li>x" * 10000,
    "titles": "<title>" * 20000,
    "comments": "<!-- x " * 20000,
    "menus": "<p>x</p>" * 10000 + "<nav>y</nav>" * 10000,
    "end tags": "<div>" * 5000 + "</p></b>" * 40000,
    "cells": "<table>" + "<tr><td><b>x" * 10000,
    "a megabyte": ("<div><p>text <b>bold <i>it <span class=x>s <li>l <td>c " * 20000)[:1_000_000],
}


def test_bad_pages_take_linear_time():
    for name, page in BAD.items():
        began = time.time()
        html_density.main_text(page)
        assert time.time() - began < 12, name  # far below what a quadratic reading takes; about 2 s at most on a quick machine


def random_tree(rng, depth=0):
    kind = rng.choice(["p", "p", "div", "div", "a", "b", "section"]) if depth else "div"
    kids = [random_tree(rng, depth + 1) if depth < 4 and kind != "a" and rng.random() < 0.6 else "t" * rng.randrange(1, 80) for _ in range(rng.randrange(1, 5))]
    return kind if kind != "p" or all(isinstance(k, str) for k in kids) else "div", kids


def written(tree):
    return tree if isinstance(tree, str) else f"<{tree[0]}>{''.join(map(written, tree[1]))}</{tree[0]}>"


def test_densities_by_recursion():
    rng = random.Random(7)
    for _ in range(200):
        tree = ("body", [random_tree(rng) for _ in range(3)])

        def inside(t):
            return [t] if isinstance(t, str) else [x for k in t[1] for x in (([k] if not isinstance(k, str) else []) + inside(k))]

        def measured(t):
            chars = len(t) if isinstance(t, str) else sum(measured(k)[0] for k in t[1])
            if isinstance(t, str):
                return chars, 0
            return chars, chars if t[0] == "a" else sum(measured(k)[1] for k in t[1])

        page_chars, page_links = measured(tree)
        densities = []

        def walk(t, path):
            c, lc = measured(t)
            below = [x for x in inside(t) if not isinstance(x, str)]
            tags, links = max(1, len(below)), sum(x[0] == "a" for x in below) + (t[0] == "a")
            linked = max(lc / c, 1 / 1000) * max(min(1, links / tags), 1 / 50)
            base = math.log(c / max(1, c - lc) * lc + page_links / page_chars * c + math.e)
            mine = [c / tags * max(0, -math.log(linked)) / (1 + math.log(base)), 0.0, path]
            densities.append(mine)
            for k in t[1]:
                if not isinstance(k, str):
                    mine[1] += walk(k, [*path, mine])
            return mine[0]

        walk(tree, [])
        order, stream = html_density.parse("".join(map(written, tree[1])))
        order = html_density.leave_out(order, stream)
        html_density.measure(order)
        assert [n.density for n in order] == pytest.approx([d[0] for d in densities])
        assert [n.total for n in order] == pytest.approx([d[1] for d in densities])
        threshold = html_density.content(order)[1]
        core = order[0].best
        assert core.total == pytest.approx(max(d[1] for d in densities))
        own = next(d for d, n in zip(densities, order, strict=True) if n is core)
        assert threshold == pytest.approx(min(d[0] for d in [*own[2], own]))


def test_extract(spark):
    page = PAGES["two articles"][0]
    rows = html_density.extract(spark.createDataFrame([(1, None, None, "e"), (2, "u", page, "e"), (2, "u", page, "e")], "page_id long, url string, html string, text string")).collect()
    assert [r["n_chars"] for r in rows] == [0, *[len(html_density.main_text(page))] * 2]
    assert html_density.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


MARKS = "comments reader-comments post-comments user-comments comment-thread commentlist entry-comments respond ad-slot google-ad article-ad ad advert sponsored-content promo privacy-notice cookie-notice related-posts author-menu sidebar newsletter-signup".split()


@pytest.mark.parametrize("mark", MARKS)
def test_marked_parts_of_articles_go(mark):
    """Inside of an article, and behind one that is shorter; elements that hold the article, or its heading, stay whatever their marks."""
    own = "<h1>Head</h1><p>One sentence of the text, and some more of it.</p>"
    loud = "<p>Some words of a reader, many more than the article itself has, and again as many of them.</p>" * 4
    for page in (
        f"<body><article>{own}<div class='{mark}'>{loud}</div></article></body>",
        f"<body><div><article>{own}</article></div><section class='{mark}'>{loud}</section></body>",
        f"<body><div class='x-{mark}-layout'><article>{own}</article></div></body>",
        f"<body><div class='post has-{mark}-below'><article>{own}<div class='{mark}'>{loud}</div></article></div></body>",
    ):
        assert html_density.main_text(page) == "Head\n\nOne sentence of the text, and some more of it."
