from __future__ import annotations

import subprocess
import sys

import html as entities
import re

import pytest
from helpers import DATA, prose

from pyspark import cloudpickle

from footfall.llm.queries import QUERIES
from footfall.llm import style_tree
from footfall.llm.style_tree import extract, importance, low_branches, main_text, node_features

LONG = prose(1, 60)
PAGES = "page_id long, url string, html string, text string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], PAGES)


@pytest.mark.parametrize(("page", "text"), [
    ("", ""),
    ("plain text", "plain text"),
    ("<p>one<p>two", "one\ntwo"),
    ("<p>a<b>b</b>c<br>d</p>", "abc d"),
    ("<article><h1> A&amp;B&nbsp; C </h1><p>x\n\ty</p></article><p>out</p>", "A&B C\nx y"),
    ("<article><p>a</p><nav>n</nav><div class='ad-box'>buy</div><p>b</p><aside>s</aside><form>f</form><footer>z</footer></article>", "a\nb"),
    ("<article><p>1 < 2 and 3 > 2<script>var t='</p>'</script></p><style>p{}</style><!-- <p>no</p> --><p>end", "1 < 2 and 3 > 2\nend"),
    ("<main><section><p>a</section></main><div id='comments'><p>c</div>", "a"),
    ("<body><header>h</header><div><p>a</p>b<p>c</p></div><div class='cookie notice'>k</div></body>", "a\nb\nc"),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "a\nb\nc\nd"),
    ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"),
    ("<article><p>x</p><p hidden>y</p><p style='display: none'>z</p></article>", "x"),
    ("<article>a<p>b</p></article><article>c</article>", "a\nb\nc"),
    ("<script>only", ""),
    ("<p>unclosed <b", "unclosed"),
    ("<ARTICLE><P>up</P></ARTICLE>", "up"),
    ("<body><header>site</header><article><header class='header'><h1>T</h1></header><p>x</p><footer>f</footer></article>", "T\nx"),
    ("<p>where <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>x=1</annotation></math> holds</p>", "where x=1 holds"),
    ("<body><form action='/'><nav>n</nav><article><h1>T</h1><p>x</p></article><input name='q'></form></body>", "T\nx"),
    (f"<body><nav>n</nav><form id='aspnet'><h1>T</h1><p>{LONG}</p><form>search</form></form><div>c 2024</div></body>", f"T\n{LONG}\nc 2024"),
    (f"<body><h1>T</h1><p>{LONG}</p><form class='f'><label>name</label><select><option>o</select></form></body>", f"T\n{LONG}"),
    ("<body><h1>T</h1><p>short</p><div id='comments'>" + f"<div class='comment'><p>{LONG}</p></div>" * 40 + "</div></body>", "T\nshort"),
    ("<article><p>short</p></article><ol class='comment-list'>" + f"<li>{LONG}</li>" * 40 + "</ol>", "short"),
    (f"<body><div class='comments'><p>{LONG}</p></div></body>", LONG),
    (f"<body><div class='comments'><main><p>x</p></main></div><div class='respond'>{LONG}</div></body>", "x"),
    ("<div " * 3 + "<p>&lt;p&gt;&#233;&copy;</p>", "<p>é©"),
])
def test_blocks_of_a_page(page, text):
    assert main_text(page) == text


def simple(page):
    """The article of the test pages, whose tags are few."""
    inner = page[page.index("<article>") + 9 : page.rindex("</article>")]
    inner = re.sub(r"<[^>]*>", "", re.sub(r"<br>", " ", re.sub(r"</?(?:p|h1)>", "\n", inner)))
    return "\n".join(x for x in (re.sub(r"\s+", " ", entities.unescape(line)).strip() for line in inner.split("\n")) if x)


@pytest.mark.parametrize("folder", [DATA, "/root/testdata/sf0.1"])
def test_query_over_a_whole_table(spark, folder):
    rows = {r.page_id: r for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    got = QUERIES["op9_html_text"](spark, folder).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.url, r.text, r.n_chars) == (rows[r.page_id].url, simple(rows[r.page_id].html), len(r.text))


def plain_site(n):
    """Pages without telling tags: a frame that repeats, and contents of their own."""
    frame = "<div class='top'><p>Site of all things</p><p>Contact us today</p></div>"
    return [(i, f"http://Frame.example/{i}", f"<body>{frame}<div class='story'><p>{prose(i, 12)}</p><p>{prose(900 + i, 9)}</p></div><div class='low'>All rights reserved</div></body>") for i in range(n)]


def test_entropies_find_the_frame(spark):
    rows = plain_site(30)
    df = pages(spark, rows)
    got = {r.page_id: r.text for r in extract(df).collect()}
    assert got == {i: f"{prose(i, 12)}\n{prose(900 + i, 9)}" for i in range(30)}
    nodes = importance(node_features(df.selectExpr("'h' as host", "html")))
    found = {r.path: r.importance for r in nodes.collect()}
    assert found["/body/div.story/p"] > 0.85 > 0.2 > found["/body/div.top"]
    assert set(low_branches(nodes).first().removed) == {"/body/div.top", "/body/div.top/p", "/body/div.low"}


def test_small_sites_and_copies_keep_their_text(spark):
    few = pages(spark, plain_site(3))
    assert all("Contact" in r.text for r in extract(few).collect())
    same = pages(spark, [(i, "http://copy.example/", "<body><div><p>always this</p></div></body>") for i in range(40)])
    assert {r.text for r in extract(same).collect()} == {"always this"}


def test_odd_rows_and_empty_table(spark):
    long = "<article>" + "".join(f"<p>{prose(i, 40)}</p>" for i in range(600)) + "</article>"
    deep = "<div>" * 3000 + "deep" + "</div>" * 3000
    df = pages(spark, [(1, None, None), (2, "", ""), (3, "no host", long), (None, "http://a/", "<p>x"), (4, "http://a/", "<p>x"), (4, "http://a/", "<p>x"), (5, "//u:p@B.c:80/x", deep)])
    got = extract(df)
    assert got.columns == ["page_id", "url", "text", "n_chars"] and got.count() == 7
    told = {r.page_id: r.text for r in got.collect()}
    assert told[1] == told[2] == "" and told[3].count("\n") == 599 and told[4] == "x" and told[5] == "deep"
    assert extract(df.limit(0)).count() == 0


@pytest.mark.parametrize(("page", "text"), [
    (f"<body><div class='site has-sidebar'><p>{LONG}</p><div class='sidebar'>s</div></div></body>", LONG),
    (f"<body><div class='layout no-sidebar'><article><p>{LONG}</p></article></div></body>", LONG),
    (f"<body><div class='sidebar-left'><article><p>a</p></article></div><p>{LONG}</p></body>", None),
    (f"<body><div class='form'><main><p>a</p></main></div><p>{LONG}</p></body>", None),
    (f"<body><div class='widget'><p>{LONG}</p></div><p>foot</p></body>", f"{LONG}\nfoot"),
    ("<body><div class='notice'><p>all there is</p></div></body>", "all there is"),
    ("<article><h2 id='related-work'>Related</h2><p>a</p><section id='social-history'><p>b</p></section></article>", "Related\na\nb"),
    ("<article><h2 id='notice'>Notice</h2><p>the <span class='form'>plural form</span> of a word</p></article>", "Notice\nthe plural form of a word"),
    (f"<article><div class='article-header'><h1>T</h1></div><p>{LONG}</p><div class='comment-list'>c</div><div id='share_buttons'>s</div></article>", f"T\n{LONG}"),
    (f"<body><p>{LONG}</p><div class='comments'><div class='comment'>{prose(2, 40)}</div><div class='comment'>{prose(3, 40)}</div></div></body>", LONG),
])
def test_words_of_classes_need_the_amount_of_text(page, text):
    got = main_text(page)
    assert got == text if text is not None else "a" in got.split("\n")


def test_entropies_confirm_a_long_named_branch(spark):
    named = f"<div class='widget'><p>{prose(7, 90)}</p></div>"
    df = pages(spark, [(i, "http://w.example/", f"<body>{named}<div><p>{prose(50 + i, 12)}</p></div></body>") for i in range(20)])
    assert {r.page_id: r.text for r in extract(df).collect()} == {i: prose(50 + i, 12) for i in range(20)}


def page_texts(spark, htmls):
    return [r.text for r in extract(pages(spark, [(i, "http://copies.example/", h) for i, h in enumerate(htmls)])).orderBy("page_id").collect()]


def test_near_copies_are_no_frame(spark):
    """One article with a paragraph edited, and one with a teaser or date beside or inside it."""
    story = f"<p>{prose(1, 60)}</p><p>{prose(2, 50)}</p>"
    edited = [f"<article><h1>Same title</h1>{story}<p>{prose(100 + i, 12)}</p></article>" for i in range(40)]
    assert page_texts(spark, edited) == [f"Same title\n{prose(1, 60)}\n{prose(2, 50)}\n{prose(100 + i, 12)}" for i in range(40)]
    beside = [f"<body><article><h1>Same title</h1>{story}</article><div class='more'><p>{prose(100 + i, 12)}</p></div></body>" for i in range(40)]
    assert page_texts(spark, beside) == [f"Same title\n{prose(1, 60)}\n{prose(2, 50)}"] * 40
    inside = [f"<body><article><h1>Same title</h1>{story}<div class='day'>{prose(100 + i, 8)}</div></article></body>" for i in range(40)]
    assert all(t.startswith(f"Same title\n{prose(1, 60)}\n{prose(2, 50)}") for t in page_texts(spark, inside))


def test_copies_on_a_host_of_other_pages(spark):
    """What only the copies of one article hold stays; the frame inside the other articles goes."""
    frame = "<div class='about'>About the writer</div>"
    copies = [f"<article><h1>One</h1><section><p>{prose(1, 60)}</p></section><p>{prose(100 + i, 6)}</p>{frame}</article>" for i in range(15)]
    others = [f"<article><h1>Title {i}</h1><p>{prose(200 + i, 40)}</p>{frame}</article>" for i in range(25)]
    got = page_texts(spark, copies + others)
    assert got[:15] == [f"One\n{prose(1, 60)}\n{prose(100 + i, 6)}" for i in range(15)]
    assert got[15:] == [f"Title {i}\n{prose(200 + i, 40)}" for i in range(25)]


def test_articles_alike_in_their_blocks_keep_them(spark):
    """Distinct orders of the same blocks: no near copies, yet no block differs."""
    blocks = [f"<p>{prose(i, 5)}</p>" for i in range(12)]
    rows = [f"<body><article>{''.join(blocks[i:] + blocks[:i])}</article><p>{prose(300 + i, 9)}</p></body>" for i in range(12)]
    assert all(t.count("\n") == 11 for t in page_texts(spark, rows))


TEASER = "<article><h3>More</h3><p>elsewhere</p></article>"


@pytest.mark.parametrize(("page", "text"), [
    (f"<main><p>{LONG}</p></main>{TEASER * 3}", LONG),
    (f"<body><div class='story'><p>{LONG}</p></div><div class='related'>{TEASER * 2}</div></body>", LONG),
    (f"<body><div class='story'><p>{LONG}</p></div>{TEASER}</body>", f"{LONG}\nMore\nelsewhere"),
    (f"<body><p>{LONG}</p><article class='teaser'><p>{prose(2, 30)}</p></article><article class='post-card'>c</article></body>", LONG),
    (f"<main><article><p>{LONG}</p></article><div><p>{prose(2, 20)}</p></div></main>", LONG),
    (f"<article><p>{LONG}</p><article id='comment-7'><p>first</p></article></article>", LONG),
    (f"<body><p>{LONG}</p><div id='comments'><article class='comment'>{prose(2, 20)}</article></div></body>", LONG),
    ("<body>" + "".join(f"<article class='card'><p>{prose(i, 9 + i)}</p></article>" for i in range(8)) + "<p>foot</p></body>", "\n".join(prose(i, 9 + i) for i in range(8))),
    ("<main></main><div><article><p>a</p></article></div>", "a"),
    (f"<main><p>intro</p></main><article><p>{LONG}</p></article>", LONG),
])
def test_an_article_is_chosen_by_its_text(page, text):
    assert main_text(page) == text


def test_importance_chooses_among_articles_and_the_rest(spark):
    """A longer article that is the same on every page is no main text; a main element that differs is."""
    same = f"<article><p>{prose(7, 90)}</p></article>"
    df = pages(spark, [(i, "http://w.example/", f"<body>{same}<main><p>{prose(50 + i, 60)}</p></main></body>") for i in range(20)])
    assert {r.page_id: r.text for r in extract(df).collect()} == {i: prose(50 + i, 60) for i in range(20)}


def test_functions_travel_without_the_package():
    """What a task is sent loads where the package is not installed."""
    code = "import pickle, sys; sys.path[:] = [p for p in sys.path if 'repo' not in p]; f = pickle.loads(sys.stdin.buffer.read()); print(f('sidebar', frozenset(['sidebar'])))"
    sent = cloudpickle.dumps(style_tree.names_aside)
    done = subprocess.run([sys.executable, "-I", "-c", code], input=sent, capture_output=True, cwd="/", check=False)
    assert done.stdout.strip() == b"True", done.stderr.decode()[-500:]
