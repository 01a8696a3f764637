import html
import re

import pytest
from llm_paths import DATA

from chronoframe.llm import html_text, queries


def article(page):
    """Blocks of the test pages' article, by direct reading."""
    body = re.search(r"<article>(.*?)(</article>|<footer>|\Z)", page or "", re.S)
    blocks = re.split(r"</?(?:p|h1|br|li|ul|div)\b[^>]*>", re.sub(r"</?b>", "", body[1])) if body else []
    return "\n".join(x for x in (" ".join(html.unescape(b).split()) for b in blocks) if x)


def test_articles_of_the_pages(spark):
    rows = {r.page_id: r.html for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    got = queries.op8_html_extraction(spark, DATA).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.text == article(rows[r.page_id]) and r.n_chars == len(r.text)


@pytest.mark.parametrize("page,text", [
    ("", ""), ("<div>", ""), ("<script>var a = '<p>not text</p>'</script>", ""),
    ("<article><p>a &amp; b &eacute; &#x41;\n\t c</p><p>Short.</p></article>", "a & b é A c\nShort."),
    ("<article><header><h1>T</h1></header><section class='article-body'>Text <span>a</span>b<ul><li>one<li>two</ul></section>"
     "<footer>tags</footer></article>", "T\nText ab\none\ntwo"),
    ("<header><a href=/>Home</a></header><main><h1>Head</h1><p>Body text.<aside>More</aside><p>End</main><footer>f</footer>",
     "Head\nBody text.\nEnd"),
    ("<body class='has-sidebar'><div class='cookie-notice'>We use cookies here and there to make you give in at last now.</div>"
     "<div class='content'><h2>Title</h2><p>One two.</p><form><label>Mail</label></form>"
     "<div class='comments'><article><p>Nice post that I read.</p></article></div></div>", "Title\nOne two."),
    ("<article><p>x<!-- <p>hidden</p> -->y</p><div hidden>no</div><div style='display: none'>no</div></article><!-- open", "xy"),
    ("<nav>menu<article><p>Inside</p></article>", "Inside"),
    ("<p>" + "word " * 30 + "</p><p>and a tail</p><ul><li><a href=a>x</a></li><li><a href=b>y</a></li></ul>", ("word " * 30).strip() + "\nand a tail"),
    ("<article><p>1 < 2 and <b>bold</b></article>", "1 < 2 and bold"),
])
def test_pages(page, text):
    assert html_text.main_text(page, html_text.fit_tree()) == text


def test_edges(spark):
    rows = [(1, "u", None, "t"), (1, "u", None, "t"), (None, None, "<article>" + "<p>long text</p>" * 20000, "t"), (2, "v", "<p", "t")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html_text.extract(pages).collect()
    assert sorted(r.n_chars for r in got) == [0, 0, 0, 20000 * 10 - 1]
    assert html_text.extract(pages.limit(0)).collect() == []


def test_tree_fits_its_table():
    table = html_text.labelled_blocks()
    tree = html_text.fit_tree(table)
    import numpy as np
    x = np.array(table, float)
    assert (tree.predict(x[:, :-1]) == x[:, -1]).mean() > 0.97


PROSE = " ".join(f"word{i}" for i in range(50))


@pytest.mark.parametrize("page,text", [
    # words, links and neighbours count inside marked regions too
    (f"<article><p>{PROSE}</p><ul><li><a href=a>One more story</a><li><a href=b>Another of them</a></ul></article>", PROSE),
    (f"<div class='page-header-text'><p>{PROSE}</p><p>{PROSE}</p></div>", f"{PROSE}\n{PROSE}"),
    (f"<article><h2><a href=a>A linked headline</a></h2><p>{PROSE}</p></article>", f"A linked headline\n{PROSE}"),
    (f"<footer>All rights are ours.</footer><nav>{PROSE}</nav><form>{PROSE}</form><div hidden>{PROSE}</div>", ""),
    (f"<div class='comments'><p>{PROSE}</p></div>", ""),
    (f"<div class='post comments-open'><p>{PROSE}</p></div>", PROSE),
    # no <article> at all
    (f"<ul><li><a href=/>Home</a><li><a href=b>News</a></ul><h2>Heading</h2><p>{PROSE}</p><p>Then a few.</p><p>{PROSE}</p><div class=ad>Buy now</div>",
     f"Heading\n{PROSE}\nThen a few.\n{PROSE}"),
    (f"<table><tr><td><a href=a>A</a><td>{PROSE}<td><a href=b>B</a></table>", PROSE),
    ("<p>Short.</p><p><a href=a>A</a></p>", ""),
])
def test_the_tree_decides_within_regions(page, text):
    assert html_text.main_text(page, html_text.fit_tree()) == text


@pytest.mark.parametrize("element", [
    "<svg viewBox='0 0 1 1'/>", "<math />", "<svg><use href=#a /></svg>", "<video src=a.mp4>", "<object data=a>", "<audio src='a'>",
    "<svg><svg><text>no</text></svg>no</svg>", "<svg>", "<script src='a.js'/>", "<script>var s = \"<script \";</script>", "<!-- <svg> -->",
    "<script>a = '<svg>'</script>", "<canvas title='a > b'>no</canvas>", "<iframe src=http://a/>no</iframe>"])
def test_dropped_elements_swallow_no_text(element):
    page = f"<article><p>Before.</p>{element}<p>{PROSE}</p><svg>no</svg><p>After.</p></article>"
    assert html_text.main_text(page, html_text.fit_tree()) == f"Before.\n{PROSE}\nAfter."


PARA = "This is a paragraph of the article with more than a dozen words in it, so that it counts as text."


def test_a_form_around_the_page():
    tree = html_text.fit_tree()
    page = f"<body><form id=aspnetForm><div id=nav><a href=x>Home</a></div><article><h1>A title</h1><p>{PARA}</p><p>{PARA}</p></article></form></body>"
    assert html_text.main_text(page, tree) == f"A title\n{PARA}\n{PARA}"
    page = f"<body><article><h1>A title</h1><p>{PARA}</p><p>{PARA}</p></article><form>Your name and address, please</form></body>"
    assert html_text.main_text(page, tree) == f"A title\n{PARA}\n{PARA}"
    assert html_text.main_text("<form><label>Name</label><label>Mail address</label></form>", tree) == ""


def test_what_stands_inside_an_article_belongs_to_it():
    tree = html_text.fit_tree()
    links = "".join(f"<li><a href=r{i}>Reference number {i}</a></li>" for i in range(4))
    page = f"<article><h1>A title</h1><p>{PARA}</p><ul>{links}</ul><p>Why?</p><p>{PARA}</p></article>"
    got = html_text.main_text(page, tree).split("\n")
    assert got == ["A title", PARA, *[f"Reference number {i}" for i in range(4)], "Why?", PARA]
    page = f"<article><h1>A title</h1><p>{PARA}</p><ul class=related>{links}</ul><p>{PARA}</p></article>"
    assert html_text.main_text(page, tree) == f"A title\n{PARA}\n{PARA}"


def test_linear_time():
    import time
    tree = html_text.fit_tree()
    size = 1_000_000
    for part in ("<svg \"' ", "<svg \"'>", "<script ", "<script>", "</script ", "<!--", "<a \"'>x", "<svg>", "<div>", "</p>", "<p class=\"'>", "'<b \">"):
        page = part * (size // len(part))
        began = time.process_time()
        html_text.main_text(page, tree)
        assert time.process_time() - began < 12, part
    page = "<div>" * 60_000 + "</p>" * 60_000
    began = time.process_time()
    html_text.main_text(page, tree)
    assert time.process_time() - began < 12
