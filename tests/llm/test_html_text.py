import html
import re
import time

import pytest
from pyspark.sql import functions as F

from copyloom.llm.html_text import extract, main_text

COLUMNS = "page_id long, url string, html string"


def plain(page):
    """For the given tables: what lies in their article element, blocks by p and h1."""
    article = re.search(r"<article>(.*)</article>", page, re.S)[1]
    blocks = re.split(r"</?(?:p|h1)>", article)
    blocks = [" ".join(html.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", b))).split()) for b in blocks]
    return "\n\n".join(b for b in blocks if b)


def test_whole_table(spark, middle):
    pages = spark.read.parquet(f"{middle}/pages.parquet")
    rows = {r.page_id: r for r in extract(pages).collect()}
    for r in pages.collect():
        assert rows[r.page_id].text == plain(r.html) and rows[r.page_id].url == r.url and rows[r.page_id].n_chars == len(plain(r.html))


LONG = "Some words of an article that goes on for a while, with commas. " * 4
PARAGRAPHS = "".join(f"<p>{LONG}{i}</p>" for i in range(4))
TEXT = "\n\n".join(f"{LONG}{i}" for i in range(4))
MENU = "<ul>" + "".join(f"<li><a href=x>Menu entry {i}</a></li>" for i in range(9)) + "</ul>"


@pytest.mark.parametrize(
    "page",
    [
        f"<body><div id=top>{MENU}</div><div id=content>{PARAGRAPHS}</div><div class='site-footer'>c</div></body>",
        f"<body><div>{MENU}</div><div><div>{PARAGRAPHS}</div><div>{MENU}</div></div></body>",
        f"<main>{PARAGRAPHS}<aside>{LONG}</aside></main><section id='comments'><p>{LONG * 9}</p></section>",
        f"<body><header><h1>Site</h1></header><article>{PARAGRAPHS}<div class='comment-list'><p>{LONG * 9}</p></div></article><form>{LONG}</form>",
        f"<div class='cookie-notice'>{LONG * 9}</div>{PARAGRAPHS}<script>if (a < b) '<p>x</p>'</script><style>p{{}}</style><div hidden>{LONG}</div>",
        f"<article>{PARAGRAPHS.replace('</p>', '')}</article>",
    ],
)
def test_articles(page):
    assert main_text("<!DOCTYPE html><html><head><title>t</title></head>" + page) == TEXT


def test_blocks_and_references():
    page = "<article><h1>A &amp; B&nbsp;&#67;</h1><p>a <b>b\n\tc</b><br>d &lt;p&gt; &am 1 < 2<ul><li>x<li>y</ul><!-- no --><p>last"
    assert main_text(page) == "A & B C\n\na b c d <p> &am 1 < 2\n\nx\n\ny\n\nlast"
    assert main_text("just text &copy;") == "just text ©"
    assert main_text("<table><tr><td>a b<td>c</table>") == "a b\n\nc"
    assert main_text("<p") == main_text("<!--") == main_text("<script>x") == ""


def test_deep_and_long_pages():
    assert main_text("<div>" * 20_000 + "deep") == "deep"
    assert main_text("<p>" + "<b>" * 20_000 + "x" + '<a href="' * 2000) == "x"
    assert len(main_text("<article>" + "<p>word</p>" * 100_000)) == 100_000 * 6 - 2


def test_nulls_and_repeated_rows(spark):
    rows = [(1, "u", None), (1, "u", ""), (None, None, "<p>x</p>"), (2, "v", "<p>x</p>"), (2, "v", "<p>x</p>")]
    df = spark.createDataFrame(rows, COLUMNS).withColumn("text", F.lit("clash")).withColumn("page", F.lit(1))
    out = sorted(((r.page_id, r.url, r.text, r.n_chars) for r in extract(df).collect()), key=str)
    assert out == sorted([(1, "u", "", 0), (1, "u", "", 0), (None, None, "x", 1), (2, "v", "x", 1), (2, "v", "x", 1)], key=str)
    assert extract(spark.createDataFrame([], COLUMNS)).count() == 0


HALF = "".join(f"<p>{LONG}{i}</p>" for i in range(2))
SECOND = "".join(f"<p>{LONG}{i}</p>" for i in range(2, 4))


@pytest.mark.parametrize(
    ("page", "expected"),
    [
        (f"<body><h1>Title</h1><div>{PARAGRAPHS}</div></body>", "Title\n\n" + TEXT),
        (f"<body><div>{MENU}</div><div><h1>Title</h1></div><div>{PARAGRAPHS}</div></body>", "Title\n\n" + TEXT),
        (f"<body><section>{HALF}</section><section>{SECOND}</section></body>", TEXT),
        (f"<body><div><div>{HALF}</div></div><h2>Part</h2><section>{SECOND}<p>Short.</p></section></body>", f"{LONG}0\n\n{LONG}1\n\nPart\n\n{LONG}2\n\n{LONG}3\n\nShort."),
        (f"<body><div>{PARAGRAPHS}</div><h3>Elsewhere</h3>{MENU}</body>", TEXT),
    ],
)
def test_no_article_element(page, expected):
    assert main_text(page) == "\n\n".join(" ".join(b.split()) for b in expected.split("\n\n"))


@pytest.mark.parametrize("name", ["content has-sidebar", "layout with-sidebar", "no-sidebar", "page-with-comments", "has-related", "sidebar-left", "comments-open"])
def test_wrappers_named_for_their_parts(name):
    parts = f"<div class=sidebar>{LONG}</div><div class='comment-list'>{LONG * 9}</div>"
    assert main_text(f"<body><div class='{name}'><article>{PARAGRAPHS}</article>{parts}</div></body>") == TEXT
    assert main_text(f"<body><div id='{name}'><h1>Title</h1><div>{PARAGRAPHS}</div>{parts}</div><p>c</p></body>") == "Title\n\n" + TEXT


def test_named_parts_that_are_no_frame():
    comments = f"<div class='comments'>{f'<article><p>{LONG}</p></article>' * 20}</div>"
    assert main_text(f"<body><div>{PARAGRAPHS}</div>{comments}</body>") == TEXT
    assert main_text(f"<body><div class=sidebar><article>{LONG}</article></div><article>{PARAGRAPHS}</article></body>") == TEXT
    assert main_text(f"<main><p>{LONG * 4}</p><div class=related><article><p>{LONG}</p></article></div></main>") == (LONG * 4).strip()
    assert main_text(f"<main><div class='page sidebar-left'><article>{PARAGRAPHS}</article></div></main>") == TEXT


@pytest.mark.parametrize(
    "part",
    [
        "<h2 id='related-work'>Part</h2>",
        "<h2 class='section-header'>Part</h2>",
        f"<section id='search-algorithms'><p>{LONG}x</p></section>",
        f"<section id='related'><h2>Related</h2><p>{LONG}x</p></section>",
        f"<section id='advert-history-of-x'><h2>Advert history of X</h2><p>{LONG}x</p></section>",
        f"<div class='section-header'><h2>Part</h2></div><p>{LONG}x</p>",
        "<h2 id='comments-on-x'>Part</h2>",
    ],
)
def test_names_made_from_headings(part):
    words = " ".join(re.sub("<[^>]*>", " ", part).split())
    for page in (f"<article>{PARAGRAPHS}{part}<p>{LONG}9</p></article>", f"<main>{PARAGRAPHS}{part}<p>{LONG}9</p></main>"):
        assert " ".join(main_text(page).split()) == " ".join(f"{TEXT} {words} {LONG}9".split())


@pytest.mark.parametrize("name", ["comments", "comment-list", "related-posts", "share-buttons", "ad-slot-3", "newsletter", "sidebar"])
def test_parts_inside_an_article(name):
    for attribute in ("class", "id"):
        part = f"<div {attribute}={name}><h3>Comments</h3><p>{LONG * 2}</p></div>"
        assert main_text(f"<article>{PARAGRAPHS}{part}</article>") == TEXT


def test_parts_beside_an_article():
    one, two = f"<article>{HALF}</article>", f"<article>{SECOND}</article>"
    assert main_text(f"<body><div>{MENU}</div><div>{one}{two}</div></body>") == TEXT
    assert main_text(f"<body><main>{one}<div>{two}</div>{MENU}</main></body>") == TEXT
    assert main_text(f"<main><p>Intro.</p><article>{PARAGRAPHS}</article><p>Short.</p></main>") == "Intro.\n\n" + TEXT
    teaser = "<article><h3><a href=x>Other news of the day</a></h3><p>Read on</p></article>"
    assert main_text(f"<body>{MENU}<article>{PARAGRAPHS}</article>{teaser * 3}<div>{LONG}</div></body>") == TEXT


def test_formulas_and_literal_text():
    math = "<math><semantics><mrow><mi>a</mi><mo>+</mo><mi>b</mi></mrow><annotation>\\a+b</annotation></semantics></math>"
    assert main_text(f"<article><p>Sum {math} here</p><xmp>a <b> &amp; c</xmp></article>") == "Sum a+b here\n\na <b> &amp; c"


def test_time_of_failing_searches():
    began = time.process_time()
    assert main_text("<div>" * 40_000 + "deep") == "deep"
    assert main_text("<b>x</i></p>" * 40_000) == "x" * 40_000
    assert main_text("<div>" * 20_000 + "<option>a" * 20_000 + "</select></ul>" * 20_000) != ""
    assert time.process_time() - began < 20
