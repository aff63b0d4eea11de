import html
import re
import time

import pytest
from conftest import ROOT

from commerce_marts.llm import html_blocks, queries
from commerce_marts.llm.html_blocks import main_text


def test_pages_give_their_articles(spark):
    for r in queries.op4_main_text(spark, ROOT).join(spark.read.parquet(f"{ROOT}/pages.parquet").select("page_id", "html"), "page_id").collect():
        article = re.search(r"<article>(.*?)(</article>|$)", r["html"], re.S).group(1)
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", p)).split()) for p in re.split(r"</?(?:p|h1|br)[^>]*>", article)]
        assert r["text"] == "\n".join(p for p in parts if p) and r["n_chars"] == len(r["text"])


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""),
        ("plain words only", "plain words only"),
        ("<nav>Home</nav><article><h1>T</h1><p>a  b\n c</p><p>x</p></article><footer>f</footer>", "T\na b c\nx"),
        ("<article><p>one<aside>side</aside><p>two<div class='comments'><p>me too, and I write at length</p></div></article>", "one\ntwo"),
        ("<article><script>var a='<p>no</p>'</script><style>p{}</style><p>yes &amp; &lt;b&gt; &#233;&nbsp;!</p></article>", "yes & <b> é !"),
        ("<div class='ad'>buy<article><p>kept</p></article>", "kept"),
        ("<article><p>in <b>bold <i>words</b> go</i> on</p></article>", "in bold words go on"),
        ("<main><form>name<input></form><p>text</p></main>", "text"),
        ("<article><p>cut off <b>here", "cut off here"),
        ("<!-- <article>no</article> --><article><p>a<!-- x -->b</p></article>", "ab"),
    ],
)
def test_small_pages(page, text):
    assert main_text(page) == text


def test_density_without_an_article():
    body = "".join(f"<p>This is paragraph {i} of a text that is long enough to count as body text.</p>" for i in range(5))
    menu = "".join(f'<li><a href="/{i}">Link {i}</a></li>' for i in range(30))
    got = main_text(f"<div><ul>{menu}</ul><p>Short head</p>{body}</div><ul>{menu}</ul><div class=footer>All rights</div>")
    assert got.split("\n")[0] == "Short head" and len(got.split("\n")) == 6 and "Link" not in got and "rights" not in got


def test_an_article_does_not_hide_text_outside_it():
    body = [f"This is paragraph {i} of a text that stands in a plain division of the page." for i in range(4)]
    inner = "".join(f"<p>{x}</p>" for x in body)
    card = "<article><h3>A card</h3><p>Short.</p></article>"
    assert main_text(f"<nav><a href=/>Home</a></nav><div><h1>Title</h1>{inner}</div>{card}<div>3 min</div>").split("\n") == ["Title", *body, "A card", "Short."]
    assert main_text(f"<div><h1>Title</h1></div><article>{inner}</article><div>3 min</div>").split("\n") == ["Title", *body]
    # Without the bonus the short card does not surge.
    lines = html_blocks.lines_of(f"<div>{inner}</div>{card}")
    assert sum(html_blocks.keep(lines)) == 6 and sum(html_blocks.keep(lines, bonus=0)) == 4


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<article><h2 id="related-work">Related work</h2><p class="comment">a</p><section id="search">b</section><div class="notice">c</div></article>', "Related work\na\nb"),
        ('<div class="page-header"><h1>Title</h1></div><article><p>text</p></article>', "Title\ntext"),
        ('<section id="search"><h2 class="skip">Search</h2><p title="a hidden gem">text</p></section>', "Search\ntext"),
        ('<article><p>text</p><div class="post relatedPosts">x</div><ul class="share-buttons"><li>y</ul><div role="search">z</div><p hidden>h</p></article>', "text"),
        ('<div id="cookie-banner">we use them, and say so at length in this line</div><div class="Sidebar">x</div><div class="notice">n</div><p>text</p>', "text"),
        ('<article><p>see <a href="/a">one article of ours</a></p><ul><li><a href="/b">two</a></ul></article>', "see one article of ours\ntwo"),
    ],
)
def test_names_of_furniture(page, text):
    assert main_text(page) == text


def test_every_text_that_surges_is_kept():
    body = "".join(f"<p>This is paragraph {i} of a text that is long enough to count as body text.</p>" for i in range(20))
    close = "A shorter closing section that stands behind three lines of an advert."
    links = 'Sources: <a href="/a">a report that is named in full length</a>, <a href="/b">another report that is named in full</a>'
    page = f"<div>{body}<div class='ad'><p>a</p><p>b</p><p>c</p></div><p>{close}</p><p>{links}</p><p>{close}</p></div>"
    got = main_text(page).split("\n")
    assert len(got) == 23 and got[-3] == got[-1] == close and got[-2].startswith("Sources: a report")


def test_odd_rows(spark):
    pages = spark.createDataFrame([(1, None, "x"), (1, None, "x"), (2, "", "x"), (3, "<p>" + "long text " * 50_000, "x")], "page_id long, html string, text string")
    got = html_blocks.extract_pages(pages)
    assert got.columns == pages.columns
    assert [len(r["text"]) for r in got.orderBy("page_id").collect()] == [0, 0, 0, 499_999]
    assert html_blocks.extract_pages(pages.limit(0)).count() == 0


BODY = "".join(f"<p>This is paragraph {i} of a text that is long enough to count as body text.</p>" for i in range(3))
TEXT = [f"This is paragraph {i} of a text that is long enough to count as body text." for i in range(3)]
SAID = "<p>I read this with care, and I must say that I could not agree less with what is said here.</p>" * 4


@pytest.mark.parametrize("box", ['div class="comment"', 'div class="notice"', 'section id="reader-comments"', 'div id="comments-section"', 'div class="user-reviews"', 'div class="x userComments"', 'ul aria-label="Reader comments"', 'div class="advert"'])
def test_additions_go_inside_and_behind_articles(box):
    inner = f"<{box}>{SAID}</{box.split()[0]}>"
    for page in (f"<article>{BODY}{inner}</article>", f"<article>{BODY}</article>{inner}", f"<div>{BODY}</div>{inner}", f"<article>{inner}{BODY}</article>"):
        assert main_text(page).split("\n") == TEXT


def test_names_made_from_headings_and_boxes_that_hold_the_text_stay():
    for box in ('section id="comments-on-the-law"', 'div class="review-of-methods"', 'div id="discussion-and-outlook"', 'p class="comment"', 'blockquote class="reply"'):
        assert main_text(f"<article>{BODY}<{box}>kept here</{box.split()[0]}></article>").split("\n") == [*TEXT, "kept here"]
    long_title = "A title of a review that alone is longer than the threshold of text"
    assert main_text(f'<article><h1>{long_title}</h1><p>By A. B.</p><div class="article-review">{BODY}</div></article>').split("\n") == [long_title, "By A. B.", *TEXT]


def test_sums_decide_inside_articles():
    links = "".join(f'<li><a href="/{i}">Another story of ours with a long title, number {i}</a></li>' for i in range(8))
    got = main_text(f"<article>{BODY}<p>One line.</p><ul>{links}</ul></article>").split("\n")
    assert got[:4] == [*TEXT, "One line."] and len(got) <= 5
    few = '<ul><li><a href="/a">One source</a></li></ul>'
    assert main_text(f"<article>{BODY}{few}{BODY}</article>").split("\n") == [*TEXT, "One source", *TEXT]


@pytest.mark.parametrize("page", ["<a " * 100_000 + '"', "<i>" * 50_000 + "</b>" * 100_000, "<div>" * 50_000 + "</p>" * 100_000, "<a b='" * 50_000, "<!--" * 50_000, "</i" * 100_000, "<p>x" * 50_000, "<script>" * 50_000])
def test_broken_markup_takes_time_by_its_length(page):
    began = time.process_time()
    main_text(page)
    assert time.process_time() - began < 2


def test_quotes_without_their_other_half():
    assert main_text('<article><p title="a>b">one</p><p class="x>two</p><p>three</p></article>').startswith("one")
    assert main_text("<article><p>one</p><p it's>two</p></article>") == "one\ntwo"
