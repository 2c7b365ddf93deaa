import html as std
import re

import numpy as np
import pytest

from corrmatch.llm import pages as html

SF = "/root/testdata/sf0.01"


def expected(page):
    """The article of a test page by plain string work: its tags are simple."""
    body = re.search("<article>(.*)</article>", page, re.S)[1]
    blocks = re.split("</?(?:h1|p)>", body)
    texts = (" ".join(std.unescape(re.sub("<[^>]*>", lambda m: " " if m[0] == "<br>" else "", b)).split()) for b in blocks)
    return " ".join(t for t in texts if t)


def test_pages_agree_with_their_articles(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = html.op7_html_extraction(spark, SF).collect()
    assert len(got) == len(pages)
    for r in got:
        assert r.text == expected(pages[r.page_id].html) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


ARTICLE = "Short. " + "A long enough paragraph of the article itself, with words. " * 3


@pytest.mark.parametrize(
    "page",
    [
        "<body><header><h1>Site</h1></header><nav><a href=/>Home</a></nav><main><h2>Title</h2><p>{a}<p>End.</main><footer>c</footer>",
        "<body><div id=top-menu><ul><li><a>x</a><li><a>y</a></ul></div><div class=story><h2>Title</h2><p>{a}</p><p>End.</p></div><div class='cookie-notice'>We use cookies on this long long long long page.</div><div id=comments><p>{a}</p></div>",
        "<article><h2>Title</h2>{a}<div class=ad>Buy buy</div><aside>side</aside><br>\n<form><label>Mail</label><input></form><p>End.</p><script>var x='</p>'</script><section class='comment-list'><p>Nice!</p></section></article>",
        "<table><tr><td class=sidebar>left<td><h2>Title</h2><p>{a}<p>End.</table>",
        "<main><article><header><h2>Title</h2></header><p>{a}</p><![odd x]><p>End.</p></article><article class=comment><p>{a}</article></main>",
    ],
)
def test_other_layouts(page):
    assert html.main_text(page.format(a=ARTICLE)) == f"Title {ARTICLE.strip()} End."


LONG = "A long paragraph of the text itself, with more than enough words to stand out from all else. " * 4


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<article class='post comments-closed'><p>{a}</p></article><footer>f</footer>", "{a}"),
        ("<div class='content no-sidebar'><h1>Title</h1><p>{a}</p><p>{a}</p></div><footer>Copyright</footer>", "Title {a} {a}"),
        ("<div class=page><div class='article-header'><h1>Title</h1></div><p>{a}</p><p>{a}</p></div><nav>Home</nav>", "Title {a} {a}"),
        ("<div class=page><p>{a}</p><div class='market-share'><p>{a}</p></div></div><footer>f</footer>", "{a} {a}"),
        ("<section><h2>One</h2><p>{a}</p></section><section><h2>Two</h2><p>Short one.</p></section><section><h2>Three</h2><p>{a}</p></section>", "One {a} Two Short one. Three {a}"),
        ("<div><p><a href=/>Home</a><p><a href=/b>Blog</a><p><a href=/c>About</a><h1>Title</h1><p>{a}<p><a href=/r>One link</a><p>{a}</div>", "Title {a} One link {a}"),
        ("<div><ul><li><a href=/>Home</a><li><a href=/b>Blog</a><li><a>About</a></ul></div>", "Home Blog About"),
    ],
)
def test_names_and_short_parts(page, text):
    assert html.main_text(page.format(a=LONG)) == text.format(a=LONG.strip())


def test_the_threshold_decides(monkeypatch):
    page = f"<div><p>{LONG}</p></div><div><p>Home</p><p>Blog</p><p>About</p></div>"
    assert html.main_text(page) == LONG.strip()
    monkeypatch.setattr(html, "threshold", lambda values: 0.0)
    assert html.main_text(page) == f"{LONG.strip()} Home Blog About"


def test_references_and_white_space():
    assert html.main_text("<article><p>a&amp;b &lt;i&gt; &#233;&eacute;&nbsp;\n x<b>y</b>z<br>w &copy</article>") == "a&b <i> éé xyz w ©"


@pytest.mark.parametrize("page", ["", " \n", "<html></html>", "<article></article>", "<nav>x</nav>", "<!-- open", "<![CDATA[", "<"])
def test_pages_without_text(page):
    assert html.main_text(page) in ("", "<")


def test_chunks_do_not_matter(monkeypatch):
    page = "<article><p>one &amp; two</p><script>if (a < b) {}</script><p>" + ARTICLE * 50 + "</article><footer>f</footer>"
    whole = html.main_text(page)
    monkeypatch.setattr(html, "CHUNK", 7)
    assert html.main_text(page) == whole


def test_smoothing_and_threshold():
    assert np.allclose(html.smooth(np.ones(9)), 1)
    x = html.smooth(np.array([0, 0, 0, 1.0, 0, 0, 0]))
    assert np.allclose(x, x[::-1]) and x.argmax() == 3
    assert 10 < html.threshold(np.array([1.0, 2, 3, 50, 60])) < 50


def test_nulls_and_empty_table(spark, tmp_path):
    rows = [(1, "u", None, 1), (None, None, "<p>x", 2), (1, "u", None, 3)]
    spark.createDataFrame(rows, "page_id long, url string, html string, text int").write.parquet(f"{tmp_path}/a/pages.parquet")
    got = sorted(((r.page_id or 0), r.text, r.n_chars) for r in html.op7_html_extraction(spark, f"{tmp_path}/a").collect())
    assert got == [(0, "x", 1), (1, "", 0), (1, "", 0)]
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/b/pages.parquet")
    assert html.op7_html_extraction(spark, f"{tmp_path}/b").count() == 0


@pytest.mark.parametrize(
    "page",
    [
        "<body><div class='layout-no-sidebar'><article><h2>Title</h2><p>{a}<p>End.</article></div>",
        "<body><div class='post has-sidebar'><main class='comments-enabled'><h2>Title</h2><p>{a}<p>End.</main></div>",
        "<body><div class='sidebar'><article class='entry-content share-enabled'><h2>Title</h2><p>{a}<p>End.</article></div><div class=menu>x</div>",
        "<article><h2 id='related'>Title</h2><section id='related-work'><p>{a}</section><section id='share-of-exports'><p>End.</section></article>",
        "<article><div class='entry-header'><h2>Title</h2></div><p id='social-policy'>{a}<p id='navigation-at-sea'>End.</article>",
        "<article><h2>Title</h2><p>{a}<p>End.</p><div class='ad-box'>Buy.</div><div class='shareButtons'>Tell</div></article><div class=related><article>Card.</article></div>",
    ],
)
def test_names_count_as_a_whole(page):
    assert html.main_text(page.format(a=ARTICLE)) == f"Title {ARTICLE.strip()} End."


def test_a_long_advert_stays_out_of_a_short_article():
    assert html.main_text(f"<article><p>Short.</p><div class=ad>{ARTICLE}</div></article>") == "Short."


@pytest.mark.parametrize(
    "page",
    [
        "<body><div><h2>Title</h2><section><p>{a}</section><section><h3>Short.</h3><p>One line.</section><div><p>{a}</div><div>End.</div></div>",
        "<body><div><h2>Title</h2><p>{a}<table><tr><th>Short.<td>One line.</table><div>{a}</div><p>End.</div><div class=footer>x</div>",
        "<body><article><h2>Title</h2><p>{a}</article><article><p>Short.<p>One line.</article><article><p>{a}<p>End.</article>",
    ],
)
def test_short_parts_between_long_ones_stay(page):
    assert html.main_text(page.format(a=ARTICLE)) == f"Title {ARTICLE.strip()} Short. One line. {ARTICLE.strip()} End."
