import re

import pytest

from chainalerts.llm import site_style_tree as S
from chainalerts.llm.queries import QUERIES
from tests.llm.conftest import SF


def text(page):
    return "\n".join(t for _, t in S.main_blocks(page))


@pytest.mark.parametrize("page, want", [
    (None, ""), ("", ""), ("plain &amp; simple", "plain & simple"), ("<p>a<p>b<br>c", "a\nb c"),
    ("<article><h1>T &lt;x&gt;</h1><p>a <b>b</b>\n\t c&nbsp;</p></article><p>out</p>", "T <x>\na b c"),
    ("<nav><p>menu</p></nav><main>m</main><footer>f</footer>", "m"),
    ("<article><p>x</p><div class='ad'>buy</div><aside>s</aside><form>f<input></form><section id=comments><p>c</p></section></article>", "x"),
    ("<script>var t='<p>no</p>';</script><style>p{}</style><p>yes</p><!-- <p>no</p> -->", "yes"),
    ("<article><p>open<div class=sidebar>s</div>end", "open\nend"), ("<ul><li>a<li>b</ul>c", "a\nb\nc"),
    ("<nav>menu <article><p>x</p></article>", "x"), ("<header>site</header><article><header><h1>t</h1></header>x</article>", "t\nx"),
    ("<p title=\"a > b\">x</p><p a='>'>y</p>", "x\ny"), ("a < b and <3 & c &unknown; &#65;&#x42;", "a < b and <3 & c &unknown; AB"),
    ("<article class=comment>c</article><article>x</article>", "x"), ("<p>x</p></div></p><b>y", "x\ny"),
    ("<div role=navigation>n</div><div class='cookie-notice'>c</div><div class='story'>s</div>", "s"), ("x<p", "x"),
    ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"), ("<textarea><p>no</textarea><p>yes", "yes"), ("<!-- never closed <p>x", ""),
])
def test_blocks(page, want):
    assert text(page) == want


@pytest.mark.parametrize("page, want", [
    ("<html class=nav><body class='has-sidebar menu'><p>x</p></body></html>", "x"),
    ("<body class=has-sidebar><article><p>x</p></article></body>", "x"), ("<body class=menu-open><main>x</main>", "x"),
    ("<div id=page class=no-sidebar><h1>t</h1><p>x</p></div>", "t\nx"), ("<article class='post comments-open'>x</article>", "x"),
    ("<main class=sidebar id=menu><p>x</p></main>", "x"), ("<p class=share-price>up</p><p>x <span class=notice>y</span></p>", "up\nx y"),
    # A role around the page's article is none; one beside or in it is.
    ("<div class=sidebar><div class=ad>buy</div><article>x<div class=ad>buy</div></article></div>", "x"),
    ("<div class=widget><p>top</p><main>x</main></div><div class=ad>buy</div><nav>n</nav>", "x"),
    ("<main><div class=menu><article>x</article></div></main>", "x"), ("<main>x<div class=menu><article>m</article></div></main>", "x"),
    ("<form><div>top</div><article>x<form>f</form></article></form>", "x"), ("<form>f</form><p>x</p>", "x"),
    ("<div class=sidebar><article>teaser</article></div><article>x</article>", "x"),
    ("<div class=sidebar><article>teaser</article></div><div>story</div>", "teaser\nstory"),
    ("<div class=story>x</div><ol id=comments><li><article class=comment>c</article></ol>", "x"),
    ("<article>x<ol id=comments><li><article>c</article></ol></article>", "x"), ("<article class=comment>c</article>", "c"),
    ("<div class='ad-banner'>b</div><div class='x sidebar'>s</div><div id=comments>c</div><div class=header>h</div>x", "x"),
])
def test_roles_spare_the_article(page, want):
    assert text(page) == want


def _site(n, host="h.example.com"):
    return [(i, f"http://{host}/{i}", f"<body><div class=top>Welcome to the site</div><div class=story><p>Story {i} has its text {i * 7}."
             f"</p><p>More {i}.</p></div><div class=bottom>All rights reserved</div></body>") for i in range(n)]


def test_boilerplate_of_a_host_goes(spark):
    rows = [*_site(30), *[(100 + i, *r[1:]) for i, r in enumerate(_site(3, "small.example.org"))], (200, None, "<p>x</p>"),
            (201, "http://h.example.com/x", None), (None, "http://h.example.com/y", "<body><div class=top>Welcome to the site</div>")]
    pages = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, host string, text string")
    got = {r["page_id"]: r["text"] for r in S.extract(pages).collect()}
    assert len(got) == len(rows)
    assert got[3] == "Story 3 has its text 21.\nMore 3." and got[201] == got[None] == "" and got[200] == "x"
    # Too few pages to compare: all stays.
    assert got[101].startswith("Welcome to the site\nStory 1 has") and got[101].endswith("All rights reserved")
    tree = {r["path"]: r["importance"] for r in S.style_tree(pages.withColumn("host", S.host_of(S.F.col("url")))).collect()
            if r["host"] == "h.example.com"}
    assert tree["/body/div.top"] < 0.05 < 0.9 < tree["/body/div.story/p"] and tree["/body"] > S.LEAST
    assert S.extract(pages.filter("false")).count() == 0


def test_repeated_rows_and_equal_articles(spark):
    page = "<article><p>Released under a license.</p></article>"
    pages = spark.createDataFrame([(1, "http://a.b/c", page)] * 2, "page_id long, url string, html string")
    assert [r["text"] for r in S.extract(pages).collect()] == ["Released under a license."] * 2


def _texts(spark, html):
    pages = spark.createDataFrame([(i, f"http://h.example.com/{i}", x) for i, x in enumerate(html)], "page_id long, url string, html string")
    return {r["page_id"]: r["text"] for r in S.extract(pages).collect()}


def test_copies_and_wrappers_keep_the_article(spark):
    story = "<p>Story {0} has its text.</p><p>More of {0}.</p>"
    want = "Story {0} has its text.\nMore of {0}."
    # A mirrored page, and many copies of a few.
    assert set(_texts(spark, [f"<body><div>{story.format(1)}</div></body>"] * 20).values()) == {want.format(1)}
    got = _texts(spark, [f"<body><article>{story.format(i % 5)}</article></body>" for i in range(200)])
    assert all(t == want.format(i % 5) for i, t in got.items())
    # Copies of a marked article between other words.
    got = _texts(spark, [f"<body><div>Menu {i}</div><main>{story.format(i % 12)}</main></body>" for i in range(240)])
    assert all(t == want.format(i % 12) for i, t in got.items())
    # Wrappers are the same on every page; the low branch beside the article goes, the article does not.
    for tag in ("article", "section"):
        deep = "<body><div><div><div><div><{1}><p>Only {0}</p></{1}><ul><li>About us</li><li>Contact</li></ul></div></div></div></div></body>"
        assert _texts(spark, [deep.format(i, tag) for i in range(30)]) == {i: f"Only {i}" for i in range(30)}
    # Text outside all elements that is on every page takes nothing with it.
    assert _texts(spark, [f"Welcome<p>Only {i}</p>" for i in range(30)]) == {i: f"Only {i}" for i in range(30)}


def test_few_pages_remove_what_all_of_them_have(spark):
    story = "Story {0} has its text {1}.\nMore {0}."
    for n in (2, 4, 5, 9):
        rest = story if n > 4 else f"Welcome to the site\n{story}\nAll rights reserved"
        assert _texts(spark, [r[2] for r in _site(n)]) == {i: rest.format(i, i * 7) for i in range(n)}
    # A template of three pages stays in a branch whose other pages are all alike.
    page = "<body><div><p>Welcome to {}</p></div></body>"
    got = _texts(spark, [page.format("the site") + "<i>{}</i>".format(i) for i in range(30)] + [
        "<body><div><ul><li>Terms</li></ul><p>Welcome to the site</p></div></body>" + f"<i>x{i}</i>" for i in range(3)])
    assert [got[i] for i in (0, 30)] == ["0", "Terms\nx0"]


def test_text_outside_of_the_article(spark):
    long = "The story of the page, told at length in a block of its own that is more than any teaser of it."
    assert text("<h1>t</h1><h2>u</h2><article>x</article><h2>v</h2><p>out</p>") == "t\nu\nx"
    assert text("<h1>site</h1><nav>n</nav><article>x</article>") == "x"
    assert text(f"<article>teaser</article><div>{long}</div>") == f"teaser\n{long}"
    assert text(f"<article>{long} {long}</article><div>{long}</div>") == f"{long} {long}"
    page = ("<body><div class=top>Welcome</div><h1>Title {0}</h1><article><p>Story {0} in some words.</p></article>"
            "<div class=more>More {0}.</div><div class=bottom>All rights reserved</div></body>")
    want = "Title {0}\nStory {0} in some words.\nMore {0}."
    assert _texts(spark, [page.format(i) for i in range(30)]) == {i: want.format(i) for i in range(30)}
    # The site's own heading is on every page.
    page = "<body><h1>The site</h1><article>Story {0}.</article></body>"
    assert _texts(spark, [page.format(i) for i in range(30)]) == {i: f"Story {i}." for i in range(30)}


def test_query(spark):
    html = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in QUERIES["op1_site_style_tree"](spark, SF).collect():
        article = re.search(r"<article>(.*?)(?:</article>|\Z)", html[r["page_id"]], re.DOTALL)[1]
        parts = [" ".join(S.entities.unescape(re.sub("<[^>]*>", "", x.replace("<br>", " "))).split())
                 for x in re.split("</?(?:p|h1)>", article)]
        assert r["text"] == "\n".join(p for p in parts if p) and r["n_chars"] == len(r["text"])


@pytest.mark.parametrize("name", "site-header site-footer main-nav cookie-bar related-posts ad-slot comment-list comment-section commentlist".split())
@pytest.mark.parametrize("marked", [False, True])
def test_names_of_roles_with_places(name, marked):
    inside = f"<section class='{name}'><p>not content</p></section>"
    body = f"<article><p>the story</p>{inside if 'comment' in name or 'ad-' in name else ''}</article>" if marked else "<div><p>the story</p></div>"
    texts = [t for _, t in S.main_blocks(f"<body><div class='{name}'>words</div>{body}{inside}</body>")]
    assert texts == ["the story"]


@pytest.mark.parametrize("name", ["has-sidebar", "no-sidebar", "share-price", "post-content", "main", "page", "section-1", "articles"])
def test_names_of_no_role(name):
    assert [t for _, t in S.main_blocks(f"<body><div class='{name}'><p>the story</p></div></body>")] == ["the story"]


@pytest.mark.parametrize("n", [2, 9, 10, 30])
def test_outside_text_by_one_rule(spark, n):
    """Text beside a marked article that differs from page to page counts from the second page on;
    what all pages share does not."""
    pages = [(i, f"http://a.example/{i}", f"<body><div class='lead'>Lead number {i} of its own</div><div class='x'>All pages say so</div>"
              f"<article><p>Story {i} {'text ' * 20}</p></article></body>") for i in range(n)]
    got = {r["page_id"]: r["text"] for r in S.extract(spark.createDataFrame(pages, "page_id int, url string, html string")).collect()}
    assert all(got[i].startswith(f"Lead number {i} of its own\nStory {i}") and "All pages" not in got[i] for i in range(n))
