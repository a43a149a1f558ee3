"""Main text of pages: the article of the given pages by a plain rule, and hand-made pages."""

import re
from html import unescape

import pytest

from chargeload.llm import html_extract as he

from .conftest import SF

TREE = he.grow_tree(*he.labelled_table())


def text(html):
    return he.main_text(html, TREE)[0]


def article(html):
    inside = html.split("<article>", 1)[1].split("</article>", 1)[0]
    blocks = [" ".join(unescape(re.sub("</?b>", "", b).replace("<br>", " ")).split()) for b in re.split("</?(?:p|h1)>", inside)]
    return "\n\n".join(b for b in blocks if b)


def test_given_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    want = sorted((r.page_id, r.url, article(r.html), len(article(r.html))) for r in pages.collect())
    got = sorted(tuple(r)[:4] for r in he.extract_text(pages).collect())
    assert got == want


PARAGRAPH = "The river rose for three days before the dam gave way and the lower town was lost to the water."


@pytest.mark.parametrize("around", [
    "<nav><ul><li><a href=/>Home</a><li><a href=/x>News of the day</a></ul></nav>{}",
    "<header><h2>The Daily Record, since 1871 and still going strong</h2></header>{}",
    "{}<div class='comments'><p>I remember this flood well, my house was in the lower town back then.</p></div>",
    "<div class=\"cookie-notice\">We use cookies to make this site work for you and count our readers.</div>{}",
    "{}<form action=/s>Sign up for our weekly letter and never miss a story <input type=text></form>",
    "{}<aside><p>About the author: writes on rivers, dams, floods and the people who live beside them.</p></aside>",
    "<script>var x = '<p>{{}}</p>';</script><style>p {{ color: red }}</style>{}",
    "{}<div id=sidebar><p>Most read this week, chosen by our editors from all the sections of the paper.</p></div>",
    "{}<footer>Copyright of all texts lies with the paper; no part may be printed elsewhere.</footer>",
])
@pytest.mark.parametrize("main", ["<article><h1>The flood</h1><p>{0}<p>Short.</p><p>{0} <b>Again</b> &amp; again.</p></article>", "<main><h1>The flood</h1><div><p>{0}</p><p>Short.</p><p>{0} <i>Again</i> &#38; again.</p></div></main>"])
def test_what_stands_around_the_article_goes(around, main):
    page = f"<html><head><title>The flood</title></head><body>{around.format(main.format(PARAGRAPH))}</body></html>"
    assert text(page) == f"The flood\n\n{PARAGRAPH}\n\nShort.\n\n{PARAGRAPH} Again & again."


def test_comments_inside_the_article():
    assert text(f"<article><p>{PARAGRAPH}</p><section class='reader-comments'><p>{PARAGRAPH}</p></section></article>") == PARAGRAPH


def test_odd_rows(spark):
    rows = [(1, "u", None), (2, "u", ""), (3, None, "<p"), (4, "u", "<article><p>a &lt;b&gt; &am c < d</article>"), (None, "u", "no tags at all, but quite a lot of words in this text so that it may count as text"),
            (4, "u", "<article><p>a &lt;b&gt; &am c < d</article>"), (5, "u", "<article>" + "<p>word " * 50_000), (6, "u", "<div>" * 3000 + "</p></b>" * 100)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, text int")
    got = sorted(((r.page_id, r.text) for r in he.extract_text(df).collect()), key=lambda r: (r[0] or 0, len(r[1])))
    assert [t for i, t in got if i in (1, 2, 3, 6)] == ["", "", "", ""]
    assert [t for i, t in got if i == 4] == ["a <b> &am c < d"] * 2
    assert next(t for i, t in got if i == 5).count("word") == 50_000
    assert he.extract_text(df.limit(0)).count() == 0


def test_white_space_and_references():
    assert text("<article><p>a\n\t b<br>c&nbsp;d</p>\n<p> </p><p>e&eacute;</article>") == "a b c d\n\neé"


def test_tree_fits_its_table():
    x, y = he.labelled_table()
    assert (he.classify(TREE, x) == y).mean() > 0.95


@pytest.mark.parametrize("wrapper", ["site has-sidebar", "content-area with-sidebar", "page menu-open", "entry-content social-share", "sidebar", "page no-comments"])
@pytest.mark.parametrize("main", ["<article><h1>The flood</h1><p>{0}</p><p>{0}</p></article>", "<main><h1>The flood</h1><p>{0}</p><p>{0}</p></main>"])
def test_an_article_in_a_marked_wrapper(wrapper, main):
    page = f"<body><nav><a href=/>Home</a></nav><div class='{wrapper}'>{main.format(PARAGRAPH)}<aside><p>{PARAGRAPH}</p></aside></div></body>"
    assert text(page) == f"The flood\n\n{PARAGRAPH}\n\n{PARAGRAPH}"


def test_marked_pages_and_short_headlines_are_judged_by_words():
    long = " ".join([PARAGRAPH] * 3)
    links = "<ul><li><a href=/a>One more story</a><li><a href=/b>Another one here</a></ul>"
    assert text(f"<body><div class='widget'><p>{long}</p><p>{long}</p>{links}</div></body>") == f"{long}\n\n{long}"
    assert text(f"<body><div><h1>The flood</h1><p>{long}</p><p>{long}</p></div>{links}</body>") == f"The flood\n\n{long}\n\n{long}"
    assert text(f"<article><p>{PARAGRAPH}</p><div class='comments'><article class='comment'><p>{long}</p></article></div></article>") == PARAGRAPH


@pytest.mark.parametrize("thing", [
    "<svg class=\"icon\"/>", "<math/>", "<svg><path d='M0'/><title/><use href='#x'/></svg>", "<template/>", "<p>Share <button>now</p>", "<button>Share", "<select><option>One<option>Two", "<div><object data=x></div>",
    "<div><canvas id=c></div>", "<div><template><p>hidden</div>", "<a href=#><svg class=icon></a>", "<span><button>Share</span>", "<script src=x />", "<div><template><div><p>hidden</p></div>more</template></div>",
])
def test_elements_without_text_end_where_they_end(thing):
    got = text(f"<article><p>{PARAGRAPH}</p>{thing}<p>{PARAGRAPH} Again.</p>{thing}<div>{PARAGRAPH} A third time.</div></article>" if thing not in ("<button>Share", "<select><option>One<option>Two") else f"<article><p>{PARAGRAPH}</p>{thing}<p>{PARAGRAPH} Again.</p><div>{PARAGRAPH} A third time.</div></article>")
    assert [b for b in got.split("\n\n") if b != "Share"] == [PARAGRAPH, f"{PARAGRAPH} Again.", f"{PARAGRAPH} A third time."]


def test_custom_elements_are_not_skipped():
    assert text(f"<article><button-group><p>{PARAGRAPH}</p></button-group><template-card>{PARAGRAPH}</template-card></article>") == f"{PARAGRAPH}\n\n{PARAGRAPH}"
    assert text(f"<article><p>{PARAGRAPH}<button>Share <b>it</b></button><svg><text>x</text></svg> End.</p></article>") == f"{PARAGRAPH} End."


LONG = " ".join([PARAGRAPH] * 3)


@pytest.mark.parametrize("tag", ["<img alt=Don't src=x>", "<img alt='a>b' src=x>", "<img alt=5\" src=x>", "<a href=/x title=it's>", "<img alt = \"it's\">"])
def test_a_quote_opens_a_value_only_after_an_equals_sign(tag):
    page = f"<article><p>{PARAGRAPH}</p><p>{tag} {PARAGRAPH} It's late.</p><p>{PARAGRAPH} \"So be it.\"</p></article>"
    assert text(page) == f"{PARAGRAPH}\n\n{PARAGRAPH} It's late.\n\n{PARAGRAPH} \"So be it.\""


def test_unclosed_values_take_linear_time():
    assert text("<article><p>" + PARAGRAPH + "</p>" + "<a b=\"c\" " * 20_000) == PARAGRAPH


@pytest.mark.parametrize("wrapper", ["<div class='social'><div class='content'>{}</div></div>", "<form action=/x id=aspnetForm>{}</form>", "<form><div><div class='widget'>{}</div></div></form>",
                                     "<div class=sidebar><div class='post-body entry'>{}</div></div>", "<div class=header><section class=main>{}</section></div>", "<form><nav><a href=/>Home</a></nav>{}<footer>All rights lie with the paper.</footer></form>"])
def test_wrappers_of_a_page_without_an_article_element(wrapper):
    body = f"<h1>The flood</h1><p>{PARAGRAPH}</p><p>{LONG}</p><p>{PARAGRAPH} Again.</p>"
    nav = "<nav><ul><li><a href=/>Home</a><li><a href=/x>News of the day</a></ul></nav>"
    assert text(f"<body>{nav}{wrapper.format(body)}</body>") == f"The flood\n\n{PARAGRAPH}\n\n{LONG}\n\n{PARAGRAPH} Again."


@pytest.mark.parametrize("place", ["<div id='comments'>{}</div>", "<section class='reader-comments'>{}</section>", "<aside>{}</aside>", "<footer>{}</footer>", "<div class='related'>{}</div>"])
@pytest.mark.parametrize("inner", ["<article><p>{0}</p></article>", "<div class='content'><p>{0}</p></div>", "<main><div class=text><p>{0}</p></div></main>", "<form><article class=entry><p>{0}</p></article></form>"])
@pytest.mark.parametrize("main", ["<article><h1>The flood</h1><p>{0}</p></article>", "<h1>The flood</h1><p>{0}</p><p>{0} Again.</p>"])
def test_comments_and_the_like_stay_out_whatever_stands_in_them(place, inner, main):
    own = main.format(LONG)
    want = text(f"<body>{own}</body>")
    assert want.startswith("The flood")
    assert text(f"<body>{own}{place.format(inner.format(LONG + ' I was there.'))}</body>") == want


def test_short_pages():
    assert text("<p>Hello world</p>") == "Hello world" and text("<body><h1>Hello</h1><p>Small world</p></body>") == "Hello\n\nSmall world"
    assert text("<p><a href=/>Home</a></p><p><a href=/x>News</a></p>") == "" and text("<nav>Home News</nav>") == ""


def test_forms_and_notices_beside_the_text_go():
    page = f"<body><h1>The flood</h1><p>{LONG}</p><p>{PARAGRAPH}</p><form><div class='form-text'>{PARAGRAPH}</div></form><div class='cookie-notice'><div class='content'>{PARAGRAPH}</div></div></body>"
    assert text(page) == f"The flood\n\n{LONG}\n\n{PARAGRAPH}"
