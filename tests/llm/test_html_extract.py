import pytest

from loreloom.llm import html_extract as h

BODY = (
    "<p>The first paragraph, which has some words, and a stop.</p><p>A second one &amp; more: &lt;b&gt; and &#233;, indeed.</p>"
    "<p>Third, with <b>bold</b>,<br>a <a href='x'>link</a> and an end.</p>"
)
TEXT = (
    "The first paragraph, which has some words, and a stop.\n\nA second one & more: <b> and é, indeed.\n\n"
    "Third, with bold, a link and an end."
)
NOISE = (
    "<header><p>Site name, slogan.</p></header><nav><ul><li><a href=a>Home</a><li><a href=b>News</a></ul></nav>"
    "<div class='cookie-notice'>We use cookies, as all do.</div>{}<aside><p>Other things, to read, now.</p></aside>"
    "<div id=\"sidebar\"><p>Beside, the point, of it.</p></div><div class=\"ad\">Buy this, buy that, buy it all now.</div>"
    "<form><label>Your name, please</label><input name=n><button>Go</button></form>"
    "<section class='comments'><h3>Comments</h3><p>I liked it, a lot, really, and I wrote a long comment, to say so.</p></section>"
    "<footer>&copy; us, all rights kept.</footer>"
)


def page(article):
    return (
        "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body class='has-sidebar'>"
        + NOISE.format(article) + "<script>more()</script><!-- <p>no</p> --></body></html>"
    )


@pytest.mark.parametrize("wrap", ["<article>{}</article>", "<main>{}</main>", "<div class='post-body'>{}</div>", "<div><div>{}</div></div>"])
def test_article_without_its_surroundings(wrap):
    assert h.main_text(page(wrap.format(BODY))) == TEXT


def test_lists_tables_and_headings_belong_to_the_article():
    inner = "<h1>Title</h1>" + BODY + "<ul><li>one<li>two</ul><table><tr><td>a</td><td>b</td></tr></table><blockquote>Said.</blockquote>"
    assert h.main_text(page(f"<article>{inner}</article>")) == "Title\n\n" + TEXT + "\n\none\n\ntwo\n\na\n\nb\n\nSaid."


def test_unclosed_and_crossed_tags():
    assert h.main_text(page("<article><p><b>Bold start.<br><p>Next</b> one.<p>Last <i>one</article>")) == "Bold start.\n\nNext one.\n\nLast one"


@pytest.mark.parametrize("html, text", [
    ("", ""), ("   ", ""), ("plain text, no tags", "plain text, no tags"), ("<p>", ""), ("<nav>menu</nav>", ""),
    ("1 < 2 & 3 > 2", "1 < 2 & 3 > 2"), ("<p>a&nbsp;b\n\tc  d</p>", "a b c d"), ("<p title='a>b'>x</p>", "x"), ("<p", "<p"),
    ("<script>never closed", ""), ("<!-- never closed", ""), ("<p>&amp &am &copy; &#x41;</p>", "& &am © A"),
])
def test_small_pages(html, text):
    assert h.main_text(html) == text


def test_rows(spark):
    schema = "page_id long, url string, html string, text string, n_chars string"
    long = "<article>" + "".join(f"<p>Paragraph {i}, of many.</p>" for i in range(20_000)) + "</article>"
    rows = [(1, "u", page(f"<article>{BODY}</article>"), "x", "y"), (2, None, None, "x", "y"), (3, "u", "", "x", "y"),
            (None, "v", "<p>é</p>", "x", "y"), (None, "v", "<p>é</p>", "x", "y"), (4, "w", long, "x", "y")]
    got = h.extract(spark.createDataFrame(rows, schema)).collect()
    found = sorted(((r.page_id, r.url, r.text, r.n_chars) for r in got), key=repr)
    whole = "\n\n".join(f"Paragraph {i}, of many." for i in range(20_000))
    expected = [(1, "u", TEXT, len(TEXT)), (2, None, "", 0), (3, "u", "", 0), (None, "v", "é", 1), (None, "v", "é", 1), (4, "w", whole, len(whole))]
    assert found == sorted(expected, key=repr)
    assert h.extract(spark.createDataFrame([], schema)).count() == 0


def test_scores_prefer_long_punctuated_paths():
    blocks = h.read_blocks("<div class=a><p>One, two, three, four, five.</p><p>Six, seven, eight.</p></div><div class=b><a>x</a></div>")
    scores = h.path_scores(blocks)
    assert scores[0] > scores[-1] and scores[-1] == 0.0


@pytest.mark.parametrize("wrap", [
    "<div class='has-sidebar'><article>{}</article></div>", "<div class='content-sidebar-wrap'><div>{}</div></div>",
    "<form><article>{}</article></form>", "<form><div>{}</div></form>", "<div class='header-fixed'><div class=x>{}</div></div>",
    "<div class='content-sidebar-wrap'><main>{}</main><div class='sidebar'><p>Beside, the point, of all of it.</p></div></div>",
])
def test_marks_around_the_article_do_not_drop_it(wrap):
    assert h.main_text(page(wrap.format(BODY))) == TEXT


def test_an_article_made_of_marked_parts():
    parts = "".join(f"<div class='elementor-widget elementor-{i}'>{p}</p></div>" for i, p in enumerate(BODY.split("</p>")[:-1]))
    assert h.main_text(page(f"<div class=x>{parts}</div>")) == TEXT


def test_inline_parts_are_judged_piece_by_piece():
    note = "<p><span class='notice'>Note:</span> a long text, which goes on, and on.</p>"
    advert = "<p>Before it, <span class='ad'>buy this</span> and after it, the same.</p>"
    got = h.main_text(page(f"<article><header><h1><a href=x>Title</a></h1></header>{note}{advert}{BODY}</article>"))
    assert got == "Title\n\nNote: a long text, which goes on, and on.\n\nBefore it, and after it, the same.\n\n" + TEXT


def test_the_container_drops_no_content():
    more = "<p>A fourth one, of the same kind, beside the others.</p>"
    expected = TEXT + "\n\nA fourth one, of the same kind, beside the others."
    assert h.main_text(page(f"<article>{BODY}</article><article>{more}</article>")) == expected
    assert h.main_text(page(f"<div><div>{BODY}</div><div>{more}</div></div>")) == expected
