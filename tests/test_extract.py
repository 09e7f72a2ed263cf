import pytest

from tidemark.operators import extract as X

SESSION = []


@pytest.fixture(autouse=True)
def _session(spark):
    SESSION[:] = [spark]


def page(head="", body="", with_body=True):
    b = f"<body>{body}</body>" if with_body else ""
    return f"<html><head>{head}</head>{b}</html>"


def ex(html):
    df = SESSION[0].createDataFrame([("https://x.com/p", html)], "url string, html string")
    return X.extract_pages(df).first().asDict()


def test_title_rules():
    assert ex(page("<title> Hello </title>"))["title"] == "Hello"
    assert ex(page("", "<h1>Main <b>Heading</b></h1>"))["title"] == "MainHeading"
    assert ex(page("", "<p>x</p>"))["title"] is None
    assert ex(page("<title>   </title>"))["title"] == ""          # white space only -> "" not None
    assert ex(page("<title></title>", "<h1>H</h1>"))["title"] == "H"
    assert ex(page("<title>A &amp; B</title>"))["title"] == "A & B"
    assert ex(page("<title>A <b>x</b></title>"))["title"] == "A <b>x</b>"  # title is text


def test_description_rules():
    long_p = "word " * 40
    assert ex(page('<meta name="description" content=" Meta desc ">'))["description"] == "Meta desc"
    assert ex(page('<meta property="og:description" content="OG">'))["description"] == "OG"
    assert ex(page("", f"<p>{long_p}</p>"))["description"] == long_p.strip()[:500]
    assert ex(page("", "<p>short text</p>"))["description"] is None
    assert len(ex(page(f'<meta name="description" content="{"d" * 600}">'))["description"]) == 500


def test_og_meta_first_tag_decides():
    out = ex(page('<meta property="og:title" content="P"><meta property="og:type" content="article">'
                  '<meta property="og:image" content="/i.png">'))
    assert (out["og_title"], out["og_type"], out["og_image"]) == ("P", "article", "/i.png")
    assert ex(page('<meta property="og:title" content=""><meta name="og:title" content="N">'))["og_title"] is None
    assert ex(page('<meta name="og:title" content="N">'))["og_title"] == "N"
    assert ex(page('<meta property="og:description" content="  ">'))["og_description"] == ""


def test_unclosed_paragraph_contains_later_ones():
    html = "<article><p><b>First<br><p>Second</p><p>Third</p></article><p>After</p>"
    assert ex(page("", html))["description"] is None  # 'FirstSecondThird' is 16 chars
    html2 = "<article><p><b>First part is long<br><p>Second</p></article>"
    assert ex(page("", html2))["description"] == "First part is longSecond"


def test_script_text_is_not_text():
    out = ex(page('<script>var t="</p>";</script>', "<p>abc</p><script>x()</script><noscript>ns</noscript>"))
    assert out["body_text_len"] == len("abcns")


def test_csr_rules(spark):
    cases = [
        (page("", '<div id="root"></div><script src="a.js"></script>'), True),
        (page("<title>T</title>", "<noscript>Enable JS</noscript><div>x</div><div>y</div>"), True),
        (page("<title>T</title>", with_body=False), True),
        (page("", "<p>" + "x" * 300 + "</p>"), False),
        (page('<title>T</title><meta name="description" content="D">', '<div id="__next"><p>s</p></div>'), False),
        (page("", "<div>tiny</div><script>1</script>"), True),
        (page("", "<div>a</div><p>b</p>"), False),
        (page("", "<p>" + "word " * 8 + "</p>"), True),   # one 40-char paragraph -> CSR
    ]
    df = spark.createDataFrame([(str(i), h) for i, (h, _) in enumerate(cases)], "url string, html string")
    got = {r.url: r.is_js_rendered for r in X.with_csr(X.extract_pages(df)).collect()}
    assert [got[str(i)] for i in range(len(cases))] == [e for _, e in cases]


def test_noise_and_main_content():
    html = page("<title>T</title>",
                "<nav><a href='/a'>Nav</a></nav><div class='cookie-banner'>Cookies</div>"
                "<main><h2>Intro</h2><p>" + "Real content here. " * 10 + "</p>"
                "<div class='hero-cta'>Buy</div><button>Go</button><ul><li>one</li><li>two</li></ul>"
                "<p><a href='/docs'>Docs</a> and <a href='#top'>top</a> <img src='x.png'></p></main>"
                "<footer>Foot</footer>")
    md = ex(html)["markdown"]
    assert md.startswith("## Intro")
    assert "Cookies" not in md and "Buy" not in md and "Go" not in md and "Nav" not in md and "Foot" not in md
    assert "* one" in md and "* two" in md
    assert "[Docs](/docs)" in md and "top" in md and "](#top)" not in md and "x.png" not in md


def test_short_candidate_falls_back_to_body():
    html = page("", "<article>tiny</article><div>" + "body text " * 20 + "</div>")
    assert "body text" in ex(html)["markdown"]


def test_links_in_document_order():
    out = ex(page("", "<a href='/a'>a</a><a>no</a><a href=''>e</a><a href='b'>b</a>"))
    assert out["links"] == ["/a", "", "b"]
    assert out["body_link_count"] == 3


def test_with_content_cleans(spark):
    df = spark.createDataFrame([("u", page("", "<main><p>Learn more</p><p>" + "Body " * 40 + "</p></main>"))],
                               "url string, html string")
    r = X.with_content(X.extract_pages(df)).first()
    assert r.content_text.startswith("Body") and "Learn more" not in r.content_text


def test_broken_html_fixtures():
    # stray end tag is ignored; an end tag closes the nearest open element of that name
    out = ex(page("<title>T</title>", "</div><div><p>alpha <b>beta</div> gamma</p><p>" + "x" * 30 + "</p>"))
    assert out["description"] is None          # first <p> holds 'alphabeta' only (9 chars)
    # a script holding '</p>' does not close a paragraph
    out = ex(page('<script>var s = "</p><p>";</script>', "<p>" + "y" * 25 + "</p>"))
    assert out["description"] == "y" * 25
    # tags and entities inside <title> are text
    out = ex(page("<title>A &lt;b&gt; <i>c</i> &amp; d</title>"))
    assert out["title"] == "A <b> <i>c</i> & d"
    # no body at all: no body measures, CSR by the no-body rule, content from the document
    out = ex("<html><head><title>Only head</title></head></html>")
    assert out["has_body"] is False and out["body_text_len"] is None
    # void elements never nest: text after <br> stays in the paragraph
    out = ex(page("", "<p>one<br>two<img src=x>three and more words here</p>"))
    assert out["description"] == "onetwothree and more words here"
