import time

import pytest

from listing_etl.llm import site_text as H


def text(page):
    return "\n".join(H.lay_out(page)[0])


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><article>";</script></head><body>
<header><a href="/">Site</a></header><nav><ul><li><a href="/a">A</a><li>B</ul></nav><div class="cookie-notice">We use</div>
<article><header><h1>Head &amp; line</h1></header><p>One  <b>two
three</b><br>four<p>Five<div class="ad">Buy</div><ul><li>six<li>seven</ul><form><input>Mail <button>go</button></form>
<aside>side</aside><!-- p --><table><tr><td>a<td>b<tr><td>c</table><section id="comments"><article class="comment"><p>me too</p></article></section>
</article><div class="sidebar"><p>no</p></div><footer>&copy; x</footer></body></html>"""


def test_article_without_the_rest():
    assert text(PAGE).split("\n") == ["Head & line", "One two three four", "Five", "six", "seven", "a", "b", "c"]


@pytest.mark.parametrize("page,want", [
    (None, ""), ("", ""), ("  ", ""), ("just text", "just text"), ("a <b>c", "a c"), ("<p>a<p>b", "a\nb"), ("<p>a</p", "a"), ("<p>a <b", "a"),
    ("a</", "a</"), ("1 < 2 &lt;p&gt; &#233;&eacute;&nbsp;x", "1 < 2 <p> éé x"), ("<div>x<!-- <p>y</p>", "x"), ("<main><p>m</p></main><p>n</p>", "m"),
    ("<div role=main><p>m</p></div><p>n</p>", "m"), ("<article><p>a</p></article><p>n</p><article><p>b</p></article>", "a\nb"),
    ("<script>x", ""), ("<p hidden>x</p><p>y</p>", "y"), ('<p style="display: none">x</p>y', "y"), ("<pre> a\n b </pre>", "a b"),
    ('<p title="a>b">c', "c"), ("<p title='x>y", "y"), ("<P CLASS=X>up</P>", "up"), ("</p></div>z", "z"), ("<div class='header-ad'>q</div>r", "r"),
    ("<aside><article><p>teaser</p></article></aside><p>body</p>", "body"), ("<article>" + "<div>" * 3000 + "deep", "deep")])
def test_odd_markup(page, want):
    assert text(page) == want


def test_linear_time():
    began = time.time()
    for page in ("<p>x" * 30_000, '<a b="' * 20_000, "<a <a " * 20_000, "<!--" * 20_000, "<div>" * 20_000, "<li>y" * 30_000, "<" * 50_000, "<b>" * 20_000 + "</i>" * 20_000,
                 "<i>" * 16_000 + "</x>" * 16_000, "<i>" * 16_000 + "<hr>" * 16_000, "<table><tr><td>" + "<i>" * 16_000 + "<p>" * 16_000):
        text(page)
    assert time.time() - began < 30


def test_names_inside_of_an_article_delete_no_text():
    page = """<article><h1>T</h1><h2 id="related-work">Related</h2><p>one</p><section id="legal-basis"><p>basis</p></section><p class="search">look</p>
    <div class="share-of-votes"><p>two</p></div><div class="ads"><p>buy</p></div></article>"""
    assert text(page).split("\n") == ["T", "Related", "one", "basis", "look", "two"]


def test_templates_go_and_shared_lines_stay(spark):
    box = "<div><p>Read our magazine</p><p>every week</p></div>"
    rows = []
    for i in range(30):
        body = f"<p>own text {i}</p><p>a line that all documents share</p>"
        rows.append((i, "http://a.org/%d" % i, f"<body>{box}<div>{body}</div></body>"))                      # nothing marked
        rows.append((100 + i, "HTTP://B.org/%d" % i, f"<body><p>top</p><article>{body}{box}</article></body>"))  # marked content
        rows.append((200 + i, "http://c.org/%d" % i, f"<body><div><p>copy of one page</p></div>{box if i < 3 else ''}</body>"))
    rows += [(300, None, "<p>x</p>"), (301, "odd", None), (None, "http://a.org/0", rows[0][2]), (0, "http://a.org/0", rows[0][2])]
    df = spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id long, url string, html string, text string, host int")
    got = H.main_text(df).collect()
    assert len(got) == len(rows)
    by = {r["page_id"]: r["text"] for r in got}
    for i in range(30):
        assert by[i] == f"own text {i}\na line that all documents share"
        assert by[100 + i] == f"own text {i}\na line that all documents share"
        assert "copy of one page" in by[200 + i]            # copies of a page are no template
    assert by[300] == "x" and by[301] == "" and by[None] == by[0]
    assert H.main_text(df.limit(0)).count() == 0


def test_a_template_is_judged_by_pages_not_by_the_size_of_its_host(spark):
    """The same box on 10 pages goes, whether the host has 90 pages or 110; on 4 pages it stays."""
    box = "<div><p>Read our magazine</p></div>"
    for n in (90, 110):
        rows = [(i, f"http://h{k}.org/{i}", f"<article><p>own {i}</p>{box if i < k else ''}</article>") for k in (4, 10) for i in range(n)]
        got = {(r["url"]): r["text"] for r in H.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
        assert got["http://h10.org/0"] == "own 0" and got["http://h4.org/0"] == "own 0\nRead our magazine"


def test_nested_templates_and_their_ranges(spark):
    menu, box = "<ul><li>a</li><li>b</li></ul>", "<section>{}<p>c</p></section>"
    rows = [(i, "http://a.org/", f"<p>top {i}</p>{box.format(menu) if i < 6 else menu}<div><p>end {i}</p></div>") for i in range(12)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r["text"] for r in H.main_text(df).collect()} == {f"top {i}\nend {i}" for i in range(12)}
    assert {r["text"] for r in H.main_text(df, min_pages=7).collect()} == {f"top {i}\n{'c' + chr(10) if i < 6 else ''}end {i}" for i in range(12)}


def test_templates_are_found_on_the_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    n = {(r["template"], r["markup"]): r["n"] for r in H.deletions(H.laid_out(pages)).collect()}
    assert n[(True, True)] > 0 and n[(False, True)] > 0
    assert H.site_templates(pages).count() > 0
