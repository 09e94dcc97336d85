import numpy as np
import pytest

from helixframe.llm.html_extract import blocks, extract, main_text, repeated, unique_runs
from tests.conftest import rows

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var a="</p><article>x</article>";</script></head>
<body><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use cookies</div><header><h1>Site</h1></header>
<article class="post"><h1>A &amp; B</h1><p>One <b>bo</b>ld&nbsp; word.<br>Next<p>Two &lt;tags&gt; &#233;<div class="ad">Buy</div><form><p>Mail</p></form>
<aside>More</aside><section id="comments"><p>Nice</p></section><p title="a > b">Three</p></article><footer>&copy; x</footer></body></html>"""


def test_article():
    assert extract(PAGE) == ("A & B\nOne bold word. Next\nTwo <tags> é\nThree", [])


@pytest.mark.parametrize(
    ("page", "text", "loose"),
    [
        ("", "", []),
        ("<article><p>cut off", "cut off", []),
        ("<article><p>a</p></div></article><p>b</p>", "a", []),
        ("<main><p>x</p><nav>y</nav></main>", "x", []),
        ("<div role=main>x<div>y</div></div>", "x\ny", []),
        ("<p>a < b and <b>c</b></p><!-- <article>z</article> --><div id='sidebar'>s</div>", "", ["a < b and c"]),
        ("<article><article class='comment'>no</article>yes</article>", "yes", []),
        ("<article>one<script>if (a < b) {}</script> two</article>", "one two", []),
    ],
)
def test_pages(page, text, loose):
    assert extract(page) == (text, loose)


@pytest.mark.parametrize(
    ("page", "text", "loose"),
    [
        ('<body class="home no-sidebar"><article><p>x</p></article></body>', "x", []),
        ('<body class="sidebar"><div class="cookie-notice">c</div><main class="search"><p>x</p></main></body>', "x", []),
        ('<body class="cookie-banner-open"><p>x</p></body>', "", ["x"]),
        ('<article class="post social-policy">x<div class="share-buttons">s</div></article>', "x", []),
        ('<div class="layout with-sidebar"><article>x</article><div class="sidebar">s</div></div>', "x", []),
        ('<div class="widget"><article>the long article</article></div><div class="related"><article>short</article></div>', "the long article", []),
        ("<main><p>the text of the page</p><article>teaser</article></main><article>out</article>", "the text of the page\nteaser", []),
        ('<nav>menu menu menu</nav><div class="promo">the only text<nav>n</nav></div><div class="ad">ad</div>', "", ["the only text"]),
    ],
)
def test_a_class_word_does_not_drop_the_text(page, text, loose):
    assert extract(page) == (text, loose)


def test_unclosed_quote_is_linear():
    assert blocks("<article><p title=\"" + "x" * 50_000 + "<p>y</p></article>") is not None


def brute_repeated(pages, run):
    at = {}
    for i, p in enumerate(pages):
        for j in range(len(p) - run + 1):
            at.setdefault(tuple(p[j : j + run]), set()).add(i)
    out = []
    for i, p in enumerate(pages):
        gone = np.zeros(len(p), dtype=bool)
        for j in range(len(p) - run + 1):
            if len(at[tuple(p[j : j + run])]) > 1:
                gone[j : j + run] = True
        out.append(gone)
    return out


def test_suffix_array_equals_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(20):
        pages = [[str(x) for x in rng.integers(0, 3, rng.integers(0, 60))] for _ in range(6)]
        got, want = repeated(pages, 8), brute_repeated(pages, 8)
        assert all((a == b).all() for a, b in zip(got, want, strict=True))


def test_unique_runs_stay():
    head, foot = "home about contact news sport weather travel more", "terms privacy imprint jobs press help store app"
    pages = [[head, f"{i} own words of page {i} end{i}", foot + f" tail{i}"] for i in range(4)]
    assert unique_runs(pages) == [f"{i} own words of page {i} end{i}\ntail{i}" for i in range(4)]


def test_pages_of_a_host(spark):
    head = "<div>home about contact news sport weather travel more</div>"
    data = [(i, "http://a.example/" + str(i), f"{head}<p>{i} own words of page {i}</p>") for i in range(5)] + [(9, "http://b.example/", head), (10, None, None), (11, "x", PAGE), (11, "x", PAGE), (12, "http://c.example/", "<p>c</p>"), (12, "http://c.example/", "<p>c</p>"), (None, None, "")]
    df = spark.createDataFrame([(*d, "y") for d in data], "page_id long, url string, html string, text string")
    got = main_text(df)
    want = [(i, f"{i} own words of page {i}") for i in range(5)] + [(9, "home about contact news sport weather travel more"), (10, ""), (11, extract(PAGE)[0]), (11, extract(PAGE)[0]), (12, "c"), (12, "c"), (None, "")]
    assert rows(got, "page_id", "text") == sorted(want, key=repr)
    assert main_text(df.where("false")).count() == 0
    assert sorted(map(repr, rows(main_text(df, part_pages=2), "page_id"))) == sorted(map(repr, rows(got, "page_id")))


@pytest.mark.parametrize("mark", ['<div id="main">', '<div class="main-content">', '<section class="site-main">'])
def test_text_marked_by_a_class_or_id_is_kept(spark, mark):
    tag = mark[1:].split(" ")[0]
    df = spark.createDataFrame([(1, "http://a.example/1", f"<body><nav>menu</nav>{mark}<p>the text</p></{tag}></body>")], "page_id long, url string, html string")
    assert main_text(df).first().text == "the text"


def test_results_do_not_depend_on_the_size_of_a_host(spark):
    rng = np.random.default_rng(3)
    menus = [" ".join(f"menu{m}x{i}" for i in range(9)) for m in range(30)]
    data = []
    for i in range(60):  # each menu stands on two pages
        own = " ".join(str(x) for x in rng.integers(0, 1000, 40))
        data.append((i, f"http://a.example/{i}", f"<div>{menus[i % 30]}</div><p>{own}</p><div>short {i}</div>"))
    df = spark.createDataFrame(data, "page_id long, url string, html string")
    whole = rows(main_text(df), "page_id", "text")
    assert not any("menu" in t for _, t in whole) and all(t.endswith(f"short {i}") for i, t in whole)
    assert rows(main_text(df, part_pages=3), "page_id", "text") == whole


def test_driver_pages(spark):
    import html
    import re

    df = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    pages = {r.page_id: r.html for r in df.collect()}
    for r in main_text(df).collect():
        inner = re.search(r"(?s)<article>(.*)</article>", pages[r.page_id])[1]
        want = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1|article)>", inner)]
        assert r.text == "\n".join(x for x in want if x)


def test_ids_beside_a_null_are_exact(spark):
    big = 2**53 + 1
    data = [(big, "http://a.example/1", "<p>one</p>"), (None, "http://a.example/2", "<p>two</p>"), (2**63 - 1, "http://a.example/3", "<article>x</article>")]
    got = main_text(spark.createDataFrame(data, "page_id long, url string, html string")).collect()
    assert {(r.page_id, r.text) for r in got} == {(big, "one"), (None, "two"), (2**63 - 1, "x")}


def test_copies_are_content(spark):
    rng = np.random.default_rng(4)
    menu = "<p>" + " ".join(f"menu{i}" for i in range(12)) + "</p>"
    base = [f"w{x}" for x in rng.integers(0, 10_000, 200)]
    data = []
    for i in range(40):
        w = list(base) if i < 12 else [f"v{x}" for x in rng.integers(0, 10_000, 200)]
        if i % 3 == 0:
            w[int(rng.integers(0, 200))] = f"changed{i}"
        data.append((i, f"http://a.example/{i}", f"{menu}<p>{' '.join(w)}</p>"))
    df = spark.createDataFrame(data, "page_id long, url string, html string")
    want = [(i, h.split("<p>")[2].removesuffix("</p>")) for i, _, h in data]
    for pages in (2000, 7):
        assert rows(main_text(df, part_pages=pages), "page_id", "text") == sorted(want, key=repr)


def test_large_page(spark):
    body = " ".join(f"w{i}" for i in range(400_000))
    df = spark.createDataFrame([(1, "http://a.example/1", f"<nav>m</nav><article><p>{body}</p></article>"), (2, "http://a.example/2", f"<p>{body}</p>")], "page_id long, url string, html string")
    assert {r.text for r in main_text(df).collect()} == {body}


def test_pages_that_lose_their_article_mark(spark):
    """The suffix array on all driver pages: near all text is what structure gives; repeats of unlike pages go."""
    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    marked = {r.page_id: r.text.split() for r in main_text(df).collect()}
    bare = {r.page_id: r.text.split() for r in main_text(df.selectExpr("page_id", "url", "regexp_replace(html, '</?article>', '') AS html")).collect()}
    extra = sum(len(bare[i]) > len(w) for i, w in marked.items())
    kept = sum(len(bare[i]) for i in marked) / sum(map(len, marked.values()))
    assert extra == 0 and kept > 0.95
