import math
import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from factloom.llm import html
from factloom.llm.html import Page

PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var a="</p><article>";</script></head>
<body class="has-sidebar"><header><h1>Site</h1></header><nav><ul><li>Menu</li></ul></nav><!-- <p>not shown</p> -->
<div class="wrap sidebar-right"><article id="a"><header><h1>The&nbsp; title</h1></header><p>One &amp; <b>two<br>three
  <p>Four <span class="ad">BUY</span> five<button>Go</button> six</p><div class=notice>Cookies!</div>
<ul><li>x<li>y</ul><pre> a  b </pre><div class="comments"><p>First!</p></div>Tail &eacute;&#x4e2d;</article>
<aside>Aside</aside></div><form><p>Your mail</p></form><footer>&copy; me</footer></body></html>"""


def test_article_without_what_surrounds_it():
    assert Page(PAGE).plain_text() == "The title\nOne & two three\nFour five six\nx\ny\na b\nTail é中"


def test_pages_without_an_article():
    assert Page("<p>a</p><div hidden>h</div>b<p>c").text() == "a\nb\nc"
    assert Page("").text() == "" and Page("plain  text").text() == "plain text"
    assert Page("<div hidden>a</div><div style='display: none'>b</div><div role=navigation>c</div>d").plain_text() == "d"
    assert Page("<p>open <b>never closed").text() == "open never closed"
    assert Page("a < b & c > d").text() == "a < b & c > d"
    assert Page('<p>see <a href="x>link</a> and more</p>').text() == "see link and more"


def test_comments_that_are_articles_are_no_main_text():
    assert Page("<main><p>m</p><section class=comments><article><p>c</p></article></section></main>").plain_text() == "m"


def test_words_that_declare_a_branch():
    assert html.declared_word(["sidebar"]) and html.declared_word(["site-nav"]) and html.declared_word(["x", "ad_banner"])
    assert not any(html.declared_word([t]) for t in ("has-sidebar", "with-comments", "no-banner", "layout-sidebar", "story", "advice"))


def entropy(values):
    n = len(values)
    return -sum(c / n * math.log(c / n) for c in Counter(values).values()) / math.log(n)


def plain_importance(seen):
    """Of one merged node, from its rows (look, prior, share, texts), by the definition; None on one page."""
    n = len(seen)
    if n < 2:
        return None
    pages, size = Counter(t for *_, texts in seen for t, _ in texts), sum(k for *_, texts in seen for _, k in texts)
    look = entropy([r[0] for r in seen])
    alike = sum(k * math.log(pages[t]) / math.log(n) for *_, texts in seen for t, k in texts)
    return html.PRESENTATION * look + (1 - html.PRESENTATION) * (1 - alike / size if size else look)


def plain_extract(rows):
    """Texts of (url, html) rows by the same evidence, in plain loops."""
    host = lambda url: (re.match(r"\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", url or "") or [0, ""])[1].lower()
    own, every = defaultdict(list), defaultdict(list)
    for url, source in rows:
        for style, *seen in Page(source or "").styles():
            own[host(url), style].append(seen)
            every[style].append(seen)
    low = defaultdict(set)
    smooth = lambda value, n, above: ((value or 0.0) * n + html.INHERITED * above) / (n + html.INHERITED)
    mean = lambda seen, at: sum(r[at] for r in seen) / len(seen)
    for (h, style), seen in own.items():
        general = smooth(plain_importance(every[style]), len(every[style]) - 1, html.UNKNOWN)
        importance = smooth(plain_importance(seen), len(seen) - 1, general)
        held = smooth(mean(seen, 2), len(seen), mean(every[style], 2))
        if mean(seen, 1) + html.HELD * held + html.ALIKE * (0.5 - importance) > 0:
            low[h].add(style)
    return [Page(source or "").text(frozenset(low[host(url)])) for url, source in rows]


def site(spark):
    box = "<div class='teaser'><p>Read our best stories</p></div>"
    rows = [(i, "https://www.site.example/p", f"<body>{box}<div class=story><p>Story number {i}</p></div></body>") for i in range(20)]
    rows += [(200 + i, "http://copies.example/", "<body><article><p>Same story</p><p>again</p></article></body>") for i in range(20)]
    rows += [(400 + i, "http://wrapped.example/", f"<body><div class='page with-sidebar'><div class=sidebar>Links {i % 2}</div><p>Body {i} of a page of some length</p></div></body>") for i in range(20)]
    rows += [(500 + i, "http://news.example/", f"<body><nav>{i} home</nav><div class='post comments'><p>The whole long text {i} stands in here.</p></div></body>") for i in range(9)]
    rows += [(600 + i, "http://beside.example/", f"<body>Skip to text<div>Seen too: {i}</div><article><div class=byline>By us</div><p>Text {i} is the longest part here</p></article></body>") for i in range(20)]
    rows += [(300, None, None), (301, "no address", ""), (None, "http://x.example", "<p>t</p>"), (0, *rows[0][1:])]
    return rows


def test_branches_are_cut_by_the_evidence_of_their_host(spark):
    rows = site(spark)
    found = html.extract(spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, text int")).collect()
    assert len(found) == len(rows)
    got = sorted((str(r.page_id), r.text) for r in found)
    assert got == sorted((str(i), t) for (i, *_), t in zip(rows, plain_extract([r[1:] for r in rows])))
    texts = {r.page_id: r.text for r in found}
    assert all(texts[i] == f"Story number {i}" for i in range(20))
    assert all(texts[200 + i] == "Same story\nagain" for i in range(20))
    assert all(texts[400 + i] == f"Body {i} of a page of some length" for i in range(20))
    assert all(texts[500 + i] == f"The whole long text {i} stands in here." for i in range(9))
    assert all(texts[600 + i] == f"Text {i} is the longest part here" for i in range(20))
    assert texts[300] == texts[301] == "" and texts[None] == "t"
    assert all(r.n_chars == len(r.text) for r in found)
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert html.extract(empty).count() == 0


def test_tree_is_that_of_the_definition(spark):
    rng = random.Random(5)
    rows = []
    for i in range(60):
        box = rng.choice(["<p>buy now</p>", "<p>buy now</p>", "<span>other</span>"])
        rows.append((i, f"http://{rng.choice('abc')}.example/x", f"<body><div class=box>{box}</div><nav><p>{rng.randrange(3)}</p><p>{i}</p></nav><p>{i}</p></body>"))
    seen = defaultdict(list)
    for _, url, source in rows:
        for style, *r in Page(source).styles():
            seen[url[7:16], style].append(r)
    nodes = html.page_nodes(spark.createDataFrame(rows, "page_id long, url string, html string"))
    texts = nodes.selectExpr("host", "style", "explode(texts) t").selectExpr("host", "style", "t.text", "t.size").groupBy("host", "style", "text")
    texts = texts.agg(F.count("*").alias("pages"), F.sum("size").alias("size"))
    got = {(r.host, r.style): r for r in html.importance(nodes, ["host", "style"], texts).collect()}
    assert set(got) == set(seen) and len(seen) == 6
    for key, own in seen.items():
        assert got[key].n == len(own) and abs(got[key].importance - plain_importance(own)) < 1e-9


def test_pages_of_the_generator_lose_menus_and_keep_articles(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = pages.collect()
    nodes = html.page_nodes(pages).cache()
    assert html.style_tree(nodes).where("noise > 0").count() > 100
    got = {r.page_id: r.text for r in html.extract(pages).collect()}
    want = dict(zip((r.page_id for r in rows), plain_extract([(r.url, r.html) for r in rows])))
    assert got == want
    whole = {r.page_id: Page(r.html).text() for r in rows}
    assert sum(got[i] != whole[i] for i in got) > 0.9 * len(rows)
    assert got == {r.page_id: Page(r.html).plain_text() for r in rows}


def test_long_page():
    source = "<article>" + "<p>word &amp; word</p>" * 50_000 + "</article>"
    assert Page(source).text().count("\n") == 49_999
    assert Page("<div>" * 3000 + "deep").text() == "deep"
