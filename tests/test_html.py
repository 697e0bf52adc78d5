"""Page extraction and URL resolution edge rows."""

from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from lexis.functions import html as H
from lexis.operators import web as W

BASE = "https://d.example.org/"
HREFS = ["/a", "a/b", "//h/x", "#top", "?q=1", "http://o/z", "mailto:x@y", "../u", "a#f", "",
         "./x/./y/../z", "a/..", "/p/q/../../r"]


@pytest.mark.parametrize("base", [BASE, "https://d.example.org/dir/page.html?x=1#f",
                                  "http://h.example.com"])
def test_resolve_url_matches_urljoin(spark, base):
    df = spark.createDataFrame([(h,) for h in HREFS], "href string")
    got = [r["u"] for r in df.select(H.resolve_url(base, F.col("href")).alias("u")).collect()]
    assert got == [urljoin(base, h) for h in HREFS]


def _pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_title_default_and_filename(spark):
    pages = _pages(spark, [
        (1, "u1", "<html><head></head><body>x</body></html>"),
        (2, "u2", "<html><head><title>a/b: c?</title></head><body>y</body></html>"),
    ])
    got = {r["page_id"]: (r["title"], r["file_name"]) for r in W.page_titles(pages).collect()}
    assert got[1] == (H.DEFAULT_TITLE, H.DEFAULT_TITLE.replace(" ", "_") + ".txt")
    assert got[2] == ("a/b: c?", "ab_c.txt")


def test_body_text_and_missing_body(spark):
    html = ("<html><head><title>t</title><style>p{}</style></head><body><script>var a='<p>'"
            "</script><p> One &amp;lt; two </p><!-- hidden --><div>\n</div><p>Three&nbsp;</p>"
            "</body></html>")
    pages = _pages(spark, [(1, "u", html), (2, "v", "<html><p>no body</p></html>")])
    rows = W.page_text(pages).collect()
    assert [(r["page_id"], r["text"]) for r in rows] == [(1, "One &lt; two\nThree")]
    assert [r["page_id"] for r in W.pages_without_body(pages).collect()] == [2]


def test_links_in_order(spark):
    html = "<body><a href=\"/x\">x</a><a class='k' href='y?a=1&amp;b=2'>y</a><abbr>z</abbr></body>"
    rows = W.page_links(_pages(spark, [(1, "https://s.example.org/d/p", html)]), base=None) \
        .orderBy("pos").collect()
    assert [r["link"] for r in rows] == ["https://s.example.org/x", "https://s.example.org/d/y?a=1&b=2"]


def test_markup_by_hand(spark):
    html = ("<script>t='<title>bad</title>'</script><!-- <body>no</body> --><title>A &amp; B</title>"
            "<body><b title='x>L'>caf&#233;</b> &#x20AC;&amp;#65;&#0;&#38;lt;</body>")
    rows = W.page_text(_pages(spark, [(1, "u", html), (2, "v", "<!-- <body>x</body> --><p>y</p>")])).collect()
    assert [(r["page_id"], r["text"]) for r in rows] == [(1, "café\n€&#65;&#0;&lt;")]
    titles = W.page_titles(_pages(spark, [(1, "u", html)])).first()
    assert titles["title"] == "A & B"


def test_saved_pages_skip_fragments_and_repeats(spark):
    page = "<title>{0}</title><body>{0}</body>"
    pages = _pages(spark, [(3, "u", page.format("late")), (1, "u", page.format("first")), (2, "u#x", page.format("part"))])
    assert [(r["page_id"], r["text"]) for r in W.saved_pages(pages).collect()] == [(1, "first")]


def test_registered_crawl_is_deep(spark):
    from lexis.plans import registry as REG
    from tests.conftest import SF001
    ring, seeds = REG._rings(spark, SF001)
    reached = W.crawl_reachable(ring, seeds)
    assert reached.agg(F.max("depth")).first()[0] >= 4
    assert reached.count() == reached.select("url").distinct().count()


def test_crawl_closure(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "e")], "src string, dst string")
    seeds = spark.createDataFrame([("a",)], "url string")
    got = {r["url"]: r["depth"] for r in W.crawl_reachable(edges, seeds).collect()}
    assert got == {"a": 0, "b": 1, "c": 2}


def test_page_documents_last_visit_wins(spark):
    page = "<html><head><title>Same</title></head><body>{}</body></html>"
    pages = _pages(spark, [(1, "u1", page.format("first")), (2, "u2", page.format("second"))])
    rows = W.page_documents(pages).collect()
    assert len(rows) == 1 and rows[0]["content"] == "URL: u2\n\nsecond"


# one scan: comments, scripts, styles and quoted attributes, with values by hand
CASES = [
    ("<body><!-- <script> --><p>keep</p><script>x</script></body>", "keep", []),
    ('<body><a title="x>y" href="/found">t</a></body>', "t", ["/found"]),
    ('<body data-x="a>b">in</body>', "in", []),
    ("<body>1 < 2 and 3 > 2</body>", "1 < 2 and 3 > 2", []),
    ("<body><script src='a>b'>no</script><style title=\"c>d\">no</style>yes</body>", "yes", []),
    ("<body><!--><p>a</p><!-- > -- --->b<!-- to the end <p>no</p>", "a\nb", []),
    ("<body>a<script>never closed <p>no</p>", "a", []),
    ("<body><scripted>a</scripted><styled>b</styled></body>out", "a\nb", []),
    ("<body><script>'</scripty>'</script >a</body>", "a", []),
    ("<BODY CLASS=a><A HREF=/up>x</A><a\nhref = '/q'>y</a><abbr href='/no'>z</abbr></BODY>", "x\ny\nz", ["/up", "/q"]),
    ("<body><a data-href='/no' title=\" href='/no'\" href='/yes'>x</a><a>none</a><a href>empty</a></body>", "x\nnone\nempty", ["/yes", ""]),
    ("<body><a href=/one href=/two>x</a><a href=\"a'b\">y</a><a href=a=b>z</a></body>", "x\ny\nz", ["/two", "a'b", "a=b"]),
    ("<body><p it's>don't</p><p a=\"x>open</p></body>", "don't\nopen", []),
    ("<body><?php x ?>a<!DOCTYPE b>c</></body>", "a\nc</>", []),
    ("<!-- <body>no</body> --><body>a<b>b</b>\u0001</body><body>late</body>", "a\nb\n�", []),
    ("<body></body>", "", []),
]


def test_scan_by_hand(spark):
    pages = W.scanned(spark.createDataFrame([(i, h) for i, (h, _, _) in enumerate(CASES)], "page_id long, html string"))
    rows = pages.where(H.has_body("nodes")).select("page_id", H.body_text("nodes").alias("t"), H.anchor_hrefs("nodes").alias("h")).orderBy("page_id").collect()
    assert [(CASES[r["page_id"]][0], r["t"], r["h"]) for r in rows] == CASES


TITLES = [("<title>a</title>", "a"), ("<title lang='x>y'>a &amp; b</title>", "a & b"), ("<title></title>", None),
          ("<title>a<b>c</b></title>", None), ("<title>open", None), ("<p>x</p>", H.DEFAULT_TITLE), ("<titled>x</titled>", H.DEFAULT_TITLE),
          ("<!-- <title>no</title> --><TITLE >yes</TITLE>", "yes"), (None, None)]


def test_titles_by_hand(spark):
    pages = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(TITLES)], "page_id long, html string")
    got = {r["page_id"]: r["title"] for r in W.page_titles(pages).collect()}
    assert {i: got.get(i) for i in range(len(TITLES))} == {i: t for i, (_, t) in enumerate(TITLES)}


def test_scan_of_hostile_pages_ends(spark):
    """No backtracking: long runs of half-open markup take a moment, not minutes, and no deep stack."""
    import time
    hostile = ["<body><a " + "x='y' " * 20_000, "<body>" + "<" * 200_000, "<body><a " + "=" * 200_000, "<body>" + "<!-" * 50_000,
               "<body><p " + 'a="' * 50_000, "<body>" + "<script" * 2_000]
    pages = W.scanned(spark.createDataFrame([(i, h) for i, h in enumerate(hostile)], "page_id long, html string"))
    begin = time.time()
    assert pages.select(F.size(H.anchor_hrefs("nodes")), H.body_text("nodes")).count() == len(hostile)
    pages.select(F.size(H.anchor_hrefs("nodes")), F.length(H.body_text("nodes"))).collect()
    assert time.time() - begin < 60


def test_a_page_is_scanned_once(spark):
    plan = W.page_text(_pages(spark, [(1, "u", "<body>x</body>")]))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(translate") == 1


def test_a_crawl_round_shuffles_its_frontier_only(spark, scratch):
    """In the plan of a round the edges and what was reached come without an exchange."""
    import os
    tables = {}
    for name, df, column in (("w_edges", spark.createDataFrame([("a", "b"), ("b", "c")], "src string, dst string"), "src"),
                             ("w_fresh", spark.createDataFrame([("a",)], "url string"), "url"), ("w_old", spark.createDataFrame([("c",)], "url string"), "url")):
        df.write.bucketBy(4, column).sortBy(column).option("path", os.path.join(scratch, name)).mode("overwrite").saveAsTable(name)
        tables[name] = spark.table(name)
    found = W.crawl_round(tables["w_edges"], tables["w_fresh"], tables["w_old"], 4)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "REPARTITION_BY_NUM" in plan
    assert [r["url"] for r in found.collect()] == ["b"]
    for name in tables:
        spark.sql(f"DROP TABLE {name}")
