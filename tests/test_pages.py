from __future__ import annotations

import http.server
import json
import threading

import pytest
from pyspark.sql import functions as F

from corpusflow.operators import clean, html, merge
from corpusflow.plans import cli, pipelines
from corpusflow.sources import files, web

URL = "https://x.test/blog/post"
STATE = {"props": {"pageProps": {"page": {"title": "State title", "slug": "post", "category": {"tag": "AI"}, "subCategories": [{"tag": "LLM"}, "Tools"], "author": {"fullName": "Ann"}}}}}
MENU = "".join(f'<a href="/blog/category/c{i}">Menu {i}</a>' for i in range(70))


def page(state=None, jsonld="", meta="", body=""):
    script = f'<script id="__NEXT_DATA__" type="application/json">{state if isinstance(state, str) else json.dumps(state)}</script>' if state else ""
    return f"<html><head>{meta}{jsonld}</head><body><nav>{MENU}</nav>{body}{script}</body></html>"


def ld(value):
    return f'<script type="application/ld+json">{value if isinstance(value, str) else json.dumps(value)}</script>'


POST = {"@type": "BlogPosting", "headline": "LD title", "datePublished": "2024-05-21T23:00:00-05:00", "author": [{"name": "Bob"}], "description": "Described.", "keywords": "a, b"}


def rows(spark, *pages):
    return html.article_rows(spark.createDataFrame([(f"{URL}{i}", p) for i, p in enumerate(pages)], "url string, html string"), "2026-08-16").orderBy("url").collect()


def test_levels_of_tags(spark):
    menu = f'<article><h1>T</h1><div>{MENU}</div><p class="post-tags"><a href="/blog/tag/x">X</a><a href="/blog/tag/y">See more</a></p></article>'
    many = {**POST, "keywords": [f"k{i}" for i in range(70)]}
    got = rows(spark, page(STATE, ld(POST)), page(None, ld(POST)), page(None, ld(many), '<meta property="article:tag" content="M1"><meta property="article:tag" content="M2">'), page(body=menu), page(), page("{bad", ld("{bad")))
    assert [(r.tags, r.tag_source) for r in got] == [("AI|LLM|Tools", "__NEXT_DATA__"), ("a|b", "json-ld"), ("M1|M2", "meta"), ("X", "html"), ("", "none"), ("", "none")]
    assert (got[1].title, got[1].published_date, got[1].author, got[1].excerpt) == ("LD title", "2024-05-21", "Bob", "Described.")
    assert got[2].title == "LD title"


def test_fallbacks_of_fields(spark):
    body = '<article><header><h1>Head  line</h1></header><time datetime="May 21st, 2024"></time><a rel="author">Carl</a><p>short<p>A paragraph that is long enough to be taken as excerpt.</article>'
    got = rows(spark, page(body=body, meta='<meta name="author" content="https://x.test/carl">'), page(STATE))
    assert (got[0].title, got[0].published_date, got[0].author) == ("Head line", "2024-05-21", "Carl")
    assert got[0].excerpt == "A paragraph that is long enough to be taken as excerpt."
    assert (got[1].title, got[1].author) == ("State title", "Ann")


def test_nearest_group_of_links():
    far = "<p>x</p>" * 50
    body = f'<article><div><a href="/tag/far">Far</a></div>{far}<h1>T</h1><div><a href="/tag/near">Near</a><a href="/tag/2">12</a></div></article>'
    assert html.candidates(page(body=body), URL)["html_tags"] == ["Near"]


def test_links_of_listings(spark):
    listing = '<a href="/blog/a">1</a><a href="/blog/a/?x=1">again</a><a href="/blog/tags">t</a><a href="https://y.test/blog/b">o</a><a href="../blog/c#f">c</a><a href="mailto:x">m</a>'
    state = {"items": [{"slug": "s1", "title": "S"}, {"slug": "s2"}, {"deep": [{"slug": "/s3/", "title": "S3"}]}]}
    pages = spark.createDataFrame([("https://x.test/blog", page(body=listing)), ("https://x.test/list", page(state))], "url string, html string")
    got = html.article_links(pages).orderBy("page_url", "pos").collect()
    assert [r.url for r in got] == [f"https://x.test/blog/{x}" for x in ("a", "c", "s1", "s3")]


def test_articles_in_jsonld(spark):
    many = [
        ([json.dumps({"@graph": [{"@type": "WebPage"}, POST, 3]})], "LD title"),
        (["[1, {}]", json.dumps([{"@type": ["Thing", "https://schema.org/NewsArticle"], "headline": "N"}])], "N"),
        (["{bad", json.dumps({"@type": "WebPage", "headline": "W"})], None),
        (["null", json.dumps({"@type": None, "headline": "W"}), json.dumps({"headline": "W"})], None),
        ([json.dumps({"@type": "liveBlogPosting", "headline": ["x"]})], ""),
        ([], None),
        (None, None),
    ]
    df = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(many)], "id int, scripts array<string>").withColumn("node", html.jsonld_article(F.col("scripts")))
    got = df.select("id", F.when(F.col("node").isNotNull(), html._said(html._part(F.col("node"), "$.headline"))).alias("headline")).orderBy("id").collect()
    assert [r.headline for r in got] == [want for _, want in many]


def test_fields_of_jsonld_and_state(spark):
    ld_rows = [({"author": {"name": " A  B "}}, "A B"), ({"author": ["C", "D"]}, "C"), ({"author": []}, ""), ({"author": 3}, ""), ({}, "")]
    df = spark.createDataFrame([(i, json.dumps(x)) for i, (x, _) in enumerate(ld_rows)], "id int, v string").withColumn("v", F.try_parse_json("v"))
    assert [r[0] for r in df.orderBy("id").select(html.jsonld_author(F.col("v"))).collect()] == [w for _, w in ld_rows]
    tag_rows = [({"keywords": "a, b,,c", "about": [{"name": "d"}, "e", 3, {"x": 1}]}, ["a", "b", "c", "d", "e"]), ({"articleSection": ["s"], "keywords": {"name": "no"}}, ["s"]), ({}, [])]
    df = spark.createDataFrame([(i, json.dumps(x)) for i, (x, _) in enumerate(tag_rows)], "id int, v string").withColumn("v", F.try_parse_json("v"))
    assert [r[0] for r in df.orderBy("id").select(html.jsonld_tags(F.col("v"))).collect()] == [w for _, w in tag_rows]
    states = [({"category": "A", "subCategories": [{"tag": "B"}, "C", {"tag": 3}, None]}, ["A", "B", "C"]), ({"category": {"tag": "A"}, "subCategories": "no"}, ["A"]), (None, []), ([1], [])]
    df = spark.createDataFrame([(i, json.dumps({"props": {"pageProps": {"page": x}}})) for i, (x, _) in enumerate(states)], "id int, v string")
    assert [r[0] for r in df.orderBy("id").select(html.state_tags(html.state_page(F.col("v")))).collect()] == [w for _, w in states]


def test_robots_and_retries():
    robots = web.Robots("User-agent: *\nDisallow: /private\nCrawl-delay: 3\n")
    assert robots.allows("https://x.test/a") and not robots.allows("https://x.test/private/a") and robots.delay == 3
    waits: list[float] = []

    def answers(*codes):
        left = list(codes)

        def get(url):
            code = left.pop(0)
            if code is None:
                raise OSError("timeout")
            return code, "page"

        return get, left

    throttle = web.Throttle(0.1, 0.2, waits.append)
    assert (throttle.least, throttle.most) == (1.0, 1.0)
    for codes, want, unused in (((200,), "page", 0), ((503, None, 200), "page", 0), ((429, 500, 500), None, 0), ((404, 200), None, 1), ((403, 200), None, 1)):
        get, left = answers(*codes)
        assert web.fetch("https://x.test/a", robots, throttle, get) == want and len(left) == unused
    assert 2 in waits and 4 in waits
    assert web.fetch("https://x.test/private/a", robots, throttle, None) is None
    with pytest.raises(web.RobotsUnavailable):
        web.Robots.load("https://x.test", lambda url: (500, ""))


def test_listing_urls(spark):
    got = [r.url for r in web.listing_urls(spark, "https://x.test", 3).orderBy("page").collect()]
    assert got == ["https://x.test/blog", "https://x.test/blog?page=2", "https://x.test/blog?page=3"]


def test_distinct_keeps_the_order_of_firsts():
    assert html.distinct(["a", "b", "A", "", "c", "b"]) == ["a", "b", "c"]


def test_pages_until_nothing_new(spark):
    links = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (1, 2, "a"), (2, 0, "c"), (2, 1, "a"), (3, 0, "b"), (4, 0, "d"), (6, 0, "e")], "page long, pos long, url string")
    found = lambda first, last: [r.url for r in merge.until_nothing_new(links, spark.range(first, last + 1).withColumnRenamed("id", "page")).orderBy("page", "pos").collect()]
    assert found(1, 6) == ["a", "b", "c"]  # the third has known links only
    assert [r.url for r in merge.until_nothing_new(links.where("page <> 3"), spark.range(1, 7).withColumnRenamed("id", "page")).orderBy("page", "pos").collect()] == ["a", "b", "c"]


class Site(http.server.BaseHTTPRequestHandler):
    """A small site: listing pages with links, of which the second has one new and the third none."""

    pages: dict[str, str] = {}
    asked: list[str] = []

    def do_GET(self):  # noqa: N802
        self.asked.append(self.path)
        body = self.pages.get(self.path)
        self.send_response(200 if body is not None else 404)
        self.end_headers()
        self.wfile.write((body or "").encode())

    def log_message(self, *args):
        pass


@pytest.fixture
def site():
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    link = lambda *names: page(body="".join(f'<a href="/blog/{n}">{n}</a>' for n in names))
    Site.asked.clear()
    Site.pages = {"/robots.txt": "User-agent: *\nDisallow: /blog/secret", "/blog": link("b", "a", "b", "secret"), "/blog?page=2": link("a", "c"), "/blog?page=3": link("a", "b"), "/blog?page=4": link("d")}
    Site.pages |= {f"/blog/{n}": page(None, ld({**POST, "headline": f"Title {n}", "datePublished": f"2024-05-0{i}"})) for i, n in enumerate("abc", 1)}
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_crawl_of_a_site_twice(spark, site, tmp_path):
    out = str(tmp_path / "raw")
    assert cli.main(["crawl", "--base", site, "--pages", "5", "--output", out]) == 0
    got = files.load_raw(spark, out).orderBy("row_ord").collect()
    assert [(r.title, r.url) for r in got] == [(f"Title {n}", f"{site}/blog/{n}") for n in "cba"]
    listings = [x for x in Site.asked if x == "/blog" or "?page=" in x]
    assert listings == ["/blog", "/blog?page=2", "/blog?page=3"]  # the fourth is not asked for
    assert [x for x in Site.asked if x.startswith("/blog/")] == ["/blog/b", "/blog/a", "/blog/c"]
    # the second run finds another article and a changed one, and keeps the others
    Site.pages |= {"/blog": page(body='<a href="/blog/e">e</a><a href="/blog/a">a</a>'), "/blog/e": page(None, ld({**POST, "headline": "Title e", "datePublished": "2024-06-01"})), "/blog/a": page(None, ld({**POST, "headline": "Changed a", "datePublished": "2024-05-01"}))}
    assert cli.main(["crawl", "--base", site, "--pages", "1", "--output", out]) == 0
    assert [r.title for r in files.load_raw(spark, out).orderBy("row_ord").collect()] == ["Title e", "Title c", "Title b", "Changed a"]


def test_crawl_that_finds_nothing(spark, site, tmp_path):
    Site.pages |= {"/blog": page()}
    assert cli.main(["crawl", "--base", site, "--pages", "2", "--output", str(tmp_path / "raw")]) == 1
    del Site.pages["/robots.txt"]
    assert cli.main(["crawl", "--base", site, "--pages", "2", "--output", str(tmp_path / "raw")]) == 2
    assert not files.exists(spark, str(tmp_path / "raw"))


def test_crawl_merges_pages_with_earlier_rows(spark, tmp_path):
    old = [(f"{URL}{i}", f"Old {i}", "2020-01-0" + str(i + 1), "Ann", "x|y", "Text.", "2026-01-01") for i in (1, 2)]
    before = spark.createDataFrame(old, "url string, title string, published_date string, author string, tags string, excerpt string, scraped_at string")
    files.write_csv(before.select(*clean.RAW), str(tmp_path / "before"), single=True)
    fresh = spark.createDataFrame([(f"{URL}{i}", page(None, ld(POST))) for i in (0, 1)], "url string, html string")
    got = pipelines.crawl(spark, fresh, str(tmp_path / "before"), "2026-08-16").persist()
    pipelines.validate_raw(got)
    assert [(r.url, r.title, r.scraped_at) for r in got.collect()] == [(f"{URL}1", "LD title", "2026-08-16"), (f"{URL}0", "LD title", "2026-08-16"), (f"{URL}2", "Old 2", "2026-01-01")]
    assert pipelines.crawl(spark, fresh, str(tmp_path / "none"), "2026-08-16").count() == 2


def test_unclosed_references_are_text_where_asked(spark):
    page = '<article><h1>A &amp; B &lt;c&amp</h1><script id="__NEXT_DATA__">{"x": "R&amp D"}</script><a href="/blog/x?a=1&amp;b=2">&#38 &#38; &amp</a></article>'
    read = lambda closed: html.candidates(page, "https://x.test/", closed=closed)
    assert read(False)["title"][1] == "A & B <c&" and read(True)["title"][1] == "A & B <c&amp"
    assert read(True)["state"] == read(False)["state"] == '{"x": "R&amp D"}'
    rows = spark.createDataFrame([("https://x.test/", page)], "url string, html string")
    assert [html.article_rows(rows, "d", closed=c).first().title for c in (True, False)] == ["A & B <c&amp", "A & B <c&"]


def test_pages_are_freed_at_once():
    import gc
    import weakref

    kept = []

    class Watched(html.Root):
        __slots__ = ("__weakref__",)

        def __init__(self):
            super().__init__()
            kept.append(weakref.ref(self))

    page = "<article><p>" + "x " * 50 + '</p><a href="/blog/a">a</a></article>'
    gc.disable()
    before, html.Root = html.Root, Watched
    try:
        assert html.page_links(page, "https://x.test/") == html.candidates(page, "https://x.test/")["links"] == ["https://x.test/blog/a"]
        assert [x() for x in kept] == [None, None]
    finally:
        html.Root = before
        gc.enable()
