"""Parsers on literal documents: every fallback, and errors as data."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from kiteloom.sources import collect, discover, embedded, feeds, html, sitemaps

UTC = dt.timezone.utc
RSS = b"""<?xml version="1.0" encoding="UTF-8"?>
<rss version="2.0" xmlns:content="http://purl.org/rss/1.0/modules/content/" xmlns:dc="http://purl.org/dc/elements/1.1/"><channel><title>Blog</title>
<item><title> One </title><link>https://x.example/1?utm_source=f</link><description>short</description><content:encoded>&lt;p&gt;long\x08 text&lt;/p&gt;</content:encoded><pubDate>Tue, 02 Jan 2024 03:04:05 GMT</pubDate><dc:creator>Ann</dc:creator></item>
<item><title>Two</title><link>https://x.example/2</link><description>d</description><dc:date>2024-01-03T00:00:00Z</dc:date><author>Bob</author></item>
<item><link>https://x.example/3</link></item></channel></rss>"""
ATOM = b"""<feed xmlns="http://www.w3.org/2005/Atom"><title>B</title><entry><title>A</title><link rel="self" href="https://x.example/self"/><link href="https://x.example/a"/><summary>s</summary><content>c</content><updated>2024-01-02</updated><author><name>Ann</name></author></entry>
<entry><title>B</title><link rel="self" href="https://x.example/only"/><content>c</content><published>2024-01-01</published><updated>2024-01-02</updated></entry></feed>"""
RDF = b"""<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns="http://purl.org/rss/1.0/" xmlns:dc="http://purl.org/dc/elements/1.1/"><item><title>R</title><link>https://x.example/r</link><dc:date>2024-01-01</dc:date><dc:creator>Ann</dc:creator></item></rdf:RDF>"""
JSON = json.dumps({"items": [{"title": "J", "external_url": "https://x.example/j", "content_html": "<p>h</p>", "authors": [{"name": "Ann"}], "date_modified": "2024-01-01"}, {"title": "K", "url": "u", "summary": "s", "content_text": "t", "author": {"name": "Bob"}, "date_published": "d"}]}).encode()


def test_feeds():
    one, two, three = feeds.feed_items(RSS)
    assert one == {"title": "One", "link": "https://x.example/1?utm_source=f", "summary": "<p>long text</p>", "author": "Ann", "published_raw": "Tue, 02 Jan 2024 03:04:05 GMT"}
    assert (two["summary"], two["author"], two["published_raw"], three["title"]) == ("d", "Bob", "2024-01-03T00:00:00Z", "")
    a, b = feeds.feed_items(ATOM)
    assert (a["link"], a["summary"], a["author"], a["published_raw"]) == ("https://x.example/a", "s", "Ann", "2024-01-02")
    assert (b["link"], b["summary"], b["published_raw"]) == ("https://x.example/only", "c", "2024-01-01")
    assert feeds.feed_items(RDF) == [{"title": "R", "link": "https://x.example/r", "summary": "", "author": "Ann", "published_raw": "2024-01-01"}]
    j, k = feeds.feed_items(JSON)
    assert (j["link"], j["summary"], j["author"], j["published_raw"]) == ("https://x.example/j", "<p>h</p>", "Ann", "2024-01-01")
    assert (k["summary"], k["author"]) == ("s", "Bob")


@pytest.mark.parametrize("raw", [b"<html><body>no feed</body></html>", b"", None, b"<rss><channel>", b"{broken"])
def test_what_is_no_feed_is_an_error_row(raw):
    got = feeds.read_feed(raw)
    assert got["items"] == [] and got["error"]


def test_json_feed_by_built_ins_equals_the_parser(spark):
    df = spark.createDataFrame([(JSON.decode(),), ("{}",), (None,)], "doc string")
    got = [r.asDict() for r in collect.json_feed_items(df, "doc").drop("doc").collect()]
    assert got == feeds.feed_items(JSON)


PAGE = """<html><head><meta property="og:title" content="OG"><meta name="author" content="Meta"><script type="application/ld+json">[{"@type":"WebPage","datePublished":"2024-01-05"},
{"@graph":[{"@type":["BlogPosting"],"headline":"LD","author":[{"name":"Graph"}],"description":"ld text"}]}]</script></head><body><h1>H</h1><time datetime="2024-02-02">x</time></body></html>"""


def test_page_meta_precedence():
    assert html.page_meta(PAGE) == {"title": "OG", "published_raw": "2024-01-05", "author": "Graph", "subtitle": "ld text", "og_type": None, "has_article_schema": True, "declares_article": True}
    only_time = html.page_meta("<h1>A <b>B</b></h1><time>Aug 10</time>")
    assert (only_time["title"], only_time["published_raw"], only_time["declares_article"]) == ("A B", "Aug 10", False)
    assert html.page_meta('<meta property="og:type" content="article">')["declares_article"]
    assert html.page_meta(None)["title"] is None and html.page_meta('<script type="application/ld+json">{bad</script>')["author"] is None
    later_first = '<script type="application/ld+json">[{"@type":"Article","headline":"first"},{"@type":"Article","headline":"last"}]</script>'
    assert html.page_meta(later_first)["title"] == "last"


def test_main_text_and_plain_text():
    page = "<body><nav>menu menu menu menu</nav><article>short</article><div class='x post-content'><p>long</p> <p>enough<script>no()</script></p></div><footer>f</footer></body>"
    assert html.main_text(html.parse(page)) == "long\nenough"
    assert html.main_text(html.parse("<body><header>h</header><p>only</p></body>")) == "only"
    assert len(html.main_text(html.parse("<main>" + "x" * 9000 + "</main>"))) == 6000
    assert html.html_to_text("&lt;p&gt;a&lt;/p&gt;<!-- c -->", unescape=True) == "a" and html.html_to_text("<p> a </p><p></p><p>b", limit=2) == "a\n" and html.html_to_text(None) == ""


LIST = """<div><section><div><div><p>Jan 5, 2024</p><h2><a href="/ko/blog/first-post?utm_source=x">First</a></h2></div></div></section></div>
<a href="/blog/second-post">Second 2024-01-06</a><a href="/blog/tag/x">tag</a><a href="/blog/">list</a><a href="/blog/index.html">i</a><a href="https://other.example/blog/z">o</a><a href="/blog/first-post#c">dup?</a>"""


def test_list_entries_take_the_nearest_date():
    got = html.list_entries(LIST, "https://x.example/blog", "^/blog/[^/]+/?$", UTC, dt.datetime(2024, 2, 1, tzinfo=UTC))
    assert [e["url"] for e in got] == ["https://x.example/ko/blog/first-post", "https://x.example/blog/second-post", "https://x.example/blog/first-post"]
    assert [e["published_us"] is not None for e in got[:2]] == [True, True]
    deep = "<div>2024-01-01" + "<div>" * 4 + '<a href="/blog/aaa">a</a>' + "</div>" * 5
    assert html.list_entries(deep, "https://x.example/blog", "^/blog/", UTC)[0]["published_us"] is None


def records(n, **more):
    return [{"title": f"t{i}", "date": "2024-01-01", "slug": f"a {i}", **more} for i in range(n)]


def read(page, **params):
    return embedded.read_embedded(page, "https://x.example/blog/", json.dumps(params))


def test_embedded_payloads():
    edges = {"props": {"featured": records(2), "all": [{"node": r} for r in records(5, author={"node": {"name": "Ann"}})]}}
    page = f'<script id="__NEXT_DATA__" type="application/json">{json.dumps(edges)}</script>'
    got = read(page, url_template="https://x.example/{slug}")
    assert len(got["records"]) == 5 and got["records"][0]["url"] == "https://x.example/a%200" and got["records"][0]["author"] == "Ann"
    assert len(read(page, path="props.featured")["records"]) == 2
    assert read(page, path="props.nothing")["error"] and read(page, source="odd")["error"] and read("<p>none</p>")["error"]
    far = [{"x": i} for i in range(387)] + [{"articles": records(3)}]
    chunks = json.dumps("1:" + json.dumps(far))
    half = len(chunks) // 2
    while chunks[half - 1] == "\\":
        half += 1
    page = f'<script>self.__next_f.push([1,{chunks[:half]}"])</script><script>self.__next_f.push([1,"{chunks[half:]}])</script>'
    assert len(read(page, source="rsc")["records"]) == 3
    literal = 'const POSTS = [\n\xa0{title: "A // no comment", date: "2024-01-01", url: "https://x.example/a", tags: [1, 2,],}, // note\n{title: "B", date: "2024-01-02", url: "/b", authors: ["X", {"name": "Y"}]}, /* end */\n];'
    got = read(f"<script>{literal}</script>", source="js_literal")["records"]
    assert [(r["title"], r["url"], r["author"]) for r in got] == [("A // no comment", "https://x.example/a", None), ("B", "https://x.example/b", "X, Y")]
    mapped = read(f'<script id="__NEXT_DATA__">{json.dumps([{"h": "x", "d": "2024", "url": "/1"}, {"h": "y", "d": "2024", "url": "/2"}])}</script>', field_map={"title": "h", "date": "d"})
    assert [r["title"] for r in mapped["records"]] == ["x", "y"]


def test_quirks_of_values_are_kept():
    roles = embedded.Roles({"title": "a"})
    assert roles.value({"a": " "}, "title") == " " and roles.value({"a": 0}, "title") == 0 and roles.value({"a": "", "title": "x"}, "title") is None
    assert embedded.as_records(records(1), embedded.Roles()) == []
    first, last = [{"title": "x", "date": "d"}] * 2, [{"title": "y", "date": "d"}] * 2
    assert embedded.largest_records({"a": first, "b": last}, embedded.Roles()) == last  # of equally long lists the later one
    deep = first
    for _ in range(14):
        deep = [deep]
    assert embedded.largest_records(deep, embedded.Roles()) == first and embedded.largest_records([deep], embedded.Roles()) == []
    assert embedded.literal_json('[1, "]" /* ] */, {a: 1, b : [2,],},] tail', 0).replace(" ", "") == '[1,"]",{"a":1,"b":[2]}]'
    assert embedded.literal_json("[1, [2]", 0) is None and embedded.records_at({"a": [first]}, "a.0", embedded.Roles()) == first and embedded.records_at({"a": 1}, "a.b", embedded.Roles()) == []


def test_sitemaps():
    index = b"<sitemapindex>" + b"".join(b"<sitemap><loc>https://x.example/%d.xml</loc></sitemap>" % i for i in range(9)) + b"</sitemapindex>"
    assert len(sitemaps.read_sitemap(index)["children"]) == 8
    got = sitemaps.read_sitemap(b'<urlset xmlns="s"><url><loc> https://x.example/a </loc></url><url><lastmod>2024</lastmod></url></urlset>')
    assert sitemaps.read_sitemap(b"<urlset><url><loc>\x08https://x.example/c</loc></url></urlset>")["entries"][0]["loc"] == "https://x.example/c"
    assert got["entries"] == [{"loc": "https://x.example/a", "lastmod": None}] and sitemaps.read_sitemap(b"<x")["error"] and sitemaps.read_sitemap(None)["error"]


def test_sitemap_ends_at_the_first_old_entry(spark):
    us = lambda d: int(dt.datetime(2024, 1, d, tzinfo=UTC).timestamp() * 1e6)
    rows = [("a", ".", f"https://x.example/p{i}", us(d) if d else None) for i, d in enumerate([20, 18, 3, None])] + [("b", ".", "https://y.example/p", None), ("b", ".", "https://y.example/tags/x", None)]
    df = spark.createDataFrame(rows, "site string, pattern string, loc string, lastmod_us long")
    got = collect.sitemap_detail(collect.sitemap_candidates(df), us(19)).collect()
    assert sorted((r.site, r.loc[-2:]) for r in got) == [("a", "p0"), ("a", "p1"), ("b", "/p")]


def test_known_entries_spend_nothing_of_the_cap(spark):
    us = lambda d: int(dt.datetime(2024, 1, d, tzinfo=UTC).timestamp() * 1e6)
    urls = [f"https://x.example/p{i:02d}" for i in range(70)]
    df = spark.createDataFrame([("a", ".", u, us(20), u) for u in urls], "site string, pattern string, loc string, lastmod_us long, url string")
    known = spark.createDataFrame([(u,) for u in urls[:60]], "url string")
    assert sorted(r.loc for r in collect.sitemap_detail(df, us(19), known).collect()) == urls[60:]
    assert collect.sitemap_detail(df, us(19)).count() == collect.DETAIL_CAP_SITEMAP


def test_a_run_of_six_old_pages_ends_a_list(spark):
    ages = {"five": ["old"] * 5 + ["new"] + ["old"] * 6 + ["new"], "six": ["old"] * 3 + [None] + ["old"] * 3 + ["new"]}
    rows = [(site, i, a) for site, values in ages.items() for i, a in enumerate(values)]
    kept = collect.stop_at_old_runs(spark.createDataFrame(rows, "site string, ord int, age string")).groupBy("site").count().collect()
    assert {r["site"]: r["count"] for r in kept} == {"five": 12, "six": 7}


def test_source_variants(spark):
    extra = json.dumps({"date_from": "detail", "extra_sources": ["https://b", {"source_url": "https://c", "date_from": "list"}, "https://a", " "]})
    df = spark.createDataFrame([("s", "https://a", extra), ("t", "https://t", None), ("u", "https://u", "{bad")], "name string, source_url string, params string")
    got = [(r["name"], r.variant, r.source_url, json.loads(r.params).get("date_from") if r.params and r.variant else None) for r in collect.source_variants(df).orderBy("name", "variant").collect()]
    assert got == [("s", 0, "https://a", None), ("s", 1, "https://b", "detail"), ("s", 2, "https://c", "list"), ("t", 0, "https://t", None), ("u", 0, "https://u", None)]


def test_decoding(spark):
    df = spark.createDataFrame([(bytearray("é".encode("latin-1")), "text/html; charset=ISO-8859-1"), (bytearray("한".encode()), "text/xml"), (bytearray("é".encode()), "text/html; charset=nope"), (None, None)], "c binary, t string")
    assert [r[0] for r in df.select(collect.decoded(F.col("c"), F.col("t"))).collect()] == ["é", "한", "é", None]


def test_discovery(spark):
    page = '<link rel="alternate" type="application/rss+xml" href="/own.xml"><a href="/blog/first-long-post">a</a><a href="/blog/second-long-post">b</a><a href="/blog/third-long-post">c</a><a href="/about">d</a>'
    pages = spark.createDataFrame([("https://x.example/blog", page)], "url string, text string")
    sites = spark.createDataFrame([("x", "https://x.example/blog")], "name string, url string")
    candidates = discover.candidate_feeds(sites, pages)
    assert candidates.orderBy("priority").first().feed_url == "https://x.example/own.xml"
    raw = spark.createDataFrame([("https://x.example/feed", bytearray(RSS), None, 0), ("https://x.example/rss", bytearray(b"<html/>"), None, 0)], "source_url string, content binary, tz string, now_us long")
    best = discover.validated_feeds(candidates, raw).collect()
    assert [(r.feed_url, r.n_items, r.n_dated, r.any_author) for r in best] == [("https://x.example/feed", 3, 2, True)]
    shapes = discover.frequent_shapes(discover.page_links(pages)).collect()
    assert [(r.url, r["shape"], r.n) for r in shapes] == [("https://x.example/blog", "^/blog/[^/]+/?$", 3)]
    links = discover.page_links(pages)
    samples = discover.sampled_links(links, discover.frequent_shapes(links))
    assert sorted(r.link for r in samples.collect()) == ["https://x.example/blog/first-long-post", "https://x.example/blog/second-long-post"]
    facts = spark.createDataFrame([("https://x.example/blog/first-long-post", True, True)], "url string, dated boolean, is_article boolean")
    best = discover.best_shape(discover.frequent_shapes(links), samples, facts).collect()
    assert [(r.url, r["shape"], r.n_links) for r in best] == [("https://x.example/blog", "^/blog/[^/]+/?$", 3)]
    votes = spark.createDataFrame([("x", True), ("x", True), ("x", False), ("y", True), ("y", False)], "name string, dated boolean")
    assert {r.name: r.from_detail for r in discover.detail_vote(votes).collect()} == {"x": True, "y": False}
    signal = spark.createDataFrame([("u", f'<script id="__NEXT_DATA__">{json.dumps(records(3))}</script>'), ("v", "none")], "url string, text string")
    assert [(r.url, r.source, r.n_records) for r in discover.embedded_signal(signal).collect()] == [("u", "next_data", 3)]
    line = discover.registry_rows(spark.createDataFrame([("n", "u", "feed", "s", None, None, "1", "a,b")], "name string, url string, fetcher string, source_url string, tz string, params string, enabled string, note string")).first()[0]
    assert line.count(",") == 8 and line.endswith('"a,b"')
