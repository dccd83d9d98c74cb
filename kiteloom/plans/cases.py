"""Queries over literal documents, with the rows they must give as SQL: parsers and tiers that no table feeds."""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kiteloom.functions import urls
from kiteloom.functions.dates import parse_date_column
from kiteloom.functions.instants import attach_zones, with_instant
from kiteloom.functions.windows import Window, date_label, local_label
from kiteloom.plans import pipelines
from kiteloom.sources import collect, discover, storage

UTC = dt.timezone.utc
NOW = dt.datetime(2026, 3, 1, tzinfo=UTC)


def _us(*when: int) -> int:
    return int(dt.datetime(*when, tzinfo=UTC).timestamp()) * 1_000_000


def _values(columns: list[str], rows: list[tuple]) -> str:
    def text(v) -> str:
        return "NULL" if v is None else str(v).lower() if isinstance(v, bool) else f"CAST({v} AS BIGINT)" if isinstance(v, int) else "'" + v.replace("'", "''") + "'"

    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(text, r)) + ")" for r in rows) + f") t({', '.join(columns)})"


# ---------------------------------------------------------------- dates and times

#: Lenient readings in a zone nine hours east; without year the latest day at most a day ahead of 2026-03-01.
DATES = [
    ("2026-08-13T10:00:00Z", _us(2026, 8, 13, 10)), ("2026-08-13T10:00:00", _us(2026, 8, 13, 1)), ("20260813", _us(2026, 8, 12, 15)), ("2026", None), ("Thu, 13 Aug 2026 10:00:00 -0500", _us(2026, 8, 13, 15)),
    ("Thu, 13 Aug 2026 10:00:00 KST", _us(2026, 8, 13, 1)), ("Posted 2026. 8. 13. by me", _us(2026, 8, 12, 15)), ("2026년 8월 13일", _us(2026, 8, 12, 15)), ("2026/13/45", None), ("Aug 13", _us(2025, 8, 12, 15)),
    ("Mar 2", _us(2026, 3, 1, 15)), ("Mar 3", _us(2025, 3, 2, 15)), ("13 Aug 2026", None), ("Marketing 12", _us(2025, 3, 11, 15)), ("August 3rd, 2024", _us(2024, 8, 2, 15)), ("Feb 29", None), ("5일 전", _us(2026, 2, 24)), ("3시간 전", _us(2026, 2, 28, 21)),
    ("2개월 전", _us(2025, 12, 31)), ("99999999999년 전", None), ("", None), ("no date", None),
]


def lenient_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.createDataFrame([(t,) for t, _ in DATES], "text string")
    got = parse_date_column(F.col("text"), F.lit("Asia/Seoul"), F.lit(int(NOW.timestamp()) * 1_000_000).cast("long"))
    return df.select("text", got["us"].alias("us"))


#: Instants of problem 3: every shape, zones, and both kinds of clock change; fetched at noon of 2025-03-10.
TIMES = [
    ("ny", "2024-03-10T02:30:00", _us(2024, 3, 10, 7, 30)), ("ny", "2024-11-03 01:30", _us(2024, 11, 3, 5, 30)), ("ny", "2024-11-03 01:30 CST", _us(2024, 11, 3, 7, 30)), ("seoul", "2024. 1. 2.", _us(2024, 1, 1, 15)),
    ("seoul", "2024년 1월 2일 오후 3:04", _us(2024, 1, 2, 6, 4)), ("plus", "02.01.2024, 05:06", _us(2024, 1, 1, 20, 6)), ("utc", "01/02/2024 5:06 PM", _us(2024, 1, 2, 17, 6)), ("utc", "20240102T030405Z", _us(2024, 1, 2, 3, 4, 5)),
    ("utc", "Tue, 02 Jan 2024 03:04:05 +0900", _us(2024, 1, 1, 18, 4, 5)), ("utc", "1704164645", _us(2024, 1, 2, 3, 4, 5)), ("utc", "1704164645000", _us(2024, 1, 2, 3, 4, 5)), ("utc", "15 de enero de 2024", _us(2024, 1, 15)), ("utc", "March 12", _us(2024, 3, 12)),
    ("utc", "March 11", _us(2025, 3, 11)), ("utc", "hace 2 días", _us(2025, 3, 8, 12)), ("utc", "vor 3 Stunden", _us(2025, 3, 10, 9)), ("utc", "5분 전", _us(2025, 3, 10, 11, 55)), ("none", "2024-01-02", None), ("none", "2024-01-02T00:00:00Z", _us(2024, 1, 2)),
    ("utc", "2024-02-30", None), ("utc", "soon", None), ("unknown", "2024-01-02", _us(2024, 1, 2)),
]


def time_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites = spark.createDataFrame([("ny", "America/New_York"), ("seoul", "asia/seoul"), ("plus", "UTC+9"), ("utc", None), ("none", "Nowhere/Land")], "name string, tz string")
    rows = spark.createDataFrame([(s, t, _us(2025, 3, 10, 12)) for s, t, _ in TIMES], "site string, text string, fetched long")
    return with_instant(attach_zones(rows, sites), "text", "fetched").select("site", "text", "utc_us")


def date_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    stamps = spark.createDataFrame([(_us(2024, 1, 1, 15, 30),), (_us(2024, 2, 29, 3),)], "us long").withColumn("ts", F.timestamp_micros("us"))
    return stamps.select("us", local_label(F.col("ts"), "Asia/Seoul").alias("label"), date_label(F.col("ts"), "Asia/Seoul").alias("day"))


# ---------------------------------------------------------------- pages and payloads

def _script(kind: str, data) -> str:
    return f'<script type="application/ld+json">{json.dumps(data)}</script>' if kind == "ld" else f'<script id="__NEXT_DATA__" type="application/json">{json.dumps(data)}</script>'


PAGES = {
    "graph": _script("ld", {"@graph": [{"@type": "WebPage", "datePublished": "2024-01-05"}, {"@type": ["BlogPosting"], "headline": "LD", "author": [{"name": "Ann"}], "description": "text"}]}),
    "last": _script("ld", [{"@type": "Article", "headline": "first", "author": "Bob"}, {"@type": "TechArticle", "headline": "last", "datePublished": "2024-02-03"}]),
    "meta": '<meta property="og:title" content=" OG "><meta name="og:title" content="no"><meta property="article:author" content="Cy">' + _script("ld", {"@type": "Report", "headline": "LD"}),
    "time": "<h1>A <b>B</b></h1><time datetime='2024-03-04'>x</time>", "text time": "<h1>T</h1><time>Aug 10</time>", "type": '<meta property="og:type" content="article">', "broken": '<script type="application/ld+json">{bad</script>', "none": "",
}


def page_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.createDataFrame(list(PAGES.items()), "page string, text string")
    return collect.parsed_pages(df).select("page", "meta.title", "meta.published_raw", "meta.author", "meta.subtitle", "meta.declares_article")


_POSTS = [{"title": f"t{i}", "date": "2024-01-01", "slug": f"a {i}"} for i in range(3)]
_NODES = [{"node": {"headline": f"n{i}", "publishedAt": "2024-01-02", "url": f"/n{i}", "authors": ["X", {"name": "Y"}], "excerpt": " e "}} for i in range(4)]
_CHUNK = json.dumps("1:" + json.dumps([{"x": 1}] * 60 + [{"list": _POSTS}]))
PAYLOADS = {
    "largest": (_script("next", {"featured": _POSTS[:2], "all": {"edges": _NODES}}), {}),
    "path": (_script("next", {"a": [{"b": _POSTS}]}), {"path": "a.0.b", "url_template": "https://x.example/p/{slug}"}),
    "stream": (f"<script>self.__next_f.push([1,{_CHUNK[:20]}\"])</script><script>self.__next_f.push([1,\"{_CHUNK[20:]}])</script>", {"source": "rsc", "url_template": "/{slug}"}),
    "literal": ('<script>let ITEMS = [\n\xa0{title: "A // no [remark", date: "2024-01-01", url: "https://x.example/a", tags: [1, 2,],}, // note ]\n{title: "B", date: "2024-01-02", url: "/b", author: {node: {name: "Cy"}}}, /* end */\n];</script>', {"source": "js_literal", "variable": "ITEMS"}),
    "mapped": (_script("next", [{"h": "x", "d": "2024", "href": "/1"}, {"h": "y", "d": "2024", "href": "/2"}]), {"field_map": {"title": "h", "date": "d"}}),
    "number": (_script("next", [{"title": "x", "date": 5, "url": "/1"}, {"title": "y", "date": "2024", "url": "/2"}]), {}),
    "none": ("<p>nothing</p>", {}), "odd": ("", {"source": "odd"}), "single": (_script("next", _POSTS[:1]), {}),
}


def embedded_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.createDataFrame([(k, page, "https://x.example/blog/", json.dumps(params)) for k, (page, params) in PAYLOADS.items()], "payload string, text string, base string, params string")
    read = collect.parsed_embedded(df, "text", "base", "params").select("payload", F.col("embedded.error").isNotNull().alias("failed"), F.posexplode_outer("embedded.records").alias("place", "r"))
    return read.select("payload", "failed", F.col("place").cast("long").alias("place"), "r.title", "r.url", "r.date_raw", "r.author", "r.subtitle")


TEXTS = {
    "<p> a </p><p></p><p>b<br>c": "a\nb\nc", "&lt;p&gt;kept&lt;/p&gt;": "<p>kept</p>", "x<script>no()</script><style>s</style><!-- c -->y": "x\ny", "": "",
    "<body><nav>menu menu menu</nav><article>short</article><div class='x post-content'><p>long</p> <p>enough</p></div></body>": "menu menu menu\nshort\nlong\nenough",
}


def plain_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.createDataFrame([(t,) for t in TEXTS], "markup string")
    return df.select("markup", collect.text_of(F.col("markup")).alias("text"), collect.main_text_of(F.col("markup")).alias("main"))


# ---------------------------------------------------------------- tiers

WINDOW = Window(dt.datetime(2024, 1, 10, tzinfo=UTC), dt.datetime(2024, 1, 11, tzinfo=UTC))
_META = "struct<title:string,published_raw:string,author:string,subtitle:string,og_type:string,has_article_schema:boolean,declares_article:boolean>"


def _page(title: str, date: str | None, article: bool = True) -> dict:
    return {"title": title, "published_raw": date, "author": None, "subtitle": None, "og_type": None, "has_article_schema": article, "declares_article": article}


def _urlset(*entries: tuple) -> bytearray:
    return bytearray(("<urlset>" + "".join(f"<url><loc>{u}</loc>" + (f"<lastmod>{d}</lastmod>" if d else "") + "</url>" for u, d in entries) + "</urlset>").encode())


def _tier_inputs(spark: SparkSession):
    """Sites of the sitemap and list tiers, their documents and pages."""
    sites = [
        ("index", "sitemap", "https://i.example/", {"article_regex": "^/blog/"}), ("trusted", "sitemap", "https://t.example/x", {"article_regex": "^/p/", "date_from": "lastmod"}), ("capped", "sitemap", "https://c.example/", {"article_regex": "^/p/"}),
        ("broken", "sitemap", "https://b.example/", {}), ("paged", "html_list", "https://l.example/blog", {"article_regex": "^/blog/[^/]+/?$", "date_from": "list", "page_url": "https://l.example/blog?page={page}"}),
        ("detail", "html_list", "https://d.example/blog", {"article_regex": "^/blog/[^/]+/?$", "page_url": "https://d.example/blog/{page}", "max_articles": 2}),
    ]
    registry = storage.normalise_sites(spark.createDataFrame([(n, u, f, u, None, json.dumps(p), "1", "") for n, f, u, p in sites], "name string, url string, fetcher string, source_url string, tz string, params string, enabled string, note string"))
    known = [f"https://c.example/p/k{i}" for i in range(60)]
    card = lambda slug, date: f'<div><p>{date}</p><h2><a href="/blog/{slug}">{slug}</a></h2></div>'
    documents = {
        "https://i.example/sitemap.xml": bytearray(b"<sitemapindex>" + b"".join(b"<sitemap><loc>https://i.example/%d.xml</loc></sitemap>" % i for i in range(9)) + b"</sitemapindex>"),
        "https://i.example/0.xml": _urlset(("https://i.example/blog/one", "2024-01-10T05:00:00Z"), ("https://i.example/tag/one", "2024-01-10")), "https://i.example/1.xml": bytearray(_urlset(("https://i.example/blog/two", None)).replace(b"<loc>", b"\x08<loc>")),
        "https://i.example/8.xml": _urlset(("https://i.example/blog/nine", "2024-01-10")),  # beyond the first eight
        "https://t.example/sitemap.xml": _urlset(("https://t.example/p/in", "2024-01-10T08:00:00+09:00"), ("https://t.example/p/ahead", "2024-02-01"), ("https://t.example/p/lost", "2024-01-10"), ("https://t.example/p/undated", None)),
        "https://c.example/sitemap.xml": _urlset(*[(u, "2024-01-10T23:00:00Z") for u in known], ("https://c.example/p/new", "2024-01-10T01:00:00Z"), ("https://c.example/p/old", "2023-01-01")),
        "https://b.example/sitemap.xml": bytearray(b"<html>"),
        "https://l.example/blog": bytearray((card("a1", "2024-01-10") + card("a2", "2024-01-12")).encode()), "https://l.example/blog?page=2": bytearray((card("a1", "2024-01-10") + card("b1", "2024-01-10") + card("b2", "2024-01-02")).encode()),
        "https://l.example/blog?page=3": bytearray(card("c1", "2024-01-10").encode()),
        "https://d.example/blog": bytearray(b"".join(b'<a href="/blog/d%d">x</a>' % i for i in range(4))), "https://d.example/blog/2": bytearray(b"".join(b'<a href="/blog/d%d">x</a>' % i for i in (0, 1, 2, 3, 4))),
    }
    pages = {
        "https://i.example/blog/one": _page("One | Site", None), "https://i.example/blog/two": _page("Two", "2024-01-10T06:00:00+02:00"), "https://i.example/blog/nine": _page("Nine", "2024-01-10"),
        "https://t.example/p/in": _page("In", "2020-01-01", False), "https://c.example/p/new": _page("New", None), "https://c.example/p/old": _page("Old", "2024-01-10"), **{u: _page("known", None) for u in known},
        **{f"https://l.example/blog/{s}": _page(s, None, False) for s in ("a1", "a2", "b1", "b2", "c1")}, **{f"https://d.example/blog/d{i}": _page(f"d{i}", "2024-01-10" if i != 1 else "2024-01-09") for i in range(5)},
    }
    raw = spark.createDataFrame([(u, c, "text/xml; charset=utf-8") for u, c in documents.items()], "source_url string, content binary, content_type string")
    facts = spark.createDataFrame(list(pages.items()), f"url string, meta {_META}")
    return registry, raw, facts, spark.createDataFrame([(u,) for u in known], "url string")


def tier_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    registry, raw, facts, known = _tier_inputs(spark)
    articles, _ = pipelines.tiers(registry, raw, facts, known, WINDOW, NOW, "en", max_pages=5)
    return articles.select("site", "title", "url", F.unix_micros("published_at").alias("us"), F.col("published_offset_s").cast("long").alias("offset_s"))


def tier_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    registry, raw, facts, known = _tier_inputs(spark)
    _, results = pipelines.tiers(registry, raw, facts, known, WINDOW, NOW, "en", max_pages=5)
    return results.select("site", F.col("newest_seen").alias("newest_us"), F.substring_index("error", ":", 1).alias("error"))


VARIANTS = [("s", "https://a", {"date_from": "detail", "extra_sources": ["https://b", {"source_url": "https://c", "date_from": "list"}, "https://a", " "]}), ("t", "https://t", None)]


def source_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.createDataFrame([(n, u, None if p is None else json.dumps(p)) for n, u, p in VARIANTS], "name string, source_url string, params string")
    return collect.source_variants(df).select("name", F.col("variant").cast("long").alias("variant"), "source_url", F.get_json_object("params", "$.date_from").alias("date_from"))


def address_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.createDataFrame([("https://medium.com/pub", "A b/ü", 1), ("https://x.example/blog?q", "Title | Blog", 3)], "url string, title string, page int")
    template = F.lit("https://x.example/blog?page={page}")
    return df.select(
        "url", urls.slug(F.col("title")).alias("slug"), urls.sitemap_url(F.col("url"), F.lit(None).cast("string")).alias("sitemap"), urls.page_url(template, F.col("url"), F.col("page")).alias("list_page"),
        urls.strip_suffix(F.col("title"), F.lit(" | Blog")).alias("title"), urls.feed_candidates(F.col("url"))[0].alias("first_feed"), F.size(urls.feed_candidates(F.col("url"))).cast("long").alias("n_feeds"))


def discovered_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed = lambda date: bytearray(f"<rss><channel><item><title>T</title><link>https://f2.example/1</link><author>Ann</author><pubDate>{date}</pubDate></item></channel></rss>".encode())
    links = "".join(f'<a href="/about-{i}">n</a>' for i in range(5)) + "".join(f'<a href="/blog/long-post-{i}">p</a>' for i in range(4))
    pages = {
        "https://f1.example/": '<link rel="alternate" type="application/rss+xml" href="/own.xml">', "https://f2.example/": "", "https://e.example/": _script("next", _POSTS), "https://h.example/": links, "https://n.example/": "<p>none</p>",
        "https://f2.example/1": '<meta property="article:published_time" content="2024-01-01">', **{f"https://h.example/about-{i}": "<h1>About</h1>" for i in range(5)},
        **{f"https://h.example/blog/long-post-{i}": '<meta property="og:type" content="article"><time>2024-01-01</time>' for i in range(4)},
    }
    sites = spark.createDataFrame([(n, f"https://{n}.example/", None) for n in ("f1", "f2", "e", "h", "n", "gone")], "name string, url string, tz string")
    raw = spark.createDataFrame([("https://f1.example/own.xml", feed("2024-01-02")), ("https://f1.example/feed", feed("2024-01-01")), ("https://f2.example/rss", feed("")), ("https://e.example/feed", bytearray(b"<html/>"))], "source_url string, content binary")
    found = discover.discover(sites, spark.createDataFrame(list(pages.items()), "url string, text string"), raw, int(NOW.timestamp()) * 1_000_000)
    return found.select("name", "fetcher", "source_url", "params", "entries", "dated", "newest_us", "has_author")


QUERIES = [lenient_dates, time_shapes, date_labels, page_facts, embedded_payloads, plain_texts, tier_articles, tier_results, source_variants, address_helpers, discovered_sources]


def oracles() -> dict[str, str]:
    post = lambda name, i, base: (name, False, i, f"t{i}", f"{base}a%20{i}", "2024-01-01", None, None)
    known_us = _us(2024, 1, 10, 1)
    return {
        "lenient_dates": _values(["text", "us"], DATES),
        "time_shapes": _values(["site", "text", "utc_us"], TIMES),
        "date_labels": _values(["us", "label", "day"], [(_us(2024, 1, 1, 15, 30), "01-02 00:30", "2024-01-02 (화)"), (_us(2024, 2, 29, 3), "02-29 12:00", "2024-02-29 (목)")]),
        "page_facts": _values(["page", "title", "published_raw", "author", "subtitle", "declares_article"], [
            ("graph", "LD", "2024-01-05", "Ann", "text", True), ("last", "last", "2024-02-03", None, None, True), ("meta", "OG", None, "Cy", None, True), ("time", "A B", "2024-03-04", None, None, False),
            ("text time", "T", "Aug 10", None, None, False), ("type", None, None, None, None, True), ("broken", None, None, None, None, False), ("none", None, None, None, None, False)]),
        "embedded_payloads": _values(["payload", "failed", "place", "title", "url", "date_raw", "author", "subtitle"], [
            *[("largest", False, i, f"n{i}", f"https://x.example/n{i}", "2024-01-02", "X, Y", "e") for i in range(4)], *[post("path", i, "https://x.example/p/") for i in range(3)], *[post("stream", i, "/") for i in range(3)],
            ("literal", False, 0, "A // no [remark", "https://x.example/a", "2024-01-01", None, None), ("literal", False, 1, "B", "https://x.example/b", "2024-01-02", "Cy", None),
            ("mapped", False, 0, "x", "https://x.example/1", "2024", None, None), ("mapped", False, 1, "y", "https://x.example/2", "2024", None, None),
            ("number", False, 0, "x", "https://x.example/1", None, None, None), ("number", False, 1, "y", "https://x.example/2", "2024", None, None),
            *[(n, True, None, None, None, None, None, None) for n in ("none", "odd", "single")]]),
        "plain_texts": _values(["markup", "text", "main"], [(m, t, {"<body>": "long\nenough"}.get(m[:6], t)) for m, t in TEXTS.items()]),
        "tier_articles": _values(["site", "title", "url", "us", "offset_s"], [
            ("index", "One | Site", "https://i.example/blog/one", _us(2024, 1, 10, 5), 0), ("index", "Two", "https://i.example/blog/two", _us(2024, 1, 10, 4), 7200), ("capped", "New", "https://c.example/p/new", known_us, 0),
            ("paged", "a1", "https://l.example/blog/a1", _us(2024, 1, 10), None), ("paged", "b1", "https://l.example/blog/b1", _us(2024, 1, 10), None),
            ("detail", "d0", "https://d.example/blog/d0", _us(2024, 1, 10), 0), ("detail", "d2", "https://d.example/blog/d2", _us(2024, 1, 10), 0), ("detail", "d3", "https://d.example/blog/d3", _us(2024, 1, 10), 0)]),
        "tier_results": _values(["site", "newest_us", "error"], [
            ("index", _us(2024, 1, 10, 5), None), ("trusted", _us(2024, 2, 1), None), ("capped", known_us, None), ("broken", None, "ParseError"), ("paged", _us(2024, 1, 12), None), ("detail", _us(2024, 1, 10), None)]),
        "source_variants": _values(["name", "variant", "source_url", "date_from"], [("s", 0, "https://a", "detail"), ("s", 1, "https://b", "detail"), ("s", 2, "https://c", "list"), ("t", 0, "https://t", None)]),
        "address_helpers": _values(["url", "slug", "sitemap", "list_page", "title", "first_feed", "n_feeds"], [
            ("https://medium.com/pub", "A%20b%2F%C3%BC", "https://medium.com/sitemap.xml", "https://medium.com/pub", "A b/ü", "https://medium.com/feed/pub", 31),
            ("https://x.example/blog?q", "Title%20%7C%20Blog", "https://x.example/sitemap.xml", "https://x.example/blog?page=3", "Title", "https://x.example/blog/index.xml", 27)]),
        "discovered_sources": _values(["name", "fetcher", "source_url", "params", "entries", "dated", "newest_us", "has_author"], [
            ("f1", "feed", "https://f1.example/own.xml", None, 1, 1, _us(2024, 1, 2), True), ("f2", "feed", "https://f2.example/rss", '{"date_from":"detail"}', 1, -1, None, True),
            ("e", "embedded", "https://e.example/", '{"source":"next_data"}', 3, None, None, None), ("h", "html_list", "https://h.example/", '{"article_regex":"^/blog/[^/]+/?$","date_from":"detail"}', 5, 1, None, None),
            ("n", None, None, None, None, None, None, None), ("gone", None, None, None, None, None, None, None)]),
    }
