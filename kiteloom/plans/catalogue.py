"""Queries of the core operators over whole tables, and the SQL that they equal.

Instants are compared as microseconds since 1970 UTC, so that no session zone plays a part.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kiteloom.functions import urls
from kiteloom.functions.civil import ntz_micros
from kiteloom.functions.windows import Window, window_day
from kiteloom.operators import records, site_state
from kiteloom.operators.normalise_time import normalised_times
from kiteloom.plans import cases, report
from kiteloom.plans.runtime import load, small_side
from kiteloom.schema import Settings
from kiteloom.sources import collect, storage

UTC = dt.timezone.utc
RANGE = Window(dt.datetime(2024, 1, 1, tzinfo=UTC), dt.datetime(2024, 7, 1, tzinfo=UTC))
TODAY = dt.date(2025, 12, 31)


# ---------------------------------------------------------------- inputs

def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The articles table as records: the wall clock minus its offset is the instant."""
    a = load(spark, sf_dir, "articles")
    us = ntz_micros(F.col("published_at")) - F.coalesce(F.col("published_offset_s"), F.lit(0)).cast("long") * 1_000_000
    return a.withColumn("published_at", F.timestamp_micros(us)).filter(F.col("published_at").isNotNull())


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as records: one site per type, one author per user, a null score for every seventh."""
    e = load(spark, sf_dir, "events")
    k = F.regexp_extract("props", r'"k": *([0-9]+)', 1)
    return e.select(
        F.col("event_type").alias("site"), F.concat_ws(" ", "event_type", k).alias("title"),
        F.concat(F.lit("https://"), F.col("event_type"), F.lit(".example/"), k).alias("url"), F.timestamp_micros(ntz_micros(F.col("ts"))).alias("published_at"),
        F.col("user_id").cast("string").alias("author"), F.lit(None).cast("string").alias("subtitle"),
        F.when(F.col("event_id") % 7 != 0, F.floor(F.abs("value")).cast("long") % 11).cast("int").alias("score"),
        F.array().cast("array<string>").alias("interests"), F.lit(None).cast("string").alias("reason"), F.array().cast("array<string>").alias("summary"),
        F.lit(None).cast("string").alias("body"), F.col("event_id").cast("long").alias("seq"), F.lit(0).alias("published_offset_s"),
    )


def _us(column: str = "published_at") -> Column:
    return F.unix_micros(column)


_ARTICLES = """
WITH a AS (SELECT * EXCLUDE (published_at), epoch_us(published_at) - CAST(coalesce(published_offset_s, 0) AS BIGINT) * 1000000 AS us,
  (CASE WHEN coalesce(len(summary), 0) > 0 THEN 4 ELSE 0 END) + (CASE WHEN score IS NOT NULL THEN 2 ELSE 0 END)
  + (CASE WHEN coalesce(subtitle, '') <> '' THEN 1 ELSE 0 END) + (CASE WHEN coalesce(author, '') <> '' THEN 1 ELSE 0 END) AS rich
  FROM articles WHERE published_at IS NOT NULL)"""
_EVENTS = """
WITH a AS (SELECT event_type AS site, event_type || ' ' || regexp_extract(props, '"k": *([0-9]+)', 1) AS title,
  'https://' || event_type || '.example/' || regexp_extract(props, '"k": *([0-9]+)', 1) AS url, epoch_us(ts) AS us, CAST(user_id AS VARCHAR) AS author,
  CASE WHEN event_id % 7 <> 0 THEN CAST(floor(abs(value)) AS BIGINT) % 11 END AS score, CAST(event_id AS BIGINT) AS seq,
  (CASE WHEN event_id % 7 <> 0 THEN 2 ELSE 0 END) + 1 AS rich FROM events)"""
#: Local date of the close of the daily window (noon in Seoul is 03:00 UTC).
_DAY = "CAST(make_timestamp(us - 3 * 3600000000) AS DATE) + 1"
_BEST = "SELECT *, row_number() OVER (PARTITION BY url ORDER BY rich DESC, seq) AS rn, min(seq) OVER (PARTITION BY url) AS url_seq FROM a"
_RANGE = f"us >= {int(RANGE.start.timestamp() * 1e6)} AND us < {int(RANGE.end.timestamp() * 1e6)}"


# ---------------------------------------------------------------- queries

def p3_found(spark, sf_dir):
    return normalised_times(*[load(spark, sf_dir, t) for t in ("feed_items", "page_meta", "articles", "sites")])


def digest_top_k_per_window(spark, sf_dir):
    kept = records.dedupe(articles(spark, sf_dir)).withColumn("day", window_day(F.col("published_at")))
    return records.select_top(kept, k=5, threshold=5, per=["day"]).select("day", "url", "seq", "score", _us().alias("us"))


def digest_sections(spark, sf_dir):
    kept = records.dedupe(events(spark, sf_dir)).withColumn("day", window_day(F.col("published_at")))
    return report.digest_rows(kept, Settings(), per=["day"]).select("day", "url", "position", "section")


def window_half_open_filter(spark, sf_dir):
    inside = articles(spark, sf_dir).filter(RANGE.contains(F.col("published_at")))
    return inside.groupBy("site").agg(F.count("*").alias("n"))


def daily_window_counts(spark, sf_dir):
    return articles(spark, sf_dir).groupBy(window_day(F.col("published_at")).alias("day")).agg(F.count("*").alias("n"))


def dedupe_richest_by_url(spark, sf_dir):
    return records.dedupe(articles(spark, sf_dir)).select("url", "seq", "url_seq", records.richness().alias("rich"))


def collapse_author_twins(spark, sf_dir):
    return records.collapse_twins(events(spark, sf_dir), language="en").select("site", "author", "seq", _us().alias("us"))


def collapse_session_windows(spark, sf_dir):
    return records.session_clusters(events(spark, sf_dir)).select("site", "author", "n", _us("first_at").alias("first_us"), _us("last_at").alias("last_us"))


def preferred_language_copy(spark, sf_dir):
    return records.collapse_twins(articles(spark, sf_dir), language="ko", gap_minutes=3 * 1440).select("seq", "site", "author")


def upsert_by_url(spark, sf_dir):
    every = articles(spark, sf_dir)
    last = every.agg(F.max("batch_id")).first()[0]
    return records.upsert(every.filter(F.col("batch_id") < last), every.filter(F.col("batch_id") == last)).select("url", "seq")


def known_url_anti_join(spark, sf_dir):
    items = load(spark, sf_dir, "feed_items").select(F.col("item_id"), urls.canonical_url(F.col("link")).alias("url"))
    known = load(spark, sf_dir, "articles").select(urls.canonical_url(F.col("url")).alias("url"))
    return records.known_anti_join(items, known).select("item_id")


def missing_days(spark, sf_dir):
    have = articles(spark, sf_dir).select(window_day(F.col("published_at")).alias("day"))
    return storage.missing_days(have, dt.date(2023, 1, 1), TODAY)


def site_pulse(spark, sf_dir):
    a = articles(spark, sf_dir)
    return records.pulse(a, RANGE.contains(F.col("published_at"))).select("site", _us("newest_seen").alias("newest_us"), "n_all", "n_window")


def _runs(spark, sf_dir) -> DataFrame:
    """Every site in every batch, with the newest local date that the batch brought for it."""
    a = load(spark, sf_dir, "articles").filter(F.col("published_at").isNotNull())
    seen = a.groupBy("site", F.col("batch_id").alias("run_id")).agg(F.max(F.to_date("published_at")).alias("newest_seen_local_date"))
    runs = a.select(F.col("batch_id").alias("run_id")).distinct().agg(F.array_sort(F.collect_list("run_id")).alias("runs"))  # one number per run of the collector
    every = a.select("site").distinct().join(F.broadcast(runs)).select("site", F.explode("runs").alias("run_id"))
    return every.join(seen, ["site", "run_id"], "left")


_RUNS = """
WITH seen AS (SELECT site, batch_id AS run_id, max(CAST(published_at AS DATE)) AS d FROM articles WHERE published_at IS NOT NULL GROUP BY 1, 2),
 runs AS (SELECT s.site, b.run_id, seen.d FROM (SELECT DISTINCT site FROM articles WHERE published_at IS NOT NULL) s
   CROSS JOIN (SELECT DISTINCT batch_id AS run_id FROM articles WHERE published_at IS NOT NULL) b LEFT JOIN seen ON seen.site = s.site AND seen.run_id = b.run_id),
 marked AS (SELECT *, count(d) OVER w AS island, max(d) OVER w AS last_post FROM runs WINDOW w AS (PARTITION BY site ORDER BY run_id ROWS UNBOUNDED PRECEDING)),
 folded AS (SELECT site, run_id, last_post, CAST(sum(CASE WHEN d IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY site, island ORDER BY run_id ROWS UNBOUNDED PRECEDING) AS INTEGER) AS empty_runs FROM marked),
 state AS (SELECT site, max(last_post) AS last_post, arg_max(empty_runs, run_id) AS empty_runs FROM folded GROUP BY site)"""


def state_fold_history(spark, sf_dir):
    return site_state.fold_history(_runs(spark, sf_dir))


def state_latest(spark, sf_dir):
    return site_state.latest_state(_runs(spark, sf_dir))


def _described(spark, sf_dir) -> DataFrame:
    sites = storage.normalise_sites(load(spark, sf_dir, "sites"))
    return site_state.describe(sites, site_state.latest_state(_runs(spark, sf_dir)), TODAY)


_DESCRIBED = _RUNS + f""",
 reg AS (SELECT trim(name) AS name, NOT (coalesce(enabled, '') IN ('0', 'false') OR (coalesce(enabled, '') <> '' AND trim(enabled, ' ') = '')) AS enabled,
   coalesce(nullif(trim(fetcher), ''), 'feed') AS fetcher FROM sites WHERE trim(name) <> ''),
 described AS (SELECT reg.name, fetcher, last_post, empty_runs, CASE WHEN NOT enabled THEN 'disabled' WHEN coalesce(empty_runs, 0) >= 5 THEN 'failing' WHEN last_post IS NULL THEN 'unknown'
   WHEN last_post > DATE '{TODAY - dt.timedelta(days=180)}' THEN 'active' ELSE 'dormant' END AS status FROM reg LEFT JOIN state ON state.site = reg.name)"""


def site_status(spark, sf_dir):
    return _described(spark, sf_dir).select("name", "fetcher", "last_post", "empty_runs", "status")


def status_counts(spark, sf_dir):
    return site_state.status_counts(_described(spark, sf_dir))


def recheck_rota(spark, sf_dir):
    sites = storage.normalise_sites(load(spark, sf_dir, "sites"))
    return sites.select("name", *[(site_state.rota_slot(F.col("name"), TODAY + dt.timedelta(days=d), 7) == 0).alias(f"due_{d}") for d in range(7)])


def registry_rows(spark, sf_dir):
    return storage.normalise_sites(load(spark, sf_dir, "sites")).drop("params_ok")


def scan_report_by_site(spark, sf_dir):
    return records.scan_report(articles(spark, sf_dir))


def scan_report_totals(spark, sf_dir):
    return records.scan_totals(articles(spark, sf_dir))


def best_of_site(spark, sf_dir):
    return records.select_top(articles(spark, sf_dir), k=20, threshold=0, per=["site"]).select("seq", "site")


def rest_links(spark, sf_dir):
    kept = records.dedupe(articles(spark, sf_dir)).withColumn("day", window_day(F.col("published_at")))
    return records.rest_links(kept, records.select_top(kept, 5, 5, ["day"])).select("url", "seq")


def _scores(e: DataFrame) -> DataFrame:
    """Answers of a scorer: one per event, a second one for every fifth, misplaced ones for every eleventh."""
    base = e.select(F.floor(F.col("seq") / 25).cast("long").alias("batch_id"), (F.col("seq") % 25).cast("int").alias("idx"), "seq")
    answer = base.select("batch_id", "idx", F.lit(0).alias("ord"), (F.col("seq") % 11).cast("int").alias("score"), F.array(F.lit("data"), F.lit("made up")).alias("interests"), F.lit(" fits ").alias("reason"))
    again = base.filter(F.col("seq") % 5 == 0).select("batch_id", "idx", F.lit(1).alias("ord"), F.lit(10).alias("score"), F.array(F.lit("infra")).alias("interests"), F.lit(" ").alias("reason"))
    lost = base.filter(F.col("seq") % 11 == 0).select("batch_id", F.lit(99).alias("idx"), F.lit(2).alias("ord"), F.lit(1).alias("score"), F.array(F.lit("data")).alias("interests"), F.lit("x").alias("reason"))
    return answer.unionByName(again).unionByName(lost)


def apply_scores(spark, sf_dir):
    e = events(spark, sf_dir)
    return records.apply_scores(e, _scores(e), ["data", "infra"]).select("seq", "score", "reason", F.array_join("interests", ",").alias("interests"))


def batch_enumeration(spark, sf_dir):
    return events(spark, sf_dir).select(F.floor(F.col("seq") / 25).cast("long").alias("batch_id")).groupBy("batch_id").agg(F.count("*").alias("n"))


def valid_interest_filter(spark, sf_dir):
    a = load(spark, sf_dir, "articles")
    valid = F.array(*[F.lit(v) for v in ("data", "infra", "ml", "security", "frontend", "backend")])
    return a.select("seq", F.array_join(F.filter(F.coalesce("interests", F.array().cast("array<string>")), lambda x: F.array_contains(valid, x)), ",").alias("kept"))


def canonical_urls(spark, sf_dir):
    return load(spark, sf_dir, "feed_items").select("item_id", urls.canonical_url(F.col("link")).alias("url"))


def locale_path_variants(spark, sf_dir):
    p = urls.path(F.col("link"))
    linked = load(spark, sf_dir, "feed_items").filter(F.col("link").isNotNull())
    return linked.select("item_id", F.array_join(urls.locale_variants(p), " ").alias("variants"))


def path_shapes_top8(spark, sf_dir):
    links = load(spark, sf_dir, "articles").select(F.col("seq"), "url")
    return records.shape_frequency(links, urls.path_shape(urls.path(F.col("url"))))


def nav_segment_filter(spark, sf_dir):
    return load(spark, sf_dir, "feed_items").filter(~urls.is_navigation(urls.path(F.col("link")))).groupBy("site").agg(F.count("*").alias("n"))


def site_pattern_matches(spark, sf_dir):
    registry = storage.normalise_sites(load(spark, sf_dir, "sites")).filter("params_ok")
    sites = registry.select(F.col("name").alias("site"), F.get_json_object("params", "$.pattern").alias("pattern")).filter(F.col("pattern").isNotNull())
    joined = load(spark, sf_dir, "articles").select("seq", "site", "url").join(small_side(sites), "site")
    return joined.filter(urls.matches_article(urls.path(F.col("url")), F.col("pattern"))).select("seq", "site")


def _xml(c: Column) -> Column:
    """Escaped for XML; control characters, which XML cannot hold, are left in for the parser to drop."""
    text = F.coalesce(c, F.lit(""))
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(sign), F.lit(name))
    return text


def _element(tag: str, c: Column) -> Column:
    return F.concat(F.lit(f"<{tag}>"), _xml(c), F.lit(f"</{tag}>"))


def _items(spark, sf_dir) -> DataFrame:
    return load(spark, sf_dir, "feed_items")


def _read_items(docs: DataFrame) -> DataFrame:
    read = collect.parsed_feeds(docs.select("item_id", F.encode("doc", "UTF-8").alias("content")))
    return read.select("item_id", F.explode("feed.items").alias("i")).select("item_id", "i.*")


def feed_items_rss(spark, sf_dir):
    doc = F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?><rss version="2.0"><channel><item>'), _element("title", F.col("title")), _element("link", F.col("link")),
                   _element("description", F.col("summary")), _element("author", F.col("author")), _element("pubDate", F.col("published_raw")), F.lit("</item></channel></rss>"))
    return _read_items(_items(spark, sf_dir).withColumn("doc", doc))


def feed_items_atom(spark, sf_dir):
    link = F.concat(F.lit('<link rel="self" href="x"/><link href="'), F.replace(_xml(F.col("link")), F.lit('"'), F.lit("&quot;")), F.lit('"/>'))
    doc = F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom"><entry>'), _element("title", F.col("title")), link, _element("summary", F.col("summary")),
                   F.lit("<author>"), _element("name", F.col("author")), F.lit("</author>"), _element("published", F.col("published_raw")), F.lit("</entry></feed>"))
    return _read_items(_items(spark, sf_dir).withColumn("doc", doc))


def feed_items_json(spark, sf_dir):
    entry = F.struct("title", F.col("link").alias("url"), F.col("summary").alias("content_text"), F.struct(F.col("author").alias("name")).alias("author"), F.col("published_raw").alias("date_published"))
    doc = F.to_json(F.struct(F.array(entry).alias("items")))
    return collect.json_feed_items(_items(spark, sf_dir).select("item_id", doc.alias("doc")), "doc").drop("doc")


_TRIM = "regexp_replace(regexp_replace(coalesce({0}, ''), '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]', '', 'g'), '^[\\s\\x1c-\\x1f\\x{{85}}\\p{{Z}}]+|[\\s\\x1c-\\x1f\\x{{85}}\\p{{Z}}]+$', '', 'g')"


#: Text without blanks at its ends, as Python strips it.
_STRIP = "regexp_replace({0}, '^[\\s\\x1c-\\x1f\\x{{85}}\\p{{Z}}]+|[\\s\\x1c-\\x1f\\x{{85}}\\p{{Z}}]+$', '', 'g')"


def page_meta_tags(spark, sf_dir):
    m = load(spark, sf_dir, "page_meta")
    attr = lambda c: F.replace(_xml(c), F.lit('"'), F.lit("&quot;"))
    tag = lambda name, c: F.when(c.isNotNull(), F.concat(F.lit(f'<meta property="{name}" content="'), attr(c), F.lit('">'))).otherwise("")
    page = F.concat(F.lit("<html><head>"), tag("og:title", F.col("title")), tag("article:published_time", F.col("published_raw")), tag("author", F.col("author")),
                    tag("og:description", F.col("subtitle")), tag("og:type", F.col("og_type")), F.lit("</head><body><h1>none</h1></body></html>"))
    return collect.parsed_pages(m.select("page_id", page.alias("text"))).select("page_id", "meta.title", "meta.published_raw", "meta.author", "meta.subtitle", "meta.og_type")


def embedded_records(spark, sf_dir):
    """A page for each article, with two records and their parts under other names."""
    a = load(spark, sf_dir, "articles").select("seq", "title", "url", "author", F.date_format("published_at", "yyyy-MM-dd").alias("day")).filter(F.col("day").isNotNull() & (F.trim("title") != "") & (F.trim("url") != ""))
    first = F.struct(F.struct("title", "url", F.struct(F.col("author").alias("name")).alias("author"), F.col("day").alias("date"), F.lit(None).cast("string").alias("slug")).alias("node"))
    second = F.struct(F.struct(F.concat(F.lit("again "), "title").alias("title"), F.lit(None).cast("string").alias("url"), F.struct(F.lit(None).cast("string").alias("name")).alias("author"), F.col("day").alias("date"), F.concat(F.lit("p"), "seq").alias("slug")).alias("node"))
    page = F.concat(F.lit('<script id="__NEXT_DATA__" type="application/json">'), F.to_json(F.struct(F.struct(F.array(first, second).alias("edges")).alias("props"))), F.lit("</script>"))
    read = collect.parsed_embedded(a.select("seq", page.alias("text"), F.lit("https://x.example/b/").alias("base"), F.lit('{"source": "next_data"}').alias("params")), "text", "base", "params")
    return read.select("seq", F.col("embedded.error").alias("error"), F.explode("embedded.records").alias("r")).select("seq", "error", F.col("r.date_raw").alias("day"), "r.title", "r.author", F.when(F.startswith("r.title", F.lit("again ")), F.col("r.url")).alias("slug_url"))


def sitemap_entries(spark, sf_dir):
    a = load(spark, sf_dir, "articles").filter(F.col("published_at").isNotNull() & (F.trim("url") != ""))
    day = F.date_format("published_at", "yyyy-MM-dd")
    doc = F.concat(F.lit('<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url>'), _element("loc", F.col("url")), _element("lastmod", day), F.lit("</url></urlset>"))
    read = collect.parsed_sitemaps(a.select("seq", F.encode(doc, "UTF-8").alias("content")))
    return read.select("seq", F.explode("sitemap.entries").alias("e")).select("seq", F.col("e.lastmod").alias("lastmod"))


def list_cards(spark, sf_dir):
    a = load(spark, sf_dir, "articles").filter(F.col("published_at").isNotNull() & F.col("url").isNotNull())
    day = F.date_format("published_at", "yyyy-MM-dd")
    page = F.concat(F.lit('<div><p>'), day, F.lit('</p><h2><a href="/blog/post-'), F.col("seq").cast("string"), F.lit('?utm_source=x">'), F.lit("post"), F.lit('</a></h2></div><a href="/tag/x">tag</a>'))
    docs = a.select("seq", page.alias("text"), F.lit("https://x.example/blog").alias("base"), F.lit("^/blog/[^/]+/?$").alias("pattern"), F.lit(None).cast("string").alias("tz"), F.lit(0).cast("long").alias("now_us"))
    return collect.parsed_lists(docs, "text", "base", "pattern", "tz", "now_us").select("seq", F.explode("list.entries").alias("e")).select("seq", "e.url", "e.published_us")


def body_text(spark, sf_dir):
    a = load(spark, sf_dir, "articles")
    return a.select("seq", F.length(collect.text_of(F.col("body"))).alias("n_text"), F.length(collect.main_text_of(F.concat(F.lit("<article>"), F.col("body"), F.lit("</article>")))).alias("n_main"))


def error_rollup(spark, sf_dir):
    """Authors as sites and the sites they write for as their sources; a source without any summary failed."""
    f = load(spark, sf_dir, "feed_items").filter(F.col("site").isNotNull() & F.col("author").isNotNull())
    good = F.col("summary").isNotNull()
    outcome = f.groupBy(F.col("author").alias("site"), F.col("site").alias("source")).agg(
        F.min("item_id").alias("ord"), F.max(F.when(good, ntz_micros(F.col("fetched_at")))).alias("newest_seen"), F.count_if(good).alias("n_articles"),
        F.when(F.count_if(good) == 0, F.concat(F.lit("ValueError: nothing in "), F.count("*").cast("string"))).alias("error"))
    rolled = records.error_rollup(outcome)
    return rolled.select("site", "newest_seen", "n_articles", "error", records.failure_reason(F.col("error")).alias("reason"))


def article_records(spark, sf_dir):
    line = records.to_record()
    own = lambda key: F.get_json_object("line", f"$.{key}").alias(key)
    return articles(spark, sf_dir).select("seq", line.alias("line")).select("seq", F.array_join(F.json_object_keys("line"), ",").alias("keys"), *[own(k) for k in ("published_at", "site", "title", "author", "subtitle", "reason", "score")])


_RECORDS = """SELECT seq, concat_ws(',', 'published_at', CASE WHEN site IS NOT NULL THEN 'site' END, CASE WHEN title IS NOT NULL THEN 'title' END, CASE WHEN url IS NOT NULL THEN 'url' END, CASE WHEN author <> '' THEN 'author' END,
  CASE WHEN subtitle <> '' THEN 'subtitle' END, CASE WHEN reason <> '' THEN 'reason' END, CASE WHEN score IS NOT NULL THEN 'score' END, CASE WHEN len(interests) > 0 THEN 'interests' END, CASE WHEN len(summary) > 0 THEN 'summary' END) AS keys,
  strftime(published_at, '%Y-%m-%dT%H:%M:%S') || printf('%s%02d:%02d', CASE WHEN coalesce(published_offset_s, 0) < 0 THEN '-' ELSE '+' END, abs(coalesce(published_offset_s, 0)) // 3600, abs(coalesce(published_offset_s, 0)) % 3600 // 60) AS published_at,
  site, title, nullif(author, '') AS author, nullif(subtitle, '') AS subtitle, nullif(reason, '') AS reason, CAST(score AS VARCHAR) AS score FROM articles WHERE published_at IS NOT NULL"""


def nation_revenue(spark, sf_dir):
    o, c, n = (load(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    joined = load(spark, sf_dir, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(small_side(n), F.col("c_nationkey") == F.col("n_nationkey"))
    cents = F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")) * 100).cast("long")
    return joined.groupBy("n_name").agg(F.sum(cents).alias("cents"), F.count("*").alias("n_lines"))


def customers_without_orders(spark, sf_dir):
    c, o = load(spark, sf_dir, "customer"), load(spark, sf_dir, "orders").filter(F.col("o_orderstatus") == "P")
    return c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_mktsegment")


def site_set_operations(spark, sf_dir):
    f, a = (load(spark, sf_dir, t).select("site").filter(F.col("site").isNotNull()).distinct() for t in ("feed_items", "articles"))
    label = lambda df, name: df.withColumn("part", F.lit(name))
    return label(f.intersect(a), "both").unionByName(label(f.subtract(a), "feeds only")).unionByName(label(a.subtract(f), "articles only"))


def embedding_shape(spark, sf_dir):
    return load(spark, sf_dir, "embeddings").groupBy("label").agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("width"))


QUERIES: list[Callable[[SparkSession, str], DataFrame]] = [
    p3_found, digest_top_k_per_window, digest_sections, window_half_open_filter, daily_window_counts, dedupe_richest_by_url, collapse_author_twins, collapse_session_windows,
    preferred_language_copy, upsert_by_url, known_url_anti_join, missing_days, site_pulse, state_fold_history, state_latest, site_status, status_counts, recheck_rota, registry_rows,
    scan_report_by_site, scan_report_totals, best_of_site, rest_links, apply_scores, batch_enumeration, valid_interest_filter, canonical_urls, locale_path_variants, path_shapes_top8,
    nav_segment_filter, site_pattern_matches, feed_items_rss, feed_items_atom, feed_items_json, page_meta_tags, embedded_records, sitemap_entries, list_cards, body_text, error_rollup,
    article_records, nation_revenue, customers_without_orders, site_set_operations, embedding_shape,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in [*QUERIES, *cases.QUERIES]}


# ---------------------------------------------------------------- the same in SQL

_ORDER = "coalesce(score, 0) DESC, us DESC, seq"
_TOP = _ARTICLES + f", b AS ({_BEST}), d AS (SELECT *, {_DAY} AS day FROM b WHERE rn = 1), r AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY {_ORDER}) AS place FROM d WHERE coalesce(score, 0) >= 5)"


def _clusters(source: str, minutes: int) -> str:
    return source + f""", g AS (SELECT *, us - lag(us) OVER w AS gap FROM a WHERE coalesce(author, '') <> '' WINDOW w AS (PARTITION BY site, author ORDER BY us, seq)),
 c AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > {minutes * 60_000_000} THEN 1 ELSE 0 END) OVER (PARTITION BY site, author ORDER BY us, seq ROWS UNBOUNDED PRECEDING) AS cluster FROM g)"""


_TRACKED = """list_filter(list_transform(string_split(q, '&'), lambda p: CASE WHEN p = '' OR url_decode(replace(split_part(p, '=', 1), '+', ' ')) IN ('source', 'ref', 'fbclid', 'gclid')
  OR starts_with(url_decode(replace(split_part(p, '=', 1), '+', ' ')), 'utm_') THEN NULL
  ELSE replace(replace(url_encode(url_decode(replace(split_part(p, '=', 1), '+', ' '))), '%20', '+'), '*', '%2A') || '=' || replace(replace(url_encode(url_decode(replace(substr(p, length(split_part(p, '=', 1)) + 2), '+', ' '))), '%20', '+'), '*', '%2A') END), lambda x: x IS NOT NULL)"""
_CANONICAL = """{name} AS (SELECT {key}, CASE WHEN contains(bare, '?') AND len(f) > 0 THEN base || '?' || array_to_string(f, '&') ELSE base END AS url
  FROM (SELECT *, """ + _TRACKED + """ AS f FROM (SELECT {key}, bare, CASE WHEN regexp_matches(split_part(bare, '?', 1), '^[A-Za-z][A-Za-z0-9+.-]*:') THEN lower(split_part(bare, ':', 1)) || substr(split_part(bare, '?', 1), length(split_part(bare, ':', 1)) + 1) ELSE split_part(bare, '?', 1) END AS base,
  CASE WHEN contains(bare, '?') THEN substr(bare, length(split_part(bare, '?', 1)) + 2) ELSE '' END AS q FROM (SELECT {key}, split_part({column}, '#', 1) AS bare FROM {table}))))"""
_PATH = "regexp_extract({0}, '^(?:[A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*)?([^?#]*)', 1)"
_LINK_PATH = _PATH.format("link")


def oracles() -> dict[str, str]:
    items = ", ".join(f"{_TRIM.format(c)} AS {c}" for c in ("title", "link", "summary", "author", "published_raw"))
    atom = ", ".join(f"{_TRIM.format(c)} AS {c}" for c in ("title", "summary", "author", "published_raw"))
    plain = lambda c: f"coalesce(nullif(trim({c}, ' '), ''), '')"
    meta = lambda c: f"nullif(regexp_replace({c}, '^[\\s\\x1c-\\x1f\\x{{85}}\\p{{Z}}]+|[\\s\\x1c-\\x1f\\x{{85}}\\p{{Z}}]+$', '', 'g'), '')"
    return cases.oracles() | {
        "digest_top_k_per_window": _TOP + " SELECT day, url, seq, score, us FROM r WHERE place <= 5",
        "digest_sections": _EVENTS + f", b AS ({_BEST}), d AS (SELECT *, {_DAY} AS day FROM b WHERE rn = 1), r AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY {_ORDER}) AS place FROM d) SELECT day, url, CASE WHEN coalesce(score, 0) >= 5 AND place <= 5 THEN place END AS position, CASE WHEN coalesce(score, 0) >= 5 AND place <= 5 THEN 'card' ELSE 'link' END AS section FROM r",
        "window_half_open_filter": _ARTICLES + f" SELECT site, count(*) AS n FROM a WHERE {_RANGE} GROUP BY site",
        "daily_window_counts": _ARTICLES + f" SELECT {_DAY} AS day, count(*) AS n FROM a GROUP BY 1",
        "dedupe_richest_by_url": _ARTICLES + f" SELECT url, seq, url_seq, rich FROM ({_BEST}) WHERE rn = 1",
        "collapse_author_twins": _clusters(_EVENTS, 15) + " SELECT site, author, seq, us FROM (SELECT *, row_number() OVER (PARTITION BY site, author, cluster ORDER BY regexp_matches(title, '[가-힣]'), us, seq) AS rn FROM c) WHERE rn = 1 UNION ALL SELECT site, author, seq, us FROM a WHERE coalesce(author, '') = ''",
        "collapse_session_windows": _clusters(_EVENTS, 15) + " SELECT site, author, count(*) AS n, min(us) AS first_us, max(us) AS last_us FROM c GROUP BY site, author, cluster",
        "preferred_language_copy": _clusters(_ARTICLES, 3 * 1440) + " SELECT seq, site, author FROM (SELECT *, row_number() OVER (PARTITION BY site, author, cluster ORDER BY NOT regexp_matches(title, '[가-힣]'), us, seq) AS rn FROM c) WHERE rn = 1 UNION ALL SELECT seq, site, author FROM a WHERE coalesce(author, '') = ''",
        "upsert_by_url": _ARTICLES + ", s AS (SELECT *, CASE WHEN batch_id = (SELECT max(batch_id) FROM a) THEN 1 ELSE 0 END AS side FROM a) SELECT url, seq FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY rich DESC, side, seq) AS rn FROM s) WHERE rn = 1",
        "known_url_anti_join": "WITH " + _CANONICAL.format(name="i", key="item_id", column="link", table="feed_items") + ", " + _CANONICAL.format(name="k", key="seq", column="url", table="articles") + " SELECT item_id FROM i WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.url = i.url)",
        "missing_days": _ARTICLES + f" SELECT CAST(d AS DATE) AS day FROM generate_series(TIMESTAMP '2023-01-01', TIMESTAMP '{TODAY}', INTERVAL 1 DAY) t(d) WHERE CAST(d AS DATE) NOT IN (SELECT {_DAY} FROM a)",
        "site_pulse": _ARTICLES + f" SELECT site, max(us) AS newest_us, count(*) AS n_all, count(*) FILTER (WHERE {_RANGE}) AS n_window FROM a GROUP BY site",
        "state_fold_history": _RUNS + " SELECT site, run_id, last_post, empty_runs FROM folded",
        "state_latest": _RUNS + " SELECT site, last_post, empty_runs FROM state",
        "site_status": _DESCRIBED + " SELECT * FROM described",
        "status_counts": _DESCRIBED + " SELECT status, count(*) AS n FROM described GROUP BY status",
        "scan_report_by_site": _ARTICLES + " SELECT site, count(*) AS n, min(seq) AS first_seq FROM a GROUP BY site",
        "scan_report_totals": _ARTICLES + ", d AS (SELECT site, CAST(make_timestamp(us + CAST(coalesce(published_offset_s, 0) AS BIGINT) * 1000000) AS DATE) AS day FROM a) SELECT count(*) AS n, min(day) AS oldest, max(day) AS newest, count(DISTINCT site) AS n_sites FROM d",
        "best_of_site": _ARTICLES + f" SELECT seq, site FROM (SELECT seq, site, row_number() OVER (PARTITION BY site ORDER BY {_ORDER}) AS place FROM a) WHERE place <= 20",
        "rest_links": _TOP + " SELECT url, seq FROM d WHERE url NOT IN (SELECT url FROM r WHERE place <= 5)",
        "apply_scores": _EVENTS + " SELECT seq, CASE WHEN seq % 5 = 0 THEN 10 ELSE seq % 11 END AS score, CASE WHEN seq % 5 = 0 THEN NULL ELSE 'fits' END AS reason, CASE WHEN seq % 5 = 0 THEN 'infra' ELSE 'data' END AS interests FROM a",
        "batch_enumeration": _EVENTS + " SELECT seq // 25 AS batch_id, count(*) AS n FROM a GROUP BY 1",
        "valid_interest_filter": "SELECT seq, array_to_string(list_filter(coalesce(interests, []), lambda x: x IN ('data', 'infra', 'ml', 'security', 'frontend', 'backend')), ',') AS kept FROM articles",
        "canonical_urls": "WITH " + _CANONICAL.format(name="i", key="item_id", column="link", table="feed_items") + " SELECT item_id, url FROM i",
        "locale_path_variants": f"""WITH p AS (SELECT item_id, {_LINK_PATH} AS p FROM feed_items WHERE link IS NOT NULL), s AS (SELECT *, list_filter(string_split(p, '/'), lambda x: x <> '') AS s FROM p),
 m AS (SELECT *, coalesce(regexp_matches(s[1], '^[a-z]{{2}}(?:[-_][A-Za-z]{{2,4}})?$'), false) AS l1, coalesce(regexp_matches(s[2], '^[a-z]{{2}}(?:[-_][A-Za-z]{{2,4}})?$'), false) AS l2 FROM s)
 SELECT item_id, CASE WHEN l1 AND l2 THEN p || ' /' || array_to_string(s[2:], '/') || ' /' || array_to_string(s[3:], '/') WHEN l1 THEN p || ' /' || array_to_string(s[2:], '/') ELSE p END AS variants FROM m""",
        "registry_rows": "SELECT trim(name) AS name, trim(url) AS url, coalesce(nullif(trim(fetcher), ''), 'feed') AS fetcher, coalesce(nullif(trim(source_url), ''), trim(url)) AS source_url, nullif(trim(tz), '') AS tz, nullif(trim(params), '') AS params, coalesce(note, '') AS note, NOT (coalesce(enabled, '') IN ('0', 'false') OR (coalesce(enabled, '') <> '' AND trim(enabled) = '')) AS enabled FROM sites WHERE trim(name) <> ''",
        "path_shapes_top8": f"WITH p AS (SELECT seq, list_filter(string_split({_PATH.format('url')}, '/'), lambda x: x <> '') AS s FROM articles), h AS (SELECT seq, '^/' || array_to_string(list_transform(s, lambda x: CASE WHEN regexp_matches(x, '\\.[A-Za-z]{{1,5}}$') THEN '[^/]+\\.' || regexp_extract(x, '\\.([A-Za-z]{{1,5}})$', 1) WHEN length(x) >= 6 AND regexp_matches(x, '[\\p{{L}}\\p{{N}}]') THEN '[^/]+' ELSE regexp_replace(x, '([^A-Za-z0-9_%!\"'',/:;<=>@`])', '\\\\\\1', 'g') END), '/') || '/?$' AS shape FROM p WHERE len(s) BETWEEN 1 AND 4), t AS (SELECT shape, count(*) AS n, min(seq) AS first_seq FROM h GROUP BY shape ORDER BY n DESC, first_seq LIMIT 8) SELECT * FROM t WHERE n >= 3",
        "site_pattern_matches": f"WITH r AS (SELECT trim(name) AS site, regexp_extract(params, '\"pattern\" *: *\"((?:[^\"\\\\]|\\\\.)*)\"', 1) AS pattern FROM sites WHERE json_valid(params)), p AS (SELECT seq, site, {_PATH.format('url')} AS p FROM articles), s AS (SELECT *, list_filter(string_split(p, '/'), lambda x: x <> '') AS s FROM p), m AS (SELECT *, coalesce(regexp_matches(s[1], '^[a-z]{{2}}(?:[-_][A-Za-z]{{2,4}})?$'), false) AS l1, coalesce(regexp_matches(s[2], '^[a-z]{{2}}(?:[-_][A-Za-z]{{2,4}})?$'), false) AS l2 FROM s) SELECT seq, site FROM m JOIN r USING (site) WHERE pattern <> '' AND (regexp_matches(p, pattern) OR (l1 AND regexp_matches('/' || array_to_string(s[2:], '/'), pattern)) OR (l1 AND l2 AND regexp_matches('/' || array_to_string(s[3:], '/'), pattern)))",
        "nav_segment_filter": f"WITH p AS (SELECT site, list_filter(string_split({_LINK_PATH}, '/'), lambda x: x <> '') AS s FROM feed_items WHERE link IS NOT NULL) SELECT site, count(*) AS n FROM p WHERE NOT list_has_any(list_transform(s, lambda x: lower(x)), [" + ", ".join(f"'{w}'" for w in urls.NAV_SEGMENTS) + "]) GROUP BY site",
        "feed_items_rss": f"SELECT item_id, {items} FROM feed_items",
        "feed_items_atom": f"SELECT item_id, {atom}, CASE WHEN coalesce(link, '') = '' THEN 'x' ELSE {_TRIM.format('link')} END AS link FROM feed_items",
        "feed_items_json": "SELECT item_id, " + ", ".join(f"{plain(c)} AS {c}" for c in ("title", "link", "summary", "author", "published_raw")) + " FROM feed_items",
        "page_meta_tags": "SELECT page_id, " + ", ".join(f"{meta(c)} AS {c}" for c in ("author", "subtitle", "published_raw")) + f", coalesce({meta('title')}, 'none') AS title, regexp_replace(og_type, '^\\s+|\\s+$', '', 'g') AS og_type FROM page_meta",
        "embedded_records": f"WITH a AS (SELECT seq, {_STRIP.format('title')} AS title, nullif({_STRIP.format("coalesce(author, '')")}, '') AS author, title AS raw, strftime(published_at, '%Y-%m-%d') AS day FROM articles WHERE published_at IS NOT NULL AND trim(title, ' ') <> '' AND trim(url, ' ') <> '') SELECT seq, CAST(NULL AS VARCHAR) AS error, day, title, author, CAST(NULL AS VARCHAR) AS slug_url FROM a UNION ALL SELECT seq, NULL, day, {_STRIP.format("'again ' || raw")}, NULL, 'https://x.example/b/p' || seq FROM a",
        "sitemap_entries": "SELECT seq, strftime(published_at, '%Y-%m-%d') AS lastmod FROM articles WHERE published_at IS NOT NULL AND trim(url, ' ') <> ''",
        "list_cards": "SELECT seq, 'https://x.example/blog/post-' || seq AS url, epoch_us(date_trunc('day', published_at)) AS published_us FROM articles WHERE published_at IS NOT NULL AND url IS NOT NULL",
        "error_rollup": "WITH o AS (SELECT author AS site, site AS source, min(item_id) AS ord, max(epoch_us(fetched_at)) FILTER (WHERE summary IS NOT NULL) AS newest_seen, count(summary) AS n_articles, CASE WHEN count(summary) = 0 THEN 'ValueError: nothing in ' || count(*) END AS error FROM feed_items WHERE site IS NOT NULL AND author IS NOT NULL GROUP BY 1, 2), "
                        "e AS (SELECT site, error, min(ord) AS ord FROM o WHERE error IS NOT NULL GROUP BY 1, 2), j AS (SELECT site, string_agg(error, '; ' ORDER BY ord) AS error FROM e GROUP BY site), r AS (SELECT site, max(newest_seen) AS newest_seen, CAST(sum(n_articles) AS BIGINT) AS n_articles FROM o GROUP BY site) "
                        "SELECT r.*, CASE WHEN n_articles = 0 AND newest_seen IS NULL THEN error END AS error, CASE WHEN n_articles = 0 AND newest_seen IS NULL THEN 'no articles matched' END AS reason FROM r LEFT JOIN j USING (site)",
        "recheck_rota": "WITH s AS (SELECT trim(name) AS name FROM sites WHERE trim(name) <> ''), h AS (SELECT name, hex(encode(name)) AS h FROM s), "
                        "b AS (SELECT name, list_transform(range(0, length(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT)) AS bytes FROM h), "
                        "c AS (SELECT name, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), bytes), lambda c, x: list_reduce([xor(c, x), 1, 1, 1, 1, 1, 1, 1, 1], lambda r, k: CASE WHEN r & 1 = 1 THEN xor(r >> 1, CAST(3988292384 AS BIGINT)) ELSE r >> 1 END)), CAST(4294967295 AS BIGINT)) AS crc FROM b) "
                        f"SELECT name, {', '.join(f'({(TODAY + dt.timedelta(days=d)).toordinal()} + crc) % 7 = 0 AS due_{d}' for d in range(7))} FROM c",
        "article_records": _RECORDS,
        "nation_revenue": "SELECT n_name, CAST(sum(CAST(round(l_extendedprice * (1 - l_discount) * 100) AS BIGINT)) AS BIGINT) AS cents, count(*) AS n_lines FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name",
        "customers_without_orders": "SELECT c_custkey, c_mktsegment FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')",
        "site_set_operations": "SELECT site, CASE WHEN f AND a THEN 'both' WHEN f THEN 'feeds only' ELSE 'articles only' END AS part FROM (SELECT site, bool_or(t = 'f') AS f, bool_or(t = 'a') AS a FROM (SELECT site, 'f' AS t FROM feed_items UNION ALL SELECT site, 'a' FROM articles) WHERE site IS NOT NULL GROUP BY site)",
        "embedding_shape": "SELECT label, count(*) AS n, max(len(embedding)) AS width FROM embeddings GROUP BY label",
    }
