"""Profiling a site: which source it offers, best tier first."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kiteloom.functions.dates import parse_date_column
from kiteloom.functions.urls import feed_candidates, path, path_shape
from kiteloom.operators.records import shape_frequency
from kiteloom.plans.runtime import cut_lineage
from kiteloom.sources import embedded, html
from kiteloom.sources.collect import parsed_feeds, parsed_pages

SHAPES_TRIED, PAGES_PER_SHAPE, SAMPLE_PAGES = 3, 2, 3


def candidate_feeds(sites: DataFrame, pages: DataFrame) -> DataFrame:
    """(name, priority, feed_url): declared feeds of the site's page, then host-specific and generic places."""
    declare = F.pandas_udf(lambda t, u: pd.Series([html.declared_feeds(a, b) for a, b in zip(t, u)], dtype="object"), "array<string>")
    declared = pages.select(F.col("url"), declare("text", "url").alias("declared"))
    all_urls = F.array_distinct(F.concat(F.coalesce("declared", F.array().cast("array<string>")), feed_candidates(F.col("url"))))
    return sites.select("name", "url").join(declared, "url", "left").select("name", F.posexplode(all_urls).alias("priority", "feed_url"))


def validated_feeds(candidates: DataFrame, raw: DataFrame, details: DataFrame | None = None) -> DataFrame:
    """(name, feed_url, n_items, n_dated, newest_us, any_author, any_summary): the best valid feed per site.

    raw(source_url, content, tz, now_us), details(url, dated). A feed is valid if it has items and one of them a date, or
    where the page of its first item has one; n_dated is -1 then.
    """
    read = parsed_feeds(candidates.join(raw, candidates["feed_url"] == raw["source_url"]))
    items = read.select("name", "priority", "feed_url", "tz", "now_us", F.posexplode("feed.items").alias("pos", "i")).withColumn(
        "us", parse_date_column(F.col("i.published_raw"), F.col("tz"), F.col("now_us"))["us"])
    stats = items.groupBy("name", "priority", "feed_url").agg(
        F.count("*").alias("n_items"), F.count("us").alias("n_dated"), F.max("us").alias("newest_us"),
        F.bool_or(F.col("i.author") != "").alias("any_author"), F.bool_or(F.col("i.summary") != "").alias("any_summary"),
        F.min_by("i.link", F.when(F.col("i.link") != "", F.col("pos"))).alias("first_link"))
    if details is not None:
        known = details.filter("dated").select(F.col("url").alias("first_link"), F.lit(True).alias("_dated")).distinct()
        stats = stats.join(known, "first_link", "left").withColumn("n_dated", F.when((F.col("n_dated") == 0) & F.col("_dated"), F.lit(-1)).otherwise(F.col("n_dated"))).drop("_dated")
    best = F.row_number().over(W.partitionBy("name").orderBy("priority"))
    return stats.filter(F.col("n_dated") != 0).withColumn("_r", best).filter(F.col("_r") == 1).drop("_r", "priority", "first_link")


def page_facts(pages: DataFrame, tz: str | None = None, now_us: int = 0) -> DataFrame:
    """(url, dated, is_article): what the pages(url, text) tell of themselves: a readable date, and whether they are articles."""
    read = parsed_pages(pages.select("url", "text"))
    dated = parse_date_column(F.col("meta.published_raw"), F.lit(tz).cast("string"), F.lit(now_us).cast("long"))["us"].isNotNull()
    return read.select("url", dated.alias("dated"), F.col("meta.declares_article").alias("_declares")).select(
        "url", "dated", (F.col("dated") | F.coalesce("_declares", F.lit(False))).alias("is_article"))


def embedded_signal(pages: DataFrame) -> DataFrame:
    """(url, source, n_records): the first kind of embedded payload that yields records."""
    def probe(text):
        for kind in ("next_data", "rsc", "js_literal"):
            payload = embedded.EXTRACTORS[kind](text or "", {})
            rows = embedded.largest_records(payload, embedded.Roles()) if payload is not None else []
            if rows:
                return {"source": kind, "n_records": len(rows)}
        return {"source": None, "n_records": 0}

    run = F.pandas_udf(lambda t: pd.DataFrame([probe(x) for x in t]), "struct<source:string,n_records:int>")
    return pages.select("url", run("text").alias("p")).select("url", "p.source", "p.n_records").filter(F.col("source").isNotNull())


def page_links(pages: DataFrame) -> DataFrame:
    """(url, link, seq): the links of each page that stay on its host, in order."""
    run = F.pandas_udf(lambda t, u: pd.Series([[a for a, _, _ in html.anchors(html.parse(x or ""), y)] for x, y in zip(t, u)], dtype="object"), "array<string>")
    return pages.select("url", F.posexplode(run("text", "url")).alias("seq", "link"))


def frequent_shapes(links: DataFrame) -> DataFrame:
    """(url, shape, n, first_seq): the frequent shapes of the links of each page."""
    return shape_frequency(links.withColumn("seq", F.col("seq").cast("long")), path_shape(path(F.col("link"))), ["url"])


def sampled_links(links: DataFrame, shapes: DataFrame) -> DataFrame:
    """(url, shape, link): the first PAGES_PER_SHAPE addresses of each of a page's SHAPES_TRIED most frequent shapes, but for the page itself."""
    place = F.row_number().over(W.partitionBy("url").orderBy(F.col("n").desc(), "first_seq"))
    tried = shapes.withColumn("_place", place).filter(F.col("_place") <= SHAPES_TRIED).select("url", "shape")
    own = lambda c: F.regexp_replace(path(F.col(c)), "/+$", "")
    hits = links.join(tried, "url").filter(F.rlike(path(F.col("link")), F.col("shape")) & (own("link") != own("url")))
    once = hits.groupBy("url", "shape", "link").agg(F.min("seq").alias("seq"))
    first = F.row_number().over(W.partitionBy("url", "shape").orderBy("seq"))
    return once.withColumn("_place", first).filter(F.col("_place") <= PAGES_PER_SHAPE).select("url", "shape", "link")


def best_shape(shapes: DataFrame, samples: DataFrame, facts: DataFrame) -> DataFrame:
    """(url, shape): for each page the shape whose sampled pages are articles most often; without samples the most frequent one."""
    known = facts.select(F.col("url").alias("link"), "is_article")
    hits = samples.join(known, "link", "left").groupBy("url", "shape").agg(F.count_if(F.coalesce("is_article", F.lit(False))).alias("hits"))
    scored = shapes.join(hits, ["url", "shape"], "left")
    by_hits = F.max_by("shape", F.when(F.col("hits").isNotNull(), F.struct("hits", "n", "shape")))
    return scored.groupBy("url").agg(F.coalesce(by_hits, F.max_by("shape", F.struct("n", -F.col("first_seq")))).alias("shape"), F.max("n").alias("n_links"))


def detail_vote(samples: DataFrame) -> DataFrame:
    """(name, from_detail): whether most of the first pages of a site's list have a date of their own; samples(name, dated)."""
    return samples.groupBy("name").agg((F.sum(F.col("dated").cast("int")) * 2 > F.least(F.count("*"), F.lit(SAMPLE_PAGES))).alias("from_detail"))


FINDING = ["name", "url", "tz", "fetcher", "source_url", "params", "entries", "dated", "newest_us", "has_author", "has_subtitle"]


def discover(sites: DataFrame, pages: DataFrame, raw: DataFrame, now_us: int = 0) -> DataFrame:
    """One finding per site of sites(name, url, tz): the first tier that offers a source, fetcher null where none does.

    pages(url, text) holds the sites' pages and what is known of their articles, raw(source_url, content) the documents
    at candidate places. Tiers in order: a valid feed, records embedded in the page, a list of links.
    """
    own = pages.join(sites.select("url").distinct(), "url", "left_semi")
    facts = cut_lineage(page_facts(pages, now_us=now_us))
    documents = raw.select("source_url", "content", F.lit(None).cast("string").alias("tz"), F.lit(now_us).cast("long").alias("now_us"))
    feeds = validated_feeds(candidate_feeds(sites, own), documents, facts).select(
        "name", F.lit("feed").alias("f1"), F.col("feed_url").alias("s1"), F.when(F.col("n_dated") == -1, '{"date_from":"detail"}').alias("p1"),
        F.col("n_items").cast("long").alias("e1"), F.col("n_dated").cast("long").alias("d1"), "newest_us", F.col("any_author").alias("has_author"), F.col("any_summary").alias("has_subtitle"))
    signals = embedded_signal(own).select("url", F.lit("embedded").alias("f2"), F.to_json(F.struct("source")).alias("p2"), F.col("n_records").cast("long").alias("e2"))
    links = cut_lineage(page_links(own))
    shapes = cut_lineage(frequent_shapes(links))
    chosen = best_shape(shapes, sampled_links(links, shapes), facts)
    first = F.row_number().over(W.partitionBy("url").orderBy("seq"))
    listed = links.join(chosen, "url").filter(F.rlike(path(F.col("link")), F.col("shape"))).groupBy("url", "link").agg(F.min("seq").alias("seq")).withColumn("_n", first).filter(F.col("_n") <= SAMPLE_PAGES)
    known = facts.select(F.col("url").alias("link"), "dated")
    votes = detail_vote(listed.join(known, "link", "left").select(F.col("url").alias("name"), F.coalesce("dated", F.lit(False)).alias("dated")))
    lists = chosen.join(votes.select(F.col("name").alias("url"), "from_detail"), "url", "left").select(
        "url", F.lit("html_list").alias("f3"), F.col("n_links").cast("long").alias("e3"), F.col("from_detail").cast("long").alias("d3"),
        F.to_json(F.struct(F.col("shape").alias("article_regex"), F.when(F.col("from_detail"), "detail").otherwise("list").alias("date_from"))).alias("p3"))
    joined = sites.select("name", "url", "tz").join(feeds, "name", "left").join(signals, "url", "left").join(lists, "url", "left")
    of_feed, of_page = F.col("f1").isNotNull(), F.col("f2").isNotNull()
    pick = lambda a, b, c: F.when(of_feed, F.col(a)).when(of_page, F.col(b) if b else None).otherwise(F.col(c) if c else None)
    return joined.select(
        "name", "url", "tz", F.coalesce("f1", "f2", "f3").alias("fetcher"), F.coalesce("s1", F.when(F.coalesce("f2", "f3").isNotNull(), F.col("url"))).alias("source_url"),
        pick("p1", "p2", "p3").alias("params"), pick("e1", "e2", "e3").alias("entries"), pick("d1", None, "d3").alias("dated"), "newest_us", "has_author", "has_subtitle").select(*FINDING)


def registry_rows(findings: DataFrame) -> DataFrame:
    """CSV lines of eight fields for the registry; findings(name, url, fetcher, source_url, tz, params, enabled, note)."""
    return findings.select(F.to_csv(F.struct("name", "url", "fetcher", "source_url", "tz", "params", "enabled", "note")).alias("line"))
