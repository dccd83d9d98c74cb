"""From the table of raw documents to articles, one tier of sources at a time.

RAW documents are the boundary to the network: parsers run next to the data, return errors as data, and a
lookup of detail pages is a join with the parsed pages.
"""

from __future__ import annotations

import json
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kiteloom.functions.dates import parse_date_column, zone
from kiteloom.functions.urls import canonical_url, is_navigation, matches_article, path, strip_suffix
from kiteloom.functions.windows import Window
from kiteloom.operators.records import collapse_twins, dedupe, error_rollup
from kiteloom.plans.runtime import spread
from kiteloom.sources import embedded, feeds, html, sitemaps

FEED_TEXT, FEED_SUBTITLE = 6000, 300
DETAIL_CAP_FEED, DETAIL_CAP_SITEMAP, LIST_CAP, OLD_RUN = 40, 60, 40, 6
LASTMOD_SLACK_DAYS = 3
META = "struct<title:string,published_raw:string,author:string,subtitle:string,og_type:string,has_article_schema:boolean,declares_article:boolean>"
ENTRIES = "struct<entries:array<struct<url:string,published_us:bigint,position:int>>,error:string>"
COLUMNS = ["site", "title", "url", "published_us", "offset_s", "author", "subtitle", "body"]


def _rows(function, *series: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([function(*values) for values in zip(*series)])


def decode_udf(content: pd.Series, content_type: pd.Series) -> pd.Series:
    """Text of raw documents by the charset of their content type; unknown ones are UTF-8, bad bytes replaced."""
    import codecs
    import re

    def one(data, kind):
        if data is None:
            return None
        found = re.search(r"charset=([\w\-]+)", kind or "", re.I)
        try:
            name = codecs.lookup(found[1]).name if found else "utf-8"
        except LookupError:
            name = "utf-8"
        return bytes(data).decode(name, "replace")

    return pd.Series([one(d, k) for d, k in zip(content, content_type)], dtype="object")


def decoded(content: Column, content_type: Column) -> Column:
    return F.pandas_udf(decode_udf, "string")(content, content_type)


def parsed_feeds(raw: DataFrame, content: str = "content") -> DataFrame:
    """Adds `feed`: items and error of each document (bytes)."""
    run = F.pandas_udf(lambda c: _rows(lambda x: feeds.read_feed(None if x is None else bytes(x) if not isinstance(x, str) else x), c), feeds.FEED_RESULT)
    return spread(raw).withColumn("feed", run(F.col(content)))


def json_feed_items(raw: DataFrame, text: str) -> DataFrame:
    """Items of JSON Feed texts by built-in functions alone."""
    entry = "struct<title:string,url:string,external_url:string,summary:string,content_text:string,content_html:string,author:struct<name:string>,authors:array<struct<name:string>>,date_published:string,date_modified:string>"
    item = F.explode(F.from_json(F.col(text), f"struct<items:array<{entry}>>")["items"])
    first = lambda *cols: F.coalesce(*[F.nullif(F.trim(F.col(f"i.{c}")), F.lit("")) for c in cols], F.lit(""))
    by = F.coalesce(F.nullif(F.trim("i.author.name"), F.lit("")), F.nullif(F.trim(F.try_element_at("i.authors", F.lit(1))["name"]), F.lit("")), F.lit(""))
    return raw.select("*", item.alias("i")).select(
        *raw.columns, first("title").alias("title"), first("url", "external_url").alias("link"), first("summary", "content_text", "content_html").alias("summary"),
        by.alias("author"), first("date_published", "date_modified").alias("published_raw"),
    )


def parsed_pages(raw: DataFrame, text: str = "text") -> DataFrame:
    """Adds `meta`: what each page says about itself."""
    return spread(raw).withColumn("meta", F.pandas_udf(lambda t: _rows(html.page_meta, t), META)(F.col(text)))


def parsed_embedded(raw: DataFrame, text: str, base: str, params: str) -> DataFrame:
    run = F.pandas_udf(lambda t, b, p: _rows(embedded.read_embedded, t, b, p), embedded.EMBEDDED_RESULT)
    return raw.withColumn("embedded", run(text, base, params))


def parsed_sitemaps(raw: DataFrame, content: str = "content") -> DataFrame:
    run = F.pandas_udf(lambda c: _rows(lambda x: sitemaps.read_sitemap(None if x is None else bytes(x) if not isinstance(x, str) else x), c), sitemaps.SITEMAP_RESULT)
    return raw.withColumn("sitemap", run(F.col(content)))


def parsed_lists(raw: DataFrame, text: str, base: str, pattern: str, tz: str, now_us: str) -> DataFrame:
    """Adds `list`: article links of each list page with their nearest date."""
    import datetime as dt

    def one(page, url, regex, name, now):
        try:
            moment = None if pd.isna(now) else dt.datetime.fromtimestamp(int(now) / 1e6, dt.timezone.utc)
            return {"entries": html.list_entries(page, url, regex, zone(name), moment), "error": None}
        except Exception as e:  # noqa: BLE001
            return {"entries": [], "error": f"{type(e).__name__}: {e}"}

    run = F.pandas_udf(lambda *s: _rows(one, *s), ENTRIES)
    return spread(raw).withColumn("list", run(text, base, pattern, tz, now_us))


def text_of(markup: Column, limit: int | None = None, unescape: bool = False) -> Column:
    return F.pandas_udf(lambda s: s.map(lambda v: None if v is None else html.html_to_text(v, unescape, limit)), "string")(markup)


def main_text_of(markup: Column) -> Column:
    return F.pandas_udf(lambda s: s.map(lambda v: None if v is None else html.main_text(html.parse(v))), "string")(markup)


def source_variants(sites: DataFrame) -> DataFrame:
    """One row per source of a site: its own, then each distinct extra source of its parameters.

    An extra source is a url or an object whose other keys override the site's parameters.
    """
    def expand(source_url, params):
        try:
            own = json.loads(params) if params else {}
        except ValueError:
            own = {}
        extras = own.pop("extra_sources", None) or [] if isinstance(own, dict) else []
        out = [(source_url, params)]
        for extra in extras if isinstance(extras, list) else []:
            spec = dict(extra) if isinstance(extra, dict) else {"source_url": extra}
            url = spec.pop("source_url", None) or spec.pop("url", None)
            if isinstance(url, str) and url.strip() and url not in [u for u, _ in out]:
                out.append((url, json.dumps({**own, **spec}, ensure_ascii=False, sort_keys=True)))
        return [{"source_url": u, "params": p} for u, p in out]

    run = F.pandas_udf(lambda u, p: pd.Series([expand(a, b) for a, b in zip(u, p)], dtype="object"), "array<struct<source_url:string,params:string>>")
    rest = [c for c in sites.columns if c not in ("source_url", "params")]
    return sites.select(*rest, F.posexplode(run("source_url", "params")).alias("variant", "v")).select(*rest, "variant", "v.source_url", "v.params")


def _dated(df: DataFrame, raw: str, tz: str, now_us: str) -> DataFrame:
    return df.withColumn("_d", parse_date_column(F.col(raw), F.col(tz), F.col(now_us))).withColumn("published_us", F.col("_d.us")).withColumn(
        "offset_s", F.col("_d.offset_s")).drop("_d")


def _finish(found: DataFrame, window: Window) -> tuple[DataFrame, DataFrame]:
    """(articles in the window, pulse by site) of dated rows; the pulse is taken before the window."""
    seen = found.groupBy("site").agg(F.max("published_us").alias("newest_us"))
    inside = found.filter(window.contains(F.timestamp_micros("published_us"))).select(*COLUMNS)
    return inside, seen


def collect_feeds(raw: DataFrame, pages: DataFrame, known: DataFrame, window: Window) -> tuple[DataFrame, DataFrame]:
    """(articles, outcomes by site) of feed documents: raw(site, tz, params, now_us, content), pages(url, meta), known(url).

    Items without title or link are dropped. With date_from = detail, undated items that are not known look up
    their page, at most DETAIL_CAP_FEED per site; the cap bounds lookups only, later dated items stay.
    """
    read = parsed_feeds(raw)
    item = read.select("site", "tz", "params", "now_us", F.col("feed.error").alias("error"), F.posexplode_outer("feed.items").alias("pos", "i"))
    items = item.filter(F.trim("i.title").cast("string") != "").filter(F.trim("i.link") != "").select(
        "site", "tz", "params", "now_us", "pos", F.col("i.title").alias("title"), canonical_url(F.col("i.link")).alias("url"), F.col("i.author").alias("own_author"),
        text_of(F.col("i.summary"), FEED_TEXT, True).alias("body"), F.col("i.published_raw").alias("raw"),
    )
    dated = _dated(items, "raw", "tz", "now_us")
    from_detail = F.coalesce(F.get_json_object("params", "$.date_from") == "detail", F.lit(False))
    undated = dated.filter(F.col("published_us").isNull() & from_detail).join(known.select("url").distinct(), "url", "left_anti")
    lookups = undated.withColumn("rank", F.row_number().over(W.partitionBy("site").orderBy("pos"))).filter(F.col("rank") <= DETAIL_CAP_FEED).drop("rank")
    detail = pages.dropDuplicates(["url"]).select("url", F.col("meta.published_raw").alias("page_raw"), F.col("meta.author").alias("page_author"), F.col("meta.subtitle").alias("page_subtitle"))
    looked = _dated(lookups.drop("published_us", "offset_s").join(detail, "url", "left"), "page_raw", "tz", "now_us")
    columns = ["site", "title", "url", "published_us", "offset_s", "author", "subtitle", "body"]
    subtitle = F.nullif(F.left("body", F.lit(FEED_SUBTITLE)), F.lit(""))
    plain = dated.filter(F.col("published_us").isNotNull()).withColumn("author", F.nullif("own_author", F.lit(""))).withColumn("subtitle", subtitle)
    extra = looked.filter(F.col("published_us").isNotNull()).withColumn("author", F.coalesce(F.nullif("own_author", F.lit("")), "page_author")).withColumn(
        "subtitle", F.coalesce(subtitle, "page_subtitle"))
    found = plain.select(*columns).unionByName(extra.select(*columns))
    articles, seen = _finish(found, window)
    totals = item.groupBy("site").agg(F.count("i").alias("n_items"), F.max("error").alias("parse_error"))
    undated_known = dated.filter(F.col("published_us").isNull()).join(known.select("url").distinct(), "url", "left_anti").groupBy("site").agg(F.count("*").alias("n_undated"))
    outcomes = totals.join(seen, "site", "left").join(undated_known, "site", "left").select(
        "site", "newest_us",
        F.coalesce(
            "parse_error",
            F.when(F.col("n_items") == 0, "ValueError: feed without items"),
            F.when(F.col("newest_us").isNull() & (F.col("n_undated") == F.col("n_items")), "ValueError: no item has a date"),
        ).alias("error"),
    )
    return articles, outcomes


def collect_embedded(raw: DataFrame, window: Window) -> tuple[DataFrame, DataFrame]:
    """(articles, outcomes) of pages with embedded records: raw(site, tz, params, now_us, text, source_url)."""
    read = parsed_embedded(raw, "text", "source_url", "params")
    rows = read.select("site", "tz", "now_us", F.explode("embedded.records").alias("r")).select(
        "site", "tz", "now_us", F.col("r.title").alias("title"), canonical_url(F.col("r.url")).alias("url"), F.col("r.date_raw").alias("raw"),
        F.col("r.author").alias("author"), F.col("r.subtitle").alias("subtitle"), F.lit(None).cast("string").alias("body"),
    )
    articles, seen = _finish(_dated(rows, "raw", "tz", "now_us").filter(F.col("published_us").isNotNull()), window)
    errors = read.groupBy("site").agg(F.max("embedded.error").alias("error"))
    return articles, errors.join(seen, "site", "left").select("site", "newest_us", "error")


def sitemap_candidates(entries: DataFrame) -> DataFrame:
    """Entries(site, pattern, loc, lastmod_us) on article paths."""
    return entries.filter(matches_article(path(F.col("loc")), F.col("pattern")) & ~is_navigation(path(F.col("loc"))))


def sitemap_detail(candidates: DataFrame, start_us: int, known: DataFrame | None = None) -> DataFrame:
    """Candidates worth a look at their page: not known, not older than the slack before the window, newest first, at most the cap.

    An old entry ends the list, and with it the undated ones, which come last. Known ones spend nothing of the
    cap, which is applied before the rows of a site meet.
    """
    limit = start_us - LASTMOD_SLACK_DAYS * 86_400_000_000
    old = candidates.groupBy("site").agg(F.max((F.col("lastmod_us") < limit).cast("int")).alias("_old"))
    fresh = (F.col("lastmod_us") >= limit) | (F.col("lastmod_us").isNull() & (F.coalesce("_old", F.lit(0)) == 0))
    order = W.partitionBy("site").orderBy(F.col("lastmod_us").desc_nulls_last(), "loc")
    unknown = candidates if known is None else candidates.join(known.select("url").distinct(), "url", "left_anti")
    kept = unknown.join(old, "site").filter(fresh).withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= DETAIL_CAP_SITEMAP)
    return kept.select(*candidates.columns)


def sitemap_documents(raw: DataFrame, children: DataFrame | None) -> DataFrame:
    """`raw` with parsed sitemaps, and the documents that its index files name, one level down, found in children(source_url, content)."""
    read = parsed_sitemaps(raw)
    if children is None:
        return read
    rest = [c for c in raw.columns if c != "content"]
    named = read.select(*rest, F.explode("sitemap.children").alias("_child")).dropDuplicates(["site", "_child"])
    found = named.join(children.select(F.col("source_url").alias("_child"), "content"), "_child").select(*rest, "content")
    return read.unionByName(parsed_sitemaps(found.select(*raw.columns)))


def collect_sitemaps(raw: DataFrame, pages: DataFrame, known: DataFrame, window: Window, children: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(articles, outcomes) of sitemap documents: raw(site, tz, params, now_us, content), pages(url, meta), known(url), children(source_url, content).

    With date_from = lastmod the entry's date is trusted, and the newest one is the site's pulse whatever its page or
    the window; else the page must declare an article and its own date goes before the entry's.
    """
    read = sitemap_documents(raw, children)
    entries = read.select("site", "tz", "params", "now_us", F.explode("sitemap.entries").alias("e")).select(
        "site", "tz", "params", "now_us", F.col("e.loc").alias("loc"), F.col("e.lastmod").alias("raw"), F.coalesce(F.get_json_object("params", "$.article_regex"), F.lit(".")).alias("pattern"))
    dated = _dated(entries, "raw", "tz", "now_us").withColumnRenamed("published_us", "lastmod_us").withColumnRenamed("offset_s", "lastmod_offset_s")
    candidates = sitemap_candidates(dated).withColumn("url", canonical_url(F.col("loc"))).dropDuplicates(["site", "url"])
    trusted = F.coalesce(F.get_json_object("params", "$.date_from") == "lastmod", F.lit(False))
    start_us, end_us = (int(t.timestamp() * 1_000_000) for t in (window.start, window.end))
    detail = sitemap_detail(candidates.filter(~trusted), start_us, known)
    inside = candidates.filter(trusted & (F.col("lastmod_us") >= start_us) & (F.col("lastmod_us") < end_us)).select(*detail.columns)
    joined = inside.unionByName(detail).join(pages.dropDuplicates(["url"]), "url", "left")
    read_own = joined.withColumn("_d", parse_date_column(F.col("meta.published_raw"), F.col("tz"), F.col("now_us")))
    own_date = ~trusted & F.col("_d.us").isNotNull()
    article = read_own.filter(trusted | F.coalesce(F.col("meta.declares_article"), F.lit(False))).select(
        "site", strip_suffix(F.col("meta.title"), F.get_json_object("params", "$.title_strip")).alias("title"), "url",
        F.when(own_date, F.col("_d.us")).otherwise(F.col("lastmod_us")).alias("published_us"),
        F.when(own_date, F.col("_d.offset_s")).otherwise(F.col("lastmod_offset_s")).alias("offset_s"), F.col("meta.author").alias("author"), F.col("meta.subtitle").alias("subtitle"), F.lit(None).cast("string").alias("body"),
    ).filter(F.col("title").isNotNull() & F.col("published_us").isNotNull())
    articles, seen = _finish(article, window)
    listed = candidates.groupBy("site").agg(F.count("*").alias("n"), F.max(F.when(trusted, F.col("lastmod_us"))).alias("listed_us"))
    found = read.groupBy("site").agg(F.max("sitemap.error").alias("parse_error")).join(listed, "site", "left")
    outcomes = found.join(seen, "site", "left").select(
        "site", F.greatest("newest_us", "listed_us").alias("newest_us"),
        F.when(F.col("n").isNull(), F.coalesce("parse_error", F.lit("ValueError: no entry matches"))).alias("error"))
    return articles, outcomes


def stop_at_old_runs(cards: DataFrame, limit: int = OLD_RUN) -> DataFrame:
    """Cards(site, ord, age) up to and with the card that completes a run of `limit` consecutive old ones.

    age is 'old', 'new' or null; null cards (known, failed, future) neither count nor reset, a new page resets
    like a new card. A running count of islands replaces the page loop.
    """
    by_site = W.partitionBy("site").orderBy("ord")
    upto = by_site.rowsBetween(W.unboundedPreceding, 0)
    island = F.sum((F.col("age") == "new").cast("int")).over(upto)
    marked = cards.withColumn("_island", F.coalesce(island, F.lit(0)))
    own = ["site", "page", "_island"] if "page" in cards.columns else ["site", "_island"]
    run = F.sum((F.col("age") == "old").cast("int")).over(W.partitionBy(*own).orderBy("ord").rowsBetween(W.unboundedPreceding, 0))
    full = marked.withColumn("_full", F.coalesce(run, F.lit(0)) >= limit)
    before = F.max(F.col("_full").cast("int")).over(by_site.rowsBetween(W.unboundedPreceding, -1))
    return full.withColumn("_before", before).filter(F.coalesce("_before", F.lit(0)) == 0).drop("_island", "_full", "_before")


def page_turns(cards: DataFrame) -> DataFrame:
    """Cards(site, page, position, url, _cap) that are looked at: on each page the first _cap links that no earlier page had looked at.

    What a page leaves over may come on a later one, so pages follow each other; a site's cards are at most those of
    its list pages.
    """
    def turns(group: pd.DataFrame) -> pd.DataFrame:
        seen: set[str] = set()
        kept = []
        for _, page in group.sort_values(["page", "position"]).groupby("page", sort=True):
            fresh = page[~page["url"].isin(seen)]
            kept.append(fresh.head(int(fresh["_cap"].iloc[0])) if len(fresh) else fresh)
            seen.update(kept[-1]["url"])
        return pd.concat(kept)

    return cards.groupBy("site").applyInPandas(turns, cards.schema).drop("_cap")


def collect_lists(raw: DataFrame, pages: DataFrame, known: DataFrame, window: Window) -> tuple[DataFrame, DataFrame]:
    """(articles, outcomes) of list pages: raw(site, tz, params, now_us, text, source_url, page), pages(url, meta), known(url).

    With date_from = list the card's date counts and vouches for the link, and a page with a card older than the window
    is the last one; else the page itself must declare an article and give the date, and a run of old pages ends
    a site's list. A page without links ends it too. Each page gives at most max_articles links that no
    earlier page had, in list mode those in the window; known ones are not looked up.
    """
    patterned = raw.withColumn("pattern", F.coalesce(F.get_json_object("params", "$.article_regex"), F.lit(".")))
    by_list = F.coalesce(F.get_json_object("params", "$.date_from") == "list", F.lit(False))
    start_us, end_us = (int(t.timestamp() * 1_000_000) for t in (window.start, window.end))
    whole = parsed_lists(patterned, "text", "source_url", "pattern", "tz", "now_us")
    old_card = F.exists("list.entries", lambda e: e["published_us"] < start_us)
    ended = F.when(F.size("list.entries") == 0, F.col("page") - 1).when(by_list & F.coalesce(old_card, F.lit(False)), F.col("page"))
    last = F.min(ended).over(W.partitionBy("site").orderBy("page").rowsBetween(W.unboundedPreceding, 0))
    read = whole.withColumn("_last", last).filter(F.col("_last").isNull() | (F.col("page") <= F.col("_last")) | (F.col("page") == 1)).drop("_last")
    cards = read.select("site", "tz", "params", "now_us", "page", F.explode("list.entries").alias("e")).select(
        "site", "tz", "params", "now_us", "page", F.col("e.url").alias("url"), F.col("e.published_us").alias("card_us"), F.col("e.position").alias("position"))
    inside = F.coalesce((F.col("card_us") >= start_us) & (F.col("card_us") < end_us), F.lit(False))
    limit = F.coalesce(F.get_json_object("params", "$.max_articles").try_cast("int"), F.lit(LIST_CAP))
    first = page_turns(cards.filter(~by_list | inside).withColumn("_cap", limit))
    unknown = first.join(known.select("url").distinct(), "url", "left_anti")
    joined = unknown.join(pages.dropDuplicates(["url"]), "url", "left").withColumn("_d", parse_date_column(F.col("meta.published_raw"), F.col("tz"), F.col("now_us")))
    published = F.when(by_list, F.col("card_us")).otherwise(F.col("_d.us"))
    dated = joined.withColumn("published_us", published).withColumn("ord", F.struct("page", "position")).withColumn(
        "age", F.when(by_list | F.col("published_us").isNull() | (F.col("published_us") >= end_us), None).when(F.col("published_us") < start_us, "old").otherwise("new"))
    kept = stop_at_old_runs(dated)
    article = kept.filter(by_list | F.coalesce(F.col("meta.declares_article"), F.lit(False))).select(
        "site", strip_suffix(F.col("meta.title"), F.get_json_object("params", "$.title_strip")).alias("title"), "url", "published_us",
        F.col("_d.offset_s").alias("offset_s"), F.col("meta.author").alias("author"), F.col("meta.subtitle").alias("subtitle"), F.lit(None).cast("string").alias("body"),
    ).filter(F.col("title").isNotNull() & F.col("published_us").isNotNull())
    articles, seen = _finish(article, window)
    shown = cards.filter(by_list).groupBy("site").agg(F.max("card_us").alias("listed_us"))
    totals = read.groupBy("site").agg(F.max("list.error").alias("parse_error"), F.sum(F.size("list.entries")).alias("n"))
    outcomes = totals.join(seen, "site", "left").join(shown, "site", "left").select(
        "site", F.greatest("newest_us", "listed_us").alias("newest_us"), F.coalesce("parse_error", F.when(F.col("n") == 0, "ValueError: no link matches")).alias("error"))
    return articles, outcomes


def collected(parts: list[tuple[DataFrame, DataFrame]], language: str = "ko") -> tuple[DataFrame, DataFrame]:
    """(articles, results by site) of all tiers: flattened, collapsed by url, twins collapsed; errors rolled up."""
    rows = reduce(DataFrame.unionByName, [a for a, _ in parts])
    records = rows.select(
        "site", "title", "url", F.timestamp_micros("published_us").alias("published_at"), "author", "subtitle", F.lit(None).cast("int").alias("score"),
        F.array().cast("array<string>").alias("interests"), F.lit(None).cast("string").alias("reason"), F.array().cast("array<string>").alias("summary"), "body",
        F.xxhash64("site", "url", "published_us").alias("seq"), F.col("offset_s").alias("published_offset_s"),
    )
    articles = collapse_twins(dedupe(records).drop("url_seq"), language)
    counts = rows.groupBy("site").agg(F.count("*").alias("n_articles"))
    outcomes = reduce(DataFrame.unionByName, [o.withColumn("ord", F.lit(i)) for i, (_, o) in enumerate(parts)]).join(counts, "site", "left")
    return articles, error_rollup(outcomes.withColumnRenamed("newest_us", "newest_seen"))
