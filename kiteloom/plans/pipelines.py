"""Whole runs: the daily digest, its replay from the store, the range scan and the site listing."""

from __future__ import annotations

import datetime as dt
from zoneinfo import ZoneInfo

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kiteloom.functions.urls import page_url, sitemap_url
from kiteloom.functions.windows import Window, daily_window, scan_window
from kiteloom.operators.records import apply_scores, apply_summaries, collapse_twins, dedupe, select_top
from kiteloom.operators.site_state import describe, fold_run, listing, sites_to_collect
from kiteloom.plans import report
from kiteloom.plans.runtime import cut_lineage
from kiteloom.schema import Settings, with_seq
from kiteloom.sources import collect, storage


def tiers(targets: DataFrame, raw: DataFrame, pages: DataFrame, known: DataFrame, window: Window, now: dt.datetime, language: str = "ko", max_pages: int = 1) -> tuple[DataFrame, DataFrame]:
    """(articles, results) of the target sites from raw(source_url, content, content_type) and pages(url, meta).

    A sitemap is looked for at its usual place unless the parameters name another, and a list has up to
    `max_pages` pages where its parameters say how they are addressed.
    """
    variants = collect.source_variants(targets)
    pages_of = F.when(F.col("fetcher") == "html_list", F.sequence(F.lit(1), F.lit(max_pages))).otherwise(F.array(F.lit(1)))
    place = F.when(F.col("fetcher") == "sitemap", sitemap_url(F.col("source_url"), F.get_json_object("params", "$.sitemap_url"))).otherwise(
        page_url(F.get_json_object("params", "$.page_url"), F.col("source_url"), F.col("page")))
    variants = variants.withColumn("page", F.explode(pages_of)).withColumn("source_url", place).filter(F.col("source_url").isNotNull())
    docs = variants.join(raw, "source_url").select(
        F.col("name").alias("site"), "fetcher", "tz", "params", "source_url", "content",
        collect.decoded(F.col("content"), F.col("content_type")).alias("text"),
        F.lit(int(now.timestamp() * 1_000_000)).cast("long").alias("now_us"), "page",
    )
    of = lambda kind: docs.filter(F.col("fetcher") == kind)
    parts = [
        collect.collect_feeds(of("feed"), pages, known, window), collect.collect_embedded(of("embedded"), window),
        collect.collect_sitemaps(of("sitemap"), pages, known, window, raw), collect.collect_lists(of("html_list"), pages, known, window),
    ]
    return collect.collected(parts, language)


def daily(spark: SparkSession, sites: DataFrame, raw: DataFrame, pages: DataFrame, scores: DataFrame, summaries: DataFrame, store: str, state_path: str,
          settings: Settings, now: dt.datetime, only: list[str] | None = None) -> tuple[str, str, str]:
    """Collects, scores and summarises one window, upserts the store, folds the state, and renders the digest."""
    window = daily_window(now, settings.timezone, settings.window_end_hour, settings.window_hours)
    today = now.astimezone(ZoneInfo(settings.timezone)).date()
    states = storage.load_state(spark, state_path)
    # the store and the state are overwritten below, so what was read from them is fixed first
    states = cut_lineage(states)
    targets = cut_lineage(sites_to_collect(sites, states, today, settings.inactive_after_days, settings.recheck_every_days, only))
    known = storage.known_urls(spark, store, today)
    articles, results = tiers(targets, raw, pages, known, window, now, settings.language, settings.max_list_pages)
    ordered = cut_lineage(with_seq(articles.drop("seq"), "published_at", "url"))
    results = cut_lineage(results)
    ranked = apply_scores(ordered, scores, list(settings.interests), settings.batch_size)
    top = select_top(ranked, settings.top_k, settings.score_threshold)
    final = cut_lineage(apply_summaries(ranked, top, summaries))
    storage.merge_daily(spark, final, store, settings.timezone, settings.window_end_hour)
    seen = results.select("site", F.to_date(F.from_utc_timestamp(F.timestamp_micros("newest_seen"), settings.timezone)).alias("newest_seen_local_date"))
    storage.save_state(fold_run(states, seen), state_path)
    n_sites, n_targets = sites.count(), targets.count()
    return report.render_digest(final, results, settings, window, n_targets, n_sites - n_targets)


def replay(spark: SparkSession, store: str, day: dt.date, settings: Settings) -> DataFrame:
    """The stored articles of one day, collapsed again; nothing is collected or scored."""
    stored = storage.read_daily(spark, store).filter(F.col("day") == F.lit(day)).drop("day")
    return collapse_twins(dedupe(stored).drop("url_seq"), settings.language)


def scan(spark: SparkSession, store: str, settings: Settings, now: dt.datetime, days: int | None = None, since: dt.datetime | None = None,
         last: int | None = None, only: list[str] | None = None, fresh: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(articles of the range, days without a file): stored rows, and fresh ones for the missing days only."""
    window = scan_window(now, settings.timezone, days, since)
    stored, missing = storage.read_range(spark, store, window)
    rows = stored.drop("url_seq")
    rows = rows.filter(F.col("site").isin(only)) if only else rows
    if fresh is not None:
        inside = fresh.filter(window.contains(F.col("published_at"))).select(*rows.columns)
        rows = dedupe(rows.unionByName(inside.withColumn("seq", F.col("seq") + F.lit(1 << 40)))).drop("url_seq")
    return (rows.orderBy(F.col("published_at").desc(), "seq").limit(last) if last is not None else rows), missing


def site_listing(sites: DataFrame, states: DataFrame, today: dt.date, statuses: list[str] | None = None, fetcher: str | None = None) -> DataFrame:
    return listing(describe(sites, states, today), statuses, fetcher)
