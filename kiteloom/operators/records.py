"""Operators on article records. Every order ends with `seq`, so results do not hang on partitioning."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kiteloom.plans.runtime import cut_lineage

HANGUL = "[가-힣]"
TWIN_GAP_MINUTES = 15
#: Shapes of addresses that are reported, and links that one needs.
TOP_SHAPES, LEAST_LINKS = 8, 3


def filled(column: str) -> Column:
    return F.coalesce(F.col(column) != "", F.lit(False))


def richness() -> Column:
    """How much a copy knows: summary 4, score 2, subtitle 1, author 1; a score of 0 counts, an empty text does not."""
    has_summary = F.coalesce(F.size("summary") > 0, F.lit(False))
    return (
        has_summary.cast("int") * 4 + F.col("score").isNotNull().cast("int") * 2
        + filled("subtitle").cast("int") + filled("author").cast("int")
    )


def dedupe(articles: DataFrame) -> DataFrame:
    """The richest copy per url, the first among equals. Adds `url_seq`, the first appearance of the url.

    Newest first, ties in order of `url_seq`, is the order the result stands for. A struct maximum is
    combined before the shuffle, so a url that holds a third of all rows moves as one row per task.
    """
    rest = [c for c in articles.columns if c != "url"]
    best = articles.groupBy("url").agg(
        F.max_by(F.struct(*rest), F.struct(richness(), -F.col("seq"))).alias("best"), F.min("seq").alias("url_seq")
    )
    return best.select("url", "best.*", "url_seq").select(*articles.columns, "url_seq")


def twin_clusters(articles: DataFrame, gap_minutes: int = TWIN_GAP_MINUTES) -> DataFrame:
    """Adds `cluster`: posts of one author on one site, each at most the gap after the one before.

    Days are ordered apart and chained by their first and last post, so no author's rows ever meet in one
    task. Rows without author are in no cluster and are left out.
    """
    gap = gap_minutes * 60_000_000
    own = ["site", "author", "_day"]
    timed = articles.filter(filled("author")).withColumn("_us", F.unix_micros("published_at")).withColumn(
        "_day", F.floor(F.col("_us") / 86_400_000_000).cast("long")
    )
    within = W.partitionBy(*own).orderBy("_us", "seq")
    opens = F.coalesce((F.col("_us") - F.lag("_us").over(within) > gap).cast("long"), F.lit(0))
    local = timed.withColumn("_opens", opens).withColumn(
        "_local", F.sum("_opens").over(within.rowsBetween(W.unboundedPreceding, 0))
    )
    days = local.groupBy(*own).agg(F.min("_us").alias("_first"), F.max("_us").alias("_last"), F.sum("_opens").alias("_n"))
    over_days = W.partitionBy("site", "author").orderBy("_day")
    fresh = F.coalesce((F.col("_first") - F.lag("_last").over(over_days) > gap).cast("long"), F.lit(1))
    chained = days.withColumn("_fresh", fresh)
    earlier = F.coalesce(F.sum("_n").over(over_days.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    base = chained.withColumn("_base", F.sum("_fresh").over(over_days.rowsBetween(W.unboundedPreceding, 0)) + earlier).select(*own, "_base")
    return local.join(base, own).withColumn("cluster", F.col("_base") + F.col("_local")).select(*articles.columns, "cluster")


def preferred(language: str) -> Column:
    """Rank of a copy within a cluster, smallest first: the wanted language, then time, then input order."""
    korean = F.col("title").rlike(HANGUL)
    return F.struct((~korean if language == "ko" else korean).cast("int"), "published_at", "seq")


def collapse_twins(articles: DataFrame, language: str = "ko", gap_minutes: int = TWIN_GAP_MINUTES) -> DataFrame:
    """One copy per cluster of near-simultaneous posts; rows without author pass through."""
    columns = articles.columns
    clusters = twin_clusters(articles, gap_minutes)
    kept = clusters.groupBy("site", "author", "cluster").agg(
        F.min_by(F.struct(*[c for c in columns if c not in ("site", "author")]), preferred(language)).alias("best")
    ).select("site", "author", "best.*").select(*columns)
    return kept.unionByName(articles.filter(~filled("author")))


def session_clusters(articles: DataFrame, gap_minutes: int = TWIN_GAP_MINUTES) -> DataFrame:
    """(site, author, n, first_at, last_at) by session window; combined before the shuffle, so it bears hot authors.

    A session window merges up to, and not at, its gap, so a microsecond is added to reach gaps of exactly 15 minutes.
    """
    window = F.session_window("published_at", f"{gap_minutes * 60 * 1_000_000 + 1} microseconds")
    return articles.filter(filled("author")).groupBy("site", "author", window.alias("w")).agg(
        F.count("*").alias("n"), F.min("published_at").alias("first_at"), F.max("published_at").alias("last_at")
    ).drop("w")


def rank_order() -> list[Column]:
    """Best first: score (null counts as 0), then newest, then input order."""
    return [F.coalesce(F.col("score"), F.lit(0)).desc(), F.col("published_at").desc(), F.col("seq").asc()]


def select_top(articles: DataFrame, k: int, threshold: int, per: list[str] | None = None) -> DataFrame:
    """The k best with at least the threshold's score, over all rows or within each group of `per`."""
    passing = articles.filter(F.coalesce(F.col("score"), F.lit(0)) >= threshold)
    if not per:
        return passing.orderBy(*rank_order()).limit(k)
    rank = F.row_number().over(W.partitionBy(*per).orderBy(*rank_order()))
    return passing.withColumn("_rank", rank).filter(F.col("_rank") <= k).drop("_rank")


def rest_links(articles: DataFrame, top: DataFrame) -> DataFrame:
    """The articles that are not among the top, by url."""
    return articles.join(top.select("url").distinct(), "url", "left_anti").select(*articles.columns)


def upsert(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Stored and fresh rows as one set by url; the stored copy wins among equals."""
    tagged = stored.withColumn("_side", F.lit(0)).unionByName(fresh.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in stored.columns if c != "url"]
    best = tagged.groupBy("url").agg(F.max_by(F.struct(*rest), F.struct(richness(), -F.col("_side"), -F.col("seq"))).alias("best"))
    return best.select("url", "best.*").select(*stored.columns)


def known_anti_join(candidates: DataFrame, known: DataFrame) -> DataFrame:
    """Candidates whose url is not known yet. Catalyst broadcasts the known side only below its size threshold."""
    return candidates.join(known.select("url").distinct(), "url", "left_anti").select(*candidates.columns)


def apply_scores(articles: DataFrame, scores: DataFrame, valid: list[str], batch_size: int = 25) -> DataFrame:
    """Scores joined by batch and place in the batch; the last of several answers wins, others keep what they have.

    Needs a dense `seq` from 0. Interests outside `valid` and blank reasons are dropped; places outside the
    batch meet no article.
    """
    last = scores.groupBy("batch_id", "idx").agg(
        F.max_by(F.struct("score", "interests", "reason"), "ord").alias("s")
    )
    placed = articles.withColumn("batch_id", F.floor(F.col("seq") / batch_size).cast("long")).withColumn("idx", (F.col("seq") % batch_size).cast("int"))
    joined = placed.join(last, ["batch_id", "idx"], "left")
    hit = F.col("s").isNotNull()
    allowed = F.array(*[F.lit(v) for v in valid]).cast("array<string>")
    return joined.select(
        *[F.col(c) for c in articles.columns if c not in ("score", "interests", "reason")],
        F.when(hit, F.col("s.score")).otherwise(F.col("score")).alias("score"),
        F.when(hit, F.filter(F.col("s.interests"), lambda x: F.array_contains(allowed, x))).otherwise(F.col("interests")).alias("interests"),
        F.when(hit, F.nullif(F.trim("s.reason"), F.lit(""))).otherwise(F.col("reason")).alias("reason"),
    ).select(*articles.columns)


def apply_summaries(articles: DataFrame, top: DataFrame, summaries: DataFrame) -> DataFrame:
    """Summaries of the selected articles only: trimmed lines, blank ones dropped."""
    lines = F.filter(F.transform("new_summary", lambda s: F.trim(s)), lambda s: s != "")
    chosen = top.select("url").distinct().join(summaries.groupBy("url").agg(F.first("summary").alias("new_summary")), "url")
    joined = articles.join(chosen, "url", "left")
    return joined.withColumn("summary", F.coalesce(lines, F.col("summary"))).select(*articles.columns)


class QuotaExhausted(Exception):
    """Raised by a scorer that may not be asked again today."""


SCORES = "batch_id long, idx int, ord int, score int, interests array<string>, reason string"


def score_batches(articles: DataFrame, scorer, batch_size: int = 25) -> DataFrame:
    """Scores (batch_id, idx, ord, score, interests, reason) of articles with a dense `seq`, for `apply_scores`.

    `scorer` takes the pandas rows of one batch, with their place `idx`, and returns rows of idx, score, interests and
    reason; it runs next to the data, and no article is filtered before it. A batch whose scorer fails scores 0
    where it has no score yet; from the first batch that meets QuotaExhausted on, nothing is scored.
    """
    placed = articles.withColumn("batch_id", F.floor(F.col("seq") / batch_size).cast("long")).withColumn("idx", (F.col("seq") % batch_size).cast("int"))

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values("idx").reset_index(drop=True)
        number = batch["batch_id"].iloc[0]
        try:
            made = scorer(batch).assign(ord=lambda d: range(len(d)))
        except QuotaExhausted:
            return pd.DataFrame({"batch_id": [number], "idx": [-1], "ord": [-1], "score": [None], "interests": [None], "reason": [None]})
        except Exception:  # noqa: BLE001
            unset = batch[batch["score"].isna()]
            made = pd.DataFrame({"idx": unset["idx"], "score": 0, "interests": [[]] * len(unset), "reason": None, "ord": 0})
        return made.assign(batch_id=number)[["batch_id", "idx", "ord", "score", "interests", "reason"]]

    answers = cut_lineage(placed.groupBy("batch_id").applyInPandas(run, SCORES))  # a scorer is asked once
    end = answers.agg(F.min(F.when(F.col("ord") == -1, F.col("batch_id")))).first()[0]
    return answers if end is None else answers.filter(F.col("batch_id") < end)


def summary_inputs(top: DataFrame, pages: DataFrame) -> DataFrame:
    """(url, body): what a summary is made of: the body that a feed gave, else the main text of pages(url, main_text); without either there is no row."""
    texts = pages.groupBy("url").agg(F.first("main_text").alias("main_text"))
    body = F.coalesce(F.when(filled("body"), F.col("body")), F.when(filled("main_text"), F.col("main_text")))
    return top.join(texts, "url", "left").select("url", body.alias("body")).filter(F.col("body").isNotNull())


def to_record() -> Column:
    """JSON line of an article: empty texts and lists are left out, a score of 0 is kept, the body never written."""
    text = lambda c: F.when(F.col(c) != "", F.col(c))
    items = lambda c: F.when(F.size(c) > 0, F.col(c))
    offset = F.coalesce(F.col("published_offset_s"), F.lit(0))
    local = F.date_format(F.timestamp_micros(F.unix_micros("published_at") + offset.cast("long") * 1_000_000), "yyyy-MM-dd'T'HH:mm:ss")
    zone = F.format_string("%s%02d:%02d", F.when(offset < 0, "-").otherwise("+"), F.floor(F.abs(offset) / 3600).cast("int"), F.floor(F.abs(offset) % 3600 / 60).cast("int"))
    return F.to_json(F.struct(
        F.concat(local, zone).alias("published_at"), "site", "title", "url", text("author").alias("author"), text("subtitle").alias("subtitle"),
        text("reason").alias("reason"), F.col("score"), items("interests").alias("interests"), items("summary").alias("summary"),
    ))


def failure_reason(error: Column) -> Column:
    """Class of an error text 'Kind: message': the status of an HTTP error, a standing text for ValueError, else the kind."""
    kind = F.substring_index(error, ":", 1)
    status = F.regexp_extract(error, r"HTTP Error (\d+)", 1)
    return F.when(error.isNull(), None).when(
        kind == "HTTPError", F.when(status != "", F.concat(F.lit("HTTP "), status)).otherwise(kind)
    ).when(kind == "ValueError", F.lit("no articles matched")).otherwise(kind)


def error_rollup(outcomes: DataFrame) -> DataFrame:
    """(site, newest_seen, n_articles, error): one row per site over its sources.

    A site failed only if all its sources did and nothing was found; its errors are joined in order of `ord`,
    each text once.
    """
    ordered = F.array_sort(F.collect_list(F.when(F.col("error").isNotNull(), F.struct("ord", "error"))))  # a site's few sources
    texts = F.array_distinct(F.transform("_errors", lambda e: e["error"]))
    return outcomes.groupBy("site").agg(
        F.max("newest_seen").alias("newest_seen"), F.sum("n_articles").alias("n_articles"),
        F.min(F.col("error").isNotNull()).alias("_all_failed"), ordered.alias("_errors"),
    ).select(
        "site", "newest_seen", "n_articles",
        F.when(F.col("_all_failed") & (F.coalesce("n_articles", F.lit(0)) == 0) & F.col("newest_seen").isNull(), F.array_join(texts, "; ")).alias("error"),
    )


def pulse(articles: DataFrame, inside: Column) -> DataFrame:
    """(site, newest_seen, n_all, n_window): the newest date anywhere in a source, and the window's count, in one pass."""
    return articles.groupBy("site").agg(
        F.max("published_at").alias("newest_seen"), F.count("*").alias("n_all"), F.count_if(inside).alias("n_window")
    )


def scan_report(articles: DataFrame) -> DataFrame:
    """(site, n, first_seq): counts by site, most first, ties by first appearance."""
    return articles.groupBy("site").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"))


def scan_totals(articles: DataFrame) -> DataFrame:
    """One row: (n, oldest, newest, n_sites); dates in each value's own offset."""
    local = F.to_date(F.timestamp_micros(F.unix_micros("published_at") + F.coalesce(F.col("published_offset_s"), F.lit(0)).cast("long") * 1_000_000))
    return articles.agg(F.count("*").alias("n"), F.min(local).alias("oldest"), F.max(local).alias("newest"), F.countDistinct("site").alias("n_sites"))


def shape_frequency(links: DataFrame, shape: Column, per: list[str] | None = None) -> DataFrame:
    """The TOP_SHAPES most frequent shapes of `links`, over all or for each group of `per`, that occur at least LEAST_LINKS times; ties by first appearance."""
    keys = per or []
    counts = links.select(*keys, shape.alias("shape"), "seq").filter(F.col("shape").isNotNull()).groupBy(*keys, "shape").agg(
        F.count("*").alias("n"), F.min("seq").alias("first_seq")
    )
    if not keys:
        return counts.orderBy(F.col("n").desc(), "first_seq").limit(TOP_SHAPES).filter(F.col("n") >= LEAST_LINKS)
    place = F.row_number().over(W.partitionBy(*keys).orderBy(F.col("n").desc(), "first_seq"))
    return counts.withColumn("_place", place).filter((F.col("_place") <= TOP_SHAPES) & (F.col("n") >= LEAST_LINKS)).drop("_place")
