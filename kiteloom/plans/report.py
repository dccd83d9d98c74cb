"""The digest and other reports: rows by query, text on the driver."""

from __future__ import annotations

import datetime as dt
import html
from pathlib import Path
from zoneinfo import ZoneInfo

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kiteloom.functions.windows import Window, date_label, local_label
from kiteloom.operators.records import failure_reason, rank_order, scan_report, scan_totals
from kiteloom.schema import Settings

# The length of a teaser, and the digest's standing texts.
SUBTITLE_LIMIT = 140
NO_ARTICLES, NO_HEADLINE, AND_MORE = "이 시간대에 올라온 글이 없습니다.", "새 글 없음", "외"
HEAD, REST, FOOT, FAILED = "{day}  ·  {total}건 / {sites}개 블로그", "-- 나머지 {n}건 ", "관심사 {interests}개 · 비활성 {inactive}개 제외 · {window}", "수집 실패 {n}건: {detail}"
SCAN_HEAD, SCAN_STORED, SCAN_PARTS = "{n}건  ·  {oldest} ~ {newest}  ·  {sites}개 블로그", "저장: {path}", "재사용 {reused}건 / 새로 수집 {crawled}건"
#: Links and failures that a rendered digest shows; it tells how many more there are.
SHOWN_LINKS = 2000


def digest_rows(articles: DataFrame, settings: Settings, per: list[str] | None = None) -> DataFrame:
    """Adds `section` ('card' or 'link') and the cards' `position`: the best articles above the threshold are cards.

    Only the cards are ranked, within each group of `per` or over all rows: a limit of top_k is applied before any
    rows meet, so a day or site that holds most of them costs no more. Urls are distinct, as `dedupe` leaves them.
    """
    keys = per or []
    passing = articles.filter(F.coalesce(F.col("score"), F.lit(0)) >= settings.score_threshold)
    best = passing if keys else passing.orderBy(*rank_order()).limit(settings.top_k)  # then top_k rows at most are numbered
    rank = F.row_number().over(W.partitionBy(*(keys or [F.lit(1)])).orderBy(*rank_order()))
    cards = best.withColumn("position", rank).filter(F.col("position") <= settings.top_k).select(*keys, "url", "position")
    joined = articles.join(cards, [*keys, "url"], "left")
    return joined.select(*articles.columns, "position", F.when(F.col("position").isNotNull(), "card").otherwise("link").alias("section"))


def card_lines(tz: str):
    """Text of one digest row, as a Column over `digest_rows`."""
    tags = F.array_join(F.transform(F.coalesce("interests", F.array().cast("array<string>")), lambda t: F.concat(F.lit("["), t, F.lit("]"))), "")
    joined = F.array_join(F.coalesce("summary", F.array().cast("array<string>")), " ")
    teaser = F.when(joined != "", joined).otherwise(F.left(F.coalesce("subtitle", F.lit("")), F.lit(SUBTITLE_LIMIT)))
    byline = F.concat(F.col("site"), F.when(F.coalesce("author", F.lit("")) != "", F.concat(F.lit(" · "), F.col("author"))).otherwise(""))
    card = F.concat_ws(
        "\n",
        F.rtrim(F.concat(F.col("position").cast("string"), F.lit(". "), F.col("title"), F.lit(" "), tags)),
        F.when(teaser != "", F.concat(F.lit("   "), teaser)),
        F.concat(F.lit("   "), byline, F.lit(" · "), local_label(F.col("published_at"), tz)),
        F.concat(F.lit("   "), F.col("url")),
    )
    link = F.concat_ws(
        "\n",
        F.rtrim(F.concat(F.lit("· "), F.col("title"), F.lit(" ("), F.col("site"), F.lit(" · "), local_label(F.col("published_at"), tz, "MM-dd"), F.lit(") "), tags)),
        F.concat(F.lit("  "), F.col("url")),
    )
    return F.when(F.col("section") == "card", card).otherwise(link)


def failures(results: DataFrame) -> DataFrame:
    return results.filter(F.col("error").isNotNull()).select("site", failure_reason(F.col("error")).alias("reason"))


def subject(settings: Settings, end: dt.datetime, total: int, best_title: str | None) -> str:
    headline = f"{best_title} {AND_MORE}" if best_title else NO_HEADLINE
    return settings.subject_format.format(date=f"{end.astimezone(ZoneInfo(settings.timezone)):%m-%d}", count=total, headline=headline)


def tag_text(tags) -> str:
    return "".join(f"[{t}]" for t in tags or [])


def render_digest(articles: DataFrame, results: DataFrame, settings: Settings, window: Window, site_count: int, inactive_count: int, shown: int = SHOWN_LINKS) -> tuple[str, str, str]:
    """(subject, HTML, text) of one digest.

    Counts are taken over all rows. The text holds all cards, at most `shown` links and failures, and says how many more
    there are; `write_links` writes every link.
    """
    digest = digest_rows(articles, settings).withColumn("line", card_lines(settings.timezone)).withColumn("day", local_label(F.col("published_at"), settings.timezone, "MM-dd"))
    total, n_links = digest.agg(F.count("*"), F.count_if(F.col("section") == "link")).first()
    cards = digest.filter("section = 'card'").orderBy("position").collect()  # top_k at most
    links = digest.filter("section = 'link'").orderBy(*rank_order()).limit(shown).collect()
    broken = failures(results) if settings.show_failures else failures(results).limit(0)
    n_failed, failed = broken.count(), broken.orderBy("site").limit(shown).collect()
    day = articles.sparkSession.range(1).select(date_label(F.lit(window.end), settings.timezone)).first()[0]
    head = HEAD.format(day=day, total=total, sites=site_count)
    more = [f"… +{n_links - len(links)}"] if n_links > len(links) else []
    body = [head, "=" * 60, "", *([] if total else [NO_ARTICLES])]
    for r in cards:
        body += [r.line, ""]
    if links:
        body += [REST.format(n=n_links) + "-" * 34, *[r.line for r in links], *more, ""]
    foot = FOOT.format(interests=len(settings.interests), inactive=inactive_count, window=window.label(settings.timezone))
    detail = ", ".join(f"{f.site} ({f.reason})" for f in failed) + (f", … +{n_failed - len(failed)}" if n_failed > len(failed) else "")
    failed_line = FAILED.format(n=n_failed, detail=detail) if n_failed else ""
    body += ["-" * 60, foot, *([failed_line] if failed_line else [])]
    esc = lambda text: html.escape(text or "", quote=True)

    def item(r) -> str:
        title = f'<a href="{esc(r.url)}">{esc(r.title)}</a> <span class="tags">{esc(tag_text(r.interests))}</span>'
        if r.section == "link":
            return f'<li class="link">{title} <span class="by">{esc(r.site)} · {r.day}</span></li>'
        teaser = " ".join(r.summary or []) or (r.subtitle or "")[:SUBTITLE_LIMIT]
        by = " · ".join(p for p in (r.site, r.author, r.day) if p)
        return f'<li class="card">{title}<p>{esc(teaser)}</p><span class="by">{esc(by)}</span></li>'

    page = "\n".join([
        '<!doctype html><html><head><meta charset="utf-8"></head><body>', f"<h1>{esc(head)}</h1>", *([] if total else [f"<p>{esc(NO_ARTICLES)}</p>"]),
        "<ol>", *[item(r) for r in cards], "</ol>", "<ul>", *[item(r) for r in links], *[f"<li>{esc(m)}</li>" for m in more], "</ul>",
        f"<footer>{esc(foot)}" + (f"<br>{esc(failed_line)}" if failed_line else "") + "</footer></body></html>",
    ])
    first = [*cards, *links]
    return subject(settings, window.end, total, first[0].title if first else None), page, "\n".join(body)


def write_links(articles: DataFrame, settings: Settings, path: str) -> None:
    """Every row of a digest as lines of text, in its order; the sort is by ranges, so no task holds them all."""
    digest_rows(articles, settings).withColumn("line", card_lines(settings.timezone)).orderBy(*rank_order()).select("line").write.mode("overwrite").text(path)


def write_preview(folder: str, page: str, text: str, name: str = "preview") -> list[str]:
    """The rendered digest as an HTML and a text file."""
    written = []
    for suffix, content in ((".html", page), (".txt", text)):
        target = Path(folder) / (name + suffix)
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(content, encoding="utf-8")
        written.append(str(target))
    return written


def scan_text(articles: DataFrame, path: str, reused: int, crawled: int) -> str:
    """The report of a scan: totals, where it was stored, and the counts by site, most first (one line per site of the registry)."""
    totals = scan_totals(articles).first()
    lines = [SCAN_HEAD.format(n=totals.n, oldest=totals.oldest, newest=totals.newest, sites=totals.n_sites), SCAN_STORED.format(path=path), SCAN_PARTS.format(reused=reused, crawled=crawled), ""]
    return "\n".join(lines + [f"  {r.n:>4}  {r.site}" for r in scan_report(articles).orderBy(F.col("n").desc(), "first_seq").collect()])


def listing_lines(described: DataFrame) -> DataFrame:
    """(line, status, name): fixed-width lines of the site listing."""
    last = F.coalesce(F.col("last_post").cast("string"), F.lit("-"))
    return described.select(
        F.format_string("%-9s %-24s %-10s %-11s %s", "status", "name", "fetcher", last, F.left(F.coalesce("note", F.lit("")), F.lit(34))).alias("line"), "status", "name")


# Labels by which a scorer is told of interests and articles.
ALL_NOTE, OWN_NOTE, ARTICLE_LABELS = "For all interests: {note}", "note", {"site": "site", "author": "author", "subtitle": "summary"}


def interest_prompt(interests: DataFrame, note: str | None = None) -> DataFrame:
    """(name, text): what a scorer is told of each interest; a note that holds for all of them has a row without name."""
    own = F.when(F.coalesce("special_instructions", F.lit("")) != "", F.concat(F.lit(f" ({OWN_NOTE}: "), F.col("special_instructions"), F.lit(")")))
    rows = interests.select("name", F.concat_ws("", F.lit("- "), F.col("name"), F.lit(": "), F.array_join("keywords", ", "), own).alias("text"))
    if not (note or "").strip():
        return rows
    return rows.unionByName(interests.sparkSession.createDataFrame([(None, ALL_NOTE.format(note=note.strip()))], "name string, text string"))


def article_prompt(batch_size: int = 25):
    """Text that describes an article to a scorer, as a Column; the number is its place in the batch."""
    told = [F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(f"; {label}: "), F.col(c))) for c, label in ARTICLE_LABELS.items()]
    return F.concat_ws("", F.lit("#"), (F.col("seq") % batch_size).cast("string"), F.lit(" "), F.col("title"), *told)
