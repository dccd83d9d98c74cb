"""Storage, whole runs, reports and streams."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F
from test_records import T0, article, brute_fold, frame

from kiteloom.functions.windows import Window
from kiteloom.operators import records, site_state
from kiteloom.plans import pipelines, report
from kiteloom.schema import SITE, Settings
from kiteloom.sources import storage
from kiteloom.streaming import jobs

UTC = dt.timezone.utc


def test_registry_csv(spark, tmp_path):
    path = tmp_path / "sites.csv"
    path.write_text('﻿name,url,fetcher,source_url,tz,params,enabled,note\na,https://a,,,,"{""date_from"": ""detail""}",,"two\nlines"\n ,https://b,,,,,1,\nc,https://c,feed,https://c/f,Asia/Seoul,,0,x\nd,https://d,,,,,False,\n', encoding="utf-8")
    got = {r.name: r for r in storage.load_sites(spark, str(path)).collect()}
    assert set(got) == {"a", "c", "d"} and got["a"].fetcher == "feed" and got["a"].source_url == "https://a" and got["a"].tz is None
    assert (got["a"].enabled, got["c"].enabled, got["d"].enabled) == (True, False, True) and json.loads(got["a"].params) == {"date_from": "detail"}
    storage.save_sites(storage.load_sites(spark, str(path)), str(tmp_path / "out"))
    assert storage.load_sites(spark, str(tmp_path / "out")).count() == 3
    path.write_text("name,url,fetcher,source_url,tz,params,enabled,note\nbad,https://a,,,,{x,,\n")
    with pytest.raises(ValueError, match="bad"):
        storage.load_sites(spark, str(path))


def test_daily_store_upsert_range_and_horizon(spark, tmp_path):
    store = str(tmp_path / "daily")
    assert storage.read_daily(spark, store).count() == 0
    storage.merge_daily(spark, frame(spark, article(1, "a", score=1), article(2, "b", minutes=-1440 * 3)), store)
    storage.merge_daily(spark, frame(spark, article(3, "a", author="x", score=2), article(4, "c", minutes=1)), store)
    rows = {r.url: (r.score, r.author, str(r.day)) for r in storage.read_daily(spark, store).collect()}
    assert rows == {"a": (2, "x", "2024-01-02"), "b": (None, None, "2023-12-30"), "c": (None, None, "2024-01-02")}
    # the store is read by the dates of the window's bounds, the rows by its instants
    window = Window(T0 - dt.timedelta(days=4), T0 + dt.timedelta(days=1))
    got, missing = storage.read_range(spark, store, window)
    assert {r.url for r in got.collect()} == {"a", "b", "c"}
    assert sorted(str(r.day) for r in missing.collect()) == ["2023-12-28", "2023-12-29", "2023-12-31", "2024-01-01"]
    narrow, _ = storage.read_range(spark, store, Window(T0, T0 + dt.timedelta(days=1, minutes=-1)))
    assert {r.url for r in narrow.collect()} == {"a", "c"}
    assert {r.url for r in storage.known_urls(spark, store, dt.date(2024, 1, 30)).collect()} == {"a", "c"}
    replayed = pipelines.replay(spark, store, dt.date(2024, 1, 2), Settings())
    assert {r.url for r in replayed.collect()} == {"a", "c"}
    scanned, gaps = pipelines.scan(spark, store, Settings(timezone="UTC"), T0 + dt.timedelta(days=1), days=5, last=1)
    assert [r.url for r in scanned.collect()] == ["c"] and gaps.count() > 0


def test_state_and_interests(spark, tmp_path):
    path = str(tmp_path / "state")
    assert storage.load_state(spark, path).count() == 0
    one = spark.createDataFrame([("a", dt.date(2024, 1, 1), 2)], "site string, last_post date, empty_runs int")
    storage.save_state(one, path)
    results = spark.createDataFrame([("a", None), ("b", dt.date(2024, 2, 1))], "site string, newest_seen_local_date date")
    storage.save_state(site_state.fold_run(storage.load_state(spark, path), results), path)
    assert {r.site: (str(r.last_post), r.empty_runs) for r in storage.load_state(spark, path).collect()} == {"a": ("2024-01-01", 3), "b": ("2024-02-01", 0)}
    (tmp_path / "i.json").write_text(json.dumps({"interests": [{"name": "data", "keywords": ["a", "b"], "special_instructions": "only x"}, {"name": "ml"}]}))
    texts = [r.text for r in report.interest_prompt(storage.load_interests(spark, str(tmp_path / "i.json"))).orderBy("name").collect()]
    assert texts == ["- data: a, b (note: only x)", "- ml: "]
    noted = report.interest_prompt(storage.load_interests(spark, str(tmp_path / "i.json")), " be strict ").filter("name is null").collect()
    assert [r.text for r in noted] == ["For all interests: be strict"]


def rss(*items):
    body = "".join(f"<item><title>{t}</title><link>{u}</link><pubDate>{d}</pubDate><author>{a}</author></item>" for t, u, d, a in items)
    return bytearray(f"<rss><channel>{body}</channel></rss>".encode())


def test_daily_run_end_to_end(spark, tmp_path):
    now = dt.datetime(2024, 1, 2, 4, 0, tzinfo=UTC)  # the window closed at 03:00 UTC
    day = "Mon, 01 Jan 2024 {} GMT"
    raw = spark.createDataFrame([
        ("https://a/f", rss(("First", "https://a/1?utm_source=x", day.format("10:00:00"), "ann"), ("첫 글", "https://a/2", day.format("10:10:00"), "ann"), ("Old", "https://a/0", "Mon, 01 Jan 2023 10:00:00 GMT", "")), "text/xml", None),
        ("https://b/f", bytearray(b"<html>"), "text/html", None),
        ("https://c", bytearray(f'<script id="__NEXT_DATA__">{json.dumps([{"title": "E1", "date": "2024-01-01T12:00:00Z", "url": "/e1"}, {"title": "E2", "date": "2024-01-01T13:00:00Z", "url": "/e2"}])}</script>'.encode()), "text/html", None),
        ("https://d/sitemap.xml", bytearray(b"<urlset><url><loc>https://d/blog/p1</loc><lastmod>2024-01-01T09:00:00Z</lastmod></url></urlset>"), "text/xml", None),
        ("https://e/blog", bytearray(b'<div><a href="/blog/card-one">x</a></div>'), "text/html", None),
    ], "source_url string, content binary, content_type string, error string")
    meta = lambda title, date: {"title": title, "published_raw": date, "author": None, "subtitle": "sub", "og_type": "article", "has_article_schema": True, "declares_article": True}
    from kiteloom.sources.collect import META

    pages = spark.createDataFrame([("https://d/blog/p1", meta("Page one", None)), ("https://e/blog/card-one", meta("Card | E", "2024-01-01T20:00:00Z"))], f"url string, meta {META}")
    rows = [("A", "https://a", "feed", "https://a/f", None, None, "1", ""), ("B", "https://b", "feed", "https://b/f", None, None, "1", ""), ("C", "https://c", "embedded", "https://c", None, None, "1", ""),
            ("D", "https://d", "sitemap", "https://d/sitemap.xml", None, '{"article_regex": "^/blog/"}', "1", ""), ("E", "https://e", "html_list", "https://e/blog", None, '{"article_regex": "^/blog/[^/]+/?$", "title_strip": " | E"}', "1", "")]
    sites = storage.normalise_sites(spark.createDataFrame(rows, SITE))
    scores = spark.createDataFrame([(0, i, 0, 10 - i, ["data"], "why") for i in range(6)], "batch_id long, idx int, ord int, score int, interests array<string>, reason string")
    summaries = spark.createDataFrame([("https://c/e1", ["line one", "line two"])], "url string, summary array<string>")
    settings = Settings(top_k=2, interests=("data",))
    store, state = str(tmp_path / "store"), str(tmp_path / "state")
    subject, page, text = pipelines.daily(spark, sites, raw, pages, scores, summaries, store, state, settings, now)
    stored = {r.url: r.title for r in storage.read_daily(spark, store).collect()}
    assert stored == {"https://a/2": "첫 글", "https://c/e1": "E1", "https://c/e2": "E2", "https://d/blog/p1": "Page one", "https://e/blog/card-one": "Card"}
    assert "5" in subject and "외" in subject and "수집 실패 1건: B (" in text and text.count("https://") == 5 and "<ol>" in page
    states = {r.site: (str(r.last_post), r.empty_runs) for r in storage.load_state(spark, state).collect()}
    assert states["A"] == ("2024-01-01", 0) and states["B"] == ("None", 1)
    pipelines.daily(spark, sites, raw, pages, scores, summaries, store, state, settings, now)
    assert storage.read_daily(spark, store).count() == 5  # a rerun merges


def test_quiet_days_and_listing(spark):
    window = Window(T0, T0 + dt.timedelta(days=1))
    none = spark.createDataFrame([], "site string, error string")
    subject, _, text = report.render_digest(frame(spark), none, Settings(), window, 3, 1)
    assert subject.endswith("새 글 없음") and "이 시간대에 올라온 글이 없습니다." in text
    subject, page, text = report.render_digest(frame(spark, article(1, title="<Best> & only", score=2)), none, Settings(), window, 3, 1)
    assert "<Best> & only 외" in subject and "&lt;Best&gt;" in page and "나머지 1건" in text
    described = spark.createDataFrame([("active", "n", "feed", None, "x" * 50)], "status string, name string, fetcher string, last_post date, note string")
    assert report.listing_lines(described).first().line == f"{'active':<9} {'n':<24} {'feed':<10} {'-':<11} " + "x" * 34


def test_site_state_stream_equals_the_fold(spark, tmp_path):
    rng = random.Random(3)
    runs = [(run, site, None if rng.random() < 0.4 else dt.date(2024, 1, 1) + dt.timedelta(days=rng.randint(0, 20))) for run in range(12) for site in "ab"]
    schema = "run_id long, site string, newest_seen_local_date date"
    source = tmp_path / "in"
    for part in range(3):
        spark.createDataFrame([r for r in runs if r[0] // 4 == part], schema).coalesce(1).write.mode("append").parquet(str(source / f"p={part}"))
        stream = spark.readStream.schema(schema).parquet(str(source / "p=*"))
        sink = jobs.site_state_stream(stream).writeStream.outputMode("update").foreachBatch(
            lambda df, _, p=part: df.write.mode("append").parquet(str(tmp_path / f"out{p}"))
        )
        query = sink.option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        query.awaitTermination(120)
    last = spark.read.parquet(str(tmp_path / "out2")).collect()
    assert {r.site: (r.last_post, r.empty_runs) for r in last} == brute_fold(runs)


def test_twin_and_distinct_streams(spark, tmp_path):
    rows = [article(i, url=str(i % 7), minutes=m, author="a") for i, m in enumerate([0, 10, 25, 41, 100, 101, 5000, 5001])]
    frame(spark, *rows).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame(spark).schema).parquet(str(tmp_path / "in"))
    out = {}
    for name, df, mode in [("twins", jobs.twin_sessions_stream(stream, "1 minute"), "append"), ("urls", jobs.distinct_stream(stream), "append"), ("days", jobs.daily_counts_stream(stream, "1 minute"), "append")]:
        q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        out[name] = spark.table(name).collect()
    batch = records.session_clusters(frame(spark, *rows)).filter(F.col("last_at") < F.lit(T0 + dt.timedelta(minutes=4000))).collect()
    assert sorted(r.n for r in out["twins"]) == sorted(r.n for r in batch) == [1, 2, 3]
    assert len(out["urls"]) == 7
    assert sum(r.n for r in out["days"]) == 6


def test_reports_count_all_and_show_how_much_is_left_out(spark, tmp_path):
    rows = frame(spark, *[article(i, url=f"https://x/{i}", title=f"T{i}", score=i % 7, minutes=-i) for i in range(30)])
    failed = spark.createDataFrame([(f"s{i}", "HTTPError: HTTP Error 404") for i in range(5)], "site string, error string")
    window = Window(T0, T0 + dt.timedelta(days=1))
    subject, page, text = report.render_digest(rows, failed, Settings(top_k=3), window, 3, 1, shown=4)
    assert "30" in subject and "30건" in text and "나머지 27건" in text and "… +23" in text and "수집 실패 5건" in text and ", … +1" in text and page.count("<li class") == 7
    report.write_links(rows, Settings(top_k=3), str(tmp_path / "links"))
    assert spark.read.text(str(tmp_path / "links")).filter("value like '%https://x/%'").count() == 30
    tagged = frame(spark, article(1, title="A", score=9)).withColumn("interests", F.array(F.lit("<data>")))
    _, page, _ = report.render_digest(tagged, failed.limit(0), Settings(), window, 1, 0)
    assert "[&lt;data&gt;]" in page and report.write_preview(str(tmp_path / "p"), page, "t") == [str(tmp_path / "p" / "preview.html"), str(tmp_path / "p" / "preview.txt")]
    assert report.scan_text(rows, "x.jsonl", 20, 10).splitlines()[-1].strip().startswith("30")


def test_settings_from_a_file_and_the_environment():
    from kiteloom.schema import load_settings

    text = "collection:\n  timezone: UTC\n  recheck_inactive_every_days: 3\nranking:\n  top_k: 7\nemail:\n  sender_address: a@x\n  recipients: [b@x]\noutput:\n"
    got = load_settings(text, {"MAIL_RECIPIENTS": " c@x, ,d@x", "MAIL_SENDER": " "}, ("data",))
    assert (got.timezone, got.recheck_every_days, got.top_k, got.sender, got.recipients, got.interests, got.batch_size) == ("UTC", 3, 7, "a@x", ("c@x", "d@x"), ("data",), 25)
    assert load_settings("").top_k == 5 and load_settings("", {"MAIL_SENDER": "e@x"}).sender == "e@x"
    with pytest.raises(ValueError):
        load_settings("ranking:\n  top_k: 0\n")
