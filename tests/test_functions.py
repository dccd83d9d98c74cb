"""URL, window and date functions against the standard library and literal cases."""

import datetime as dt
import re
from urllib.parse import parse_qsl, urlencode, urlsplit, urlunsplit
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from kiteloom.functions import urls
from kiteloom.functions.dates import micros, parse_date, parse_date_column
from kiteloom.functions.windows import Window, daily_window, range_window, scan_label, scan_window, window_day
from kiteloom.schema import Settings, with_seq
from kiteloom.sources.html import canonical, path_variants

UTC = dt.timezone.utc
URLS = [
    "https://x.example/a?utm_source=f&id=3#top", "https://x.example/a?ref=x", "https://x.example/a?flag&b=", "https://x.example/a?q=%zz&x=~*", "HTTPS://X.example/P/", "https://x.example/a b?c=d e",
    "https://x.example/a?source=rss----1---4&gclid=&fbclid=2", "https://x.example/a?&&a=1", "https://x.example/a?a=1+2&b=%2B", "/relative?ref=1&k=v", "https://x.example/a?k=한글",
]


def standard_library(url):
    p = urlsplit(url)
    kept = [(k, v) for k, v in parse_qsl(p.query, keep_blank_values=True) if k not in urls.TRACKING_KEYS and not k.startswith("utm_")]
    return urlunsplit((p.scheme, p.netloc, p.path, urlencode(kept), ""))


def column(spark, values, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.select("i", expression(F.col("v")).alias("x")).orderBy("i").select("x").collect()]


def test_canonical_url_equals_the_standard_library(spark):
    got = column(spark, URLS, urls.canonical_url)
    assert got == [standard_library(u) for u in URLS] == [canonical(u) for u in URLS]
    assert column(spark, got, urls.canonical_url) == got
    assert column(spark, [None], urls.canonical_url) == [None]


def test_locale_variants(spark):
    paths = ["/kr/ko/blog/x", "/en-US/blog/", "/aa/bb/cc/d", "/blog//x", "", "/ko"]
    assert column(spark, paths, urls.locale_variants) == [path_variants(p) for p in paths]
    assert path_variants("/kr/ko/blog/x") == ["/kr/ko/blog/x", "/ko/blog/x", "/blog/x"]


def test_shapes_navigation_and_small_helpers(spark):
    shapes = column(spark, ["/blog/some-long-slug", "/p/abc.html", "/a.b/c", "/", "/1/2/3/4/5"], urls.path_shape)
    assert shapes == ["^/blog/[^/]+/?$", r"^/p/[^/]+\.html/?$", r"^/[^/]+\.b/c/?$", None, None]
    assert all(re.search(s, p) for s, p in zip(shapes, ["/blog/some-long-slug", "/p/abc.html", "/a.b/c"]))
    assert column(spark, ["/Tags/x", "/tagged/x"], urls.is_navigation) == [True, False]
    assert column(spark, ["Title | Blog", "Title"], lambda c: urls.strip_suffix(c, F.lit(" | Blog"))) == ["Title", "Title"]
    assert column(spark, ["https://b.example/p/x?q"], lambda c: urls.sitemap_url(c, F.lit(None).cast("string"))) == ["https://b.example/sitemap.xml"]
    assert column(spark, ["a b/c"], urls.slug) == ["a%20b%2Fc"]
    assert column(spark, ["https://medium.com/pub"], urls.feed_candidates)[0][:2] == ["https://medium.com/feed/pub", "https://medium.com/pub/index.xml"]
    df = spark.createDataFrame([("/ko/blog/x", "^/blog/[^/]+/?$"), ("/about", "^/blog/")], "p string, r string")
    assert [r[0] for r in df.select(urls.matches_article(F.col("p"), F.col("r"))).collect()] == [True, False]
    assert column(spark, ["https://x/l?page={page}"], lambda c: F.concat_ws(" ", urls.page_url(c, F.lit("https://x/l"), F.lit(1)), urls.page_url(c, F.lit("https://x/l"), F.lit(3)))) == ["https://x/l https://x/l?page=3"]


@pytest.mark.parametrize("hour,minute,day", [(9, 0, 4), (12, 0, 5), (12, 5, 5)])
def test_daily_window_has_closed(hour, minute, day):
    w = daily_window(dt.datetime(2024, 3, 5, hour, minute, tzinfo=ZoneInfo("Asia/Seoul")), "Asia/Seoul")
    assert w.end == dt.datetime(2024, 3, day, 12, tzinfo=ZoneInfo("Asia/Seoul")) and w.end - w.start == dt.timedelta(hours=24)


def test_windows_are_half_open_disjoint_and_total(spark):
    w = daily_window(dt.datetime(2024, 3, 5, 9, tzinfo=UTC), "Asia/Seoul")
    times = [w.start - dt.timedelta(microseconds=1), w.start, w.end - dt.timedelta(microseconds=1), w.end, None]
    df = spark.createDataFrame([(t,) for t in times], "ts timestamp")
    assert [r[0] for r in df.select(w.contains(F.col("ts"))).collect()] == [False, True, True, False, False]
    assert [str(r[0]) for r in df.filter("ts is not null").select(window_day(F.col("ts"))).collect()] == ["2024-03-04", "2024-03-05", "2024-03-05", "2024-03-06"]
    assert w.label("Asia/Seoul") == "2024-03-04 12:00 → 2024-03-05 12:00"


def test_scan_windows_and_labels():
    now = dt.datetime(2024, 3, 5, 9, tzinfo=UTC)
    assert scan_window(now, "UTC", days=0).start == now - dt.timedelta(days=365)
    since = dt.datetime(2024, 1, 2)
    assert range_window(now, "UTC", days=3, since=since).start == since.replace(tzinfo=ZoneInfo("UTC"))
    with pytest.raises(ValueError):
        range_window(now, "UTC")
    w = scan_window(now, "UTC", since=since)
    assert scan_label(w, "UTC", last=5, since=since) == "2024-03-05-since20240102-top5" and scan_label(w, "UTC", days=7) == "2024-03-05-last7d"


NOW = dt.datetime(2026, 3, 1, tzinfo=UTC)
DATES = [
    ("2026-08-13T10:00:00Z", dt.datetime(2026, 8, 13, 10, tzinfo=UTC)), ("20260813", dt.datetime(2026, 8, 13, tzinfo=UTC)), ("2026", None),
    ("Thu, 13 Aug 2026 10:00:00 +0900", dt.datetime(2026, 8, 13, 1, tzinfo=UTC)), ("Thu, 13 Aug 2026 10:00:00 KST", dt.datetime(2026, 8, 13, 10, tzinfo=UTC)),
    ("Posted 2026. 8. 13. by me", dt.datetime(2026, 8, 13, tzinfo=UTC)), ("2026년 8월 13일", dt.datetime(2026, 8, 13, tzinfo=UTC)), ("2026-02-30", None),
    ("Aug 13", dt.datetime(2025, 8, 13, tzinfo=UTC)), ("Mar 1", dt.datetime(2026, 3, 1, tzinfo=UTC)), ("13 Aug 2026", None), ("Marketing 12", dt.datetime(2025, 3, 12, tzinfo=UTC)),
    ("Feb 29", None), ("5일 전", dt.datetime(2026, 2, 24, tzinfo=UTC)), ("2개월 전", NOW - dt.timedelta(days=60)), ("99999999999년 전", None), ("", None), (None, None), ("no date", None),
]


def test_lenient_dates(spark):
    assert [parse_date(t, UTC, NOW) for t, _ in DATES] == [d for _, d in DATES]
    df = spark.createDataFrame([(i, t, "Asia/Seoul" if i < 0 else None, micros(NOW)) for i, (t, _) in enumerate(DATES)], "i int, t string, tz string, now long")
    got = [r[0] for r in df.select("i", parse_date_column(F.col("t"), F.col("tz"), F.col("now")).alias("d")).orderBy("i").select("d.us").collect()]
    assert got == [micros(d) for _, d in DATES]
    assert spark.createDataFrame([("2026-01-01", "No/Zone", 0)], "t string, tz string, now long").select(parse_date_column(F.col("t"), F.col("tz"), F.col("now"))["us"]).first()[0] is None


def test_settings_refuse_values_out_of_range(spark):
    with pytest.raises(ValueError):
        Settings(top_k=0)
    with pytest.raises(ValueError):
        Settings(score_threshold=11)
    assert [r.seq for r in with_seq(spark.createDataFrame([("b",), ("a",)], "x string"), "x").orderBy("x").collect()] == [0, 1]
    assert isinstance(Window(NOW, NOW), Window)
