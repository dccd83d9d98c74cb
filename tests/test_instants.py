"""Problem 3 against an independent reading with the standard library."""

import datetime as dt
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from kiteloom.operators.normalise_time import normalised_times, raw_instants

UTC = dt.timezone.utc
FETCHED = dt.datetime(2024, 3, 5, 12, 0)
SITES = [("seoul", " Asia/Seoul "), ("utc", None), ("blank", "  "), ("plus", "UTC+9"), ("minus", "-08:00"), ("york", "america/new_york"), ("none", "Local"), ("etc", "Etc/GMT-9"), ("kst", "KST"), ("rio", "GMT-3")]


def us(*parts, tz=UTC):
    return int((dt.datetime(*parts, tzinfo=tz).astimezone(UTC) - dt.datetime(1970, 1, 1, tzinfo=UTC)) / dt.timedelta(microseconds=1))


CASES = [
    ("seoul", "2024-01-02T03:04:05", us(2024, 1, 1, 18, 4, 5)),
    ("seoul", "2024-01-02T03:04:05Z", us(2024, 1, 2, 3, 4, 5)),
    ("seoul", "2024-01-02T03:04:05.5+05:30", us(2024, 1, 1, 21, 34, 5, 500000)),
    ("seoul", "20240102T030405Z", us(2024, 1, 2, 3, 4, 5)),
    ("utc", "Tue, 02 Jan 2024 03:04:05 KST", us(2024, 1, 1, 18, 4, 5)),
    ("utc", "Tue, 02 Jan 2024 03:04:05 CST", us(2024, 1, 2, 9, 4, 5)),
    ("utc", "2 Jan 24 03:04 -0500", us(2024, 1, 2, 8, 4)),
    ("blank", "January 19th, 2024 at 5:28 PM", us(2024, 1, 19, 17, 28)),
    ("blank", "Published on January 19th, 2024", us(2024, 1, 19)),
    ("plus", "2024.01.05", us(2024, 1, 4, 15)),
    ("minus", "2024년 2월 29일 오후 1:32", us(2024, 2, 29, 21, 32)),
    ("etc", "26.11.2023, 23:18 Uhr", us(2023, 11, 26, 14, 18)),
    ("rio", "09/27/2023 12:26 AM", us(2023, 9, 27, 3, 26)),
    ("utc", "1700000000", 1700000000 * 10**6),
    ("utc", "1700000000123", 1700000000123 * 1000),
    ("utc", "Mar 6", us(2024, 3, 6)),
    ("utc", "Mar 7", us(2023, 3, 7)),
    ("utc", "29 February", us(2024, 2, 29)),
    ("utc", "3 weeks ago", us(2024, 2, 13, 12)),
    ("utc", "vor 2 Tagen", us(2024, 3, 3, 12)),
    ("utc", "hace 1 hora", us(2024, 3, 5, 11)),
    ("utc", "45분 전", us(2024, 3, 5, 11, 15)),
    # a repeated hour is the earlier one, a skipped one keeps the offset before the change
    ("york", "2023-11-05T01:30:00", us(2023, 11, 5, 5, 30)),
    ("york", "2024-03-10T02:30:00", us(2024, 3, 10, 7, 30)),
    ("kst", "\t2024-01-02 \n", us(2024, 1, 1, 15)),
    # no case
    ("none", "2024-01-02T03:04:05", None),
    ("none", "2024-01-02T03:04:05Z", us(2024, 1, 2, 3, 4, 5)),
    *[("utc", t, None) for t in ("", "  ", None, "n/a", "2024-13-05T10:00:00Z", "Feb 30, 2024", "31 Sep 2023", "Marketing 12", "Spring 2024", "0000-00-00", "2024", "{{ post.date }}", "13:00 PM 2024-01-01", "x" * 100_000)],
]


def frame(spark, cases):
    rows = [(i, site, raw, FETCHED, "clash", 1) for i, (site, raw, _) in enumerate(cases)]
    return spark.createDataFrame(rows, "item_id long, site string, published_raw string, fetched_at timestamp_ntz, zone_id string, utc_us int")


@pytest.fixture(scope="module")
def sites(spark):
    return spark.createDataFrame(SITES + [("seoul", "zz ignored, the first in text order wins")], "name string, tz string")


def test_shapes_zones_and_clock_changes(spark, sites):
    got = {r.rec_id: r.utc_us for r in raw_instants(frame(spark, CASES), sites, "item_id").collect()}
    assert got == {i: want for i, (_, _, want) in enumerate(CASES) if want is not None}


def test_session_zone_plays_no_part(spark, sites):
    want = sorted(map(tuple, raw_instants(frame(spark, CASES), sites, "item_id").collect()))
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert sorted(map(tuple, raw_instants(frame(spark, CASES), sites, "item_id").collect())) == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_naive_values_agree_with_zoneinfo_through_a_year(spark, sites):
    hours = [dt.datetime(2023, 1, 1) + dt.timedelta(hours=7 * k, minutes=30) for k in range(1250)]
    cases = [("york", h.strftime("%Y-%m-%d %H:%M:%S"), us(*h.timetuple()[:6], tz=ZoneInfo("America/New_York"))) for h in hours]
    got = {r.rec_id: r.utc_us for r in raw_instants(frame(spark, cases), sites, "item_id").collect()}
    assert got == {i: want for i, (_, _, want) in enumerate(cases)}


def test_wall_clocks_nulls_repeats_and_empty_tables(spark, sites):
    articles = spark.createDataFrame(
        [(1, "seoul", dt.datetime(2024, 1, 1, 9), 3600), (2, "seoul", dt.datetime(2024, 1, 1, 9), None), (3, "none", dt.datetime(2024, 1, 1, 9), None), (4, None, None, 0),
         (1, "seoul", dt.datetime(2024, 1, 1, 9), 3600), (5, "unknown", dt.datetime(2024, 1, 1, 9), None)],
        "seq long, site string, published_at timestamp_ntz, published_offset_s int",
    )
    empty = frame(spark, CASES).limit(0)
    pages = empty.withColumnRenamed("item_id", "page_id")
    got = sorted((r.tab, r.rec_id, r.utc_us) for r in normalised_times(empty, pages, articles, sites).collect())
    eight = us(2024, 1, 1, 8)
    assert got == [("articles", 1, eight), ("articles", 1, eight), ("articles", 2, us(2024, 1, 1)), ("articles", 5, us(2024, 1, 1, 9))]
    assert normalised_times(empty, pages, articles.limit(0), sites.limit(0)).count() == 0


def test_rows_are_not_shuffled_and_columns_pruned(spark, sites):
    plan = raw_instants(frame(spark, CASES), sites, "item_id")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan
    assert raw_instants(frame(spark, CASES).withColumn("extra", F.lit(1)), sites, "item_id").columns == ["rec_id", "utc_us"]
