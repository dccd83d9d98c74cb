"""Record operators on literal rows, and the properties that hold for any rows."""

import datetime as dt
import json
import random
import zlib

import pandas as pd
import pytest
from pyspark.sql import functions as F

from kiteloom.operators import records, site_state
from kiteloom.schema import ARTICLE

T0 = dt.datetime(2024, 1, 1, 12, tzinfo=dt.timezone.utc)


def article(seq, url="u", minutes=0, site="s", title="t", author=None, subtitle=None, score=None, summary=(), interests=(), reason=None, offset=0):
    return (site, title, url, T0 + dt.timedelta(minutes=minutes), author, subtitle, score, list(interests), reason, list(summary), None, seq, offset)


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), ARTICLE)


def test_richest_copy_wins_and_the_first_among_equals(spark):
    df = frame(spark, article(1), article(2, author="a"), article(3, author="b"), article(4, score=0), article(5, url="v", summary=["x"]), article(6, url="v", subtitle="", author="", score=3))
    got = {r.url: (r.seq, r.url_seq) for r in records.dedupe(df).collect()}
    assert got == {"u": (4, 1), "v": (5, 5)}
    again = records.dedupe(records.dedupe(df).drop("url_seq"))
    assert {r.url: r.seq for r in again.collect()} == {"u": 4, "v": 5}
    assert records.dedupe(frame(spark)).count() == 0


def test_twins_chain_by_the_gap_and_keep_the_language(spark):
    s = lambda n, sec: (*article(n, author="a", url=str(n))[:3], T0 + dt.timedelta(seconds=sec), *article(n, author="a")[4:])
    rows = [s(1, 0), s(2, 900), s(3, 1800), s(4, 2701), article(5, minutes=0), article(6, minutes=1, author="")]
    got = sorted(r.seq for r in records.collapse_twins(frame(spark, *rows), "en").collect())
    assert got == [1, 4, 5, 6]  # 15:00 joins, 15:01 does not; rows without author pass through
    bilingual = frame(spark, article(1, author="a", title="Hello"), article(2, author="a", title="안녕", minutes=1))
    assert [r.seq for r in records.collapse_twins(bilingual, "ko").collect()] == [2]
    assert [r.seq for r in records.collapse_twins(bilingual, "en").collect()] == [1]
    sessions = records.session_clusters(frame(spark, *rows)).collect()
    assert sorted(r.n for r in sessions) == [1, 3]


def test_collapse_is_idempotent(spark):
    rng = random.Random(4)
    rows = [article(i, url=str(i), minutes=rng.randint(0, 600), author=rng.choice(["a", "b", None])) for i in range(120)]
    once = records.collapse_twins(frame(spark, *rows), "en").cache()
    assert sorted(r.seq for r in records.collapse_twins(once, "en").collect()) == sorted(r.seq for r in once.collect())


def test_order_top_and_rest(spark):
    df = frame(spark, article(1, url="a", score=7), article(2, url="b", score=7), article(3, url="c", score=None), article(4, url="d", score=9, minutes=-5), article(5, url="e", score=4))
    top = records.select_top(df, 3, 5)
    assert [r.seq for r in top.collect()] == [4, 1, 2]
    assert sorted(r.seq for r in records.rest_links(df, top).collect()) == [3, 5]
    assert records.select_top(df, 3, 10).count() == 0
    assert sorted(r.seq for r in records.select_top(df, 1, 0, ["site"]).collect()) == [4]


def test_upsert_keeps_the_stored_copy_among_equals(spark):
    stored, fresh = frame(spark, article(9, score=1), article(8, url="w")), frame(spark, article(1, score=5), article(2, url="w", author="x"))
    assert {r.url: r.seq for r in records.upsert(stored, fresh).collect()} == {"u": 9, "w": 2}


def test_scores_last_answer_wins_and_misplaced_ones_are_lost(spark):
    df = frame(spark, *[article(i, url=str(i)) for i in range(3)])
    scores = spark.createDataFrame([(0, 0, 0, 3, ["a", "b", "a"], "ok"), (0, 0, 1, 8, ["b", "zz"], " "), (0, -1, 0, 9, [], "x"), (0, 25, 0, 9, [], "x"), (1, 0, 0, 9, [], "x")],
                                   "batch_id long, idx int, ord int, score int, interests array<string>, reason string")
    got = {r.seq: (r.score, r.interests, r.reason) for r in records.apply_scores(df, scores, ["a", "b"]).collect()}
    assert got == {0: (8, ["b"], None), 1: (None, [], None), 2: (None, [], None)}


def test_summaries_only_for_the_top(spark):
    df = frame(spark, article(1, url="a", score=9), article(2, url="b", score=1))
    summaries = spark.createDataFrame([("a", [" x ", "", "y"]), ("b", ["z"])], "url string, summary array<string>")
    got = {r.url: r.summary for r in records.apply_summaries(df, records.select_top(df, 5, 5), summaries).collect()}
    assert got == {"a": ["x", "y"], "b": []}


def test_records_drop_empties_but_keep_zero(spark):
    line = frame(spark, article(1, score=0, author="", subtitle="s", offset=32400)).select(records.to_record()).first()[0]
    assert json.loads(line) == {"published_at": "2024-01-01T21:00:00+09:00", "site": "s", "title": "t", "url": "u", "subtitle": "s", "score": 0}


def test_errors_are_data(spark):
    outcomes = spark.createDataFrame(
        [("a", 0, "HTTPError: HTTP Error 404: gone", None, 0), ("a", 1, "HTTPError: HTTP Error 404: gone", None, 0), ("a", 2, "ValueError: none", None, 0), ("b", 0, "URLError: x", None, 0), ("b", 1, None, 5, 1)],
        "site string, ord int, error string, newest_seen long, n_articles long")
    got = {r.site: r.error for r in records.error_rollup(outcomes).collect()}
    assert got == {"a": "HTTPError: HTTP Error 404: gone; ValueError: none", "b": None}
    texts = spark.createDataFrame([("HTTPError: HTTP Error 404: gone",), ("ValueError: x",), ("URLError: y",), (None,)], "e string")
    assert [r[0] for r in texts.select(records.failure_reason(F.col("e"))).collect()] == ["HTTP 404", "no articles matched", "URLError", None]


TODAY = dt.date(2024, 6, 30)


@pytest.fixture(scope="module")
def sites(spark):
    return spark.createDataFrame([(n, n != "off", "feed") for n in ("off", "new", "failing", "old", "edge", "fresh")], "name string, enabled boolean, fetcher string")


@pytest.fixture(scope="module")
def states(spark):
    day = lambda d: TODAY - dt.timedelta(days=d)
    return spark.createDataFrame([("off", day(1), 0), ("failing", day(1), 5), ("old", day(181), 4), ("edge", day(180), 0), ("fresh", day(179), 4)], "site string, last_post date, empty_runs int")


def test_status_activity_and_listing(spark, sites, states):
    got = {r.name: r.status for r in site_state.describe(sites, states, TODAY).collect()}
    assert got == {"off": "disabled", "new": "unknown", "failing": "failing", "old": "dormant", "edge": "dormant", "fresh": "active"}
    active = {r.name for r in site_state.with_state(sites, states).filter(site_state.is_active(TODAY)).collect()}
    assert active == {"new", "fresh"}
    listed = site_state.listing(site_state.describe(sites, states, TODAY))
    assert [r.name for r in listed.collect()] == ["fresh", "new", "edge", "old", "failing", "off"]
    assert {r.name for r in site_state.sites_to_collect(sites, states, TODAY, every=1).collect()} == {"new", "failing", "old", "edge", "fresh"}
    assert {r.name for r in site_state.sites_to_collect(sites, states, TODAY, every=1, only=["old", "off"]).collect()} == {"old"}


def test_rota_is_stable_and_hits_each_site_once_a_cycle(spark):
    names = ["alpha", "한글 블로그", "x" * 300]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    for step in range(7):
        day = TODAY + dt.timedelta(days=step)
        got = [r[0] for r in df.select(site_state.rota_slot(F.col("name"), day, 7)).collect()]
        assert got == [(day.toordinal() + zlib.crc32(n.encode())) % 7 for n in names]


def brute_fold(runs):
    state = {}
    for run, site, seen in sorted(runs, key=lambda r: r[0]):
        last, empty = state.get(site, (None, 0))
        state[site] = (last, empty + 1) if seen is None else (max(last or seen, seen), 0)
    return state


def test_folds_agree_with_a_loop(spark):
    rng = random.Random(8)
    runs = [(run, site, None if rng.random() < 0.5 else TODAY - dt.timedelta(days=rng.randint(0, 50))) for run in range(30) for site in "abc"]
    df = spark.createDataFrame(runs, "run_id long, site string, newest_seen_local_date date")
    want = brute_fold(runs)
    assert {r.site: (r.last_post, r.empty_runs) for r in site_state.latest_state(df).collect()} == want
    last = site_state.fold_history(df).filter("run_id = 29").collect()
    assert {r.site: (r.last_post, r.empty_runs) for r in last} == want
    state = spark.createDataFrame([], "site string, last_post date, empty_runs int")
    for run in (0, 1):
        one = df.filter(F.col("run_id") == run)
        state = site_state.fold_run(state, one)
    assert {r.site: (r.last_post, r.empty_runs) for r in state.collect()} == brute_fold([r for r in runs if r[0] < 2])


def test_scoring_survives_failures_and_an_exhausted_quota(spark):
    rows = frame(spark, *[article(i, url=str(i), score=3 if i == 4 else None) for i in range(10)])

    def scorer(batch):
        if (batch["seq"] == 3).any():
            raise RuntimeError("broken answer")
        return pd.DataFrame({"idx": batch["idx"], "score": 7, "interests": [["data"]] * len(batch), "reason": "fits"})

    def exhausted(batch):
        if batch["seq"].min() >= 6:
            raise records.QuotaExhausted
        return scorer(batch)

    for run, want in ((scorer, [7, 7, 7, 0, 3, 0, 7, 7, 7, 7]), (exhausted, [7, 7, 7, 0, 3, 0, None, None, None, None])):
        scored = records.apply_scores(rows, records.score_batches(rows, run, 3), ["data"], 3)
        assert [r.score for r in scored.orderBy("seq").collect()] == want
    assert records.score_batches(rows.limit(0), scorer).count() == 0


def test_summaries_fall_back_to_the_page(spark):
    top = frame(spark, article(1, "a"), article(2, "b"), article(3, "c")).withColumn("body", F.when(F.col("url") == "a", "own").otherwise(""))
    pages = spark.createDataFrame([("a", "page a"), ("b", "page b"), ("c", "")], "url string, main_text string")
    assert sorted((r.url, r.body) for r in records.summary_inputs(top, pages).collect()) == [("a", "own"), ("b", "page b")]


def test_dense_numbers_follow_the_order_without_one_task_for_all(spark):
    from kiteloom.schema import with_seq

    rows = spark.range(500).select((F.col("id") * 7919 % 500).alias("x"), F.lit("r").alias("r")).repartition(6)
    assert [(r.x, r.seq) for r in with_seq(rows, "x").orderBy("seq").collect()] == [(i, i) for i in range(500)]
