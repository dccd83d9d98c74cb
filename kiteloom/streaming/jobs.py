"""Structured Streaming forms of the stateful operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from kiteloom.functions.windows import window_day
from kiteloom.operators.records import TWIN_GAP_MINUTES, filled

STATE_OUT = "site string, run_id long, last_post date, empty_runs int"
STATE_KEPT = "run_id long, last_post string, empty_runs int"


def _fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Folds the runs of one site in order; runs not newer than the last one folded are ignored."""
    run_id, last_post, empty = state.get if state.exists else (-1, None, 0)
    rows = pd.concat(list(batches), ignore_index=True).sort_values("run_id")
    folded = False
    for run, seen in zip(rows["run_id"], rows["newest_seen_local_date"]):
        if int(run) <= run_id:
            continue
        run_id, folded = int(run), True
        if seen is None or pd.isna(seen):
            empty += 1
        else:
            day = pd.Timestamp(seen).strftime("%Y-%m-%d")
            last_post, empty = max(last_post or day, day), 0
    state.update((run_id, last_post, empty))
    if folded:
        yield pd.DataFrame({"site": [key[0]], "run_id": [run_id], "last_post": [None if last_post is None else pd.Timestamp(last_post).date()], "empty_runs": [empty]})


def site_state_stream(runs: DataFrame) -> DataFrame:
    """State of each site after every micro-batch of runs(site, run_id, newest_seen_local_date)."""
    return runs.groupBy("site").applyInPandasWithState(_fold, STATE_OUT, STATE_KEPT, "update", GroupStateTimeout.NoTimeout)


def distinct_stream(articles: DataFrame, horizon: str = "30 days") -> DataFrame:
    """First copy of each url within the horizon; later copies in time are dropped, state older than the horizon too.

    The richest copy cannot be known before the horizon has passed: a batch `dedupe` of the stored days picks it.
    """
    return articles.withWatermark("published_at", horizon).dropDuplicatesWithinWatermark(["url"])


def twin_sessions_stream(articles: DataFrame, lateness: str = "1 day", gap_minutes: int = TWIN_GAP_MINUTES) -> DataFrame:
    """(site, author, n, first_at, last_at) of finished sessions of near-simultaneous posts."""
    window = F.session_window("published_at", f"{gap_minutes * 60 * 1_000_000 + 1} microseconds")
    return articles.filter(filled("author")).withWatermark("published_at", lateness).groupBy("site", "author", window.alias("w")).agg(
        F.count("*").alias("n"), F.min("published_at").alias("first_at"), F.max("published_at").alias("last_at")
    ).drop("w")


def daily_counts_stream(articles: DataFrame, lateness: str = "1 day", start: str = "3 hours") -> DataFrame:
    """(day, site, n) of closed daily windows only; late rows are dropped and left to a batch backfill."""
    window = F.window("published_at", "1 day", "1 day", start)
    counts = articles.withWatermark("published_at", lateness).groupBy(window.alias("w"), "site").agg(F.count("*").alias("n"))
    return counts.select(window_day(F.col("w.start")).alias("day"), "site", "n")
