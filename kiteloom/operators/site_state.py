"""State of the sites: activity, status, the recheck rota and the fold over runs."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

EMPTY_RUNS_LIMIT = 5
#: Order in which statuses are listed.
STATUS_ORDER = {"active": 0, "unknown": 1, "dormant": 2, "failing": 3, "disabled": 4}


def _fresh(today: dt.date, days: int) -> Column:
    return F.col("last_post") > F.lit(today - dt.timedelta(days=days))


def is_active(today: dt.date, inactive_after_days: int = 180) -> Column:
    """Over sites left-joined to their state: enabled, not failing, and not silent for too long."""
    return (
        F.when(~F.col("enabled"), False)
        .when(F.coalesce(F.col("empty_runs"), F.lit(0)) >= EMPTY_RUNS_LIMIT, False)
        .when(F.col("last_post").isNull(), True)
        .otherwise(_fresh(today, inactive_after_days))
    )


def status(today: dt.date, inactive_after_days: int = 180) -> Column:
    return (
        F.when(~F.col("enabled"), "disabled")
        .when(F.coalesce(F.col("empty_runs"), F.lit(0)) >= EMPTY_RUNS_LIMIT, "failing")
        .when(F.col("last_post").isNull(), "unknown")
        .when(_fresh(today, inactive_after_days), "active")
        .otherwise("dormant")
    )


def rota_slot(name: Column, today: dt.date, every: int) -> Column:
    """0 on the days on which an inactive site is rechecked; stable across runs and machines."""
    return (F.lit(today.toordinal()) + F.crc32(F.encode(name, "UTF-8"))) % F.lit(max(1, every))


def with_state(sites: DataFrame, states: DataFrame) -> DataFrame:
    """Sites with the columns of their state; null where there is none yet."""
    own = states.select(F.col("site").alias("name"), "last_post", "empty_runs")
    return sites.join(own, "name", "left")


def sites_to_collect(sites: DataFrame, states: DataFrame, today: dt.date, inactive_after_days: int = 180, every: int = 7, only: list[str] | None = None) -> DataFrame:
    """Enabled sites that are active or due; `only` narrows the result afterwards."""
    joined = with_state(sites, states)
    due = is_active(today, inactive_after_days) | (rota_slot(F.col("name"), today, every) == 0)
    chosen = joined.filter(F.col("enabled") & due).select(*sites.columns)
    return chosen.filter(F.col("name").isin(only)) if only else chosen


def describe(sites: DataFrame, states: DataFrame, today: dt.date, inactive_after_days: int = 180) -> DataFrame:
    return with_state(sites, states).withColumn("status", status(today, inactive_after_days))


def listing(described: DataFrame, statuses: list[str] | None = None, fetcher: str | None = None) -> DataFrame:
    """Sites in order of status and name, optionally of some statuses or one fetcher."""
    rank = F.create_map(*[F.lit(x) for pair in STATUS_ORDER.items() for x in pair])
    out = described.filter(F.col("status").isin(statuses)) if statuses else described
    out = out.filter(F.col("fetcher") == fetcher) if fetcher else out
    return out.orderBy(F.element_at(rank, F.col("status")), "name")


def status_counts(described: DataFrame) -> DataFrame:
    return described.groupBy("status").agg(F.count("*").alias("n"))


def fold_run(states: DataFrame, results: DataFrame) -> DataFrame:
    """State after one run: a run without a date counts as empty, a date resets the count and never moves back."""
    seen = results.groupBy("site").agg(F.max("newest_seen_local_date").alias("seen"))
    both = states.join(seen.withColumn("ran", F.lit(True)), "site", "full")
    return both.select(
        "site",
        F.greatest("last_post", "seen").alias("last_post"),
        F.when(F.col("ran").isNull(), F.coalesce("empty_runs", F.lit(0)))
        .when(F.col("seen").isNull(), F.coalesce("empty_runs", F.lit(0)) + 1)
        .otherwise(0).cast("int").alias("empty_runs"),
    )


def fold_history(runs: DataFrame) -> DataFrame:
    """(site, run_id, last_post, empty_runs): the state after each run, from the history of runs.

    Gaps and islands: a run with a date opens an island, and the empty runs of an island are counted.
    """
    history = W.partitionBy("site").orderBy("run_id").rowsBetween(W.unboundedPreceding, 0)
    marked = runs.withColumn("island", F.count("newest_seen_local_date").over(history)).withColumn(
        "last_post", F.max("newest_seen_local_date").over(history)
    )
    within = W.partitionBy("site", "island").orderBy("run_id").rowsBetween(W.unboundedPreceding, 0)
    empty = F.sum(F.col("newest_seen_local_date").isNull().cast("int")).over(within)
    return marked.select("site", "run_id", "last_post", empty.cast("int").alias("empty_runs"))


def latest_state(runs: DataFrame) -> DataFrame:
    """State after the last run of each site, by aggregation only: no order within a site is needed."""
    last_seen = F.max(F.when(F.col("newest_seen_local_date").isNotNull(), F.col("run_id")))
    marks = runs.groupBy("site").agg(F.max("newest_seen_local_date").alias("last_post"), last_seen.alias("seen_run"))
    after = runs.join(marks.select("site", "seen_run"), "site").filter(F.col("seen_run").isNull() | (F.col("run_id") > F.col("seen_run")))
    counts = after.groupBy("site").agg(F.count("*").cast("int").alias("empty_runs"))
    return marks.join(counts, "site", "left").select("site", "last_post", F.coalesce("empty_runs", F.lit(0)).alias("empty_runs"))
