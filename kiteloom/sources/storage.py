"""Registry, daily article files, site state and interests: reading and writing."""

from __future__ import annotations

import datetime as dt
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from kiteloom.functions.windows import Window, window_day
from kiteloom.operators.records import dedupe, upsert
from kiteloom.plans.runtime import cut_lineage
from kiteloom.schema import ARTICLE, SITE, STATE


def normalise_sites(raw: DataFrame) -> DataFrame:
    """Registry rows with defaults: blank names dropped, fetcher 'feed', source the url, blank zones null, `enabled` boolean.

    Only '0', 'false' and blanks (but not an empty or missing value) switch a site off. Parameters stay JSON text;
    `params_ok` is false where they are neither empty nor JSON.
    """
    blank_to = lambda c, d: F.coalesce(F.nullif(F.trim(c), F.lit("")), d)
    params = F.nullif(F.trim("params"), F.lit(""))
    return raw.filter(F.trim("name") != "").select(
        F.trim("name").alias("name"), F.trim("url").alias("url"), blank_to("fetcher", F.lit("feed")).alias("fetcher"),
        blank_to("source_url", F.trim("url")).alias("source_url"), F.nullif(F.trim("tz"), F.lit("")).alias("tz"), params.alias("params"),
        (F.coalesce("enabled", F.lit("")).isin("0", "false") | ((F.coalesce("enabled", F.lit("")) != "") & (F.trim("enabled") == ""))).alias("_off"),
        F.coalesce("note", F.lit("")).alias("note"), (params.isNull() | F.try_parse_json(params).isNotNull()).alias("params_ok"),
    ).withColumn("enabled", ~F.col("_off")).drop("_off")


def load_sites(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """The registry CSV; with `strict`, broken parameters are refused with the site's name."""
    sites = normalise_sites(spark.read.schema(SITE).csv(path, header=True, multiLine=True, escape='"', encoding="UTF-8"))
    if strict:
        broken = [r[0] for r in sites.filter(~F.col("params_ok")).select("name").limit(5).collect()]
        if broken:
            raise ValueError(f"params of these sites are no JSON: {broken}")
    return sites


def save_sites(sites: DataFrame, path: str) -> None:
    rows = sites.select(*[F.col(f.name).cast("string") if f.name != "enabled" else F.when(F.col("enabled"), "1").otherwise("0").alias("enabled") for f in SITE])
    rows.coalesce(1).write.mode("overwrite").csv(path, header=True, escape='"')


def write_daily(articles: DataFrame, path: str, tz: str = "Asia/Seoul", end_hour: int = 12) -> None:
    """JSON lines partitioned by window day, newest first within a file; the body is never written.

    Rebalancing gathers small days into one file each and splits a day that is too large for one task.
    """
    named = articles.drop("body").withColumn("day", window_day(F.col("published_at"), tz, end_hour))
    named.hint("rebalance", "day").sortWithinPartitions("day", F.col("published_at").desc(), "seq").write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("day").json(path)


def read_daily(spark: SparkSession, path: str) -> DataFrame:
    """All stored articles with their `day`; a missing store is empty, a malformed line raises."""
    schema = T.StructType([*ARTICLE.fields, T.StructField("day", T.DateType())])
    try:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def merge_daily(spark: SparkSession, fresh: DataFrame, path: str, tz: str = "Asia/Seoul", end_hour: int = 12) -> None:
    """Upsert by url into the touched days only; staged through a checkpoint, since the same files are read."""
    days = [r[0] for r in fresh.select(window_day(F.col("published_at"), tz, end_hour).alias("d")).distinct().collect()]
    stored = read_daily(spark, path).filter(F.col("day").isin(days)).drop("day")
    write_daily(cut_lineage(upsert(stored, fresh.select(*stored.columns))), path, tz, end_hour)


def missing_days(existing: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """Days from start to end, both included, of which `existing` (day) has none."""
    days = existing.sparkSession.range(1).select(F.explode(F.sequence(F.lit(start), F.lit(end))).alias("day"))
    return days.join(existing.select("day").distinct(), "day", "left_anti")


def read_range(spark: SparkSession, path: str, window: Window) -> tuple[DataFrame, DataFrame]:
    """(articles, missing days): only the days of the window are read, rows outside it dropped, urls collapsed."""
    first, last = window.start.date(), window.end.date()
    stored = read_daily(spark, path).filter(F.col("day").between(F.lit(first), F.lit(last)))
    rows = dedupe(stored.filter(window.contains(F.col("published_at"))).drop("day"))
    return rows, missing_days(stored.select("day"), first, last)


def known_urls(spark: SparkSession, path: str, today: dt.date, days: int = 30) -> DataFrame:
    return read_daily(spark, path).filter(F.col("day") >= F.lit(today - dt.timedelta(days=days))).select("url").distinct()


def load_state(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(STATE).json(path)
    except AnalysisException:
        return spark.createDataFrame([], STATE)


def save_state(states: DataFrame, path: str) -> None:
    """One sorted file of state; staged through a checkpoint, since it is usually derived from the same path."""
    cut_lineage(states).coalesce(1).sortWithinPartitions("site").write.mode("overwrite").json(path)


def load_interests(spark: SparkSession, path: str) -> DataFrame:
    """(name, keywords, special_instructions) from a YAML or JSON file; a handful of rows, read on the driver."""
    text = Path(path).read_text(encoding="utf-8-sig")
    try:
        data = json.loads(text)
    except ValueError:
        import yaml

        data = yaml.safe_load(text) or {}
    rows = [(i.get("name"), list(i.get("keywords") or []), i.get("special_instructions")) for i in data.get("interests") or []]
    return spark.createDataFrame(rows, "name string, keywords array<string>, special_instructions string")
