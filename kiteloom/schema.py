"""Record types of the engine and its settings."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

ARTICLE = T.StructType([
    T.StructField("site", T.StringType(), False),
    T.StructField("title", T.StringType(), False),
    T.StructField("url", T.StringType(), False),
    T.StructField("published_at", T.TimestampType(), False),
    T.StructField("author", T.StringType()),
    T.StructField("subtitle", T.StringType()),
    T.StructField("score", T.IntegerType()),
    T.StructField("interests", T.ArrayType(T.StringType())),
    T.StructField("reason", T.StringType()),
    T.StructField("summary", T.ArrayType(T.StringType())),
    T.StructField("body", T.StringType()),
    T.StructField("seq", T.LongType()),
    T.StructField("published_offset_s", T.IntegerType()),
])
SITE = T.StructType([T.StructField(n, T.StringType()) for n in ("name", "url", "fetcher", "source_url", "tz", "params", "enabled", "note")])
RESULT = "site string, error string, newest_seen timestamp, newest_seen_local_date date, examined int"
STATE = "site string, last_post date, empty_runs int"
RAW = "site string, source_url string, kind string, fetched_at timestamp, content binary, content_type string, error string"
FETCHERS = ("feed", "embedded", "sitemap", "html_list")


@dataclass(frozen=True)
class Settings:
    """Bounds of a run; values outside their range are refused at once."""

    timezone: str = "Asia/Seoul"
    window_end_hour: int = 12
    window_hours: int = 24
    inactive_after_days: int = 180
    recheck_every_days: int = 7
    top_k: int = 5
    score_threshold: int = 5
    batch_size: int = 25
    language: str = "ko"
    subject_format: str = "[digest] {date} {count} | {headline}"
    show_failures: bool = True
    max_list_pages: int = 20
    sender: str = ""
    recipients: tuple = ()
    interests: tuple = field(default_factory=tuple)

    def __post_init__(self) -> None:
        ranges = {"window_end_hour": (0, 23), "window_hours": (1, None), "top_k": (1, None), "score_threshold": (0, 10), "batch_size": (1, None), "max_list_pages": (1, None)}
        for name, (low, high) in ranges.items():
            value = getattr(self, name)
            if value < low or (high is not None and value > high):
                raise ValueError(f"{name} must lie in {low}..{high if high is not None else ''}: {value}")


#: Where a settings file gives each value: section and name.
SETTING_KEYS = {
    "timezone": ("collection", "timezone"), "window_end_hour": ("collection", "window_end_hour"), "window_hours": ("collection", "window_hours"),
    "max_list_pages": ("collection", "max_list_pages"), "inactive_after_days": ("collection", "inactive_after_days"),
    "recheck_every_days": ("collection", "recheck_inactive_every_days"), "top_k": ("ranking", "top_k"), "score_threshold": ("ranking", "score_threshold"),
    "batch_size": ("ranking", "batch_size"), "subject_format": ("email", "subject_format"), "show_failures": ("email", "show_failures"),
    "sender": ("email", "sender_address"), "recipients": ("email", "recipients"), "language": ("output", "language"),
}


def load_settings(text: str, environment: Mapping[str, str] | None = None, interests: tuple = ()) -> Settings:
    """Settings from a YAML (or JSON) text; what it leaves out keeps its default.

    MAIL_SENDER and MAIL_RECIPIENTS (a comma list) of the environment go before the file where they are not blank.
    """
    import yaml

    sections = yaml.safe_load(text) or {}
    values = {}
    for name, (section, key) in SETTING_KEYS.items():
        own = sections.get(section) or {}
        if own.get(key) is not None:
            values[name] = tuple(own[key]) if name == "recipients" else own[key]
    env = environment or {}
    addresses = tuple(a.strip() for a in env.get("MAIL_RECIPIENTS", "").split(",") if a.strip())
    values |= {"sender": env["MAIL_SENDER"].strip()} if env.get("MAIL_SENDER", "").strip() else {}
    values |= {"recipients": addresses} if addresses else {}
    return Settings(interests=interests, **values)


def with_seq(df: DataFrame, *order: str, name: str = "seq") -> DataFrame:
    """Adds the input order that stable sorts fall back on.

    With `order` the numbers are dense and follow those columns: ranges of them are numbered apart, and each range is
    set off by the sizes of those before, so no task holds all rows. Without, they only increase within the given
    partitioning, which costs no shuffle.
    """
    if not order:
        return df.withColumn(name, F.monotonically_increasing_id())
    from kiteloom.plans.runtime import cut_lineage

    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn(
        "_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    fixed = cut_lineage(ranged)
    sizes = fixed.groupBy("_part").agg(F.count("*").alias("_n"))  # one row per partition
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    return fixed.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_at")).select(*df.columns, name)
