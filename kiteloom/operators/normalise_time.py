"""Problem 3: one unambiguous instant per record, whatever its shape, precision or zone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kiteloom.functions.civil import ntz_micros
from kiteloom.functions.instants import attach_zones, local_to_utc, with_instant
from kiteloom.plans.runtime import spread


def raw_instants(df: DataFrame, sites: DataFrame, key: str, raw: str = "published_raw", fetched: str = "fetched_at") -> DataFrame:
    """(rec_id, utc_us) of every row of `df` whose text `raw` fixes an instant.

    The text is read in the zone it names, else in the site's. Blank, null, impossible and incomplete
    values give no row; a yearless or relative value without a fetch time gives none either. Repeated
    rows give repeated results. Columns of `df` other than the four named ones are not read.
    """
    slim = df.select(
        F.col(key).cast("long").alias("rec_id"),
        F.col("site").alias("site"),
        F.col(raw).alias("raw"),
        ntz_micros(F.col(fetched)).alias("fetched_us"),
    ).filter(F.col("raw").isNotNull())
    zoned = with_instant(attach_zones(spread(slim), sites), "raw", "fetched_us")
    return zoned.select("rec_id", "utc_us").filter(F.col("utc_us").isNotNull())


def wall_clock_instants(df: DataFrame, sites: DataFrame, key: str, ts: str = "published_at", offset: str = "published_offset_s") -> DataFrame:
    """(rec_id, utc_us) of wall clocks with an offset in seconds; a null offset means the site's zone."""
    slim = df.select(
        F.col(key).cast("long").alias("rec_id"),
        F.col("site").alias("site"),
        ntz_micros(F.col(ts)).alias("local_us"),
        F.col(offset).cast("long").alias("offset_s"),
    ).filter(F.col("local_us").isNotNull())
    zoned = attach_zones(slim, sites)
    utc = F.when(
        F.col("offset_s").isNotNull(), F.col("local_us") - F.col("offset_s") * 1_000_000
    ).otherwise(local_to_utc(F.col("local_us"), F.col("zone_fixed_us"), F.col("zone_id")))
    return zoned.select("rec_id", utc.alias("utc_us")).filter(F.col("utc_us").isNotNull())


def normalised_times(feed_items: DataFrame, page_meta: DataFrame, articles: DataFrame, sites: DataFrame) -> DataFrame:
    """(tab, rec_id, utc_us) over the three tables; one pass over each, no shuffle of their rows."""
    parts = [
        raw_instants(feed_items, sites, "item_id").withColumn("tab", F.lit("feed_items")),
        raw_instants(page_meta, sites, "page_id").withColumn("tab", F.lit("page_meta")),
        wall_clock_instants(articles, sites, "seq").withColumn("tab", F.lit("articles")),
    ]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out.select("tab", "rec_id", "utc_us")
