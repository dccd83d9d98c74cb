"""Lookup joins that a hot key cannot overload."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kiteloom.plans.runtime import small_side

#: Groups above this many rows are split over salts when their members are looked up.
HOT_GROUP_ROWS = 20_000
SALTS = 32


def lookup_join(rows: DataFrame, lookup: DataFrame, keys: list[str], size: str, spread: str) -> DataFrame:
    """`rows` with the columns of `lookup`, one row of which holds each key; `lookup` is materialised.

    `size` is the lookup's column with the number of rows of a key, `spread` a column of `rows` that
    differs within a key. Only keys above HOT_GROUP_ROWS are salted: their rows are marked by a lookup of
    the hot keys, of which a table has at most a HOT_GROUP_ROWS-th of its rows.
    """
    hot = lookup.filter(F.col(size) > HOT_GROUP_ROWS).select(*keys, F.lit(True).alias("_hot"))
    if hot.isEmpty():
        return rows.join(lookup.drop(size), keys)
    salted = lookup.withColumn(
        "_salt", F.explode(F.when(F.col(size) > HOT_GROUP_ROWS, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))
    ).drop(size)
    marked = rows.join(small_side(hot), keys, "left")
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(spread), F.lit(SALTS))).otherwise(0).cast("int")
    return marked.withColumn("_salt", salt).drop("_hot").join(salted, [*keys, "_salt"]).drop("_salt")
