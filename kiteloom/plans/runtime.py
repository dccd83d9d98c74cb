"""Session-level helpers: table loading, size-checked broadcast and lineage cuts."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows above which a lookup side is joined by shuffle instead of being broadcast.
BROADCAST_ROWS = 50_000


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def small_side(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """`df` marked for broadcast if it has at most `max_rows` rows, else unchanged.

    The check reads at most `max_rows + 1` rows, so it costs little on a large side.
    """
    n = df.limit(max_rows + 1).count()
    return F.broadcast(df) if n <= max_rows else df


def spread(df: DataFrame) -> DataFrame:
    """`df` over all cores where its scan has fewer partitions than there are cores, else unchanged.

    For parsers and models, whose work outweighs moving a few files. A table of many files keeps its partitions.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster; only where it is unset (tests), a folder of our own."""
    sc = spark.sparkContext
    conf = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    current = sc.getCheckpointDir()
    if current is None:
        if not conf:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            conf = tempfile.mkdtemp(prefix="kiteloom-ckpt-")
        sc.setCheckpointDir(conf)
        current = sc.getCheckpointDir()
    return current


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise `df` in the checkpoint folder, so later stages survive lost executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
