"""Bounded parts of texts: slices of a batch, so that working memory follows a bound, samples for fitting, and sums of arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters that one slice holds at most; a longer text is a slice of its own.
SLICE_CHARS = 2_000_000


def slices(texts: list[str], limit: int | None = None) -> Iterator[slice]:
    limit = limit or SLICE_CHARS
    begin, size = 0, 0
    for i, text in enumerate(texts):
        if i > begin and size + len(text) > limit:
            yield slice(begin, i)
            begin, size = i, 0
        size += len(text)
    if begin < len(texts):
        yield slice(begin, len(texts))


def sampled_texts(df: DataFrame, name: str, n: int, wanted: Column) -> list[str]:
    """At most `n` texts of a column for fitting, in the order of a hash of their content.

    The hash makes the sample independent of files and partitions; equal texts stand side by side, so copies do not
    crowd others out of the order but count as often as they occur.
    """
    drawn = df.select(F.col(name).alias("t")).filter(wanted).select("t", F.xxhash64("t").alias("h"))
    return [r[0] for r in drawn.orderBy("h").limit(n).collect()]


#: Blocks that a summed array is cut into, and the rows of one.
BLOCKS, SUMMANDS = 8, "block int, data binary"


def summands(array: np.ndarray) -> pd.DataFrame:
    """SUMMANDS of a flat array of float64."""
    return pd.DataFrame({"block": np.arange(BLOCKS, dtype=np.int32), "data": [part.tobytes() for part in np.array_split(array, BLOCKS)]})


def _added(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, data in zip(batch["block"], batch["data"]):
            part = np.frombuffer(data, np.float64)
            sums[block] = sums[block] + part if block in sums else part
    if sums:
        yield pd.DataFrame({"block": np.array(list(sums), dtype=np.int32), "data": [s.tobytes() for s in sums.values()]})


def summed(rows: DataFrame, size: int) -> np.ndarray:
    """The sum of the arrays in `rows` (SUMMANDS), added up in the executors: the driver gets one array."""
    parts = dict(map(tuple, rows.repartition(BLOCKS, "block").mapInPandas(_added, SUMMANDS).collect()))
    return np.concatenate([np.frombuffer(parts[b], np.float64) for b in range(BLOCKS)]) if parts else np.zeros(size)
