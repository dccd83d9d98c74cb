"""Problem 9: sources mixed to target shares of the tokens.

The documents of a source are laid end to end in pseudorandom order and packed into blocks of a fixed
number of tokens. Each output shard draws its blocks per source from a multinomial; the running number
of a draw is mapped through the source's pseudorandom permutation of block numbers, a new one for each
repetition, and blocks are joined by number. No block, and so no document, is used more often than its
source allows.
"""

from __future__ import annotations

import base64

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kiteloom.plans.runtime import cut_lineage, small_side, spread

#: Tokens of a block, blocks of an output shard, and parts of a source whose offsets are summed alone.
BLOCK_TOKENS, SHARD_BLOCKS, BUCKETS = 256, 4096, 1024
#: Shards whose draws are numbered together.
SHARDS_TOGETHER = 4096
#: Folder of the public tokenizers and the rank file that sizes are measured with.
TOKENIZER_DIR, TOKENIZER_FILE = "/opt/tokenizers", "byte_bpe_50k.tiktoken"
# Fixed value: the pattern that parts text before the merges of that file.
TOKEN_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Sources that a mix may have; their sizes and shares are handled on the driver.
MAX_SOURCES = 10_000


def encoding_of(rank_lines: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in rank_lines.splitlines() if line)}
    return tiktoken.Encoding("kiteloom", pat_str=TOKEN_PATTERN, mergeable_ranks=ranks, special_tokens={})


def _count_tokens(rank_lines: bytes):
    def run(batches):
        encoding = None
        for batch in batches:
            encoding = encoding or encoding_of(rank_lines)
            sizes = [0 if t is None else len(encoding.encode_ordinary(t)) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "channel": batch["channel"], "n_tokens": sizes})

    return run


def token_counts(documents: DataFrame, tokenizer_dir: str = TOKENIZER_DIR, tokenizer_file: str = TOKENIZER_FILE) -> DataFrame:
    """(doc_id, channel, n_tokens) of every row with a key; a null text has no tokens."""
    with open(f"{tokenizer_dir}/{tokenizer_file}", "rb") as f:
        lines = f.read()
    slim = documents.select(F.col("doc_id").cast("long"), "channel", "text").filter(F.col("doc_id").isNotNull())
    return spread(slim).mapInPandas(_count_tokens(lines), "doc_id long, channel string, n_tokens long")


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Pseudorandom permutation of 0 .. size - 1 by key: a Feistel network, walked until it falls inside."""
    index, size = np.asarray(index, np.uint64), np.asarray(size, np.uint64)
    half = np.array([max(1, (max(int(n) - 1, 1).bit_length() + 1) // 2) for n in np.unique(size)], np.uint64)
    half = half[np.searchsorted(np.unique(size), size)]
    mask = (np.uint64(1) << half) - np.uint64(1)
    key = np.asarray(key, np.int64).view(np.uint64)
    out, todo = index.copy(), np.ones(len(index), dtype=bool)
    with np.errstate(over="ignore"):
        while todo.any():
            left, right = out[todo] >> half[todo], out[todo] & mask[todo]
            for r in range(4):
                mixed = (right + key[todo] + np.uint64(r) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xD6E8FEB86659FD93)
                mixed ^= mixed >> np.uint64(32)
                mixed *= np.uint64(0xD6E8FEB86659FD93)
                left, right = right, left ^ ((mixed ^ (mixed >> np.uint64(29))) & mask[todo])
            out[todo] = (left << half[todo]) | right
            todo[todo] = out[todo] >= size[todo]
    return out.astype(np.int64)


def _permute(index: pd.Series, size: pd.Series, key: pd.Series) -> pd.Series:
    return pd.Series(permuted(index.to_numpy(), size.to_numpy(), key.to_numpy()) if len(index) else [], dtype="int64")


DRAWN = "shard long, source int, n long, offset long, size long"


def shard_draws(p: np.ndarray, total: int, seed: int, attempt: int):
    """DRAWN of shards: each draws its blocks per source from a multinomial, by a seed of its own."""

    def run(batches):
        for batch in batches:
            parts = []
            for shard in batch["id"]:
                size = min(SHARD_BLOCKS, total - int(shard) * SHARD_BLOCKS)
                n = np.random.default_rng([seed, attempt, int(shard)]).multinomial(size, p)
                own = np.flatnonzero(n)
                parts.append(pd.DataFrame({"shard": shard, "source": own, "n": n[own], "offset": (np.cumsum(n) - n)[own], "size": size}))
            if parts:
                yield pd.concat(parts)

    return run


def drawn_shards(spark, shares: list[float], caps: list[int], seed: int) -> DataFrame:
    """DRAWN of as many blocks as the scarcest source allows; shards draw next to each other in the executors.

    The driver sees the sums by source only. A source that is drawn more often than its cap makes all draw again, a
    little less.
    """
    p = np.array(shares, dtype=float)
    p = p / p.sum() if len(p) and p.sum() > 0 else p
    usable = [c / s for c, s in zip(caps, p) if s > 0]
    total, attempt = int(min(usable)) if usable else 0, 0
    while total > 0:
        draws = spark.range(-(-total // SHARD_BLOCKS)).mapInPandas(shard_draws(p, total, seed, attempt), DRAWN)
        sums = np.zeros(len(p), dtype=np.int64)
        for r in draws.groupBy("source").agg(F.sum("n")).collect():  # one row per source
            sums[r[0]] = r[1]
        over = sums - np.array(caps)
        if (over <= 0).all():
            return draws
        total -= max(1, int(max(o / s for o, s in zip(over, p) if s > 0 and o > 0) * 0.5))
        attempt += 1
    return spark.createDataFrame([], DRAWN)


def numbered_draws(draws: DataFrame) -> DataFrame:
    """Adds `first`, the number of a source's blocks that earlier shards drew; summed within SHARDS_TOGETHER shards and then over those."""
    grouped = draws.withColumn("_group", F.floor(F.col("shard") / SHARDS_TOGETHER).cast("long"))
    sums = grouped.groupBy("source", "_group").agg(F.sum("n").alias("_n"))
    earlier = W.partitionBy("source").orderBy("_group").rowsBetween(W.unboundedPreceding, -1)
    before = sums.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    within = W.partitionBy("source", "_group").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    inside = grouped.withColumn("_inside", F.coalesce(F.sum("n").over(within), F.lit(0)))
    return inside.join(before, ["source", "_group"]).withColumn("first", F.col("_before") + F.col("_inside")).drop("_group", "_before", "_inside")


def packed_documents(counted: DataFrame) -> DataFrame:
    """(channel, doc_id, n_tokens, start): where each document begins in its source's row of tokens.

    Offsets are summed within BUCKETS parts of a source and then over the parts, so a source that holds
    most of the rows is never sorted in one task.
    """
    once = counted.filter(F.col("n_tokens") > 0).groupBy("doc_id").agg(F.min(F.struct("channel", "n_tokens")).alias("d")).select(
        "doc_id", "d.channel", "d.n_tokens", F.xxhash64("doc_id", F.lit(1)).alias("place")
    ).withColumn("bucket", F.pmod("place", F.lit(BUCKETS)).cast("int"))
    sums = once.groupBy("channel", "bucket").agg(F.sum("n_tokens").alias("tokens"))
    before = sums.withColumn(
        "before", F.coalesce(F.sum("tokens").over(W.partitionBy("channel").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ).select("channel", "bucket", "before")
    within = W.partitionBy("channel", "bucket").orderBy("place", "doc_id").rowsBetween(W.unboundedPreceding, -1)
    placed = once.withColumn("inside", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    return placed.join(before, ["channel", "bucket"]).select("channel", "doc_id", "n_tokens", (F.col("before") + F.col("inside")).alias("start"))


def mixed_blocks(documents: DataFrame, targets: DataFrame, seed: int = 1, tokenizer_dir: str = TOKENIZER_DIR) -> DataFrame:
    """(shard, slot, channel, round, block, doc_id, first_token, n_tokens): the mix, one row per piece of a document.

    A slot of a shard holds one block; its pieces are the stretches of documents, in order of first_token
    within the source. Sources without target, with a share or repeats of zero or null are left out, and a
    source with a target but without tokens leaves an empty mix, since its share cannot be reached. The
    last block of a source may be short. Repeated document keys count once.
    """
    spark = documents.sparkSession
    wanted = targets.filter((F.col("target_share") > 0) & (F.col("max_repeats") > 0) & F.col("channel").isNotNull()).groupBy("channel").agg(
        F.max("target_share").alias("share"), F.max("max_repeats").alias("repeats")
    )
    rows = sorted(wanted.limit(MAX_SOURCES + 1).collect())
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources in the targets")
    names = small_side(wanted.select("channel"))
    counted = cut_lineage(token_counts(documents, tokenizer_dir).join(names, "channel", "left_semi"))
    packed = packed_documents(counted)
    tokens = {r[0]: r[1] for r in packed.groupBy("channel").agg(F.max(F.col("start") + F.col("n_tokens"))).collect()}  # one row per source
    blocks = [-(-tokens.get(r[0], 0) // BLOCK_TOKENS) for r in rows]
    draws = drawn_shards(spark, [r[1] for r in rows], [n * r[2] for n, r in zip(blocks, rows)], seed)
    sources = spark.createDataFrame([(i, r[0], int(n)) for i, (r, n) in enumerate(zip(rows, blocks))], "source int, channel string, n_blocks long")
    shards = numbered_draws(draws).join(F.broadcast(sources), "source").drop("source")  # at most MAX_SOURCES rows
    permute = F.pandas_udf(_permute, "bigint")
    drawn = shards.repartition("shard", "channel").select(
        "*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("i")
    ).select(
        "shard", "channel", "n_blocks",
        F.floor((F.col("first") + F.col("i")) / F.col("n_blocks")).cast("long").alias("round"),
        ((F.col("first") + F.col("i")) % F.col("n_blocks")).alias("index"),
        (F.col("offset") + F.col("i")).alias("position"), "size",
    )
    slots = drawn.select(
        "shard", "channel", "round",
        permute("position", "size", F.xxhash64(F.lit(seed), F.lit("slot"), "shard")).alias("slot"),
        permute("index", "n_blocks", F.xxhash64(F.lit(seed), "channel", "round")).alias("block"),
    )
    begin = F.col("block") * BLOCK_TOKENS
    pieces = packed.select(
        "*", F.explode(F.sequence(F.floor(F.col("start") / BLOCK_TOKENS), F.floor((F.col("start") + F.col("n_tokens") - 1) / BLOCK_TOKENS))).alias("block")
    ).select(
        "channel", F.col("block").cast("long").alias("block"), "doc_id",
        F.greatest(begin - F.col("start"), F.lit(0)).cast("long").alias("first_token"),
        (F.least(begin + BLOCK_TOKENS, F.col("start") + F.col("n_tokens")) - F.greatest(begin, F.col("start"))).cast("long").alias("n_tokens"),
    )
    # both sides grow with the corpus, so neither may be broadcast
    return slots.join(pieces.hint("merge"), ["channel", "block"]).select("shard", "slot", "channel", "round", "block", "doc_id", "first_token", "n_tokens")


def mix_shares(mix: DataFrame, targets: DataFrame) -> DataFrame:
    """(channel, target_share, actual_share, n_tokens, n_docs, most_repeats): what the mix reached."""
    per_doc = mix.groupBy("channel", "doc_id").agg(F.sum("n_tokens").alias("tokens"), F.countDistinct("round").alias("rounds"))
    sums = per_doc.groupBy("channel").agg(
        F.sum("tokens").alias("n_tokens"), F.count("*").alias("n_docs"), F.max("rounds").alias("most_repeats")
    )
    whole = sums.agg(F.sum("n_tokens").alias("whole"))
    joined = targets.select("channel", "target_share").join(sums, "channel", "left").join(F.broadcast(whole))  # one row
    return joined.select(
        "channel", "target_share", F.round(F.coalesce("n_tokens", F.lit(0)) / F.col("whole"), 6).alias("actual_share"),
        F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"), F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"),
    )
