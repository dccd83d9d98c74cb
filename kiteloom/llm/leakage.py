"""Problem 8: passages of evaluation items inside documents.

Q-gram lemma filtering. Texts become lower-case words parted by one space. The items' q-grams form a
sorted index; all q-grams of a batch of documents are hashed and looked up at once. Hits are counted
in overlapping diagonal bands per document and item; a band that holds as many hits as the lemma
demands of a passage within the edit budget is kept. It is verified by an alignment within the band: the longest
stretch that agrees but for the budgeted edits must be as long as a passage. What is left must hold unbroken words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kiteloom.llm.batches import slices
from kiteloom.plans.runtime import spread

#: Words in a row that make a leak.
MIN_WORDS = 12
#: Characters of a q-gram.
Q = 16
#: Edits that the filter allows in a passage; the verification then asks for unbroken words.
EDITS = 1
#: Characters of items in one index, which takes about twenty times as many bytes of memory, and indexes that one pass over
#: the documents holds; a larger item set takes more passes.
BLOCK_CHARS, BLOCKS_AT_ONCE = 4_000_000, 4
#: Pairs of equal q-grams that are counted at once; a q-gram that many items share is worked off in parts.
HIT_PAIRS = 4_000_000
#: Characters of documents that are looked up at once.
CHUNK_CHARS = 4_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15)


def normalised_words(text: Column) -> Column:
    """Lower-case runs of letters or digits, one space between them."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts, each followed by a newline, and where each text starts."""
    joined = "\n".join(texts) + "\n"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    lengths = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    return points, np.concatenate(([0], np.cumsum(lengths)[:-1])).astype(np.int64)


def qgram_hashes(points: np.ndarray) -> np.ndarray:
    """Hash of the Q characters from each position, by doubling; Q is a power of two."""
    h, width, factor = points.astype(np.uint64) + np.uint64(1), 1, _BASE
    with np.errstate(over="ignore"):
        while width < Q:
            if len(h) <= width:
                return np.empty(0, dtype=np.uint64)
            h = h[:-width] * factor + h[width:]
            factor, width = factor * factor, width * 2
        return (h ^ (h >> np.uint64(29))) * _BASE


class ItemIndex:
    """Sorted q-grams of the items with their positions, and a bitmap that rules out most lookups."""

    BITS = 22

    def __init__(self, ids: list[int], texts: list[str]):
        self.ids = np.asarray(ids, dtype=np.int64)
        self.points, self.starts = codes(texts)
        hashes = qgram_hashes(self.points)
        inside = np.ones(len(hashes), dtype=bool)
        for newline in np.flatnonzero(self.points == 10):
            inside[max(0, newline - Q + 1): newline + 1] = False
        at = np.flatnonzero(inside)
        order = np.argsort(hashes[at], kind="stable")
        self.hashes, self.positions = hashes[at][order], at[order]
        self.bitmap = np.zeros(1 << self.BITS, dtype=bool)
        self.bitmap[self.hashes >> np.uint64(64 - self.BITS)] = True
        #: Characters of each item's shortest passage, and the q-grams that it keeps under EDITS edits, at least one.
        self.shortest = np.array([self._shortest(t) for t in texts], dtype=np.int64)
        self.needed = np.where(self.shortest < 1 << 40, np.maximum(self.shortest - Q + 1 - EDITS * Q, 1), 1 << 40)

    @staticmethod
    def _shortest(text: str) -> int:
        """Characters of the shortest passage of MIN_WORDS words."""
        ends = np.cumsum([len(w) + 1 for w in text.split(" ")])
        if len(ends) < MIN_WORDS:
            return 1 << 40
        begins = np.concatenate(([0], ends[:-MIN_WORDS]))
        return int((ends[MIN_WORDS - 1:] - begins).min()) - 1

    def hits(self, points: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Positions in `points` and in the index of equal q-grams, in parts of about HIT_PAIRS."""
        hashes = qgram_hashes(points)
        maybe = np.flatnonzero(self.bitmap[hashes >> np.uint64(64 - self.BITS)])
        first = np.searchsorted(self.hashes, hashes[maybe], "left")
        count = np.searchsorted(self.hashes, hashes[maybe], "right") - first
        keep = count > 0
        maybe, first, count = maybe[keep], first[keep], count[keep]
        part = np.cumsum(count) // HIT_PAIRS
        for own in np.split(np.arange(len(maybe)), np.flatnonzero(np.diff(part)) + 1) if len(maybe) else []:
            doc_at = np.repeat(maybe[own], count[own])
            within = np.arange(len(doc_at)) - np.repeat(np.cumsum(count[own]) - count[own], count[own])
            yield doc_at, self.positions[np.repeat(first[own], count[own]) + within]


def _ending_runs(equal: np.ndarray) -> np.ndarray:
    """For each place of each row, how many true values in a row end there."""
    at = np.arange(equal.shape[1])
    return at - np.maximum.accumulate(np.where(equal, -1, at), axis=1)


def one_edit_stretch(doc: np.ndarray, item: np.ndarray, low: int, width: int) -> int:
    """`aligned_stretch` for one edit, all positions at once: what ends before the edit and what starts after it."""
    place = np.arange(len(item))[None, :] + low + np.arange(width)[:, None]
    inside = (place >= 0) & (place < len(doc))
    if not inside.any():
        return min(1, len(item))
    equal = inside & (doc[np.where(inside, place, 0)] == item[None, :])
    none = np.zeros((width, 1), dtype=np.int64)
    before = np.concatenate((none, _ending_runs(equal)), axis=1)  # [:, i]: the run that ends before i
    after = np.concatenate((_ending_runs(equal[:, ::-1])[:, ::-1], none), axis=1)  # [:, i]: the run that starts at i
    exchanged = before[:, :-1] + 1 + after[:, 1:]
    passed_over = before[:-1] + after[1:]
    left_out = before[1:, :-1] + 1 + after[:-1, 1:]
    return int(max(exchanged.max(initial=0), passed_over.max(initial=0), left_out.max(initial=0)))


def aligned_stretch(doc: np.ndarray, item: np.ndarray, low: int, width: int, edits: int = EDITS) -> int:
    """Most characters of the item in a row that agree with the document but for `edits` edits, along the diagonals low .. low + width - 1.

    A banded alignment: for each item position, diagonal and number of edits, the longest stretch that ends there.
    """
    best, none = 0, [0] * (width + 2)
    before = [none] * (edits + 1)  # by edits and diagonal, with a border on each side
    letters = item.tolist()
    for i in range(len(letters)):
        at, now = i + low, []
        equal = [0 <= at + d < len(doc) and doc[at + d] == letters[i] for d in range(width)]
        for e in range(edits + 1):
            row = [0] * (width + 2)
            for d in range(width):
                if equal[d]:
                    row[d + 1] = before[e][d + 1] + 1
                if e:  # one letter exchanged, the item's letter left out, or a letter of the document passed over
                    under = before[e - 1]
                    row[d + 1] = max(row[d + 1], under[d + 1] + 1, under[d + 2] + 1, now[e - 1][d] if d else 0)
            now.append(row)
            best = max(best, *row)
        before = now
    return best


def longest_word_run(doc: np.ndarray, item: np.ndarray, shift: int) -> int:
    """Most words in a row that agree when item position i lies on document position i + shift."""
    lo, hi = max(0, -shift), min(len(item), len(doc) - shift)
    if hi <= lo:
        return 0
    equal = item[lo:hi] == doc[lo + shift: hi + shift]
    edges = np.flatnonzero(np.diff(np.concatenate(([False], equal, [False])).astype(np.int8)))
    best = 0
    begins, ends = edges[::2] + lo, edges[1::2] + lo
    long_enough = ends - begins >= 2 * MIN_WORDS - 1
    for a, b in zip(begins[long_enough], ends[long_enough]):
        run = item[a:b]
        spaces = np.flatnonzero(run == 32)
        # a word counts if the stretch covers it up to a border in both texts
        starts_whole = (a == 0 or item[a - 1] == 32) and (a + shift == 0 or doc[a + shift - 1] == 32)
        ends_whole = (b == len(item) or item[b] == 32) and (b + shift == len(doc) or doc[b + shift] == 32)
        words = len(spaces) + 1 - (not starts_whole) - (not ends_whole)
        best = max(best, words)
    return best


def leaks_in(index: ItemIndex, texts: list[str]) -> list[tuple[int, int]]:
    """(row of `texts`, row of the index) of every leak."""
    points, starts = codes(texts)
    width = 2 * EDITS + 2  # overlapping bands: each diagonal lies in two, half a width apart
    half = width // 2
    n_items = len(index.ids)
    # one integer per document, item and band
    lowest = 2 * (-(len(index.points) + width) // width) - 2
    span = 2 * (len(points) // width + 2) - lowest
    keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for doc_at, item_at in index.hits(points):
        doc = np.searchsorted(starts, doc_at, "right") - 1
        item = np.searchsorted(index.starts, item_at, "right") - 1
        shift = (doc_at - starts[doc]) - (item_at - index.starts[item])
        band = np.concatenate((2 * (shift // width), 2 * ((shift + half) // width) + 1))
        own, n = np.unique((np.tile(doc * n_items + item, 2)) * span + (band - lowest), return_counts=True)
        keys, place = np.unique(np.concatenate((keys, own)), return_inverse=True)
        counts = np.bincount(place, np.concatenate((counts, n)), len(keys)).astype(np.int64)
    pairs, bands = keys // span, keys % span + lowest
    found, checked = [], -1
    for k in np.flatnonzero(counts >= index.needed[pairs % n_items]):
        pair, b = pairs[k], bands[k]
        if pair == checked:
            continue
        d, i = divmod(int(pair), n_items)
        low = int(b // 2) * width - (half if b % 2 else 0)
        doc_end = starts[d + 1] - 1 if d + 1 < len(starts) else len(points) - 1
        item_end = index.starts[i + 1] - 1 if i + 1 < len(index.starts) else len(index.points) - 1
        document, wanted = points[starts[d]: doc_end], index.points[index.starts[i]: item_end]
        stretch = one_edit_stretch(document, wanted, low, width) if EDITS == 1 else aligned_stretch(document, wanted, low, width)
        if stretch < index.shortest[i]:
            continue
        if any(longest_word_run(document, wanted, s) >= MIN_WORDS for s in range(low, low + width)):
            found.append((d, i))
            checked = pair
    return found


def _search(indexes: list):
    """Search of documents in broadcast indexes, which a worker unpacks once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, texts = batch["doc_id"].to_numpy(), batch["words"].tolist()
            for part in slices(texts, CHUNK_CHARS):
                for held in indexes:
                    pairs = leaks_in(held.value, texts[part])
                    yield pd.DataFrame(
                        {"doc_id": [ids[part.start + d] for d, _ in pairs], "item_id": [held.value.ids[i] for _, i in pairs]},
                        dtype="int64",
                    )

    return run


def leaked_items(documents: DataFrame, eval_items: DataFrame) -> DataFrame:
    """(doc_id, item_id): the document holds at least MIN_WORDS consecutive words of the item.

    Documents are read once for BLOCKS_AT_ONCE blocks of items (one block up to BLOCK_CHARS characters of items)
    and are never shuffled; each index is built once and broadcast, its size bounded by the block. Null texts,
    texts and items of fewer words than that and empty tables give no row; repeated keys give one row per pair.
    """
    spark = documents.sparkSession
    items = eval_items.select(F.col("item_id").cast("long"), normalised_words(F.col("text")).alias("words")).filter(
        F.col("item_id").isNotNull() & (F.size(F.split("words", " ")) >= MIN_WORDS)
    )
    total = items.agg(F.sum(F.length("words"))).first()[0] or 0
    blocks = int(total // BLOCK_CHARS) + 1
    docs = documents.select(F.col("doc_id").cast("long"), normalised_words(F.col("text")).alias("words")).filter(
        F.col("words").isNotNull() & F.col("doc_id").isNotNull()
    )
    result, indexes = None, []
    for block in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("words"), F.lit(blocks)) == block) if blocks > 1 else items
        rows = sorted((r[0], r[1]) for r in part.collect())  # at most about BLOCK_CHARS
        if rows:
            indexes.append(spark.sparkContext.broadcast(ItemIndex([r[0] for r in rows], [r[1] for r in rows])))
        if indexes and (len(indexes) == BLOCKS_AT_ONCE or block == blocks - 1):
            found = spread(docs).mapInPandas(_search(indexes), "doc_id long, item_id long")
            result, indexes = found if result is None else result.unionByName(found), []
    if result is None:
        return spark.createDataFrame([], "doc_id long, item_id long")
    return result.distinct()


def leak_report(documents: DataFrame, eval_items: DataFrame) -> DataFrame:
    """One row per evaluation item: (item_id, kind, n_docs) with the number of documents that hold it."""
    counts = leaked_items(documents, eval_items).groupBy("item_id").agg(F.count("*").alias("n_docs"))
    named = eval_items.select(F.col("item_id").cast("long").alias("item_id"), "kind")
    return named.join(counts, "item_id", "left").select("item_id", "kind", F.coalesce("n_docs", F.lit(0)).alias("n_docs"))
