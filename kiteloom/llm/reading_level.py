"""Problem 10: how demanding each document's text is.

A linear pairwise ranker is fitted on pairs of graded documents of one language, over the vocabulary
(hashed words) and the syntax (lengths of words, sentences and clauses) of their texts. Isotonic
regression by language turns its scores into levels.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kiteloom.llm.batches import slices
from kiteloom.plans.runtime import spread

#: Graded documents read for fitting, pairs per graded document, and bins of the hashed words.
MAX_GRADED, PAIRS_PER_DOC, BINS = 12_000, 40, 1 << 15
#: Iterations of the ranker (few, which keeps it from learning the noise of the grades) and weight of its penalty.
ITERATIONS, PENALTY = 20, 2e-4
#: Graded documents that a language needs for a calibration of its own.
LEAST_BY_LANGUAGE = 40
LOWEST, HIGHEST = 1, 4

_TOKEN = re.compile(r"[^\W\d_]+|\d+|[.!?。]+|[,;:()–—]")
# Frequent words by which a text's language shows.
_STOPWORDS = {
    "en": "the and of to in is that it was for with as we our you this are be by not".split(),
    "de": "der die das und ist nicht wir mit von zu den ein eine haben nach wurde war für auf dem".split(),
    "es": "el la los las de que y en un una con por para del se su más hasta como es".split(),
}
_LANGUAGE_OF = {w: k for k, words in _STOPWORDS.items() for w in words}
LANGUAGES = ["en", "de", "es", "ko"]
SYNTAX = ["sentence_log", "word_length", "clause_log", "long_share", "distinct_share", "bias"]


class Texts:
    """Words and syntax features of a list of texts, as flat arrays: the bins of a text's words, each once, with its share of them."""

    def __init__(self, texts: list[str]):
        known: dict[str, tuple[int, int, int]] = {}
        bins, shares, counts, language, syntax = [], [], [], [], []
        for text in texts:
            tokens = _TOKEN.findall(text.lower())
            ids, votes, ends, clauses, letters, long_words = [], [0, 0, 0, 0], 0, 0, 0, 0
            for t in tokens:
                got = known.get(t)
                if got is None:
                    kind = 1 if t[0] in ".!?。" else 2 if t[0] in ",;:()–—" else 0
                    vote = 3 if "가" <= t[0] <= "힣" else LANGUAGES.index(_LANGUAGE_OF[t]) if t in _LANGUAGE_OF else -1
                    name = "9" if t[0].isdigit() else t
                    got = known[t] = (zlib.crc32(name.encode("utf-8", "replace")) % BINS if not kind else -kind, len(t), vote)
                if got[0] == -1:
                    ends += 1
                elif got[0] == -2:
                    clauses += 1
                else:
                    ids.append(got[0])
                    letters += got[1]
                    long_words += got[1] >= 9
                    if got[2] >= 0:
                        votes[got[2]] += 1
            n = max(len(ids), 1)
            own = Counter(ids) or {0: 1}
            bins.extend(own)
            shares.extend(k / n for k in own.values())
            counts.append(len(own))
            language.append(int(np.argmax(votes)))
            syntax.append((
                np.log(n / max(ends, 1)), letters / n / 5, np.log1p(clauses / max(ends, 1)), long_words / n, len(set(ids)) / n, 1.0
            ))
        self._set(bins, shares, counts, language, syntax)

    def _set(self, bins, shares, counts, language, syntax) -> None:
        self.bins, self.shares = np.array(bins, dtype=np.int64), np.array(shares, dtype=float)
        self.counts = np.array(counts, dtype=np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.counts)[:-1])).astype(np.int64) if len(counts) else np.zeros(0, np.int64)
        self.language = np.array(language, dtype=np.int64)
        self.syntax = np.array(syntax, dtype=float).reshape(len(counts), len(SYNTAX))

    def rows(self) -> pd.DataFrame:
        """The features of each text, to be sent in its place."""
        ends = self.starts + self.counts
        return pd.DataFrame({
            "bins": [self.bins[a:b] for a, b in zip(self.starts, ends)], "shares": [self.shares[a:b] for a, b in zip(self.starts, ends)],
            "language": self.language, "syntax": list(self.syntax),
        })

    @classmethod
    def of_rows(cls, rows: pd.DataFrame) -> Texts:
        made = cls.__new__(cls)
        joined = lambda name: np.concatenate([np.zeros(0), *rows[name]])
        made._set(joined("bins"), joined("shares"), [len(b) for b in rows["bins"]], rows["language"], [list(x) for x in rows["syntax"]])
        return made

    def scores(self, vocabulary: np.ndarray, syntax: np.ndarray) -> np.ndarray:
        if not len(self.counts):
            return np.zeros(0)
        words = np.add.reduceat(vocabulary[self.bins] * self.shares, self.starts)
        return words + (self.syntax * syntax[self.language]).sum(axis=1)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing fit of y on x, by pooling adjacent violators."""
    order = np.argsort(x, kind="stable")
    levels: list[list[float]] = []
    for xi, yi in zip(x[order], y[order]):
        levels.append([yi, 1.0, xi, xi])
        while len(levels) > 1 and levels[-2][0] >= levels[-1][0]:
            v, w, _, hi = levels.pop()
            u, t, lo, _ = levels.pop()
            levels.append([(u * t + v * w) / (t + w), t + w, lo, hi])
    knots = np.array([[p[2], p[0]] for p in levels] + [[p[3], p[0]] for p in levels])
    knots = knots[np.lexsort((knots[:, 1], knots[:, 0]))]
    return knots[:, 0], knots[:, 1]


class ReadingModel:
    def __init__(self, vocabulary: np.ndarray, syntax: np.ndarray, knots: list[tuple[np.ndarray, np.ndarray]]):
        self.vocabulary, self.syntax, self.knots = vocabulary, syntax, knots

    @classmethod
    def fit(cls, texts: list[str] | Texts, grades: list[float], seed: int = 3) -> ReadingModel:
        data = texts if isinstance(texts, Texts) else Texts(texts)
        grade, rng = np.array(grades, dtype=float), np.random.default_rng(seed)
        n = len(grade)
        vocabulary, syntax = np.zeros(BINS), np.zeros((len(LANGUAGES), len(SYNTAX)))
        if not n:
            middle = (np.array([0.0]), np.array([(LOWEST + HIGHEST) / 2]))
            return cls(vocabulary.astype(np.float32), syntax, [middle] * len(LANGUAGES))
        left, right = [], []
        for k in range(len(LANGUAGES)):
            own = np.flatnonzero(data.language == k)
            if len(own) < 2:
                continue
            a, b = rng.choice(own, len(own) * PAIRS_PER_DOC), rng.choice(own, len(own) * PAIRS_PER_DOC)
            harder = grade[a] - grade[b]
            left += [a[harder > 0.4], b[harder < -0.4]]
            right += [b[harder > 0.4], a[harder < -0.4]]
        left, right = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))
        doc_of = np.repeat(np.arange(n), data.counts)
        seen_v, seen_s = np.full(BINS, 1e-8), np.full(syntax.shape, 1e-8)
        for _ in range(ITERATIONS if len(left) else 0):  # AdaGrad on the pairwise logistic loss
            score = data.scores(vocabulary, syntax)
            pull = 1 / (1 + np.exp(np.clip(score[left] - score[right], -30, 30))) / len(left)
            push = np.bincount(right, pull, n) - np.bincount(left, pull, n)
            grad_v = np.bincount(data.bins, push[doc_of] * data.shares, BINS) + PENALTY * vocabulary / BINS
            grad_s = np.zeros_like(syntax)
            np.add.at(grad_s, data.language, push[:, None] * data.syntax)
            seen_v += grad_v**2
            seen_s += grad_s**2
            vocabulary -= 0.5 * grad_v / np.sqrt(seen_v)
            syntax -= 0.1 * grad_s / np.sqrt(seen_s)
        score = data.scores(vocabulary, syntax)
        whole = isotonic(score, grade)
        knots = []
        for k in range(len(LANGUAGES)):
            own = data.language == k
            knots.append(isotonic(score[own], grade[own]) if own.sum() >= LEAST_BY_LANGUAGE else whole)
        return cls(vocabulary.astype(np.float32), syntax, knots)

    def levels(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(level, score) of each text."""
        data = Texts(texts)
        score = data.scores(self.vocabulary, self.syntax)
        level = np.zeros(len(texts))
        for k, (x, y) in enumerate(self.knots):
            own = data.language == k
            level[own] = np.interp(score[own], x, y)
        return np.clip(np.floor(level + 0.5), LOWEST, HIGHEST).astype(np.int64), score


def level_batch(vocabulary: np.ndarray, syntax: np.ndarray, knots: list):
    model = ReadingModel(vocabulary, syntax, knots)

    def run(text: pd.Series) -> pd.DataFrame:
        values = [t or "" for t in text]
        parts = [model.levels(values[part]) for part in slices(values)]
        level = np.concatenate([np.zeros(0, np.int64), *(p[0] for p in parts)])
        return pd.DataFrame({"band": level, "score": np.concatenate([np.zeros(0), *(p[1] for p in parts)])})

    return run


LEVEL = "struct<band:bigint,score:double>"


FEATURES = "graded_id long, grade double, bins array<long>, shares array<double>, language long, syntax array<double>"


def _features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        texts = batch["text"].tolist()
        for part in slices(texts):
            rows = Texts(texts[part]).rows()
            yield pd.concat([batch[["graded_id", "grade"]].iloc[part].reset_index(drop=True), rows], axis=1)


def fit_reading_model(documents: DataFrame, labels: DataFrame) -> ReadingModel:
    """Fits on at most MAX_GRADED graded documents, in the order of a hash of their key; grades of one document are averaged.

    The driver gets the features of each document, never its text: at most BINS words of 16 bytes, whatever its length.
    """
    graded = labels.filter(F.col("band").between(LOWEST, HIGHEST)).groupBy(F.col("doc_id").cast("long").alias("graded_id")).agg(F.avg("band").alias("grade"))
    bounded = graded.orderBy(F.xxhash64("graded_id"), "graded_id").limit(MAX_GRADED)
    # at most MAX_GRADED rows of 16 bytes, so the documents stay where they are
    texts = documents.select("doc_id", "text").join(F.broadcast(bounded), F.col("doc_id") == F.col("graded_id")).filter(
        F.col("text").isNotNull()
    ).groupBy("graded_id").agg(F.first("grade").alias("grade"), F.min("text").alias("text"))
    rows = texts.mapInPandas(_features, FEATURES).toPandas().sort_values("graded_id")
    return ReadingModel.fit(Texts.of_rows(rows), rows["grade"].tolist())


def reading_levels(documents: DataFrame, labels: DataFrame, model: ReadingModel | None = None) -> DataFrame:
    """(doc_id, band, score): one row per row of documents, `band` from 1 (easiest) to 4.

    Null and empty texts get the level of a text without words; without any usable label all documents
    get the middle of the scale. Labels outside the scale are ignored, documents without key dropped.
    """
    model = model or fit_reading_model(documents, labels)
    run = F.pandas_udf(level_batch(model.vocabulary, model.syntax, model.knots), LEVEL)
    slim = documents.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), "text")
    return spread(slim).select("doc_id", run("text").alias("l")).select(
        "doc_id", F.col("l.band").alias("band"), F.round("l.score", 4).alias("score")
    )


def level_profile(levels: DataFrame, documents: DataFrame) -> DataFrame:
    """(channel, band, n_docs): how demanding each part of the corpus is."""
    return levels.join(documents.select(F.col("doc_id").cast("long"), "channel").dropDuplicates(["doc_id"]), "doc_id", "left").groupBy("channel", "band").agg(
        F.count("*").alias("n_docs")
    )
