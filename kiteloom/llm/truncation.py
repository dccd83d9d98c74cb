"""Problem 4: text cut off by length limits or on the way.

A cut text is a near-copy of the beginning of a longer one, so min-hash bands over shingles of five words are
taken of beginnings: each text offers its beginnings of the lengths of a grid, and a value with an open end
asks with its own. Verified pairs are aligned by words, and a copy whose alignment ends early, inside a
sentence, is cut. Records without such a partner are scored by closing-word terminality: a linear model over
the closing words of the last sentence, fitted on sentences that are cut here, tells whether a text may end there. All
values of the columns are read for it: words and openings are counted, the weights are fitted by shards and averaged.
"""

from __future__ import annotations

import bisect
import html
import random
import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kiteloom.llm.batches import SUMMANDS, slices, summands, summed
from kiteloom.plans.runtime import cut_lineage, small_side, spread

#: Words of a shingle, similarity of near-copies, bands and rows per band (hit rate 0.95 at 0.8, 1 for a cut that was not edited).
SHINGLE, SIMILARITY, BANDS, ROWS = 5, 0.8, 3, 2
#: Lengths in words of the beginnings that are banded, each half as long again as the one before; a text that is longer
#: than the last is met by that one.
GRID = [6]
while GRID[-1] < 20_000:
    GRID.append(GRID[-1] * 3 // 2)
#: An opening of sentences is known if one in so many values has it, a word if more than one in so many have it.
RARE = 8000
#: Values that one shard of the fit holds; shards are drawn by a hash of the values.
SHARD_VALUES = 50_000
#: Values of a bucket that one salt holds.
BUCKET_ROWS = 1000
#: Pairs up to which their longer texts are looked up by broadcast ids (16 bytes each).
BROADCAST_PAIRS = 500_000
#: Bins of the hashed closing features, and features of a stretch of words.
BINS, FEATURES = 1 << 17, 12

# Signs and words by which sources mark an omission.
OMISSION = re.compile(
    r"(?:\s*(?:[\[(]\s*(?:…|\.{3}|&hellip;|&#8230;|more|mehr)\s*[\])]|…|\.{3,}|&hellip;|&#8230;|&#x2026;"
    r"|(?:[-–—>»]\s*)?(?:read more|continue reading|weiterlesen|mehr lesen|leer más|seguir leyendo|더 보기|더보기|계속 읽기)\s*[.…>»]*))+\s*$",
    re.IGNORECASE,
)
_TAG = re.compile(r"<!--.*?-->|</?[a-zA-Z][^<>]*>", re.DOTALL)
_OPEN_REFERENCE = re.compile(r"&(?:#?\w{1,7})?$")
_OPEN_LINK = re.compile(r"\]\([^()\s]*$|\[\[[^\]\n]*$")
_CLOSABLE = ("p", "li", "ul", "ol", "pre", "code", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "table", "a", "b", "strong", "em", "i", "span", "td", "figure")
_UNCLOSED = re.compile(rf"<(/?)({'|'.join(_CLOSABLE)})\b[^<>]*?(/?)>", re.IGNORECASE)
# the first sign stands before the alternatives, so that the search passes over all else
_STOP = re.compile(r"[.!?。！？…](?:[\"'”’»)\]*_~`]*(?=\s|$)|(?<=[.!?。])[.!?。]*(?=[^\w\s]*$))")
_ENDS, _CLOSERS = (".", "!", "?", "。", "！", "？"), "\"'”’»)]*_~`"
_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)?")
_ASCII_WORD = re.compile(r"[A-Za-z0-9]+(?:'[A-Za-z0-9]+)?")
# what OMISSION may end with
_OMITTING, _OMITTED = re.compile(r"(?:more|reading|lesen|más|leyendo|보기|읽기)\Z", re.IGNORECASE), ("…", "...", ";", "]", ")")
_ORNAMENT = re.compile(r"(?:\s*(?:\(\d+/\d+\)|[:;]-?[)D(P]|[\U0001F300-\U0001FAFF☀-➿]))+\s*$")
_LISTED = re.compile(r"^\s*(?:[-*+#]{1,4}\s|\d{1,3}[.)]\s|\\item\b|\||#{1,6}\s|={2,}|>|```|\\(?:sub)*section|\\end|\\begin)")


def find_words(text: str) -> list[str]:
    return (_ASCII_WORD if text.isascii() else _WORD).findall(text)


def lower_words(text: str) -> list[str]:
    return _ASCII_WORD.findall(text.lower()) if text.isascii() else [w.lower() for w in _WORD.findall(text)]


def without_omission(text: str) -> str:
    """`text`, which ends with no space, without OMISSION; searched only where the end may be one."""
    if text.endswith(_OMITTED) or _OMITTING.search(text.rstrip(".…>»").rstrip()[-8:]):
        return OMISSION.sub("", text)
    return text


def without_ornament(text: str) -> str:
    """`text`, which ends with no space, without _ORNAMENT; searched only where the end may be one."""
    end = text[-1:]
    return _ORNAMENT.sub("", text) if end in ")D(P" or "☀" <= end <= "➿" or "\U0001F300" <= end <= "\U0001FAFF" else text


def light_text(value: str) -> tuple[str, bool]:
    """(text without tags and references, whether it ends inside a tag or with an element left open)."""
    text = value
    if "&" in text:
        text = html.unescape(html.unescape(text)) if "&lt;" in text or "&amp;" in text else html.unescape(text)
    if "<" not in text:
        return text, "&lt;" in value and bool(_OPEN_REFERENCE.search(value))
    broken = bool(re.search(r"</?(?:[a-zA-Z]\w*)?(?:\s[^<>]*)?$|<!-[^>]*$", text)) and not re.search(r"<\s[^<>]*$", text)
    if broken:
        text = text[: text.rfind("<")]
    opened: list[str] = []
    for m in _UNCLOSED.finditer(text):
        name = m[2].lower()
        if m[3]:
            continue
        if not m[1]:
            opened.append(name)
        elif name in opened:
            while opened and opened.pop() != name:
                pass
    return _TAG.sub(lambda m: "" if re.match(r"</?(?:a|b|i|em|strong|code|span|u|s|mark|small|sub|sup)\b", m[0], re.I) else "\n", text), broken or bool(opened)


@lru_cache(1 << 16)
def _shape(word: str, inside: bool) -> str:
    if any(c.isdigit() for c in word):
        return re.sub(r"\d+", "9", word.lower())
    return "Xx" if inside and word[:1].isupper() and word[1:].islower() and len(word) > 3 and word.isascii() else word.lower()


def _checked(text: str, start: int = 0) -> int:
    return zlib.crc32(text.encode("utf-8", "replace"), start)


def _bin(feature: str) -> int:
    return _checked(feature) % BINS


_KNOWN, _UNKNOWN, _BIAS = _bin("known"), _bin("unknown"), _bin("bias")


@lru_cache(1 << 16)
def _opening(opener: str, pair: str, length: int) -> tuple[int, int, int, int, int]:
    """(bins of an opening with the length, bin of the length, check values that the features of both ends go on from)."""
    return _bin(f"o{opener}|{length}"), _bin(f"p{pair}|{length}"), _bin(f"n{length}"), _checked(f"c{pair}|"), _checked(f"C{pair}|")


@lru_cache(1 << 16)
def _closing(third: str, second: str, last: str) -> tuple[int, int, int, bytes, bytes]:
    """(bins of the last word, the last two, the last three, text of the first two)."""
    two = f"{second} {last}"
    return _bin("1" + last), _bin("2" + two), _bin(f"3{third} {two}"), last.encode("utf-8", "replace"), two.encode("utf-8", "replace")


@lru_cache(1 << 16)
def _suffixes(word: str) -> tuple[str, int, int]:
    """(word in lower case, bins of its last two and three letters)."""
    low = word.lower()
    return low, _bin("s" + low[-2:]), _bin("S" + low[-3:])


class Tail:
    """What the end of a value shows before any model is asked."""

    __slots__ = ("verdict", "words", "alone", "listed", "others", "copied")

    def __init__(self, value: str):
        #: Words that a longer copy would begin with, the last perhaps in part; empty where the end closes its sentence.
        self.copied: list[str] = []
        self.words: list[str] = []
        self.others: frozenset = frozenset()
        self.alone = self.listed = False
        self.verdict: bool | None = False
        text, left_open = light_text(value)
        text = text.rstrip()
        if not text.strip():
            return
        stripped = without_omission(text)
        omitted = stripped != text
        if omitted or not text.rstrip(_CLOSERS).endswith(_ENDS):
            self.copied = lower_words(stripped)
        bare = (stripped if omitted else without_ornament(text)).rstrip()
        ornament = not omitted and bare != text
        last_line = bare.rsplit("\n", 1)[-1]
        stops = [m.end() for m in _STOP.finditer(last_line)]
        fragment = last_line[stops[-1]:] if stops else last_line
        self.words = find_words(fragment)
        if not self.words:
            # the omission follows a whole sentence, or nothing is left open
            self.verdict = False
            return
        fences, code = value.count("```"), "```" in value or "<pre" in value or "&lt;pre" in value
        opened = left_open or fences % 2 == 1 or bool(_OPEN_LINK.search(bare)) or value.count("\\begin{") > value.count("\\end{")
        self.verdict = None
        if omitted or opened:
            self.verdict = True
        elif ornament or re.search(r"https?://\S+$", last_line) or value.rstrip().endswith((">", "&gt;")):
            self.verdict = False  # an ornament, an address or a closed element ends the value
        elif bare[-1] in ",([{«“‘–—-" and not code:
            self.verdict = True
        elif not re.match(r"\w", bare[-1]):
            self.verdict = False
        self.listed = bool(_LISTED.match(last_line))
        if self.verdict is not None:
            return
        self.alone = not self.listed and "\n" not in bare.strip() and not stops
        if self.listed:
            self.others = frozenset(w.lower() for w in find_words(bare)[:-1])


def stretches(values: list[str]) -> tuple[list[tuple[str, list[str]]], list[list[str]]]:
    """(sentences that are closed and their words, words of short lines that stand alone) of the values."""
    sentences, lines = [], []
    for value in values:
        text, _ = light_text(value)
        stopped = False
        for line in text.split("\n"):
            at = 0
            for m in _STOP.finditer(line):
                begin, end = m.span()
                sentence = line[at:end]
                words = find_words(sentence)
                if len(words) >= 2 and line[begin] != "…":
                    sentences.append((sentence.rstrip(".!?。 \"'”’»)*_~`"), words))  # what is taken off is no word
                at, stopped = end, True
        if stopped:
            continue  # such a value is no line that stands alone
        tail = Tail(value)
        if tail.verdict is None and tail.alone and len(tail.words) <= 9:
            lines.append(tail.words)
    return sentences, lines


def opening_counts(sentences: list[tuple[str, list[str]]], lines: list[list[str]]) -> tuple[Counter, Counter]:
    """(how many more sentences than lines open with two words, how many sentences hold a word)."""
    opening = Counter(" ".join(map(str.lower, words[:2])) for _, words in sentences)
    opening.subtract(" ".join(words[:2]).lower() for words in lines)
    return opening, Counter(chain.from_iterable(set(map(str.lower, words)) for _, words in sentences))


def fitted_weights(examples: np.ndarray, seed: int, epochs: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """(weights of the bins, how often the examples hold each), by AdaGrad on the logistic loss."""
    squared, noise, weights = np.full(BINS, 1e-6), np.random.default_rng(seed), np.zeros(BINS)
    if not len(examples):
        return weights, np.zeros(BINS)
    matrix, target, order = examples[:, :-1], examples[:, -1].astype(np.float64), np.arange(len(examples))
    place, number = np.zeros(BINS, np.int64), np.arange(512 * matrix.shape[1])
    for _ in range(epochs):
        noise.shuffle(order)
        for batch in np.array_split(order, max(1, len(order) // 256)):
            rows = matrix[batch].astype(np.int64)
            error = (1 / (1 + np.exp(-weights[rows].sum(axis=1))) - target[batch]) / len(batch)
            bins = rows.ravel()
            place[bins] = number[: len(bins)]  # one occurrence of each bin stays, which needs no sort
            touched = bins[place[bins] == number[: len(bins)]]
            place[touched] = number[: len(touched)]
            grad = np.bincount(place[bins], np.repeat(error, rows.shape[1]))
            squared[touched] += grad ** 2
            weights[touched] -= 0.3 * grad / np.sqrt(squared[touched])
    return weights, np.bincount(matrix.ravel(), minlength=BINS).astype(np.float64)


class TerminalityModel:
    """Linear model of closing features; positive scores mean that the text was cut."""

    def __init__(self, weights: np.ndarray, openers: frozenset, vocabulary: frozenset):
        self.weights, self.openers, self.vocabulary = weights, openers, vocabulary
        self._stems = self._endings = None  # worked out at the first item

    @classmethod
    def fit(cls, values: list[str], seed: int = 5) -> TerminalityModel:
        sentences, lines = stretches(values)
        opening, words = opening_counts(sentences, lines)
        least = max(1, len(values) / RARE)
        model = cls(np.zeros(BINS, dtype=np.float32), frozenset(o for o, n in opening.items() if n >= least), frozenset(w for w, n in words.items() if n > least))
        model.weights = fitted_weights(model.examples(sentences, lines, random.Random(seed)), seed)[0].astype(np.float32)
        return model

    def examples(self, sentences: list[tuple[str, list[str]]], lines: list[list[str]], rng: random.Random) -> np.ndarray:
        """Bins of whole sentences, of the same cut anywhere, and of lines that are no sentence; the last column is the label."""
        flat = array("i")
        for s, words in sentences:
            flat.extend(self._bins(words))
            flat.append(0)
            if len(s) > 12:
                cut = find_words(s[: rng.randint(6, len(s) - 1)]) if rng.random() < 0.6 else words[: rng.randrange(len(words) - 1) + 1]
                if cut and cut != words:
                    flat.extend(self._bins(cut))
                    flat.append(1)
        for words in lines:
            if " ".join(words[:2]).lower() not in self.openers:
                flat.extend(self._bins(words))
                flat.append(0)
        return np.array(flat, dtype=np.int32).reshape(-1, FEATURES + 1)

    def _bins(self, words: list[str]) -> tuple[int, ...]:
        """Bins of the features of a stretch of words as the end of a sentence; digits and names count by their shape.

        They are the last word, two and three, the last word's last two and three letters, the first word and two each
        with the length, the first two with the last word and two, the length, whether the last word is known, and a bias.
        """
        n = len(words)
        opener, last, second, third = _shape(words[0], False), _shape(words[-1], n > 1), "^", "^"
        pair = opener
        if n > 1:
            pair, second = f"{opener} {_shape(words[1], True)}", _shape(words[-2], n > 2)
            if n > 2:
                third = _shape(words[-3], n > 3)
        first_length, pair_length, length, pair_last, pair_two = _opening(opener, pair, min(n, 60))
        one, two, three, last_text, two_text = _closing(third, second, last)
        low, letters, more_letters = _suffixes(words[-1])
        return (
            one, two, three, letters, more_letters, first_length, pair_length, zlib.crc32(last_text, pair_last) % BINS, zlib.crc32(two_text, pair_two) % BINS,
            length, _KNOWN if low in self.vocabulary or words[-1].isdigit() else _UNKNOWN, _BIAS,
        )

    def _breaks_off(self, word: str, others: frozenset) -> bool:
        """Whether an unknown word begins a longer one, of the vocabulary or of the same value, or ends like no known word."""
        if word in self.vocabulary or word in others:
            return False
        if self._stems is None:
            self._stems = {w[:n] for w in self.vocabulary for n in range(1, len(w))}
            self._endings = {w[-2:] for w in self.vocabulary}
        return word in self._stems or any(w.startswith(word) for w in others) or bool(self._endings) and word[-2:] not in self._endings

    def cut(self, tail: Tail) -> bool:
        if tail.verdict is not None:
            return tail.verdict
        if tail.listed:  # items and headings have no stop; only a word that breaks off shows the cut
            last = tail.words[-1]
            return not last[:1].isupper() and not last.isdigit() and self._breaks_off(last.lower(), tail.others)
        pair = " ".join(tail.words[:2]).lower()
        if tail.alone and len(tail.words) <= 9 and pair not in self.openers and (tail.words[-1].lower() in self.vocabulary or tail.words[-1][:1].isupper()):
            return False  # a heading: no sentence opens like this
        return float(self.weights[list(self._bins(tail.words))].sum()) > 0


# ---------------------------------------------------------------- near-copies

_MULTIPLIERS = np.random.default_rng(17).integers(1, 1 << 62, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LAST = np.uint64(0xFFFFFFFFFFFFFFFF)


def copy_words(value: str) -> list[str]:
    return lower_words(light_text(value)[0])


def grid_steps(n_words: int) -> int:
    """How many lengths of the grid a text of so many words reaches."""
    return bisect.bisect_right(GRID, n_words)


def beginnings(texts: list[list[str]], homes: list[int], last_only: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, step, band key, piece) of the beginnings of word lists, by the lengths of the grid that they reach.

    A band key stands for the source (`homes`), the length, the band and its min-hashes over the shingles of that
    beginning. A piece is a hash of the beginning and of the words up to the next length, all that an
    alignment with a text of this length looks at. With `last_only` only the longest beginning counts.
    """
    rows = [i for i, words in enumerate(texts) if len(words) >= GRID[0]]
    empty = np.zeros(0, np.int64)
    if not rows:
        return empty, empty, empty, empty
    steps = np.array([grid_steps(len(texts[i])) for i in rows], dtype=np.int64)
    reach = [min(len(texts[i]), GRID[min(s, len(GRID) - 1)] + 2) for i, s in zip(rows, steps)]
    vocabulary: dict[str, int] = {}
    flat_ids: list[int] = []
    for i, r in zip(rows, reach):
        for w in texts[i][:r]:
            got = vocabulary.get(w)
            if got is None:
                data = w.encode("utf-8", "replace")
                got = vocabulary[w] = (zlib.crc32(data) << 32) | zlib.adler32(data[::-1])
            flat_ids.append(got)
    flat = np.array(flat_ids, dtype=np.uint64)
    lengths = np.array(reach, dtype=np.int64)
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1])).astype(np.int64)
    n_steps = int(steps.max())
    sizes = np.array(GRID[:n_steps], dtype=np.int64)
    with np.errstate(over="ignore"):
        padded = np.concatenate((flat, np.zeros(SHINGLE, np.uint64)))
        shingles = np.zeros(len(flat), dtype=np.uint64)
        for k in range(SHINGLE):
            shingles = shingles * np.uint64(0x9E3779B97F4A7C15) + padded[k: len(flat) + k]
        shingles ^= shingles >> np.uint64(31)
        # shingles that a beginning adds to the one before: from the last one that ended there to its own last one
        reached = np.arange(n_steps)[None, :] < steps[:, None]
        begin = starts[:, None] + np.concatenate(([0], sizes[:-1] - SHINGLE + 1))[None, :]
        stop = starts + GRID_ENDS[steps - 1]
        cuts = np.concatenate((begin[reached], stop))
        order = np.argsort(cuts, kind="stable")
        real = np.concatenate((np.ones(int(reached.sum()), bool), np.zeros(len(rows), bool)))[order]
        mins = []
        for m in _MULTIPLIERS:
            mixed = shingles * m
            mixed ^= mixed >> np.uint64(32)
            low = np.full(reached.shape, _LAST)
            low[reached] = np.minimum.reduceat(np.concatenate((mixed, [_LAST])), cuts[order])[real]
            mins.append(np.minimum.accumulate(low, axis=1))
        place = np.arange(len(flat), dtype=np.uint64) - np.repeat(starts, lengths).astype(np.uint64) + np.uint64(1)
        weighed = flat * (place * np.uint64(0x94D049BB133111EB) | np.uint64(1))
        weighed ^= weighed >> np.uint64(29)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(weighed, dtype=np.uint64)))
        ends = np.minimum(np.array([GRID[min(k + 1, len(GRID) - 1)] + 2 for k in range(n_steps)])[None, :], lengths[:, None])
        pieces = (sums[starts[:, None] + ends] - sums[starts][:, None]) * _MULTIPLIERS[0] ^ ends.astype(np.uint64)
        home = np.array([homes[i] for i in rows], dtype=np.int64).view(np.uint64)[:, None]
        keys = []
        for b in range(BANDS):
            key = home * np.uint64(0xBF58476D1CE4E5B9) + (np.arange(n_steps, dtype=np.uint64) * np.uint64(BANDS) + np.uint64(b))[None, :]
            for r in range(ROWS):
                key = (key ^ mins[b * ROWS + r]) * np.uint64(0xD6E8FEB86659FD93)
                key ^= key >> np.uint64(32)
            keys.append(key)
    wanted = reached & (np.arange(n_steps)[None, :] == steps[:, None] - 1) if last_only else reached
    at, step = np.nonzero(wanted)
    n = len(at)
    row = np.array(rows, dtype=np.int64)[at]
    return (
        np.tile(row, BANDS), np.tile(step, BANDS), np.concatenate([k[wanted] for k in keys]).view(np.int64),
        np.tile(pieces[wanted].view(np.int64), BANDS) if n else empty,
    )


#: Shingles of the beginnings of the grid.
GRID_ENDS = np.array(GRID, dtype=np.int64) - SHINGLE + 1


def _shingle_set(words: list[str]) -> set[tuple[str, ...]]:
    return {tuple(words[i:i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))}


def banded_ends(core: list[str], b: list[str], band: int) -> dict[int, int]:
    """Edits between the words `core` and b[:j], by j, along alignments that stray from the diagonal by at most `band` words."""
    skip = 0  # a common beginning costs nothing
    while skip < min(len(core), len(b)) and core[skip] == b[skip]:
        skip += 1
    row = {j: j - skip for j in range(skip, min(len(b), skip + band) + 1)}
    for i in range(skip + 1, len(core) + 1):
        last, row = row, {}
        word = core[i - 1]
        for j in range(max(skip, i - band), min(len(b), i + band) + 1):
            best = last.get(j, i + j) + 1
            if j > skip:
                best = min(best, last.get(j - 1, i + j) + (word != b[j - 1]), row.get(j - 1, i + j) + 1)
            row[j] = best
    return row


def aligned_words(a: list[str], b: list[str], long: str) -> str | None:
    """'cut' or 'whole' where the alignment of the copied words `a` with the words `b` of a longer text ends early, else None.

    The words before the last are aligned with the beginning of `b` within a band, the last one with the word that
    follows there, of which it may be a part. The alignment holds with at most a tenth of the words edited, or
    where the shingles of both aligned parts have the similarity of near-copies.
    """
    n = len(a)
    if n < 2 or not b:
        return None
    if a[:-1] == b[: n - 1]:
        end = n - 1 if n <= len(b) and b[n - 1].startswith(a[-1]) else None
    else:
        band = n // 4 + 1
        shingles, others = _shingle_set(a), _shingle_set(b[: n + band + 1])  # the band reaches no further
        if len(shingles - others) > SHINGLE * (0.1 * n + 1):
            return None  # neither bound below can hold: an edit changes at most SHINGLE of the shingles
        ends = {j: edits for j, edits in banded_ends(a[:-1], b, band).items() if j < len(b) and b[j].startswith(a[-1])}
        end = min(ends, key=lambda j: (ends[j], b[j] != a[-1], abs(j - n + 1))) if ends else None
        if end is not None and ends[end] > 0.1 * (n - 1):
            part = _shingle_set([*b[:end], a[-1]])
            if len(shingles & part) < SIMILARITY * len(shingles | part):
                return None
    if end is None or (end == len(b) - 1 and a[-1] == b[end]):
        return None
    if a[-1] != b[end]:
        return "cut"
    text = light_text(long)[0]
    words = list(_WORD.finditer(text))
    following = text[words[end].end(): words[end + 1].start()]
    return "whole" if re.search(r"[.!?。:]|\n", following) else "cut"


def aligned_end(short: str, long: str) -> str | None:
    """`aligned_words` of two texts; a sign of omission is no part of the copy, a text that closes its sentence copies nothing."""
    return aligned_words(Tail(short).copied, copy_words(long), long)


def align_batch(copied: pd.Series, long: pd.Series) -> pd.Series:
    """`aligned_words` of pairs; a longer text is cut into words once for the pairs that stand side by side."""
    out, text, words = [], None, []
    for a, b in zip(copied, long):
        if b is not text:
            if b != text:
                words = copy_words(b)
            text = b
        out.append(aligned_words(a.split(" "), words, b))
    return pd.Series(out, dtype="object")


# ---------------------------------------------------------------- the operator

PROFILE = "struct<cut:boolean,copied:string,keys:array<bigint>>"


def _home(site) -> int:
    return zlib.crc32(site.encode("utf-8", "replace")) + 1 if isinstance(site, str) else 0


def _grouped(rows: np.ndarray, values: list[np.ndarray], n: int) -> list[list[np.ndarray]]:
    """The parts of each of `values` that belong to row 0 .. n - 1."""
    order = np.argsort(rows, kind="stable")
    edges = np.searchsorted(rows[order], np.arange(1, n))
    return [np.split(v[order], edges) if n else [] for v in values]


def profile_batch(weights: np.ndarray, openers: frozenset, vocabulary: frozenset):
    """For reported values: what their closing words say, and of those with an open end the copied words and their keys."""
    model = TerminalityModel(weights, openers, vocabulary)

    def run(text: pd.Series, site: pd.Series) -> pd.DataFrame:
        values, homes = [t or "" for t in text], [_home(s) for s in site]
        cuts, copied, keys = [], [], []
        for part in slices(values):
            tails = [Tail(t) for t in values[part]]
            cuts += [model.cut(t) for t in tails]
            copied += [" ".join(t.copied) if len(t.copied) > GRID[0] else None for t in tails]
            row, _, key, _ = beginnings([t.copied[:-1] for t in tails], homes[part], last_only=True)
            keys += _grouped(row, [key], len(tails))[0]
        return pd.DataFrame({"cut": pd.array(cuts, dtype="boolean"), "copied": pd.Series(copied, dtype="object"), "keys": pd.Series(keys, dtype="object")})

    return run


OFFERED = "key long, piece long, part int, rec_id long"


def offered_beginnings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """OFFERED of all beginnings of the texts of (part, rec_id, site, value)."""
    for batch in batches:
        values, homes = batch["value"].tolist(), [_home(s) for s in batch["site"]]
        parts, ids = batch["part"].to_numpy(), batch["rec_id"].to_numpy()
        for part in slices(values):
            row, _, key, piece = beginnings([copy_words(t) for t in values[part]], homes[part])
            yield pd.DataFrame({"key": key, "piece": piece, "part": parts[part][row], "rec_id": ids[part][row]})


def counted_openings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(opens, item, n): `opening_counts` of the column `value`."""
    for batch in batches:
        for opens, counts in zip((True, False), opening_counts(*stretches(batch["value"].tolist()))):
            yield pd.DataFrame({"opens": opens, "item": pd.Series(list(counts), dtype="object"), "n": np.fromiter(counts.values(), np.int64, len(counts))})


def fitted_shard(openers: frozenset, vocabulary: frozenset, seed: int = 5):
    """SUMMANDS of a shard's weights, each times how often it was met, and of how often."""
    model = TerminalityModel(np.zeros(BINS, dtype=np.float32), openers, vocabulary)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rng = random.Random(seed)
        parts = [e for b in batches if len(e := model.examples(*stretches(b["value"].tolist()), rng))]
        if parts:
            weights, met = fitted_weights(np.concatenate(parts), seed)
            yield summands(np.concatenate((weights * met, met)))

    return run


def fit_terminality(columns: list[tuple[DataFrame, str]]) -> TerminalityModel:
    """Fits on all values of the columns that are not blank.

    Each shard fits weights of its own; a bin's weight is their mean by how often the shards met it. The shards and
    their order follow from a hash of the values, not from files and partitions. The driver gets what is known and one array.
    """
    values = reduce(DataFrame.unionByName, [df.select(F.col(name).alias("value")).filter(F.trim("value") != "") for df, name in columns])
    total = values.count()
    least = max(1, total / RARE)
    counts = spread(values).mapInPandas(counted_openings, "opens boolean, item string, n long").groupBy("opens", "item").agg(F.sum("n").alias("n"))
    known = counts.filter(F.when(F.col("opens"), F.col("n") >= least).otherwise(F.col("n") > least)).select("opens", "item").collect()
    openers, vocabulary = frozenset(r[1] for r in known if r[0]), frozenset(r[1] for r in known if not r[0])
    place = F.xxhash64("value")
    shards = values.repartition(-(-total // SHARD_VALUES) or 1, place).sortWithinPartitions(place)
    sums = summed(shards.mapInPandas(fitted_shard(openers, vocabulary), SUMMANDS), 2 * BINS)
    return TerminalityModel((sums[:BINS] / np.maximum(sums[BINS:], 1)).astype(np.float32), openers, vocabulary)


def _values(parts: list[tuple[str, DataFrame, str, str]]) -> DataFrame:
    """(tab, rec_id, field, part, site, value) of the values that are not blank; `part` is the place in `parts`."""
    rows = [
        df.select(F.lit(tab).alias("tab"), F.col(key).cast("long").alias("rec_id"), F.lit(column).alias("field"), F.lit(i).alias("part"), F.col("site").alias("site"), F.col(column).alias("value"))
        .filter(F.trim("value") != "")
        for i, (tab, df, key, column) in enumerate(parts)
    ]
    return reduce(DataFrame.unionByName, rows)


def copy_pairs(asked: DataFrame, offered: DataFrame) -> DataFrame:
    """(text_id, at): values with an open end and the texts that begin like them.

    asked(key, text_id), offered(key, piece, part, rec_id). Texts that go on alike are one partner (the smallest
    `at`), so copies are never paired with each other. What nobody asks for is dropped before any pair is made,
    and a bucket of many askers is split over salts.
    """
    counts = asked.groupBy("key").agg(F.count("*").alias("n"))
    met = offered.join(counts, "key").groupBy("key", "piece", "n").agg(F.min(F.struct("part", "rec_id")).alias("at"))
    n_salts = F.ceil(F.col("n") / BUCKET_ROWS).cast("int")
    long = met.select("key", "at", F.explode(F.sequence(F.lit(0), n_salts - 1)).alias("salt"))
    short = asked.join(counts, "key").select("key", "text_id", F.pmod(F.xxhash64("text_id"), n_salts).cast("int").alias("salt"))
    return short.join(long, ["key", "salt"]).select("text_id", "at").distinct()


def truncation_verdicts(
    parts: list[tuple[str, DataFrame, str, str]], model: TerminalityModel | None = None, partners: list[tuple[str, DataFrame, str, str]] | None = None
) -> DataFrame:
    """(tab, rec_id, field, site, cut, how) of every value of `parts` that is not blank.

    `how` is 'copy' where the alignment with a longer text decided, else 'closing'. Longer texts are those of the same
    source (a null source is one too) in `parts` and `partners`, lists of (table name, table, key, column); they need a key. A value
    with fewer than GRID[0] whole words, or one that closes its sentence, has no partner. Null and blank
    values give no row, repeated rows repeated results.
    """
    model = model or fit_terminality([(df, column) for _, df, _, column in parts])
    base, everything = _values(parts), _values([*parts, *(partners or [])])
    run = F.pandas_udf(profile_batch(model.weights, model.openers, model.vocabulary), PROFILE)
    profiled = cut_lineage(spread(base).withColumn("p", run("value", "site")).select(
        "tab", "rec_id", "field", "site", "p.cut", "p.copied", F.when(F.col("p.copied").isNotNull(), F.xxhash64("site", "p.copied")).alias("text_id"), "p.keys"))
    # equal beginnings of one source have equal keys, so any one of them stands for all
    shorts = cut_lineage(profiled.filter(F.col("text_id").isNotNull()).groupBy("text_id").agg(F.first("keys").alias("keys"), F.first("copied").alias("copied")))
    offering = everything.filter(F.col("rec_id").isNotNull()).select("part", "rec_id", "site", "value")
    pairs = cut_lineage(copy_pairs(shorts.select("text_id", F.explode("keys").alias("key")), spread(offering).mapInPandas(offered_beginnings, OFFERED)))
    wanted = small_side(pairs.select("at").distinct(), BROADCAST_PAIRS)
    texts = offering.select(F.struct("part", "rec_id").alias("at"), "value").join(wanted, "at").groupBy("at").agg(F.first("value").alias("long"))
    align = F.pandas_udf(align_batch, "string")
    # the longer texts come last, so that the pairs of each stand side by side
    both = pairs.join(shorts.select("text_id", "copied"), "text_id").join(texts, "at")
    ends = (
        both.select("text_id", align("copied", "long").alias("end"))
        .filter(F.col("end").isNotNull()).groupBy("text_id").agg(F.max(F.col("end") == "cut").alias("copy_cut"))
    )
    columns = ["tab", "rec_id", "field", "site"]
    settled = profiled.filter(F.col("text_id").isNull()).select(*columns, "cut", F.lit("closing").alias("how"))
    asked = profiled.filter(F.col("text_id").isNotNull()).join(ends, "text_id", "left").select(
        *columns, F.coalesce("copy_cut", "cut").alias("cut"), F.when(F.col("copy_cut").isNotNull(), "copy").otherwise("closing").alias("how"))
    return settled.unionByName(asked)


def truncation_rates(verdicts: DataFrame) -> DataFrame:
    """(site, field, n_values, n_cut, cut_rate): how often each source truncates; a null site is a source too."""
    return verdicts.groupBy("site", "field").agg(
        F.count("*").alias("n_values"), F.sum(F.col("cut").cast("long")).alias("n_cut")
    ).withColumn("cut_rate", F.round(F.col("n_cut") / F.col("n_values"), 6))
