"""Problem 2: text that was read in the wrong character encoding.

A multinomial model over hashed byte bigrams tells, for each blank-free piece of a text, which chain
of wrong readings made it, or that it is clean. It is fitted on pieces of a bounded sample of records
that are garbled here by every chain. A predicted chain is undone and counts only if the bytes decode
strictly; chains that destroyed characters are reported as not restorable.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kiteloom.llm.batches import sampled_texts
from kiteloom.plans.runtime import spread

#: Records read for fitting, per column.
SAMPLE_ROWS = 1500
#: Bins of the hashed byte bigrams.
BINS = 1 << 14
#: Log-likelihood by which a chain must beat the clean reading.
MARGIN = 1.0

SINGLE_BYTE = ("latin-1", "cp1252", "cp1251", "mac_roman", "cp850", "iso8859_15")
_TABLES: dict[str, str] = {}
_BACK: dict[str, dict[str, int]] = {}


def _table(codec: str) -> str:
    """Character of each byte; bytes without one stand for themselves, as common readers do it."""
    if codec not in _TABLES:
        chars = []
        for b in range(256):
            try:
                chars.append(bytes([b]).decode(codec))
            except UnicodeDecodeError:
                chars.append(chr(b))
        _TABLES[codec] = "".join(chars)
    return _TABLES[codec]


def _read_as(data: bytes, codec: str) -> str:
    table = _table(codec)
    return "".join(table[b] for b in data)


def _bytes_of(text: str, codec: str) -> bytes:
    """Inverse of `_read_as`; raises where a character has no byte."""
    if codec not in _BACK:
        _BACK[codec] = {c: b for b, c in enumerate(_table(codec))}
    back = _BACK[codec]
    return bytes([back[c] for c in text])


def _misread(source: str, reader: str):
    return lambda text: _read_as(text.encode(source, "strict"), reader)


def _undo(source: str, reader: str):
    return lambda text: _bytes_of(text, reader).decode(source, "strict")


def _korean_only(text: str) -> str:
    """Refuses what is not Korean: legacy double bytes decode to something far too easily."""
    foreign = [c for c in text if ord(c) > 127]
    syllables = sum("가" <= c <= "힣" for c in foreign)
    if syllables < 2 or syllables < 0.8 * len(foreign):
        raise UnicodeDecodeError("euc_kr", b"", 0, 1, "not Korean")
    return text


#: Chains that keep all bytes: name -> (garble, undo).
CHAINS = {f"utf8>{r}": (_misread("utf-8", r), _undo("utf-8", r)) for r in SINGLE_BYTE}
CHAINS |= {
    f"utf8>{r}>utf8>{r}": (
        lambda t, r=r: _read_as(_read_as(t.encode(), r).encode(), r),
        lambda t, r=r: _bytes_of(_bytes_of(t, r).decode("utf-8"), r).decode("utf-8"),
    )
    for r in ("latin-1", "cp1252")
}
CHAINS |= {
    f"cp949>{r}": (
        lambda t, r=r: _read_as(t.encode("cp949"), r),
        lambda t, r=r: _korean_only(_bytes_of(t, r).decode("euc_kr")),
    )
    for r in ("latin-1", "cp1252")
}
CHAINS["utf8>cp949"] = (
    lambda t: t.encode("utf-8").decode("cp949"),
    lambda t: t.encode("cp949").decode("utf-8"),
)

_HOLES = "".join(c for b, c in enumerate(_table("cp1252")) if 128 <= b < 160 and ord(c) == b)


def _with_holes(sign: str):
    """UTF-8 read as cp1252 by a reader that has `sign` (or nothing) for bytes without character."""
    return lambda t: re.sub(f"[{_HOLES}]", sign, _read_as(t.encode(), "cp1252"))


def _mostly_decodes(piece: str) -> bool:
    """Whether the bytes of a piece with holes are UTF-8 but for the holes."""
    try:
        got = _bytes_of(piece, "cp1252").decode("utf-8", "replace")
    except KeyError:
        return False
    return sum(ord(c) > 127 and c != "�" for c in got) >= 1 and got.count("�") <= 2 * piece.count("?") + 1


#: Chains that lose characters: name -> garble. What they leave can be found, not restored.
LOSSY = {
    "utf8>ascii?": lambda t: re.sub(r"[^\x00-\x7f]", "?", t),
    "utf8>cp1252?": _with_holes("?"),
    "utf8>cp1252-": _with_holes(""),
    "utf8>ascii�": lambda t: t.encode("utf-8").decode("ascii", "replace"),
    "latin-1>utf8�": lambda t: t.encode("latin-1", "replace").decode("utf-8", "replace"),
    "cp949>utf8�": lambda t: t.encode("cp949").decode("utf-8", "replace"),
    "utf8>cp949�": lambda t: t.encode("utf-8").decode("cp949", "replace"),
}
CLASSES = ["clean", *CHAINS, *LOSSY]

#: Pieces worth scoring: blank-free runs with a character beyond ASCII, or with a question mark that
#: stands where no sentence ends.
PIECE = re.compile(r"[^ \t\r\n]*(?:[^\x00-\x7f]|(?<![^ \t\r\n(\"'\[{>;])\?|\?(?=\?)|(?<=[a-zA-Z])\?(?=[a-z]))[^ \t\r\n]*")
_URL = re.compile(r"https?://[^\s\"'<>)\]]+")


def bigram_bins(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bins of the byte bigrams of all pieces, a blank at both ends of each, and where each piece starts."""
    data = [b" " + p.encode("utf-8", "surrogatepass") + b" " for p in pieces]
    raw = np.frombuffer(b"".join(data), dtype=np.uint8).astype(np.uint32)
    starts = np.concatenate(([0], np.cumsum([len(d) for d in data])[:-1])).astype(np.int64)
    pairs = np.empty(len(raw), dtype=np.uint32)
    pairs[:-1] = raw[:-1] * 256 + raw[1:]
    pairs[-1] = raw[-1] * 256 + 32
    return (pairs * np.uint32(2654435761) >> np.uint32(32 - 14)).astype(np.int64), starts


class ChainModel:
    """Multinomial log-likelihoods of bigram bins by class."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights

    @classmethod
    def fit(cls, pieces: list[str]) -> ChainModel:
        weights = np.full((len(CLASSES), BINS), 0.05)
        for k, name in enumerate(CLASSES):
            made = []
            for piece in pieces:
                try:
                    got = piece if name == "clean" else (CHAINS[name][0] if name in CHAINS else LOSSY[name])(piece)
                except (UnicodeError, KeyError):
                    continue
                if name == "clean" or got != piece:
                    made.append(got)
            if made:
                bins, _ = bigram_bins(made)
                weights[k] += np.bincount(bins, minlength=BINS)
        return cls(np.log(weights / weights.sum(axis=1, keepdims=True)).astype(np.float32))

    def scores(self, pieces: list[str]) -> np.ndarray:
        """(pieces, classes) log-likelihoods."""
        bins, starts = bigram_bins(pieces)
        return np.stack([np.add.reduceat(w[bins], starts) for w in self.weights], axis=1)


def undo_chain(piece: str, name: str) -> str | None:
    """The piece with the chain undone, None unless it decodes strictly to something else."""
    try:
        # signs around a garbled stretch may be written rightly, so only characters beyond ASCII must fit
        got = CHAINS[name][1](piece)
    except (UnicodeError, KeyError):
        return None
    if name == "utf8>cp949" and sum(ord(c) > 127 for c in piece) == 1 and any(c.isalpha() and ord(c) > 127 for c in got):
        return None  # one syllable may happen to be the bytes of an accented letter
    return got if got != piece and any(ord(c) > 127 for c in got) else None


_STRETCH = re.compile(r"[^\x00-\x7f]+(?:[^\x00-\x7f]|(?<=[^\x00-\x7f])[\x00-\x7f]{1,2}(?=[^\x00-\x7f]))*")


def classify(model: ChainModel, pieces: list[str]) -> dict[str, tuple[str, str | None]]:
    """Garbled pieces: piece -> (chain, restored text or None)."""
    found: dict[str, tuple[str, str | None]] = {}
    if not pieces:
        return found
    scores = model.scores(pieces)
    clean = scores[:, 0]
    order = np.argsort(-scores, axis=1)
    for row, piece in enumerate(pieces):
        if "�" in piece:
            lossy = max(LOSSY, key=lambda n: scores[row, CLASSES.index(n)])
            found[piece] = (lossy, None)
            continue
        likely = [CLASSES[k] for k in order[row] if k and scores[row, k] >= clean[row] + MARGIN]
        # by likelihood, but strict UTF-8 is the far stronger proof and goes before legacy double bytes
        for name in sorted(likely, key=lambda n: (n in LOSSY, n.startswith("cp949>"))):
            if name in CHAINS:
                restored = undo_chain(piece, name)
                if restored is None:  # part of the piece may be right: undo stretch by stretch
                    # two Korean syllables may happen to be UTF-8 bytes, so a stretch read as cp949 must be longer
                    least = 3 if name == "utf8>cp949" else 1
                    parts = [undo_chain(m, name) if len(m) >= least else None for m in _STRETCH.findall(piece)]
                    if any(p is not None for p in parts):
                        fixed = iter(parts)
                        restored = _STRETCH.sub(lambda m: next(fixed) or m[0], piece)
                if restored is not None:
                    found[piece] = (name, restored)
                    break
            elif (name == "utf8>ascii?" and "?" in piece) or (name.startswith("utf8>cp1252") and _mostly_decodes(piece)):
                found[piece] = (name, None)
                break
    return found


def pieces_of(text: str) -> list[str]:
    if text.isascii() and "?" not in text:
        return []
    bare = _URL.sub(" ", text) if "://" in text else text
    return PIECE.findall(bare)


#: Question marks alone are weak evidence: this many pieces of them must stand in one text, unless one
#: stands inside a word.
MIN_QUESTION_PIECES = 2
_IN_WORD = re.compile(r"[^\W\d_]\?[^\W\d_]")


def repair_text(text: str, known: dict[str, tuple[str, str | None]]) -> tuple[str | None, str | None, bool]:
    """(chains, best text, fully restored) of a text, chains None where it is clean."""
    pieces = pieces_of(text)
    hits = [(p, *known[p]) for p in pieces if p in known]
    marks = [h for h in hits if h[1] == "utf8>ascii?"]
    if len(marks) < MIN_QUESTION_PIECES and not any(_IN_WORD.search(h[0]) for h in marks):
        hits = [h for h in hits if h[1] != "utf8>ascii?"]
    if not hits:
        return None, text, True
    fixed = text
    for piece, _, restored in sorted(hits, key=lambda h: -len(h[0])):
        if restored is not None:
            fixed = fixed.replace(piece, restored)
    return "+".join(sorted({h[1] for h in hits})), fixed, all(h[2] is not None for h in hits)


def repair_batch(weights: np.ndarray):
    model = ChainModel(weights)

    def run(text: pd.Series) -> pd.DataFrame:
        unique = {p for t in text if t is not None for p in pieces_of(t)}
        known = classify(model, sorted(unique))
        rows = [(None, None, None) if t is None else repair_text(t, known) for t in text]
        return pd.DataFrame(rows, columns=["chain", "fixed", "whole"])

    return run


REPAIR = "struct<chain:string,fixed:string,whole:boolean>"


def fit_on(texts: list[str]) -> ChainModel:
    """Fitted on the pieces that are clean by strict decoding: no control or replacement characters, no chain fits."""
    pieces = set()
    for text in texts:
        for piece in pieces_of(text):
            if re.search("[\x80-\x9f�]", piece) or any(undo_chain(piece, n) for n in CHAINS if n.startswith("utf8>")):
                continue
            pieces.add(piece)
    return ChainModel.fit(sorted(pieces) + ["What?", "really?!", "why?)", "Q?", "so?\"", "ok??", "(a?b:c)"])


def fit_encoding_model(columns: list[tuple[DataFrame, str]]) -> ChainModel:
    """Fits the model on at most SAMPLE_ROWS texts beyond ASCII of each column."""
    texts: list[str] = []
    for df, name in columns:
        texts += sampled_texts(df, name, SAMPLE_ROWS, F.col(name).rlike(r"[^\x00-\x7f]"))
    return fit_on(texts)


def with_repair(df: DataFrame, text: str, model: ChainModel, into: str = "repair") -> DataFrame:
    """Adds struct(chain, fixed, whole). Plain ASCII without question marks is never sent to Python."""
    odd = F.col(text).rlike(r"[^\x00-\x7f]|\?")
    run = F.pandas_udf(repair_batch(model.weights), REPAIR)
    return df.withColumn(into, run(F.when(odd, F.col(text))))


def garbled_values(parts: list[tuple[str, DataFrame, str, str]], model: ChainModel | None = None) -> DataFrame:
    """(tab, rec_id, field, chain, fixed, whole) of every value in which characters were changed or lost.

    `parts` lists (table name, table, key, column). `fixed` is the value with every restorable piece
    restored, `whole` tells whether that is all of it. Null and empty values give no row, repeated
    rows repeated results; other columns of the tables are not read.
    """
    model = model or fit_encoding_model([(df, column) for _, df, _, column in parts])
    result = None
    for tab, df, key, column in parts:
        slim = df.select(F.col(key).cast("long").alias("rec_id"), F.col(column).alias("value")).filter(
            F.col("value").rlike(r"[^\x00-\x7f]|\?")
        )
        found = with_repair(spread(slim), "value", model).filter(F.col("repair.chain").isNotNull())
        rows = found.select(
            F.lit(tab).alias("tab"), "rec_id", F.lit(column).alias("field"),
            F.col("repair.chain").alias("chain"), F.col("repair.fixed").alias("fixed"), F.col("repair.whole").alias("whole"),
        )
        result = rows if result is None else result.unionByName(rows)
    return result
