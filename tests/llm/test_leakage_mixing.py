"""Problems 8 and 9: leaks against brute force; the mix by its properties."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from kiteloom.llm import leakage, mixing

VOCABULARY = "amber quarry stores crates while every foundry near hollow harbour holds more than seven 아침 저녁 항구 등대".split()


def brute(documents, items):
    words = lambda t: re.findall(r"[^\W_]+", t.lower())
    grams = {i: {tuple(w[k:k + 12]) for k in range(len(w) - 11)} for i, t in items if t for w in [words(t)]}
    return {(d, i) for d, t in documents if t for w in [words(t)] for k in range(len(w) - 11) for i, g in grams.items() if tuple(w[k:k + 12]) in g}


@pytest.fixture(scope="module")
def case():
    rng = random.Random(12)
    items = [(i, " ".join(rng.choice(VOCABULARY) for _ in range(rng.randint(10, 40))) + ".") for i in range(25)]
    documents = []
    for d in range(120):
        text = " ".join(rng.choice(VOCABULARY) for _ in range(60))
        if d % 2:
            words = rng.choice(items)[1].split()
            at, n = rng.randrange(len(words)), rng.randint(9, 20)
            piece = rng.choice(["  ", ", ", " -\n", " "]).join(words[at:at + n])
            text = text[:100] + " " + rng.choice([piece.upper(), piece]) + "! " + text[100:]
        documents.append((d, text))
    return documents + [(500, None), (501, ""), (502, "short"), (1, documents[1][1])], items + [(90, None), (91, "too short to leak")]


def test_leaks_equal_brute_force(spark, case):
    documents, items = case
    docs = spark.createDataFrame([(*d, 1) for d in documents], "doc_id long, text string, item_id int")
    held = spark.createDataFrame([(i, t, "k") for i, t in items], "item_id long, text string, kind string")
    want = brute(documents, items)
    got = leakage.leaked_items(docs, held).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want) > 20
    assert leakage.leaked_items(docs.limit(0), held).count() == 0 and leakage.leaked_items(docs, held.limit(0)).count() == 0
    report = {r.item_id: r.n_docs for r in leakage.leak_report(docs, held).collect()}
    assert report[90] == 0 and sum(report.values()) == len(want)


def test_blocks_of_items_and_chunks_of_texts_change_nothing(spark, case, monkeypatch):
    documents, items = case
    monkeypatch.setattr(leakage, "BLOCK_CHARS", 1000)
    monkeypatch.setattr(leakage, "CHUNK_CHARS", 500)
    docs, held = spark.createDataFrame(documents, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {tuple(r) for r in leakage.leaked_items(docs, held).collect()} == brute(documents, items)


def test_hits_in_parts_and_blocks_in_one_pass_change_nothing(spark, case, monkeypatch):
    documents, items = case
    monkeypatch.setattr(leakage, "HIT_PAIRS", 50)
    index = leakage.ItemIndex([i for i, t in items if t], [" ".join(re.findall(r"[^\W_]+", t.lower())) for _, t in items if t])
    texts = [" ".join(re.findall(r"[^\W_]+", (t or "").lower())) for _, t in documents]
    got = {(documents[d][0], int(index.ids[i])) for d, i in leakage.leaks_in(index, texts)}
    assert got == brute(documents, items)


def test_banded_alignment_bears_the_budgeted_edits():
    point = lambda t: leakage.codes([t])[0][:-1]
    item = "alpha beta gamma delta epsilon"
    for text, edits, want in ((item, 0, 30), ("x" + item, 0, 30), ("alpha beta gamXa delta epsilon", 0, 15), ("alpha beta gamXa delta epsilon", 1, 30), ("alpha beta gama delta epsilon", 1, 30), ("alpha beta gamXma delta epsilon", 1, 30), ("", 1, 1)):
        assert leakage.aligned_stretch(point(text), point(item), -2, 4, edits) == want, (text, edits, want)


def test_the_alignment_of_one_edit_equals_the_general_one():
    rng = np.random.default_rng(5)
    for _ in range(300):
        doc, item = rng.integers(0, 3, rng.integers(1, 30)), rng.integers(0, 3, rng.integers(1, 25))
        low = int(rng.integers(-8, 8))
        assert leakage.one_edit_stretch(doc, item, low, 4) == max(leakage.aligned_stretch(doc, item, low, 4, 1), 1), (doc, item, low)


def test_permutations_are_bijections():
    for n in (1, 2, 3, 10, 257, 4096):
        for key in (0, -5, 123456789):
            got = mixing.permuted(np.arange(n), np.full(n, n), np.full(n, key))
            assert sorted(got) == list(range(n))
    a, b = (mixing.permuted(np.arange(1000), np.full(1000, 1000), np.full(1000, k)) for k in (1, 2))
    assert (a != b).mean() > 0.9 and abs(np.corrcoef(np.arange(1000), a)[0, 1]) < 0.15


def drawn(spark, shares, caps, seed):
    counts = np.zeros((0, len(shares)), dtype=np.int64)
    rows = mixing.numbered_draws(mixing.drawn_shards(spark, shares, caps, seed)).orderBy("shard", "source").collect()
    if rows:
        counts = np.zeros((max(r.shard for r in rows) + 1, len(shares)), dtype=np.int64)
        for r in rows:
            counts[r.shard, r.source] = r.n
        for r in rows:  # a shard's own blocks and those of earlier shards come first
            assert (r.first, r.offset, r.size) == (counts[: r.shard, r.source].sum(), counts[r.shard, : r.source].sum(), counts[r.shard].sum())
    return counts


def test_draws_stay_within_the_caps(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_BLOCKS", 500)
    monkeypatch.setattr(mixing, "SHARDS_TOGETHER", 4)
    for seed in range(2):
        counts = drawn(spark, [0.5, 0.3, 0.2], [9000, 9000, 1500], seed)
        assert (counts.sum(axis=0) <= [9000, 9000, 1500]).all() and counts.sum() > 6500
        assert np.allclose(counts.sum(axis=0) / counts.sum(), [0.5, 0.3, 0.2], atol=0.03)
        assert (counts[:-1].sum(axis=1) == 500).all()
    assert drawn(spark, [0.5, 0.5], [10, 0], 1).sum() == 0 and drawn(spark, [], [], 1).sum() == 0


@pytest.fixture(scope="module")
def mixed(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["big"] * 8 + ["small", "tiny", "unwanted"]), " ".join(rng.choice(["alpha", "beta", "gamma", "한글"]) for _ in range(rng.randint(0, 900)))) for i in range(400)]
    rows += [(1000, None, "no channel"), (1001, "big", None), (1002, "big", ""), (rows[0][0], rows[0][1], rows[0][2])]
    docs = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, channel string, text string, n_tokens int")
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.3, 4), ("tiny", 0.2, 3), ("off", 0.0, 1), (None, 0.1, 1)], "channel string, target_share double, max_repeats int")
    return docs, targets, mixing.mixed_blocks(docs, targets).cache()


def test_mix_keeps_shares_caps_and_blocks(mixed):
    docs, targets, mix = mixed
    shares = {r.channel: r for r in mixing.mix_shares(mix, targets).collect()}
    for name, share, repeats in (("big", 0.5, 1), ("small", 0.3, 4), ("tiny", 0.2, 3)):
        assert abs(shares[name].actual_share - share) < 0.12 and shares[name].most_repeats <= repeats
    most = mix.groupBy("channel", "doc_id", "first_token").agg(F.count("*").alias("n")).groupBy("channel").agg(F.max("n").alias("n"))
    assert {r.channel: r.n for r in most.collect()}.items() <= {"big": 1, "small": shares["small"].most_repeats, "tiny": shares["tiny"].most_repeats}.items()
    sizes = [r.n for r in mix.groupBy("shard", "slot").agg(F.sum("n_tokens").alias("n")).collect()]
    assert max(sizes) == mixing.BLOCK_TOKENS and sum(s < mixing.BLOCK_TOKENS for s in sizes) <= 3 * 4
    per_shard = mix.groupBy("shard").agg(F.countDistinct("slot").alias("n"), F.max("slot").alias("m")).collect()
    assert all(r.n == r.m + 1 for r in per_shard)
    assert {r.channel for r in mix.select("channel").distinct().collect()} == {"big", "small", "tiny"}


def test_pieces_of_a_block_lie_end_to_end(mixed):
    docs, _, mix = mixed
    counted = {r.doc_id: r.n_tokens for r in mixing.token_counts(docs).collect()}
    assert counted[1001] == 0 and counted[1000] > 0
    spans = {}
    for r in mix.select("doc_id", "first_token", "n_tokens").distinct().collect():
        spans.setdefault(r.doc_id, []).append((r.first_token, r.n_tokens))
    for doc, parts in spans.items():
        parts.sort()
        assert all(a + n <= b for (a, n), (b, _) in zip(parts, parts[1:])) and parts[-1][0] + parts[-1][1] <= counted[doc]


def test_empty_inputs(mixed):
    docs, targets, _ = mixed
    assert mixing.mixed_blocks(docs.limit(0), targets).count() == 0 and mixing.mixed_blocks(docs, targets.limit(0)).count() == 0
