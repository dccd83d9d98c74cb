"""Problem 4: cut and complete endings, aligned copies, near-copies against brute force."""

import random
import time
import zlib

import numpy as np
import pytest

from kiteloom.llm import truncation
from kiteloom.llm.truncation import GRID, Tail, TerminalityModel, aligned_end, beginnings

NOUNS = "queue cache server topic module parser bucket token proxy worker".split()
VERBS = "moved tuned rebuilt cleaned measured patched".split()


def sentence(rng):
    return rng.choice([
        f"The {rng.choice(NOUNS)} was {rng.choice(VERBS)} before the {rng.choice(NOUNS)} started again in production.",
        f"In spring we {rng.choice(VERBS)} the {rng.choice(NOUNS)} and every {rng.choice(NOUNS)} behind the old gateway.",
        f"Nobody saw why the {rng.choice(NOUNS)} needed only {rng.randint(2, 99)} seconds after that change.",
    ])


@pytest.fixture(scope="module")
def model():
    rng = random.Random(1)
    return TerminalityModel.fit([" ".join(sentence(rng) for _ in range(3)) for _ in range(700)] + ["Notes on the queue", "A short look at the cache", "What we moved"] * 20)


CUT = [
    "The queue was moved before the cac", "The queue was moved before the", "In spring we tuned the queue and every", "One sentence. The queue was moved bef [...]", "The queue was mov…", "The queue was moved before the […]", "The queue Read more",
    "<p>One.</p><p>The queue was mov", "<p>The queue was moved in <a href=\"https://x", "The queue, the cache,", "text ```\ncode never closed", "see [here](https://x.example/abc", "Nobody saw why the queue &hellip;",
]
WHOLE = [
    "The queue was moved before the cache started again in production.", "The queue was moved before the cache started again in production", "Notes on the queue", "A short look at the cache", "<p>Done.</p>", "Title\n\n- one item\n- another",
    "Demo: https://x.example/abc", "All done :)", "All done. (1/2)", "Ready 🚀", "<h3>Heading</h3>", "What we moved", "It holds: $a = b$", "", "   ", "One sentence. […]",
]


@pytest.mark.parametrize("text", CUT)
def test_cut_ends(model, text):
    assert model.cut(Tail(text))


@pytest.mark.parametrize("text", WHOLE)
def test_whole_ends(model, text):
    assert not model.cut(Tail(text))


def test_terminality_on_held_out_sentences(model):
    rng, right, n = random.Random(99), 0, 0
    for _ in range(300):
        s = sentence(rng)
        at = rng.randint(12, len(s) - 12)
        right += model.cut(Tail(s[:at])) + (not model.cut(Tail(s.rstrip("."))))
        n += 2
    assert right / n > 0.93


def test_terminality_is_fitted_on_all_values(spark, monkeypatch):
    monkeypatch.setattr(truncation, "SAMPLE_ROWS", 5, raising=False)  # once a bound of what was read
    monkeypatch.setattr(truncation, "SHARD_VALUES", 400, raising=False)
    rng = random.Random(1)
    rows = [" ".join(sentence(rng) for _ in range(3)) for _ in range(1200)] + ["The vestige was moved twice."] * 2 + ["Notes on the queue"] * 20
    df = spark.createDataFrame([(t,) for t in rows], "subtitle string")
    fitted = truncation.fit_terminality([(df.limit(0), "subtitle"), (df, "subtitle")])
    assert not truncation.fit_terminality([(df.limit(0).union(spark.createDataFrame([("...",)], df.schema)), "subtitle")]).weights.any()
    assert {"vestige", *NOUNS, *VERBS} <= fitted.vocabulary and "the vestige" in fitted.openers and "notes on" not in fitted.openers
    right = 0
    for _ in range(300):
        s = sentence(rng)
        right += fitted.cut(Tail(s[: rng.randint(12, len(s) - 12)])) + (not fitted.cut(Tail(s.rstrip("."))))
    assert right / 600 > 0.93


def test_an_ending_is_judged_without_a_search_from_every_place():
    text = "Notes" + " " * 20_000 + "on the queue"
    began = time.process_time()
    assert Tail(text).words == ["Notes", "on", "the", "queue"]
    assert time.process_time() - began < 0.5


def test_endings_that_may_be_marks_are_searched():
    rng = random.Random(7)
    marks = ["read more", "Continue Reading", "leer MÁS", "readıng", "weiterleſen", "더 보기", "계속 읽기", "more", "[…]", "(mehr)", "...", "…", "&hellip;", ".", "»", ">", " ", " ", "–", "(1/2)", ":)", ";-P", ":D", "🚀", "☀", "➿", "word", "P"]
    for _ in range(3000):
        text = "".join(rng.choice(marks) for _ in range(rng.randint(1, 6))).rstrip()
        assert truncation.without_omission(text) == truncation.OMISSION.sub("", text)
        assert truncation.without_ornament(text) == truncation._ORNAMENT.sub("", text)


@pytest.mark.parametrize("words", [["Queue"], ["The", "Parser"], ["In", "2024", "Über"], ["In", "spring", "we", "tuned", "v2"], ["The"] * 70 + ["don’t"]])
def test_bins_are_check_values_of_the_features(model, words):
    shapes = [truncation._shape(w, i > 0) for i, w in enumerate(words)]
    pair, (a, b, c), n, low = " ".join(shapes[:2]), ["^", "^", *shapes][-3:], min(len(words), 60), words[-1].lower()
    known = "known" if low in model.vocabulary or low.isdigit() else "unknown"
    features = ["1" + c, f"2{b} {c}", f"3{a} {b} {c}", "s" + low[-2:], "S" + low[-3:], f"o{shapes[0]}|{n}", f"p{pair}|{n}", f"c{pair}|{c}", f"C{pair}|{b} {c}", f"n{n}", known, "bias"]
    assert list(model._bins(words)) == [zlib.crc32(f.encode()) % truncation.BINS for f in features]


def test_alignment_decides():
    long = "Alpha beta gamma delta epsilon zeta. Eta theta iota kappa lambda mu."
    assert aligned_end("Alpha beta gamma delta epsilon zeta. Eta theta iota kap", long) == "cut"
    assert aligned_end("Alpha beta gamma delta epsilon zeta. Eta theta iota kappa", long) == "cut"
    assert aligned_end("Alpha beta gamma delta epsilon zeta", long) == "whole"
    assert aligned_end(long, long) is None and aligned_end("Something else entirely here", long) is None and aligned_end("", long) is None


def test_bands_of_beginnings_find_the_copies_that_brute_force_finds():
    rng = random.Random(5)
    longs = [[rng.choice("abcdefghijklmnopqrstuvwxyz") * 3 + str(rng.randint(0, 40)) for _ in range(rng.randint(40, 120))] for _ in range(80)]
    shorts = []
    for i, t in enumerate(longs):
        shorts.append((i, 0, t[: rng.randint(GRID[0], 39)]))
        edited = t[: rng.randint(30, 39)]
        edited[rng.randrange(12)] = "edited"
        shorts.append((i, 1, edited))
    row, _, key, piece = beginnings(longs, [0] * len(longs))
    offered = {}
    for r, k, p in zip(row, key, piece):
        offered.setdefault(int(k), set()).add(int(r))
    row, _, key, _ = beginnings([s for _, _, s in shorts], [0] * len(shorts), last_only=True)
    met = {}
    for r, k in zip(row, key):
        met.setdefault(int(r), set()).update(offered.get(int(k), ()))
    assert all(i in met[n] for n, (i, edits, _) in enumerate(shorts) if not edits)
    assert sum(i in met[n] for n, (i, edits, _) in enumerate(shorts) if edits) >= 0.8 * len(longs)
    assert all(found <= {shorts[n][0]} for n, found in met.items())  # nothing else begins like them
    other, _, key, _ = beginnings([longs[0]], [1])
    assert not set(key.tolist()) & set(offered)  # another source
    assert beginnings([["a"] * 3, []], [0, 0])[0].size == 0 and set(np.unique(beginnings([longs[0][:30], longs[0][:30]], [0, 0])[2], return_counts=True)[1]) == {2}


def test_messy_tables(spark, model):
    full = "The queue was moved before the cache started again in production. In spring we tuned the queue and every worker behind the old gateway."
    rows = [(1, full, "a", True), (2, full[:-12], "a", True), (3, full[:-12], None, True), (3, full[:-12], None, True), (4, None, "a", True), (5, "  ", "a", True), (6, "word " * 100_000 + "end.", "b", True)]
    df = spark.createDataFrame(rows, "seq long, subtitle string, site string, cut boolean")
    got = truncation.truncation_verdicts([("articles", df, "seq", "subtitle")], model)
    assert sorted((r.rec_id, r.cut, r.how) for r in got.collect()) == [(1, False, "closing"), (2, True, "copy"), (3, True, "closing"), (3, True, "closing"), (6, False, "closing")]
    rates = {r.site: (r.n_values, r.n_cut) for r in truncation.truncation_rates(got).collect()}
    assert rates == {"a": (2, 1), None: (2, 2), "b": (1, 0)}
    assert truncation.truncation_verdicts([("articles", df.limit(0), "seq", "subtitle")]).count() == 0


def test_items_cut_inside_a_word(model):
    assert model.cut(Tail("- one item\n- second it")) and model.cut(Tail("Notes\n\n1. the queue\n2. moved in produc"))
    assert not model.cut(Tail("- one item\n- second item")) and not model.cut(Tail("# Notes on the queue")) and not model.cut(Tail("- a\n- the Parse"))


def test_an_inserted_or_dropped_word_does_not_void_the_alignment():
    long = "Luckily, each buffer now reads its own endpoint before the test starts and the worker of the gateway stops. All is well."
    short = "each buffer now reads its own endpoint before the test starts and the worker of the gat"
    assert aligned_end(short, long) == "cut" and aligned_end("Luckily, then " + short, long) == "cut"
    assert aligned_end(short + "eway stops", long) == "whole"
    assert aligned_end(long.removeprefix("Luckily, "), long) is None and aligned_end(long, long.removeprefix("Luckily, ")) is None
    rng = random.Random(3)
    for _ in range(60):
        b = [rng.choice("abcd") for _ in range(rng.randint(3, 12))]
        a = list(b[: rng.randint(1, len(b))])
        a[rng.randrange(len(a))] = rng.choice("abcd")
        table = [[i + j if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                table[i][j] = min(table[i - 1][j] + 1, table[i][j - 1] + 1, table[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
        ends = truncation.banded_ends(a, b, 20)
        assert min(ends.values()) == min(table[-1]) and all(edits >= table[-1][j] for j, edits in ends.items())


def test_buckets_of_many_askers_are_salted_and_copies_are_one_partner(spark, monkeypatch):
    monkeypatch.setattr(truncation, "BUCKET_ROWS", 7)
    asked = [(key, i) for i in range(120) for key in (i % 3, 100 + i)] + [(50, 200)]
    offered = [(key, piece, 0, piece * 10 + copy) for key in (0, 1, 2, 105) for piece in range(4) for copy in range(3)] + [(77, 1, 0, 1)]
    got = sorted((r.text_id, r["at"].rec_id) for r in truncation.copy_pairs(
        spark.createDataFrame(asked, "key long, text_id long"), spark.createDataFrame(offered, "key long, piece long, part int, rec_id long")).collect())
    assert got == sorted((i, piece * 10) for i in range(120) for piece in range(4))


def test_a_longer_unrelated_text_in_the_bucket_hides_no_copy(spark, model):
    words = [f"{a}{b}" for a in NOUNS for b in VERBS]
    random.Random(3).shuffle(words)  # each bucket that the copies share holds longer texts
    start = " ".join(words[:30])
    others = [" ".join(words[:25] + random.Random(k).sample(words[30:], 10)) for k in range(12)]
    rows = [(1, start + " queue. Done.", "a"), (2, start[:-3], "a"), *((3 + i, t, "a") for i, t in enumerate(others))]
    got = truncation.truncation_verdicts([("articles", spark.createDataFrame(rows, "seq long, subtitle string, site string"), "seq", "subtitle")], model)
    assert {r.rec_id: (r.cut, r.how) for r in got.collect()}[2] == (True, "copy")


def test_partners_are_texts_of_the_same_source(spark, model):
    body = "The queue was moved before the cache started again in production. In spring we tuned the queue and every worker behind it."
    rows = [(1, body[:85] + " Read more", "a", body, 5), (2, body[:85], "b", None, 5), (3, body[:85], None, "  ", 5), (4, body[:85], "c", body[:85], 5), (None, None, "c", body, 5)]
    df = spark.createDataFrame(rows, "seq long, subtitle string, site string, body string, part int")
    got = truncation.truncation_verdicts([("articles", df, "seq", "subtitle")], model, [("articles", df, "seq", "body")])
    assert {r.rec_id: r.how for r in got.collect()} == {1: "copy", 2: "closing", 3: "closing", 4: "closing"}
    assert {r.rec_id: r.cut for r in got.collect()}[1]


def test_a_good_part_of_the_cut_values_is_found_by_alignment(spark):
    from oracle import DATA

    from kiteloom.llm.queries import _truncations

    counts = {r.how: r["count"] for r in _truncations(spark, str(DATA / "sf0.01")).filter("cut").groupBy("how").count().collect()}
    assert counts["copy"] >= 0.27 * (counts["copy"] + counts["closing"])
